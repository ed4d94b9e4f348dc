"""Splits that keep related records together: connected components by random-mate contraction, cut by cumulative weight.

Records that share any key belong together, and so on in chains. Each round every vertex throws a coin, by a hash of its
name and the round; a tail with a head as neighbour collapses into it (the least one), the edges are relabelled by two
joins, loops and repeats go. A constant share of the vertices goes in each round, until no edge is left; then the labels
are unwound from the last round to the first. Every round is written to the shared folder, so that a lost executor
costs no more than that round. Edges stay distributed at any size.

Defined results. A null key relates nothing. A record whose keys are all null stands alone. Repeated records are records
of their own, with the same keys and so the same split. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.curate import running_total
from ..session import cut, forget


#: Rounds that are unwound between two written tables.
UNWOUND = 3


def components(edges: DataFrame, seed: int = 5) -> DataFrame:
    """vertex, label of every vertex with an edge to another (u STRING, v STRING); the label is the least vertex of the component."""
    spark = edges.sparkSession
    left = cut(_clean(edges))
    moves: list[DataFrame] = []
    while not left.isEmpty():
        head = lambda c: F.xxhash64(c, F.lit(len(moves)), F.lit(seed)).bitwiseAND(1) == 1  # noqa: E731, B023
        ends = left.select(F.when(head("u"), F.col("v")).otherwise(F.col("u")).alias("x"), F.when(head("u"), F.col("u")).otherwise(F.col("v")).alias("y")).where(~head("x") & head("y"))
        move = cut(ends.groupBy("x").agg(F.min("y").alias("y")))
        nxt = cut(_clean(_moved(_moved(left, "u", move), "v", move)))
        forget(left)
        moves.append(move)
        left = nxt
    forget(left)
    labels = spark.createDataFrame([], "vertex string, label string")
    written: list[DataFrame] = []
    for i, move in enumerate(reversed(moves), 1):
        later = move.join(labels, F.col("y") == F.col("vertex"), "left").select(F.col("x").alias("vertex"), F.coalesce("label", "y").alias("label"))
        labels = later.unionByName(labels)
        if i % UNWOUND == 0 or i == len(moves):
            labels = cut(labels)
            written.append(labels)
    roots = labels.select(F.col("label").alias("vertex"), "label").distinct()
    whole = labels.unionByName(roots)
    least = whole.groupBy("label").agg(F.min("vertex").alias("least"))
    out = cut(whole.join(least, "label").select("vertex", F.col("least").alias("label")))
    for x in [*moves, *written]:
        forget(x)
    return out


def _clean(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct()


def _moved(edges: DataFrame, end: str, move: DataFrame) -> DataFrame:
    other = "v" if end == "u" else "u"
    return edges.join(move, F.col(end) == F.col("x"), "left").select(F.coalesce("y", end).alias(end), other)


def vertex(first: Column, others: list[Column], row: Column) -> Column:
    """The vertex of a record: its first key, or the first other one that is not null, or the record itself."""
    named = [F.concat(F.lit(f"{i}:"), c) for i, c in enumerate([first, *others])]
    return F.coalesce(*named, F.concat(F.lit("r:"), row.cast("string")))


def related(df: DataFrame, keys: list[str]) -> DataFrame:
    """vertex, label of the vertices that are related to others. df: vertex and the other keys.

    All vertices that have a key are tied to the least of them: a star, found by a pre-aggregated minimum, in place of all pairs.
    """
    edges = None
    for k in keys:
        pairs = cut(df.where(F.col(k).isNotNull()).select("vertex", k).distinct())
        hub = pairs.groupBy(k).agg(F.min("vertex").alias("u"), F.max("vertex").alias("top")).where("u <> top").select(k, "u")
        star = pairs.join(hub, k).select("u", F.col("vertex").alias("v"))
        edges = star if edges is None else edges.unionByName(star)
    return components(edges)


def assign(groups: DataFrame, shares: dict[str, float]) -> DataFrame:
    """component, weight, split: the components, heaviest first, cut by cumulative weight.

    A component goes to a split if its middle lies before the split's end. What a heavy component takes beyond a split's share is
    missing from the later splits in proportion.
    """
    rest = running_total(groups, "weight", [F.col("weight").desc(), F.col("component")]).withColumn("mid", F.col("before") + F.col("weight") / 2)
    names, out, start = list(shares), F.lit(None).cast("string"), F.lit(0.0)
    done = rest.withColumn("split", out).withColumn("start", start)
    for i, name in enumerate(names):
        left = sum(shares[n] for n in names[i:])
        end = F.col("start") + (F.col("total") - F.col("start")) * (shares[name] / left)
        here = F.col("split").isNull() & ((F.col("mid") < end) | F.lit(i == len(names) - 1))
        done = done.withColumn("split", F.when(here, name).otherwise(F.col("split")))
        if i < len(names) - 1:
            taken = done.where(F.col("split").isNotNull()).agg(F.coalesce(F.sum("weight"), F.lit(0)).cast("double").alias("start"))
            done = done.drop("start").crossJoin(F.broadcast(taken))
    return done.select("component", "weight", "split")


def grouped_splits(df: DataFrame, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """id, component, split of every row. df: id, vertex (see `vertex`) and the other keys that relate rows."""
    df = cut(df.select("id", "vertex", *keys))
    labels = related(df, keys)
    sizes = df.groupBy("vertex").agg(F.count("*").alias("n"))
    placed = cut(sizes.join(labels, "vertex", "left").select("vertex", "n", F.coalesce("label", "vertex").alias("component")))
    weights = placed.groupBy("component").agg(F.sum("n").alias("weight"))
    chosen = placed.join(assign(weights, shares), "component").select("vertex", "component", "split")
    return df.join(chosen, "vertex").select("id", "component", "split")
