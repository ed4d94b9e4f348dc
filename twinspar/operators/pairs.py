"""Comparison pairs: tasks of equal and different variables, positives by self-join, negatives by probing, deterministic sampling.

Sampling goes by hashes of keys, so a pair set is the same on every cluster and every engine that has MD5.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut
from .curate import numbered

# For each task, which of arch, bit, compiler, version and optimizations must be equal (True) or differ (False) in a positive pair.
FREE = ("arch", "bit", "compiler", "version", "optimizations")
TASKS: dict[str, tuple[bool | None, ...]] = {
    "arch": (False, True, True, True, True),
    "bit": (True, False, True, True, True),
    "comp": (True, True, False, False, True),
    "ver": (True, True, True, False, True),
    "opt": (True, True, True, True, False),
    "XA": (False, False, True, True, True),
    "XA+XO": (False, False, True, True, False),
    "XC": (True, True, False, False, False),
    "XC+XB": (True, False, False, False, False),
    "XM": (None, None, None, None, None),
}
TASKS["XO"] = TASKS["opt"]
RANGE = 1 << 16
# The published search of vulnerable functions, as the functions looked for in each firmware, its binary, and the binaries the functions are taken from.
SEARCHES = {
    "NETGEAR_R7000": ("IDBs/Dataset-Vulnerability/libcrypto.so.1.0.0_NETGEAR_R7000_1.0.2h_arm32.i64", "BN_bn2dec CMS_decrypt MDC2_Update PKCS7_dataDecode"),
    "TP-Link_Deco-M4": (
        "IDBs/Dataset-Vulnerability/libcrypto.so.1.0.0_TP-Link_Deco-M4_1.0.2d_mips32.i64",
        "BN_bn2dec BN_dec2bn BN_hex2bn CMS_decrypt EVP_EncodeUpdate EVP_EncryptUpdate PKCS7_dataDecode SRP_VBASE_get_by_user X509_NAME_oneline",
    ),
}
SOURCES = [f"IDBs/Dataset-Vulnerability/libcrypto.so.1.0.0_openssl_1.0.2d_{m}.i64" for m in ("arm32", "mips32", "x64", "x86")]


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def task_condition(task: str, left: str, right: str) -> Column:
    """What a task asks of two rows aliased left and right."""
    a, b = (lambda c: F.col(f"{left}.{c}")), (lambda c: F.col(f"{right}.{c}"))
    return all_of([a(c) == b(c) if same else a(c) != b(c) for c, same in zip(FREE, TASKS[task], strict=True) if same is not None])


def positives(df: DataFrame, task: str, id: str = "func_id", group: tuple[str, ...] = ("project", "library", "func_name")) -> DataFrame:
    """id_1 < id_2 of the same function, built as the task says. The equal variables are join keys, the different ones a residual condition.

    The pairs of a group are the result itself; AQE splits the sort-merge join's skewed groups.
    """
    same = [c for c, e in zip(FREE, TASKS[task], strict=True) if e]
    differ = [c for c, e in zip(FREE, TASKS[task], strict=True) if e is False]
    keys = [*group, *same]
    narrow = df.select(id, *group, *FREE)
    a, b = narrow.alias("a"), narrow.alias("b")
    on = all_of([F.col(f"a.{c}") == F.col(f"b.{c}") for c in keys] + [F.col(f"a.{c}") != F.col(f"b.{c}") for c in differ] + [F.col(f"a.{id}") < F.col(f"b.{id}")])
    return a.join(b, on).select(F.col(f"a.{id}").alias(f"{id}_1"), F.col(f"b.{id}").alias(f"{id}_2"), F.lit(task).alias("db_type"))


def hash_order(*parts: Column | str) -> Column:
    """A pseudo-random order that any engine with MD5 gives."""
    return F.md5(F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.col(p).cast("string") for p in parts]))


def sample(pairs: DataFrame, n: int, seed: int, keys: list[str]) -> DataFrame:
    """n rows in hash order: a top-k, so nothing is sorted as a whole."""
    return pairs.orderBy(hash_order(F.lit(seed), *keys), *keys).limit(n)


def sample_by(pairs: DataFrame, by: str, quotas: dict[str, int], seed: int, keys: list[str]) -> DataFrame:
    """Of each value of `by` so many rows as its quota, in hash order: a top-k for each value, so no value is gathered in one task."""
    return reduce(DataFrame.unionByName, [sample(pairs.where(F.col(by) == value), n, seed, keys) for value, n in quotas.items()])


def probe(seed: Column, n: Column) -> Column:
    """A number from 0 to n-1 from the first 32 bits of an MD5."""
    return F.pmod(F.conv(F.substring(F.md5(seed), 1, 8), 16, 10).cast("bigint"), n)


def negatives(left: DataFrame, pool: DataFrame, task: str, probes: int = 16, count: int = 1, id: str = "func_id", name: str = "func_name") -> DataFrame:
    """For each left row `count` rows of another name out of the pool, without a cross join.

    pool: idx (0..N-1), id, name, other columns. For each k < count, probe numbers hashed from (id, task, k, j) are looked up in the pool by an equi-join; the
    first j whose name differs is taken. Where none differs, one more probe is the place to go on from, to the next row of another name. So a left row
    gets fewer only if the pool has no other name. Rows without a name are no candidates and get none.
    """
    slots = left.select(F.col(id).alias(f"{id}_1"), F.col(name).alias("__n1")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    return _filled(slots, pool, task, probes, id, name)


def _filled(slots: DataFrame, pool: DataFrame, task: str, probes: int, id: str, name: str) -> DataFrame:
    """A row of the pool for each slot (id_1, __n1, k); see `negatives`."""
    size = pool.agg(F.count("*").alias("__size"))
    slots = slots.where("__n1 is not null").crossJoin(F.broadcast(size)).where("__size > 0")
    seed = lambda j: F.concat_ws(":", F.col(f"{id}_1").cast("string"), F.lit(task), F.col("k").cast("string"), j.cast("string"))
    places = pool.select("idx", F.col(id).alias(f"{id}_2"), F.col(name).alias("__n2"))
    other = F.col("__n1") != F.col("__n2")
    first = slots.withColumn("idx", probe(seed(F.lit(0)), F.col("__size"))).join(places, "idx")
    first = cut(first.select(f"{id}_1", "k", "__n1", F.when(other, F.col(f"{id}_2")).alias(f"{id}_2")))
    out = first.where(f"{id}_2 is not null").drop("__n1")
    # Only slots that the first probe did not fill are probed again.
    again = first.where(f"{id}_2 is null").drop(f"{id}_2").crossJoin(F.broadcast(size)).withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(probes - 1))))
    found = again.withColumn("idx", probe(seed(F.col("j")), F.col("__size"))).join(places, "idx").groupBy(f"{id}_1", "k").agg(F.max("__n1").alias("__n1"), F.min_by(f"{id}_2", F.when(other, F.col("j"))).alias(f"{id}_2"))
    found = cut(found)
    out, empty = out.unionByName(found.where(f"{id}_2 is not null").drop("__n1")), found.where(f"{id}_2 is null").drop(f"{id}_2")
    if not empty.isEmpty():
        after = _next_names(pool, id, name)
        places = after.agg(F.count("*").alias("__size"))
        last = empty.crossJoin(F.broadcast(places)).where("__size > 0").withColumn("place", probe(seed(F.lit(probes)), F.col("__size"))).join(after, "place")
        last = last.withColumn(f"{id}_2", F.when(F.col("__n1") != F.col(name), F.col(id)).otherwise(F.col("__next")))
        out = out.unionByName(last.where(f"{id}_2 is not null").select(f"{id}_1", "k", f"{id}_2"))
    return out.select(f"{id}_1", F.col("k").cast("bigint").alias("k"), f"{id}_2", F.lit(task).alias("db_type"))


def aligned_negatives(pos: DataFrame, pool: DataFrame, task: str, probes: int = 16, id: str = "func_id", name: str = "func_name") -> DataFrame:
    """`pos` (id_1, id_2) with id_neg: for each positive pair a row of another name for the same left end. A left end with several positives gets a draw for each.

    Null where the pool has no other name.
    """
    k = F.row_number().over(W.partitionBy(f"{id}_1").orderBy(f"{id}_2")) - 1
    slots = cut(pos.select(f"{id}_1", f"{id}_2").withColumn("k", k))
    named = slots.join(pool.select(F.col(id).alias(f"{id}_1"), F.col(name).alias("__n1")), f"{id}_1").select(f"{id}_1", "__n1", "k")
    drawn = _filled(named, pool, task, probes, id, name).select(f"{id}_1", "k", F.col(f"{id}_2").alias(f"{id}_neg"))
    return slots.join(drawn, [f"{id}_1", "k"], "left").select(f"{id}_1", f"{id}_2", f"{id}_neg", F.lit(task).alias("db_type"))


#: How many pairs of each task are kept for validation, for testing, and for ranking.
QUOTAS = {"validation": 10_000, "testing": 50_000, "ranking": 200}


def aligned_sample(pos: DataFrame, pool: DataFrame, task: str, n: int, seed: int, id: str = "func_id", name: str = "func_name") -> DataFrame:
    """n positive pairs in hash order, each with its negative: sampled before the negatives are drawn, as a pair's draw does not depend on the others that stay."""
    k = F.row_number().over(W.partitionBy(f"{id}_1").orderBy(f"{id}_2")) - 1
    numbered_pairs = pos.select(f"{id}_1", f"{id}_2").withColumn("k", k)
    slots = cut(sample(numbered_pairs, n, seed, [f"{id}_1", f"{id}_2"]))
    named = slots.join(pool.select(F.col(id).alias(f"{id}_1"), F.col(name).alias("__n1")), f"{id}_1").select(f"{id}_1", "__n1", "k")
    drawn = _filled(named, pool, task, 16, id, name).select(f"{id}_1", "k", F.col(f"{id}_2").alias(f"{id}_neg"))
    return slots.join(drawn, [f"{id}_1", "k"], "left").select(f"{id}_1", f"{id}_2", f"{id}_neg", F.lit(task).alias("db_type"))


def interleaved(aligned: DataFrame, order: list[str], id: str = "func_id") -> DataFrame:
    """idx, id_1, id_2, label, db_type: the positive pair of row x at 2x with label 1, its negative pair at 2x + 1 with label -1. Rows are numbered in `order`."""
    rows = numbered(aligned, order, "__x")
    both = F.array(F.struct((F.col("__x") * 2).alias("idx"), F.col(f"{id}_2").alias("other"), F.lit(1).alias("label")), F.struct((F.col("__x") * 2 + 1).alias("idx"), F.col(f"{id}_neg").alias("other"), F.lit(-1).alias("label")))
    out = rows.select(f"{id}_1", "db_type", F.explode(both).alias("p"))
    return out.select("p.idx", f"{id}_1", F.col("p.other").alias(f"{id}_2"), "p.label", "db_type")


def epoch(df: DataFrame, n: int, seed: int, number: int = 0, id: str = "func_id", name: str = "func_name") -> DataFrame:
    """n training triples (i, id_1, id_2, id_neg) of one epoch: two rows of one name and one of another, names drawn first, so that frequent ones do not win.

    Draws are hashes of (seed, epoch, i), found by equi-joins on numbered names and on places inside a name; no list of names comes to the driver. Names with one row only
    are drawn as the other name. Without two names, one of them with two rows, there are no triples.
    """
    rows = numbered(df.where(F.col(name).isNotNull()).select(F.col(name).alias("__name"), F.col(id).alias("__id")), ["__name", "__id"], "__at")
    rows = cut(rows)
    names = rows.groupBy("__name").agg(F.min("__at").alias("__first"), F.count("*").alias("__rows"))
    every, twice = cut(numbered(names, ["__name"], "__number")), cut(numbered(names.where("__rows >= 2"), ["__name"], "__number"))
    sizes = every.agg(F.count("*").alias("__all")).crossJoin(twice.agg(F.count("*").alias("__two")))
    draw = lambda what, of: probe(F.concat_ws(":", F.lit(seed), F.lit(number), F.col("i").cast("string"), F.lit(what)), of)
    i = df.sparkSession.range(n).select(F.col("id").alias("i")).crossJoin(F.broadcast(sizes)).where("__all > 1 and __two > 0")
    one = i.withColumn("__number", draw("name", F.col("__two"))).join(twice, "__number").drop("__number")
    a = draw("first", F.col("__rows"))
    one = one.withColumn("__a", a).withColumn("__b", F.pmod(F.col("__a") + 1 + draw("second", F.col("__rows") - 1), F.col("__rows")))
    one = one.select("i", "__all", "__name", (F.col("__first") + F.col("__a")).alias("__a"), (F.col("__first") + F.col("__b")).alias("__b"))
    # The other name: drawn among all but the first, by going past the first one's number.
    own = every.select("__name", F.col("__number").alias("__own"))
    other = one.join(own, "__name").withColumn("__o", draw("other", F.col("__all") - 1)).withColumn("__number", F.col("__o") + F.when(F.col("__o") >= F.col("__own"), 1).otherwise(0))
    other = other.join(every.select("__number", F.col("__first").alias("__f"), F.col("__rows").alias("__r")), "__number").withColumn("__c", F.col("__f") + draw("third", F.col("__r")))
    at = lambda c, out: rows.select(F.col("__at").alias(c), F.col("__id").alias(out))
    return other.select("i", "__a", "__b", "__c").join(at("__a", f"{id}_1"), "__a").join(at("__b", f"{id}_2"), "__b").join(at("__c", f"{id}_neg"), "__c").select("i", f"{id}_1", f"{id}_2", f"{id}_neg")


def search_pairs(functions: DataFrame, wanted: DataFrame, sources: DataFrame, targets: DataFrame, columns: list[str], most_queries: int = 10_000) -> DataFrame:
    """Pairs for a search of known functions: every row of the source binaries whose name is wanted for a target, with every row of that target's binaries.

    wanted: target, func_name; sources: idb_path; targets: target, idb_path; `columns` of functions come out as c_1 and c_2, with db_type 'XM'. Repeated rows come once. The wanted
    rows are a stated query set; they are counted and broadcast in blocks of `most_queries`.
    """
    left = functions.join(F.broadcast(sources.select("idb_path").distinct()), "idb_path").join(F.broadcast(wanted.distinct()), "func_name")
    left = cut(left.select("target", *(F.col(c).alias(f"{c}_1") for c in columns)).distinct())
    right = functions.join(F.broadcast(targets.distinct()), "idb_path").select("target", *(F.col(c).alias(f"{c}_2") for c in columns)).distinct()
    blocks = max(1, -(-left.count() // most_queries))
    parts = [left if blocks == 1 else left.where(F.pmod(F.xxhash64(*left.columns), F.lit(blocks)) == b) for b in range(blocks)]
    joined = reduce(DataFrame.unionByName, [right.join(F.broadcast(p), "target") for p in parts])
    return joined.select(*(f"{c}_1" for c in columns), *(f"{c}_2" for c in columns), F.lit("XM").alias("db_type"))


def published_search(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """wanted, sources and targets of the published search, for `search_pairs`."""
    wanted = spark.createDataFrame([(t, f) for t, (_, names) in SEARCHES.items() for f in names.split()], "target string, func_name string")
    return wanted, spark.createDataFrame([(x,) for x in SOURCES], "idb_path string"), spark.createDataFrame([(t, b) for t, (b, _) in SEARCHES.items()], "target string, idb_path string")


def equal_ends(pairs: DataFrame, column: str) -> DataFrame:
    """Pairs whose ends have the same value, which a search for similar functions must not have; null equals nothing."""
    return pairs.where(F.col(f"{column}_1") == F.col(f"{column}_2"))


def with_results(pairs: DataFrame, results: DataFrame, keys: tuple[str, ...] = ("idb_path_1", "fva_1", "idb_path_2", "fva_2"), score: str = "sim") -> DataFrame:
    """Pairs with the score of a result table on the four keys; pairs without a result stay, with a null score. A result given several times counts once, with its greatest score."""
    one = results.groupBy(*keys).agg(F.max(score).alias(score))
    return pairs.join(one, list(keys), "left")


def _next_names(pool: DataFrame, id: str, name: str) -> DataFrame:
    """place, id, name, __next: the named rows of the pool, numbered, each with the next one of another name; after the last comes the first. None if there is one name only.

    Runs of a name are found by an equi-join with the row before; the next start of a run is looked for in ranges of places first, then among the ranges.
    """
    rows = cut(numbered(pool.where(F.col(name).isNotNull()).select("idx", id, name), ["idx"], "place"))
    n = rows.agg(F.count("*").alias("__size"))
    before = rows.crossJoin(F.broadcast(n)).select(((F.col("place") + 1) % F.col("__size")).alias("place"), F.col(name).alias("__before"))
    starts = rows.join(before, "place").select("place", id, name, F.floor(F.col("place") / RANGE).alias("__range"), F.when(F.col(name) != F.col("__before"), F.struct("place", id)).alias("__start"))
    starts = cut(starts)
    ranges = starts.groupBy("__range").agg(F.min("__start").alias("__first"))
    ranges = ranges.withColumn("__later", F.min("__first").over(W.orderBy("__range").rowsBetween(1, W.unboundedFollowing))).drop("__first")
    here = F.min("__start").over(W.partitionBy("__range").orderBy("place").rowsBetween(1, W.unboundedFollowing))
    wrapped = starts.agg(F.min("__start").alias("__wrapped"))
    out = starts.withColumn("__here", here).join(ranges, "__range").crossJoin(F.broadcast(wrapped))
    return out.select("place", id, name, F.coalesce("__here", "__later", "__wrapped")[id].alias("__next"))


def described(pairs: DataFrame, df: DataFrame, columns: list[str], id: str = "func_id") -> DataFrame:
    """Pairs with the columns of both ends, as c_1 and c_2: two joins against one table. A missing end leaves nulls."""
    side = lambda i: df.select(F.col(id).alias(f"{id}_{i}"), *(F.col(c).alias(f"{c}_{i}") for c in columns))
    return pairs.join(side(1), f"{id}_1", "left").join(side(2), f"{id}_2", "left")


def triplets(pos: DataFrame, neg: DataFrame, id: str = "func_id") -> DataFrame:
    """anchor, positive, negative: pairs with the same left end."""
    return pos.select(F.col(f"{id}_1").alias("anchor"), F.col(f"{id}_2").alias("positive")).join(neg.select(F.col(f"{id}_1").alias("anchor"), F.col(f"{id}_2").alias("negative")), "anchor")


def used(pairs: DataFrame, df: DataFrame, id: str = "func_id") -> DataFrame:
    """The rows of df that some pair names."""
    ends = pairs.select(F.col(f"{id}_1").alias(id)).union(pairs.select(F.col(f"{id}_2").alias(id))).distinct()
    return df.join(ends, id, "left_semi")


def combinations(described_pairs: DataFrame, columns: tuple[str, ...] = FREE) -> DataFrame:
    """How often each unordered pair of values of each variable occurs: variable, low, high, pairs."""
    each = [F.struct(F.lit(c).alias("variable"), F.least(f"{c}_1", f"{c}_2").alias("low"), F.greatest(f"{c}_1", f"{c}_2").alias("high")) for c in columns]
    return described_pairs.select(F.explode(F.array(*each)).alias("v")).groupBy("v.variable", "v.low", "v.high").agg(F.count("*").alias("pairs"))


def unordered(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Each unordered pair once."""
    return pairs.select(F.least(a, b).alias(a), F.greatest(a, b).alias(b)).distinct()


def all_against(queries: DataFrame, targets: DataFrame, most_queries: int = 10_000) -> DataFrame:
    """Every query with every target. The queries are a stated set: they are counted, broadcast if `most_queries` or fewer, and else joined in blocks of that size."""
    n = queries.count()
    blocks = max(1, -(-n // most_queries))
    out = None
    for b in range(blocks):
        block = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64(*queries.columns), F.lit(blocks)) == b)
        part = targets.crossJoin(F.broadcast(block))
        out = part if out is None else out.unionByName(part)
    return out
