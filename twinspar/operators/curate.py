"""Curation of function tables: filters, order-aware deduplication, path variables, leak-free splits, audits and counts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.paths import variables
from ..session import cut


def at_least_blocks(df: DataFrame, least: int = 5, column: str = "bb_num") -> DataFrame:
    return df.where(F.col(column) >= least)


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, in `order`: a pre-aggregated minimum over the whole row, so a hot key stays cheap. Null keys are one key."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return first.select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest)).select(*df.columns)


def with_variables(df: DataFrame, path: str = "idb_path") -> DataFrame:
    """The seven compilation variables that the path spells out."""
    return df.withColumns(variables(F.col(path)))


def only_in(df: DataFrame, column: str, values: Iterable[str]) -> DataFrame:
    return df.where(F.col(column).isin(*values))


def without_shared_names(splits: dict[str, DataFrame], name: str = "func_name") -> dict[str, DataFrame]:
    """training without the names of testing or validation, testing without those of validation, validation as it is."""
    names = {k: d.select(name).where(F.col(name).isNotNull()).distinct() for k, d in splits.items()}
    return {
        "training": splits["training"].join(names["testing"].union(names["validation"]).distinct(), name, "left_anti"),
        "validation": splits["validation"],
        "testing": splits["testing"].join(names["validation"], name, "left_anti"),
    }


def shared_names(a: DataFrame, b: DataFrame, name: str = "func_name") -> DataFrame:
    return a.select(name).intersect(b.select(name))


def without_singletons(df: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """Rows of groups of `least` or more. Group sizes are pre-aggregated and joined back; rows with a null key are in no group."""
    groups = df.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") >= least).drop("__n")
    return df.join(groups, keys, "left_semi")


def composition(df: DataFrame, sets: list[tuple[str, ...]]) -> DataFrame:
    """Counts by each set of columns in one pass: level (the set's name), values (joined by '/'), functions."""
    kinds = [F.struct(F.lit("/".join(s)).alias("level"), F.concat_ws("/", *(F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in s)).alias("value")) for s in sets]
    return df.select(F.explode(F.array(*kinds)).alias("k")).groupBy("k.level", "k.value").agg(F.count("*").alias("functions"))


def null_audit(df: DataFrame) -> DataFrame:
    """column, nulls of every column, in one pass."""
    one = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in df.columns))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in df.columns))).alias("x")).select("x.*")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are not unique, with their counts."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def missing(part: DataFrame, whole: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of `part` that `whole` does not have; empty if `part` is a subset."""
    return part.select(*keys).distinct().join(whole.select(*keys), keys, "left_anti")


def same_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one table has, and which."""
    return missing(a, b, keys).withColumn("only_in", F.lit("left")).unionByName(missing(b, a, keys).withColumn("only_in", F.lit("right")))


def without_keys(df: DataFrame, keys: list[str], unwanted: DataFrame) -> DataFrame:
    return df.join(unwanted.select(*keys).distinct(), keys, "left_anti")


def numbered(df: DataFrame, order: list[str], name: str = "idx") -> DataFrame:
    """Row numbers from 0 in `order`, without one task for all rows: ranges are numbered on their own and shifted by the counts before them.

    The ranges are written first: another evaluation could cut them elsewhere. `order` must have no ties.
    """
    parts = cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    before = F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
    counts = parts.groupBy("__part").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(before, F.lit(0))).drop("__n")
    inside = F.row_number().over(W.partitionBy("__part").orderBy(*order)) - 1
    return parts.withColumn(name, inside).join(F.broadcast(counts), "__part").withColumn(name, (F.col(name) + F.col("__before")).cast("bigint")).drop("__part", "__before")


def running_total(df: DataFrame, weight: str, order: list[Column]) -> DataFrame:
    """df with `before`, the sum of `weight` of all rows earlier in `order`, and `total`. `order` must have no ties.

    The rows are range-partitioned, so that a hot value is cut up too, and each range is summed on its own; only one sum per range is summed up over all.
    """
    parts = cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sums = parts.groupBy("__part").agg(F.sum(weight).alias("__sum"))
    earlier = F.sum("__sum").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
    starts = sums.select("__part", F.coalesce(earlier, F.lit(0)).alias("__start"), F.sum("__sum").over(W.partitionBy()).alias("total"))
    inside = F.sum(weight).over(W.partitionBy("__part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    return parts.join(F.broadcast(starts), "__part").withColumn("before", F.col("__start") + F.coalesce(inside, F.lit(0))).drop("__part", "__start")


def golden_diff(golden: DataFrame, output: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows of the golden table whose output is missing or differs, with the names of the columns that differ."""
    b = output.select(*keys, F.lit(True).alias("__there"), *(F.col(c).alias(f"__{c}") for c in columns))
    j = golden.join(b, keys, "left")
    differs = F.filter(F.array(*(F.when(~F.equal_null(F.col(c), F.col(f"__{c}")), c) for c in columns)), lambda x: x.isNotNull())
    return j.select(*keys, F.when(F.col("__there").isNull(), F.array(F.lit("<missing>"))).otherwise(differs).alias("differs")).where(F.size("differs") > 0)


def outcome_counts(df: DataFrame, by: list[str], outcome: Column, elapsed: Column) -> DataFrame:
    """by, rows, one count for each outcome ('ok', 'error', 'timeout'), elapsed: totals of a run."""
    return df.groupBy(*by).agg(F.count("*").alias("rows"), *(F.count_if(outcome == x).alias(x) for x in ("ok", "error", "timeout")), F.sum(elapsed).alias("elapsed"))


def ends(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """The first and the last n rows in `order`, each row once, with `end` ('head' or 'tail'): two top-k, nothing is sorted as a whole."""
    head = df.orderBy(*order).limit(n).withColumn("end", F.lit("head"))
    tail = df.orderBy(*(F.desc_nulls_last(c) for c in order)).limit(n).withColumn("end", F.lit("tail"))
    return head.unionByName(tail.join(head.select(*order), order, "left_anti"))
