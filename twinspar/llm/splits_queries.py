"""Queries p5_: splits of flowchart that keep projects and functions of the same source-level name together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import project_of, source_name
from ..session import table
from .sets import spread_join
from .splits import grouped_splits, related, vertex

SHARES = {"training": 0.7, "validation": 0.15, "testing": 0.15}


def rows(spark: SparkSession, d: str) -> DataFrame:
    """id, project, name, vertex of every row of flowchart; names of the runtime relate nothing and are null."""
    f = table(spark, d, "flowchart").select(F.col("func_id").alias("id"), project_of(F.col("idb_path")).alias("project"), source_name(F.col("func_name")).alias("name"))
    runtime = table(spark, d, "runtime_names").select(source_name(F.col("func_name")).alias("name"), F.lit(True).alias("everywhere")).where("name is not null").distinct()
    f = f.join(runtime, "name", "left").withColumn("name", F.when(F.col("everywhere").isNull(), F.col("name"))).drop("everywhere")
    return f.withColumn("vertex", vertex(F.col("project"), [F.col("name")], F.col("id")))


def found(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of projects of a component; a component of many projects is cut into pieces by the number of its pairs."""
    labels = related(rows(spark, d), ["name"]).where("vertex like '0:%'").withColumn("project", F.substring("vertex", 3, 1 << 30))
    one = lambda i: labels.select("label", F.col("project").alias(f"project_{i}"))
    return spread_join(one(1), one(2), "label").where("project_1 < project_2").select("project_1", "project_2")


def splits(spark: SparkSession, d: str) -> DataFrame:
    return grouped_splits(rows(spark, d), ["name"], SHARES).select(F.col("id").alias("func_id"), "component", "split")


QUERIES = {"p5_found": found, "p5_splits": splits}
SQL = {}
