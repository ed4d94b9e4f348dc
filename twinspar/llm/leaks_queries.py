"""Queries p6_: documents that hold passages of eval_items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .leaks import leaks


def pairs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    items = table(spark, d, "eval_items").select(F.col("item_id").alias("item"), "text")
    return leaks(docs, items).select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "words_found", "item_words")


def found(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).select("doc_id", "item_id")


def by_item(spark: SparkSession, d: str) -> DataFrame:
    """Every item of eval_items with its task and the number of documents that hold it, none included."""
    held = pairs(spark, d).groupBy("item_id").agg(F.count("*").alias("documents"))
    return table(spark, d, "eval_items").select("item_id", "lang", "task").join(held, "item_id", "left").withColumn("documents", F.coalesce("documents", F.lit(0)).cast("bigint"))


QUERIES = {"p6_found": found, "p6_items": by_item}
SQL = {}
