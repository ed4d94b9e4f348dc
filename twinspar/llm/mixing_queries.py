"""Queries p7_: the sources of documents in the shares of mix_targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, table
from .mixing import balance, copies, count_tokens, masses, mix


def counted(spark: SparkSession, d: str) -> DataFrame:
    return count_tokens(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", "text"), "text")


def found(spark: SparkSession, d: str) -> DataFrame:
    return balance(masses(counted(spark, d), table(spark, d, "mix_targets"))).where("short").select("source")


def plan(spark: SparkSession, d: str) -> DataFrame:
    return mix(cut(counted(spark, d)), table(spark, d, "mix_targets"))


def records(spark: SparkSession, d: str) -> DataFrame:
    docs = cut(counted(spark, d))
    rates = balance(masses(docs, table(spark, d, "mix_targets")))
    return copies(docs, rates).select(F.col("id").alias("doc_id"), F.col("key").alias("source"), "tokens", "copies")


QUERIES = {"p7_found": found, "p7_plan": plan, "p7_copies": records}
SQL = {}
