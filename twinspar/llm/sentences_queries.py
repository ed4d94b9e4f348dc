"""Queries p8_: the sentences of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from .sentences import sentences


def found(spark: SparkSession, d: str) -> DataFrame:
    return sentences(table(spark, d, "documents"), "doc_id", "text")


def texts(spark: SparkSession, d: str) -> DataFrame:
    """The sentences themselves, numbered in each document."""
    return sentences(table(spark, d, "documents"), "doc_id", "text", with_text=True)


QUERIES = {"p8_found": found, "p8_sentences": texts}
SQL = {}
