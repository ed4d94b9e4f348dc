"""Queries p3_: similar signatures in catalog_sigs, vuln_sigs and fss_hashes."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .setjoin import Bands, link_counts, similar_pairs

CATALOG = Bands(bands=84, rows=3, num=1, den=2)
FSS = Bands(bands=45, rows=13, num=9, den=10)


_NUMBER = re.compile(r"(?<![\w.])\d+(?![\w.])")


def _number(digits: str) -> int:
    """A number as BIGINT: itself below 2^63, else a negative one from a 63-bit hash, so that long numbers stay apart from each other and from short ones."""
    n = int(digits[-4000:]) if len(digits) > 18 else int(digits)
    if n < 1 << 63 and len(digits) <= 4000:
        return n
    return -1 - (int.from_bytes(hashlib.blake2b(digits.lstrip("0").encode(), digest_size=8).digest(), "big") >> 1)


def number_sets(df: DataFrame, text: str) -> DataFrame:
    """df with `items`, the distinct whole numbers of a list, sorted, whatever stands between them, in place of the column `text`; null where there is none."""
    keep = [c for c in df.columns if c != text]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = [sorted(set(map(_number, _NUMBER.findall(t)))) or None if t else None for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(items, pa.list_(pa.int64()))], names=[*keep, "items"])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, text).mapInArrow(kernel, f"{schema}, items array<bigint>")


def word(text: Column) -> Column:
    """A 64-bit word in decimal, signed or not, or in hexadecimal with 0x; null if it is none."""
    t = F.lower(F.regexp_replace(text, r"\s+", ""))
    hexadecimal = F.conv(F.substring(t, 3, 16), 16, -10)
    return F.when(t.rlike("^0x[0-9a-f]{1,16}$"), hexadecimal).when(t.rlike("^[0-9]+$"), F.conv(t, 10, -10)).when(t.rlike("^-[0-9]+$"), t).try_cast("bigint")


def catalog(spark: SparkSession, d: str) -> DataFrame:
    """id, items of both catalogue tables."""
    one = lambda name: table(spark, d, name).select(F.col("sig_id").alias("id"), "catalog_hash_list")
    return number_sets(one("catalog_sigs").unionByName(one("vuln_sigs")), "catalog_hash_list")


def words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fss_hashes").select(F.col("fss_id").alias("id"), word(F.col("hashes0")).alias("word"))


def found(spark: SparkSession, d: str) -> DataFrame:
    known = lambda i: table(spark, d, "vuln_sigs").select(F.col("sig_id").alias(f"id_{i}"), F.lit(True).alias(f"k{i}"))
    within = similar_pairs(catalog(spark, d), "items", CATALOG).join(known(1), "id_1", "left").join(known(2), "id_2", "left").where("k1 is null or k2 is null")
    out = lambda df, field: df.select(F.lit(field).alias("field"), "id_1", "id_2")
    return out(within, "catalog_hash_list").unionByName(out(similar_pairs(words(spark, d), "word", FSS), "hashes0"))


def catalog_links(spark: SparkSession, d: str) -> DataFrame:
    return link_counts(catalog(spark, d), "items", CATALOG)


def word_links(spark: SparkSession, d: str) -> DataFrame:
    return link_counts(words(spark, d), "word", FSS)


QUERIES = {"p3_found": found, "p3_catalog_links": catalog_links, "p3_hash_links": word_links}
SQL = {}
