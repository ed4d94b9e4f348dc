"""Queries p2_: functions of flowchart that are in training and in validation or testing."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import dataset_of, digest_of, source_name, split_of
from ..session import table
from .overlap import overlap_report, overlapping_pairs


_ADDRESS = re.compile(r"(?:0x)?([0-9a-f]{1,16})$")


def _offsets(listed: str | None, start: str | None) -> list[int] | None:
    """The distinct block addresses of a ';' list minus the start, sorted; parts that are no address are left out."""
    if listed is None or start is None or not (at := _ADDRESS.match(start.strip().lower())):
        return None
    base = int(at[1], 16)
    try:
        found = {int(x, 16) for x in listed.split(";") if x}
    except ValueError:
        found = {int(m[1], 16) for x in listed.lower().replace(",", ";").split(";") if (m := _ADDRESS.match(x.strip()))}
    wrap = lambda x: (x + (1 << 63)) % (1 << 64) - (1 << 63)
    return sorted({wrap(x - base) for x in found})


def block_offsets(df: DataFrame, listed: str, start: str) -> DataFrame:
    """df with `items`, the block offsets, in place of the columns `listed` and `start`."""
    keep = [c for c in df.columns if c not in (listed, start)]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(keep)
            items = [_offsets(a, b) for a, b in zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(items, pa.list_(pa.int64()))], names=[*keep, "items"])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, listed, start).mapInArrow(kernel, f"{schema}, items array<bigint>")


def functions(spark: SparkSession, d: str) -> DataFrame:
    """id, split, train, name, digest, items, dataset of the rows of flowchart that are in a split."""
    f = table(spark, d, "flowchart").select("func_id", "split_name", "func_name", "hashopcodes", "idb_path", "bb_list", "start_ea")
    f = f.withColumn("split", split_of(F.col("split_name"))).where("split is not null")
    rows = f.select(
        F.col("func_id").alias("id"),
        "split",
        (F.col("split") == "training").alias("train"),
        source_name(F.col("func_name")).alias("name"),
        digest_of(F.col("hashopcodes")).alias("digest"),
        dataset_of(F.col("idb_path")).alias("dataset"),
        "bb_list",
        "start_ea",
    )
    return block_offsets(rows, "bb_list", "start_ea")


def found(spark: SparkSession, d: str) -> DataFrame:
    pairs = overlapping_pairs(functions(spark, d))
    return pairs.select(F.least("id_t", "id_h").alias("func_id_1"), F.greatest("id_t", "id_h").alias("func_id_2"))


def report(spark: SparkSession, d: str) -> DataFrame:
    return overlap_report(functions(spark, d), ["split", "dataset"])


QUERIES = {"p2_found": found, "p2_report": report}

SQL = {}
