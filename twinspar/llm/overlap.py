"""The same or nearly the same records across splits, by bit fingerprints in segments.

A record has a digest, and a set under a name (here: block offsets under a source-level name). Two records of
different splits overlap if their digests are equal, or if names are equal and the sets have a Jaccard overlap of
num/den or more. Such sets differ in at most r = (|A|+|B|)(den-num)/(den+num) elements. So each set, as a bit
fingerprint over a hashed universe, is cut into more segments than r for its size class: by the pigeonhole
principle at least one segment is equal in both, and joining on segment codes loses no pair. A 64-bit parity
fingerprint carried along must lie within the same Hamming radius, which leaves few candidates; these are then
verified on the sets themselves.

Copies (equal name and set) are one class from the start, so a group of copies costs one row in the search.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .sets import bucket_pairs, jaccard_at_least, key128, mix64, spread_join


@dataclass(frozen=True)
class OverlapParams:
    """Smallest set that takes part, and the least Jaccard overlap as a fraction."""

    min_items: int = 5
    num: int = 4
    den: int = 5


def size_classes(most: int, p: OverlapParams) -> tuple[np.ndarray, np.ndarray]:
    """Lower ends of the size classes and the number of segments of each. Sets that can match lie in one class or in neighbours."""
    low, segments, lo = [], [], max(1, p.min_items)
    while not low or low[-1] <= most:
        hi = lo * p.den // p.num
        low.append(lo)
        segments.append(2 * hi * (p.den - p.num) // (p.den + p.num) + 1)
        lo = hi + 1
    return np.array(low), np.array(segments)


def segment_codes(name: np.ndarray, items: pa.ListArray, p: OverlapParams) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """code, row, fp (64-bit parity fingerprint) and n of each segment of each set, for its own size class and the next.

    The element 0, which nearly all sets have, is left out of the segments; that only brings sets nearer together.
    """
    offsets = np.asarray(items.offsets, dtype=np.int64)
    n = np.diff(offsets)
    values = np.asarray(items.values, dtype=np.int64)[offsets[0] : offsets[-1]]
    owner = np.repeat(np.arange(len(n)), n)
    h = mix64(values.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    fp = np.zeros(len(n), np.uint64)
    np.bitwise_xor.at(fp, owner, np.uint64(1) << (h >> np.uint64(58)))
    h[values == 0] = 0
    low, segments = size_classes(int(n.max(initial=1)), p)
    own = np.searchsorted(low, n, side="right") - 1
    low, segments = size_classes(int(n.max(initial=1)) * 2 + 2, p)
    codes, rows = [], []
    for level in (own, own + 1):
        k = segments[level]
        start = np.cumsum(k) - k
        at = start[owner] + (h >> np.uint64(8)) % k[owner].astype(np.uint64)
        total = np.zeros(int(k.sum()), np.uint64)
        np.add.at(total, at.astype(np.int64), h)
        row = np.repeat(np.arange(len(n)), k)
        number = np.arange(len(row)) - start[row]
        with np.errstate(over="ignore"):
            seed = name.view(np.uint64)[row] + mix64((level[row].astype(np.uint64) << np.uint64(32)) + number.astype(np.uint64) + np.uint64(1))
            codes.append(mix64(total + seed))
        rows.append(row)
    row = np.concatenate(rows)
    return np.concatenate(codes).view(np.int64), row, fp.view(np.int64)[row], n[row]


def _blocks(classes: DataFrame, p: OverlapParams) -> DataFrame:
    """code, a, b (the class), fp, n, sides (1: has a training row, 2: has a held-out row) of each segment of each class."""
    names = ["code", "a", "b", "fp", "n", "sides"]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                c = batch.slice(at, 2000)
                code, row, fp, n = segment_codes(np.asarray(c.column(2), dtype=np.int64), c.column(3), p)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(code), c.column(0).take(take), c.column(1).take(take), pa.array(fp), pa.array(n), c.column(4).take(take)], names=names)

    sides = (F.col("t").cast("int") + F.col("h").cast("int") * 2).cast("bigint").alias("sides")
    return classes.select("cid.a", "cid.b", F.col("nk.a").alias("name"), "items", sides).mapInArrow(kernel, ", ".join(f"{c} bigint" for c in names))


def prepare(df: DataFrame, p: OverlapParams, keep: list[str] = []) -> DataFrame:
    """The rows that can take part, written once: id, train, nk and dk (keys of name and digest, null where there is none), cid (key of the class of
    equal name and items), items, and the columns `keep`.

    df: id, train (BOOLEAN, null = in no split), name, digest (null = none), items (ARRAY<BIGINT>, distinct, sorted, no nulls; null = none).
    """
    has = lambda c, *parts: F.when(F.col(c).isNotNull(), key128(*map(F.col, parts)))
    rows = df.where(F.col("train").isNotNull() & (F.size("items") >= p.min_items))
    return cut(rows.select("id", "train", has("name", "name").alias("nk"), has("digest", "digest").alias("dk"), has("name", "name", "items").alias("cid"), "items", *keep))


def on_both_sides(rows: DataFrame, key: str) -> DataFrame:
    """The values of `key` that training rows have and held-out rows have: a pre-aggregated group-by of narrow rows."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max("train").alias("t"), F.max(~F.col("train")).alias("h")).where("t and h").select(key)


def class_pairs(rows: DataFrame, p: OverlapParams) -> DataFrame:
    """cid_t, cid_h: classes with a training row and classes with a held-out row that overlap, themselves included.

    Only classes whose name is on both sides are fingerprinted.
    """
    named = rows.join(on_both_sides(rows, "nk"), "nk").groupBy("cid", "nk", "items").agg(F.max("train").alias("t"), F.max(~F.col("train")).alias("h"))
    classes = cut(named)
    same = classes.where("t and h").select(F.col("cid").alias("cid_t"), F.col("cid").alias("cid_h"))

    def accept(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
        """x has a training row, y a held-out one, and the fingerprints are within the radius of the two sizes."""
        (_, _, fx, nx, sx), (_, _, fy, ny, sy) = x, y
        return (sx & 1 > 0) & (sy & 2 > 0) & (np.bitwise_count((fx ^ fy).view(np.uint64)).astype(np.int64) * (p.num + p.den) <= (nx + ny) * (p.den - p.num))

    found = bucket_pairs(_blocks(classes, p), ["a", "b"], ["fp", "n", "sides"], accept)
    candidates = found.select(F.struct(F.col("a_l").alias("a"), F.col("b_l").alias("b")).alias("cid_t"), F.struct(F.col("a_r").alias("a"), F.col("b_r").alias("b")).alias("cid_h"))
    sets = lambda tag: classes.where(tag).select(F.col("cid").alias(f"cid_{tag}"), F.col("nk").alias(f"nk_{tag}"), F.col("items").alias(f"items_{tag}"))
    verified = candidates.join(sets("t"), "cid_t").join(sets("h"), "cid_h").where((F.col("nk_t") == F.col("nk_h")) & jaccard_at_least(F.col("items_t"), F.col("items_h"), p.num, p.den))
    return cut(same.unionByName(verified.select("cid_t", "cid_h")))


def overlapping_pairs(df: DataFrame, p: OverlapParams = OverlapParams()) -> DataFrame:
    """id_t, id_h, by ('digest' or 'name'): every training row and held-out row that overlap, once each.

    Rows without a split, and with fewer than min_items items, are in no pair; equal digests come first, so a pair that
    fits both ways is called 'digest'. Hot digests and classes are split. An empty input gives no rows.
    """
    rows = prepare(df, p)
    side = lambda r, t, tag: r.where(F.col("train") == t).select(F.col("id").alias(f"id_{tag}"), F.col("dk").alias(f"dk_{tag}"), F.col("cid").alias(f"cid_{tag}"))
    shared = cut(rows.select("id", "train", "dk").join(on_both_sides(rows, "dk"), "dk"))
    equal = spread_join(shared.where("train").select("dk", F.col("id").alias("id_t")), shared.where("not train").select("dk", F.col("id").alias("id_h")), "dk")
    pairs = class_pairs(rows, p)
    both = cut(spread_join(pairs, side(rows, True, "t").join(pairs.select("cid_t").distinct(), "cid_t"), "cid_t").drop("cid_t"))
    by_name = spread_join(both, side(rows, False, "h").join(pairs.select("cid_h").distinct(), "cid_h"), "cid_h").where(~F.equal_null("dk_t", "dk_h") | F.col("dk_t").isNull())
    return equal.select("id_t", "id_h", F.lit("digest").alias("by")).unionByName(by_name.select("id_t", "id_h", F.lit("name").alias("by")))


def overlap_report(df: DataFrame, groups: list[str], p: OverlapParams = OverlapParams()) -> DataFrame:
    """Per `groups` (columns of the held-out rows, such as split and source): held-out rows, and how many of them overlap with
    training by digest, by name and set, and in any way. Counted per row, from classes; no pair is written out."""
    rows = prepare(df, p, groups)
    digests = on_both_sides(rows, "dk").withColumn("d", F.lit(1))
    near = class_pairs(rows, p).select(F.col("cid_h").alias("cid")).distinct().withColumn("c", F.lit(1))
    held = rows.where("not train").select("dk", "cid", *groups).join(digests, "dk", "left").join(near, "cid", "left")
    count = lambda c: F.count_if(c).alias
    d, c = F.col("d").isNotNull(), F.col("c").isNotNull()
    return held.groupBy(*groups).agg(F.count("*").alias("rows_held"), count(d)("by_digest"), count(c)("by_name"), count(d | c)("overlapping"))
