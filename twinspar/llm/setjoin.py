"""All similar pairs between set-valued records, by minwise hashing in bands.

Each set gets bands*rows minwise hashes; a band is the hash of `rows` of them, and sets that share any band bucket are
candidates. They are deduplicated and verified on the sets exactly, in whole numbers. A pair at the threshold t is
missed with probability (1 - t^rows)^bands, about 1e-5 with the parameters used here; a pair above it more rarely.

Values that very many sets have say little, but sets that share some of them would meet in many buckets, and such meetings grow with the square of the
table. So lists are hashed without their frequent values F (in more than `common_least` classes and more than 1 in `COMMON_SHARE` of all; they are
counted over all classes). If B has a share f of its values in F, a pair at the threshold t still overlaps by (t - f)/(1 - f) in the rest, whatever its partner is: at most
f|B| of what the two share is in F. Sets fall in levels by f; bands of each level are cut for its overlap, so that a pair is missed no more often than above. A set takes part in the
bands of its own level and of all lighter ones, so a pair meets at the level of its lighter set. The last level hashes whole sets.

Equal sets are one class from the start: they need no search, and a group of copies costs one row. Buckets come
together by their codes; hot ones are compared piece by piece in tasks of their own (`bucket_pairs`), and hot classes are split by `spread_join`.
Sets whose sizes alone exclude the overlap are no candidates.

Defined results. Null sets and empty sets are in no pair. Repeated elements count once. Two records with equal sets have
overlap 1 and are a pair. An empty table has no pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, spread
from .sets import bucket_pairs, jaccard_at_least, key128, mix64, spread_join


@dataclass(frozen=True)
class Bands:
    """Minwise hashes in bands, and the least Jaccard overlap as a fraction."""

    bands: int
    rows: int
    num: int
    den: int
    seed: int = 11
    common_least: int = 1000

    @property
    def missed(self) -> float:
        """The chance that a pair at the threshold shares no band."""
        return (1 - (self.num / self.den) ** self.rows) ** self.bands


#: Frequent values are in more than one in so many sets. There are at most so many of them as COMMON_SHARE average sets have values; they are broadcast.
COMMON_SHARE = 1000
#: Shares of frequent values up to which a set is in the first, second, ... level.
LEVELS = (0.1, 0.35)


def levels(p: Bands) -> list[tuple[float, Bands]]:
    """The greatest share of frequent values and the bands of each level but the last, for the overlap that is left without them."""
    out = []
    for i, share in enumerate(LEVELS):
        left = (p.num / p.den - share) / (1 - share)
        if left > 0:
            rows = max(1, round(log(0.2) / log(left)))
            out.append((share, Bands(ceil(log(p.missed) / log(1 - left**rows)), rows, p.num, p.den, p.seed + 1 + i)))
    return out


def _factors(k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(0, 1 << 32, k, dtype=np.uint32) | np.uint32(1), r.integers(0, 1 << 32, k, dtype=np.uint32)


def _band_codes(signature: np.ndarray, p: Bands) -> np.ndarray:
    """(sets, bands*rows) to (sets, bands) 64-bit codes; the seed and the band's number are part of a code."""
    out = np.empty((len(signature), p.bands), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(p.bands):
            code = np.full(len(signature), mix64(np.array([b + 1 + (p.seed << 32)], np.uint64))[0])
            for j in range(p.rows):
                code = mix64(code * np.uint64(0x9E3779B97F4A7C15) + signature[:, b * p.rows + j].astype(np.uint64))
            out[:, b] = code
    return out


def _signature(x: np.ndarray, start: np.ndarray, p: Bands) -> np.ndarray:
    """Minwise hashes of lists that begin at `start`, none of them empty. x: the elements, mixed to 32 bits."""
    a, c = _factors(p.bands * p.rows, p.seed)
    signature = np.empty((len(start), len(a)), np.uint32)
    for i in range(len(a)):
        signature[:, i] = np.minimum.reduceat(x * a[i] + c[i], start)
    return signature


def list_bands(items: pa.ListArray, p: Bands, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Band codes of lists of whole numbers, and the list of each; no list is empty. common: the frequent values, sorted."""
    offsets = np.asarray(items.offsets, dtype=np.int64)
    values = np.asarray(items.values, dtype=np.int64)[offsets[0] : offsets[-1]]
    start, n = offsets[:-1] - offsets[0], np.diff(offsets)
    owner = np.repeat(np.arange(len(n)), n)
    x = (mix64(values.view(np.uint64)) >> np.uint64(32)).astype(np.uint32)
    rare = ~np.isin(values, common) if common is not None and len(common) else np.ones(len(values), bool)
    left = np.bincount(owner[rare], minlength=len(n))
    share = 1 - left / np.maximum(n, 1)
    codes, rows = [], []
    lightest = -1.0
    for most, bands in levels(p):
        # This level's own sets and the heavier ones, as far as they have values that are not frequent.
        here = np.flatnonzero((share > lightest) & (left > 0))
        if len(here):
            inside = np.zeros(len(n), bool)
            inside[here] = True
            kept = rare & inside[owner]
            codes.append(_band_codes(_signature(x[kept], np.cumsum(left[here]) - left[here], bands), bands).ravel())
            rows.append(np.repeat(here, bands.bands))
        lightest = most
    heavy = np.flatnonzero((share > lightest) | (left == 0))
    if len(heavy):
        inside = np.zeros(len(n), bool)
        inside[heavy] = True
        codes.append(_band_codes(_signature(x[inside[owner]], np.cumsum(n[heavy]) - n[heavy], p), p).ravel())
        rows.append(np.repeat(heavy, p.bands))
    return np.concatenate(codes) if codes else np.zeros(0, np.uint64), np.concatenate(rows) if rows else np.zeros(0, np.int64)


def word_bands(words: np.ndarray, p: Bands) -> np.ndarray:
    """Band codes of the sets of one-bits of 64-bit words; the minwise element is the first one-bit in a permuted order.

    A word is looked up byte by byte: for each permutation a table has the first place of the one-bits of every byte.
    """
    parts = np.ascontiguousarray(words).view(np.uint8).reshape(-1, 8)
    ones = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(bool)
    r = np.random.default_rng(p.seed)
    signature = np.empty((len(words), p.bands * p.rows), np.uint8)
    for i in range(signature.shape[1]):
        place = r.permutation(64).astype(np.uint8).reshape(8, 8)
        first = np.where(ones[None], place[:, None, :], np.uint8(64)).min(axis=2)
        found = first[0][parts[:, 0]]
        for k in range(1, 8):
            np.minimum(found, first[k][parts[:, k]], out=found)
        signature[:, i] = found
    return _band_codes(signature, p)


def _buckets(sets: DataFrame, value: str, codes: Callable) -> DataFrame:
    """code, cid, n of every band of every set. sets: cid, value, n (its size)."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                b = batch.slice(at, 1000)
                code, row = codes(b.column(1))
                row = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), b.column(0).take(row), b.column(2).take(row)], names=["code", "cid", "n"])

    sets = sets.select("cid", value, F.col("n").cast("bigint").alias("n"))
    narrow = sets.schema[value].dataType.typeName() != "array"  # words are few bytes and much work; lists are moved only once they are codes
    return (spread(sets) if narrow else sets).mapInArrow(kernel, "code bigint, cid bigint, n bigint")


def _word_codes(p: Bands) -> Callable:
    def codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return word_bands(np.asarray(column, dtype=np.int64).view(np.uint64), p).ravel(), np.repeat(np.arange(len(column)), p.bands)

    return codes


def _list_codes(classes: DataFrame, value: str, p: Bands) -> Callable:
    common = frequent_values(classes, value, p)
    held = classes.sparkSession.sparkContext.broadcast(common)
    return lambda column: list_bands(column, p, held.value)


def frequent_values(classes: DataFrame, value: str, p: Bands) -> np.ndarray:
    """The values in more than `common_least` classes and more than one in COMMON_SHARE of them, sorted. Counted over all classes, pre-aggregated. There are at most as many full
    counters and frequent values as COMMON_SHARE average sets have values. Which values count as frequent changes the work, not the result."""
    n, total = classes.agg(F.count("*"), F.coalesce(F.sum(F.size(value)), F.lit(0))).first()
    least = max(p.common_least, n // COMMON_SHARE)
    # Hashed counters first, about `least` / 8 values each: only values whose counter is above the limit are counted one by one, so hardly a value is shuffled.
    counters = max(1024, 8 * total // least)
    values = classes.select(F.explode(value).alias("v")).withColumn("counter", F.pmod(F.xxhash64("v"), F.lit(counters)))
    full = values.groupBy("counter").agg(F.count("*").alias("n")).where(F.col("n") > least).select("counter")
    counts = values.join(F.broadcast(full), "counter").groupBy("v").agg(F.count("*").alias("n")).where(F.col("n") > least)
    return np.sort(np.array([r["v"] for r in counts.select("v").toLocalIterator()], np.int64))


def prepare(df: DataFrame, value: str) -> DataFrame:
    """id, value, key (128 bits of the value) of the records that have a set, written once."""
    full = F.size(value) > 0 if df.schema[value].dataType.typeName() == "array" else F.col(value) != 0
    return cut(df.where(full).select("id", value, key128(F.col(value)).alias("key")))


def members(rows: DataFrame) -> DataFrame:
    """key, cid, n: each class of equal sets, its least id and its size. Only keys are shuffled, pre-aggregated."""
    return cut(rows.groupBy("key").agg(F.min("id").alias("cid"), F.count("*").alias("n")))


def classes_of(rows: DataFrame, groups: DataFrame, value: str) -> DataFrame:
    """cid, value: one record of each class. Records are taken out by the few keys that have copies, so sets are not shuffled for them."""
    copied = groups.where("n > 1").select("key", F.col("cid").alias("first"))
    return rows.join(copied, "key", "left").where("first is null or first = id").select(F.col("id").alias("cid"), value)


def similar_classes(classes: DataFrame, value: str, p: Bands) -> DataFrame:
    """cid_1 < cid_2 of different sets (or words) whose overlap is num/den or more."""
    array = classes.schema[value].dataType.typeName() == "array"
    size = F.size(value) if array else F.bit_count(value)
    buckets = _buckets(classes.withColumn("n", size), value, _list_codes(classes, value, p) if array else _word_codes(p))

    def accept(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
        """Each pair once; sets of too unequal sizes cannot overlap enough."""
        (x, m), (y, n) = a, b
        return (x < y) & (np.minimum(m, n) * p.den >= np.maximum(m, n) * p.num)

    candidates = cut(bucket_pairs(buckets, ["cid"], ["n"], accept).select(F.col("cid_l").alias("cid_1"), F.col("cid_r").alias("cid_2")))
    one = lambda i: classes.select(F.col("cid").alias(f"cid_{i}"), F.col(value).alias(f"v_{i}"))
    pairs = candidates.join(one(1), "cid_1").join(one(2), "cid_2")
    return pairs.where(_enough(F.col("v_1"), F.col("v_2"), array, p)).select("cid_1", "cid_2")


def _enough(a: Column, b: Column, array: bool, p: Bands) -> Column:
    if array:
        return jaccard_at_least(a, b, p.num, p.den)
    return F.bit_count(a.bitwiseAND(b)) * p.den >= F.bit_count(a.bitwiseOR(b)) * p.num


def similar_pairs(df: DataFrame, value: str, p: Bands) -> DataFrame:
    """id_1 < id_2 of all records whose sets overlap by num/den or more, those with equal sets too.

    df: id (BIGINT, unique), value (sorted ARRAY<BIGINT> without nulls, or BIGINT word). Null, empty and zero values are in no pair.
    """
    rows = prepare(df, value)
    groups = members(rows)
    near = cut(similar_classes(classes_of(rows, groups, value), value, p))
    copies = cut(rows.select("id", "key").join(groups.where("n > 1").select("key", "cid"), "key").select("id", "cid"))
    one = lambda i: copies.select(F.col("id").alias(f"id_{i}"), F.col("cid").alias(f"cid_{i}"))
    # The records of the classes that have links; a class of one record is that record, and is not looked up among the rows.
    linked = near.select(F.col("cid_1").alias("cid")).union(near.select("cid_2")).distinct()
    records = cut(copies.join(linked, "cid", "left_semi").unionByName(linked.join(copies, "cid", "left_anti").withColumn("id", F.col("cid"))))
    spread = near
    for i in (1, 2):
        spread = spread_join(spread, records.select(F.col("cid").alias(f"cid_{i}"), F.col("id").alias(f"id_{i}")), f"cid_{i}")
        spread = cut(spread) if i == 1 else spread
    between = spread.select(F.least("id_1", "id_2").alias("id_1"), F.greatest("id_1", "id_2").alias("id_2"))
    within = spread_join(one(1).withColumnRenamed("cid_1", "cid"), one(2).withColumnRenamed("cid_2", "cid"), "cid").where("id_1 < id_2").select("id_1", "id_2")
    return between.unionByName(within)


def link_counts(df: DataFrame, value: str, p: Bands) -> DataFrame:
    """id, class_id, copies (records with the same set), links (other sets that overlap enough): one row per record with a set."""
    rows = prepare(df, value)
    groups = members(rows)
    near = cut(similar_classes(classes_of(rows, groups, value), value, p))
    links = near.select("cid_1").union(near.select("cid_2")).groupBy(F.col("cid_1").alias("cid")).agg(F.count("*").alias("links"))
    return rows.select("id", "key").join(groups, "key").join(links, "cid", "left").select("id", F.col("cid").alias("class_id"), F.col("n").alias("copies"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
