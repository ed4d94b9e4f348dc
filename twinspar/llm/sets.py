"""Shared parts of the set operators: exact overlap of arrays, 64-bit mixing, joins whose hot keys and buckets are split."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut


def jaccard_at_least(a: Column, b: Column, num: int, den: int) -> Column:
    """Whether two arrays of distinct values overlap by num/den or more, in whole numbers."""
    both = F.size(F.array_intersect(a, b))
    return both * (num + den) >= num * (F.size(a) + F.size(b))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), elementwise."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def key128(*parts: Column) -> Column:
    """128 bits that stand for the given values, as a struct of two numbers; nulls are told from other values by their places."""
    return F.struct(F.xxhash64(F.lit(1), *parts, *[p.isNull() for p in parts]).alias("a"), F.xxhash64(F.lit(2), *[p.isNull() for p in parts], *reversed(parts)).alias("b"))


def spread_join(left: DataFrame, right: DataFrame, key: str, target: int = 200_000) -> DataFrame:
    """Inner equi-join of two tables on `key` whose hot keys are split: a key of m left and n right rows is cut into
    about m*n/target pieces, left rows falling in one piece each and right rows copied to all of them.

    Only keys above the target take part in the split, so the copies stay in proportion to the result. The counts
    come from a pre-aggregation; the hot keys are joined back, never collected.
    """
    counts = left.groupBy(key).agg(F.count("*").alias("__m")).join(right.groupBy(key).agg(F.count("*").alias("__n")), key)
    hot = counts.select(key, F.least(F.ceil(F.col("__m") * F.col("__n") / target), F.col("__m")).cast("int").alias("__pieces")).where("__pieces > 1")
    pieces = F.coalesce(F.col("__pieces"), F.lit(1))
    l = left.join(hot, key, "left").withColumn("__piece", F.pmod(F.xxhash64(*left.columns), pieces.cast("bigint")).cast("int")).drop("__pieces")
    r = right.join(hot, key, "left").withColumn("__piece", F.explode(F.sequence(F.lit(0), pieces - 1))).drop("__pieces")
    return l.join(r, [key, "__piece"]).drop("__piece")


#: Rows of a bucket that are compared in one piece, and pairs that are looked at at once; bounds on memory and on the work of one step only.
BUCKET, _PAIRS = 2048, 1 << 21


def _pairs_in(start: np.ndarray, stop: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers i, j of all i < j < stop[i] of each row, in runs of bounded length. start: i + 1, or where the rows of the other half begin."""
    n = np.maximum(stop - start, 0)
    ends = np.cumsum(n)
    at = 0
    while at < len(n):
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + _PAIRS, side="right")))
        k = n[at:to]
        i = np.repeat(np.arange(at, to), k)
        j = np.arange(len(i)) - np.repeat(np.cumsum(k) - k, k) + np.repeat(start[at:to], k)
        if len(i):
            yield i, j
        at = to


def _accepted(columns: list[np.ndarray], ids: int, start: np.ndarray, stop: np.ndarray, accept: Callable) -> list[np.ndarray]:
    """The ids of both ends of the accepted ordered pairs, each once."""
    found: list[pd.DataFrame] = []
    for i, j in _pairs_in(start, stop):
        for a, b in ((i, j), (j, i)):
            keep = accept([c[a] for c in columns], [c[b] for c in columns])
            if keep is not None and keep.any():
                a, b = a[keep], b[keep]
                found.append(pd.DataFrame({k: c[x] for k, (c, x) in enumerate([(c, a) for c in columns[:ids]] + [(c, b) for c in columns[:ids]])}).drop_duplicates())
    if not found:
        return [np.zeros(0, np.int64)] * (2 * ids)
    out = pd.concat(found).drop_duplicates()
    return [out[k].to_numpy() for k in range(2 * ids)]


def _edges(columns: list[np.ndarray]) -> np.ndarray:
    """Where a new group begins in sorted rows."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.flatnonzero(new)


def bucket_pairs(rows: DataFrame, ids: list[str], payload: list[str], accept: Callable, most: int = BUCKET) -> DataFrame:
    """Distinct ordered pairs (ids with suffix _l and _r) of rows that share a bucket and that `accept` takes.

    rows: code BIGINT, the bucket; ids and payload BIGINT. accept(left, right) gets the columns ids + payload of both ends as numpy arrays and gives a mask; it sees
    each pair in both orders. Rows are brought together by code and compared inside their bucket, without being joined row by row. A bucket of more than
    `most` rows is cut into pieces of `most`; each two pieces are compared in a task of their own, so no task gets more than 2 * most rows of a bucket at once, and none holds
    a whole hot bucket. All pairs of a bucket are looked at and only accepted ones come out.
    """
    columns = [*ids, *payload]
    outs = [f"{c}_l" for c in ids] + [f"{c}_r" for c in ids]
    width, k = len(columns), len(ids)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*outs, "code", "piece", *columns]
        none = lambda n: pa.nulls(n, pa.int64())

        def hot(part: list[np.ndarray], place: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*[none(len(place))] * (2 * k), pa.array(part[0]), pa.array(place // most), *map(pa.array, part[1:])], names=names)

        def met(part: list[np.ndarray], begin: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
            stop = np.repeat(begin + size, size)
            got = _accepted(part[1:], k, np.arange(len(part[0])) + 1, stop, accept)
            return pa.RecordBatch.from_arrays([*map(pa.array, got), *[none(len(got[0]))] * (2 + width)], names=names)

        held = [np.zeros(0, np.int64)] * (1 + width)
        open_code, open_rows = None, 0  # a hot bucket that goes on, and how many of its rows have gone out
        for batch in batches:
            data = [np.concatenate([h, np.asarray(c, dtype=np.int64)]) for h, c in zip(held, batch.columns, strict=True)]
            if not len(data[0]):
                continue
            begin = _edges(data[:1])
            size = np.diff(np.r_[begin, len(data[0])])
            before = np.zeros(len(begin), np.int64)
            if open_code is not None and data[0][0] == open_code:
                before[0] = open_rows
            large = (before > 0) | (size > most)
            last = 0 if large[-1] else int(size[-1])  # the last bucket may go on; a small one waits
            if large[-1]:
                open_code, open_rows = int(data[0][-1]), int(before[-1] + size[-1])
            else:
                open_code, open_rows = None, 0
            whole = len(data[0]) - last
            held = [d[whole:] for d in data]
            if large.any():
                rows_large = np.repeat(large, size)
                place = np.arange(len(data[0])) - np.repeat(begin - before, size)
                yield hot([d[rows_large] for d in data], place[rows_large])
            small = ~large & (size > 1)
            if last:
                small[-1] = False
            if small.any():
                kept = np.repeat(small, size)
                n = size[small]
                yield met([d[kept] for d in data], np.cumsum(n) - n, n)
        if len(held[0]) > 1:
            yield met(held, np.zeros(1, np.int64), np.array([len(held[0])]))

    big = lambda names: ", ".join(f"`{n}` bigint" for n in names)
    out = cut(rows.select("code", *columns).repartition("code").sortWithinPartitions("code").mapInArrow(first, big([*outs, "code", "piece", *columns])))
    pieces = out.where("piece is not null").select("code", "piece", *columns)
    counts = pieces.groupBy("code").agg((F.max("piece") + 1).alias("pieces"))
    other = pieces.join(counts, "code").withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pieces") - 1)))
    met_by = other.select("code", F.least("piece", "other").alias("lo"), F.greatest("piece", "other").alias("hi"), "piece", *columns)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * (4 + width)

        def met(part: list[np.ndarray]) -> pa.RecordBatch:
            begin = _edges(part[:3])
            size = np.diff(np.r_[begin, len(part[0])])
            stop = np.repeat(begin + size, size)
            # Inside one piece each row meets the later ones; of two pieces the rows of the lower one meet all of the higher one.
            upper = np.searchsorted(np.flatnonzero(part[3] != part[1]), np.arange(len(part[0])))
            highs = np.r_[np.flatnonzero(part[3] != part[1]), len(part[0])]
            same = part[1] == part[2]
            start = np.where(same, np.arange(len(part[0])) + 1, np.where(part[3] == part[1], highs[upper], stop))
            got = _accepted(part[4:], k, start, stop, accept)
            return pa.RecordBatch.from_arrays([*map(pa.array, got)], names=outs)

        for batch in batches:
            data = [np.concatenate([h, np.asarray(c, dtype=np.int64)]) for h, c in zip(held, batch.columns, strict=True)]
            if len(data[0]):
                at = int(_edges(data[:3])[-1])
                held = [d[at:] for d in data]
                if at:
                    yield met([d[:at] for d in data])
        if len(held[0]):
            yield met(held)

    found = met_by.repartition("code", "lo", "hi").sortWithinPartitions("code", "lo", "hi", "piece").mapInArrow(second, big(outs))
    return out.where("piece is null").select(*outs).unionByName(found).distinct()
