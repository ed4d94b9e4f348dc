"""How often each term occurs, and in how many records, by compressed bitmaps of record identifiers.

Vertical layout: for each term and each block of 65 536 record identifiers there is one container, holding the low 16
bits of the identifiers that have the term, either as a sorted list of two bytes each or as a bitmap of 8 KB, whichever is
smaller, with the number of occurrences beside it. Every task builds the containers of its own records; containers of
the same term and block are merged by union; the number of records is the sum of the cardinalities of a term's
containers. A term in every record is spread over as many containers as there are blocks, so no term is hot, and two
deliveries of the same record identifier count once. Containers are small where identifiers are dense; `dense` numbers records.

Defined results. Terms are taken as given; null and empty terms are no terms. A record without terms counts among all records.
An empty table gives no terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.nested import as_list, child_index
from ..session import cut

#: Above so many members a bitmap, of 8 KB, is no larger than a list. Lists are shorter than bitmaps, so the length tells them apart.
_LIST_MOST = 4095
#: Identifiers of one block share all but this many bits.
_LOW = 16
CONTAINER = "term string, block bigint, bits binary, occurrences bigint"


def pack(low: np.ndarray) -> bytes:
    """Sorted distinct 16-bit members as a container."""
    if len(low) <= _LIST_MOST:
        return low.astype("<u2").tobytes()
    full = np.zeros(1 << _LOW, np.uint8)
    full[low] = 1
    return np.packbits(full, bitorder="little").tobytes()


def unpack(bits: bytes) -> np.ndarray:
    """The members of a container, sorted."""
    if len(bits) == (1 << _LOW) // 8:
        return np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little"))
    return np.frombuffer(bits, "<u2").astype(np.int64)


def containers(ids: np.ndarray, terms: pa.Array, occurrences: np.ndarray) -> pa.RecordBatch:
    """The containers of (record, term, occurrences) triples, one for each term and block."""
    coded = terms.dictionary_encode()
    code = np.asarray(coded.indices, dtype=np.int64)
    order = np.lexsort((ids, ids >> _LOW, code))
    ids, code, occurrences = ids[order], code[order], occurrences[order]
    block = ids >> _LOW
    if not len(ids):
        return pa.RecordBatch.from_pylist([], schema=pa.schema([("term", pa.string()), ("block", pa.int64()), ("bits", pa.binary()), ("occurrences", pa.int64())]))
    start = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (block[1:] != block[:-1])])
    total = np.add.reduceat(occurrences, start)
    low = ids & ((1 << _LOW) - 1)
    bits = [pack(np.unique(x)) for x in np.split(low, start[1:])]
    return pa.RecordBatch.from_arrays(
        [coded.dictionary.take(pa.array(code[start])), pa.array(block[start]), pa.array(bits, pa.binary()), pa.array(total)], names=["term", "block", "bits", "occurrences"]
    )


def block_terms(record: np.ndarray, nodes: pa.Array, blocks: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """record, term, occurrences: the words of those blocks (MAP<BIGINT, ARRAY<STRING>>) whose key is in the record's nodes, in lower case
    and without outer white space, counted in each record. Sorted by record."""
    node, node_of, _ = child_index(nodes)
    entry, entry_of, _ = child_index(as_list(blocks))
    key, words = entry.flatten()
    there = np.asarray(node.is_valid())
    node, node_of = np.asarray(node.drop_null(), dtype=np.int64), node_of[there]
    key = np.asarray(key, dtype=np.int64)
    values, code = np.unique(np.concatenate([node, key]), return_inverse=True)
    width = max(1, len(values))
    inside = np.flatnonzero(np.isin(entry_of * width + code[len(node) :], node_of * width + code[: len(node)]))
    word, word_of, _ = child_index(words.take(pa.array(inside)))
    word = pc.utf8_lower(pc.utf8_trim_whitespace(word))
    full = pc.fill_null(pc.not_equal(word, ""), False)
    owner = entry_of[inside][word_of][np.asarray(full)]
    coded = word.filter(full).dictionary_encode()
    width = max(1, len(coded.dictionary))
    pair, n = np.unique(owner * width + np.asarray(coded.indices, dtype=np.int64), return_counts=True)
    return record[pair // width], coded.dictionary.take(pa.array(pair % width)), n


#: Postings that a task gathers before it writes containers; a bound on memory only.
_GATHER = 1 << 20


def function_terms(df: DataFrame, keys: list[str], nodes: str, blocks: str) -> DataFrame:
    """`keys` and `terms` (MAP<STRING, BIGINT>) of each row: the words of its blocks that are in its nodes, and how often.

    A row without such words has an empty map. Nothing is shuffled.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            owner, term, n = block_terms(np.arange(rows), batch.column(len(keys)), batch.column(len(keys) + 1))
            offsets = pa.array(np.searchsorted(owner, np.arange(rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.MapArray.from_arrays(offsets, term, pa.array(n, pa.int64()))], names=[*keys, "terms"])

    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, nodes, blocks).mapInArrow(kernel, f"{schema}, terms map<string, bigint>")


def _build(df: DataFrame) -> DataFrame:
    """Containers of df (id BIGINT, terms MAP<STRING, BIGINT>: a record's terms and how often each occurs in it)."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            out = containers(np.concatenate([h[0] for h in held]), pa.concat_arrays([h[1] for h in held]), np.concatenate([h[2] for h in held]))
            held.clear()
            return out

        for batch in batches:
            terms = batch.column(1)
            offsets = np.asarray(terms.offsets, dtype=np.int64)
            n = np.diff(offsets)
            keys, items = (x.slice(int(offsets[0]), int(offsets[-1] - offsets[0])) for x in (terms.keys, terms.items))
            held.append((np.repeat(np.asarray(batch.column(0), dtype=np.int64), n), keys, np.asarray(items, dtype=np.int64)))
            size += len(keys)
            if size >= _GATHER:
                yield flush()
                size = 0
        if held:
            yield flush()

    return df.select("id", "terms").where(F.size("terms") > 0).mapInArrow(kernel, CONTAINER)


def dense(df: DataFrame, name: str = "id") -> DataFrame:
    """df, written once, with identifiers that follow each other inside each part of the files: a block of identifiers belongs to one task. The same files give the same
    identifiers whenever they are read."""
    return cut(df).withColumn(name, F.monotonically_increasing_id())


def _union(parts: DataFrame) -> DataFrame:
    """One container for each term and block. Members of a block are 65 536 at most, whatever the input. Containers of one term and block come behind each
    other in sorted partitions and are merged as they go by; most have no other and pass as they are."""

    def merged(batch: pa.RecordBatch) -> pa.RecordBatch:
        term, block = batch.column(0).dictionary_encode(), np.asarray(batch.column(1), dtype=np.int64)
        code = np.asarray(term.indices, dtype=np.int64)
        start = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (block[1:] != block[:-1])])
        total = np.add.reduceat(np.asarray(batch.column(3), dtype=np.int64), start)
        size = np.diff(np.r_[start, len(code)])
        bits = batch.column(2).take(pa.array(start)).to_pylist()
        for g in np.flatnonzero(size > 1):
            same = batch.column(2).slice(start[g], size[g])
            bits[g] = pack(np.unique(np.concatenate([unpack(b.as_py()) for b in same])))
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(start)), pa.array(block[start]), pa.array(bits, pa.binary()), pa.array(total)], names=["term", "block", "bits", "occurrences"])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last container, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.concat_batches([held, batch])
            batch = merged(batch)
            held = batch.slice(batch.num_rows - 1)
            if batch.num_rows > 1:
                yield batch.slice(0, batch.num_rows - 1)
        if held is not None:
            yield held

    return parts.repartition("term", "block").sortWithinPartitions("term", "block").mapInArrow(kernel, CONTAINER)


def bitmaps(df: DataFrame) -> DataFrame:
    """term, block, bits, occurrences: the merged bitmap index of df (id, terms)."""
    return _union(_build(df))


def cardinality(bits: Column) -> Column:
    """The number of members of a container."""
    n = F.length(bits)
    return F.when(n == (1 << _LOW) // 8, F.bitmap_count(bits)).otherwise((n / 2).cast("bigint"))


def term_counts(df: DataFrame) -> DataFrame:
    """term, occurrences, records of df (id, terms)."""
    return bitmaps(df).groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum(cardinality(F.col("bits"))).alias("records"))


def marked(counts: DataFrame, all_records: DataFrame, rare_below: int, common_above: float) -> DataFrame:
    """`counts` with `all_records` (from a table of one row and column) and `mark`: 'rare' below a number of records, 'common' above a
    share of all records, else null. One that is both is 'rare'."""
    n = all_records.columns[0]
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > F.col(n) * common_above, "common")
    return counts.crossJoin(F.broadcast(all_records)).withColumn("mark", mark)
