"""Features of functions from their blocks: vocabularies, bags, id sequences, class counts, sub-blocks, coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.codec import strand_bucket
from ..functions.mnemonics import COUNTERS, counters, members
from ..functions.tokens import immediates, small_immediates


def instructions(df: DataFrame, keys: list[str], blocks: str = "basic_blocks", field: str = "bb_mnems") -> DataFrame:
    """keys, block, pos, token: the tokens of each block's list, in lower case and trimmed; empty and null ones are left out."""
    b = df.select(*keys, F.explode(blocks).alias("block", "b")).select(*keys, "block", F.posexplode(F.col("b")[field]).alias("pos", "t"))
    return b.withColumn("token", F.lower(F.trim("t"))).where("token <> ''").drop("t")


def term_counts(tokens: DataFrame, token: str = "token") -> DataFrame:
    return tokens.groupBy(F.col(token).alias("token")).agg(F.count("*").alias("n"))


def vocabulary_top(counts: DataFrame, most: int) -> DataFrame:
    """token, n, id of the `most` frequent tokens, ties by token: a top-k first, so only its rows are numbered in one task."""
    top = counts.orderBy(F.desc("n"), "token").limit(most)
    return top.withColumn("id", (F.row_number().over(W.orderBy(F.desc("n"), "token")) - 1).cast("bigint"))


def vocabulary_min(counts: DataFrame, least: int) -> DataFrame:
    """token, n, kept: which tokens occur `least` times or more."""
    return counts.withColumn("kept", F.col("n") >= least)


def with_ids(tokens: DataFrame, vocabulary: DataFrame, default: int = -1) -> DataFrame:
    """Tokens with the vocabulary's id, or the default for unknown ones."""
    return tokens.join(vocabulary.select("token", "id"), "token", "left").withColumn("id", F.coalesce("id", F.lit(default)).cast("bigint"))


def unknown_replaced(tokens: DataFrame, vocabulary: DataFrame, unknown: str = "UNK") -> DataFrame:
    kept = vocabulary.select("token", F.lit(True).alias("__in"))
    return tokens.join(kept, "token", "left").withColumn("token", F.when(F.col("__in"), F.col("token")).otherwise(unknown)).drop("__in")


def sequences(ids: DataFrame, keys: list[str], order: list[str], most: int, stop_at_blocks: bool = False) -> DataFrame:
    """keys, ids: each function's ids in order, cut to `most`. With stop_at_blocks, whole blocks are taken until the length reaches `most`.

    The running length is counted per block, so only rows that stay are collected; a list has `most` ids and at most one block more.
    """
    if stop_at_blocks:
        sizes = ids.groupBy(*keys, "block").agg(F.count("*").alias("size"))
        before = F.sum("size").over(W.partitionBy(*keys).orderBy("block").rowsBetween(W.unboundedPreceding, -1))
        ids = ids.join(sizes.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < most).select(*keys, "block"), [*keys, "block"], "left_semi")
    else:
        ids = ids.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= most)
    packed = F.array_sort(F.collect_list(F.struct(*order, "id")))
    return ids.groupBy(*keys).agg(F.transform(packed, lambda x: x["id"]).alias("ids"))


def coverage(ids: DataFrame, keys: list[str], unknown: int = -1) -> DataFrame:
    """keys, tokens, known_pct: the share of tokens in the vocabulary."""
    return ids.groupBy(*keys).agg(F.count("*").alias("tokens"), (F.count_if(F.col("id") != unknown) * 100.0 / F.count("*")).alias("known_pct"))


def bags(ids: DataFrame, keys: list[str]) -> DataFrame:
    """keys, id, n: bags of known tokens, one row for each entry of the sparse matrix."""
    return ids.where("id >= 0").groupBy(*keys, "id").agg(F.count("*").alias("n"))


def class_counts(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_instructions and one count for each class of mnemonics. tokens: keys, machine (see `machine_of`), token.

    The classes are those of the row's machine, from a table of fixed size that is broadcast. An unknown machine has no classes, only a number of instructions.
    """
    table = F.broadcast(counters(tokens.sparkSession))
    counts = (F.count_if(F.coalesce(f"is_{n}", F.lit(False))).alias(f"n_{n}") for n in COUNTERS)
    return tokens.join(table, ["machine", "token"], "left").groupBy(*keys).agg(F.count("*").alias("n_instructions"), *counts)


def block_tokens(tokens: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """keys, class, n by a table (class, mnem) of the caller's own, as a join."""
    return tokens.join(table.select("class", F.col("mnem").alias("token")), "token").groupBy(*keys, "class").agg(F.count("*").alias("n"))


def block_constants(blocks: DataFrame, keys: list[str], most: int = 4096) -> DataFrame:
    """keys, numerics ARRAY<BIGINT>, n_numeric_consts: the immediate operands of a block's instructions, in order, that are at most `most` (negative ones
    included), whatever they stand for. blocks: keys, disasm ARRAY<STRING>. A null list gives an empty array."""
    numbers = F.flatten(F.transform(F.coalesce("disasm", F.array().cast("array<string>")), lambda i: F.coalesce(immediates(i), F.array().cast("array<bigint>"))))
    return blocks.select(*keys, small_immediates(numbers, most).alias("numerics")).withColumn("n_numeric_consts", F.size("numerics").cast("bigint"))


def block_strings(refs: DataFrame, strings: DataFrame, keys: list[str]) -> DataFrame:
    """keys, strings ARRAY<STRING> in order of addresses, n_string_consts. refs: keys, address (data that the block's instructions refer to); strings:
    address, text. A string counts once for each block; blocks that refer to none have no row."""
    used = refs.select(*keys, "address").distinct().join(strings.select("address", "text").distinct(), "address")
    packed = used.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("address", "text"))).alias("s"))
    return packed.select(*keys, F.transform("s", lambda x: x["text"]).alias("strings"), F.size("s").cast("bigint").alias("n_string_consts"))


def incoming_calls(refs: DataFrame, functions: DataFrame) -> DataFrame:
    """`functions` (binary, address, other columns) with n_incoming_calls, the code references (binary, target) to each address; 0 where there are none."""
    n = refs.where("target is not null").groupBy("binary", F.col("target").alias("address")).agg(F.count("*").alias("n_incoming_calls"))
    return functions.join(n, ["binary", "address"], "left").withColumn("n_incoming_calls", F.coalesce("n_incoming_calls", F.lit(0)).cast("bigint"))


def sub_blocks(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Tokens with `part`: a block is cut after each call of its machine. tokens: keys, machine, block, pos, token."""
    calls = {m: sorted(members(m, "call")) for m in ("x86", "arm", "mips")}
    call = reduce(lambda a, b: a | b, [(F.col("machine") == m) & F.col("token").isin(c) for m, c in calls.items()])
    before = F.sum(F.when(call, 1).otherwise(0)).over(W.partitionBy(*keys, "block").orderBy("pos").rowsBetween(W.unboundedPreceding, -1))
    return tokens.withColumn("part", F.coalesce(before, F.lit(0)).cast("bigint"))


def split_graph(parts: DataFrame, edges: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (key, node, block, part, n_instructions) and edges (key, src, dst) of a graph whose blocks are cut after calls.

    parts: key, block, part, address, n, one row for each part; its node is the address of its first instruction, the block's for the first part. edges: key,
    src, dst between blocks. A part leads to the next one of its block, the last one to where the block led; blocks without instructions lead nowhere.
    """
    nodes = parts.select(key, F.when(F.col("part") == 0, F.col("block")).otherwise(F.col("address")).alias("node"), "block", "part", F.col("n").alias("n_instructions"))
    after = F.lead("node").over(W.partitionBy(key, "block").orderBy("part"))
    chained = nodes.withColumn("__next", after)
    inside = chained.where("__next is not null").select(key, F.col("node").alias("src"), F.col("__next").alias("dst"))
    last = chained.where("__next is null").select(key, F.col("block").alias("src"), F.col("node").alias("__last"))
    outside = edges.join(last, [key, "src"]).select(key, F.col("__last").alias("src"), "dst")
    return nodes, inside.unionByName(outside).distinct()


def strand_histogram(expressions: DataFrame, keys: list[str], text: str, bits: int = 10) -> DataFrame:
    """keys, bucket, n: expressions counted by the bucket of their hash."""
    return expressions.groupBy(*keys, strand_bucket(F.col(text), bits).alias("bucket")).agg(F.count("*").alias("n"))


def joined_features(nodes: DataFrame, *others: DataFrame, on: list[str]) -> DataFrame:
    """The feature rows of nodes side by side; what a node lacks is 0."""
    for o in others:
        nodes = nodes.join(o, on, "left")
    return nodes.na.fill(0)
