"""Mixing sources to target weights, by entropy balancing.

Each record gets a rate, the expected number of its copies. Of all rates that give source s its target of w_s * T tokens
(T: the tokens of all records), those of the greatest entropy relative to the tokens as they are have the form exp(lambda_s): the
records are tilted exponentially by their source. lambda is the minimum of the convex dual

    sum_s N_s exp(lambda_s) - lambda_s w_s T,    lambda_s <= log(max_repeats_s)

and is found by projected Newton steps. Tokens are counted in one distributed pass; as the rate of a record depends on its source alone,
the tokens per source N_s are all that a step needs, so each step is an aggregation over that small table, made by Spark,
and only the gradient's size comes to the driver. Rates become whole copies by floor(rate) plus one for a share frac(rate) of the
records, drawn by a hash of the record's id, so that the same copies come out on any cluster and after any failure.

A source is short if the steps end with its lambda at the cap and the gradient still asking for more; an exact comparison in whole tokens follows.

Defined results. Names of sources are compared in lower case without outer white space. Records whose source is null or no target count in T
but get no copies. Null and empty texts have no tokens. A target without records cannot be reached unless its weight is 0. A null
weight is 0, a null max_repeats is no limit.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Where the vocabulary is unless a caller says otherwise.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Longer texts are tokenized in stretches of about so many characters. They are cut where the pattern always parts: before white space that follows something else, or
#: between a mark (no apostrophe) and a letter. A text without such a place goes on to the next one, so the sum is that of the whole text.
_STRETCH = 200_000
_PARTS = regex.compile(r"(?<=\S)(?=\s)|(?<=[^\s\p{L}\p{N}'])(?=\p{L})")


def stretches(text: str, length: int = _STRETCH) -> Iterator[str]:
    """The text in stretches whose tokens are those of the text."""
    at = 0
    while len(text) - at > length and (m := _PARTS.search(text, at + length)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def count_tokens(df: DataFrame, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """df without `text` and with `tokens` (BIGINT), the tokens of the text under a byte-level BPE vocabulary of ranks; 0 for null."""
    keep = [c for c in df.columns if c != text]
    if "tokens" in keep:
        raise ValueError("df has a column tokens already")
    with open(vocabulary, "rb") as f:
        vocab = df.sparkSession.sparkContext.broadcast(f.read())  # under 2 MB

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocab.value.splitlines())}
        encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

        def tokens(t: str | None) -> int:
            if not t:
                return 0
            return sum(len(encode(x)) for x in stretches(t))

        for batch in batches:
            n = pa.array([tokens(x.as_py()) for x in batch.column(len(keep))], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], n], names=[*keep, "tokens"])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, text).mapInArrow(kernel, f"{schema}, tokens bigint" if keep else "tokens bigint")


def source_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def masses(counted: DataFrame, targets: DataFrame) -> DataFrame:
    """One row for each target: key, source, weight, max_repeats, documents, tokens, total. counted: source, tokens."""
    sums = cut(counted.groupBy(source_key(F.col("source")).alias("key")).agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens")))
    total = sums.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total"))
    wanted = targets.select(source_key(F.col("source")).alias("key"), "source", F.coalesce("weight", F.lit(0.0)).alias("weight"), "max_repeats")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return wanted.join(sums, "key", "left").select("key", "source", "weight", "max_repeats", zero("documents"), zero("tokens")).crossJoin(F.broadcast(total))


def balance(mass: DataFrame, most_steps: int = 60, tolerance: float = 1e-9) -> DataFrame:
    """`mass` with rate, the repeat count of the source, and short, whether the source cannot reach its target even at max_repeats.

    Both are read off the solution. Newton steps are cut at 1, which keeps the iteration from overshooting; it converges from any start in about as many steps as
    the logarithm of the rates. Raises if it has not after `most_steps`.
    """
    goal = F.col("weight") * F.col("total")
    cap = F.when(F.col("max_repeats").isNotNull(), F.log(F.greatest("max_repeats", F.lit(0)).cast("double")))
    state = cut(mass.withColumn("goal", goal).withColumn("cap", F.coalesce(cap, F.when(F.col("max_repeats").isNotNull(), F.lit(float("-inf"))), F.lit(float("inf")))).withColumn("lam", F.least(F.lit(0.0), "cap")))
    now = F.col("tokens") * F.exp("lam")
    # The projected gradient is zero where lambda is free and the mass is the goal, where lambda is at its cap and more is asked for, and where nothing can be moved.
    held = (F.col("lam") >= F.col("cap")) & (F.col("goal") >= now)
    movable = (F.col("tokens") > 0) & (F.col("goal") > 0) & (F.col("cap") > F.lit(float("-inf")))
    for step_no in range(most_steps + 1):
        worst = state.agg(F.max(F.when(movable & ~held, F.abs(F.col("goal") - now) / F.col("goal")))).first()[0]
        if worst is None or worst < tolerance:
            break
        if step_no == most_steps:
            raise RuntimeError(f"no convergence in {most_steps} steps: a source is off its target by {worst:.3g}")
        step = F.when(movable, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("goal") - now) / now))).otherwise(0.0)
        state = cut(state.withColumn("lam", F.least(F.col("lam") + step, "cap")))
    at_cap = (F.col("lam") >= F.col("cap")) | (F.col("tokens") == 0)
    rate = F.when((F.col("tokens") == 0) | (F.col("goal") <= 0), F.lit(0.0)).when(F.col("lam") >= F.col("cap"), F.col("max_repeats").cast("double")).otherwise(F.exp("lam"))
    # What the solution says, then the same in whole tokens, which settles targets that are reached to the token.
    asks = at_cap & (F.col("goal") > 0) & (F.col("goal") >= now)
    exact = F.when(F.col("tokens") == 0, F.lit(True)).otherwise(F.col("tokens") * F.col("max_repeats") < F.col("goal"))
    return state.withColumn("rate", rate).withColumn("short", asks & exact).drop("lam", "cap", "goal")


def copies(counted: DataFrame, rates: DataFrame) -> DataFrame:
    """id, key, tokens, copies of every record whose source is a target. counted: id, source, tokens. No more copies than max_repeats."""
    chance = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 40)) / float(1 << 40)
    whole = F.floor("rate")
    out = counted.select("id", "tokens", source_key(F.col("source")).alias("key")).join(rates.select("key", "rate", "max_repeats"), "key")
    n = whole + F.when(chance < F.col("rate") - whole, 1).otherwise(0)
    return out.select("id", "key", "tokens", F.least(n, F.coalesce("max_repeats", n)).cast("bigint").alias("copies"))


def mix(counted: DataFrame, targets: DataFrame) -> DataFrame:
    """One row for each target: source, weight, max_repeats, documents, tokens, rate, copies, tokens_out, share, short."""
    rates = cut(balance(masses(counted, targets)))
    made = copies(counted, rates).groupBy("key").agg(F.sum("copies").alias("copies"), F.sum(F.col("copies") * F.col("tokens")).alias("tokens_out"))
    out = rates.join(made, "key", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("copies", "tokens_out")})
    all_out = made.agg(F.sum("tokens_out").alias("all_out"))
    share = F.when(F.col("all_out") > 0, F.col("tokens_out") / F.col("all_out")).otherwise(0.0)
    return out.crossJoin(F.broadcast(all_out)).withColumn("share", share).select("source", "weight", "max_repeats", "documents", "tokens", "rate", "copies", "tokens_out", "share", "short")
