"""Signatures of functions: minwise signatures of raw bytes, similarity hashes of control-flow graphs, digests of mnemonics."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import spread

# The words that the permutations add and mix in.
WORDS = np.array(
    """
    1445200656 3877429363 1060188777 4260769784 1438562000 2836098482 1986405151 4230168452
    380326093 2859127666 1134102609 788546250 3705417527 1779868252 1958737986 4046915967
    1614805928 4160312724 3682325739 534901034 2287240917 2677201636 71025852 1171752314
    47956297 2265969327 2865804126 1364027301 2267528752 1998395705 576397983 636085149
    3876141063 1131266725 3949079092 1674557074 2566739348 3782985982 2164386649 550438955
    2491039847 2409394861 3757073140 3509849961 3972853470 1377009785 2164834118 820549672
    2867309379 1454756115 94270429 2974978638 2915205038 1887247447 3641720023 4292314015
    702694146 1808155309 95993403 1529688311 2883286160 1410658736 3225014055 1903093988
    2049895643 476880516 3241604078 3709326844 2531992854 265580822 2920230147 4294230868
    408106067 3683123785 1782150222 3876124798 3400886112 1837386661 664033147 3948403539
    3572529266 4084780068 691101764 1191456665 3559651142 709364116 3999544719 189208547
    3851247656 69124994 1685591380 1312437435 2316872331 1466758250 1979107610 2611873442
    80372344 1251839752 2716578101 176193185 2142192370 1179562050 1290470544 1957198791
    1435943450 2989992875 3703466909 1302678442 3343948619 3762772165 1438266632 1761719790
    3668101852 1283600006 671544087 1665876818 3645433092 3760380605 3802664867 1635015896
    1060356828 1666255066 2953295653 2827859377 386702151 3372348076 4248620909 2259505262
    """.split(),
    dtype=np.uint32,
)
ROUNDS = 4


def _turn(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Rotate 32-bit words to the right."""
    return (x >> by) | (x << ((32 - by) & 31))


def permuted(x: np.ndarray, number: int) -> np.ndarray:
    """The 32-bit words x under permutation `number`."""
    low = np.uint32(len(WORDS) - 1)
    for r in range(ROUNDS):
        fixed, at = WORDS[(r + number + 1) % len(WORDS)], np.uint32(r + number)
        x = x + WORDS.take((x + at) & low)
        x = _turn(x, (x ^ fixed) & np.uint32(31))
        x = x ^ WORDS.take((x + at) & low)
        x = _turn(x, (x ^ fixed) & np.uint32(31))
    return x


#: Windows that are permuted at once; they stay in the processor's cache.
_AT_ONCE = 1 << 15


def minhash_all(data: list[bytes], n: int) -> np.ndarray:
    """A row of n minima over the permuted 4-byte windows, big end first, for each of data; none may have fewer than 4 bytes."""
    windows = []
    for d in data:
        b = np.frombuffer(d, np.uint8).astype(np.uint32)
        windows.append(np.unique((b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]))
    size = np.array([len(w) for w in windows])
    out = np.full((len(data), n), 0xFFFFFFFF, np.uint32)
    flat, owner = np.concatenate(windows), np.repeat(np.arange(len(data)), size)
    for at in range(0, len(flat), _AT_ONCE):
        x, o = flat[at : at + _AT_ONCE], owner[at : at + _AT_ONCE]
        start = np.flatnonzero(np.r_[True, o[1:] != o[:-1]])
        for k in range(n):
            out[o[start], k] = np.minimum(out[o[start], k], np.minimum.reduceat(permuted(x, k), start))
    return out


def minhash(data: bytes, n: int) -> list[int] | None:
    """n minima over the permuted 4-byte windows of data; null for fewer than 4 bytes."""
    return minhash_all([data], n)[0].tolist() if len(data) >= 4 else None


def minhash_signatures(df: DataFrame, key: str, data: str, n: int = 128) -> DataFrame:
    """key, signature (ARRAY<BIGINT> of n 32-bit words; null for null data and for fewer than 4 bytes). data: BINARY."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).to_pylist()
            out: list = [None] * len(values)
            long = [i for i, x in enumerate(values) if x is not None and len(x) >= 4]
            if long:
                for i, row in zip(long, minhash_all([values[i] for i in long], n).astype(np.int64).tolist(), strict=True):
                    out[i] = row
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], names=[key, "signature"])

    return spread(df.select(key, data)).mapInArrow(kernel, f"`{key}` {df.schema[key].dataType.simpleString()}, signature array<bigint>")


def function_bytes(blocks: Column) -> Column:
    """The bytes of a function: those of its blocks, in order of addresses. blocks: MAP<BIGINT, STRUCT<..., b64_bytes STRING, ...>>."""
    ordered = F.transform(F.array_sort(F.map_entries(blocks)), lambda e: F.hex(F.unbase64(F.coalesce(e["value"]["b64_bytes"], F.lit("")))))
    return F.unhex(F.array_join(ordered, ""))


def mnemonic_digest(mnemonics: Column) -> Column:
    """SHA-256 of the mnemonics in a row in capitals. mnemonics: the block lists in order of addresses, ARRAY<ARRAY<STRING>>."""
    return F.sha2(F.upper(F.array_join(F.flatten(mnemonics), "")), 256)


# --- weighted similarity hash of a control-flow graph ---------------------------------------------------------------

# The weights of immediates, mnemonics and graphlets in the usual settings.
WEIGHTS = {"graph": (0.0, 0.0, 1.0), "mnem": (0.0, 1.0, 1.0), "all": (1.0, 1.0, 1.0), "tuned": (4.0, 0.05, 1.0)}


def _features(nodes: list[int], edges: list[tuple[int, int]], mnems: dict[int, list[str]], numbers: list[int]) -> Iterator[tuple[int, str]]:
    """The features of a graph, each with its kind (0: immediates, 1: runs of three mnemonics, 2: shapes around nodes and edges). edges: distinct, between nodes."""
    out: dict[int, int] = dict.fromkeys(nodes, 0)
    into: dict[int, int] = dict.fromkeys(nodes, 0)
    for s, d in edges:
        out[s] += 1
        into[d] += 1
    shape = {x: f"{min(into[x], 9)},{min(out[x], 9)}" for x in nodes}
    for x in nodes:
        yield 2, f"n{shape[x]}"
    for s, d in edges:
        yield 2, f"e{shape[s]}>{shape[d]}"
    for x in nodes:
        m = mnems.get(x) or []
        for i in range(len(m) - 2):
            yield 1, f"m{m[i]} {m[i + 1]} {m[i + 2]}"
    for v in numbers:
        yield 0, f"i{v}"


def simhash(features: Iterator[tuple[int, str]], weights: list[tuple[float, float, float]], known: dict[str, np.ndarray] | None = None) -> list[tuple[int, int]]:
    """128 bits for each triple of weights: the signs of the weighted sum of the features' hashed bits; repeated features count less each time, the n-th 1/n. As two signed
    64-bit words. known: bits of features that were hashed before."""
    known = {} if known is None else known
    total = np.zeros((3, 128))
    seen: dict[tuple[int, str], int] = {}
    for kind, f in features:
        n = seen[kind, f] = seen.get((kind, f), 0) + 1
        name = f"{f}#{n}"
        if (bits := known.get(name)) is None:
            if len(known) > 200_000:
                known.clear()  # a bound on memory only
            bits = known[name] = 2.0 * np.unpackbits(np.frombuffer(hashlib.md5(name.encode()).digest(), np.uint8)) - 1
        total[kind] += bits / n
    packed = np.packbits(np.array(weights) @ total > 0, axis=1)
    return [tuple(int.from_bytes(row[i : i + 8].tobytes(), "big", signed=True) for i in (0, 8)) for row in packed]  # type: ignore[misc]


def graph_hashes(df: DataFrame, key: str, settings: dict[str, tuple[float, float, float]]) -> DataFrame:
    """key, num_nodes, branching_nodes, hash0, hash1, setting: a row for each graph and setting, from one pass over its features. df: key, nodes ARRAY<BIGINT>, edges
    ARRAY<STRUCT<src, dst>>, mnems MAP<BIGINT, ARRAY<STRING>>, numbers ARRAY<BIGINT> (immediates). No shuffle; null parts count as empty, edges to unknown nodes are left out."""
    names, weights = list(settings), list(settings.values())

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, np.ndarray] = {}
        for batch in batches:
            rows = []
            for ns, es, ms, im in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                ns = sorted({n for n in ns or [] if n is not None})
                inside = set(ns)
                es = sorted({(e["src"], e["dst"]) for e in es or [] if e and e["src"] in inside and e["dst"] in inside})
                ways = Counter(s for s, _ in es)
                sizes = (len(ns), sum(n > 1 for n in ways.values()))
                rows += [(*sizes, *h) for h in simhash(_features(ns, es, dict(ms or []), im or []), weights, known)]
            columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(4)]
            owner = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), len(names))))
            yield pa.RecordBatch.from_arrays([owner, *columns, pa.array(names * batch.num_rows, pa.string())], names=[key, "num_nodes", "branching_nodes", "hash0", "hash1", "setting"])

    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, num_nodes bigint, branching_nodes bigint, hash0 bigint, hash1 bigint, setting string"
    return spread(df.select(key, "nodes", "edges", "mnems", "numbers")).mapInArrow(kernel, schema)
