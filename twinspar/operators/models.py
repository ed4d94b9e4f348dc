"""Forward passes of graph and sequence models in numpy, over one row per function. Weights are given or drawn from a seed; nothing is trained here.

Each network is a function of arrays, and `apply` runs it over Arrow batches with its weights broadcast, so a table of any size goes
through without a shuffle. Graphs of a batch are packed into one index space (`packed`): all their nodes behind each other, edges between rows, and the graph of each
node; a round of messages is then one step for all of them. A graph without nodes gives the network's value for zeros.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import spread
from .nested import as_list, child_index

Weights = dict[str, np.ndarray]


def drawn(shapes: dict[str, tuple[int, ...]], seed: int) -> Weights:
    """Weights drawn from a normal distribution, scaled by the number of inputs."""
    r = np.random.default_rng(seed)
    return {k: r.standard_normal(s) / np.sqrt(s[0]) for k, s in shapes.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _relu(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0)


def segment(values: np.ndarray, at: np.ndarray, n: int, how: str = "sum") -> np.ndarray:
    """Rows of values put together by segment: sum, mean, sqrt_n or max; 0 for an empty segment."""
    count = np.bincount(at, minlength=n)[:, None].astype(float)
    out = np.zeros((n, values.shape[1]))
    if len(at):
        order = np.argsort(at, kind="stable")
        full = np.flatnonzero(count[:, 0])
        start = np.searchsorted(at[order], full)
        out[full] = (np.maximum if how == "max" else np.add).reduceat(values[order], start, axis=0)
    return out if how in ("sum", "max") else out / np.maximum(count, 1) ** (1.0 if how == "mean" else 0.5)


def gru(state: np.ndarray, x: np.ndarray, w: Weights) -> np.ndarray:
    """One step of a gated unit. w: z, r, c of shape (inputs + states, states)."""
    both = np.concatenate([x, state], axis=1)
    z, r = _sigmoid(both @ w["z"]), _sigmoid(both @ w["r"])
    return (1 - z) * state + z * np.tanh(np.concatenate([x, r * state], axis=1) @ w["c"])


def message_shapes(features: int, states: int = 32, messages: int = 64, graph: int = 128) -> dict[str, tuple[int, ...]]:
    return {"encode": (features, states), "forth": (2 * states, messages), "back": (2 * states, messages), "z": (messages + states, states), "r": (messages + states, states), "c": (messages + states, states), "gate": (states, graph), "value": (states, graph), "out": (graph, graph)}


def propagate(h: np.ndarray, src: np.ndarray, dst: np.ndarray, w: Weights, extra: np.ndarray | None = None) -> np.ndarray:
    """One round of messages along edges and against them, summed at each node, then a gated update."""
    m = segment(np.concatenate([h[src], h[dst]], axis=1) @ w["forth"], dst, len(h)) + segment(np.concatenate([h[dst], h[src]], axis=1) @ w["back"], src, len(h))
    return gru(h, m if extra is None else m + extra, w)


def _one(x: np.ndarray) -> np.ndarray:
    return np.zeros(len(x), np.int64)


def readout(h: np.ndarray, w: Weights, of: np.ndarray | None = None, n: int = 1) -> np.ndarray:
    """A gated sum over the nodes of each graph and a layer; a row for each graph, or the row of the only one."""
    sums = segment(_sigmoid(h @ w["gate"]) * (h @ w["value"]), _one(h) if of is None else of, n) @ w["out"]
    return sums[0] if of is None else sums


def embed_graph(x: np.ndarray, src: np.ndarray, dst: np.ndarray, w: Weights, rounds: int = 5, of: np.ndarray | None = None, n: int = 1) -> np.ndarray:
    """The embeddings of packed graphs with node features x, or of the only one."""
    h = np.tanh(x @ w["encode"])
    for _ in range(rounds):
        h = propagate(h, src, dst, w)
    return readout(h, w, of, n)


def attention(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each side sees of the other, by a softmax over dot products, in both directions."""
    s = a @ b.T
    soft = lambda m: np.exp(m - m.max(axis=1, keepdims=True)) / np.exp(m - m.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True)
    return soft(s) @ b, soft(s.T) @ a


def match_graphs(one: tuple, two: tuple, w: Weights, rounds: int = 5) -> float:
    """Minus the squared distance of two graphs' embeddings when nodes attend to the other graph in each round. one, two: (x, src, dst). w also has cross (states, messages)."""
    (xa, sa, da), (xb, sb, db) = one, two
    a, b = np.tanh(xa @ w["encode"]), np.tanh(xb @ w["encode"])
    for _ in range(rounds):
        if len(a) and len(b):
            to_a, to_b = attention(a, b)
            ea, eb = (a - to_a) @ w["cross"], (b - to_b) @ w["cross"]
        else:
            ea = eb = None
        a, b = propagate(a, sa, da, w, ea), propagate(b, sb, db, w, eb)
    return -float(((readout(a, w) - readout(b, w)) ** 2).sum())


def structure2vec_shapes(features: int, size: int = 64) -> dict[str, tuple[int, ...]]:
    return {"w1": (features, size), "p1": (size, size), "p2": (size, size), "w2": (size, size)}


def structure2vec(x: np.ndarray, src: np.ndarray, dst: np.ndarray, w: Weights, rounds: int = 2, of: np.ndarray | None = None, n: int = 1) -> np.ndarray:
    """Mean-field embeddings of packed graphs, or of the only one: tanh(x W1 + relu(neighbours P2) P1), summed over nodes, W2, length 1."""
    fixed = x @ w["w1"]
    h = np.zeros_like(fixed)
    for _ in range(rounds):
        h = np.tanh(fixed + _relu(segment(h[src], dst, len(h)) @ w["p2"]) @ w["p1"])
    out = segment(h, _one(h) if of is None else of, n) @ w["w2"]
    length = np.linalg.norm(out, axis=1, keepdims=True)
    out = np.where(length > 0, out / np.where(length > 0, length, 1), out)
    return out[0] if of is None else out


def node_mean(ids: list[list[int]], table: np.ndarray) -> np.ndarray:
    """The mean of each node's instruction vectors; zeros for a node without any."""
    return np.array([table[i].mean(axis=0) if len(i) else np.zeros(table.shape[1]) for i in ids]).reshape(-1, table.shape[1])


def node_attention(ids: list[list[int]], table: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Instruction vectors weighed by a softmax of a linear score."""
    def one(i: list[int]) -> np.ndarray:
        if not len(i):
            return np.zeros(table.shape[1])
        v = table[i]
        s = v @ w
        e = np.exp(s - s.max())
        return (e / e.sum()) @ v

    return np.array([one(i) for i in ids]).reshape(-1, table.shape[1])


def node_recurrent(ids: list[list[int]], table: np.ndarray, w: Weights) -> np.ndarray:
    """The last state of a gated unit over each node's instructions."""
    states = w["c"].shape[1]
    out = np.zeros((len(ids), states))
    for k, i in enumerate(ids):
        h = np.zeros((1, states))
        for t in i:
            h = gru(h, table[t][None], w)
        out[k] = h
    return out


def self_attentive_shapes(words: int, states: int = 50, depth: int = 250, hops: int = 10, dense: int = 2000, size: int = 100) -> dict[str, tuple[int, ...]]:
    gates = {f"{d}_{g}": (words + states, states) for d in ("fore", "back") for g in "zrc"}
    return gates | {"s1": (2 * states, depth), "s2": (depth, hops), "dense": (hops * 2 * states, dense), "out": (dense, size)}


def self_attentive(ids: list[int], table: np.ndarray, w: Weights) -> np.ndarray:
    """A sequence embedding: gated units in both directions, attention in several hops, two layers, length 1."""
    states = w["s1"].shape[0] // 2
    if not len(ids):
        return np.zeros(w["out"].shape[1])
    x = table[ids]
    seen = []
    for d, order in (("fore", range(len(x))), ("back", range(len(x) - 1, -1, -1))):
        h, rows, g = np.zeros((1, states)), np.zeros((len(x), states)), {k: w[f"{d}_{k}"] for k in "zrc"}
        for t in order:
            h = gru(h, x[t][None], g)
            rows[t] = h
        seen.append(rows)
    both = np.concatenate(seen, axis=1)
    s = np.tanh(both @ w["s1"]) @ w["s2"]
    a = np.exp(s - s.max(axis=0))
    m = (a / a.sum(axis=0)).T @ both
    out = _relu(m.ravel() @ w["dense"]) @ w["out"]
    n = np.linalg.norm(out)
    return out / n if n > 0 else out


def histogram_match(a: np.ndarray, b: np.ndarray, w: Weights) -> float:
    """The chance that two histograms match: layers of tanh over both, then a softmax. w: h1, h2, out."""
    h = np.tanh(np.tanh(np.concatenate([a, b]) @ w["h1"]) @ w["h2"]) @ w["out"]
    e = np.exp(h - h.max())
    return float(e[0] / e.sum())


def histogram_match_shapes(size: int = 1024) -> dict[str, tuple[int, ...]]:
    return {"h1": (2 * size, 512), "h2": (512, 128), "out": (128, 2)}


def graph_arrays(nodes: list | None, edges: list | None, features: dict[int, list[float]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Node features in order of addresses, and edges between known nodes as row numbers."""
    ns = sorted({n for n in nodes or [] if n is not None})
    at = {n: i for i, n in enumerate(ns)}
    x = np.array([features.get(n) or [0.0] * width for n in ns], float).reshape(len(ns), width)
    kept = sorted({(at[e["src"]], at[e["dst"]]) for e in edges or [] if e and e["src"] in at and e["dst"] in at})
    return x, np.array([s for s, _ in kept], np.int64), np.array([d for _, d in kept], np.int64)


def packed(nodes: pa.Array, edges: pa.Array, features: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """x, src, dst and the graph of each node of a batch of graphs, read off their Arrow buffers: nodes ARRAY<BIGINT>, edges ARRAY<STRUCT<src, dst>>, features
    MAP<BIGINT, ARRAY<DOUBLE>> of `width` numbers. Nodes are in order of addresses; repeated and null ones count once and not at all, edges to others are left out, missing features are 0."""
    node, of, _ = child_index(nodes)
    there = np.asarray(node.is_valid())
    values, code = np.unique(np.asarray(node.filter(pa.array(there)), dtype=np.int64), return_inverse=True)
    span = max(1, len(values))
    keys = np.unique(of[there] * span + code)

    def rows(graph: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The row of each node, -1 where there is none."""
        if not len(keys):
            return np.full(len(graph), -1)
        c = np.minimum(np.searchsorted(values, value), span - 1)
        k = graph * span + c
        at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
        return np.where((values[c] == value) & (keys[at] == k), at, -1)

    edge, graph, _ = child_index(edges)
    s, d = (edge.flatten()[edge.type.get_field_index(f)] for f in ("src", "dst"))
    full = np.asarray(s.is_valid()) & np.asarray(d.is_valid())
    s, d = (np.asarray(z.filter(pa.array(full)), dtype=np.int64) for z in (s, d))
    s, d = rows(graph[full], s), rows(graph[full], d)
    kept = (s >= 0) & (d >= 0)
    pairs = np.unique(s[kept] * max(1, len(keys)) + d[kept])
    x = np.zeros((len(keys), width))
    entry, graph, _ = child_index(as_list(features))
    name, numbers = entry.flatten()
    at = rows(graph, np.asarray(name, dtype=np.int64))
    number, place, ordinal = child_index(numbers)
    kept = (at[place] >= 0) & (ordinal < width)
    x[at[place][kept], ordinal[kept]] = np.nan_to_num(np.asarray(number, dtype=float)[kept])
    return x, pairs // max(1, len(keys)), pairs % max(1, len(keys)), keys // span


#: Graphs that are packed at once; a bound on memory only.
_GRAPHS = 2000


def embed_graphs(df: DataFrame, key: str, network: Callable, weights: Weights, width: int, name: str = "embedding") -> DataFrame:
    """key and the embedding of each graph as ARRAY<DOUBLE>. df: key, nodes, edges, x (see `packed`); network(x, src, dst, weights, of=, n=) works on packed graphs."""
    held = df.sparkSession.sparkContext.broadcast(weights)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, _GRAPHS):
                b = batch.slice(start, _GRAPHS)
                x, src, dst, of = packed(b.column(1), b.column(2), b.column(3), width)
                out = network(x, src, dst, held.value, of=of, n=b.num_rows)
                values = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * out.shape[1]), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), values], names=[key, name])

    return spread(df.select(key, "nodes", "edges", "x")).mapInArrow(kernel, f"`{key}` {df.schema[key].dataType.simpleString()}, `{name}` array<double>")


def apply(df: DataFrame, key: str, columns: list[str], network: Callable, weights: Weights, name: str = "embedding") -> DataFrame:
    """key and network(*columns of a row, weights) as ARRAY<DOUBLE>. The weights are broadcast once; their size does not depend on the data."""
    held = df.sparkSession.sparkContext.broadcast(weights)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = held.value
        for batch in batches:
            rows = zip(*(batch.column(i + 1).to_pylist() for i in range(len(columns))), strict=True)
            out = [np.atleast_1d(network(*r, w)).tolist() for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], names=[key, name])

    return spread(df.select(key, *columns)).mapInArrow(kernel, f"`{key}` {df.schema[key].dataType.simpleString()}, `{name}` array<double>")
