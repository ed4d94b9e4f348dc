"""Control-flow graphs: edges, degrees, adjacency, reachability, betweenness, walks.

Relational parts work on (key, src, dst) rows. What goes round in a graph (reachability, betweenness, walks) works on one row per graph with
arrays of nodes and edges, in Arrow batches: no graph is shuffled, and graphs of any number go through in constant memory. Edges to unknown nodes are
dropped unless it is said; loops and repeated edges count once; null arrays are empty graphs.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

# --- relational ----------------------------------------------------------------------------------------------------


def nodes_of(df: DataFrame, key: str, nodes: str = "nodes") -> DataFrame:
    return df.select(key, F.explode(F.array_distinct(nodes)).alias("node")).where("node is not null")


def edges_of(df: DataFrame, key: str, known_only: bool = True, nodes: str = "nodes", edges: str = "edges") -> DataFrame:
    """key, src, dst: distinct edges, by default those between nodes of the graph. Checked inside the row, without a join."""
    kept = F.array_distinct(F.filter(edges, lambda e: e["src"].isNotNull() & e["dst"].isNotNull()))
    if known_only:
        kept = F.filter(kept, lambda e: F.array_contains(nodes, e["src"]) & F.array_contains(nodes, e["dst"]))
    return df.select(key, F.explode(kept).alias("e")).select(key, "e.src", "e.dst")


def all_nodes(df: DataFrame, key: str) -> DataFrame:
    """The nodes of a graph that edges may add to."""
    e = edges_of(df, key, known_only=False)
    return nodes_of(df, key).union(e.select(key, "src")).union(e.select(key, "dst")).distinct()


def degrees(df: DataFrame, key: str) -> DataFrame:
    """key, node, n_in, n_out, is_source (nothing leads to it)."""
    e = edges_of(df, key)
    ends = e.select(key, F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(e.select(key, F.col("dst"), F.lit(1), F.lit(0)))
    own = nodes_of(df, key).select(key, "node", F.lit(0).alias("i"), F.lit(0).alias("o"))
    n = own.union(ends).groupBy(key, "node").agg(F.sum("i").cast("bigint").alias("n_in"), F.sum("o").cast("bigint").alias("n_out"))
    return n.withColumn("is_source", F.col("n_in") == 0)


def sizes(df: DataFrame, key: str) -> DataFrame:
    """key, num_nodes, num_edges, branching_nodes (more than one way out)."""
    return degrees(df, key).groupBy(key).agg(F.count("*").alias("num_nodes"), F.sum("n_out").alias("num_edges"), F.count_if(F.col("n_out") > 1).alias("branching_nodes"))


def adjacency(df: DataFrame, key: str) -> DataFrame:
    """key, row, col, n: the adjacency matrix; rows and columns number the nodes in the order of their addresses."""
    order = F.array_sort(F.array_distinct(F.filter("nodes", lambda x: x.isNotNull())))
    place = lambda x: F.array_position("__o", x) - 1
    kept = F.array_distinct(F.filter("edges", lambda e: F.array_contains("__o", e["src"]) & F.array_contains("__o", e["dst"])))
    e = df.withColumn("__o", order).select(key, "__o", F.size("__o").alias("n"), F.explode(kept).alias("e"))
    return e.select(key, place(F.col("e.src")).cast("bigint").alias("row"), place(F.col("e.dst")).cast("bigint").alias("col"), F.col("n").cast("bigint").alias("n"))


# --- one row per graph ----------------------------------------------------------------------------------------------


def clean(nodes: list | None, edges: list | None) -> tuple[list[int], dict[int, list[int]]]:
    """Nodes in order, and the successors of each."""
    ns = sorted({n for n in nodes or [] if n is not None})
    out: dict[int, set[int]] = {n: set() for n in ns}
    for e in edges or []:
        if e and e["src"] in out and e["dst"] in out:
            out[e["src"]].add(e["dst"])
    return ns, {n: sorted(d) for n, d in out.items()}


def per_graph(df: DataFrame, key: str, compute: Callable, fields: list[tuple[str, str]], columns: tuple[str, ...] = ("nodes", "edges")) -> DataFrame:
    """key and the rows that compute(*columns of a graph) yields."""
    kinds = {"bigint": pa.int64(), "double": pa.float64(), "array<bigint>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string()), "int": pa.int32()}

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, rows = [], []
            for i, graph in enumerate(zip(*(batch.column(j).to_pylist() for j in range(1, batch.num_columns)), strict=True)):
                for r in compute(*graph):
                    owner.append(i)
                    rows.append(r)
            arrays = [pa.array([r[j] for r in rows], kinds[k]) for j, (_, k) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *arrays], names=[key, *(n for n, _ in fields)])

    schema = ", ".join([f"`{key}` {df.schema[key].dataType.simpleString()}", *(f"`{n}` {k}" for n, k in fields)])
    return spread(df.select(key, *columns)).mapInArrow(kernel, schema)


def descendants(succ: dict[int, list[int]]) -> dict[int, int]:
    """How many other nodes each node leads to. Strongly connected nodes are joined first, then bit sets are merged in topological order."""
    index: dict[int, int] = {}
    low: dict[int, int] = {}
    on, stack, component, groups = set(), [], {}, []
    for root in succ:
        if root in index:
            continue
        work = [(root, iter(succ[root]))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            n, it = work[-1]
            for m in it:
                if m not in index:
                    index[m] = low[m] = len(index)
                    stack.append(m)
                    on.add(m)
                    work.append((m, iter(succ[m])))
                    break
                if m in on:
                    low[n] = min(low[n], index[m])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[n])
                if low[n] == index[n]:
                    group = []
                    while True:
                        m = stack.pop()
                        on.discard(m)
                        component[m] = len(groups)
                        group.append(m)
                        if m == n:
                            break
                    groups.append(group)
    place = {n: i for i, n in enumerate(succ)}
    reach: list[int] = []
    for g in groups:  # every successor group is there already
        bits = 0
        for n in g:
            bits |= 1 << place[n]
        for c in {component[m] for n in g for m in succ[n]}:
            if c < len(reach):
                bits |= reach[c]
        reach.append(bits)
    return {n: reach[component[n]].bit_count() - 1 for n in succ}


def offspring(df: DataFrame, key: str) -> DataFrame:
    """key, node, n_offspring: how many other nodes can be reached."""

    def compute(nodes: list, edges: list) -> Iterator[tuple]:
        yield from descendants(clean(nodes, edges)[1]).items()

    return per_graph(df, key, compute, [("node", "bigint"), ("n_offspring", "bigint")])


def betweenness_of(succ: dict[int, list[int]]) -> dict[int, float]:
    """Shares of shortest paths through each node, directed, unweighted, over (n-1)(n-2)."""
    score = dict.fromkeys(succ, 0.0)
    for s in succ:
        order, before, paths, far = [], {s: []}, {s: 1}, {s: 0}
        queue = deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for x in succ[v]:
                if x not in far:
                    far[x] = far[v] + 1
                    paths[x], before[x] = 0, []
                    queue.append(x)
                if far[x] == far[v] + 1:
                    paths[x] += paths[v]
                    before[x].append(v)
        share = dict.fromkeys(order, 0.0)
        for x in reversed(order):
            for v in before[x]:
                share[v] += paths[v] / paths[x] * (1 + share[x])
            if x != s:
                score[x] += share[x]
    n = len(succ)
    return {k: v / ((n - 1) * (n - 2)) if n > 2 else v for k, v in score.items()}


def betweenness(df: DataFrame, key: str) -> DataFrame:
    """key, node, betweenness."""

    def compute(nodes: list, edges: list) -> Iterator[tuple]:
        yield from betweenness_of(clean(nodes, edges)[1]).items()

    return per_graph(df, key, compute, [("node", "bigint"), ("betweenness", "double")])


def _draw(*parts: object) -> int:
    return int.from_bytes(hashlib.md5(":".join(map(str, parts)).encode()).digest()[:8], "big")


def walks_of(nodes: list, edges: list, walks: int, longest: int, seed: int, name: object) -> Iterator[list[int]]:
    """All nodes in stored order, then `walks` walks from a source (or the least address) that never come back to a node."""
    ns, succ = clean(nodes, edges)
    if not ns:
        return
    yield [n for n in dict.fromkeys(nodes) if n is not None]
    reached = {d for x in succ.values() for d in x}
    sources = [n for n in ns if n not in reached]
    for w in range(walks):
        here = sources[_draw(name, seed, w) % len(sources)] if sources else ns[0]
        path, been = [here], {here}
        while len(path) < longest:
            ways = [d for d in succ[here] if d not in been]
            if not ways:
                break
            here = ways[_draw(name, seed, w, len(path)) % len(ways)]
            path.append(here)
            been.add(here)
        yield path


def random_walks(df: DataFrame, key: str, walks: int = 10, longest: int = 500, seed: int = 1) -> DataFrame:
    """key, walk (0: all nodes in stored order), path. Draws are hashes of key, seed, walk and step, so the walks are the same on any cluster."""
    named = df.select(key, F.col(key).cast("string").alias("__name"), "nodes", "edges")

    def compute(name: str, nodes: list, edges: list) -> Iterator[tuple]:
        yield from enumerate(walks_of(nodes or [], edges or [], walks, longest, seed, name))

    return per_graph(named, key, compute, [("walk", "int"), ("path", "array<bigint>")], ("__name", "nodes", "edges"))


def walk_instructions(df: DataFrame, key: str, walks: int = 10, longest: int = 500, most: int = 50_000, seed: int = 1) -> DataFrame:
    """key, walk, instructions: the lower-case instructions of each walk's blocks, at most `most`. df: key, nodes, edges, disasm MAP<BIGINT, ARRAY<STRING>>."""
    named = df.select(key, F.col(key).cast("string").alias("__name"), "nodes", "edges", "disasm")

    def compute(name: str, nodes: list, edges: list, disasm: list) -> Iterator[tuple]:
        text = dict(disasm or [])
        for w, path in enumerate(walks_of(nodes or [], edges or [], walks, longest, seed, name)):
            out: list[str] = []
            for n in path:
                out += [i.lower() for i in text.get(n) or [] if i]
                if len(out) >= most:
                    break
            yield w, out[:most]

    return per_graph(named, key, compute, [("walk", "int"), ("instructions", "array<string>")], ("__name", "nodes", "edges", "disasm"))
