"""Queries of features, codecs, graphs, models, sources and streams over acfg_disasm, catalog_sigs and events."""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec as X
from ..functions import tokens as T
from ..functions import vectors as V
from ..functions import mnemonics as M
from ..functions.mnemonics import counters, machine_of
from ..functions.names import hex_number
from ..operators import embed as E
from ..operators import features as A
from ..operators import graph as G
from ..operators import models as N
from ..operators import strands as S
from ..operators.pairs import all_against
from ..sources import io
from ..session import cut, scratch, spread, table
from ..streaming import streams

KEY = ["record_id"]
TOP = 100
#: Lengths of sequences of ids: for a text of whole functions, and for the input of a network.
SEQUENCE, PADDED = 250, 150


def acfg(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "acfg_disasm")


def tokens(spark: SparkSession, d: str) -> DataFrame:
    return A.instructions(acfg(spark, d), KEY)


def counts(spark: SparkSession, d: str) -> DataFrame:
    return A.term_counts(tokens(spark, d))


def vocab(spark: SparkSession, d: str) -> DataFrame:
    return cut(A.vocabulary_top(counts(spark, d), TOP))


def vocab_min(spark: SparkSession, d: str) -> DataFrame:
    return A.vocabulary_min(counts(spark, d), 3)


def unknown(spark: SparkSession, d: str) -> DataFrame:
    """Token counts after rare tokens became UNK."""
    kept = cut(vocab_min(spark, d).where("kept").select("token"))
    return A.term_counts(A.unknown_replaced(tokens(spark, d), kept))


def ids(spark: SparkSession, d: str) -> DataFrame:
    return A.with_ids(tokens(spark, d), vocab(spark, d))


def coverage(spark: SparkSession, d: str) -> DataFrame:
    return A.coverage(ids(spark, d), KEY).withColumn("known_pct", F.round("known_pct", 6))


def bags(spark: SparkSession, d: str) -> DataFrame:
    return A.bags(ids(spark, d), [*KEY, "block"])


def sequences(stop: bool, spark: SparkSession, d: str, longest: int = SEQUENCE) -> DataFrame:
    out = A.sequences(ids(spark, d), KEY, ["block", "pos"], longest, stop)
    return out.select("record_id", X.joined(F.col("ids")).alias("ids"))


def padded(spark: SparkSession, d: str, longest: int = PADDED) -> DataFrame:
    out = A.sequences(ids(spark, d), KEY, ["block", "pos"], longest)
    return out.select("record_id", X.joined(T.cut_and_padded(F.transform("ids", lambda x: x + 1), longest)).alias("ids"), T.capped_size(F.col("ids"), longest).cast("bigint").alias("size"))


def machine_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens with the family of the function's machine."""
    return A.instructions(acfg(spark, d).withColumn("machine", machine_of(F.col("arch"))), [*KEY, "machine"])


def instruction_norm(spark: SparkSession, d: str) -> DataFrame:
    """Each block's instructions in normal form, made from their disassembly. Addresses stay, as in the table's own bb_norm, which has blanks in some mnemonics."""
    b = acfg(spark, d).select("record_id", F.explode("basic_blocks").alias("block", "b")).where("b.bb_disasm is not null and b.bb_norm is not null")
    return b.select("record_id", "block", F.array_join(F.transform("b.bb_disasm", lambda i: T.normalised(i, 1 << 62)), ";").alias("norm"))


def class_counts(spark: SparkSession, d: str) -> DataFrame:
    return A.class_counts(machine_tokens(spark, d), KEY)


def block_constants(spark: SparkSession, d: str) -> DataFrame:
    """The small immediates of each block, as text, and how many there are."""
    blocks = acfg(spark, d).select("record_id", F.explode("basic_blocks").alias("block", "b")).select("record_id", "block", F.col("b.bb_disasm").alias("disasm"))
    return A.block_constants(blocks, ["record_id", "block"]).select("record_id", "block", X.joined(F.col("numerics")).alias("numerics"), "n_numeric_consts")


def incoming_calls(spark: SparkSession, d: str) -> DataFrame:
    """How often the code of the same binary, as far as the table has it, calls or jumps to the start of each function."""
    a = acfg(spark, d)
    lines = a.select(F.col("idb_path").alias("binary"), machine_of(F.col("arch")).alias("machine"), F.explode(F.map_values("basic_blocks")).alias("b")).select("binary", "machine", F.explode("b.bb_disasm").alias("i"))
    lines = lines.select("binary", "machine", F.lower(F.regexp_extract("i", r"^\s*(\S+)", 1)).alias("token"), T.immediates(F.col("i")).alias("n"))
    jumps = lines.join(F.broadcast(counters(spark)), ["machine", "token"]).where("is_redirect").select("binary", F.explode("n").alias("target"))
    functions = a.select(F.col("idb_path").alias("binary"), hex_number(F.col("fva")).alias("address"), "record_id")
    return A.incoming_calls(jumps, functions).select("record_id", "n_incoming_calls")


def rollup(spark: SparkSession, d: str) -> DataFrame:
    """Counts of each function: blocks, edges, bytes, instructions and classes."""
    sizes = acfg(spark, d).select(
        "record_id",
        F.greatest(F.coalesce(F.size("basic_blocks"), F.lit(0)), F.lit(0)).cast("bigint").alias("n_blocks"),
        F.greatest(F.coalesce(F.size("edges"), F.lit(0)), F.lit(0)).cast("bigint").alias("n_edges"),
        F.coalesce(F.aggregate(F.map_values("basic_blocks"), F.lit(0).cast("bigint"), lambda a, b: a + F.coalesce(b["bb_len"], F.lit(0))), F.lit(0)).cast("bigint").alias("n_bytes"),
    )
    return A.joined_features(sizes, class_counts(spark, d), on=KEY)


def asm_tokens(spark: SparkSession, d: str) -> DataFrame:
    lines = acfg(spark, d).select(F.explode("basic_blocks").alias("k", "b")).select(F.explode("b.bb_disasm").alias("i"))
    return A.term_counts(lines.select(F.explode(T.plain_tokens(F.col("i"))).alias("token")))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """record_id, lines: the instructions of each function, blocks in order of addresses."""
    ordered = F.transform(F.array_sort(F.map_entries("basic_blocks")), lambda e: F.coalesce(e["value"]["bb_disasm"], F.array().cast("array<string>")))
    return spread(acfg(spark, d)).select("record_id", F.filter(F.flatten(ordered), lambda x: x.isNotNull()).alias("lines")).where("size(lines) > 0")


def traces(spark: SparkSession, d: str) -> DataFrame:
    t = _lines(spark, d).select("record_id", T.trace(F.col("lines"), 512).alias("t"))
    return t.select("record_id", F.array_join("t.code", " ").alias("code"), X.joined(F.col("t.inst"), " ").alias("inst_pos"), X.joined(F.col("t.pos"), " ").alias("op_pos"))


def opcode_hash(spark: SparkSession, d: str) -> DataFrame:
    """SHA-256 of the mnemonics in order of addresses, and how many functions share it."""
    t = tokens(spark, d).groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("block", "pos", "token"))).alias("m"))
    h = t.select("record_id", F.sha2(F.upper(F.array_join(F.transform("m", lambda x: x["token"]), "")), 256).alias("digest"))
    return h


def strand_buckets(spark: SparkSession, d: str) -> DataFrame:
    lines = acfg(spark, d).select("record_id", F.explode("basic_blocks").alias("k", "b")).select("record_id", F.explode("b.bb_norm").alias("e")).where("e is not null")
    return A.strand_histogram(lines, KEY, "e").withColumn("bucket", F.col("bucket").cast("bigint"))


def codec_hist(spark: SparkSession, d: str) -> DataFrame:
    """Histograms as text, and read back."""
    h = strand_buckets(spark, d).groupBy("record_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("bucket").cast("int"), "n"))).alias("h"))
    text = h.select("record_id", X.histogram_text(F.col("h")).alias("text"))
    return text.select("record_id", "text", F.size(X.histogram(F.col("text"))).cast("bigint").alias("buckets"))


def statements(spark: SparkSession, d: str) -> DataFrame:
    """Statements of blocks out of their disassembly: the first operand is written, stores, calls and jumps are effects."""
    parts = lambda i: F.transform(F.split(F.regexp_replace(F.regexp_replace(F.lower(i), r"^\s*\S+\s*", ""), r"\s+", ""), ","), lambda a: F.trim(a))

    def statement(i):  # noqa: ANN001, ANN202
        op = F.regexp_extract(F.lower(i), r"^\s*(\S+)", 1)
        a = F.filter(parts(i), lambda x: x != "")
        writes = (F.size(a) > 0) & ~op.rlike(r"^(?:cmp|test|j\w*|b\w*|call|ret\w*|push|nop)$")
        memory = F.get(a, F.lit(0)).startswith("[")
        return F.struct(F.when(writes & ~memory, F.get(a, F.lit(0))).alias("out"), op.alias("op"), F.when(writes & (F.size(a) > 1), F.slice(a, 2, 1000)).otherwise(a).alias("args"), (memory | ~writes | (F.size(a) > 0)).alias("effect"))

    b = acfg(spark, d).select("record_id", F.explode("basic_blocks").alias("k", "b")).where("b.bb_disasm is not null")
    return b.select("record_id", F.transform("b.bb_disasm", statement).alias("statements"))


def strands(spark: SparkSession, d: str) -> DataFrame:
    return A.strand_histogram(S.strands(statements(spark, d), "record_id", "statements"), KEY, "strand").withColumn("bucket", F.col("bucket").cast("bigint"))


def sub_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Instructions of each block and of its parts between calls."""
    return A.sub_blocks(machine_tokens(spark, d), KEY).groupBy("record_id", "block", "part").agg(F.count("*").alias("n"))


def split_graph(which: int, spark: SparkSession, d: str) -> DataFrame:
    """Nodes or edges of the graphs whose blocks are cut after calls. A part whose address is not given has the block's address plus its first place."""
    heads = acfg(spark, d).select("record_id", F.explode("basic_blocks").alias("block", "b")).select("record_id", "block", F.col("b.bb_heads").alias("heads"))
    parts = A.sub_blocks(machine_tokens(spark, d), KEY).groupBy("record_id", "block", "part").agg(F.min("pos").alias("pos"), F.count("*").alias("n"))
    parts = parts.join(heads, ["record_id", "block"]).withColumn("address", F.coalesce(F.get("heads", F.col("pos")), F.col("block") + F.col("pos")))
    return A.split_graph(parts, G.edges_of(acfg(spark, d), "record_id"), "record_id")[which]


def edges(known: bool, spark: SparkSession, d: str) -> DataFrame:
    return G.edges_of(acfg(spark, d), "record_id", known)


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return G.all_nodes(acfg(spark, d), "record_id")


def degrees(spark: SparkSession, d: str) -> DataFrame:
    return G.degrees(acfg(spark, d), "record_id")


def sizes(spark: SparkSession, d: str) -> DataFrame:
    return G.sizes(acfg(spark, d), "record_id")


def adjacency(spark: SparkSession, d: str) -> DataFrame:
    return G.adjacency(acfg(spark, d), "record_id")


def codec_coo(spark: SparkSession, d: str) -> DataFrame:
    """Adjacency matrices as text, and the entries after reading them back."""
    m = adjacency(spark, d).groupBy("record_id", "n").agg(F.array_sort(F.collect_list(F.struct("row", "col"))).alias("e"))
    text = m.select("record_id", X.coo_text(F.transform("e", lambda x: x["row"]), F.transform("e", lambda x: x["col"]), F.transform("e", lambda _: F.lit(1)), F.col("n"), F.col("n")).alias("text"))
    return text.select("record_id", "text", F.size(X.identity_if_empty(X.coo(F.col("text")))["rows"]).cast("bigint").alias("entries"))


def offspring(spark: SparkSession, d: str) -> DataFrame:
    return G.offspring(acfg(spark, d), "record_id")


def betweenness(spark: SparkSession, d: str) -> DataFrame:
    return G.betweenness(acfg(spark, d), "record_id").withColumn("betweenness", F.round("betweenness", 9))


def node_features(spark: SparkSession, d: str) -> DataFrame:
    """Counts of classes and constants, reachable nodes and betweenness of each node."""
    n = G.nodes_of(acfg(spark, d), "record_id")
    classes = A.class_counts(machine_tokens(spark, d), ["record_id", "block"]).withColumnRenamed("block", "node")
    constants = block_constants(spark, d).select("record_id", F.col("block").alias("node"), "n_numeric_consts")
    return A.joined_features(n, classes, constants, offspring(spark, d), betweenness(spark, d), on=["record_id", "node"])


def walks(spark: SparkSession, d: str) -> DataFrame:
    return G.random_walks(acfg(spark, d), "record_id").select("record_id", "walk", X.joined(F.col("path")).alias("path"))


def _disasm(spark: SparkSession, d: str) -> DataFrame:
    return acfg(spark, d).select("record_id", "nodes", "edges", F.transform_values("basic_blocks", lambda _, b: b["bb_disasm"]).alias("disasm"))


def walk_text(spark: SparkSession, d: str) -> DataFrame:
    w = G.walk_instructions(_disasm(spark, d), "record_id")
    return w.select("record_id", "walk", F.size("instructions").cast("bigint").alias("n"), F.md5(F.array_join("instructions", "\n")).alias("digest"))


def _graphs(spark: SparkSession, d: str) -> DataFrame:
    """record_id, nodes, edges, x: eight numbers of each node. String constants are not in the table and count 0."""
    f = node_features(spark, d)
    columns = ["n_numeric_consts", "n_transfer", "n_call", "n_instructions", "n_arith", "n_logic", "n_offspring", "betweenness"]
    x = f.groupBy("record_id").agg(F.map_from_entries(F.collect_list(F.struct("node", F.array(*(F.log1p(F.col(c).cast("double")) for c in columns))))).alias("x"))
    return acfg(spark, d).select("record_id", "nodes", "edges").join(x, "record_id")


def _gmn(n1: list, e1: list, x1: list, n2: list, e2: list, x2: list, w: N.Weights) -> float:
    return N.match_graphs(N.graph_arrays(n1, e1, dict(x1), 8), N.graph_arrays(n2, e2, dict(x2), 8), w)


def s2v(spark: SparkSession, d: str) -> DataFrame:
    return N.embed_graphs(_graphs(spark, d), "record_id", N.structure2vec, N.drawn(N.structure2vec_shapes(8), 1), 8)


def ggnn(spark: SparkSession, d: str) -> DataFrame:
    return N.embed_graphs(_graphs(spark, d), "record_id", N.embed_graph, N.drawn(N.message_shapes(8), 2), 8)


def gmn(spark: SparkSession, d: str) -> DataFrame:
    """The matching score of each graph and the next one."""
    g = cut(_graphs(spark, d))
    n = g.select((F.col("record_id") - 1).alias("record_id"), *(F.col(c).alias(f"{c}2") for c in ("nodes", "edges", "x")))
    w = N.drawn(N.message_shapes(8) | {"cross": (32, 64)}, 3)
    return N.apply(g.join(n, "record_id"), "record_id", ["nodes", "edges", "x", "nodes2", "edges2", "x2"], _gmn, w, "sim").select("record_id", F.get("sim", F.lit(0)).alias("sim"))


def _safe(i: list, w: N.Weights) -> np.ndarray:
    return N.self_attentive([x + 1 for x in i], w["table"], w)


def safe(spark: SparkSession, d: str) -> DataFrame:
    """Self-attentive embeddings of the first 150 instructions."""
    seqs = A.sequences(ids(spark, d), KEY, ["block", "pos"], 150)
    w = N.drawn(N.self_attentive_shapes(50), 4) | N.drawn({"table": (TOP + 1, 50)}, 5)
    return N.apply(seqs, "record_id", ["ids"], _safe, w)


def _node_means(ids_: list, nodes: list, edges: list, w: N.Weights) -> np.ndarray:
    """structure2vec over attention, mean and recurrent node vectors, behind each other."""
    by = {e["block"]: [i + 1 for i in e["ids"]] for e in ids_}
    ns = sorted({n for n in nodes or [] if n is not None})
    lists = [by.get(n, []) for n in ns]
    _, src, dst = N.graph_arrays(nodes, edges, {}, 1)
    rnn = {k: w[k] for k in "zrc"}
    views = (N.node_mean(lists, w["table"]), N.node_attention(lists, w["table"], w["attention"][:, 0]), N.node_recurrent(lists, w["table"], rnn))
    return np.concatenate([N.structure2vec(x, src, dst, w) for x in views])


def s2v_tokens(spark: SparkSession, d: str) -> DataFrame:
    """structure2vec with instruction vectors per node, in three ways."""
    per_block = A.sequences(ids(spark, d), ["record_id", "block"], ["pos"], 200).groupBy("record_id").agg(F.collect_list(F.struct("block", "ids")).alias("b"))
    w = N.drawn(N.structure2vec_shapes(16), 6) | N.drawn({"table": (TOP + 1, 16), "attention": (16, 1), "z": (32, 16), "r": (32, 16), "c": (32, 16)}, 7)
    return N.apply(per_block.join(acfg(spark, d).select("record_id", "nodes", "edges"), "record_id"), "record_id", ["b", "nodes", "edges"], _node_means, w)


def _mlp(a: list, b: list, w: N.Weights) -> float:
    dense = np.zeros((2, 1024))
    for row, h in zip(dense, (a, b), strict=True):
        for k, n in h:
            row[k] = n
    return N.histogram_match(dense[0], dense[1], w)


def strand_mlp(spark: SparkSession, d: str) -> DataFrame:
    """The score of a network over the strand histograms of each function and the next one."""
    h = cut(strand_buckets(spark, d).groupBy("record_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("bucket").cast("int"), "n"))).alias("a")))
    both = h.join(h.select((F.col("record_id") - 1).alias("record_id"), F.col("a").alias("b")), "record_id")
    return N.apply(both, "record_id", ["a", "b"], _mlp, N.drawn(N.histogram_match_shapes(), 8), "sim").select("record_id", F.get("sim", F.lit(0)).alias("sim"))


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    return tokens(spark, d).groupBy("record_id", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]).alias("tokens"))


def word2vec(spark: SparkSession, d: str) -> DataFrame:
    """The nearest of the other mnemonics to each one, by vectors trained on blocks as sentences. The vocabulary is counted and crossed with itself in blocks."""
    v = cut(_plain_vectors(E.fit_word2vec(_sentences(spark, d), size=32, least=8, rounds=1)))
    both = all_against(v.select(F.col("word").alias("query"), F.col("v").alias("qv")), v).where("word <> query")
    near = both.groupBy("query").agg(F.max_by(F.struct("word", V.cosine(F.col("qv"), F.col("v")).alias("sim")), V.cosine(F.col("qv"), F.col("v"))).alias("n"))
    return near.select(F.col("query").alias("word"), F.col("n.word").alias("near"), F.col("n.sim").alias("sim"))


def _plain_vectors(model: E.Word2VecModel) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return E.word_vectors(model).select("word", vector_to_array("vector").alias("v"))


def arith_mean(spark: SparkSession, d: str) -> DataFrame:
    """Each function's mean mnemonic vector, length 1; mnemonic vectors are drawn from hashes, so SQL can draw them too."""
    v = counts(spark, d).select("token", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substring(F.md5(F.concat("token", F.lit(":"), i.cast("string"))), 1, 4), 16, 10).cast("double") / 65535 - 0.5).alias("v"))
    rows = tokens(spark, d).join(v, "token").select("record_id", F.posexplode("v").alias("j", "x")).groupBy("record_id", "j").agg(F.avg("x").alias("x"))
    unit = rows.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("j", "x"))).alias("m")).select("record_id", V.unit(F.transform("m", lambda e: e["x"])).alias("u"))
    return unit.select("record_id", F.posexplode("u").alias("dim", "x")).select("record_id", F.col("dim").cast("bigint").alias("dim"), F.round("x", 6).alias("x"))


def documents(kind: str, spark: SparkSession, d: str) -> DataFrame:
    """Document vectors of functions, trained on all of their instructions."""
    text = _lines(spark, d).select(F.col("record_id").alias("id"), F.transform("lines", T.plain_tokens).alias("tokens"))
    m = E.DocumentModel(kind=kind, size=16, negative=5, rounds=1, infer_rounds=2)
    return E.infer_documents(text, E.fit_documents(text, m), m)


def header_rows(spark: SparkSession, d: str) -> DataFrame:
    return io.without_header_rows(table(spark, d, "catalog_sigs"), "catalog_hash_list").select("sig_id", "path")


def csv_round(spark: SparkSession, d: str) -> DataFrame:
    """flowchart's key columns through CSV and back."""
    where = scratch(spark, "csv")
    io.write_csv(table(spark, d, "flowchart").select("func_id", "fva", "bb_num", "split_name"), where)
    return io.read_csv(spark, where, "func_id bigint, fva string, bb_num int, split_name string")


def pending(spark: SparkSession, d: str) -> DataFrame:
    """Functions of flowchart that acfg_disasm lacks, or has without blocks."""
    return io.pending(table(spark, d, "flowchart").select("idb_path", "fva"), acfg(spark, d), ["idb_path", "fva"], F.col("basic_blocks").isNull()).distinct()


def stream_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events by day and type, counted from a stream of files that is worked off once."""
    e = table(spark, d, "events")
    where = scratch(spark, "stream")
    source = streams.read_stream(spark, _folder(spark, d, "events"), e)
    out = streams.counts(source, "ts", "1 day", [F.col("event_type")], "3650 days")

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{where}/out")

    q = out.writeStream.foreachBatch(keep).outputMode("complete").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{where}/out").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def _folder(spark: SparkSession, d: str, name: str) -> str:
    """A folder that holds a copy of a table as files, for the stream to read."""
    where = scratch(spark, "in")
    table(spark, d, name).write.parquet(where)
    return where


QUERIES = {
    "vocab_topk": vocab,
    "vocab_min_freq": vocab_min,
    "unk_replace": unknown,
    "coverage_pct": coverage,
    "bow_matrix": bags,
    "id_sequences": partial(sequences, False),
    "id_sequences_block_stop": partial(sequences, True),
    "id_sequences_padded": padded,
    "class_counts": class_counts,
    "function_rollup": rollup,
    "tokenize_asm": asm_tokens,
    "tokenize_trace": traces,
    "opcode_hash": opcode_hash,
    "strand_bucket_hist": strand_buckets,
    "strand_slices": strands,
    "codec_hist": codec_hist,
    "codec_coo": codec_coo,
    "instruction_norm": instruction_norm,
    "block_constants": block_constants,
    "incoming_calls": incoming_calls,
    "call_split_blocks": sub_blocks,
    "call_split_nodes": partial(split_graph, 0),
    "call_split_edges": partial(split_graph, 1),
    "cfg_edges": partial(edges, True),
    "cfg_edges_all": partial(edges, False),
    "cfg_nodes": nodes,
    "cfg_degree": degrees,
    "cfg_size_branching": sizes,
    "cfg_adjacency": adjacency,
    "cfg_offspring": offspring,
    "cfg_betweenness": betweenness,
    "node_features": node_features,
    "random_walks": walks,
    "walk_instructions": walk_text,
    "s2v_embed": s2v,
    "s2v_tokens": s2v_tokens,
    "graph_embed": ggnn,
    "graph_match": gmn,
    "seq_embed": safe,
    "strand_mlp": strand_mlp,
    "word2vec_nn": word2vec,
    "arith_mean_embed": arith_mean,
    "doc_vectors_pvdm": partial(documents, "pvdm"),
    "doc_vectors_pvdbow": partial(documents, "pvdbow"),
    "doc_vectors_asm": partial(documents, "asm"),
    "header_rows": header_rows,
    "csv_round_trip": csv_round,
    "pending_runs": pending,
    "stream_counts": stream_counts,
}

_TOK = r"""b AS (SELECT record_id, e.key AS block, e.value.bb_mnems AS m FROM (SELECT record_id, unnest(map_entries(basic_blocks)) AS e FROM acfg_disasm)),
    t AS (SELECT record_id, block, i - 1 AS pos, lower(trim(m[i])) AS token FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM b) WHERE trim(m[i]) <> ''),
    c AS (SELECT token, count(*) AS n FROM t GROUP BY token)"""
_IDS = f"""{_TOK}, v AS (SELECT token, n, row_number() OVER (ORDER BY n DESC, token) - 1 AS id FROM c QUALIFY id < {TOP}),
    ids AS (SELECT t.record_id, t.block, t.pos, coalesce(v.id, -1) AS id FROM t LEFT JOIN v USING (token))"""
def _class_sql() -> str:
    """CTEs cls (machine, class, token) and flags (machine, token, one BOOLEAN for each counter), from the listed values and the rule of Arm's conditions."""
    listed = " UNION ALL ".join(f"SELECT '{m}' AS machine, '{c}' AS class, unnest(string_split('{' '.join(t.split())}', ' ')) AS token" for (m, c), t in M.LISTED.items())
    words = lambda x: f"(SELECT unnest(string_split('{' '.join(x)}', ' ')) AS w)"
    conditions = f"(SELECT w FROM {words(M.CONDITIONS)} UNION ALL SELECT '')"
    plain = f"SELECT 'arm', 'arithmetic', a.w || c.w FROM {words(M.ARM_STEMS)} a, {conditions} c"
    flags = f"SELECT 'arm', 'arithmetic', a.w || s FROM {words(M.ARM_FLAG_STEMS)} a, {conditions} c, (SELECT unnest([c.w, c.w || 's', 's' || c.w]) AS s)"
    counted = ", ".join(f"bool_or(class IN ({', '.join(map(repr, k))})) AS is_{n}" for n, k in M.COUNTERS.items())
    return f"cls AS ({listed} UNION ALL {plain} UNION ALL {flags}), flags AS (SELECT machine, token, {counted} FROM cls GROUP BY machine, token)"


_MACHINE = "mach AS (SELECT record_id, lower(trim(split_part(arch, '-', 1))) AS machine FROM acfg_disasm)"
_CLASSES = ", ".join(f"count(*) FILTER (coalesce(is_{n}, false)) AS n_{n}" for n in M.COUNTERS)
_COUNTED = f"{_class_sql()}, {_MACHINE}, k AS (SELECT record_id, count(*) AS n_instructions, {_CLASSES} FROM t JOIN mach USING (record_id) LEFT JOIN flags USING (machine, token) GROUP BY record_id)"
_DIS = """d AS (SELECT record_id, e.key AS block, e.value.bb_disasm AS l, e.value.bb_norm AS nl FROM (SELECT record_id, unnest(map_entries(basic_blocks)) AS e FROM acfg_disasm))"""
_EDGE = """g AS (SELECT record_id, nodes, unnest(list_distinct(edges)) AS e FROM acfg_disasm), k AS (SELECT record_id, e.src AS src, e.dst AS dst FROM g WHERE list_contains(nodes, e.src) AND list_contains(nodes, e.dst)),
    n AS (SELECT DISTINCT record_id, unnest(nodes) AS node FROM acfg_disasm)"""
_DEG = f"""{_EDGE}, deg AS (SELECT n.record_id, n.node, (SELECT count(*) FROM k WHERE k.record_id = n.record_id AND k.dst = n.node) AS n_in, (SELECT count(*) FROM k WHERE k.record_id = n.record_id AND k.src = n.node) AS n_out FROM n WHERE node IS NOT NULL)"""
_ADJ = f"""{_EDGE}, o AS (SELECT record_id, node, row_number() OVER (PARTITION BY record_id ORDER BY node) - 1 AS i, count(*) OVER (PARTITION BY record_id) AS n FROM n WHERE node IS NOT NULL),
    adj AS (SELECT k.record_id, a.i AS row, z.i AS col, a.n AS n FROM k JOIN o a ON a.record_id = k.record_id AND a.node = src JOIN o z ON z.record_id = k.record_id AND z.node = dst)"""
_CALLS = " OR ".join(f"machine = '{m}' AND token IN ({', '.join(map(repr, sorted(M.members(m, 'call'))))})" for m in ("x86", "arm", "mips"))
_PARTS = f"""{_TOK}, {_MACHINE}, s AS (SELECT t.*, coalesce(sum(coalesce({_CALLS}, false)::INT) OVER (PARTITION BY record_id, block ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS part FROM t JOIN mach USING (record_id))"""
_SPLIT = """heads AS (SELECT record_id, e.key AS block, e.value.bb_heads AS h FROM (SELECT record_id, unnest(map_entries(basic_blocks)) AS e FROM acfg_disasm)),
    nodes AS (SELECT record_id, block, part, CASE WHEN part = 0 THEN block ELSE coalesce(any_value(h)[min(pos) + 1], block + min(pos)) END AS node, count(*) AS n_instructions FROM s JOIN heads USING (record_id, block) GROUP BY record_id, block, part)"""
_OPERANDS = r"""lines AS (SELECT record_id, block, i, lower(l[i]) AS t FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM (SELECT record_id, e.key AS block, e.value.bb_disasm AS l FROM (SELECT record_id, unnest(map_entries(basic_blocks)) AS e FROM acfg_disasm)))),
    ops AS (SELECT record_id, block, i, regexp_extract(t, '^\s*(\S+)', 1) AS token, list_filter(list_transform(string_split(regexp_replace(regexp_replace(t, '^\s*\S+\s*', ''), '-?[0-9a-fx]*\([^)]*\)|\[[^\]]*\]|\{[^}]*\}', '?', 'g'), ','),
        lambda x: regexp_replace(trim(x), '^#', '')), lambda x: regexp_full_match(x, '-?(0x[0-9a-f]{1,16}|[0-9]{1,18})')) AS found FROM lines WHERE t IS NOT NULL)"""
_NUMBERS = f"""{_OPERANDS}, one AS (SELECT record_id, block, i, unnest(range(1, len(found) + 1)) AS j, found FROM ops),
    n AS (SELECT record_id, block, list(CASE WHEN found[j] LIKE '-%' THEN -1 ELSE 1 END * (CASE WHEN found[j] LIKE '%0x%' THEN '0x' || regexp_replace(found[j], '^-?0x', '') ELSE regexp_replace(found[j], '^-', '') END)::BIGINT ORDER BY i, j) AS numbers FROM one GROUP BY ALL),
    per_block AS (SELECT b.record_id, b.block, n.numbers FROM (SELECT record_id, unnest(map_keys(basic_blocks)) AS block FROM acfg_disasm) b LEFT JOIN n USING (record_id, block))"""
_SUCC = "succ AS (SELECT record_id, src, list_sort(list(dst)) AS ways FROM (SELECT DISTINCT record_id, src, dst FROM k) GROUP BY record_id, src)"
_WALK = f"""{_EDGE}, {_SUCC}, starts AS (SELECT n.record_id, list_sort(list(n.node)) AS ns, list_sort(list(n.node) FILTER (NOT EXISTS (SELECT 1 FROM k WHERE k.record_id = n.record_id AND k.dst = n.node))) AS src FROM n WHERE n.node IS NOT NULL GROUP BY n.record_id),
    stored AS (SELECT record_id, list(node ORDER BY i) AS path FROM (SELECT record_id, node, min(i) AS i FROM (SELECT record_id, unnest(nodes) AS node, unnest(range(len(nodes))) AS i FROM acfg_disasm) WHERE node IS NOT NULL GROUP BY ALL) GROUP BY record_id),
    walk AS (SELECT record_id, w, CASE WHEN len(src) > 0 THEN [src[(('0x' || substr(md5(record_id || ':1:' || w), 1, 16))::UBIGINT % len(src)::UBIGINT)::BIGINT + 1]] ELSE [ns[1]] END AS path FROM starts, range(10) r(w)
        UNION ALL SELECT record_id, w, list_append(path, ways[(('0x' || substr(md5(record_id || ':1:' || w || ':' || len(path)), 1, 16))::UBIGINT % len(ways)::UBIGINT)::BIGINT + 1])
        FROM (SELECT walk.record_id, w, path, list_filter(succ.ways, lambda x: NOT list_contains(path, x)) AS ways FROM walk JOIN succ ON succ.record_id = walk.record_id AND src = path[-1] WHERE len(path) < 500) WHERE len(ways) > 0),
    walks AS (SELECT record_id, 0 AS walk, path FROM stored UNION ALL SELECT record_id, (w + 1)::INT, arg_max(path, len(path)) FROM walk GROUP BY record_id, w)"""
_BETWEEN = f"""{_EDGE}, d0 AS (SELECT DISTINCT record_id, src, dst FROM k WHERE src <> dst), many AS (SELECT record_id, count(*) AS n FROM n WHERE node IS NOT NULL GROUP BY record_id),
    far AS (SELECT record_id, src AS s, dst AS t, 1 AS d FROM d0 UNION SELECT far.record_id, s, d0.dst, d + 1 FROM far JOIN d0 ON d0.record_id = far.record_id AND d0.src = t JOIN many ON many.record_id = far.record_id WHERE d + 1 < many.n AND d0.dst <> s),
    dist AS (SELECT record_id, s, t, min(d) AS d FROM far GROUP BY ALL),
    path AS (SELECT record_id, src AS s, dst AS t, [src, dst] AS p FROM d0 UNION ALL SELECT path.record_id, path.s, d0.dst, list_append(p, d0.dst) FROM path JOIN d0 ON d0.record_id = path.record_id AND d0.src = path.t
        JOIN dist ON dist.record_id = path.record_id AND dist.s = path.s AND dist.t = d0.dst WHERE dist.d = len(p)),
    share AS (SELECT record_id, unnest(p[2:-2]) AS node, 1.0 / count(*) OVER (PARTITION BY record_id, s, t) AS x FROM path),
    between AS (SELECT n.record_id, n.node, coalesce((SELECT sum(x) FROM share WHERE share.record_id = n.record_id AND share.node = n.node), 0) AS x FROM n WHERE n.node IS NOT NULL)"""
_HIST = f"""{_DIS}, x AS (SELECT record_id, unnest(nl) AS e FROM d), h AS (SELECT record_id, (('0x' || substr(md5(e), 3, 2) || substr(md5(e), 1, 2))::BIGINT & 1023) AS bucket, count(*) AS n FROM x WHERE e IS NOT NULL GROUP BY ALL)"""
SQL = {
    "instruction_norm": f"WITH {_DIS} SELECT record_id, block, replace(array_to_string(nl, ';'), ' ', '_') AS norm FROM d WHERE l IS NOT NULL AND nl IS NOT NULL",
    "vocab_topk": f"WITH {_IDS} SELECT token, n, id FROM v",
    "vocab_min_freq": f"WITH {_TOK} SELECT token, n, n >= 3 AS kept FROM c",
    "unk_replace": f"WITH {_TOK} SELECT CASE WHEN n >= 3 THEN token ELSE 'UNK' END AS token, sum(n)::BIGINT AS n FROM c GROUP BY 1",
    "coverage_pct": f"WITH {_IDS} SELECT record_id, count(*) AS tokens, round(count(*) FILTER (id <> -1) * 100.0 / count(*), 6) AS known_pct FROM ids GROUP BY record_id",
    "bow_matrix": f"WITH {_IDS} SELECT record_id, block, id, count(*) AS n FROM ids WHERE id >= 0 GROUP BY ALL",
    "id_sequences": f"""WITH {_IDS}, r AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY block, pos) AS n FROM ids)
        SELECT record_id, string_agg(id::VARCHAR, ';' ORDER BY block, pos) AS ids FROM r WHERE n <= {SEQUENCE} GROUP BY record_id""",
    "id_sequences_block_stop": f"""WITH {_IDS}, s AS (SELECT record_id, block, count(*) AS n FROM ids GROUP BY ALL),
        a AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY record_id ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
        SELECT record_id, string_agg(id::VARCHAR, ';' ORDER BY block, pos) AS ids FROM ids JOIN a USING (record_id, block) WHERE before < {SEQUENCE} GROUP BY record_id""",
    "id_sequences_padded": f"""WITH {_IDS}, r AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY block, pos) AS n FROM ids), l AS (SELECT record_id, list(id + 1 ORDER BY n) AS i FROM r WHERE n <= {PADDED} GROUP BY record_id)
        SELECT record_id, array_to_string(list_resize(i, {PADDED}, 0), ';') AS ids, len(i) AS size FROM l""",
    "class_counts": f"WITH {_TOK}, {_COUNTED} SELECT * FROM k",
    "function_rollup": f"""WITH {_TOK}, {_COUNTED}
        SELECT record_id, coalesce(cardinality(basic_blocks), 0)::BIGINT AS n_blocks, coalesce(len(edges), 0) AS n_edges, coalesce(list_sum(list_transform(map_values(basic_blocks), lambda x: coalesce(x.bb_len, 0))), 0)::BIGINT AS n_bytes,
        coalesce(n_instructions, 0) AS n_instructions, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in M.COUNTERS)} FROM acfg_disasm LEFT JOIN k USING (record_id)""",
    "tokenize_asm": rf"WITH {_DIS}, l AS (SELECT unnest(l) AS i FROM d), t AS (SELECT unnest(regexp_split_to_array(lower(i), '[#,{{}}+\-*\\\[\]:()\s]')) AS token FROM l) SELECT token, count(*) AS n FROM t WHERE token <> '' GROUP BY token",
    "tokenize_trace": rf"""WITH {_DIS}, f AS (SELECT record_id, list_filter(flatten(list(coalesce(l, []) ORDER BY block)), lambda x: x IS NOT NULL) AS l FROM d GROUP BY record_id),
        i AS (SELECT record_id, i - 1 AS inst, list_filter(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(l[i], '([,\[\]:*(){{}}!])', ' \1 ', 'g'), '[#$]', '', 'g'), '-([0-9a-fA-F]+)', '- \1', 'g'), '\s+'), lambda x: x <> '') AS t
              FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM f)),
        t AS (SELECT record_id, inst, p - 1 AS pos, lower(t[p]) AS w FROM (SELECT *, unnest(range(1, len(t) + 1)) AS p FROM i)),
        r AS (SELECT record_id, inst, pos, CASE WHEN contains(w, '0x') THEN 'hexvar' WHEN regexp_full_match(w, '[0-9]+') THEN 'num' ELSE w END AS code FROM t QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY inst, pos) <= 512)
        SELECT record_id, string_agg(code, ' ' ORDER BY inst, pos) AS code, string_agg(inst::VARCHAR, ' ' ORDER BY inst, pos) AS inst_pos, string_agg(pos::VARCHAR, ' ' ORDER BY inst, pos) AS op_pos FROM r GROUP BY record_id""",
    "opcode_hash": f"WITH {_TOK} SELECT record_id, sha256(upper(string_agg(token, '' ORDER BY block, pos))) AS digest FROM t GROUP BY record_id",
    "strand_bucket_hist": f"WITH {_HIST} SELECT * FROM h",
    "codec_hist": f"WITH {_HIST} SELECT record_id, string_agg(bucket || ':' || n, ';' ORDER BY bucket) AS text, count(*) AS buckets FROM h GROUP BY record_id",
    "codec_coo": f"""WITH {_ADJ} SELECT record_id, string_agg(row::VARCHAR, ';' ORDER BY row, col) || '::' || string_agg(col::VARCHAR, ';' ORDER BY row, col) || '::' || string_agg('1', ';') || '::' || n || '::' || n AS text,
        count(*) AS entries FROM adj GROUP BY record_id, n""",
    "block_constants": f"""WITH {_NUMBERS} SELECT record_id, block, coalesce(array_to_string(list_filter(numbers, lambda x: x <= 4096), ';'), '') AS numerics, coalesce(len(list_filter(numbers, lambda x: x <= 4096)), 0) AS n_numeric_consts FROM per_block""",
    "incoming_calls": f"""WITH {_OPERANDS}, {_class_sql()}, {_MACHINE}, r AS (SELECT idb_path, CASE WHEN x LIKE '-%' THEN -1 ELSE 1 END * (CASE WHEN x LIKE '%0x%' THEN '0x' || regexp_replace(x, '^-?0x', '') ELSE regexp_replace(x, '^-', '') END)::BIGINT AS target
        FROM (SELECT o.record_id, token, unnest(found) AS x FROM ops o) o JOIN mach USING (record_id) JOIN flags f USING (machine, token) JOIN acfg_disasm a USING (record_id) WHERE is_redirect),
        n AS (SELECT idb_path, target, count(*) AS n FROM r GROUP BY ALL)
        SELECT record_id, coalesce(n, 0) AS n_incoming_calls FROM (SELECT record_id, idb_path, ('0x' || regexp_replace(lower(trim(fva)), '^0x', ''))::BIGINT AS address FROM acfg_disasm) a LEFT JOIN n ON n.idb_path = a.idb_path AND n.target = a.address""",
    "call_split_blocks": f"WITH {_PARTS} SELECT record_id, block, part, count(*) AS n FROM s GROUP BY ALL",
    "call_split_nodes": f"WITH {_PARTS}, {_SPLIT} SELECT record_id, node, block, part, n_instructions FROM nodes",
    "call_split_edges": f"""WITH {_PARTS}, {_SPLIT}, {_EDGE}, ends AS (SELECT *, row_number() OVER (PARTITION BY record_id, block ORDER BY part DESC) AS back, lead(node) OVER (PARTITION BY record_id, block ORDER BY part) AS nxt FROM nodes)
        SELECT record_id, node AS src, nxt AS dst FROM ends WHERE nxt IS NOT NULL UNION SELECT k.record_id, z.node, k.dst FROM k JOIN ends z ON z.record_id = k.record_id AND z.block = k.src AND back = 1""",
    "cfg_edges": f"WITH {_EDGE} SELECT record_id, src, dst FROM k",
    "cfg_edges_all": f"WITH {_EDGE} SELECT record_id, e.src AS src, e.dst AS dst FROM g WHERE e.src IS NOT NULL AND e.dst IS NOT NULL",
    "cfg_nodes": f"WITH {_EDGE} SELECT record_id, node FROM n WHERE node IS NOT NULL UNION SELECT record_id, e.src FROM g WHERE e.src IS NOT NULL AND e.dst IS NOT NULL UNION SELECT record_id, e.dst FROM g WHERE e.src IS NOT NULL AND e.dst IS NOT NULL",
    "cfg_degree": f"WITH {_DEG} SELECT record_id, node, n_in, n_out, n_in = 0 AS is_source FROM deg",
    "cfg_size_branching": f"WITH {_DEG} SELECT record_id, count(*) AS num_nodes, sum(n_out)::BIGINT AS num_edges, count(*) FILTER (n_out > 1) AS branching_nodes FROM deg GROUP BY record_id",
    "cfg_adjacency": f"WITH {_ADJ} SELECT record_id, row, col, n FROM adj",
    "cfg_offspring": f"""WITH RECURSIVE {_EDGE}, r AS (SELECT record_id, src AS node, dst AS other FROM k UNION SELECT r.record_id, r.node, k.dst FROM r JOIN k ON k.record_id = r.record_id AND k.src = r.other)
        SELECT n.record_id, n.node, count(r.other) FILTER (r.other <> n.node) AS n_offspring FROM n LEFT JOIN r ON r.record_id = n.record_id AND r.node = n.node WHERE n.node IS NOT NULL GROUP BY ALL""",
    "random_walks": f"WITH RECURSIVE {_WALK} SELECT record_id, walk, array_to_string(path, ';') AS path FROM walks",
    "walk_instructions": f"""WITH RECURSIVE {_WALK}, {_DIS}, i AS (SELECT record_id, walk, p, q, lower(l[q]) AS t FROM (SELECT *, unnest(range(1, len(l) + 1)) AS q FROM (SELECT w.record_id, walk, p, l FROM (SELECT record_id, walk, path, unnest(range(1, len(path) + 1)) AS p FROM walks) w LEFT JOIN d ON d.record_id = w.record_id AND d.block = path[p])) WHERE l[q] <> '')
        SELECT w.record_id, w.walk, count(t) AS n, md5(coalesce(string_agg(t, chr(10) ORDER BY p, q), '')) AS digest FROM walks w LEFT JOIN i USING (record_id, walk) GROUP BY w.record_id, w.walk""",
    "cfg_betweenness": f"WITH RECURSIVE {_BETWEEN} SELECT record_id, node, round((CASE WHEN n > 2 THEN x / ((n - 1) * (n - 2)) ELSE x END)::DOUBLE, 9) AS betweenness FROM between JOIN many USING (record_id)",
    "arith_mean_embed": f"""WITH {_TOK}, v AS (SELECT token, i, ('0x' || substr(md5(token || ':' || i), 1, 4))::DOUBLE / 65535 - 0.5 AS x FROM c, range(8) r(i)), m AS (SELECT record_id, i, avg(x) AS x FROM t JOIN v USING (token) GROUP BY ALL)
        SELECT record_id, i AS dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY record_id)), 6) AS x FROM m""".replace("::DOUBLE / 65535", "::BIGINT::DOUBLE / 65535"),
    "header_rows": "SELECT sig_id, path FROM catalog_sigs WHERE trim(catalog_hash_list) IS DISTINCT FROM 'catalog_hash_list'",
    "csv_round_trip": "SELECT func_id, fva, bb_num, split_name FROM flowchart",
    "pending_runs": "SELECT DISTINCT idb_path, fva FROM flowchart f WHERE NOT EXISTS (SELECT 1 FROM acfg_disasm a WHERE a.idb_path = f.idb_path AND a.fva = f.fva AND a.basic_blocks IS NOT NULL)",
    "stream_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
}
