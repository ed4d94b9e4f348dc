"""Queries of similarities, ranking metrics and signatures over embeddings, catalog_sigs, fss_hashes and acfg_disasm."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import metrics as M
from ..operators import pairs as P
from ..operators.curate import numbered
from ..operators.signature import WEIGHTS, function_bytes, graph_hashes, minhash_signatures
from ..session import cut, table

NEGATIVES = 100
PROBES = 16


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")


def neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Each vector with the next one by id: a, b, va, vb."""
    e = vectors(spark, d)
    return e.select(F.col("vec_id").alias("a"), F.col("v").alias("va")).join(e.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("v").alias("vb")), "a")


def _with_next(e: DataFrame) -> DataFrame:
    """func_id, func_id_2: each row with the next one of its func_name, by an equi-join on row numbers; a name of any size is spread over ranges."""
    rows = cut(numbered(e.select("func_name", "func_id"), ["func_name", "func_id"], "place"))
    after = rows.select("func_name", (F.col("place") - 1).alias("place"), F.col("func_id").alias("func_id_2"))
    return rows.join(after, ["func_name", "place"]).select("func_id", "func_id_2")


def scored(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Scored positives (each vector with the next one of its label) and negatives (100 vectors of other labels each). Vectors are brought to length 1 once."""
    e = cut(numbered(vectors(spark, d).select(F.col("vec_id").alias("func_id"), F.col("label").alias("func_name"), V.unit(F.col("v")).alias("v")), ["func_id"]))
    pos = _with_next(e).select(F.col("func_id").alias("func_id_1"), "func_id_2", F.col("func_id").alias("idx"))
    neg = P.negatives(e.drop("v"), e.drop("v"), "rank", PROBES, NEGATIVES)
    sim = lambda p: P.described(p, e, ["v", "func_name"]).withColumn("sim", F.coalesce(F.round(V.dot(F.col("v_1"), F.col("v_2")), 6), F.lit(0.0))).drop("v_1", "v_2")
    return cut(sim(pos)), cut(sim(neg))


def ranked(ties: str, spark: SparkSession, d: str) -> DataFrame:
    pos, neg = scored(spark, d)
    return M.ranks(pos, neg, ["func_id_1"], ties).withColumnRenamed("func_id_1", "vec_id")


def mrr_recall(spark: SparkSession, d: str) -> DataFrame:
    """MRR@10 and Recall@K of cosine similarity by label, equal scores against the positive."""
    pos, neg = scored(spark, d)
    label = pos.select("func_id_1", F.col("func_name_1").alias("label"))
    out = M.ranking_table(M.ranks(pos, neg, ["func_id_1"]).join(label, "func_id_1"), label, ["label"])
    return out.select("label", *(F.round(c, 6).alias(c) for c in out.columns if c != "label"))


def labelled(spark: SparkSession, d: str) -> DataFrame:
    pos, neg = scored(spark, d)
    one = lambda p, y: p.select(F.col("func_name_1").alias("task"), "sim", F.lit(y).alias("label"))
    return one(pos, 1).unionByName(one(neg, 0))


def auc_exact(spark: SparkSession, d: str) -> DataFrame:
    return M.auc(labelled(spark, d), []).withColumn("auc", F.round("auc", 6))


def auc_by_task(spark: SparkSession, d: str) -> DataFrame:
    return M.auc(labelled(spark, d), ["task"]).withColumn("auc", F.round("auc", 6))


def losses(spark: SparkSession, d: str) -> DataFrame:
    """Mean losses of the ranked positives and negatives by label: margin and signs of pairs, squared difference, and cross-entropy of (sim, -sim)."""
    y = F.col("label")
    l = labelled(spark, d).withColumn("label", F.col("label") * 2 - 1)
    one = V.zero_one(y)
    r = lambda c, n: F.round(F.avg(c), 6).alias(n)
    return l.groupBy("task").agg(
        r(M.margin_pair_loss(1 - F.col("sim"), y), "margin"), r(M.hamming_pair_loss(F.col("sim"), y), "signs"), F.round(M.pair_loss(F.col("sim"), y), 6).alias("squares"),
        r(M.softmax_loss(F.array(-F.col("sim"), F.col("sim")), one.cast("int")), "softmax"),
    )


def best_task(spark: SparkSession, d: str) -> DataFrame:
    """The label with the greatest area, of even and of odd ones."""
    a = M.auc(labelled(spark, d), ["task"]).withColumn("group", F.pmod("task", F.lit(2)))
    return M.best_by(a.withColumn("auc", F.round("auc", 6)), ["group"], "task", "auc")


def auc_binned(spark: SparkSession, d: str) -> DataFrame:
    return M.binned_auc(labelled(spark, d), ["task"]).withColumn("auc", F.round("auc", 6))


def pairwise(measure, spark: SparkSession, d: str) -> DataFrame:  # noqa: ANN001
    return neighbours(spark, d).select("a", "b", F.round(measure(F.col("va"), F.col("vb")), 6).alias("sim"))


def pairwise_block(spark: SparkSession, d: str) -> DataFrame:
    """The first vector of each label against all vectors: dot product, cosine and squared distance; the query set is one row per label."""
    e = vectors(spark, d)
    q = e.groupBy("label").agg(F.min_by(F.struct("vec_id", "v"), "vec_id").alias("q")).select(F.col("q.vec_id").alias("query_id"), F.col("q.v").alias("qv"))
    both = P.all_against(q, e)
    r = lambda c, n: F.round(c, 6).alias(n)
    return both.select("query_id", "vec_id", r(V.dot(F.col("qv"), F.col("v")), "dot"), r(V.cosine(F.col("qv"), F.col("v")), "cosine"), r(V.euclidean_similarity(F.col("qv"), F.col("v")), "euclid"))


def segments(spark: SparkSession, d: str) -> DataFrame:
    """Sum, mean, sum over the root of n, and maximum of each dimension by label."""
    e = vectors(spark, d).select("label", F.posexplode("v").alias("dim", "x"))
    r = lambda c, n: F.round(c, 6).alias(n)
    return e.groupBy("label", "dim").agg(r(F.sum("x"), "total"), r(F.avg("x"), "mean"), r(F.sum("x") / F.sqrt(F.count("*")), "sqrt_n"), r(F.max("x"), "top")).withColumn("dim", F.col("dim").cast("bigint"))


def triplet_accuracy(spark: SparkSession, d: str) -> DataFrame:
    pos, neg = scored(spark, d)
    both = pos.select("func_id_1", F.col("sim").alias("near")).join(neg.select("func_id_1", F.col("sim").alias("far")), "func_id_1")
    return both.agg(F.round(M.triplet_accuracy(F.col("near"), F.col("far")), 6).alias("accuracy"), F.round(M.triplet_loss(F.col("near"), F.col("far"), 0.1), 6).alias("loss"))


def normalised(spark: SparkSession, d: str) -> DataFrame:
    """Scores of neighbours scaled to 0..1 over all of them."""
    s = cut(neighbours(spark, d).select("a", V.dot(F.col("va"), F.col("vb")).alias("dot")))
    ends = s.agg(F.min("dot").alias("low"), F.max("dot").alias("high"))
    return s.crossJoin(F.broadcast(ends)).select("a", F.round(V.min_max(F.col("dot"), F.col("low"), F.col("high")), 6).alias("scaled"))


def _word(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return F.when(t.startswith("0x"), F.conv(F.substring(t, 3, 16), 16, -10)).when(t.startswith("-"), t).when(t != "", F.conv(t, 10, -10)).try_cast("bigint")


def hamming128(spark: SparkSession, d: str) -> DataFrame:
    """1 minus the share of differing bits of each function's two words and those of the next row."""
    f = table(spark, d, "fss_hashes").select("fss_id", _word(F.col("hashes0")).alias("h0"), _word(F.col("hashes1")).alias("h1"))
    g = f.select((F.col("fss_id") - 1).alias("fss_id"), F.col("h0").alias("g0"), F.col("h1").alias("g1"))
    return f.join(g, "fss_id").select("fss_id", F.round(V.hamming_words(*map(F.col, ("h0", "h1", "g0", "g1"))), 6).alias("sim"))


def _set(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit("[0-9]+"), 0), lambda x: x.cast("bigint"))


def jaccard_sets(spark: SparkSession, d: str) -> DataFrame:
    """The overlap of each signature with the next row's, as sets and place by place."""
    c = table(spark, d, "catalog_sigs").select("sig_id", _set(F.col("catalog_hash_list")).alias("s"))
    n = c.select((F.col("sig_id") - 1).alias("sig_id"), F.col("s").alias("t"))
    both = c.join(n, "sig_id").where("size(s) > 0 and size(t) > 0")
    return both.select("sig_id", F.round(V.jaccard(F.col("s"), F.col("t")), 6).alias("jaccard"), F.round(F.when(F.size("s") == F.size("t"), V.same_places(F.col("s"), F.col("t"))), 6).alias("places"))


def vulnerable(spark: SparkSession, d: str) -> DataFrame:
    """Each reference signature and each of catalog_sigs that shares a value: vuln_id, sig_id, arch, sim. Shared values are counted by an equi-join."""
    known = table(spark, d, "vuln_sigs").select(F.col("sig_id").alias("vuln_id"), F.array_distinct(_set(F.col("catalog_hash_list"))).alias("known"))
    name = F.element_at(F.split(F.translate("path", "\\", "/"), "/"), -1)
    rows = table(spark, d, "catalog_sigs").select("sig_id", F.regexp_extract(name, "^[A-Za-z]+[0-9]*", 0).alias("arch"), F.array_distinct(_set(F.col("catalog_hash_list"))).alias("s"))
    values = rows.select("sig_id", "arch", F.size("s").alias("n"), F.explode("s").alias("x"))
    shared = values.join(known.select("vuln_id", F.size("known").alias("m"), F.explode("known").alias("x")), "x")
    counted = shared.groupBy("vuln_id", "sig_id", "arch", "n", "m").agg(F.count("*").alias("k"))
    return counted.select("vuln_id", "sig_id", "arch", F.round(F.col("k") / (F.col("n") + F.col("m") - F.col("k")), 6).alias("sim")).where("sim > 0")


def vuln_best(spark: SparkSession, d: str) -> DataFrame:
    """The best match of each reference signature on each machine."""
    best = vulnerable(spark, d).groupBy("vuln_id", "arch").agg(F.max_by(F.struct("sim", "sig_id"), F.struct("sim", -F.col("sig_id"))).alias("b"))
    return best.select("vuln_id", "arch", "b.sig_id", "b.sim")


def _search(spark: SparkSession, d: str) -> DataFrame:
    """The first vector of each label against all others; the second one is the match that is looked for."""
    e = vectors(spark, d)
    first = e.groupBy("label").agg(F.min_by(F.struct("vec_id", "v"), "vec_id").alias("q")).select("label", F.col("q.vec_id").alias("query_id"), F.col("q.v").alias("qv"))
    second = e.join(first, "label").where("vec_id > query_id").groupBy("label").agg(F.min("vec_id").alias("match"))
    q = first.join(second, "label", "left").select(F.col("label").alias("query"), "query_id", "qv", "match")
    both = P.all_against(q, e).where("vec_id <> query_id")
    return both.select("query", "query_id", "vec_id", F.round(V.cosine(F.col("qv"), F.col("v")), 6).alias("sim"), F.equal_null("vec_id", "match").alias("hit"))


def vuln_rank(spark: SparkSession, d: str) -> DataFrame:
    return M.target_ranks(_search(spark, d), ["query"], F.col("hit"), [F.col("vec_id")])


def vuln_mrr(spark: SparkSession, d: str) -> DataFrame:
    """Rank lists and MRR@10 of queries with even and odd labels."""
    r = vuln_rank(spark, d).withColumn("firmware", (F.col("query") % 2).cast("int"))
    return M.rank_lists(r, ["firmware"], "query").withColumn("mrr_at_10", F.round("mrr_at_10", 6))


def minhash(spark: SparkSession, d: str) -> DataFrame:
    """Signatures of 64 words of each function's bytes."""
    a = table(spark, d, "acfg_disasm").select("record_id", function_bytes(F.col("basic_blocks")).alias("data"))
    return minhash_signatures(a, "record_id", "data", 64)


def function_digests(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "acfg_disasm").select("record_id", function_bytes(F.col("basic_blocks")).alias("data"))
    return a.select("record_id", F.coalesce(F.length("data"), F.lit(0)).cast("bigint").alias("n_bytes"), F.md5(F.coalesce("data", F.lit(b""))).alias("md5"))


def simhash(spark: SparkSession, d: str) -> DataFrame:
    """Similarity hashes of graphs in the four usual settings."""
    numbers = F.flatten(F.transform(F.map_values("basic_blocks"), lambda b: F.flatten(F.transform(F.coalesce(b["bb_disasm"], F.array().cast("array<string>")), lambda i: F.regexp_extract_all(i, F.lit("0x([0-9a-f]{1,3})(?![0-9a-f])"), 1)))))
    a = table(spark, d, "acfg_disasm").select("record_id", "nodes", "edges", F.transform_values("basic_blocks", lambda _, b: b["bb_mnems"]).alias("mnems"), F.transform(numbers, lambda x: F.conv(x, 16, 10).cast("bigint")).alias("numbers"))
    return graph_hashes(a, "record_id", WEIGHTS)


_MEASURES = {"cosine_pairs": V.cosine, "dot_pairs": V.dot, "euclid_sim": V.euclidean_similarity, "hamming_sign": V.hamming_sign, "hamming_tanh": V.hamming_tanh}
QUERIES = {
    "mrr_recall_cosine": mrr_recall,
    "rank_min": partial(ranked, "min"),
    "rank_max": partial(ranked, "max"),
    "auc_exact": auc_exact,
    "auc_by_task": auc_by_task,
    "auc_binned": auc_binned,
    "pair_losses": losses,
    "best_task": best_task,
    **{k: partial(pairwise, m) for k, m in _MEASURES.items()},
    "pairwise_block": pairwise_block,
    "segment_aggregates": segments,
    "triplet_accuracy": triplet_accuracy,
    "scores_normalised": normalised,
    "hamming128": hamming128,
    "jaccard_sets": jaccard_sets,
    "vuln_best_match": vuln_best,
    "vuln_rank": vuln_rank,
    "vuln_mrr": vuln_mrr,
    "minhash_sig": minhash,
    "function_digests": function_digests,
    "simhash": simhash,
}

_E = "e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings)"
_COS = "list_cosine_similarity({0}, {1})"
_SCORED = f"""{_E}, pool AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS idx, * FROM e),
    pos AS (SELECT a.vec_id AS id1, a.label, round({_COS.format('a.v', 'b.v')}, 6) AS sim FROM (SELECT *, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS nxt FROM e) a JOIN e b ON b.vec_id = a.nxt),
    tries AS (SELECT l.vec_id AS id1, l.label AS n1, k, j, ('0x' || substr(md5(l.vec_id || ':rank:' || k || ':' || j), 1, 8))::BIGINT % (SELECT count(*) FROM pool) AS idx FROM pool l, range({NEGATIVES}) r(k), range({PROBES}) q(j) WHERE l.label IS NOT NULL),
    hit AS (SELECT id1, n1, k, arg_min(p.vec_id, j) FILTER (n1 <> p.label) AS id2 FROM tries t JOIN pool p USING (idx) GROUP BY id1, n1, k),
    places AS (SELECT row_number() OVER (ORDER BY idx) - 1 AS place, vec_id, label FROM pool WHERE label IS NOT NULL),
    later AS (SELECT h.id1, h.k, arg_min(q.vec_id, (q.place - ('0x' || substr(md5(h.id1 || ':rank:' || k || ':{PROBES}'), 1, 8))::BIGINT % z.n + z.n) % z.n) AS id2
        FROM (SELECT * FROM hit WHERE id2 IS NULL) h, (SELECT count(*) AS n FROM places) z, places q WHERE q.label <> h.n1 GROUP BY h.id1, h.k),
    negid AS (SELECT id1, k, id2 FROM hit WHERE id2 IS NOT NULL UNION ALL SELECT id1, k, id2 FROM later),
    neg AS (SELECT id1, a.label, round({_COS.format('a.v', 'b.v')}, 6) AS sim FROM negid JOIN e a ON a.vec_id = id1 JOIN e b ON b.vec_id = id2),
    rk AS (SELECT pos.id1, pos.label, 1 + count(*) FILTER (neg.sim >= pos.sim) AS rmin, 1 + count(*) FILTER (neg.sim > pos.sim) AS rmax FROM pos JOIN neg USING (id1) GROUP BY pos.id1, pos.label)"""
_LAB = "lab AS (SELECT label AS task, sim, 1 AS y FROM pos UNION ALL SELECT label, sim, 0 FROM neg)"
_AUC = """r AS (SELECT *, rank() OVER ({p} ORDER BY sim) + (count(*) OVER (PARTITION BY {q} sim) - 1) / 2.0 AS r FROM lab)
    SELECT {s} sum(y)::BIGINT AS positives, sum(1 - y)::BIGINT AS negatives, round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)), 6) AS auc FROM r {g}"""
_NB = f"WITH {_E}, n AS (SELECT a.vec_id AS a, b.vec_id AS b, a.v AS va, b.v AS vb FROM e a JOIN e b ON b.vec_id = a.vec_id + 1)"
_SQUARES = "list_sum(list_transform(list_zip({0}, {1}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_WORD = """CASE WHEN trim({0}) LIKE '0x%' THEN ('0x' || substr(lower(trim({0})), 3))::HUGEINT WHEN trim({0}) LIKE '-%' THEN trim({0})::HUGEINT + 18446744073709551616 WHEN trim({0}) <> '' THEN trim({0})::HUGEINT END::UBIGINT"""
SQL = {
    "mrr_recall_cosine": f"""WITH {_SCORED}, n AS (SELECT label, count(*) AS n FROM pos GROUP BY label)
        SELECT label, {", ".join(f"round(count(*) FILTER (rmin <= {k}) / max(n), 6) AS recall_at_{k}" for k in M.RECALL_AT)}, round(avg(CASE WHEN rmin <= 10 THEN 1.0 / rmin ELSE 0 END), 6) AS mrr_at_10
        FROM n JOIN rk USING (label) GROUP BY label""",
    "rank_min": f"WITH {_SCORED} SELECT id1 AS vec_id, rmin AS rank FROM rk",
    "rank_max": f"WITH {_SCORED} SELECT id1 AS vec_id, rmax AS rank FROM rk",
    "auc_exact": f"WITH {_SCORED}, {_LAB}, " + _AUC.format(p="", q="", s="", g=""),
    "auc_by_task": f"WITH {_SCORED}, {_LAB}, " + _AUC.format(p="PARTITION BY task", q="task,", s="task,", g="GROUP BY task"),
    "auc_binned": f"""WITH {_SCORED}, {_LAB}, ends AS (SELECT task, min(sim) AS lo, max(sim) AS hi FROM lab GROUP BY task), b AS (SELECT task, floor((sim - lo + 1e-8) / (hi - lo + 1e-8) * 199)::INT AS bin, sum(y) AS p, sum(1 - y) AS n FROM lab JOIN ends USING (task) GROUP BY ALL),
        c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY task ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM b) SELECT task, round(sum(p * (below + n / 2.0)) / (sum(p) * sum(n)), 6) AS auc FROM c GROUP BY task""",
    "pair_losses": f"""WITH {_SCORED}, {_LAB}, s AS (SELECT task, sim, 2 * y - 1 AS y FROM lab) SELECT task, round(avg(greatest(0, 1 - y * sim)), 6) AS margin, round(avg((y - sim) ** 2 / 4), 6) AS signs, round(avg((sim - y) ** 2), 6) AS squares,
        round(avg(ln(exp(sim) + exp(-sim)) - y * sim), 6) AS softmax FROM s GROUP BY task""",
    "best_task": f"WITH {_SCORED}, {_LAB}, a AS (" + _AUC.format(p="PARTITION BY task", q="task,", s="task,", g="GROUP BY task").replace("r AS (SELECT", "SELECT * FROM (WITH r AS (SELECT", 1) + ")) SELECT (task % 2)::INT AS \"group\", task, auc FROM a QUALIFY row_number() OVER (PARTITION BY task % 2 ORDER BY auc DESC, task) = 1",
    "cosine_pairs": f"{_NB} SELECT a, b, round({_COS.format('va', 'vb')}, 6) AS sim FROM n",
    "dot_pairs": f"{_NB} SELECT a, b, round(list_dot_product(va, vb), 6) AS sim FROM n",
    "euclid_sim": f"{_NB} SELECT a, b, round(-{_SQUARES.format('va', 'vb')}, 6) AS sim FROM n",
    "hamming_sign": f"{_NB} SELECT a, b, round(list_avg(list_transform(list_zip(va, vb), lambda z: CASE WHEN (z[1] > 0) = (z[2] > 0) THEN 1.0 ELSE 0.0 END)), 6) AS sim FROM n",
    "hamming_tanh": f"{_NB} SELECT a, b, round(list_avg(list_transform(list_zip(va, vb), lambda z: tanh(z[1]) * tanh(z[2]))), 6) AS sim FROM n",
    "pairwise_block": f"""WITH {_E}, q AS (SELECT vec_id AS query_id, v AS qv FROM e QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1)
        SELECT query_id, vec_id, round(list_dot_product(qv, v), 6) AS dot, round({_COS.format('qv', 'v')}, 6) AS cosine, round(-{_SQUARES.format('qv', 'v')}, 6) AS euclid FROM q, e""",
    "segment_aggregates": f"""WITH {_E}, x AS (SELECT label, unnest(range(len(v))) AS dim, unnest(v) AS x FROM e)
        SELECT label, dim, round(sum(x), 6) AS total, round(avg(x), 6) AS mean, round(sum(x) / sqrt(count(*)), 6) AS sqrt_n, round(max(x), 6) AS top FROM x GROUP BY label, dim""",
    "triplet_accuracy": f"WITH {_SCORED} SELECT round(avg((pos.sim > neg.sim)::INT), 6) AS accuracy, round(avg(greatest(0, 0.1 - pos.sim + neg.sim)), 6) AS loss FROM pos JOIN neg USING (id1)",
    "scores_normalised": f"{_NB}, s AS (SELECT a, list_dot_product(va, vb) AS dot FROM n) SELECT a, round((dot - min(dot) OVER () + 1e-8) / (max(dot) OVER () - min(dot) OVER () + 1e-8), 6) AS scaled FROM s",
    "hamming128": f"""WITH f AS (SELECT fss_id, {_WORD.format('hashes0')} AS h0, {_WORD.format('hashes1')} AS h1 FROM fss_hashes)
        SELECT a.fss_id, round(1 - (bit_count(xor(a.h0, b.h0)) + bit_count(xor(a.h1, b.h1))) / 128, 6) AS sim FROM f a JOIN f b ON b.fss_id = a.fss_id + 1""",
    "jaccard_sets": """WITH c AS (SELECT sig_id, list_transform(regexp_extract_all(catalog_hash_list, '[0-9]+'), lambda x: x::BIGINT) AS s FROM catalog_sigs)
        SELECT a.sig_id, round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))), 6) AS jaccard,
        CASE WHEN len(a.s) = len(b.s) THEN round(list_avg(list_transform(list_zip(a.s, b.s), lambda z: (z[1] = z[2])::INT)), 6) END AS places
        FROM c a JOIN c b ON b.sig_id = a.sig_id + 1 WHERE len(a.s) > 0 AND len(b.s) > 0""",
    "vuln_best_match": r"""WITH k AS (SELECT sig_id AS vuln_id, list_transform(regexp_extract_all(catalog_hash_list, '[0-9]+'), lambda x: x::BIGINT) AS k FROM vuln_sigs),
        kv AS (SELECT vuln_id, unnest(list_distinct(k)) AS x FROM k), c AS (SELECT sig_id, regexp_extract(string_split(replace(path, '\', '/'), '/')[-1], '^[A-Za-z]+[0-9]*') AS arch,
            list_distinct(list_transform(regexp_extract_all(catalog_hash_list, '[0-9]+'), lambda x: x::BIGINT)) AS s FROM catalog_sigs),
        cv AS (SELECT sig_id, unnest(s) AS x FROM c), n AS (SELECT vuln_id, sig_id, count(*) AS n FROM kv JOIN cv USING (x) GROUP BY ALL),
        m AS (SELECT vuln_id, sig_id, arch, round(n / (len(s) + len(list_distinct(k)) - n), 6) AS sim FROM n JOIN c USING (sig_id) JOIN k USING (vuln_id))
        SELECT vuln_id, arch, sig_id, sim FROM m WHERE sim > 0 QUALIFY row_number() OVER (PARTITION BY vuln_id, arch ORDER BY sim DESC, sig_id) = 1""",
    "vuln_rank": f"""WITH {_E}, o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM e),
        s AS (SELECT q.label AS query, t.vec_id, round({_COS.format('q.v', 't.v')}, 6) AS sim, t.label = q.label AND t.n = 2 AS hit FROM o q, o t WHERE q.n = 1 AND t.vec_id <> q.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, vec_id) AS rank FROM s) SELECT query, min(rank) AS rank FROM r WHERE hit GROUP BY query""",
    "function_digests": """WITH b AS (SELECT record_id, unnest(map_entries(basic_blocks)) AS e FROM acfg_disasm),
        h AS (SELECT record_id, string_agg(hex(from_base64(coalesce(e.value.b64_bytes, ''))), '' ORDER BY e.key) AS h FROM b GROUP BY record_id)
        SELECT a.record_id, coalesce(length(h) // 2, 0)::BIGINT AS n_bytes, md5(unhex(coalesce(h, ''))) AS md5 FROM acfg_disasm a LEFT JOIN h USING (record_id)""",
}
SQL["vuln_mrr"] = SQL["vuln_rank"].replace(" SELECT query, min(rank) AS rank FROM r WHERE hit GROUP BY query", """, f AS (SELECT query, min(rank) AS rank FROM r WHERE hit GROUP BY query)
        SELECT (query % 2)::INT AS firmware, string_agg(rank::VARCHAR, ';' ORDER BY query) AS ranks, round(avg(CASE WHEN rank <= 10 THEN 1.0 / rank ELSE 0 END), 6) AS mrr_at_10 FROM f GROUP BY 1""")
