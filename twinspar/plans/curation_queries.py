"""Queries of curation and pairs over flowchart."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import base64_text, hex_text
from ..functions.names import dataset_of, digest_of, hex_number, split_of
from ..functions.paths import VARIABLES, machine, renamed, side_file, trace_machine
from ..operators import curate as C
from ..operators import pairs as P
from ..session import cut, scratch, table
from ..sources import io


def functions(spark: SparkSession, d: str) -> DataFrame:
    """flowchart with its compilation variables."""
    return C.with_variables(table(spark, d, "flowchart"))


def named(spark: SparkSession, d: str) -> DataFrame:
    """The rows that pairs are made of: five blocks or more and a name."""
    f = functions(spark, d).where("bb_num >= 5 and func_name is not null")
    return f.select("func_id", "func_name", *VARIABLES)


def min_blocks(spark: SparkSession, d: str) -> DataFrame:
    return C.at_least_blocks(table(spark, d, "flowchart")).select("func_id", "bb_num")


def dedup(spark: SparkSession, d: str) -> DataFrame:
    return C.keep_first(table(spark, d, "flowchart").select("func_id", "hashopcodes"), ["hashopcodes"], ["func_id"])


def path_variables(spark: SparkSession, d: str) -> DataFrame:
    return functions(spark, d).select("func_id", *VARIABLES)


def split_rows(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    f = table(spark, d, "flowchart").withColumn("split", split_of(F.col("split_name"))).select("func_id", "func_name", "split")
    return {s: f.where(F.col("split") == s) for s in ("training", "validation", "testing")}


def disjoint_names(spark: SparkSession, d: str) -> DataFrame:
    a, b, c = C.without_shared_names(split_rows(spark, d)).values()
    return a.unionByName(b).unionByName(c).select("func_id", "split")


def shared(spark: SparkSession, d: str) -> DataFrame:
    s = split_rows(spark, d)
    return C.shared_names(s["training"], s["testing"])


def singletons(spark: SparkSession, d: str) -> DataFrame:
    return C.without_singletons(functions(spark, d), ["library", "func_name"]).select("func_id", "library", "func_name")


def composition(spark: SparkSession, d: str) -> DataFrame:
    sets = [("library",), ("arch",), ("arch", "bit"), ("compiler",), ("compiler", "version"), ("compiler", "optimizations")]
    return C.composition(functions(spark, d), sets)


def positives(task: str, spark: SparkSession, d: str) -> DataFrame:
    return P.positives(named(spark, d), task)


def pool(spark: SparkSession, d: str) -> DataFrame:
    return C.numbered(named(spark, d), ["func_id"])


def negatives(spark: SparkSession, d: str) -> DataFrame:
    rows = cut(pool(spark, d))
    return P.negatives(rows, rows, "XM")


def quota(spark: SparkSession, d: str) -> DataFrame:
    f = cut(named(spark, d))
    both = P.positives(f, "XA").unionByName(P.positives(f, "XC"))
    return P.sample_by(both, "db_type", {"XA": 50, "XC": 50}, 7, ["func_id_1", "func_id_2"])


def triplets(spark: SparkSession, d: str) -> DataFrame:
    rows = cut(pool(spark, d))
    return P.triplets(P.positives(rows, "XA"), P.negatives(rows, rows, "XM"))


def combos(spark: SparkSession, d: str) -> DataFrame:
    f = cut(named(spark, d))
    return P.combinations(P.described(P.positives(f, "XA"), f, list(P.FREE)))


def described(spark: SparkSession, d: str) -> DataFrame:
    f = cut(named(spark, d))
    return P.described(P.positives(f, "XC"), f, ["func_name", "library"])


def used(spark: SparkSession, d: str) -> DataFrame:
    f = cut(named(spark, d))
    return P.used(P.positives(f, "XA"), f).select("func_id", "func_name")


def referential(spark: SparkSession, d: str) -> DataFrame:
    """Functions of acfg_disasm that flowchart does not have, and of fss_hashes."""
    f = table(spark, d, "flowchart")
    one = lambda name, path, at: C.missing(table(spark, d, name).select(F.col(path).alias("idb_path"), F.col(at).alias("fva")), f, ["idb_path", "fva"]).withColumn("source", F.lit(name))
    return one("acfg_disasm", "idb_path", "fva").unionByName(one("fss_hashes", "path", "address"))


def null_audit(spark: SparkSession, d: str) -> DataFrame:
    return C.null_audit(table(spark, d, "flowchart"))


def repeated(spark: SparkSession, d: str) -> DataFrame:
    return C.duplicates(table(spark, d, "flowchart"), ["idb_path", "fva"])


def latest(spark: SparkSession, d: str) -> DataFrame:
    """Of functions delivered again the latest row."""
    f = table(spark, d, "flowchart").select("idb_path", "fva", "func_id", "loaded_at")
    return f.groupBy("idb_path", "fva").agg(F.max_by("func_id", F.struct("loaded_at", "func_id")).alias("func_id"))


def only_validated(spark: SparkSession, d: str) -> DataFrame:
    """Rows of flowchart without a signature in catalog_sigs."""
    c = table(spark, d, "catalog_sigs").select(F.col("path").alias("idb_path"), F.col("address").alias("fva"))
    return C.without_keys(table(spark, d, "flowchart").select("func_id", "idb_path", "fva"), ["idb_path", "fva"], c).select("func_id")


def golden(spark: SparkSession, d: str) -> DataFrame:
    """Rows of acfg_disasm against flowchart: which are missing, or differ in the machine's family."""
    f = functions(spark, d).groupBy("idb_path", "fva").agg(F.min("arch").alias("family"))
    a = table(spark, d, "acfg_disasm").groupBy("idb_path", "fva").agg(F.min(F.regexp_extract("arch", "^[a-z]+", 0)).alias("family"))
    return C.golden_diff(a, f, ["idb_path", "fva"], ["family"]).select("idb_path", "fva", F.array_join("differs", ",").alias("differs"))


def outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Runs of the events table by user: purchases are done, errors are errors, logouts are timeouts."""
    e = table(spark, d, "events")
    what = F.when(F.col("event_type") == "purchase", "ok").when(F.col("event_type") == "error", "error").when(F.col("event_type") == "logout", "timeout")
    return C.outcome_counts(e, ["user_id"], what, F.round("value", 6)).withColumn("elapsed", F.round("elapsed", 3))


def row_numbers(spark: SparkSession, d: str) -> DataFrame:
    return C.numbered(table(spark, d, "flowchart").select("func_id", "bb_num"), ["func_id"])


def aligned(spark: SparkSession, d: str) -> DataFrame:
    """Positive pairs of XA in the quota of a ranking, each with a negative for the same left end."""
    rows = cut(pool(spark, d))
    return P.aligned_sample(P.positives(rows, "XA"), rows, "XA", P.QUOTAS["ranking"], 7)


def interleaved(spark: SparkSession, d: str) -> DataFrame:
    return P.interleaved(aligned(spark, d), ["func_id_1", "func_id_2"])


def epoch(spark: SparkSession, d: str) -> DataFrame:
    """The training triples of an epoch of 4 000."""
    return P.epoch(named(spark, d), 4000, 11)


def vulnerability_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The search of a few known functions in whole binaries: names are those of runtime_names, a target is an origin ('?' for null) with the binary of Dataset-Vulnerability that has the most rows of
    its names, the sources are the four binaries of Dataset-1 with the most rows of such names; ties by path. Every row of these binaries takes part."""
    f = table(spark, d, "flowchart").select("func_id", "idb_path", "fva", "func_name", digest_of(F.col("hashopcodes")).alias("digest"), dataset_of(F.col("idb_path")).alias("dataset"))
    wanted = table(spark, d, "runtime_names").select(F.coalesce("origin", F.lit("?")).alias("target"), "func_name")
    held = cut(f.join(F.broadcast(wanted), "func_name").groupBy("dataset", "target", "idb_path").agg(F.count("*").alias("n")))
    sources = held.where("dataset = 'Dataset-1'").groupBy("idb_path").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "idb_path").limit(4)
    best = F.min_by("idb_path", F.struct(-F.col("n"), F.col("idb_path")))
    targets = held.where("dataset = 'Dataset-Vulnerability'").groupBy("target").agg(best.alias("idb_path"))
    return P.search_pairs(f, wanted, sources, targets, ["func_id", "idb_path", "fva", "digest"])


def vuln_pairs(spark: SparkSession, d: str) -> DataFrame:
    return vulnerability_pairs(spark, d).select("func_id_1", "func_id_2", "db_type")


def vuln_equal_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of that search whose digests are equal."""
    return P.equal_ends(vulnerability_pairs(spark, d), "digest").select("func_id_1", "func_id_2", "digest_1")


def _hash_scores(spark: SparkSession, d: str, pairs: DataFrame) -> DataFrame:
    """Scores of pairs by their similarity hashes, as a result table that lacks the functions without a hash."""
    h = table(spark, d, "fss_hashes").select(F.col("path").alias("idb_path"), F.col("address").alias("fva"), "num_nodes")
    one = h.groupBy("idb_path", "fva").agg(F.max("num_nodes").alias("n"))
    side = lambda i: one.select(F.col("idb_path").alias(f"idb_path_{i}"), F.col("fva").alias(f"fva_{i}"), F.col("n").alias(f"n_{i}"))
    keys = [f"{c}_{i}" for i in (1, 2) for c in ("idb_path", "fva")]
    both = pairs.select(*keys).join(side(1), ["idb_path_1", "fva_1"]).join(side(2), ["idb_path_2", "fva_2"])
    return both.select(*keys, F.round(F.least("n_1", "n_2") / F.greatest("n_1", "n_2"), 6).alias("sim"))


def results_joined(spark: SparkSession, d: str) -> DataFrame:
    """Positive pairs of XA with the score of their result, where there is one: here the ratio of the numbers of nodes in fss_hashes."""
    f = cut(functions(spark, d).where("bb_num >= 5 and func_name is not null").select("func_id", "func_name", "idb_path", "fva", *VARIABLES))
    pairs = cut(P.described(P.positives(f, "XA"), f, ["idb_path", "fva"]))
    return P.with_results(pairs, _hash_scores(spark, d, pairs)).select("func_id_1", "func_id_2", "sim")


def vuln_results_joined(spark: SparkSession, d: str) -> DataFrame:
    """The pairs of the search with the score of their result, where there is one."""
    pairs = cut(vulnerability_pairs(spark, d))
    return P.with_results(pairs, _hash_scores(spark, d, pairs)).select("func_id_1", "func_id_2", "sim")


def selection(spark: SparkSession, d: str) -> DataFrame:
    """How many functions are selected in how many binaries."""
    return io.selection_total(table(spark, d, "acfg_disasm").select("idb_path", F.col("fva").alias("address")).distinct())


def previews(spark: SparkSession, d: str) -> DataFrame:
    return C.ends(table(spark, d, "flowchart").select("func_id", "func_name"), ["func_id"])


def path_helpers(spark: SparkSession, d: str) -> DataFrame:
    """Names that go with a binary: its side file, its machine as pairs and traces call it, its path under other folder names."""
    a = table(spark, d, "acfg_disasm")
    family, bits = F.split_part("arch", F.lit("-"), F.lit(1)), F.split_part("arch", F.lit("-"), F.lit(2)).try_cast("int")
    return a.select("record_id", side_file(F.col("idb_path"), "_acfg.pkl", "out").alias("side"), machine(family, bits).alias("machine"), F.when(F.col("arch").isNotNull(), trace_machine(F.col("arch"))).alias("trace"),
                    renamed(F.col("idb_path"), [("IDBs/", "DBs/"), ("Dataset-", "D")]).alias("short"), F.endswith(F.col("idb_path"), F.lit(".i64")).alias("is_i64"))


def selection_round(spark: SparkSession, d: str) -> DataFrame:
    """The selected functions of each binary, written as JSON texts {binary: [addresses]} and read back."""
    a = table(spark, d, "acfg_disasm").select("idb_path", hex_number(F.col("fva")).alias("address")).where("address is not null and idb_path is not null")
    where = scratch(spark, "selection")
    io.selection_json(a).write.text(where)
    return io.read_selection(spark, where, lines=True)


def words_round(spark: SparkSession, d: str) -> DataFrame:
    """The mnemonics of opcodes_dict, written one per line and read back."""
    where = scratch(spark, "words")
    io.write_words(table(spark, d, "opcodes_dict").where("trim(mnem) <> ''"), where, "mnem")
    return io.read_words(spark, where)


def same_keys(spark: SparkSession, d: str) -> DataFrame:
    """Functions that only one of acfg_disasm and fss_hashes has."""
    h = table(spark, d, "fss_hashes").select(F.col("path").alias("idb_path"), F.col("address").alias("fva"))
    return C.same_keys(table(spark, d, "acfg_disasm").select("idb_path", "fva"), h, ["idb_path", "fva"])


def block_bytes(spark: SparkSession, d: str) -> DataFrame:
    """The bytes of each block in hexadecimal, and encoded again."""
    b = table(spark, d, "acfg_disasm").select("record_id", F.explode("basic_blocks").alias("block", "b")).select("record_id", "block", F.unbase64("b.b64_bytes").alias("data"))
    return b.where("data is not null").select("record_id", "block", F.lower(F.hex("data")).alias("hex"), base64_text(F.col("data")).alias("b64"))


def addresses(spark: SparkSession, d: str) -> DataFrame:
    """Addresses as numbers and in their usual spelling."""
    n = hex_number(F.col("fva"))
    return table(spark, d, "flowchart").select("func_id", n.alias("number"), hex_text(n).alias("text"))


_TASKS = {t: "pairs_pos_" + t.lower().replace("+", "_") for t in ("arch", "bit", "comp", "ver", "opt", "XA", "XA+XO", "XC", "XC+XB", "XM")}
QUERIES = {
    "curate_min_blocks": min_blocks,
    "dedup_keep_first": dedup,
    "path_variables": path_variables,
    "split_disjoint_names": disjoint_names,
    "split_shared_names": shared,
    "drop_singletons": singletons,
    "composition_counts": composition,
    **{name: partial(positives, t) for t, name in _TASKS.items()},
    "pairs_neg_hash": negatives,
    "pairs_quota_sample": quota,
    "pairs_triplets": triplets,
    "free_var_combos": combos,
    "pairs_described": described,
    "used_functions": used,
    "referential_check": referential,
    "null_audit": null_audit,
    "duplicate_keys": repeated,
    "latest_delivery": latest,
    "anti_selected": only_validated,
    "golden_diff": golden,
    "outcome_stats": outcomes,
    "row_numbers": row_numbers,
    "pairs_aligned_sample": aligned,
    "pairs_interleaved": interleaved,
    "pairs_epoch": epoch,
    "vuln_pairs": vuln_pairs,
    "vuln_equal_hashes": vuln_equal_hashes,
    "results_joined": results_joined,
    "vuln_results_joined": vuln_results_joined,
    "selection_total": selection,
    "previews": previews,
    "path_helpers": path_helpers,
    "selection_round_trip": selection_round,
    "words_round_trip": words_round,
    "same_keys": same_keys,
    "block_bytes": block_bytes,
    "address_forms": addresses,
}

_FV = r"""
    cp AS (SELECT *, regexp_replace(replace(regexp_replace(idb_path, '^\s+|\s+$', '', 'g'), '\', '/'), '/+', '/', 'g') AS cp FROM flowchart),
    nm AS (SELECT *, string_split(cp, '/')[-1] AS nm, string_split(cp, '/')[-2] AS dir, regexp_matches(lower(cp), '(^|/)dataset-2/') AS flat FROM cp),
    w AS (SELECT *, string_split(nm, '_')[1] AS w1, string_split(nm, '_')[2] AS w2 FROM nm),
    fv AS (SELECT w.* EXCLUDE (cp, nm, dir, flat, w1, w2),
        CASE WHEN flat THEN string_split(w2, '-')[1] ELSE dir END AS project,
        CASE WHEN flat THEN array_to_string(string_split(w2, '-')[:-2], '-') ELSE regexp_replace(w2, '\.(i64|idb)$', '') END AS library,
        CASE WHEN flat THEN string_split(w1, '-')[1] ELSE regexp_replace(string_split(w1, '-')[1], '32|64|86', '', 'g') END AS arch,
        CASE WHEN flat THEN string_split(w1, '-')[2] WHEN contains(replace(string_split(w1, '-')[1], '86', '32'), '32') THEN '32' ELSE '64' END AS bit,
        CASE WHEN flat THEN 'gcc' ELSE string_split(w1, '-')[2] END AS compiler,
        CASE WHEN flat THEN '7.5' WHEN string_split(w1, '-')[2] = 'gcc' THEN 'gcc_' || string_split(w1, '-')[3] ELSE string_split(w1, '-')[3] END AS version,
        CASE WHEN flat THEN string_split(w2, '-')[-1] ELSE string_split(w1, '-')[4] END AS optimizations FROM w),
    named AS (SELECT func_id, func_name, project, library, arch, bit, compiler, version, optimizations FROM fv WHERE bb_num >= 5 AND func_name IS NOT NULL)"""
_SPLIT = r"""sp AS (SELECT func_id, func_name, CASE lower(regexp_replace(split_name, '^\s+|\s+$', '', 'g')) WHEN 'train' THEN 'training' WHEN 'training' THEN 'training'
        WHEN 'val' THEN 'validation' WHEN 'valid' THEN 'validation' WHEN 'validation' THEN 'validation' WHEN 'dev' THEN 'validation' WHEN 'test' THEN 'testing' WHEN 'testing' THEN 'testing' END AS split FROM flowchart)"""


def _positives_sql(task: str) -> str:
    rule = " AND ".join(f"a.{c} {'=' if same else '<>'} b.{c}" for c, same in zip(P.FREE, P.TASKS[task], strict=True) if same is not None)
    return f"""SELECT a.func_id AS func_id_1, b.func_id AS func_id_2, '{task}' AS db_type FROM named a JOIN named b
        ON a.project = b.project AND a.library = b.library AND a.func_name = b.func_name AND a.func_id < b.func_id {'AND ' + rule if rule else ''}"""


_NEG = """pool AS (SELECT row_number() OVER (ORDER BY func_id) - 1 AS idx, func_id, func_name FROM named),
    tries AS (SELECT l.func_id AS func_id_1, l.func_name AS n1, j, ('0x' || substr(md5(l.func_id || ':XM:0:' || j), 1, 8))::BIGINT % (SELECT count(*) FROM pool) AS idx
              FROM pool l, range(16) r(j)),
    neg AS (SELECT func_id_1, 0::BIGINT AS k, arg_min(p.func_id, j) AS func_id_2, 'XM' AS db_type FROM tries t JOIN pool p USING (idx) WHERE n1 <> p.func_name GROUP BY func_id_1)"""

_DRAWS = r"('0x' || substr(md5({0}), 1, 8))::BIGINT % ({1})"
_ALIGNED = f"""pool AS (SELECT row_number() OVER (ORDER BY func_id) - 1 AS idx, func_id, func_name FROM named), pos AS ({_positives_sql('XA')}),
    kept AS (SELECT func_id_1, func_id_2, row_number() OVER (PARTITION BY func_id_1 ORDER BY func_id_2) - 1 AS k FROM pos),
    top AS (SELECT * FROM kept QUALIFY row_number() OVER (ORDER BY md5('7:' || func_id_1 || ':' || func_id_2), func_id_1, func_id_2) <= {P.QUOTAS['ranking']}),
    tries AS (SELECT t.*, func_name AS n1, j, {_DRAWS.format("t.func_id_1 || ':XA:' || k || ':' || j", "SELECT count(*) FROM pool")} AS idx FROM top t JOIN pool ON func_id = func_id_1, range(16) r(j)),
    drawn AS (SELECT func_id_1, k, arg_min(p.func_id, j) AS func_id_neg FROM tries t JOIN pool p USING (idx) WHERE n1 <> p.func_name GROUP BY func_id_1, k),
    aligned AS (SELECT func_id_1, func_id_2, func_id_neg, 'XA' AS db_type FROM top LEFT JOIN drawn USING (func_id_1, k))"""
_VULN = r"""fl AS (SELECT func_id, idb_path, fva, func_name, regexp_replace(lower(regexp_replace(hashopcodes, '^\s+|\s+$', '', 'g')), '^(sha-?256:|0x)', '') AS h, lower(regexp_extract(regexp_replace(replace(idb_path, '\', '/'), '/+', '/', 'g'), '(?i)(^|/)dataset-(1|2|vulnerability)(/|$)', 2)) AS ds FROM flowchart),
    fd AS (SELECT *, CASE WHEN regexp_full_match(h, '[0-9a-f]{64}') THEN h END AS digest FROM fl), wanted AS (SELECT DISTINCT coalesce(origin, '?') AS target, func_name FROM runtime_names),
    held AS (SELECT ds, target, idb_path, count(*) AS n FROM fd JOIN wanted USING (func_name) GROUP BY ALL), src AS (SELECT idb_path FROM held WHERE ds = '1' GROUP BY idb_path ORDER BY sum(n) DESC, idb_path LIMIT 4),
    l AS (SELECT target, func_id, digest, idb_path, fva FROM fd JOIN wanted USING (func_name) WHERE idb_path IN (SELECT idb_path FROM src)),
    tg AS (SELECT target, idb_path FROM held WHERE ds = 'vulnerability' QUALIFY row_number() OVER (PARTITION BY target ORDER BY n DESC, idb_path) = 1), r AS (SELECT target, func_id, digest, f.idb_path, fva FROM fd f JOIN tg ON tg.idb_path = f.idb_path),
    vp AS (SELECT l.func_id AS func_id_1, r.func_id AS func_id_2, l.digest AS digest_1, r.digest AS digest_2, l.idb_path AS p1, l.fva AS a1, r.idb_path AS p2, r.fva AS a2 FROM l JOIN r USING (target))"""
_SCORES = "one AS (SELECT path, address, max(num_nodes) AS n FROM fss_hashes GROUP BY ALL)"

SQL = {
    "pairs_aligned_sample": f"WITH {_FV}, {_ALIGNED} SELECT * FROM aligned",
    "pairs_interleaved": f"""WITH {_FV}, {_ALIGNED}, n AS (SELECT *, row_number() OVER (ORDER BY func_id_1, func_id_2) - 1 AS x FROM aligned)
        SELECT 2 * x AS idx, func_id_1, func_id_2, 1::INT AS label, db_type FROM n UNION ALL SELECT 2 * x + 1, func_id_1, func_id_neg, -1, db_type FROM n""",
    "pairs_epoch": f"""WITH {_FV}, rw AS (SELECT func_name, func_id, row_number() OVER (PARTITION BY func_name ORDER BY func_id) - 1 AS at FROM named), nam AS (SELECT func_name, count(*) AS n, row_number() OVER (ORDER BY func_name) - 1 AS number FROM rw GROUP BY func_name),
        tw AS (SELECT func_name, n, number AS own, row_number() OVER (ORDER BY func_name) - 1 AS number FROM nam WHERE n >= 2),
        i AS (SELECT i, '11:0:' || i || ':' AS s FROM range(4000) r(i)), f AS (SELECT i.*, tw.func_name, tw.n, tw.own FROM i JOIN tw ON tw.number = {_DRAWS.format("s || 'name'", "SELECT count(*) FROM tw")}),
        g AS (SELECT *, {_DRAWS.format("s || 'first'", "n")} AS a, {_DRAWS.format("s || 'other'", "(SELECT count(*) FROM nam) - 1")} AS o FROM f),
        h AS (SELECT *, (a + 1 + {_DRAWS.format("s || 'second'", "n - 1")}) % n AS b, o + (o >= own)::INT AS q FROM g), k AS (SELECT h.*, nam.func_name AS other, {_DRAWS.format("s || 'third'", "nam.n")} AS c FROM h JOIN nam ON nam.number = q)
        SELECT i, x.func_id AS func_id_1, y.func_id AS func_id_2, z.func_id AS func_id_neg FROM k JOIN rw x ON x.func_name = k.func_name AND x.at = a JOIN rw y ON y.func_name = k.func_name AND y.at = b JOIN rw z ON z.func_name = other AND z.at = c""",
    "vuln_pairs": f"WITH {_VULN} SELECT func_id_1, func_id_2, 'XM' AS db_type FROM vp",
    "vuln_equal_hashes": f"WITH {_VULN} SELECT func_id_1, func_id_2, digest_1 FROM vp WHERE digest_1 = digest_2",
    "results_joined": f"""WITH {_FV}, pos AS ({_positives_sql('XA')}), {_SCORES} SELECT func_id_1, func_id_2, round(CASE WHEN x.n < y.n THEN x.n / y.n ELSE y.n / x.n END, 6) AS sim FROM pos JOIN flowchart a ON a.func_id = func_id_1 JOIN flowchart b ON b.func_id = func_id_2
        LEFT JOIN one x ON x.path = a.idb_path AND x.address = a.fva LEFT JOIN one y ON y.path = b.idb_path AND y.address = b.fva""",
    "vuln_results_joined": f"WITH {_VULN}, {_SCORES} SELECT func_id_1, func_id_2, round(CASE WHEN x.n < y.n THEN x.n / y.n ELSE y.n / x.n END, 6) AS sim FROM vp LEFT JOIN one x ON x.path = p1 AND x.address = a1 LEFT JOIN one y ON y.path = p2 AND y.address = a2",
    "selection_total": "SELECT count(DISTINCT idb_path) AS binaries, count(*) AS functions FROM (SELECT DISTINCT idb_path, fva FROM acfg_disasm)",
    "selection_round_trip": "SELECT DISTINCT idb_path, ('0x' || regexp_replace(lower(trim(fva)), '^0x', ''))::BIGINT AS address FROM acfg_disasm WHERE idb_path IS NOT NULL AND fva IS NOT NULL",
    "words_round_trip": "SELECT trim(mnem) AS word FROM opcodes_dict WHERE trim(mnem) <> ''",
    "same_keys": """WITH a AS (SELECT DISTINCT idb_path, fva FROM acfg_disasm), b AS (SELECT DISTINCT path AS idb_path, address AS fva FROM fss_hashes)
        SELECT a.*, 'left' AS only_in FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.idb_path = a.idb_path AND b.fva = a.fva) UNION ALL SELECT b.*, 'right' FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE b.idb_path = a.idb_path AND b.fva = a.fva)""",
    "block_bytes": """SELECT record_id, e.key AS block, lower(hex(from_base64(e.value.b64_bytes))) AS hex, to_base64(from_base64(e.value.b64_bytes)) AS b64
        FROM (SELECT record_id, unnest(map_entries(basic_blocks)) AS e FROM acfg_disasm) WHERE e.value.b64_bytes IS NOT NULL""",
    "address_forms": "SELECT func_id, n AS number, '0x' || lower(printf('%x', n)) AS text FROM (SELECT func_id, ('0x' || regexp_replace(lower(trim(fva)), '^0x', ''))::BIGINT AS n FROM flowchart)",
    "previews": 'SELECT func_id, func_name, CASE WHEN x <= 5 THEN \'head\' ELSE \'tail\' END AS "end" FROM (SELECT func_id, func_name, row_number() OVER (ORDER BY func_id) AS x, row_number() OVER (ORDER BY func_id DESC) AS y FROM flowchart) WHERE x <= 5 OR y <= 5',
    "path_helpers": r"""SELECT record_id, 'out/' || regexp_replace(string_split(replace(trim(idb_path), '\', '/'), '/')[-1], '\.(i64|idb)$', '') || '_acfg.pkl' AS side, lower(arch) AS machine,
        CASE WHEN arch = 'x86-64' THEN 'x64' ELSE string_split(arch, '-')[1] END AS trace, replace(replace(idb_path, 'IDBs/', 'DBs/'), 'Dataset-', 'D') AS short, idb_path LIKE '%.i64' AS is_i64 FROM acfg_disasm""",
    "curate_min_blocks": "SELECT func_id, bb_num FROM flowchart WHERE bb_num >= 5",
    "dedup_keep_first": "SELECT min(func_id) AS func_id, hashopcodes FROM flowchart GROUP BY hashopcodes",
    "path_variables": f"WITH {_FV} SELECT func_id, project, library, arch, bit, compiler, version, optimizations FROM fv",
    "split_disjoint_names": f"""WITH {_SPLIT} SELECT func_id, split FROM sp s WHERE split = 'validation'
        OR split = 'training' AND NOT EXISTS (SELECT 1 FROM sp o WHERE o.func_name = s.func_name AND o.split IN ('testing', 'validation'))
        OR split = 'testing' AND NOT EXISTS (SELECT 1 FROM sp o WHERE o.func_name = s.func_name AND o.split = 'validation')""",
    "split_shared_names": f"WITH {_SPLIT} SELECT func_name FROM sp WHERE split = 'training' INTERSECT SELECT func_name FROM sp WHERE split = 'testing'",
    "drop_singletons": f"""WITH {_FV} SELECT func_id, library, func_name FROM fv WHERE func_name IS NOT NULL AND library IS NOT NULL
        QUALIFY count(*) OVER (PARTITION BY library, func_name) >= 2""",
    "composition_counts": f"""WITH {_FV} SELECT CASE grouping_id(library, arch, bit, compiler, version, optimizations) WHEN 31 THEN 'library' WHEN 47 THEN 'arch' WHEN 39 THEN 'arch/bit'
        WHEN 59 THEN 'compiler' WHEN 57 THEN 'compiler/version' ELSE 'compiler/optimizations' END AS level,
        CASE grouping_id(library, arch, bit, compiler, version, optimizations) WHEN 31 THEN coalesce(library, '?') WHEN 47 THEN coalesce(arch, '?') WHEN 39 THEN coalesce(arch, '?') || '/' || coalesce(bit, '?')
        WHEN 59 THEN coalesce(compiler, '?') WHEN 57 THEN coalesce(compiler, '?') || '/' || coalesce(version, '?') ELSE coalesce(compiler, '?') || '/' || coalesce(optimizations, '?') END AS value,
        count(*) AS functions FROM fv GROUP BY GROUPING SETS ((library), (arch), (arch, bit), (compiler), (compiler, version), (compiler, optimizations))""",
    **{name: f"WITH {_FV} {_positives_sql(t)}" for t, name in _TASKS.items()},
    "pairs_neg_hash": f"WITH {_FV}, {_NEG} SELECT * FROM neg",
    "pairs_quota_sample": f"""WITH {_FV}, p AS ({_positives_sql('XA')} UNION ALL {_positives_sql('XC')})
        SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY db_type ORDER BY md5('7:' || func_id_1 || ':' || func_id_2), func_id_1, func_id_2) <= 50""",
    "pairs_triplets": f"""WITH {_FV}, {_NEG}, pos AS ({_positives_sql('XA')})
        SELECT pos.func_id_1 AS anchor, pos.func_id_2 AS positive, neg.func_id_2 AS negative FROM pos JOIN neg USING (func_id_1)""",
    "free_var_combos": f"""WITH {_FV}, pos AS ({_positives_sql('XA')}), v AS ({" UNION ALL ".join(f"SELECT '{c}' AS variable, least(a.{c}, b.{c}) AS low, greatest(a.{c}, b.{c}) AS high FROM pos JOIN named a ON a.func_id = func_id_1 JOIN named b ON b.func_id = func_id_2" for c in P.FREE)})
        SELECT variable, low, high, count(*) AS pairs FROM v GROUP BY ALL""",
    "pairs_described": f"""WITH {_FV}, pos AS ({_positives_sql('XC')}) SELECT pos.*, a.func_name AS func_name_1, a.library AS library_1, b.func_name AS func_name_2, b.library AS library_2
        FROM pos LEFT JOIN named a ON a.func_id = func_id_1 LEFT JOIN named b ON b.func_id = func_id_2""",
    "used_functions": f"WITH {_FV}, pos AS ({_positives_sql('XA')}) SELECT func_id, func_name FROM named WHERE func_id IN (SELECT func_id_1 FROM pos UNION SELECT func_id_2 FROM pos)",
    "referential_check": """SELECT DISTINCT idb_path, fva, 'acfg_disasm' AS source FROM acfg_disasm a WHERE NOT EXISTS (SELECT 1 FROM flowchart f WHERE f.idb_path = a.idb_path AND f.fva = a.fva)
        UNION ALL SELECT DISTINCT path, address, 'fss_hashes' FROM fss_hashes a WHERE NOT EXISTS (SELECT 1 FROM flowchart f WHERE f.idb_path = a.path AND f.fva = a.address)""",
    "null_audit": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS nulls FROM flowchart"
        for c in ("func_id", "idb_path", "fva", "func_name", "start_ea", "end_ea", "bb_num", "bb_list", "hashopcodes", "split_name", "exported_at", "loaded_at")
    ),
    "duplicate_keys": "SELECT idb_path, fva, count(*) AS n FROM flowchart GROUP BY ALL HAVING count(*) > 1",
    "latest_delivery": "SELECT idb_path, fva, func_id FROM flowchart QUALIFY row_number() OVER (PARTITION BY idb_path, fva ORDER BY loaded_at DESC NULLS LAST, func_id DESC) = 1",
    "anti_selected": "SELECT func_id FROM flowchart f WHERE NOT EXISTS (SELECT 1 FROM catalog_sigs c WHERE c.path = f.idb_path AND c.address = f.fva)",
    "golden_diff": f"""WITH {_FV}, f AS (SELECT idb_path, fva, min(arch) AS family FROM fv GROUP BY ALL), a AS (SELECT idb_path, fva, min(regexp_extract(arch, '^[a-z]+')) AS family FROM acfg_disasm GROUP BY ALL)
        SELECT idb_path, fva, CASE WHEN f.idb_path IS NULL THEN '<missing>' ELSE 'family' END AS differs FROM a LEFT JOIN f USING (idb_path, fva) WHERE f.idb_path IS NULL OR a.family IS DISTINCT FROM f.family""",
    "outcome_stats": """SELECT user_id, count(*) AS rows, count(*) FILTER (event_type = 'purchase') AS ok, count(*) FILTER (event_type = 'error') AS error,
        count(*) FILTER (event_type = 'logout') AS timeout, round(sum(round(value, 6)), 3) AS elapsed FROM events GROUP BY user_id""",
    "row_numbers": "SELECT func_id, bb_num, row_number() OVER (ORDER BY func_id) - 1 AS idx FROM flowchart",
}
