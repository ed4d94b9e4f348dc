"""Queries p1_: functions, blocks, instructions and edges of acfg_raw and acfg_disasm as related flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.nested import flatten, function_edges, shred_functions
from ..session import table


def _raw(spark: SparkSession, d: str) -> DataFrame:
    return shred_functions(table(spark, d, "acfg_raw"), "raw_id", "payload")


def found(spark: SparkSession, d: str) -> DataFrame:
    return function_edges(table(spark, d, "acfg_raw"), "raw_id", "payload")


def raw_functions(spark: SparkSession, d: str) -> DataFrame:
    return flatten(_raw(spark, d), ["raw_id"], "functions").withColumnRenamed("pos_1", "func_pos")


def raw_blocks(spark: SparkSession, d: str) -> DataFrame:
    return flatten(_raw(spark, d), ["raw_id"], "functions.blocks").withColumnsRenamed({"pos_1": "func_pos", "pos_2": "block_pos"})


def raw_instructions(spark: SparkSession, d: str) -> DataFrame:
    return flatten(_raw(spark, d), ["raw_id"], "functions.blocks.instructions").withColumnsRenamed({"pos_1": "func_pos", "pos_2": "block_pos", "pos_3": "instr_pos"})


def disasm_functions(spark: SparkSession, d: str) -> DataFrame:
    sizes = [F.coalesce(F.greatest(F.size(c), F.lit(0)), F.lit(0)).cast("bigint").alias(n) for c, n in (("nodes", "n_nodes"), ("edges", "n_edges"), ("basic_blocks", "n_blocks"))]
    return table(spark, d, "acfg_disasm").select("record_id", "idb_path", "arch", "fva", "elapsed_time", *sizes)


def disasm_nodes(spark: SparkSession, d: str) -> DataFrame:
    return flatten(table(spark, d, "acfg_disasm"), ["record_id"], "nodes").select("record_id", F.col("pos_1").alias("node_pos"), F.col("value").alias("addr"))


def disasm_edges(spark: SparkSession, d: str) -> DataFrame:
    return flatten(table(spark, d, "acfg_disasm"), ["record_id"], "edges").withColumnRenamed("pos_1", "edge_pos")


def disasm_blocks(spark: SparkSession, d: str) -> DataFrame:
    b = flatten(table(spark, d, "acfg_disasm"), ["record_id"], "basic_blocks")
    return b.select("record_id", F.col("key").alias("addr"), F.col("value_bb_len").alias("bb_len"), F.col("value_b64_bytes").alias("b64_bytes"))


def disasm_instructions(spark: SparkSession, d: str) -> DataFrame:
    """The parallel lists of a block, side by side; a missing list counts as empty."""
    empty = F.array().cast("array<string>")
    parts = lambda b: F.arrays_zip(
        F.coalesce(b["bb_heads"], F.array().cast("array<bigint>")).alias("head"), *(F.coalesce(b[f"bb_{n}"], empty).alias(n) for n in ("mnems", "disasm", "norm"))
    )
    zipped = table(spark, d, "acfg_disasm").select("record_id", F.transform_values("basic_blocks", lambda _, b: parts(b)).alias("blocks"), F.map_keys("basic_blocks").alias("addr"))
    rows = flatten(zipped, ["record_id", "addr"], "blocks.value")
    return rows.select("record_id", F.get("addr", F.col("pos_1").cast("int")).alias("addr"), F.col("pos_2").alias("instr_pos"), F.col(rows.columns[4]).alias("head"), *(F.col(rows.columns[i]).alias(n) for i, n in ((5, "mnem"), (6, "disasm"), (7, "norm"))))


QUERIES = {
    "p1_found": found,
    "p1_raw_functions": raw_functions,
    "p1_raw_blocks": raw_blocks,
    "p1_raw_instructions": raw_instructions,
    "p1_disasm_functions": disasm_functions,
    "p1_disasm_nodes": disasm_nodes,
    "p1_disasm_edges": disasm_edges,
    "p1_disasm_blocks": disasm_blocks,
    "p1_disasm_instructions": disasm_instructions,
}

# Payloads by DuckDB's JSON functions, layout by layout: functions under a path, in a list, or under their addresses; chunks belong to their function.
_ADDRESS = r"""CASE WHEN regexp_full_match({0}, '0x[0-9a-f]+') THEN {0}::UBIGINT::HUGEINT WHEN regexp_full_match({0}, '-?[0-9]+') THEN {0}::HUGEINT WHEN regexp_full_match({0}, '[0-9a-f]+h?') THEN ('0x' || rtrim({0}, 'h'))::UBIGINT::HUGEINT END"""
_PAYLOADS = r"""j AS (SELECT raw_id, CASE WHEN json_valid(payload) THEN payload::JSON END AS p FROM acfg_raw),
    top AS (SELECT raw_id, p, e.key AS k, e.value AS v FROM j, json_each(j.p) e WHERE json_type(p) = 'OBJECT'),
    kind AS (SELECT raw_id, bool_or(k = 'functions') AS listed FROM top GROUP BY raw_id),
    fs AS (SELECT raw_id, k, v, listed FROM top JOIN kind USING (raw_id)),
    fn AS (SELECT raw_id, e.key AS fa, e.value AS body FROM fs, json_each(fs.v) e WHERE NOT listed AND json_type(v) = 'OBJECT' AND json_type(e.value) = 'OBJECT'
        UNION ALL SELECT raw_id, e.key, e.value FROM fs, json_each(fs.v) e WHERE listed AND k = 'functions' AND json_type(v) = 'OBJECT' AND json_type(e.value) = 'OBJECT'
        UNION ALL SELECT raw_id, e.value->>'$.fva', e.value FROM fs, json_each(fs.v) e WHERE listed AND k = 'functions' AND json_type(v) = 'ARRAY' AND json_type(e.value) = 'OBJECT'),
    nfn AS (SELECT row_number() OVER () AS f, raw_id, replace(lower(trim(fa)), '_', '') AS fa, body FROM fn WHERE fa IS NOT NULL),
    part AS (SELECT f, body FROM nfn UNION ALL SELECT f, e.value FROM part, json_each(part.body->'$.chunks') e WHERE json_type(e.value) = 'OBJECT'),
    nd AS (SELECT f, e.value AS n, CASE WHEN json_type(e.value) = 'OBJECT' THEN coalesce(e.value->>'$.addr', e.value->>'$.id') ELSE e.value->>'$' END AS a FROM part, json_each(part.body->'$.nodes') e WHERE json_type(part.body->'$.nodes') = 'ARRAY'),
    ed AS (SELECT f, a AS s, e.value->>'$' AS d FROM nd, json_each(nd.n->'$.succ') e WHERE json_type(n) = 'OBJECT'
        UNION ALL SELECT f, CASE json_type(e.value) WHEN 'ARRAY' THEN e.value->>0 ELSE e.value->>'$.src' END, CASE json_type(e.value) WHEN 'ARRAY' THEN e.value->>1 ELSE e.value->>'$.dst' END FROM part, json_each(part.body->'$.edges') e WHERE json_type(part.body->'$.edges') = 'ARRAY'
        UNION ALL SELECT f, e.key, g.value->>'$' FROM part, json_each(part.body->'$.edges') e, json_each(e.value) g WHERE json_type(part.body->'$.edges') = 'OBJECT'),
    t AS (SELECT f, replace(lower(trim(a)), '_', '') AS a FROM nd), u AS (SELECT f, replace(lower(trim(s)), '_', '') AS s, replace(lower(trim(d)), '_', '') AS d FROM ed),
    node AS (SELECT DISTINCT f, @a AS a FROM t), edge AS (SELECT DISTINCT f, @s AS s, @d AS d FROM u)""".replace("@a", _ADDRESS.format("a")).replace("@s", _ADDRESS.format("s")).replace("@d", _ADDRESS.format("d"))
_SIGNED = "CASE WHEN {0} >= 9223372036854775808 THEN {0} - 18446744073709551616 ELSE {0} END::BIGINT"

SQL = {
    "p1_found": f"""WITH RECURSIVE {_PAYLOADS} SELECT DISTINCT raw_id, {_SIGNED.format("x")} AS func_addr, {_SIGNED.format("s")} AS src, {_SIGNED.format("d")} AS dst
        FROM (SELECT f, raw_id, {_ADDRESS.format("fa")} AS x FROM nfn) JOIN edge USING (f) SEMI JOIN node a ON a.f = f AND a.a = s SEMI JOIN node b ON b.f = f AND b.a = d WHERE x IS NOT NULL""",
    "p1_disasm_functions": """
        SELECT record_id, idb_path, arch, fva, elapsed_time, coalesce(len(nodes), 0)::BIGINT AS n_nodes,
               coalesce(len(edges), 0)::BIGINT AS n_edges, coalesce(cardinality(basic_blocks), 0)::BIGINT AS n_blocks FROM acfg_disasm""",
    "p1_disasm_nodes": """
        SELECT record_id, (i - 1)::BIGINT AS node_pos, nodes[i] AS addr
        FROM (SELECT record_id, nodes, unnest(range(1, len(nodes) + 1)) AS i FROM acfg_disasm)""",
    "p1_disasm_edges": """
        SELECT record_id, (i - 1)::BIGINT AS edge_pos, edges[i].src AS src, edges[i].dst AS dst
        FROM (SELECT record_id, edges, unnest(range(1, len(edges) + 1)) AS i FROM acfg_disasm)""",
    "p1_disasm_blocks": """
        SELECT record_id, b.key AS addr, b.value.bb_len AS bb_len, b.value.b64_bytes AS b64_bytes
        FROM (SELECT record_id, unnest(map_entries(basic_blocks)) AS b FROM acfg_disasm)""",
    "p1_disasm_instructions": """
        WITH b AS (SELECT record_id, b.key AS addr, b.value.bb_heads AS h, b.value.bb_mnems AS m, b.value.bb_disasm AS d, b.value.bb_norm AS n
                   FROM (SELECT record_id, unnest(map_entries(basic_blocks)) AS b FROM acfg_disasm)),
             i AS (SELECT *, unnest(range(1, greatest(coalesce(len(h), 0), coalesce(len(m), 0), coalesce(len(d), 0), coalesce(len(n), 0)) + 1)) AS i FROM b)
        SELECT record_id, addr, (i - 1)::BIGINT AS instr_pos, h[i] AS head, m[i] AS mnem, d[i] AS disasm, n[i] AS norm FROM i""",
}
