"""Queries p4_: mnemonics of the functions in acfg_disasm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .termfreq import dense, function_terms, marked, term_counts

RARE_BELOW = 3
COMMON_ABOVE = 0.5


def functions(spark: SparkSession, d: str) -> DataFrame:
    """id, terms: of each (idb_path, fva) the row with the latest loaded_at, on a tie the greatest record_id; written once, ids are dense.

    A row's terms are counted before the shuffle that finds the latest row, so blocks are not moved.
    """
    a = table(spark, d, "acfg_disasm")
    words = F.transform_values("basic_blocks", lambda _, b: b["bb_mnems"])
    rows = function_terms(a.select("record_id", "idb_path", "fva", "loaded_at", "nodes", words.alias("words")), ["record_id", "idb_path", "fva", "loaded_at"], "nodes", "words")
    latest = F.struct(F.col("loaded_at").isNotNull(), "loaded_at", "record_id")
    one = rows.groupBy("idb_path", "fva").agg(F.max_by(F.struct("record_id", "terms"), latest).alias("r"))
    return dense(one.select(F.col("r.terms").alias("terms")))


def terms(spark: SparkSession, d: str) -> DataFrame:
    """Every term with its occurrences, its functions, its rank in opcodes_dict if it has one, and its mark."""
    rows = functions(spark, d)
    everything = rows.agg(F.count("*").alias("all_functions"))
    known = table(spark, d, "opcodes_dict").select(F.lower(F.trim("mnem")).alias("term"), "opc_rank").groupBy("term").agg(F.min("opc_rank").alias("opc_rank"))
    out = marked(term_counts(rows), everything, RARE_BELOW, COMMON_ABOVE).join(known, "term", "left")
    return out.select("term", "occurrences", F.col("records").alias("functions"), "all_functions", "opc_rank", "mark")


def found(spark: SparkSession, d: str) -> DataFrame:
    return terms(spark, d).where("mark is not null").select("term", "mark")


QUERIES = {"p4_found": found, "p4_terms": terms}
_TERMS_SQL = r"""
    WITH latest AS (SELECT * FROM acfg_disasm QUALIFY row_number() OVER (PARTITION BY idb_path, fva ORDER BY loaded_at DESC NULLS LAST, record_id DESC) = 1),
         b AS (SELECT record_id, nodes, unnest(map_entries(basic_blocks)) AS b FROM latest),
         m AS (SELECT record_id, lower(regexp_replace(m, '^\s+|\s+$', '', 'g')) AS term FROM (SELECT record_id, unnest(b.value.bb_mnems) AS m FROM b WHERE list_contains(nodes, b.key))),
         c AS (SELECT term, count(*) AS occurrences, count(DISTINCT record_id) AS functions FROM m WHERE term <> '' GROUP BY term),
         t AS (SELECT *, (SELECT count(*) FROM latest) AS all_functions, (SELECT min(opc_rank) FROM opcodes_dict o WHERE lower(trim(o.mnem)) = c.term) AS opc_rank FROM c)
    SELECT term, occurrences, functions, all_functions, opc_rank,
           CASE WHEN functions < 3 THEN 'rare' WHEN functions > 0.5 * all_functions THEN 'common' END AS mark FROM t"""
SQL = {"p4_found": f"SELECT term, mark FROM ({_TERMS_SQL}) WHERE mark IS NOT NULL", "p4_terms": _TERMS_SQL}
