"""Every query of the core against its SQL on the smallest tables; those without SQL by the number of their rows and by what holds for each."""

import numpy as np
import pytest
from oracle import compare, connect

from twinspar.plans import nested_queries, registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_sql(spark, sf, name):
    _, why = compare(spark, sf, registry.QUERIES[name], registry.SQL[name])
    assert not why


GRAPHS = "SELECT count(*) FROM acfg_disasm WHERE len(list_filter(nodes, lambda x: x IS NOT NULL)) > 0"
TOKENS = "SELECT count(DISTINCT record_id) FROM (SELECT record_id, unnest(e.value.bb_mnems) AS m FROM (SELECT record_id, unnest(map_entries(basic_blocks)) AS e FROM acfg_disasm)) WHERE trim(m) <> ''"
LINES = "SELECT count(DISTINCT record_id) FROM (SELECT record_id, unnest(e.value.bb_disasm) AS m FROM (SELECT record_id, unnest(map_entries(basic_blocks)) AS e FROM acfg_disasm)) WHERE m IS NOT NULL"
FUNCTIONS = f"WITH RECURSIVE {nested_queries._PAYLOADS} SELECT count(*) FROM nfn"
unit = lambda width: lambda r: len(r["embedding"]) == width and (abs(np.linalg.norm(r["embedding"]) - 1) < 1e-9 or not np.any(r["embedding"]))
#: For each query without SQL: how many rows it has, and what holds for each of them.
HOLDS = {
    "p1_raw_functions": (FUNCTIONS, lambda r: r["func_pos"] >= 0 and r["func_addr"] is not None),
    "p1_raw_blocks": (None, lambda r: r["block_pos"] >= 0 and r["func_pos"] >= 0),
    "p1_raw_instructions": (None, lambda r: r["instr_pos"] >= 0 and (r["mnem"] or r["norm"] or r["head"] is not None)),
    "minhash_sig": ("SELECT count(*) FROM acfg_disasm", lambda r: r["signature"] is None or len(r["signature"]) == 64 and all(0 <= x < 1 << 32 for x in r["signature"])),
    "simhash": ("SELECT 4 * count(*) FROM acfg_disasm", lambda r: r["num_nodes"] >= r["branching_nodes"] >= 0),
    "strand_slices": (None, lambda r: 0 <= r["bucket"] < 1024 and r["n"] > 0),
    "node_features": ("SELECT count(*) FROM (SELECT DISTINCT record_id, unnest(nodes) AS n FROM acfg_disasm) WHERE n IS NOT NULL", lambda r: r["n_instructions"] >= max(r[f"n_{c}"] for c in ("call", "redirect", "transfer", "arith", "logic")) and r["n_redirect"] >= r["n_call"]),
    "s2v_embed": (GRAPHS, unit(64)),
    "graph_embed": (GRAPHS, lambda r: len(r["embedding"]) == 128),
    "s2v_tokens": (TOKENS, lambda r: len(r["embedding"]) == 3 * 64),
    "graph_match": (None, lambda r: r["sim"] <= 0),
    "seq_embed": (TOKENS, unit(100)),
    "strand_mlp": (None, lambda r: 0 <= r["sim"] <= 1),
    "word2vec_nn": (None, lambda r: r["word"] != r["near"] and -1 <= r["sim"] <= 1 + 1e-9),
    **{f"doc_vectors_{k}": (LINES, lambda r: len(r["embedding"]) == 32 and np.all(np.isfinite(r["embedding"]))) for k in ("pvdm", "pvdbow", "asm")},
}


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_without_sql(spark, sf, name):
    count, holds = HOLDS[name]
    rows = registry.QUERIES[name](spark, sf).collect()
    assert rows and all(map(holds, rows))
    if count:
        assert len(rows) == connect(sf).execute(count).fetchone()[0]


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
