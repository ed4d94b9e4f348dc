import json

import numpy as np
import pyarrow as pa
import pytest

from twinspar.operators import nested as N

SCHEMA = "id bigint, pos_1 int, items array<struct<id:int,tags:array<string>,m:map<string,array<bigint>>>>, note string"


def test_flatten_keeps_links_and_names(spark):
    rows = [(1, 7, [(5, ["a", "b"], {"k": [1, 2]}), (6, None, None)], "x" * 100_000), (2, 8, [], ""), (3, 9, None, None), (4, 9, [None], None), (5, 9, [(5, [], {})], None)]
    df = spark.createDataFrame(rows, SCHEMA)
    items = N.flatten(df, ["id", "pos_1"], "items")
    assert items.columns == ["id", "pos_1", "pos_1_", "id_"]
    assert sorted(map(tuple, items.collect()), key=str) == [(1, 7, 0, 5), (1, 7, 1, 6), (4, 9, 0, None), (5, 9, 0, 5)]
    tags = {tuple(r) for r in N.flatten(df, ["id"], "items.tags").collect()}
    assert tags == {(1, 0, 0, "a"), (1, 0, 1, "b")}
    inner = {tuple(r) for r in N.flatten(df, ["id"], "items.m.value").collect()}
    assert inner == {(1, 0, 0, 0, 1), (1, 0, 0, 1, 2)}
    tables = N.related_tables(df, ["id"])
    assert set(tables) == {"", "items", "items.tags", "items.m", "items.m.value"}
    assert tables[""].count() == 5
    assert all(t.count() >= 0 for t in N.related_tables(df.limit(0), ["id"]).values())


def test_flatten_refuses_paths_outside_lists(spark):
    df = spark.createDataFrame([(1, 7, None, None)], SCHEMA)
    for path in ("note", "items.none"):
        with pytest.raises(ValueError):
            N.flatten(df, ["id"], path)


def test_child_index_of_slices():
    a = pa.array([[1, 2], None, [], [3], [4, 5, 6]])
    for at in range(5):
        for n in range(5 - at + 1):
            s = a.slice(at, n)
            values, parent, ordinal = N.child_index(s)
            want = [(i, j, v) for i, x in enumerate(s.to_pylist()) for j, v in enumerate(x or [])]
            assert list(zip(parent.tolist(), ordinal.tolist(), values.to_pylist(), strict=True)) == want


LAYOUTS = [
    {"p": {"arch": "x", "0x10": {"nodes": [16, "0x20", "48"], "edges": [[16, 32], ["0x10", "0x20"], [32, 99]], "basic_blocks": {"16": {"bb_mnems": ["mov"]}}}}},
    {"idb_path": "p", "functions": [{"fva": "16", "nodes": [{"addr": 16}], "edges": [{"src": 16, "dst": 32}], "chunks": [{"nodes": [{"addr": "0x20"}], "edges": None, "chunks": [{"nodes": [{"addr": 48}]}]}]}]},
    {"binary": {"path": "p"}, "functions": {"0X10": {"nodes": [{"id": "0x10", "succ": ["0x20", "0x63"], "block": {"bb_len": 4}}, {"id": "0x20"}, {"id": 48}]}}},
    {"idb_path": "p", "functions": [{"fva": 16, "nodes": [16, 32, 48], "edges": {"16": [32, 32], "0x20": [99]}}]},
]


@pytest.mark.parametrize("record", LAYOUTS)
def test_layouts_agree(record):
    out = N.known_edges(pa.array([7]), N.shred(pa.array([json.dumps(record)])))
    assert [tuple(r.values()) for r in out.to_pylist()] == [(7, 16, 16, 32)]


def test_damaged_payloads_give_nothing(spark):
    good = json.dumps(LAYOUTS[0])
    rows = [(1, good), (2, good[:-3]), (3, None), (4, ""), (5, "[]"), (6, "null"), (7, good), (8, good + "x"), (9, json.dumps({"p": 3, "functions": None})), (10, "[" * 100_000)]
    df = spark.createDataFrame(rows, "raw_id bigint, payload string")
    assert {tuple(r) for r in N.function_edges(df, "raw_id", "payload").collect()} == {(1, 16, 16, 32), (7, 16, 16, 32)}
    assert N.function_edges(df.limit(0), "raw_id", "payload").count() == 0
    with pytest.raises(ValueError):
        N.function_edges(df.withColumnRenamed("raw_id", "src"), "src", "payload")


def test_addresses():
    assert [N._address(x) for x in ("0xFFFFFFFFFFFFFFFF", "12", 7, 8.0, True, None, "zz", -1, [])] == [-1, 12, 7, 8, None, None, None, -1, None]


def test_found_against_plain_loops(spark, sf):
    import pyarrow.parquet as pq

    want = set()
    for r in pq.read_table(f"{sf}/acfg_raw.parquet").to_pylist():
        try:
            record = json.loads(r["payload"] or "null")
        except ValueError:
            continue
        for _, _, at, body in N._functions(record):
            ns, es, bs = [], [], []
            N._gather(body, ns, es, bs)
            nodes = {N._address(n) for n in ns}
            want |= {(r["raw_id"], N._address(at), N._address(s), N._address(d)) for s, d in es if N._address(s) in nodes and N._address(d) in nodes}
    from twinspar.plans.nested_queries import found

    got = [tuple(x) for x in found(spark, sf).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_slices_cover_all():
    a = pa.array(["x" * n for n in (5, 0, 50, 3)] + [None])
    assert [x for at, n in N.slices(a, 10) for x in range(at, at + n)] == list(range(5))
    assert list(N.slices(pa.array([], pa.string()))) == []
    assert np.sum([n for _, n in N.slices(a, 1)]) == 5
