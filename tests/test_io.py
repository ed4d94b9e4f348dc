import json

from pyspark.sql import functions as F

from twinspar.sources import io
from twinspar.streaming import streams


def test_csv_headers_and_index(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "a.csv").write_text(",x,y\n0,1,a\n1,2,b\n,x,y\n2,3,\"c,\"\"d\"\n")
    (d / "b.csv").write_text(",x,y\n0,9,z\n")
    got = {tuple(r) for r in io.read_csv(spark, str(d), "x bigint, y string", index_column=True).collect()}
    assert got == {(1, "a"), (2, "b"), (3, 'c,"d'), (9, "z")}
    out = str(tmp_path / "out")
    df = spark.createDataFrame([(1, ' a"b\n'), (2, None)], "x int, y string")
    io.write_csv(df, out)
    io.write_csv(df, out, append=True)
    back = io.read_csv(spark, out, "x int, y string")
    assert back.count() == 4 and back.where("x = 1").first()["y"] == ' a"b\n'
    assert io.without_header_rows(spark.createDataFrame([("y",), ("z",), (None,)], "y string"), "y").count() == 2


def test_json_folder_selection_words(spark, tmp_path):
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.json").write_text(json.dumps({"p.i64": {"arch": "x86-64", "0x10": {"nodes": [1]}, "0x20": {}}, "other": {"0x1": {}}}))
    (tmp_path / "j" / "b.json").write_text("{broken")
    (tmp_path / "j" / "c.txt").write_text("{}")
    rows = io.read_functions_json(spark, str(tmp_path / "j")).select("idb_path", "arch", "fva").collect()
    assert {tuple(r) for r in rows} == {("other", None, "0x1"), ("p.i64", "x86-64", "0x10"), ("p.i64", "x86-64", "0x20")}
    (tmp_path / "s.json").write_text(json.dumps({"p": [3, 1, 3], "q": []}))
    sel = io.read_selection(spark, str(tmp_path / "s.json"))
    assert sel.count() == 3 and io.selection_json(sel).first()["value"] == '{"p":[1,3]}'
    io.write_words(spark.createDataFrame([("a",), ("b",)], "word string"), str(tmp_path / "w"))
    assert io.read_words(spark, str(tmp_path / "w")).count() == 2
    io.write_corpus(spark.createDataFrame([(["a", "b"],)], "t array<string>"), "t", str(tmp_path / "c"))
    assert spark.read.text(str(tmp_path / "c")).first()[0] == "a b"
    io.write_vectors(spark.createDataFrame([(1, [1.0, 2.0])], "id int, vector array<double>"), str(tmp_path / "v"))
    assert io.read_vectors(spark, str(tmp_path / "v")).first()["vector"] == [1.0, 2.0]
    assert io.files_below(spark, str(tmp_path / "j"), "*.json").count() == 2
    assert all(len(r["sha256"]) == 64 for r in io.checksums(spark, str(tmp_path / "j")).collect())
    done = spark.createDataFrame([(1, "ok"), (2, "error")], "k int, state string")
    assert sorted(r["k"] for r in io.pending(spark.range(4).select(F.col("id").cast("int").alias("k")), done, ["k"], F.col("state") == "error").collect()) == [0, 2, 3]


def test_streams(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet")
    e.write.parquet(str(tmp_path / "in"))
    for run in range(2):
        s = streams.read_stream(spark, str(tmp_path / "in"), e)
        q = streams.run_once(streams.first_deliveries(s, ["event_id"], "ts", "10 days").select("event_id"), str(tmp_path / "out"), str(tmp_path / "state"))
        q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == e.select("event_id").distinct().count()
