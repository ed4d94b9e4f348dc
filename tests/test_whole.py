"""Queries that give the whole job: no row, slot or instruction left out."""

import numpy as np
import pytest

from twinspar.operators import embed, pairs
from twinspar.plans import feature_queries as Q
from twinspar.plans import similarity_queries as S


def test_word2vec_queries_every_trained_word(spark):
    d = "/root/testdata/sf0.1"
    trained = {r["token"] for r in Q.counts(spark, d).where("n >= 8").collect()}
    near = Q.word2vec(spark, d).collect()
    assert len(trained) > Q.TOP
    assert len(near) == len(trained) and {r["word"] for r in near} == trained
    assert all(r["near"] in trained and r["near"] != r["word"] for r in near)


def test_every_slot_gets_a_negative(spark, monkeypatch):
    monkeypatch.setattr(pairs, "RANGE", 7, raising=False)
    names = ["a" if i % 25 or not i else "b" if i % 2 else None for i in range(130)]
    df = spark.createDataFrame([(i, 1000 + i, n) for i, n in enumerate(names)], "idx bigint, func_id bigint, func_name string")
    by = {1000 + i: n for i, n in enumerate(names)}
    got = pairs.negatives(df, df, "XM", probes=2, count=3).collect()
    assert sorted((r["func_id_1"], r["k"]) for r in got) == sorted((i, k) for i, n in by.items() if n for k in range(3))
    assert all(by[r["func_id_2"]] and by[r["func_id_1"]] != by[r["func_id_2"]] for r in got)
    assert pairs.negatives(df.where("func_name = 'a'"), df.where("func_name = 'a'"), "XM").count() == 0
    named = [i for i, n in by.items() if n]
    want = {a: next(b for b in named[k + 1 :] + named if by[b] != by[a]) for k, a in enumerate(named)}
    assert {r["func_id"]: r["__next"] for r in pairs._next_names(df, "func_id", "func_name").collect()} == want


def test_no_negative_is_missing(spark, sf):
    _, neg = S.scored(spark, sf)
    assert neg.count() == S.NEGATIVES * S.vectors(spark, sf).count()


def test_documents_have_all_instructions(spark, tmp_path, monkeypatch):
    lines = [f"mov r{i}, 0x{i:x}" for i in range(500)]
    rows = [(1, {"0": {"bb_disasm": lines}})]
    spark.createDataFrame(rows, "record_id bigint, basic_blocks map<string,struct<bb_disasm:array<string>>>").write.parquet(f"{tmp_path}/acfg_disasm.parquet")
    monkeypatch.setattr(Q.E, "fit_documents", lambda text, m: None)
    monkeypatch.setattr(Q.E, "infer_documents", lambda text, words, m: text)
    (row,) = Q.documents("pvdm", spark, str(tmp_path)).collect()
    assert len(row["tokens"]) == 500 and "r499" in row["tokens"][-1]


@pytest.mark.parametrize("kind", ["pvdm", "pvdbow", "asm"])
def test_long_documents_in_runs_give_the_same(monkeypatch, kind):
    m = embed.DocumentModel(kind=kind, size=4, negative=3)
    r = np.random.default_rng(3)
    doc = [r.integers(0, 9, n).tolist() for n in r.integers(1, 5, 40)]
    width = m.size if kind == "asm" else m.width

    def stepped(run):
        monkeypatch.setattr(embed, "RUN", run, raising=False)
        w = embed.Words({}, np.ones(9), np.random.default_rng(1).random((9, width)), np.random.default_rng(2).random((9, m.width)))
        d = embed._step(doc, np.full(m.width, 0.1), w, m, np.cumsum(np.full(9, 1 / 9)), np.random.default_rng(4), True)
        return d, w.into, w.out

    for one, other in zip(stepped(10_000), stepped(7), strict=True):
        np.testing.assert_allclose(one, other)


def test_sequences_have_the_reference_lengths(spark, tmp_path):
    """A function of 400 instructions in blocks of 90: 250 ids, whole blocks until 250, 150 padded ids."""
    blocks = {10 + b: {"bb_mnems": [f"m{b}x{i}" if i < 90 else None for i in range(90)]} for b in range(4)} | {99: {"bb_mnems": ["ret"] * 40}}
    spark.createDataFrame([(1, blocks)], "record_id bigint, basic_blocks map<bigint,struct<bb_mnems:array<string>>>").write.parquet(f"{tmp_path}/acfg_disasm.parquet")
    size = lambda name: len(Q.QUERIES[name](spark, str(tmp_path)).first()["ids"].split(";"))
    assert (size("id_sequences"), size("id_sequences_block_stop"), size("id_sequences_padded")) == (250, 270, 150)
