"""Queries p2_ to p8_ against their SQL, and those without SQL against brute force."""

import base64

import numpy as np
import pytest
import tiktoken
from oracle import compare

from twinspar.llm import leaks, mixing, queries
from twinspar.session import table

FOUND = {
    "p2_found": ["func_id_1", "func_id_2"],
    "p3_found": ["field", "id_1", "id_2"],
    "p4_found": ["term", "mark"],
    "p5_found": ["project_1", "project_2"],
    "p6_found": ["doc_id", "item_id"],
    "p7_found": ["source"],
    "p8_found": ["doc_id", "start_char", "end_char"],
}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, sf, name):
    _, why = compare(spark, sf, queries.QUERIES[name], queries.SQL[name])
    assert not why


def test_leaks_against_all_pairs(spark, sf):
    """Every document with every item, aligned over the whole text: shared words are a bound, so most pairs need no alignment."""
    items = [(r["item_id"], leaks.words(r["text"])) for r in table(spark, sf, "eval_items").collect() if r["text"]]
    number = {}
    code = lambda w: np.array([number.setdefault(x, len(number)) for x in w], np.int64)
    items = [(i, code(w)) for i, w in items if w]
    want = set()
    for r in table(spark, sf, "documents").collect():
        w = code(leaks.words(r["text"] or ""))
        for i, item in items:
            if np.isin(item, w).sum() * 5 >= 2 * len(item) and leaks.aligned(item, w) * 5 >= 2 * len(item):
                want.add((r["doc_id"], i))
    got = {tuple(r) for r in queries.QUERIES["p6_found"](spark, sf).collect()}
    assert got == want and len(got) >= 10
    by_item = {r["item_id"]: r["documents"] for r in queries.QUERIES["p6_items"](spark, sf).collect()}
    assert by_item == {r["item_id"]: sum(i == r["item_id"] for _, i in want) for r in table(spark, sf, "eval_items").collect()}


def test_mixing_against_plain_counts(spark, sf):
    with open(mixing.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines())}
    encode = tiktoken.Encoding("own", pat_str=mixing.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    docs = [(r["doc_id"], (r["source"] or "").strip().lower(), len(encode(r["text"] or ""))) for r in table(spark, sf, "documents").collect()]
    total = sum(n for *_, n in docs)
    plan = {r["source"]: r for r in queries.QUERIES["p7_plan"](spark, sf).collect()}
    copies = {r["doc_id"]: r["copies"] for r in queries.QUERIES["p7_copies"](spark, sf).collect()}
    assert len(plan) == table(spark, sf, "mix_targets").count()
    for r in table(spark, sf, "mix_targets").collect():
        own = [(i, n) for i, s, n in docs if s == r["source"].strip().lower()]
        tokens, out = sum(n for _, n in own), plan[r["source"]]
        assert out["tokens"] == tokens and out["short"] == (tokens * r["max_repeats"] < r["weight"] * total)
        assert out["rate"] == pytest.approx(min(r["max_repeats"], r["weight"] * total / tokens))
        assert out["tokens_out"] == sum(copies[i] * n for i, n in own) and all(int(out["rate"]) <= copies[i] <= r["max_repeats"] for i, _ in own)
    assert {r["source"] for r in queries.QUERIES["p7_found"](spark, sf).collect()} == {s for s, r in plan.items() if r["short"]}


def test_sentences_cover_the_texts(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    by = {}
    for r in queries.QUERIES["p8_sentences"](spark, sf).orderBy("doc_id", "sentence_no").collect():
        assert r["sentence"] == texts[r["doc_id"]][r["start_char"] : r["end_char"]] and r["sentence"] == r["sentence"].strip() != ""
        by.setdefault(r["doc_id"], []).append((r["start_char"], r["end_char"]))
    assert {tuple(r) for r in queries.QUERIES["p8_found"](spark, sf).collect()} == {(d, a, b) for d, spans in by.items() for a, b in spans}
    for d, t in texts.items():
        inside = np.zeros(len(t or ""), bool)
        last = 0
        for a, b in by.get(d, []):
            assert a >= last
            last = b
            inside[a:b] = True
        assert not any(c.isalnum() for c, i in zip(t or "", inside, strict=True) if not i)  # only marks and white space lie outside


def test_no_query_is_left_without_a_check():
    assert set(queries.QUERIES) - set(queries.SQL) == {"p6_found", "p6_items", "p7_found", "p7_plan", "p7_copies", "p8_found", "p8_sentences"}


def test_columns(spark, sf):
    for name, columns in FOUND.items():
        assert queries.QUERIES[name](spark, sf).columns == columns
