import os

import pytest

from twinspar.llm import mixing
from twinspar.llm.mixing import VOCABULARY, balance, copies, count_tokens, masses, mix

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")


def test_shares_are_reached(spark):
    rows = [(i, s, 10 + i % 7) for i, s in enumerate(["big"] * 3000 + [" Mid "] * 900 + ["small"] * 60 + [None] * 40 + ["other"] * 10)]
    counted = spark.createDataFrame(rows, "id bigint, source string, tokens bigint")
    targets = spark.createDataFrame([("Big", 0.3, 2), ("mid", 0.3, 5), ("small", 0.3, 4), ("none", 0.05, 3), ("zero", 0.0, 1), ("free", None, None)], "source string, weight double, max_repeats int")
    out = {x["source"]: x for x in mix(counted, targets).collect()}
    total = sum(t for *_, t in rows)
    assert {s for s, x in out.items() if x["short"]} == {"small", "none"}
    assert out["small"]["rate"] == 4.0 and out["small"]["copies"] == 240
    for s in ("Big", "mid"):
        assert out[s]["rate"] * out[s]["tokens"] == pytest.approx(0.3 * total) and out[s]["tokens_out"] == pytest.approx(0.3 * total, rel=0.05)
    assert sum(x["share"] for x in out.values()) == pytest.approx(1)
    made = copies(counted, balance(masses(counted, targets)))
    assert made.where("copies > 5 or copies < 0").count() == 0 and made.count() == 3960
    assert mix(counted.limit(0), targets).where("short").count() == 0


def test_tokens(spark):
    rows = [(1, None), (2, ""), (3, "hello world"), (4, "a b " * 200_000), (5, " " * 300_000), (6, "<|endoftext|>"), (7, "程序" * 10)]
    got = {x["id"]: x["tokens"] for x in count_tokens(spark.createDataFrame(rows, "id int, text string"), "text").collect()}
    assert got[1] == got[2] == 0 and 1 < got[3] < 5 and got[4] >= 400_000 and got[5] > 0 and got[6] > 1 and got[7] > 1
    with pytest.raises(ValueError):
        count_tokens(spark.createDataFrame([(1, "x")], "tokens int, text string"), "text")


def test_stretches_have_the_tokens_of_the_whole_text():
    import base64

    import tiktoken

    from twinspar.llm.mixing import PATTERN, stretches

    with open(VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines())}
    encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    for t in ("It's a  test,\n\n  isn't it? 12,5 x=y;z " * 40, "程序。函数，" * 90, "a" * 700, "", "x'll y'd 'save' " * 50, " \t\n " * 200):
        for length in (7, 50, 333):
            parts = list(stretches(t, length))
            assert "".join(parts) == t and sum(len(encode(p)) for p in parts) == len(encode(t)), (t[:20], length)


def test_short_comes_from_the_solution(spark, monkeypatch):
    """Sources at exactly their goal, short by one token, without limit, with no repeats; a wrong lambda gives wrong rows."""
    counted = spark.createDataFrame([(1, "a", 50), (2, "b", 49), (3, "c", 1), (4, "d", 100)], "id bigint, source string, tokens bigint")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 2), ("c", 0.9, None), ("d", 0.5, 0), ("e", 0.1, None), ("f", 0.0, 0)], "source string, weight double, max_repeats int")
    out = {x["source"]: (x["short"], x["rate"]) for x in balance(masses(counted, targets)).collect()}
    assert {s for s, x in out.items() if x[0]} == {"b", "d", "e"} and out["a"][1] == pytest.approx(2) and out["c"][1] == pytest.approx(180) and out["d"][1] == 0
    with pytest.raises(RuntimeError):
        balance(masses(counted, targets), most_steps=1)
    real = mixing.F.log
    monkeypatch.setattr(mixing.F, "log", lambda c: real(c) + 1)  # the steps then go past the true cap
    assert "b" not in {x["source"] for x in balance(masses(counted, targets)).collect() if x["short"]}
