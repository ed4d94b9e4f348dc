import random

from twinspar.llm.leaks import LeakParams, aligned, in_order, leaks, words

R = random.Random(9)
VOCABULARY = ["".join(R.choices("bcdfgklmnprst", k=2)) + R.choice("aeiou") + R.choice(["x", "n", "r"]) for _ in range(900)]


def text(n):
    return [R.choice(VOCABULARY) for _ in range(n)]


def test_words_ignore_appearance():
    want = ["the", "noisy", "loop"]
    for t in ("The  noisy\nloop!", "> the\n> NOISY\n> loop", "**The** <b>noisy</b> loop", "thе nоisy lооp", "ｔｈｅ noisy loop", "the no​isy lo­op", "&quot;The noisy&quot; loop"):
        assert words(t) == want, t
    assert words("请删除。ok") == ["请", "删", "除", "ok"] and words("") == [] and words("é") == words("é")


def test_holds(spark):
    items = [(i, text(80)) for i in range(5)]
    docs, want = [], set()

    def doc(parts):
        docs.append((len(docs), " ".join(parts)))
        return len(docs) - 1

    for i, w in items:
        want.add((doc(text(100) + w + text(50)), i))
        want.add((doc(text(30) + w[10:50] + text(300)), i))
        changed = [x for k, x in enumerate(w) if k % 9]
        changed = [R.choice(VOCABULARY) if k % 11 == 0 else x for k, x in enumerate(changed)]
        want.add((doc(text(30) + changed + text(10)), i))
        doc(text(30) + w[:20] + text(60))  # too little
        doc(text(5) + [x for k in range(0, 80, 8) for x in [*w[k : k + 4], *text(40)]])  # scattered
        doc([x for k in range(70, -1, -10) for x in w[k : k + 10]])  # out of order
    docs += [(900, None), (901, ""), (902, " ".join(text(200_00))), (903, docs[0][1])]
    want.add((903, 0))
    spark_items = spark.createDataFrame([*((i, " ".join(w)) for i, w in items), (50, None), (51, ""), (52, "two words")], "item bigint, text string")
    df = spark.createDataFrame(docs, "id bigint, text string")
    got = {(x["id"], x["item"]) for x in leaks(df, spark_items).collect()}
    assert got == want
    assert {(x["id"], x["item"]) for x in leaks(df, spark_items, LeakParams(block_chars=900)).collect()} == want
    assert leaks(df.limit(0), spark_items).count() == 0 and leaks(df, spark_items.limit(0)).count() == 0


def test_short_items(spark):
    """Items of one to six words: their own number of words is enough of a shingle."""
    items = [(1, "zebra"), (2, "zebra crossing"), (3, "three blind mice"), (4, "one two three four five"), (5, "a b c d e f"), (6, "!!!")]
    docs = [(10, "a Zebra, seen"), (11, "the crossing zebra"), (12, "blind mice"), (13, "blind and mice"), (14, "see one two"), (15, "c d e"), (16, "c x d x e"), (17, "nothing")]
    got = {(x["id"], x["item"]) for x in leaks(spark.createDataFrame(docs, "id bigint, text string"), spark.createDataFrame(items, "item bigint, text string")).collect()}
    assert got == {(10, 1), (11, 1), (10, 2), (11, 2), (12, 3), (14, 4), (15, 5)}


def test_many_items_against_one_by_one(spark):
    items = [(i, " ".join(text(25))) for i in range(400)]
    docs = [(k, " ".join(text(40) + (items[k][1].split()[2:20] if k % 3 else []) + text(30))) for k in range(120)]
    df = spark.createDataFrame(docs, "id bigint, text string")
    got = {(x["id"], x["item"]) for x in leaks(df, spark.createDataFrame(items, "item bigint, text string")).collect()}
    assert got == {(k, k) for k in range(120) if k % 3}
    assert {(x["id"], x["item"]) for x in leaks(df, spark.createDataFrame(items, "item bigint, text string"), LeakParams(cover=0.0)).collect()} == got


def test_bound_holds_for_alignments():
    import numpy as np

    r = np.random.default_rng(2)
    for _ in range(200):
        a, b = r.integers(0, 12, 40), r.integers(0, 12, 60)
        assert aligned(a, b) <= in_order(a, b)
    assert aligned(np.arange(10), np.arange(10)) == in_order(np.arange(10), np.arange(10)) == 10
