import random
from collections import Counter, defaultdict

import numpy as np

from twinspar.llm import termfreq as T


def test_containers_round_trip():
    r = np.random.default_rng(1)
    for n in (0, 1, 4095, 4096, 4097, 65535, 65536):
        x = np.sort(r.choice(65536, n, replace=False))
        assert T.unpack(T.pack(x)).tolist() == x.tolist()


def test_counts_against_plain_ones(spark):
    r = random.Random(3)
    rows = []
    for i in range(3000):
        rows.append((r.choice([i, i + 70_000, i * 1_000_003, -i]), Counter(r.choices(["a", "b", "c", f"rare{i % 700}"], k=r.randint(0, 5)))))
    rows = list({k: (k, v) for k, v in rows}.values())
    occurrences, holders = Counter(), defaultdict(set)
    for i, c in rows:
        for t, n in c.items():
            occurrences[t] += n
            holders[t].add(i)
    df = spark.createDataFrame([(i, dict(c)) for i, c in rows], "id bigint, terms map<string,bigint>").repartition(5)
    got = {x["term"]: (x["occurrences"], x["records"]) for x in T.term_counts(df).collect()}
    assert got == {t: (occurrences[t], len(holders[t])) for t in occurrences}
    twice = {x["term"]: x["records"] for x in T.term_counts(df.union(df)).collect()}
    assert twice == {t: len(holders[t]) for t in occurrences}
    assert T.term_counts(df.limit(0)).count() == 0


def test_full_container_counts_as_bitmap(spark):
    df = spark.range(70_000).selectExpr("id", "map('x', 2L) AS terms")
    assert [tuple(r) for r in T.term_counts(df).collect()] == [("x", 140_000, 70_000)]


def test_words_of_known_blocks(spark):
    rows = [
        (1, [10, 20], {10: ["MOV", " mov ", None, ""], 20: None, 30: ["add"]}),
        (2, None, {1: ["x"]}),
        (3, [1], None),
        (4, [], {}),
        (5, [7, None, 7], {7: ["lock cmpxchg", "A\t"]}),
    ]
    df = spark.createDataFrame(rows, "k int, n array<bigint>, b map<bigint,array<string>>")
    got = {x["k"]: x["terms"] for x in T.function_terms(df, ["k"], "n", "b").collect()}
    assert got == {1: {"mov": 2}, 2: {}, 3: {}, 4: {}, 5: {"lock cmpxchg": 1, "a": 1}}
