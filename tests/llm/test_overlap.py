import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from twinspar.llm import overlap
from twinspar.llm.overlap import OverlapParams, overlap_report, overlapping_pairs, segment_codes, size_classes
from twinspar.llm.sets import bucket_pairs, spread_join

SCHEMA = "id bigint, train boolean, name string, digest string, items array<bigint>, extra string"


def brute(rows, p=OverlapParams()):
    out = set()
    for a, b in itertools.product(rows, rows):
        if a[1] is True and b[1] is False and a[4] and b[4] and min(len(a[4]), len(b[4])) >= p.min_items:
            x, y = set(a[4]), set(b[4])
            same = a[2] is not None and a[2] == b[2] and len(x & y) * p.den >= p.num * len(x | y)
            if same or a[3] is not None and a[3] == b[3]:
                out.add((a[0], b[0]))
    return out


def test_against_brute_force(spark):
    r = random.Random(5)
    rows = []
    bases = [sorted({0, *r.sample(range(1, 400), r.randint(4, 60))}) for _ in range(12)]
    for i in range(400):
        s = set(r.choice(bases))
        for _ in range(r.randint(0, max(1, len(s) // 6))):
            s.discard(r.choice(sorted(s)))
            s.add(r.randrange(500))
        rows.append((i, r.choice([True, False, None]), r.choice(["f", "g", None]), r.choice(["d1", "d2", None, None, None, f"u{i}"]), sorted(s) if r.random() < 0.95 else None, "x" * r.choice([0, 10])))
    rows += [(1000 + i, i % 2 == 0, "hot", None, bases[0], None) for i in range(60)] + [(2000, True, None, None, [], None), (2001, False, "f", "d1", [1, 2], None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [(x["id_t"], x["id_h"]) for x in overlapping_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    report = {x["name"]: x["overlapping"] for x in overlap_report(df.withColumnRenamed("extra", "e"), ["name"]).collect()}
    assert sum(report.values()) == len({b for _, b in brute(rows)})
    assert overlapping_pairs(df.limit(0)).count() == 0


def test_segments_lose_no_pair():
    r = np.random.default_rng(1)
    p = OverlapParams()
    for _ in range(300):
        n = int(r.integers(5, 200))
        a = set(r.choice(2000, n, replace=False).tolist())
        b = set(a)
        while True:
            c = set(b)
            c.symmetric_difference_update(r.choice(2000, 1).tolist())
            if len(a & c) * p.den < p.num * len(a | c):
                break
            b = c
        if len(b) < 5:
            continue
        items = pa.array([sorted(a), sorted(b)], pa.list_(pa.int64()))
        code, row, _, _ = segment_codes(np.array([7, 7]), items, p)
        side = [set(code[row == i].tolist()) for i in (0, 1)]
        assert side[0] & side[1]


def test_size_classes_cover():
    low, segments = size_classes(1000, OverlapParams())
    assert low[0] == 5 and low[-1] > 1000 and all(s >= 2 for s in segments)


def test_long_sets(spark):
    s = list(range(50_000))
    rows = [(1, True, "f", None, s, ""), (2, False, "f", None, s[:45_000], "")]
    assert [(x["id_t"], x["id_h"]) for x in overlapping_pairs(spark.createDataFrame(rows, SCHEMA)).collect()] == [(1, 2)]


def test_hot_keys_are_split(spark):
    a = spark.createDataFrame([("h", i) for i in range(300)] + [("c", 1)], "k string, a int")
    b = spark.createDataFrame([("h", i) for i in range(200)] + [("d", 1), ("c", 2)], "k string, b int")
    got = spread_join(a, b, "k", target=500)
    assert got.count() == 300 * 200 + 1 and got.distinct().count() == 300 * 200 + 1


@pytest.mark.parametrize("most", [3, 2048])
def test_bucket_pairs_against_brute_force(spark, most):
    r = random.Random(9)
    rows = [(r.choice([1, 2, 3, 4, 5]), i, i % 7) for i in range(120)] + [(9, 1000 + i, 0) for i in range(40)] + [(77, 5, 1)] + [(78, 3, 3), (78, 4, 4)] * 2
    accept = lambda x, y: (x[0] < y[0]) & (x[1] + y[1] > 5)
    df = spark.createDataFrame(rows, "code bigint, id bigint, w bigint")
    got = [tuple(x) for x in bucket_pairs(df, ["id"], ["w"], accept, most).collect()]
    want = {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and a[2] + b[2] > 5}
    assert len(got) == len(set(got)) and set(got) == want
    assert bucket_pairs(df.limit(0), ["id"], ["w"], accept, most).count() == 0


def test_params_are_frozen():
    assert overlap.OverlapParams().num == 4
