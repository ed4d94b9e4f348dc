import dataclasses
import itertools
import random

from twinspar.llm.setjoin import Bands, frequent_values, levels, link_counts, similar_pairs
from twinspar.llm.setjoin_queries import CATALOG, FSS, number_sets, word


def test_sets_against_brute_force(spark):
    r = random.Random(7)
    common = [1, 2, 3, 4]
    base = [r.sample(range(10, 5000), 40) for _ in range(6)]
    rows = []
    for i in range(250):
        s = set(r.choice(base)) if r.random() < 0.7 else set(r.sample(range(10, 5000), r.randint(1, 60)))
        for _ in range(r.randint(0, 14)):
            s.discard(r.choice(sorted(s)) if s else 0)
            s.add(r.randrange(10, 5000))
        s |= set(r.sample(common, r.randint(0, 4)))
        rows.append((i, sorted(s)))
    rows += [(900 + i, rows[0][1]) for i in range(30)] + [(1000, []), (1001, None), (1002, [5]), (1003, [5])]
    df = spark.createDataFrame(rows, "id bigint, value array<bigint>")
    want = {(a, b) for (a, x), (b, y) in itertools.combinations(rows, 2) if x and y and len(set(x) & set(y)) * 2 >= len(set(x) | set(y))}
    got = [tuple(x) for x in similar_pairs(df, "value", CATALOG).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    links = {x["id"]: x for x in link_counts(df, "value", CATALOG).collect()}
    assert links[900]["class_id"] == 0 and links[900]["copies"] == 31 and 1000 not in links
    assert similar_pairs(df.limit(0), "value", CATALOG).count() == 0


def test_words_against_brute_force(spark):
    r = random.Random(8)
    base = [r.getrandbits(64) for _ in range(20)]
    rows = []
    for i in range(300):
        w = r.choice(base)
        for _ in range(r.randint(0, 4)):
            w ^= 1 << r.randrange(64)
        rows.append((i, w - (1 << 64) if w >> 63 else w))
    rows += [(500, 0), (501, 0), (502, None), (503, -1), (504, -1)]
    df = spark.createDataFrame(rows, "id bigint, w bigint")
    bits = lambda w: w & ((1 << 64) - 1)
    want = {(a, b) for (a, x), (b, y) in itertools.combinations(rows, 2) if x and y and (bits(x) & bits(y)).bit_count() * 10 >= 9 * (bits(x) | bits(y)).bit_count()}
    assert {tuple(x) for x in similar_pairs(df, "w", FSS).collect()} == want


def test_notations(spark):
    from pyspark.sql import functions as F

    rows = [(1, "[1, 2;;3 ]"), (2, "min_function_size_error"), (3, None), (4, ""), (5, "7;7; 7"), (6, "catalog_hash_list"), (8, "9223372036854775808;9223372036854775809;009223372036854775807;12 x9"), (9, "1" * 5000 + ";" + "1" * 5001)]
    got = {x["id"]: x["items"] for x in number_sets(spark.createDataFrame(rows, "id int, t string"), "t").collect()}
    long, longer = got.pop(8), got.pop(9)
    assert got == {1: [1, 2, 3], 2: None, 3: None, 4: None, 5: [7], 6: None}
    assert len(long) == 4 and long[2:] == [12, (1 << 63) - 1] and long[1] < 0 and len(longer) == 2
    words = [(1, "0xffffffffffffffff"), (2, "-1"), (3, "18446744073709551615 "), (4, "00000000000000000007"), (5, ""), (6, None), (7, "x")]
    got = {x["id"]: x["w"] for x in spark.createDataFrame(words, "id int, t string").select("id", word(F.col("t")).alias("w")).collect()}
    assert got == {1: -1, 2: -1, 3: -1, 4: 7, 5: None, 6: None, 7: None}


def test_frequent_values_change_nothing(spark):
    """A few values in nearly all sets, at all levels: sets with few, many and only frequent values."""
    r = random.Random(11)
    base = [r.sample(range(100, 9000), 30) for _ in range(8)]
    rows = []
    for i in range(300):
        s = set(r.choice(base)[: r.choice([30, 20, 8, 0])]) | set(r.sample(range(14), r.choice([0, 2, 7, 12])))
        for _ in range(r.randint(0, 6)):
            s.add(r.randrange(100, 9000))
        rows.append((i, sorted(s) or None))
    df = spark.createDataFrame(rows, "id bigint, value array<bigint>")
    want = {(a, b) for (a, x), (b, y) in itertools.combinations(rows, 2) if x and y and len(set(x) & set(y)) * 2 >= len(set(x) | set(y))}
    p = dataclasses.replace(CATALOG, common_least=25)
    classes = df.where("value is not null").select("id", "value")
    assert len(frequent_values(classes, "value", p)) >= 14
    assert {tuple(x) for x in similar_pairs(df, "value", p).collect()} == want == {tuple(x) for x in similar_pairs(df, "value", CATALOG).collect()}


def test_chance_to_miss():
    for p in (CATALOG, FSS):
        assert p.missed < 3e-5
        for share, bands in levels(p):
            left = (p.num / p.den - share) / (1 - share)
            assert (1 - left**bands.rows) ** bands.bands <= p.missed
    assert Bands(1, 1, 1, 2).seed == 11
