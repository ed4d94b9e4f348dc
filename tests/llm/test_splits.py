import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from twinspar.llm.splits import assign, components, grouped_splits, vertex

SHARES = {"training": 0.7, "validation": 0.15, "testing": 0.15}


def labels(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            up[find(a)] = find(b)
    return {x: find(x) for x in up}


def same_groups(a, b):
    g, h = defaultdict(set), defaultdict(set)
    for x, y in a.items():
        g[y].add(x)
    for x, y in b.items():
        h[y].add(x)
    return set(map(frozenset, g.values())) == set(map(frozenset, h.values()))


def test_components(spark):
    r = random.Random(4)
    edges = [(f"v{i}", f"v{i + 1}") for i in range(60)] + [("hub", f"s{i}") for i in range(200)] + [("x", "x"), ("p", "q"), ("q", "p"), ("p", "q")]
    edges += [(f"r{r.randrange(80)}", f"r{r.randrange(80)}") for _ in range(60)]
    got = {x["vertex"]: x["label"] for x in components(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert same_groups(got, labels(edges))
    assert components(spark.createDataFrame([], "u string, v string")).count() == 0


def test_related_rows_share_a_split(spark):
    r = random.Random(6)
    rows = [(i, r.choice([f"p{r.randrange(60)}", None]), r.choice([f"n{r.randrange(400)}", None, None])) for i in range(2000)] + [(9000 + i, "big", None) for i in range(900)] + [(99_000, None, None)] * 2
    df = spark.createDataFrame(rows, "id bigint, p string, name string").withColumn("vertex", vertex(F.col("p"), [F.col("name")], F.col("id")))
    got = grouped_splits(df, ["name"], SHARES).collect()
    assert len(got) == len(rows) and {x["split"] for x in got} <= set(SHARES)
    split = {x["id"]: x["split"] for x in got}
    for k in (1, 2):
        by = defaultdict(set)
        for x in rows:
            if x[k] is not None:
                by[x[k]].add(split[x[0]])
        assert all(len(s) == 1 for s in by.values())
    assert grouped_splits(df.limit(0), ["name"], SHARES).count() == 0


def test_shares(spark):
    r = random.Random(7)
    groups = spark.createDataFrame([(f"c{i}", r.randint(1, 20)) for i in range(2000)], "component string, weight bigint")
    total = Counter()
    for x in assign(groups, SHARES).collect():
        total[x["split"]] += x["weight"]
    n = sum(total.values())
    assert all(abs(total[s] / n - w) < 0.01 for s, w in SHARES.items())
    one = assign(spark.createDataFrame([("a", 90), ("b", 5), ("c", 5)], "component string, weight bigint"), SHARES)
    assert {x["component"]: x["split"] for x in one.collect()} == {"a": "training", "b": "validation", "c": "testing"}
