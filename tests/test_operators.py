"""Goldens, identities and edge cases of the core's operators."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinspar.functions import mnemonics, names, paths
from twinspar.functions import tokens as T
from twinspar.functions import vectors as V
from twinspar.operators import curate, features, graph, metrics, models, pairs, signature, strands

# The bytes of a known function, block by block, and its signature of 16 words.
BLOCKS = ["gD15CSAAAHUv", "SIM9DwggAABVSInldAw=", "SIs9OgggAOgN////", "6Ej////GBVEJIAABXcM=", "88M="]
SIGNATURE = [16246714, 33239425, 27928189, 71450536, 44960705, 141758464, 26136794, 13497241, 301254875, 41321992, 46723024, 49102047, 16180186, 285262132, 27325237, 238788173]
NODES = [1968, 1977, 1991, 2003, 2024]
EDGES = [(1968, 1977), (1968, 2024), (1977, 1991), (1977, 2003), (1991, 2003)]


def column(spark, kind, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}").select("i", f(F.col("c")).alias("o")).orderBy("i").collect()
    return [r["o"] for r in rows]


def test_source_names(spark):
    given = ["_Z5_finiPvi", "foo.constprop.3.isra.0", "bar@@V_3.1", "bar@plt", ".die", "j_read_list", "__start", "sub_D920", "fcn.80001cf0", "FUN_00402f60", "nullsub_12", "foo_3", "foo.part.1", "foo.cold", "", " ", None, "j__init", "sub_add", "_ZN3foo3barEv", "x.lto_priv.7", "_Z99short"]
    given += ["fcn.00001390", "sub.123", "loc.77", "fcn.00001390.cold", "j_fcn.00401390", "fcn.80001cf0@plt", "fcn.main", "_ZNK2ns5Thing3runEPKc", "_ZN3fooC1Ev", "_ZL4helpi", "memcpy.2", "_ZN3foo3barEv.isra.0"]
    want = ["fini", "foo", "bar", "bar", "die", "read_list", "start", None, None, None, None, "foo", "foo", "foo", None, None, None, "init", "sub_add", "foo::bar", "x", "short"]
    want += [None, None, None, None, None, None, "fcn.main", "ns::Thing::run", "_ZN3fooC1Ev", "help", "memcpy", "foo::bar"]
    assert column(spark, "string", given, names.source_name) == want


def test_paths_labels_digests(spark):
    p = ["IDBs/Dataset-1/NMAP/x86-gcc-5-O2_ncat.i64", "IDBs\\Dataset-1\\z3\\x64-clang-3.5-O0_z3.i64", "/mnt/v/IDBs//Dataset-2/X86-64_Lib-1.2-O3_x.i64 ", "Dataset-Vulnerability/a/b_c.i64", "nothing", None, ""]
    assert column(spark, "string", p, names.project_of) == ["nmap", "z3", "lib", "a", None, None, None]
    assert column(spark, "string", p, names.dataset_of) == ["Dataset-1", "Dataset-1", "Dataset-2", "Dataset-Vulnerability", None, None, None]
    assert column(spark, "string", ["TRAIN ", "val", "x", None], names.split_of) == ["training", "validation", None, None]
    d = "a" * 64
    assert column(spark, "string", ["SHA256:" + d.upper(), " 0x" + d, d + "\n", d[:-1], None], names.digest_of) == [d, d, d, None, None]
    assert column(spark, "string", ["0xFFFFFFFFFFFFFFFF", "10", "0xg", None, ""], names.hex_number) == [-1, 16, None, None, None]
    df = spark.createDataFrame([(x,) for x in p], "idb_path string")
    got = {r["idb_path"]: tuple(r[v] for v in paths.VARIABLES) for r in curate.with_variables(df).collect()}
    assert got[p[0]] == ("NMAP", "ncat", "x", "32", "gcc", "gcc_5", "O2")
    assert got[p[1]] == ("z3", "z3", "x", "64", "clang", "3.5", "O0")
    assert got[p[2]] == ("Lib", "Lib-1.2", "X86", "64", "gcc", "7.5", "O3")
    assert column(spark, "string", ["x86-64", "arm-32"], paths.trace_machine) == ["x64", "arm"]
    assert column(spark, "string", ["lib_arm32.i64"], paths.arch_suffix) == ["arm32"]


def test_tokens(spark):
    assert column(spark, "string", ["mov  RAX, [rbp+0x10]"], T.plain_tokens) == [["mov", "rax", "rbp", "0x10"]]
    assert column(spark, "string", ["ldr r0,[sp,#-0x10]!"], T.trace_tokens) == [["ldr", "r0", ",", "[", "sp", ",", "-", "0x10", "]", "!"]]
    assert column(spark, "string", ["#-0x10", "#0xff", "0x10", "#zz", None], T.immediate) == [-16, 255, None, None, None]


# The normal form of that function's instructions.
NORM = ["cmp_[rip+2099577],_0x0", "jne_0x7e8", "cmp_[rip+2099215],_0x0", "push_rbp", "mov_rbp,_rsp", "je_0x7d3", "mov_rdi,_[rip+2099258]", "call_0x6e0", "call_0x720", "mov_[rip+2099537],_0x1", "pop_rbp", "ret", "ret"]


def test_normal_form_golden(spark):
    assert column(spark, "string", [line for lines in LINES.values() for line in lines], T.normalised) == NORM
    given = ["mov eax, 0x1389", "mov eax, -0x1388", "lea rax, [rbx*4 - 0x10]", "mov eax, [0x6000]", "LDR r0, [sp, #4]", "add r1, #-5", "lock cmpxchg [rdi + 8], eax", None, "nop"]
    want = ["mov_eax,_himm", "mov_eax,_-0x1388", "lea_rax,_[rbx*4-16]", "mov_eax,_[mem]", "ldr_r0,_[sp,_#4]", "add_r1,_-0x5", "lock_cmpxchg_[rdi+8],_eax", None, "nop"]
    assert column(spark, "string", given, T.normalised) == want


def test_published_search(spark):
    wanted, sources, targets = pairs.published_search(spark)
    assert (wanted.count(), sources.count(), targets.count()) == (13, 4, 2)
    firmware = pairs.SEARCHES["NETGEAR_R7000"][0]
    rows = [(1, pairs.SOURCES[0], "CMS_decrypt", "h"), (2, pairs.SOURCES[1], "other", "x"), (3, firmware, "f", "h"), (4, firmware, "g", None), (4, firmware, "g", None), (5, "else", "CMS_decrypt", "h")]
    f = spark.createDataFrame(rows, "func_id int, idb_path string, func_name string, digest string")
    got = pairs.search_pairs(f, wanted, sources, targets, ["func_id", "digest"])
    assert sorted((r["func_id_1"], r["func_id_2"]) for r in got.collect()) == [(1, 3), (1, 4)]
    assert [r["func_id_2"] for r in pairs.equal_ends(got, "digest").collect()] == [3]
    results = spark.createDataFrame([(1, 3, 0.5), (1, 3, 0.7)], "func_id_1 int, func_id_2 int, sim double")
    assert {r["func_id_2"]: r["sim"] for r in pairs.with_results(got, results, ("func_id_1", "func_id_2")).collect()} == {3: 0.7, 4: None}
    assert pairs.search_pairs(f.limit(0), wanted, sources, targets, ["func_id"]).count() == 0


def test_losses(spark):
    row = spark.createDataFrame([(0.3, 1, -1, 0.9, -0.2, [1000.0, 999.0])], "d double, y int, z int, near double, far double, s array<double>")
    got = row.select(metrics.margin_pair_loss(F.col("d"), F.col("y")), metrics.margin_pair_loss(F.col("d"), F.col("z")), metrics.hamming_pair_loss(F.col("near"), F.col("y")), metrics.hamming_triplet_loss(F.col("near"), F.col("far")), metrics.softmax_loss(F.col("s"), F.lit(1))).first()
    assert list(got) == pytest.approx([0.3, 1.7, 0.0025, (0.01 + 0.64) / 8, np.log(1 + np.e)])
    steps = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 4.0), ("b", 1, 7.0)], "run string, step int, loss double")
    assert sorted((r["run"], r["step"], r["mean_loss"]) for r in metrics.running_means(steps, ["run"], "step", ["loss"]).collect()) == [("a", 1, 2.0), ("a", 2, 3.0), ("b", 1, 7.0)]
    assert metrics.renamed_models(steps, {"loss": "Loss", "none": "x"}).columns == ["run", "step", "Loss"]
    assert {(r["run"], r["step"]) for r in metrics.best_by(steps, ["run"], "step", "loss").collect()} == {("a", 2), ("b", 1)}


def test_minwise_golden(spark):
    import base64

    data = b"".join(map(base64.b64decode, BLOCKS))
    assert signature.minhash(data, 16) == SIGNATURE and signature.minhash(b"abc", 16) is None
    df = spark.createDataFrame([(1, bytearray(data)), (2, None), (3, bytearray(b"")), (4, bytearray(b"x" * 200_000))], "k int, d binary")
    got = {r["k"]: r["signature"] for r in signature.minhash_signatures(df, "k", "d", 16).collect()}
    assert got[1] == SIGNATURE and got[2] is None and got[3] is None and len(got[4]) == 16


def test_simhash_is_stable_and_local():
    f = lambda e, mnems=None, numbers=(), w=(0, 0, 1): signature.simhash(signature._features(NODES, e, mnems or {}, numbers), [w])[0]
    a, b = f(EDGES), f(list(reversed(EDGES)))
    assert a == b and a != f(EDGES[:2])
    assert f(EDGES, {1968: ["a", "b", "c"]}, [7]) == a != f(EDGES, {1968: ["a", "b", "c"]}, [7], (4.0, 0.05, 1.0))
    both = signature.simhash(signature._features(NODES, EDGES, {1968: list("abcd")}, [7]), [(0, 0, 1), (1, 1, 1)])
    assert both == [f(EDGES, {1968: list("abcd")}, [7]), f(EDGES, {1968: list("abcd")}, [7], (1, 1, 1))]


def test_graph_hashes_of_known_and_empty_graphs(spark):
    df = spark.createDataFrame([(1, NODES, [*EDGES, (1, 2), (1968, 1977)], {1968: ["cmp", "jne"]}, [0]), (2, None, None, None, None)], "k int, nodes array<bigint>, edges array<struct<src:bigint,dst:bigint>>, mnems map<bigint,array<string>>, numbers array<bigint>")
    got = {(r["k"], r["setting"]): r for r in signature.graph_hashes(df, "k", signature.WEIGHTS).collect()}
    assert len(got) == 8 and {(r["num_nodes"], r["branching_nodes"]) for (k, _), r in got.items() if k == 1} == {(5, 2)}
    assert got[1, "graph"]["hash0"] != got[1, "all"]["hash0"] and got[2, "graph"]["hash0"] == got[2, "graph"]["hash1"] == 0
    assert signature.graph_hashes(df.limit(0), "k", signature.WEIGHTS).count() == 0


# The instructions of that function, and the counters of its blocks (instructions, call, redirect, transfer, arith, logic) and constants.
LINES = {
    1968: ["cmp byte ptr [rip + 0x200979], 0", "jne 0x7e8"],
    1977: ["cmp qword ptr [rip + 0x20080f], 0", "push rbp", "mov rbp, rsp", "je 0x7d3"],
    1991: ["mov rdi, qword ptr [rip + 0x20083a]", "call 0x6e0"],
    2003: ["call 0x720", "mov byte ptr [rip + 0x200951], 1", "pop rbp", "ret"],
    2024: ["ret"],
}
COUNTED = {1968: (2, 0, 1, 0, 0, 0), 1977: (4, 0, 1, 2, 0, 0), 1991: (2, 1, 1, 1, 0, 0), 2003: (4, 1, 2, 1, 0, 0), 2024: (1, 0, 1, 0, 0, 0)}
CONSTANTS = {1968: [0, 2024], 1977: [0, 2003], 1991: [1760], 2003: [1824, 1], 2024: []}


def test_class_counts_golden(spark):
    rows = [(1, m, n, i, line.split()[0]) for m in ("x86", None) for n, lines in LINES.items() for i, line in enumerate(lines)]
    t = spark.createDataFrame(rows, "k int, machine string, block bigint, pos int, token string")
    got = {r["block"]: tuple(r)[2:] for r in features.class_counts(t.where("machine = 'x86'"), ["k", "block"]).collect()}
    assert got == COUNTED
    whole = features.class_counts(t.where("machine = 'x86'"), ["k"]).first()
    assert (whole["n_instructions"], whole["n_call"], whole["n_redirect"], whole["n_transfer"], whole["n_logic"]) == (13, 2, 6, 4, 0)
    assert tuple(features.class_counts(t.where("machine is null"), ["k"]).first()) == (1, 13, 0, 0, 0, 0, 0)
    assert features.class_counts(t.limit(0), ["k"]).count() == 0


def test_classes_by_machine():
    of = mnemonics.members
    assert {"adceq", "adceqs", "adcseq", "subs", "mulsne", "qadd8nv", "ldrsb"} <= of("arm", "arithmetic") and "pop" not in of("arm", "transfer")
    assert "push" in of("x86", "transfer") and "pop" not in of("x86", "transfer") and "not" not in of("x86", "logic")
    assert of("sparc", "call") == set() and "jal" in of("mips", "call") and "bl" not in of("x86", "call")


def test_constants_and_split_graph_golden(spark):
    df = spark.createDataFrame([(1, n, x) for n, x in LINES.items()] + [(2, 7, None), (2, 8, ["ldr r0, [sp, #-0x10]!", "mov r1, #-5", None, "lw $v0, 0x10($sp)", "addiu $sp, $sp, -0x20", "mov eax, 0x1001", "movk x0, #0x1000"])], "k int, block bigint, disasm array<string>")
    got = {(r["k"], r["block"]): r["numerics"] for r in features.block_constants(df, ["k", "block"]).collect()}
    assert {b: x for (k, b), x in got.items() if k == 1} == CONSTANTS and got[2, 7] == [] and got[2, 8] == [-5, -32, 4096]
    t = spark.createDataFrame([(1, "x86", n, i, line.split()[0]) for n, lines in LINES.items() for i, line in enumerate(lines)], "k int, machine string, block bigint, pos int, token string")
    parts = features.sub_blocks(t, ["k"]).groupBy("k", "block", "part").agg(F.count("*").alias("n"), F.min("pos").alias("pos")).withColumn("address", F.when(F.col("part") == 0, F.col("block")).otherwise(F.lit(2008).cast("bigint")))
    nodes, edges = features.split_graph(parts, spark.createDataFrame([(1, a, b) for a, b in EDGES], "k int, src bigint, dst bigint"), "k")
    assert {r["node"] for r in nodes.collect()} == {*NODES, 2008}
    assert {(r["src"], r["dst"]) for r in edges.collect()} == {*EDGES, (2003, 2008)}


def test_strings_and_incoming_calls(spark):
    refs = spark.createDataFrame([(1, 10, 0x100), (1, 10, 0x90), (1, 10, 0x100), (1, 11, 0x5)], "k int, block int, address int")
    got = features.block_strings(refs, spark.createDataFrame([(0x100, "b"), (0x90, "a"), (0x100, "b")], "address int, text string"), ["k", "block"]).collect()
    assert [tuple(r) for r in got] == [(1, 10, ["a", "b"], 2)]
    calls = spark.createDataFrame([("p", 1), ("p", 1), ("q", 1), ("p", None)], "binary string, target bigint")
    own = spark.createDataFrame([("p", 1), ("p", 2), ("q", 1)], "binary string, address bigint")
    assert {(r["binary"], r["address"]): r["n_incoming_calls"] for r in features.incoming_calls(calls, own).collect()} == {("p", 1): 2, ("p", 2): 0, ("q", 1): 1}


def graph_row(spark):
    return spark.createDataFrame([(1, NODES, [*EDGES, (1968, 1977), (1, 2)]), (2, None, None), (3, [5], []), (4, [1, 2], [(1, 2), (2, 1), (1, 1)])], "k int, nodes array<bigint>, edges array<struct<src:bigint,dst:bigint>>")


def test_graphs(spark):
    g = graph_row(spark)
    off = {(r["k"], r["node"]): r["n_offspring"] for r in graph.offspring(g, "k").collect()}
    assert [off[1, n] for n in NODES] == [4, 2, 1, 0, 0] and off[3, 5] == 0 and off[4, 1] == off[4, 2] == 1
    between = {(r["k"], r["node"]): r["betweenness"] for r in graph.betweenness(g, "k").collect()}
    assert between[1, 1977] == pytest.approx(2 / 12) and sum(v for (k, _), v in between.items() if k == 1) == pytest.approx(2 / 12)
    deg = {(r["k"], r["node"]): r for r in graph.degrees(g, "k").collect()}
    assert [n for n in NODES if deg[1, n]["is_source"]] == [1968] and [n for n in NODES if deg[1, n]["n_out"] > 1] == [1968, 1977]
    walks = [r["path"] for r in graph.random_walks(g, "k").where("k = 1").orderBy("walk").collect()]
    assert len(walks) == 11 and walks[0] == NODES
    allowed = set(EDGES)
    assert all(w[0] == 1968 and all(e in allowed for e in itertools.pairwise(w)) for w in walks[1:])
    assert graph.random_walks(g, "k").where("k = 2").count() == 0
    assert graph.all_nodes(g, "k").where("k = 1").count() == 7


def test_reachability_against_search():
    r = random.Random(3)
    for _ in range(50):
        n = r.randint(1, 15)
        succ = {i: sorted({r.randrange(n) for _ in range(r.randint(0, 3))}) for i in range(n)}
        got = graph.descendants(succ)
        for i in range(n):
            seen, todo = set(), [i]
            while todo:
                for m in succ[todo.pop()]:
                    if m not in seen:
                        seen.add(m)
                        todo.append(m)
            assert got[i] == len(seen - {i})


def test_ranks_ties_and_auc(spark):
    pos = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.9), ("b", 1, None), ("c", 1, 0.1)], "key string, idx int, sim double")
    neg = spark.createDataFrame([("a", 0.5), ("a", 0.4), ("a", 0.7), ("b", 0.0)], "key string, sim double")
    rank = lambda t: {r["key"]: r["rank"] for r in metrics.ranks(pos, neg, ["key"], t).collect()}
    assert rank("min") == {"a": 3, "b": 2} and rank("max") == {"a": 2, "b": 2}
    r = random.Random(1)
    rows = [(r.randint(0, 5) / 5, r.randint(0, 1)) for _ in range(60)]
    p, n = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in p for b in n) / (len(p) * len(n))
    df = spark.createDataFrame(rows, "sim double, label int")
    assert metrics.auc(df, []).first()["auc"] == pytest.approx(want)
    assert metrics.auc(df.withColumn("sim", -F.col("sim")), []).first()["auc"] == pytest.approx(1 - want)
    assert metrics.auc(df.where("label = 1"), []).first()["auc"] is None
    table = metrics.ranking_table(metrics.ranks(pos, neg, ["key"]), pos, []).first()
    assert [table[f"recall_at_{k}"] for k in metrics.RECALL_AT] == sorted(table[f"recall_at_{k}"] for k in metrics.RECALL_AT)


# Rank lists and the mean reciprocal ranks at 10 that belong to them.
RANK_LISTS = {"59;23;1;12": 0.25, "82;28;523;9": 0.027777777777777776, "24;1;1;8": 0.53125, "537;62;1;12": 0.25, "7;2;3;58;51;142;17;1;18": 0.21957671957671956}


def test_rank_lists(spark):
    rows = [(k, i, int(x)) for k in RANK_LISTS for i, x in enumerate(k.split(";"))]
    got = metrics.rank_lists(spark.createDataFrame(rows, "cell string, i int, rank int"), ["cell"], "i").collect()
    assert {r["ranks"]: pytest.approx(r["mrr_at_10"]) for r in got} == RANK_LISTS and all(r["cell"] == r["ranks"] for r in got)


def test_pair_invariants(spark):
    r = random.Random(2)
    rows = [(i, "p", "l", f"f{r.randint(0, 5)}", r.choice(["x", "arm"]), r.choice(["32", "64"]), "gcc", "5", r.choice(["O0", "O1"])) for i in range(120)]
    df = spark.createDataFrame(rows, "func_id bigint, project string, library string, func_name string, arch string, bit string, compiler string, version string, optimizations string")
    by = {x[0]: x for x in rows}
    for task, rule in pairs.TASKS.items():
        got = [(x["func_id_1"], x["func_id_2"]) for x in pairs.positives(df, task).collect()]
        fits = lambda a, b: a[3] == b[3] and all(e is None or (a[4 + i] == b[4 + i]) == e for i, e in enumerate(rule))  # noqa: B023, E731
        assert sorted(got) == sorted((a, b) for a in by for b in by if a < b and fits(by[a], by[b]))
    pool = curate.numbered(df, ["func_id"])
    assert [x["idx"] for x in pool.orderBy("func_id").collect()] == list(range(120))
    neg = pairs.negatives(pool, pool, "XM", count=3).collect()
    assert len(neg) == 360 and all(by[x["func_id_1"]][3] != by[x["func_id_2"]][3] for x in neg)
    assert pairs.negatives(pool.limit(0), pool.limit(0), "XM").count() == 0
    assert pairs.sample(pairs.positives(df, "XM"), 7, 1, ["func_id_1", "func_id_2"]).count() == 7


def test_keep_first_and_audits(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, None), (5, None), (4, "b")], "i int, h string")
    assert sorted(x["i"] for x in curate.keep_first(df, ["h"], ["i"]).collect()) == [1, 2, 4]
    assert {x["column"]: x["nulls"] for x in curate.null_audit(df).collect()} == {"i": 0, "h": 2}
    assert curate.same_keys(df, df.where("i < 4"), ["i"]).count() == 2


def test_similarities(spark):
    r = np.random.default_rng(1)
    a, b = r.standard_normal((2, 16))
    df = spark.createDataFrame([(a.tolist(), b.tolist())], "a array<double>, b array<double>")
    x, y = F.col("a"), F.col("b")
    got = df.select(V.cosine(x, y), V.cosine(x, x), V.euclidean_similarity(x, y), V.hamming_sign(x, y), V.hamming_tanh(x, y), V.cosine(x, F.lit(None)), V.cosine(x, F.array_repeat(F.lit(0.0), 16))).first()
    want = [a @ b / np.linalg.norm(a) / np.linalg.norm(b), 1, -((a - b) ** 2).sum(), ((a > 0) == (b > 0)).mean(), (np.tanh(a) * np.tanh(b)).mean(), 0, 0]
    assert list(got) == pytest.approx(want)


def test_networks_do_not_depend_on_the_order_of_nodes():
    r = np.random.default_rng(2)
    x, src, dst = r.standard_normal((5, 8)), np.array([0, 0, 1, 1, 2]), np.array([1, 4, 2, 3, 3])
    p = r.permutation(5)
    back = np.argsort(p)
    for shapes, f in ((models.message_shapes(8), models.embed_graph), (models.structure2vec_shapes(8), models.structure2vec)):
        w = models.drawn(shapes, 1)
        assert f(x, src, dst, w) == pytest.approx(f(x[p], back[src], back[dst], w))
    w = models.drawn(models.message_shapes(8) | {"cross": (32, 64)}, 1)
    one, two = (x, src, dst), (x[:3], src[:2], np.array([1, 2]))
    assert models.match_graphs(one, one, w) == pytest.approx(0, abs=1e-9)
    assert models.match_graphs(one, two, w) == pytest.approx(models.match_graphs(two, one, w))
    assert models.segment(x, np.array([0, 0, 2, 2, 2]), 3, "max")[1].tolist() == [0.0] * 8


def test_packed_graphs_give_what_each_graph_gives(spark):
    r = np.random.default_rng(5)
    rows = []
    for k in range(40):
        ns = r.integers(0, 30, r.integers(0, 9)).tolist()
        es = [(int(r.integers(0, 30)), int(r.integers(0, 30))) for _ in range(12)]
        rows.append((k, [*ns, None], [*es, (None, 3)], {n: r.standard_normal(8).tolist() for n in {*ns[:4], 77}}))
    rows.append((99, None, None, None))
    df = spark.createDataFrame(rows, "k int, nodes array<bigint>, edges array<struct<src:bigint,dst:bigint>>, x map<bigint,array<double>>").coalesce(1)
    for shapes, f in ((models.message_shapes(8), models.embed_graph), (models.structure2vec_shapes(8), models.structure2vec)):
        w = models.drawn(shapes, 1)
        got = {x["k"]: x["embedding"] for x in models.embed_graphs(df, "k", f, w, 8).collect()}
        for k, ns, es, x in rows:
            one = models.graph_arrays(ns, [{"src": a, "dst": b} for a, b in es or []], x or {}, 8)
            assert got[k] == pytest.approx(f(*one, w).tolist())
    assert models.embed_graphs(df.limit(0), "k", models.structure2vec, w, 8).count() == 0


def test_strands_ignore_register_names():
    s = lambda r: [{"out": r, "op": "mov", "args": ["a"], "effect": False}, {"out": "z", "op": "add", "args": [r, "0x10"], "effect": True}]
    assert list(strands.strands_of(s("q"))) == list(strands.strands_of(s("w"))) == ["add(mov(r0),0x10)"]
    assert list(strands.strands_of(None)) == []
    long = [{"out": "x", "op": "add", "args": ["x", "x"], "effect": True}] * 200
    assert max(map(len, strands.strands_of(long))) < 9000
    named = lambda a, b: list(strands.strands_of([{"out": a, "op": "add", "args": [a, b], "effect": False}, {"out": a, "op": "sub", "args": [a, a], "effect": True}] * 20))
    assert named("x", "y") == named("q", "w") != named("x", "x") and any("d" in t for t in named("x", "y"))
