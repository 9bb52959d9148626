"""Operators of the llm subpackage against brute force on small fixtures with dirt of every kind."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from embervane.llm import calibration as C, grouping as G, leakage as L, mixing as M, neighbours as N, truncation as T
from embervane.llm.graph import PrunedGraph
from embervane.session import Scratch

# --- calibrated samples ---


def plan_of(spark):
    ann = [("p1", "d", ["A", " a ", "b", None, ""]), ("p1", "d", ["A", " a ", "b", None, ""]), ("p2", "d", ["b\t"] * 30), ("p3", "d", None), ("p4", "d", []), (None, "d", ["c"] * 3), ("p5", None, ["a"])]
    u = C.units(spark.createDataFrame(ann, "parent_id string, dataset_key string, labels array<string>").withColumn("label", F.lit("clash")))
    t = spark.createDataFrame([("d", "a", 50, 1), ("d", "B", 40, 20), ("d", "c", 10, 2), ("d", "never", 0, 1), ("d", None, 1, 1), ("x", "a", 100, 0)], "dataset_key string, label string, target_percent int, min_samples int")
    r = spark.createDataFrame([(1, "d", 10), (1, "d", 10), (2, "d", None), (3, "none", 5), (4, "d", 0), (None, "d", 3)], "result_id bigint, dataset_key string, draw_size bigint")
    return C.calibrate(r, t, C.supply(u)), u


def test_calibration(spark):
    plan, u = plan_of(spark)
    rows = {(r.result_id, r.cat): r for r in plan.collect()}
    assert {k[0] for k in rows} == {1, 4}
    assert (rows[1, "a"].supply, rows[1, "b"].supply, rows[1, "c"].supply, rows[1, "never"].supply) == (2, 31, 3, 0)
    assert (rows[1, "a"].demand, rows[1, "b"].demand) == (5, 20)
    assert {tuple(r) for r in C.shortfalls(plan).where("result_id = 1").collect()} == {(1, "a"), (1, "never")}
    for block in (1000, 7):
        s = C.draw(plan, u, block_units=block)
        assert s.count() == s.distinct().count()
        n = {(r.result_id, r.cat): r.n for r in s.groupBy("result_id", "cat").agg(F.count("cat").alias("n")).collect()}
        for k, r in rows.items():
            assert abs(n.get(k, 0) - r.expected) < 1
        assert n[1, "b"] >= 20  # a minimum holds in the sample


def test_tilt_meets_shares():
    d, dual, _ = C.tilt(100, np.array([50.0, 30, 20]), np.array([0.0, 0, 40]), np.array([30.0, 1000, 50]))
    assert d.sum() == pytest.approx(100) and d.tolist() == pytest.approx([30, 30, 40])
    d, _, rest = C.tilt(10, np.array([5.0, 5]), np.zeros(2), np.array([3.0, 4]))
    assert d.tolist() == pytest.approx([3, 4]) and rest.tolist() == [2, 1]
    assert C.tilt(0, np.zeros(1), np.zeros(1), np.zeros(1))[0].tolist() == [0]


def test_tilt_below_every_breakpoint():
    # minimums that take most of the size push a large category without a minimum far below its share
    d, _, rest = C.tilt(100, np.array([90.0, 10]), np.array([0.0, 60]), np.array([100_000.0, 80]))
    assert d.tolist() == pytest.approx([40, 60]) and not rest.any()
    rng = np.random.default_rng(11)
    for _ in range(300):
        n = rng.integers(1, 8)
        share, floor, stock = rng.random(n) * 50 * rng.integers(0, 2, n), np.floor(rng.random(n) * 30) * rng.integers(0, 2, n), np.floor(rng.random(n) ** 4 * 10_000)
        size = float(rng.integers(0, 200))
        low = np.minimum(floor, stock)
        assert C.tilt(size, share, floor, stock)[0].sum() == pytest.approx(np.clip(size, low.sum(), np.where(share > 0, stock, low).sum()), abs=1e-6)


def test_report_counts_what_is_lacking(spark):
    u = C.units(spark.createDataFrame([("p", "d", ["a"] * 500 + ["b"] * 80)], "parent_id string, dataset_key string, labels array<string>"))
    t = spark.createDataFrame([("d", "a", 90, 0), ("d", "b", 10, 60)], "dataset_key string, label string, target_percent int, min_samples int")
    plan = C.calibrate(spark.createDataFrame([(1, "d", 100), (2, "d", 1000)], "result_id bigint, dataset_key string, draw_size bigint"), t, C.supply(u)).cache()
    for units_, rest in ((100_000, 1024), (20, 2)):
        old, C.REST_BLOCKS = C.REST_BLOCKS, rest
        try:
            s = C.draw(plan, u, block_units=units_).cache()
        finally:
            C.REST_BLOCKS = old
        assert s.count() == s.distinct().count() == 680
        rows = {(r.result_id, r.label): (r.drawn, r.gap, r.unreachable) for r in C.report(plan, s).collect()}
        assert rows == {(1, "a"): (40, 50, 0), (1, "b"): (60, 0, 0), (2, "a"): (500, 400, 400), (2, "b"): (80, 20, 20)}
        assert all(r.within_one and r.n_drawn == r.n_expected for r in C.totals(plan, s).collect())
    empty = C.draw(plan.limit(0), u.limit(0))
    assert empty.count() == 0 and C.report(plan.limit(0), empty).count() == 0


def test_pivotal_keeps_totals():
    rng = np.random.default_rng(0)
    p = np.full(40, 0.25)
    hits = np.zeros(40)
    for _ in range(2000):
        q = C._duel(p.copy(), rng)
        assert set(np.round(q, 9)) <= {0.0, 1.0} and q.sum() == pytest.approx(10)
        hits += q
    assert abs(hits / 2000 - 0.25).max() < 0.06


# --- neighbours ---


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[100] = x[7] * 3
    x[101] = x[7] + 0.01
    rows = [(i, "o", v.tolist()) for i, v in enumerate(x)] + [(7, "o", x[7].tolist()), (2000, "o", None), (2001, "o", [1.0]), (2002, "o", [0.0] * 16), (2003, "o", [float("nan")] * 16), (2004, None, x[7].tolist()), (2005, "o", [None] * 16), (2006, "z", x[7].tolist())]
    t = spark.createDataFrame(rows, "token_id bigint, output_name string, embeddings array<float>").withColumn("vec", F.lit("clash"))
    o = spark.createDataFrame([("o", 16), ("p", 3)], "output_name string, embedding_dim int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    want = {(i, j) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(s >= 0.95))) if i < j}
    for how in ({"shard_rows": 30_000}, {"shard_rows": 300}, {"shard_rows": 60, "one_level": 4}, {"shard_rows": 60, "most": 5}):
        got = [tuple(r) for r in N.similar_pairs(t, o, **how).collect()]
        assert len(got) == len(set(got)) and set(got) == want
        near = N.nearest(t, o, k=5, every=50, **how).collect()
        np.fill_diagonal(s, -2)
        hit = [r.neighbour_id in set(np.argsort(-s[r.token_id])[:5].tolist()) for r in near]
        assert len(hit) == 30 * 5 and np.mean(hit) >= 0.9
    assert N.similar_pairs(t.limit(0), o).count() == 0


def test_clusters_larger_than_the_beam(spark):
    rng = np.random.default_rng(6)
    x = (np.repeat(rng.normal(size=(3, 32)), (70, 40, 1), 0) + rng.normal(scale=0.05, size=(111, 32))).astype(np.float32)
    x[5] = x[6]
    x = np.concatenate([x, rng.normal(size=(300, 32)).astype(np.float32)])
    t = spark.createDataFrame([(i, "a", v.tolist()) for i, v in enumerate(x)], "token_id bigint, output_name string, embeddings array<float>")
    o = spark.createDataFrame([("a", 32)], "output_name string, embedding_dim int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(u @ u.T >= 0.95))) if i < j}
    assert len(want) >= 70 * 69 // 2 + 40 * 39 // 2
    got = [tuple(r) for r in N.similar_pairs(t, o).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_equal_vectors(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(200, 24)).astype(np.float32)
    hot = {i: 3 for i in range(1000, 1400)} | {2000: 5, 2050: 5, 2100: 7}  # copies of 3, 5 and 7
    rows = [(i, "o", v.tolist()) for i, v in enumerate(x)] + [(i, "o", x[j].tolist()) for i, j in hot.items()]
    rows += [(3000, "o", (x[5] + 0.01).tolist())]
    t = spark.createDataFrame([*rows, rows[5], (4000, "p", x[3].tolist())], "token_id bigint, output_name string, embeddings array<float>")
    o = spark.createDataFrame([("o", 24), ("p", 24)], "output_name string, embedding_dim int")
    for how in ({}, {"shard_rows": 40}):
        pairs = [tuple(r) for r in N.similar_pairs(t, o, **how).collect()]
        assert len(pairs) == len(set(pairs))
        small = {(5, 2000), (5, 2050), (2000, 2050), (7, 2100), (5, 3000), (2000, 3000), (2050, 3000)}
        assert set(pairs) == small | {(3, i) for i in range(1000, 1400)}  # the large group by its lowest id
        near = {}
        for r in sorted(N.nearest(t, o, k=4, every=50, **how).collect(), key=lambda r: r["rank"]):
            near.setdefault(r.token_id, []).append(r.neighbour_id)
        assert near[1050] == [3, 1000, 1001, 1002] and near[1000] == [3, 1001, 1002, 1003]
        assert near[2000][:3] == [5, 2050, 3000] and near[2100][0] == 7 and near[2000] != near[0]
        assert set(near) == {0, 50, 100, 150, *range(1000, 1400, 50), 2000, 2050, 2100, 3000}


def test_pairs_below_two_levels_send_few_copies(spark):
    rng = np.random.default_rng(21)
    centres = rng.normal(size=(16, 48))
    x = 0.65 * (centres / np.linalg.norm(centres, axis=1, keepdims=True))[rng.integers(0, 16, 5000)] + rng.normal(scale=0.11, size=(5000, 48))
    x[:1000] = x[1000:2000] + rng.normal(size=(1000, 48)) * rng.uniform(0, 0.045, size=(1000, 1))  # on either side of the limit
    x = x.astype(np.float32)
    how = {"shard_rows": 20, "one_level": 16}
    t = spark.createDataFrame([(i, "o", v.tolist()) for i, v in enumerate(x)], "token_id bigint, output_name string, embeddings array<float>").cache()
    shards = N.fit_shards(t, {"o": 5000}, **how)
    assert len(shards["o"].tops) == 16 and shards["o"].first[-1] > 60
    assert N.route(t.withColumn("ask", F.lit(False)), shards, least=0.95).count() <= 2 * 5000
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    sure = {(i, j) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(s >= 0.95 + 1e-6))) if i < j}
    got = [tuple(r) for r in N.similar_pairs(t, spark.createDataFrame([("o", 48)], "output_name string, embedding_dim int"), **how).collect()]
    assert len(sure) > 300 and len(got) == len(set(got))
    assert sure <= set(got) and all(s[p] >= 0.95 - 1e-6 for p in got)


def test_reach_finds_every_partner():
    rng = np.random.default_rng(13)
    x = rng.normal(size=(3000, 6)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tops = N._kmeans(x, 12)
    for cells in (N.Cells(tops, [tops[j : j + 1] for j in range(12)]), N.Cells(tops, [N._kmeans(x[(x @ tops.T).argmax(1) == j], 5) for j in range(12)])):
        top, own, s = cells.home(x)
        row, shard = cells.reach(x, top, s, np.sqrt(2 - 2 * 0.95))
        visits = set(zip(row.tolist(), shard.tolist()))
        a, b = np.nonzero(x @ x.T >= 0.95)
        assert all((i, own[j]) in visits or (j, own[i]) in visits for i, j in zip(a.tolist(), b.tolist()))
        assert len(visits) < 0.8 * len(x) * cells.first[-1]


def test_graph_recall_and_degenerate():
    x = np.random.default_rng(5).normal(size=(3000, 24)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = PrunedGraph(x)
    ids, sims = g.search(x[:200], 32)
    true = np.argsort(-(x[:200] @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(b)) / 10 for a, b in zip(ids, true)]) > 0.9
    assert PrunedGraph(x[:1]).search(x[:1], 4)[0][0].tolist() == [0, -1, -1, -1]
    same = PrunedGraph(np.repeat(x[:1], 300, 0))
    assert len(set(same.search(x[:1], 16)[0][0].tolist()) - {-1}) > 1


# --- connected splits ---


def components_of(edges):
    label = {}

    def find(a):
        while label.setdefault(a, a) != a:
            a = label[a]
        return a

    for a, b in edges:
        x, y = find(a), find(b)
        label[max(x, y)] = min(x, y)
    return {a: find(a) for a in label}


@pytest.mark.parametrize("small", [1_000_000, 3])
def test_components(spark, small):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(5, 5), (1, 0)]
    df = spark.createDataFrame([*edges, (None, 3)], "u bigint, v bigint")
    got = {r.node: r.label for r in G.components(df, Scratch(spark), small_graph=small, depth=2).collect()}
    assert got == components_of([e for e in edges if e[0] != e[1]])


def test_related_sets_and_splits(spark):
    rows = [
        (1, "d", ["author:x", None]), (2, "d", [" AUTHOR : X ", "source:s"]), (3, "d", ["source:S"]), (4, "d", ["source:x"]), (5, "e", ["author:x"]),
        (6, "d", ["author:unknown"]), (7, "d", ["author: UNKNOWN "]), (8, "d", None), (9, "d", []), (10, None, ["author:q"]), (11, None, ["author:q"]), (1, "d", ["author:x", None]), (12, "d", ["noise"]), (13, "d", ["noise"]),
    ]
    df = spark.createDataFrame(rows, "sample_id bigint, dataset_key string, groups array<string>").withColumn("label", F.lit("clash"))
    rel = G.related_sets(df).cache()
    got = {r.sample_id: r.component for r in rel.collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8, 9: 9, 10: 10, 11: 10, 12: 12, 13: 13}
    t = spark.createDataFrame([("train", 0.8), ("test", 0.2), ("none", 0.0), (None, 1.0)], "split_name string, target_share double")
    many = spark.range(3000).select(F.col("id").alias("sample_id"), F.lit("d").alias("dataset_key"), (F.col("id") - F.col("id") % 3).alias("component"))
    s = G.assign_splits(many, t)
    assert s.groupBy("component").agg(F.count_distinct("split_name").alias("n")).where("n > 1").count() == 0
    n = {r.split_name: r.n for r in s.groupBy("split_name").agg(F.count("split_name").alias("n")).collect()}
    assert set(n) == {"train", "test"} and abs(n["train"] - 2400) <= 3
    assert G.related_sets(df.limit(0)).count() == 0


# --- leakage ---


def test_leaks(spark):
    w = [f"word{i}" for i in range(40)]
    item = "Read the passage. " + " ".join(w) + "."
    items = spark.createDataFrame([(1, item), (2, "Read the passage. Short one."), (3, None), (1, item)], "item_id bigint, text string").withColumn("task", F.lit("t"))
    docs = [
        (1, "intro " + " ".join(w[3:15]) + " outro"), (2, "x " + " ".join(w[3:14]) + " outro"), (3, None), (4, ""), (5, "<b>" + "​</b>, ".join(x.upper() for x in w[20:36])),
        (6, " ".join(w[:11]) + " gap " + " ".join(w[11:22])), (7, "Read the passage. " * 40), (8, "filler " * 50_000 + "\n> ".join(w[5:18])), (1, "intro " + " ".join(w[3:15]) + " outro"),
    ]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit("clash"))
    for bits in (1 << 24, 1 << 15):
        got = L.leaks(d, items, bits=bits).cache()
        assert {(r.doc_id, r.item_id) for r in got.collect()} == {(1, 1), (5, 1), (8, 1)}
    assert {r.item_id: r.n_docs for r in L.leaked_items(got, items).where("item_id < 3").collect()} == {1: 3, 2: 0}
    assert L.leaks(d.limit(0), items).count() == 0 and L.leaks(d, items.limit(0)).count() == 0


def test_multi_index_finds_all_within_radius(spark):
    rng = np.random.default_rng(7)
    own = spark.createDataFrame([(1, [f"a{i}" for i in range(60)])], "item_id bigint, words array<string>")
    items = L.item_windows(own).cache()
    prints = {r.start: r.print for r in items.collect()}
    assert len(prints) == 49
    rows = []
    for k, p in prints.items():
        near, far = np.int64(p).view(np.uint64), np.int64(p).view(np.uint64)
        for bit in rng.choice(64, 3, replace=False):
            near ^= np.uint64(1) << np.uint64(bit)
        for bit in rng.choice(64, 4, replace=False):
            far ^= np.uint64(1) << np.uint64(bit)
        rows += [(k, int(near.view(np.int64)), True), (k, int(far.view(np.int64)), False)]
    got = L.candidates(spark.createDataFrame(rows, "k bigint, print bigint, near boolean"), items).where("k = start").select("k", "near").collect()
    assert sorted(got) == [(k, True) for k in sorted(prints)]  # each once, and none beyond the radius


def test_openings_that_items_share(spark):
    rule, half = "Read the report; decide which of the claims holds.", "Look at this:"
    items = [(1, f"{rule} Alpha beta."), (2, f"{rule} Gamma."), (3, f"{half} delta."), (4, f"{half} epsilon! Zeta."), (5, "Own opening. Eta."), (6, "Own opening. Eta."), (6, "Own opening. Eta."), (7, None), (8, "")]
    own = L.own_words(spark.createDataFrame(items, "item_id bigint, text string"))
    got = {r.item_id: " ".join(r.words) for r in own.collect()}
    assert got == {1: "alpha beta", 2: "gamma", 3: "delta", 4: "epsilon zeta", 5: "eta", 6: "eta", 8: ""}


def test_near_windows_by_weighted_shingles(spark):
    w = [f"w{i}" for i in range(12)]
    items = spark.createDataFrame([(1, " ".join(w))], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, " ".join([*w[:11], "other"])), (2, "none of these words is in any of the items at all indeed")], "doc_id bigint, text string")
    wide = L.candidates(L.document_windows(docs, L.shingle_filter(L.own_words(items)), 0.5), L.item_windows(L.own_words(items)), 3)
    assert {r.doc_id for r in wide.collect()} <= {1}
    assert L.similarity(w, [*w[:11], "other"], {}) == pytest.approx(7 / 9)
    assert L.similarity(w, w, {"w0 w1 w2 w3 w4": 0.5}) == 1


# --- mixing ---


def test_mixing(spark):
    docs = [(i, "one two three four", "Big-Source ") for i in range(50)] + [(100 + i, "one two", "small") for i in range(5)] + [(200, None, "small"), (201, "x", None), (0, "one two three four", "big source"), (None, "y", "small")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    c = M.token_counts(d).cache()
    assert c.agg(F.sum("tokens")).first()[0] == 210 and c.where("doc_id = 200").first()["tokens"] == 0
    t = spark.createDataFrame([("m", 1.0, "BIG_source", 0.5, 1), ("m", 1.0, "small", 0.3, 3), ("m", 1.0, "absent", 0.2, 2), ("e", 0.1, "big source", 1.0, None), (None, 1.0, "small", 1.0, 1)], "mix_id string, size_factor double, source string, target_weight double, max_repeats int")
    plan = M.mix_plan(c, t).cache()
    assert {tuple(r) for r in M.short_sources(plan).collect()} == {("m", "small"), ("m", "absent"), ("e", "big_source")}
    mix = M.realise(c, plan).cache()
    assert mix.groupBy("mix_id", "doc_id").count().where("count > 1").count() == 0
    rep = {r.source: r for r in M.mix_report(plan, mix).where("mix_id = 'm'").collect()}
    assert rep["small"].given == 30 and rep["small"].most_copies == 3 and rep["absent"].given == 0
    assert 105 <= rep["big_source"].given < 109
    assert rep["big_source"].exponent == 1 and 0 < rep["small"].exponent < 1 and rep["absent"].exponent == 0
    given = sum(r.given for r in rep.values())
    assert rep["small"].share_of_mix == pytest.approx(30 / given, abs=1e-6) and rep["small"].share_of_size == pytest.approx(30 / 210, abs=1e-6)
    assert M.mix_plan(c, t.limit(0)).count() == 0 and M.mix_report(plan, M.realise(c.limit(0), plan)).where("given > 0").count() == 0


def test_tempering_stops_at_the_limit():
    assert M.exponents([(0.5, 0.5, 100.0), (0.5, 0.5, 100.0)], 100) == [(1.0, 0.5), (1.0, 0.5)]
    (a1, w1), (a2, w2) = M.exponents([(0.9, 0.5, 90.0), (0.1, 0.5, 20.0)], 100)
    assert a1 == 1 and w1 == 0.5 and 0 < a2 < 1 and w2 == pytest.approx(0.2)
    (a, w), _ = M.exponents([(0.9, 0.8, 50.0), (0.1, 0.2, 90.0)], 100)  # even its natural share is too much
    assert a == 0 and w == pytest.approx(0.5)
    assert M.exponents([(0.0, 0.5, 0.0), (1.0, 0.5, 900.0)], 100) == [(0.0, 0.0), (1.0, 0.5)]
    assert M.exponents([(1.0, 0.0, 5.0)], 100) == [(1.0, 0.0)]


# --- truncation ---


def corpus(rng, n):
    """Texts with all the endings that authors give them."""
    verbs, things, ends = ["rerun", "check", "compare", "drop"], ["probe", "split", "cache", "gallery"], ["by hand", "over the weekend", "in two passes"]
    entry = lambda: f"- {rng.choice(verbs)} the {rng.choice(things)} {rng.choice(ends)}"
    sentence = lambda: f"{rng.choice(['The run', 'A reviewer', 'Every split', 'Their margin'])} {rng.choice(['moved', 'ended', 'settled', 'recovered'])} after {rng.randint(2, 90)} epochs, {rng.choice(['and', 'but', 'while'])} the {rng.choice(things)} {rng.choice(['grew', 'shrank', 'stayed flat'])} {rng.choice(ends)}."
    prose = lambda k: "\n\n".join(" ".join(sentence() for _ in range(rng.randint(2, 5))) for _ in range(k))
    rows = lambda: "| a | b |\n|---|---|\n" + "\n".join(f"| {rng.randint(1, 9)} | {rng.randint(1, 9)} |" for _ in range(rng.randint(1, 6)))
    code = lambda: "```\n" + "\n".join(f"x{j} = {rng.randint(1, 99)}" for j in range(rng.randint(1, 6))) + "\n```"
    listed = lambda: "\n".join(entry() for _ in range(rng.randint(3, 30)))
    last = [lambda: prose(1)] * 8 + [rows, code, listed, listed, lambda: "See https://notes.example/a/1", lambda: "Regards\n" + rng.choice(["someone", "noname", "anyone"]), lambda: "</section>", lambda: "That was all. " + rng.choice(["To be continued...", "More to come..."])]
    return ["\n\n".join([prose(rng.randint(1, 3)), *(f() for f in rng.sample([rows, code, listed, lambda: prose(1)], 2)), rng.choice(last)()]) for _ in range(n)]


def test_truncation(spark):
    rng = random.Random(8)
    whole = corpus(rng, 900)
    docs = [(i, t, "notes") for i, t in enumerate(whole)] + [(3000 + i, t[: rng.randint(20, len(t) - 20)], "mail") for i, t in enumerate(corpus(rng, 60))]
    docs += [(4000 + i, t[:500], "forum") for i, t in enumerate(corpus(rng, 300))] + [(5000 + i, t, "mail") for i, t in enumerate(corpus(rng, 300))]
    body = "The run moved after 5 epochs, and the cache grew by hand. "
    cases = {
        1000: ("The run ended well. The margin of the", True), 1001: ("The run ended well.", False), 1002: (body + "\n\n- check the probe over the", True), 1003: (body + "\n\n- check the probe over the weekend", False),
        1004: (body + "\n\n- check the gall", True), 1005: ("text\n```\ncode = 1", True), 1006: ("text\n```\ncode = 1\n```", False), 1007: ("| a | b |\n|---|---|\n| 1 | 2", True), 1008: ("| a | b |\n|---|---|\n| 1 | 2 |", False),
        1010: ("All done. See https://notes.example/a/1", False), 1011: ("All done.\n\nRegards\nsomeone", False), 1012: ("All done.\n\n</section>", False), 1013: ("All done. The run moved after 12 epochs, and the cac...", True),
        1014: ("The run moved after 12 epo\ufffd", True), 1015: ("All done. To be continued...", False), 1016: ("The run moved and Tom &am", True), 1017: ("All done. The run mov...", True),
    }
    docs += [(i, t, None if i % 2 else "Mail ") for i, (t, _) in cases.items()] + [(2000, None, "notes"), (2001, "  ", "notes"), (2002, "x", "notes"), (0, whole[0], "notes"), (None, "cut in the mid", "notes")]
    s = T.scores(spark.createDataFrame(docs, "doc_id bigint, text string, source string").withColumn("length", F.lit("clash"))).cache()
    rows = {r.doc_id: r for r in s.collect()}
    got = {i: r.log_odds > 0 for i, r in rows.items()}
    assert {i: got[i] for i in cases} == {i: c for i, (_, c) in cases.items()}
    assert 2000 not in got and 2001 not in got and None not in got and sum(got[i] for i in range(900)) == 0 and not any(got[5000 + i] for i in range(300))
    cut_off = [i for i in range(60) if not docs[900 + i][1].rstrip().endswith((".", "```", "|", "weekend", "hand", "passes"))]
    assert sum(got[3000 + i] for i in cut_off) >= 0.9 * len(cut_off)
    assert rows[4000].posterior > 0.9 and rows[0].posterior == 0  # the forum's limit
    assert rows[4000].prior > rows[5000].prior + 3
    r = {x.source: x for x in T.truncation_report(s).collect()}
    assert r["notes"].n_texts == 901 and r["forum"].n_cut_at_limit >= 0.85 * 300
    assert T.scores(spark.createDataFrame([], "doc_id bigint, text string, source string")).count() == 0
    assert T.scores(spark.createDataFrame([(1, None, "a"), (2, "One text.", None)], "doc_id bigint, text string, source string")).count() == 1


def test_the_prior_of_a_limit_decides():
    import pandas as pd

    cells = pd.DataFrame([("s", 0, 0.0, "none", "prose", "point", 900), ("s", 0, 0.0, "none", "prose", "sign", 60), ("s", 0, 0.0, "none", "prose", "open", 20), ("s", 500, 0.95, "none", "prose", "open", 80), ("s", 500, 0.95, "none", "prose", "sign", 6), ("s", 500, 0.95, "none", "prose", "point", 8)], columns=["source", "at", "posterior", "mark", "form", "kind", "n"])
    cuts = pd.DataFrame([("prose", "open", 900), ("prose", "sign", 60), ("prose", "point", 10)], columns=["form", "kind", "n"])
    stops = pd.DataFrame([("prose", "point", 900), ("prose", "sign", 40)], columns=["form", "kind", "n"])
    r = {(x.at, x.kind): x.log_odds for x in T.combine(cells, cuts, stops).itertuples()}
    assert r[0, "open"] > 0 > r[0, "sign"] and r[500, "sign"] > 0 > r[500, "point"]


def test_beginnings_of_words(spark):
    vocabulary = spark.createDataFrame([("list", w) for w in ("gallery", "gall", "probe", "x" * 3000)], "form string, word string")
    asked = spark.createDataFrame([("list", w) for w in ("gal", "gall", "gallery", "galler", "prober", "g", "x" * 1500, "pro")] + [("casual", "gal")], "form string, last string")
    assert {(r.form, r.last) for r in T.beginnings(vocabulary, asked).collect()} == {("list", w) for w in ("gal", "gall", "galler", "x" * 1500, "pro")}


def test_limits(spark):
    rng = np.random.default_rng(9)
    n = np.rint(np.exp(rng.normal(6, 0.4, 4000))).astype(int)
    rows = [("s", int(min(v, 500))) for v in n] + [("t", int(v)) for v in n]
    lim = T.length_limits(spark.createDataFrame(rows, "source string, length int")).collect()
    assert [(r.source, r.length) for r in lim] == [("s", 500)] and lim[0].posterior > 0.95


def test_long_tags_inside_a_passage(spark):
    item = [f"word{i}" for i in range(16)]
    tags = ['<img alt="' + "many words " * 40 + '" src="data:image/png;base64,' + "QUJD" * 80 + '"/>', '<a hidden href=' + "x" * 300 + ">", "<!-- " + "remark " * 50 + "-->"]
    prose = " <b then " + "filler " * 60 + " > "
    docs = [(k, " ".join(item[:8]) + " " + t + " " + " ".join(item[8:])) for k, t in enumerate(tags)]
    docs += [(8, "if a" + prose.replace("filler", " ".join(item)) + "c"), (9, " ".join(item[:8]) + " plain words " + " ".join(item[8:]))]
    found = L.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string"))
    assert sorted(r.doc_id for r in found.collect()) == [0, 1, 2, 8]


def test_links_and_splits_are_not_cut(spark):
    held = spark.range(1).select(F.sequence(F.lit(1), F.lit(1_000_003)).alias("reps"))
    assert G.links(held).count() == 1_000_002
    related = spark.createDataFrame([(1, "d", 1)], "sample_id bigint, dataset_key string, component bigint")
    many = spark.range(1001).selectExpr("cast(id as string) as split_name", "1.0 as target_share")
    with pytest.raises(ValueError, match="more than 1000 splits"):
        G.assign_splits(related, many)
