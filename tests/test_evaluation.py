"""Evaluation operators on hand-made rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from embervane.functions import vectors as V
from embervane.operators import compression as C, probe as P, prototypes as O, results as R, retrieval as T, structured as S, targets as G
from embervane.sources import datasets as D, extractors as X
from embervane.streaming import monitor as M


def test_retrieval_metrics(spark):
    q = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "q bigint, vec array<double>")
    g = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.7, 0.7]), (2, [0.0, 1.0])], "g bigint, vec array<double>")
    rel = spark.createDataFrame([(0, 0, 3.0), (0, 1, 1.0), (1, 2, 2.0)], "q bigint, g bigint, grade double")
    m = T.mean_metrics(T.query_metrics(T.ranks(q, g, rel), ks=(1, 2))).first()
    assert m["ndcg_1"] == m["hit_1"] == m["recall_2"] == m["map"] == 1
    huge = spark.createDataFrame([(0, 0, 1024.0), (0, 1, 1023.0)], "q bigint, g bigint, grade double")
    assert T.query_metrics(T.ranks(q, g, huge), ks=(2,)).first()["ndcg_2"] == pytest.approx(1)
    none = T.ranks(q, g, rel, exclusions=rel.select("q", "g"))
    assert none.count() == 0
    assert T.query_scores(q, g, huge.unionByName(rel.where("q = 1")), ks=(2,)).where("q = 0").first()["ndcg_2"] == pytest.approx(1)
    excluded = spark.createDataFrame([(1, 2)], "q bigint, g bigint")
    with pytest.raises(Exception, match="no positive left"):
        T.query_scores(q, g, rel, excluded, ks=(1,)).collect()
    for a, b in ((1e-300, 2e-300), (5e307, 1e308), (0.5, 0.7)):
        # the lower grade is ranked first
        tiny = spark.createDataFrame([(0, 0, a), (0, 1, b)], "q bigint, g bigint, grade double")
        for m in (T.query_metrics(T.ranks(q, g, tiny, metric="dot"), ks=(2,)), T.query_scores(q.where("q = 0"), g, tiny, ks=(2,), metric="dot")):
            assert 0 < m.first()["ndcg_2"] < 1


def test_both_ways_give_the_same_metrics(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x, y = rng.normal(size=(9, 4)).round(1), rng.normal(size=(50, 4)).round(1)
    y[5] = y[6]
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "q bigint, vec array<double>").withColumn("grade", F.lit("clash"))
    g = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "g bigint, vec array<double>").repartition(3).withColumn("q", F.lit("clash"))
    rel = spark.createDataFrame([(i, int(j), float(rng.integers(0, 4))) for i in range(9) for j in rng.choice(60, 12, replace=False)] + [(i, 3, 1.0) for i in range(9)], "q bigint, g bigint, grade double").dropDuplicates(["q", "g"])
    ex = spark.createDataFrame([(i, int(j)) for i in range(9) for j in rng.choice([k for k in range(60) if k != 3], 6)], "q bigint, g bigint").distinct()
    rounded = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(sorted(df.columns)).collect())
    for metric in ("cosine", "squared_l2"):
        near = rounded(T.query_scores(q, g, rel, ex, ks=(1, 5), metric=metric, exclude_self=True))
        with monkeypatch.context() as m:
            m.setattr(T, "GALLERY_VALUES", 1)
            assert rounded(T.query_scores(q, g, rel, ex, ks=(1, 5), metric=metric, exclude_self=True)) == near
    rows = spark.createDataFrame([(i, "ab"[i % 2], v.tolist()) for i, v in enumerate(y)] + [(99, None, [1.0, 0.0, 0.0, 0.0])], "row_id bigint, label string, vec array<double>")
    near = rounded(T.label_scores(rows, ks=(3,)))
    assert len(near) == 50
    monkeypatch.setattr(T, "GALLERY_VALUES", 1)
    assert rounded(T.label_scores(rows, ks=(3,))) == near


def test_ranks_match_brute_force(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(12, 4)).round(1), rng.normal(size=(40, 4)).round(1)
    y[5] = y[6]
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "q bigint, vec array<double>")
    g = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "g bigint, vec array<double>").repartition(3)
    rel = spark.createDataFrame([(i, int(j), 1.0) for i in range(12) for j in rng.choice(40, 5, replace=False)], "q bigint, g bigint, grade double")
    for metric in ("dot", "cosine", "squared_l2"):
        s = x @ y.T
        if metric == "cosine":
            s = s / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(y, axis=1)
        if metric == "squared_l2":
            s = -((x[:, None] - y[None]) ** 2).sum(2)
        s = s.round(10)
        for r in T.ranks(q, g, rel, metric=metric).collect():
            assert r["rank"] == 1 + sum((s[r.q, j], -j) > (s[r.q, r.g], -r.g) for j in range(40))


def test_zero_shot_tie_and_summary(spark):
    s = spark.createDataFrame([(0, "a", [1.0, 1.0]), (1, "b", [-1.0, 1.0]), (2, "a", [1.0, 0.1])], "row_id bigint, label string, vec array<double>")
    p = O.class_prototypes(spark.createDataFrame([("a", [2.0, 0.0]), ("b", [0.0, 1.0]), ("b", [0.0, 3.0])], "label string, vec array<double>"))
    z = {r.row_id: r for r in O.zero_shot(s, p).collect()}
    assert z[0].predicted == "a" and z[0].tie and z[1].predicted == "b" and not z[2].tie
    m = O.classification_summary(O.confusion(O.zero_shot(s, p))).first()
    assert m["accuracy"] == m["macro_f1"] == 1


def test_auto_k(spark):
    c = spark.createDataFrame([("a", 100), ("b", 20), ("c", 1)], "label string, n bigint")
    assert {r.label: r.k for r in O.auto_k(c).collect()} == {"a": 10, "b": 4, "c": 1}
    c = spark.createDataFrame([("a", 8), ("b", 30)], "label string, n bigint")
    assert {r.label: r.k for r in O.auto_k(c, requested=10).collect()} == {"a": 1, "b": 6}


def test_overlap_separates(spark):
    rng = np.random.default_rng(1)
    rows = [(i, i % 2, (rng.normal(0, 0.1, 4) + (5 if i % 2 else -5)).tolist()) for i in range(60)]
    e = spark.createDataFrame(rows, "row_id bigint, label bigint, vec array<double>")
    s = O.overlap_summary(O.overlap_per_class(O.overlap_events(e, O.exemplars(e, 3)))).first()
    assert s["macro"] == s["weighted"] == 1


def test_overlap_over_all_rows(spark, tmp_path):
    from embervane.plans import evaluation

    rng = np.random.default_rng(7)
    x = rng.normal(0, 0.02, (200, 8))
    at = np.arange(200)
    x[at, (at % 2) * 4] += 1
    e = spark.createDataFrame([(int(i), v.tolist(), int(i % 2)) for i, v in zip(at, x)], "vec_id bigint, embedding array<float>, label int")
    e.write.parquet(str(tmp_path / "embeddings.parquet"))
    c = {r.label: r.vec for r in O.centroids(evaluation.emb(spark, str(tmp_path))).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert all(np.allclose(c[k], u[at % 2 == k].mean(0), atol=1e-6) for k in (0, 1))
    run = lambda name: evaluation.QUERIES[name](spark, str(tmp_path)).collect()
    assert {r.score for r in run("overlap_centroid")} == {1}
    s = run("overlap_fitted_summary")[0]
    assert s.macro == s.weighted == 1 and run("overlap_fitted_pairs") == []
    assert {r["mean"] for r in run("overlap_fitted_stability")} == {r.score for r in run("overlap_fitted_cross_fitted")} == {1}


def test_graded_retrieval_searches_all_rows(spark, tmp_path):
    from embervane.plans import evaluation

    x = np.random.default_rng(8).normal(size=(120, 6))
    spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r.q: r for r in evaluation.QUERIES["graded_retrieval_all"](spark, str(tmp_path)).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in (0, 50, 100):
        order = [int(g) for g in np.argsort(-(u @ u[q])) if g != q]
        first = next(k for k, g in enumerate(order, 1) if g % 2 == q % 2)
        assert got[q].n_positive == 59 and got[q].mrr == round(1 / first, 6)
        assert got[q].precision_5 == sum(g % 2 == q % 2 for g in order[:5]) / 5


def test_warm_latency(spark):
    c = spark.createDataFrame([("a", 2, 1.0), ("a", 1, 90.0), ("a", 3, 3.0), (None, 1, 80.0), (None, 2, 2.0)], "k string, at int, v double")
    assert {(r.k, r.n, r["mean"], r.largest) for r in R.latency_profile(c, "v", ("k",), ("at",)).collect()} == {("a", 2, 2.0, 3.0), (None, 1, 2.0, 2.0)}


def test_permutation():
    for n in (1, 2, 7, 1000):
        p = [O.permuted(np.arange(n), n, seed) for seed in (1, 2)]
        assert all(sorted(x) == list(range(n)) for x in p) and (n < 1000 or (p[0] != p[1]).any())


def test_continuous_overlap(spark):
    rng = np.random.default_rng(4)
    x, noise = rng.normal(size=(600, 2)), rng.normal(size=600)
    frame = lambda y: spark.createDataFrame([(i, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y))], "row_id bigint, vec array<double>, y double").repartition(3)
    told = O.continuous_overlap(frame(1e6 + x[:, 0]), normalize=False).first()
    assert told.n == 600 and told.n_prototypes == 24 and told.score > 0.8
    assert told.null_loss == pytest.approx(x[:, 0].var() * (1 - 23 / 599), rel=0.02)
    assert O.continuous_overlap(frame(noise)).first().score < 0.1
    assert O.continuous_overlap(frame(np.ones(600))).first().score is None
    y = np.repeat([0.0, 1.0, 9.0], 20)
    three = [(i, [float(i // 20), 0.0], float(t)) for i, t in enumerate(y)]
    r = O.continuous_overlap(spark.createDataFrame(three, "row_id bigint, vec array<double>, y double"), k=3, normalize=False).first()
    assert (r.n_prototypes, r.loss, r.score) == (3, 0, 1)


def test_overlap_continuous_reads_the_vectors(spark, tmp_path):
    from embervane.plans import evaluation

    rng = np.random.default_rng(5)
    rows = [(i, 1, float(rng.integers(1, 51)), float(rng.integers(0, 11)) / 100, float(rng.integers(0, 9)) / 100, float(np.exp(rng.normal(8, 2)))) for i in range(1000)]
    li = spark.createDataFrame(rows, "l_orderkey bigint, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_extendedprice double")
    li.write.parquet(str(tmp_path / "lineitem.parquet"))
    li.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_extendedprice").alias("o_totalprice")).write.parquet(str(tmp_path / "orders.parquet"))
    assert evaluation.QUERIES["overlap_continuous"](spark, str(tmp_path)).first()["score"] < 0.1


def test_quantize_and_pca(spark):
    x = np.random.default_rng(2).normal(size=(50, 5))
    x[:, 4] = 0
    e = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id bigint, vec array<double>")
    for how, step in (("int8", np.abs(x).max(0) / 127), ("uint8", np.ptp(x, axis=0) / 255)):
        q = np.array([r.vec for r in C.quantize(e, how).orderBy("row_id").collect()])
        assert (np.abs(q - x) <= step / 2 + 1e-12).all()
    z = np.array([r.vec for r in C.pca(e, 2).orderBy("row_id").collect()])
    u, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(np.abs(z), np.abs(u[:, :2] * s[:2]))


def test_ridge(spark):
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist(), float(v @ [2, -1] + 3), i % 3) for i, v in enumerate(rng.normal(size=(60, 2)))]
    e = spark.createDataFrame(rows, "row_id bigint, vec array<double>, target double, fold int")
    assert P.regression_metrics(P.ridge_out_of_fold(e, 3, alpha=1e-9)).first()["r2"] == pytest.approx(1)
    two = e.withColumn("target", F.array("target", -F.col("target"))).repartition(7)
    for r in P.ridge_out_of_fold(two, 3, alpha=1e-9).collect():
        assert np.allclose(r.predicted, r.target) and np.isclose(r.predicted[0], -r.predicted[1])
    with pytest.raises(ValueError, match="two folds"):
        P.ridge_out_of_fold(e.withColumn("fold", F.lit(0)), 1)


def test_subsample_and_folds(spark):
    df = spark.range(100).select(F.col("id"), F.when(F.col("id") < 90, "big").otherwise("small").alias("label"))
    n = {r.label: r.n for r in G.class_counts(G.stratified_subsample(df, "id", "label", 0.1, 5), "label").collect()}
    assert n == {"big": 9, "small": 5}
    f = G.folds(df, "id", "label", 5)
    assert {r["n"] for r in f.where("label = 'big'").groupBy("fold").agg(F.count("id").alias("n")).collect()} == {18}
    r = G.hash_rank(df, ["label"], "id")
    assert sorted(x["_rank"] for x in r.where("label = 'big'").collect()) == list(range(1, 91))


def test_segmentation_and_units(spark):
    px = spark.createDataFrame([(0, r, c, 0 if c < 2 else 1, 7) for r in range(4) for c in range(4)], "img int, r int, c int, label int, instance int")
    t = {(x.i, x.j): x for x in S.grid_tokens(px, 4, 4, 2, 2).collect()}
    assert len(t) == 4 and t[0, 0].label == 0 and t[0, 1].label == 1 and t[0, 0].dropped is None
    u = S.explode_units(spark.createDataFrame([("p", ["a", "b", "c"], ["x"]), ("q", None, None)], "p string, l array<string>, i array<string>"), "p", "l", uid="i")
    assert [(r.position, r.uid) for r in u.orderBy("position").collect()] == [(0, "x"), (1, None), (2, None)]
    assert [r.label for r in S.drop_special(u, 1, 1).collect()] == ["b"]


def test_vectors(spark):
    r = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>").select(V.norm(F.col("a")).alias("n"), V.unit(F.col("b")).alias("z"), V.cosine(F.col("a"), F.col("b")).alias("c"), V.valid(F.col("a"), 3).alias("v"), V.compose(F.col("a"), F.col("b"), "average").alias("m")).first()
    assert (r.n, r.z, r.c, r.v, r.m) == (5.0, [0.0, 0.0], None, False, [1.5, 2.0])
    with pytest.raises(ValueError):
        V.compose(F.col("a"), F.col("b"), "sum")


def test_datasets(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0], "a"), (2, [2.0], "b")], "row_id bigint, vec array<double>, label string")
    d = D.Dataset(rows)
    assert d.identity() == D.Dataset(rows.orderBy(F.desc("row_id"))).identity()
    assert d.subset(spark.createDataFrame([(2,)], "row_id bigint")).rows.count() == 1
    D.write_artifact(rows, str(tmp_path / "art"), {"a": 1})
    back, meta = D.read_artifact(spark, str(tmp_path / "art"))
    assert back.count() == 2 and meta == {"a": 1, "n_rows": 2}
    with pytest.raises(ValueError):
        D.write_artifact(rows.unionByName(rows), str(tmp_path / "bad"), {})
    assert len({D.exact_hash(1), D.exact_hash("1"), D.exact_hash(True)}) == 3
    assert "| row_id |" in D.markdown(rows, "x")
    with pytest.raises(ValueError):
        D.prompts(rows, ["{label} {other}"])


def test_extractor_contract(spark):
    rows = spark.createDataFrame([(1, "ab"), (2, "c")], "id bigint, t string")
    assert {r.id: r.vec for r in X.call(rows, lambda s: np.array([[len(t)] for t in s]), "t").collect()} == {1: [2.0], 2: [1.0]}
    with pytest.raises(Exception, match="shape"):
        X.call(rows, lambda s: np.zeros(3), "t").collect()


def test_history_and_stream(spark, tmp_path):
    rec = spark.sql("select 's' as stream, 1L as evaluation_index, 'success' as status, timestamp'2025-01-01' as recorded_at, 'm' as metric, 0.5D as value")
    path = str(tmp_path / "h")
    M.append(path, rec)
    M.append(path, rec)
    M.append(path, rec.withColumn("evaluation_index", F.lit(2).cast("bigint")))
    h = spark.read.parquet(path)
    assert h.count() == 2 and M.latest(h).first()["evaluation_index"] == 2
    rec.select("stream", "metric", "value", "recorded_at").unionByName(rec.select("stream", "metric", "value", F.expr("recorded_at + interval 3 days").alias("recorded_at"))).write.json(str(tmp_path / "in"))
    q = M.follow(spark, str(tmp_path / "in"), "stream string, metric string, value double, recorded_at timestamp", str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).first()["mean"] == 0.5


def test_ranking(spark):
    r = spark.createDataFrame([(1, 0.9), (2, None), (3, 0.895), (4, 0.1)], "id bigint, s double").withColumn("k", F.lit("d"))
    assert [x.id for x in R.ranked(r, "s", "id").orderBy("place").collect()] == [1, 3, 4]
    assert {x.id for x in R.cohort(r, "s", ("k",)).collect()} == {1, 3}


def test_entry_without_llm():
    import ast
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent / "embervane"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts[0]:
            for node in ast.walk(ast.parse(p.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any(n.startswith("embervane.llm") for n in names), p
