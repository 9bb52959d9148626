"""Benchmark runs, typed labels, metrics, datasets, adapters, monitoring and the command line, on hand-made rows."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from embervane import cli
from embervane.operators import complexity as X, compression as C, labels as L, metrics as M, probe as P, prototypes as O, resources as R, results, retrieval as T, structured as S, targets as G
from embervane.plans import benchmark as B
from embervane.sources import datasets as D, extractors as E
from embervane.streaming.monitor import Monitor


def clusters(spark, n=60, gap=1.0, dim=4, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 0.05, (n, dim))
    x[np.arange(n), np.arange(n) % 2] += gap
    return spark.createDataFrame([(i, v.tolist(), "ab"[i % 2], i // 4) for i, v in enumerate(x)], "row_id bigint, vec array<double>, label string, group int")


def test_label_retrieval_fixture(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0], "a"), (1, [0.9, 0.1], "a"), (2, [0.0, 1.0], "b"), (3, [0.1, 0.9], "b")], "row_id bigint, vec array<double>, label string")
    assert M.LabelRetrievalMetric(1).score(rows).score == 1
    with pytest.raises(ValueError):
        M.LabelRetrievalMetric(1).score(rows, "multi_label")


def test_typed_labels(spark):
    df = spark.sql("select parse_json(x) as v from values ('1'), ('1'), ('true'), ('\"1\"'), ('null'), (null) as t(x)")
    rows = L.catalog(df, "v").collect()
    assert {(r.label_type, r.display, r.n) for r in rows} == {("bigint", "1", 2), ("boolean", "true", 1), ("string", "1", 1)}
    assert [r.position for r in sorted(rows, key=lambda r: r.label_key)] == [0, 1, 2]
    for kind, value in (("array<string>", ["a", None]), ("bigint", 7), ("double", 0.5), ("string", 'q"}')):
        d = spark.createDataFrame([(value,)], f"c {kind}")
        assert L.from_json(L.to_json(d, "c"), "c").first()[0] == value


def test_normalized_targets(spark):
    df = spark.createDataFrame([(1, 0, [1, 0], 2.0), (0, 1, [1, 1], 3.0)], "a int, b int, flags array<int>, y double")
    rows, kind = L.normalize_targets(df, ["a", "b"])
    assert kind == "multi_label" and [r.target for r in rows.collect()] == [["a"], ["b"]]
    assert [r.target for r in L.normalize_targets(df, "flags", names=["x", "y"])[0].collect()] == [["x"], ["x", "y"]]
    assert [r.target for r in L.normalize_targets(df, "y", "regression")[0].collect()] == [[2.0], [3.0]]
    with pytest.raises(Exception, match="neither 0 nor 1"):
        L.normalize_targets(df.withColumn("a", F.lit(2)), ["a", "b"])[0].collect()
    with pytest.raises(Exception, match="not finite"):
        L.normalize_targets(df.withColumn("y", F.lit(float("nan"))), "y", "regression")[0].collect()
    with pytest.raises(ValueError):
        L.normalize_targets(df.withColumn("y", F.lit("x")), "y", "regression")


def test_benchmark_run(spark):
    e = clusters(spark)
    d = D.Dataset(e.withColumn("one", F.lit("x")), group_col="group")
    b = B.Benchmark(d, {"own": None, "noise": lambda r: r.withColumn("vec", F.array(*(F.rand(i) for i in range(4))))}, (C.Compression(), C.Compression("pca", 2), C.Compression("pca", 9)), (M.LinearProbeMetric(3), M.CallableMetric(lambda rows: rows.count(), "n")), views={"one": "one"}, repeats=2, diagnose=True)
    r = b.run().cache()
    assert b.warnings and "one" in b.warnings[0] and {x.view for x in r.collect()} == {"labels"}
    own = {(x.variant, x.metric): x for x in r.collect()}
    assert own["own", "overlap"].score == own["own", "linear_probe"].score == 1 and own["own", "overlap"].advice == "strong"
    assert own["own[pca_2]", "overlap"].output_dim == 2 and "changes nothing" in own["own[pca_9]", "overlap"].warnings
    assert own["own", "n"].score == 60
    ranked = b.ranked(r).orderBy("place").collect()
    assert [x.variant for x in ranked][:3] == sorted(["own", "own[pca_2]", "own[pca_9]"]) and len(ranked) == 6
    assert b.diagnostics["labels", "own"]["recommended"] == "linear" and b.diagnostics["labels", "noise"]["status"] == "skipped"
    advice = results.overall_advice(b.ranked(r), "score", "variant")
    assert advice[0].startswith("own ranks first") and "own[pca_2] is as good with 2 dimensions." in advice
    text = D.benchmark_report(b.ranked(r), r, advice, b.diagnostics)
    assert all(h in text for h in ("## Ranking", "## Stability", "## Complexity", "## Warnings"))
    with pytest.raises(ValueError):
        B.Benchmark(d, {"own": None}, primary="absent")
    with pytest.raises(ValueError):
        B.Benchmark(D.Dataset(e.withColumn("label", F.lit("x"))), {"own": None}).run()
    assert B.protocol(b) == B.protocol(b) and B.evaluate(D.Dataset(e))["overlap"]["score"] == 1


def test_multilabel_and_regression_benchmarks(spark):
    e = clusters(spark)
    ml = e.withColumn("labels", F.array(F.col("label"), F.lit("all"))).drop("label")
    b = B.Benchmark(D.Dataset(ml, label_col="labels", target_type="multi_label"), {"own": None}, metrics=(M.LinearProbeMetric(3),))
    r = {x.metric: x for x in b.run().collect()}
    assert r["linear_probe"].score == 1 and json.loads(r["linear_probe"].details).keys() >= {"macro_f1", "micro_f1", "jaccard", "subset_accuracy"}
    y = e.withColumn("y", F.col("vec")[0] * 2 + 1).drop("label")
    r = {x.metric: x for x in B.Benchmark(D.Dataset(y, label_col="y", target_type="regression"), {"own": None}, metrics=(M.LinearProbeMetric(3, alpha=1e-9),)).run().collect()}
    assert r["linear_probe"].score == pytest.approx(0, abs=1e-5) and not r["linear_probe"].higher_is_better and 0 <= r["overlap"].score <= 1
    with pytest.raises(ValueError):
        D.Dataset(y.withColumn("y", F.lit(1.0)), label_col="y", target_type="regression").validate()


def test_retrieval_and_zero_shot_runs(spark):
    q = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "q bigint, vec array<double>")
    g = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "g bigint, vec array<double>")
    rel = D.relevance_from_matrix(spark.createDataFrame([(0, [2.0, 0.0]), (1, [0.0, 1.0])], "q bigint, grades array<double>"))
    d = D.RetrievalDataset(q, g, rel).validate()
    r = B.retrieval_run(d, {"own": (None, None)}, (C.Compression(), C.Compression("quantize_int8")), ks=(1,), both_ways=True).collect()
    assert {x.variant for x in r} == {"own", "own[quantize_int8]"} and {x.score for x in r} == {1.0} and "## Variants" in D.retrieval_report(spark.createDataFrame(r))
    for bad in (D.RetrievalDataset(q, g, rel, rel.select("q", "g")), D.RetrievalDataset(q, g, rel.withColumn("grade", F.lit(-1.0))), D.RetrievalDataset(q, g.where("g = 0"), rel), D.RetrievalDataset(q.unionByName(q), g, rel)):
        with pytest.raises(ValueError):
            bad.validate()
    samples = spark.createDataFrame([(0, "a", [1.0, 0.0]), (1, "a", [0.8, 0.2]), (2, "b", [0.0, 1.0]), (3, "b", [0.2, 0.8])], "row_id bigint, label string, vec array<double>")
    z = D.zero_shot_from_prompts(samples, {"a": ["an a", "the a"], "b": ["a b", "the b"]}).validate()
    assert z.fingerprint() == D.ZeroShotDataset(samples, z.prompts.orderBy(F.desc("prompt"))).fingerprint() != D.zero_shot_from_templates(samples, ["{label}!"]).fingerprint()
    encode = E.from_function(lambda s: np.array([[1.0, 0.0] if p.endswith("a") else [0.0, 1.0] for p in s]), "prompt")
    r = B.zero_shot_run(z, {"own": (None, encode)}, (C.Compression(), C.Compression("prefix_truncate", 2))).collect()
    assert all(x.accuracy == x.macro_f1 == 1 for x in r) and {x.variant for x in r} == {"own", "own[prefix_truncate_2]"}
    ties = samples.withColumn("vec", F.array(F.lit(1.0), F.lit(1.0)))
    assert "ties" in B.zero_shot_run(D.ZeroShotDataset(ties, z.prompts), {"own": (None, encode)}, overlap=False).first().warnings
    with pytest.raises(ValueError):
        D.zero_shot_from_prompts(samples, {"a": ["x"]}).validate()


def test_metrics_by_name_and_coercion(spark):
    assert M.load("math:sqrt").name == "sqrt"
    for bad in ("math", "math:", ":x"):
        with pytest.raises(ValueError):
            M.load(bad)
    assert M.coerce({"score": 1, "extra": 2.0}, "m").details == {"extra": 2.0} and M.coerce(0.5, "m").score == 0.5
    assert M.coerce(spark.sql("select 0.25D as score"), "m").score == 0.25
    for bad, error in ((float("nan"), ValueError), ({"x": 1}, ValueError), ("1", TypeError), (True, TypeError), (spark.range(2), ValueError)):
        with pytest.raises(error):
            M.coerce(bad, "m")


def test_grouped_probe_fixture(spark):
    rows = [(i, [-1.0, 0.25] if i < 10 else [1.0, -0.25], "negative" if i < 10 else "positive", i // 2) for i in range(20)]
    e = spark.createDataFrame(rows, "row_id bigint, vec array<double>, label string, group int")
    assert M.LinearProbeMetric(5).score(e).score == 1
    assert M.LinearProbeMetric(5, balanced=True).score(e.drop("group")).score == 1
    k, f = G.safe_folds(e, "row_id", "label", 5, "group")
    held = f.groupBy("fold").agg(F.count("row_id").alias("n"), F.count_distinct("label").alias("c")).collect()
    assert k == 5 and sum(x.n for x in held) == 20 and f.groupBy("group").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    with pytest.raises(ValueError):
        G.safe_folds(e.withColumn("group", F.col("label")), "row_id", "label", 5, "group")


def test_regression_fixture(spark):
    x = np.linspace(-2, 2, 30)
    e = spark.createDataFrame([(i, [float(v), float(v * v)], [float(3 * v - 1), float(v * v), 7.0]) for i, v in enumerate(x)], "row_id bigint, vec array<double>, target array<double>")
    m = P.target_metrics(P.ridge_out_of_fold(G.folds(e, "row_id", None, 3), 3, 1e-9)).first()
    assert m.rmse == pytest.approx(0, abs=1e-5) and m.r2 == m.r2_uniform == pytest.approx(1)


def test_multilabel_subsample_and_resolve_k(spark):
    df = spark.createDataFrame([(i, ["a", "b"] if i % 10 == 0 else ["a"] if i % 2 else [None]) for i in range(200)], "id bigint, labels array<string>")
    n = {r.label: r.n for r in G.multilabel_counts(G.multilabel_subsample(df, "id", "labels", 0.1, 5), "labels").collect()}
    assert n["a"] >= 12 and n["b"] >= 5 and n["a"] < 40
    c = spark.createDataFrame([("a", 100), ("b", 30)], "label string, n bigint")
    assert {r.label: r.k for r in O.resolve_k(c, {"a": 3}).collect()} == {"a": 3, "b": 6}
    with pytest.raises(ValueError):
        O.resolve_k(spark.createDataFrame([("a", 1)], "label string, n bigint"))


def test_complexity(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(-1, 1, (300, 2))
    ring = spark.createDataFrame([(i, v.tolist(), int((v * v).sum() > 0.5)) for i, v in enumerate(x)], "row_id bigint, vec array<double>, label int")
    s, report = X.diagnose(ring, 0.9)
    assert s["recommended"] in ("smooth_poly", "kernel_approx", "knn") and s["nonlinear_gain"] > 0.1 and report.count() == 5
    assert {r.probe: r.balanced_accuracy for r in report.collect()}["dummy"] == 0.5
    assert X.diagnose(ring, 0.5)[0]["status"] == X.diagnose(ring, None)[0]["status"] == "skipped"
    assert X.diagnose(ring.limit(1), 0.9)[0]["status"] == "skipped"


def test_compression_metadata(spark):
    e = clusters(spark, dim=6)
    for how, dim in ((C.Compression("gaussian_random_projection", 3), 3), (C.Compression("sparse_random_projection", 3), 3), (C.Compression("truncated_svd", 2), 2), (C.Compression("pca", 0.9), None), (C.Compression("quantize_uint8"), 6), (C.Compression("quantize_float16"), 6)):
        out, meta = C.compress(e, how)
        assert out.select(F.size("vec")).first()[0] == meta["output_dim"] == (dim or meta["output_dim"]) and meta["ratio"] >= 1
    assert C.compress(e, C.Compression("pca", 6))[1]["warnings"] and 0.9 <= C.compress(e, C.Compression("pca", 0.9))[1]["explained_variance"] <= 1
    a, b, _ = C.compress_pair(e, e.limit(3), C.Compression("quantize_int8"))
    assert {tuple(r.vec) for r in b.collect()} <= {tuple(r.vec) for r in a.collect()}
    for bad in (("nope",), ("pca",)):
        with pytest.raises(ValueError):
            C.Compression(*bad)
    assert C.Compression("quantize_float16").name("own") == "own[quantize_float16]" and C.Compression().name("own") == "own" and C.Compression("pca", 2).name("own") == "own[pca_2]"


def test_constructors(spark):
    df = spark.createDataFrame([(1, [0.1, 0.2], 8000, [[1.0], [2.0]], "x", [True, False])], "id bigint, wave array<double>, rate int, series array<array<double>>, label string, seen array<boolean>")
    a = D.from_audio_arrays(df, "id", "wave", "rate", "label").rows.first().input
    assert a.sampling_rate == 8000 and len(a.samples) == 2
    assert D.from_video_arrays(df, "id", "series", 24.0).rows.first().input.frame_rate == 24
    assert D.from_time_series(df, "id", "series", "label", "seen").rows.first().input.observed == [True, False]
    assert D.from_time_series(df, "id", "series").rows.first().input.observed == [True, True]
    assert D.from_multimodal(df, "id", {"sound": "wave", "text": "label"}).rows.first().input.text == "x"
    with pytest.raises(Exception, match="positive"):
        D.from_audio_arrays(df, "id", "wave", -1).rows.collect()
    with pytest.raises(Exception, match="each step"):
        D.from_time_series(df.withColumn("seen", F.array(F.lit(True))), "id", "series", None, "seen").rows.collect()
    with pytest.raises(Exception, match="null"):
        D.from_multimodal(df.withColumn("label", F.lit(None).cast("string")), "id", {"sound": "wave", "text": "label"}).rows.select("input").collect()
    nodes = spark.createDataFrame([(1, "n1", [1.0]), (1, "n2", [2.0]), (2, "n1", [3.0])], "gid int, node_id string, vec array<double>")
    edges = spark.createDataFrame([(1, "n1", "n2")], "gid int, src string, dst string")
    g = {r.gid: r.input for r in D.from_graphs(nodes, edges, "gid").rows.collect()}
    assert len(g[1].nodes) == 2 and len(g[1].edges) == 1 and g[2].edges == []
    ids = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0])], "id string, vec array<double>")
    pairs = spark.createDataFrame([(1, "a", "b", "x")], "row_id bigint, left string, right string, label string")
    assert D.from_pairs(pairs, "abs_diff", ids).rows.first().vec == [2.0, 2.0]
    with pytest.raises(ValueError):
        D.from_pairs(pairs.withColumn("left", F.lit(1)), "concat", ids)
    D.from_nodes(ids, "id", "vec", edges=spark.createDataFrame([("a", "b")], "src string, dst string"))
    with pytest.raises(ValueError):
        D.from_nodes(ids, "id", "vec", edges=spark.createDataFrame([("a", "z")], "src string, dst string"))
    assert D.from_entities(ids, "id", "vec").metadata["entity_type"] == "entity"
    with pytest.raises(ValueError):
        D.from_units(ids, "id", "vec", "id", "id", colour="id")
    d = D.Dataset(ids, "id", "vec", None)
    for bad in (["z"], ["a", "a"], [None]):
        with pytest.raises(ValueError):
            d.subset(spark.createDataFrame([(x,) for x in bad], "id string"))
    assert sum(d.batches(i, 3).count() for i in range(3)) == 2
    from pyspark.ml.functions import array_to_vector

    assert D.from_embeddings(ids.withColumn("vec", array_to_vector("vec")), "id", "vec").rows.orderBy("id").first().vec == [1.0, 2.0]
    h = D.Dataset(ids.withColumn("path", F.array(F.lit("r"), F.col("id"))), "id", "vec", None).with_label_hierarchy("path", ("root", "leaf"))
    assert h.hierarchy_view("leaf").rows.select("view_label").distinct().count() == 2 and h.hierarchy_view("root").rows.select("view_label").distinct().count() == 1
    with pytest.raises(ValueError):
        h.hierarchy_view("stem")
    u = D.Dataset(ids, "id", "vec", None).with_unit_annotations(spark.createDataFrame([("a", [("u1",)])], "id string, units array<struct<label:string>>"), "word")
    assert {r.id: len(r.units) for r in u.rows.collect()} == {"a": 1, "b": 0}


def test_artifacts_and_reports(spark, tmp_path):
    e = clusters(spark, 8)
    p = str(tmp_path)
    D.write_artifact(e.select("row_id", "vec"), f"{p}/emb", {"a": 1}, n_expected=8)
    D.write_labels(D.Dataset(e), f"{p}/lab")
    assert D.aligned(spark, f"{p}/emb", f"{p}/lab").count() == 8 and spark.read.parquet(f"{p}/lab/catalog").count() == 2
    D.write_labels(D.Dataset(e.where("row_id < 7")), f"{p}/few")
    with pytest.raises(ValueError):
        D.aligned(spark, f"{p}/emb", f"{p}/few")
    with pytest.raises(ValueError):
        D.write_artifact(e.select("row_id", "vec"), f"{p}/short", {}, n_expected=9)
    D.save_json_report(e.select("row_id").orderBy("row_id"), f"{p}/json", title="t")
    assert D.get_json(spark, f"{p}/json")["results"][0] == {"row_id": 0}
    assert "5 more rows" in D.markdown(e, "x", 3) and "more rows" not in D.markdown(e, "x")
    assert D.artifact_key("a", "B c").startswith("a/b-c-") and D.artifact_key("B c") != D.artifact_key("b c")
    for bad in ("", "..", "a/b"):
        with pytest.raises(ValueError):
            D.artifact_key(bad)


def test_segmentation_fixtures(spark):
    grid = [[[1, 1, 2, 2], [1, 1, 2, 2], [0, 0, 1, 1], [0, 0, 1, 1]]] * 2
    d = D.segmentation(spark.createDataFrame([(i, m, [[0, 5, 5, 5]] * 4) for i, m in enumerate(grid)], "img int, mask array<array<int>>, inst array<array<int>>"), "img", "mask", "inst")
    px = D.pixels(d).cache()
    features = px.select("img", F.floor(F.col("r") / 2).cast("int").alias("i"), F.floor(F.col("c") / 2).cast("int").alias("j")).distinct().withColumn("vec", F.array(F.lit(1.0)))
    t = S.segment_tokens(px, features, 4, 4, 2, 2, background=(0,)).collect()
    assert len(t) == 8 and sum(x.background for x in t) == 2 and {x.img for x in t} == {0, 1}
    assert len(S.segment_tokens(px, features, 4, 4, 2, 2, background=(0,), include_excluded=False).collect()) == 6
    stuff = S.segment_tokens(px, features, 4, 4, 2, 2, things=(9,)).collect()
    assert all(x.instance is None for x in stuff)  # stuff never gets an instance
    one = S.instances(px, S.grid_tokens(px, 4, 4, 4, 4), 4, 4, 4, 4).where("instance is not null")
    two = S.instances(px, S.grid_tokens(px, 4, 4, 4, 4), 4, 4, 4, 4, ignored=()).where("instance is not null")
    assert one.count() == 24 and two.count() == 32
    capped = S.segment_tokens(px, features, 4, 4, 2, 2, per_class=3, per_instance=1, instances_per_class=3).groupBy("label").count().collect()
    assert all(x["count"] <= 3 for x in capped)
    with pytest.raises(Exception, match="shape"):
        D.pixels(D.segmentation(spark.createDataFrame([(0, [[1, 1]], [[1]])], "img int, mask array<array<int>>, inst array<array<int>>"), "img", "mask", "inst")).collect()
    with pytest.raises(Exception, match="no features"):
        S.segment_tokens(px, features.where("i = 0"), 4, 4, 2, 2).collect()


def test_adapters(spark):
    df = spark.createDataFrame([("p", [("dog", [0.0, 0.0, 2.0, 3.0])], [("N", [0, 4])], [("eye", 1.0, 2.0, True), ("ear", 1.0, 2.0, None)], [(1.5, True), (None, False), (2.5, True)], ["s", None])], "parent string, boxes array<struct<label:string,box:array<double>>>, toks array<struct<label:string,span:array<int>>>, pts array<struct<label:string,x:double,y:double,visible:boolean>>, deep array<struct<depth:double,valid:boolean>>, slots array<string>")
    assert S.detection_units(df, "parent", "boxes").first().units[0].coordinates == [0.0, 0.0, 2.0, 3.0]
    assert S.sequence_units(df, "parent", "toks").first().units[0].span == [0, 4]
    assert [u.label for u in S.keypoint_units(df, "parent", "pts").first().units] == ["eye"] and len(S.keypoint_units(df, "parent", "pts", False).first().units) == 2
    assert [(u.position, u.target) for u in S.depth_units(df, "parent", "deep").first().units] == [(0, 1.5), (2, 2.5)]
    assert [(u.unit_id, u.label) for u in S.slot_units(df, "parent", "slots").first().units] == [("slot-0", "s"), ("slot-1", None)]
    with pytest.raises(Exception, match="inverted"):
        S.detection_units(df.withColumn("boxes", F.expr("array(named_struct('label', 'x', 'box', array(1D, 1D, 0D, 2D)))")), "parent", "boxes").collect()
    units = S.sequence_units(df, "parent", "toks")
    rows = S.materialize(units, {"o": spark.createDataFrame([("p", [[1.0, 2.0]])], "parent string, vecs array<array<double>>")})["o"].collect()
    assert [(r.group, r.label, r.vec) for r in rows] == [("p", "N", [1.0, 2.0])]
    with pytest.raises(Exception, match="differ in number"):
        S.materialize(units, {"o": spark.createDataFrame([("p", [[1.0], [2.0]])], "parent string, vecs array<array<double>>")})["o"].collect()
    u = spark.createDataFrame([("p", 0, "a"), ("p", 1, "b")], "parent string, position int, label string")
    v = spark.createDataFrame([("p", 0, [1.0]), ("p", 1, [2.0]), ("p", 2, [3.0])], "parent string, at int, vec array<double>")
    got = S.align_by(u, v, f=lambda a, b: [(p, p + 1) for p in a["position"]]).orderBy("position").collect()
    assert [r.vec for r in got] == [[2.0], [3.0]]
    pairs = lambda *p: spark.createDataFrame([("p", a, b) for a, b in p], "parent string, unit_at int, vector_at int")
    assert [r.label for r in S.align_by(u, v, pairs((1, 2))).collect()] == ["b"]
    for bad in (pairs((0, 9)), pairs((7, 0)), pairs((0, 0), (0, 1)), None):
        with pytest.raises(ValueError):
            S.align_by(u, v, bad)


def test_extractors(spark):
    rows = spark.createDataFrame([(i, f"word{i % 3} common text", [float(i % 3), float(i % 5)], "ab"[i % 2]) for i in range(30)], "id bigint, text string, x array<double>, label string")
    train, rest = rows.where("id < 20"), rows.where("id >= 20").unionByName(rows.limit(1).withColumn("text", F.lit(None).cast("string")))
    assert E.text_features("text", 64, 2).fit(train)(rest).select(F.size("vec")).distinct().collect()[0][0] == 2
    assert E.scaled_features("x").fit(train)(rest).count() == 11
    leaf = E.fit_tree_leaves(train, "x", "label", trees=3, depth=2, one_hot=True)
    out = leaf(rest).collect()
    assert len({len(r.vec) for r in out}) == 1 and all(sum(r.vec) <= 3 for r in out) and set(out[0].vec) <= {0.0, 1.0}
    two = E.many_outputs(lambda s: {"a": np.ones((len(s), 2)), "b": np.zeros((len(s), 3))}, "text", ("a", "b"))
    assert two["a"](train).first().vec == [1.0, 1.0] and two["b"](train).first().vec == [0.0, 0.0, 0.0]
    assert E.precomputed("x")(rows).first().vec == rows.first().x
    q, g = E.sided(lambda s: np.ones((len(s), 1)), lambda s: np.zeros((len(s), 1)), "text", "text")
    assert q(train).first().vec == [1.0] and g(train).first().vec == [0.0]
    n = E.nested(train, lambda s: [np.ones((2, 3)) if i else None for i in range(len(s))], "text").select("vecs").collect()
    assert any(r.vecs is None for r in n) and [1.0] * 3 in [v for r in n if r.vecs for v in r.vecs]
    cells = E.grid(train.limit(2), lambda s: [np.arange(12.0).reshape(2, 3, 2) for _ in s], "text", "id").orderBy("img", "i", "j").collect()
    assert len(cells) == 12 and cells[4].i == 1 and cells[4].j == 1 and cells[4].vec == [8.0, 9.0]
    with pytest.raises(Exception, match="need the package"):
        E.family("tf_hub", lambda: None, lambda m, s: np.ones((len(s), 1)), "text")(train).collect()


def test_monitor(spark, tmp_path):
    said = []
    m = Monitor(spark, str(tmp_path / "h"), "s", "p1", "continue", said.append)
    assert m.evaluate(lambda: {"a": 1}, {"epoch": 1}) == {"a": 1.0}
    assert m.evaluate(lambda: 1 / 0, {"epoch": 2}) is None
    m = Monitor(spark, str(tmp_path / "h"), "s", "p1", report=said.append)
    m.evaluate(lambda: {"a": 3, "b": 4}, {"epoch": 1})
    with pytest.raises(ZeroDivisionError):
        m.evaluate(lambda: 1 / 0, {"epoch": 3})
    assert sorted((r.evaluation_index, r.status, r.metric or "", r.value) for r in m.scores().collect()) == [(1, "success", "a", 1.0), (2, "failure", "", None), (3, "success", "a", 3.0), (3, "success", "b", 4.0), (4, "failure", "", None)]
    assert any("before" in s for s in said)
    with pytest.raises(ValueError):
        Monitor(spark, str(tmp_path / "h"), "s", "p2")


def test_profiles_and_guards(spark):
    p = R.profile_summary(R.profiled(spark.range(100).repartition(2).withColumn("x", F.col("id")), lambda s: s.sum(), "x")).first()
    assert p.n_rows == 100 and p.rss_mb > 0
    with pytest.raises(ValueError):
        R.require_pairs(1000, 1000, 10)


def test_command_line(spark, tmp_path):
    p = str(tmp_path)
    clusters(spark, 40).write.parquet(f"{p}/t")
    run = lambda *a: cli.main(list(a), spark)
    run("embed", "--table", f"{p}/t", "--out", f"{p}/emb")
    run("write-labels", "--table", f"{p}/t", "--out", f"{p}/lab")
    run("write-groups", "--table", f"{p}/t", "--out", f"{p}/grp")
    run("compress", "--embeddings", f"{p}/emb", "--method", "pca", "--components", "2", "--out", f"{p}/small")
    for e in ("emb", "small"):
        run("score", "--embeddings", f"{p}/{e}", "--labels", f"{p}/lab", "--groups", f"{p}/grp", "--repeats", "2", "--out", f"{p}/s_{e}")
    run("collect-scores", "--scores", f"{p}/s_emb", f"{p}/s_small", "--out", f"{p}/all")
    assert {(r.n, r["mean"]) for r in spark.read.parquet(f"{p}/all").collect()} == {(2, 1.0)}
    run("benchmark-from-artifacts", "--scores", f"{p}/s_emb", f"{p}/s_small", "--out", f"{p}/rep")
    assert [r["place"] for r in D.get_json(spark, f"{p}/rep")["results"]] == [1, 2]
    run("diagnose-complexity", "--embeddings", f"{p}/emb", "--labels", f"{p}/lab", "--out", f"{p}/dia")
    assert D.get_json(spark, f"{p}/dia")["recommended"] == "linear"
    spark.createDataFrame([(i, [1.0 if j % 2 == i % 2 else 0.0 for j in range(40)]) for i in range(40)], "q bigint, grades array<double>").write.parquet(f"{p}/m")
    run("write-retrieval-relevance", "--table", f"{p}/m", "--out", f"{p}/rel")
    run("compress-retrieval", "--queries", f"{p}/emb", "--gallery", f"{p}/emb", "--method", "quantize_int8", "--out", f"{p}/pair")
    run("score-retrieval", "--queries", f"{p}/pair/queries", "--gallery", f"{p}/pair/gallery", "--relevance", f"{p}/rel", "--out", f"{p}/sr")
    assert spark.read.parquet(f"{p}/sr").first()["mrr"] == 1
    spark.createDataFrame([("a", [1.0, 0.0, 0.0, 0.0], "an a"), ("b", [0.0, 1.0, 0.0, 0.0], "a b")], "label string, vec array<double>, prompt string").write.parquet(f"{p}/pr")
    run("score-zero-shot", "--embeddings", f"{p}/emb", "--labels", f"{p}/lab", "--prompts", f"{p}/pr", "--out", f"{p}/zs")
    assert spark.read.parquet(f"{p}/zs").first()["accuracy"] == 1
    run("write-zero-shot-protocol", "--prompts", f"{p}/pr", "--out", f"{p}/proto")
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["nope"])
