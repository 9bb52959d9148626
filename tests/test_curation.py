"""Consolidation, nested records and schema drift on small fixtures with dirt of every kind."""

import json

from pyspark.sql import functions as F

from embervane.operators import compaction as C, drift as D, nested as N

FILES = "file_id bigint, output_key string, sample_indices array<bigint>, file_id_ string"
ARTS = "artifact_key string, n_samples bigint, record_bytes double"


def merged(spark, files, arts, width=4):
    return C.merge_runs(spark.createDataFrame(files, FILES), spark.createDataFrame(arts, ARTS), width)


def test_faults_and_layout(spark):
    files = [
        (1, " ./a//b/shards/0-of-2/x ", [0, 2, 4, 4], "s"),  # held twice by one file
        (1, "a/b/shards/0-of-2/x", [0, 2, 4, 4], "s"),  # listed twice
        (2, "runs/r1/a/b/shards/1-of-2/x", [1, None, -1, 2], "s"),  # 2 held by another file too
        (3, "a/b/shards/0-of-1", None, "s"),
        (4, None, [1], None),
        (5, "no key", [1], "s"),
        (6, "c/shards/0-of-1", [0, 9], "s"),  # an artifact that is not known
    ]
    arts = [("a/b/x", 7, 4.0), ("a/b/x", 7, 4.0), ("a/b", 2, None), (None, 3, 1.0), ("e", 0, 1.0)]
    m = merged(spark, files, arts).cache()
    got = sorted(map(tuple, C.faults(m).collect()))
    assert got == [("a/b", 0, "missing"), ("a/b", 1, "missing"), ("a/b/x", 2, "duplicate"), ("a/b/x", 3, "missing"), ("a/b/x", 4, "duplicate"), ("a/b/x", 5, "missing"), ("a/b/x", 6, "missing")]
    lay = {(r.artifact_key, r.file_no): r for r in C.layout(m, target_bytes=8).collect()}
    assert [(lay["a/b/x", i].first_index, lay["a/b/x", i].last_index, lay["a/b/x", i].n_records) for i in (0, 1)] == [(0, 1, 2), (2, 4, 2)]
    assert lay["c", 0].n_records == 2 and ("a/b", 0) not in lay
    assert sum(r.n_extra_copies for r in lay.values()) == 2


def test_range_width_does_not_matter(spark):
    files = [(i, f"k/shards/{i}-of-5", [j for j in range(i, 60, 5)] + [7], "s") for i in range(5)]
    arts = [("k", 70, 1.0)]
    a = sorted(map(tuple, C.faults(merged(spark, files, arts, 4)).collect()))
    assert a == sorted(map(tuple, C.faults(merged(spark, files, arts, 1000)).collect()))
    assert [x for x in a if x[2] == "duplicate"] == [("k", 7, "duplicate")] and len(a) == 11


def test_empty_tables(spark):
    m = merged(spark, [], [])
    assert C.faults(m).count() == 0 and C.layout(m).count() == 0
    assert N.exploded(spark.createDataFrame([], "report_id bigint, report string"), "report_id", {"report": "report"}, N.REPORT_RULES)[0].count() == 0
    rows = D.parsed_rows(spark.createDataFrame([], "line_id bigint, stream_id string, file_seq bigint, line_no int, record string"))
    assert D.changes(rows).count() == 0 and D.fused_schema(D.file_schemas(D.typed_cells(rows))).count() == 0


def test_compact_files_keeps_every_row(spark, tmp_path):
    df = spark.range(1000).withColumn("k", F.col("id") % 7).unionByName(spark.range(3).withColumn("k", F.lit(1)))
    df.repartition(40).write.parquet(str(tmp_path / "in"))
    man = C.compact_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), ["k", "id"], 1 << 20)
    assert man.count() == 1 and man.first()["n_rows"] == 1003
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, df.collect()))


def test_nested_shapes(spark):
    probes = {"a": {"recipe": {"recipe_id": "r1"}, "folds": [{"fold": 0}]}, "b": {"recipes": [{"recipe_id": "r2"}, {"recipe_id": "r3"}]}}
    rows = [
        (1, json.dumps({"metrics": {"probes": probes}}), json.dumps({"x": {"confusions": {"y": 3}}, "label": {"f1": 1.0}}), None),
        (2, json.dumps({"metrics": {"probes": json.dumps([{"name": "c"}])}}), json.dumps(json.dumps([{"label": "x", "confusions": [{"label": "y"}]}])), json.dumps({"worst_queries": {"query_id": 7, "hits": [{"gallery_id": "g"}]}})),
        (3, '{"metrics": {"probes": {"a": 1', "", "null"),
        (4, None, None, None),
        (1, json.dumps({"metrics": {"probes": probes}}), json.dumps({"x": {"confusions": {"y": 3}}, "label": {"f1": 1.0}}), None),
    ]
    df = spark.createDataFrame(rows, "report_id bigint, report string, per_class string, diagnostics string").withColumn("kind", F.lit("clash"))
    ch, tree = N.exploded(df, "report_id", N.REPORT_PAYLOADS, N.REPORT_RULES)
    assert [c.kind for c in tree[len(N.REPORT_RULES) :]] == ["probe_folds"]
    got = {tuple(r) for r in ch.where("key is not null").select("report_id", "kind", "parent_key", "key").distinct().collect()}
    assert got == {
        (1, "probe", "", "a"), (1, "recipe", "a", "r1"), (1, "probe", "", "b"), (1, "recipe", "b", "r2"), (1, "recipe", "b", "r3"),
        (1, "class", "", "x"), (1, "confusion", "x", "y"), (1, "class", "", "label"),
        (2, "probe", "", "c"), (2, "class", "", "x"), (2, "confusion", "x", "y"), (2, "worst_query", "", "7"), (2, "hit", "7", "g"),
    }
    schema = {r.kind: r.merged_schema for r in N.merged_schema(ch).collect()}
    hits = N.child_table(ch, "hit", "report_id", schema["hit"]).collect()
    assert [(h.report_id, h.gallery_id, h.ordinal) for h in hits] == [(2, "g", 0)]
    parents = {r.row for r in ch.select("row").collect()}
    assert all(r.parent_row in parents for r in ch.where("kind in ('recipe', 'hit', 'confusion')").collect())
    assert N.child_table(ch, "probe", "report_id", schema["probe"]).count() == 3  # the repeated delivery counts once


def line(i, seq, ev, rows, stream="s"):
    return (i, stream, seq, 1, json.dumps({"evaluation_index": ev, "status": "success", "rows": rows}))


def test_drift(spark):
    lines = [
        line(1, 1, 1, [{"extractor": "e", "old": 0.5, "same": 1, "t": 1, "gone": 3}]),
        line(2, 2, 1, json.dumps([{"extractor": "e", "new": 0.5, "same": 1.0, "t": "1", "fresh": 4}])),
        line(3, 2, 2, {"extractor": "e", "new": 0.7, "same": None, "T": 2}),
        (4, "s", 2, 2, '{"evaluation_index": 3, "rows": [{"extr'),
        (5, "s", 2, 3, None),
        line(6, 2, 9, [{}]),
        line(3, 2, 2, {"extractor": "e", "new": 0.7, "same": None, "T": 2}),
    ]
    rows = D.parsed_rows(spark.createDataFrame(lines, "line_id bigint, stream_id string, file_seq bigint, line_no int, record string"))
    got = {tuple(r) for r in D.changes(rows).collect()}
    assert got == {("s", 2, "renamed", "old", "new"), ("s", 2, "removed", "gone", ""), ("s", 2, "added", "fresh", ""), ("s", 2, "added", "T", ""), ("s", 2, "type", "t", ""), ("s", 2, "type", "same", "")}
    fused = [tuple(r) for r in D.fused_schema(D.file_schemas(D.typed_cells(rows))).select("field", "types", "canonical").collect()]
    wide = D.unified(rows, fused)
    assert {"t", "T__2", "T", "t__2"} & set(wide.columns) and len({c.lower() for c in wide.columns}) == len(wide.columns)
    assert wide.count() == 4
    name = D.column_names([f for f, _, _ in fused], ("line_id", "stream_id", "file_seq", "line_no", "row_no", "evaluation_index", "status"))["t"]
    assert {r[0] for r in wide.where("file_seq = 2 and evaluation_index = 1").select(f"{name}_as_string").collect()} == {"1"}


def test_null_ids_and_every_level(spark):
    from embervane.plans import curation

    report = lambda x: json.dumps({"metrics": {"probes": {x: {"f": 1}}}})
    df = spark.createDataFrame([(None, report("a")), (None, report("b")), (None, report("b")), (1, report("a"))], "report_id bigint, report string")
    ch, _ = N.exploded(df, "report_id", {"report": "report"}, N.REPORT_RULES)
    schema = N.merged_schema(ch).first().merged_schema
    assert sorted(r.key for r in N.child_table(ch, "probe", "report_id", schema).collect()) == ["a", "a", "b"]
    assert {f"p5_{c.kind}" for c in N.REPORT_RULES} <= set(curation.QUERIES)
    lines = spark.createDataFrame([(None, "s", 1, 1), (None, "s", 1, 2), (3, "s", 1, 3), (3, "s", 1, 3)], "line_id bigint, stream_id string, file_seq bigint, line_no bigint")
    lines = lines.selectExpr("*", "0 as row_no", "1 as evaluation_index", "'ok' as status", "map('x', parse_json('1')) as fields")
    assert sorted(r.line_no for r in D.unified(lines, [("x", ["integer"], "integer")]).collect()) == [1, 2, 3]


def test_arrays_without_a_rule_are_levels(spark):
    odd_name, odd = "it's \"odd\"", {'a "b"': 7, "c.d": 8, "e`f": 9, "g'h\\": 5}
    value = {"extra": [{"z": 1, "deep": [{"y": "a"}, {"y": "b"}]}, {"z": 2}], "grid": [[1, 2], [3]], "metrics": {"probes": {"p": {"notes": ["n1", "n2"]}}}, odd_name: [odd]}
    df = spark.createDataFrame([(1, json.dumps(value)), (2, json.dumps({"extra": json.dumps([{"z": 3}])}))], "report_id bigint, report string")
    ch, tree = N.exploded(df, "report_id", {"report": "report"}, N.REPORT_RULES)
    new = {c.kind: c.parent for c in tree[len(N.REPORT_RULES) :]}
    odd = next(k for k in new if "odd" in k)
    assert {k: v for k, v in new.items() if k != odd} == {"report_extra": "report", "report_extra_deep": "report_extra", "report_grid": "report", "report_grid_entry": "report_grid", "probe_notes": "probe"}
    schema = {r.kind: r.merged_schema for r in N.merged_schema(ch).collect()}
    rows = lambda kind: N.child_table(ch, kind, "report_id", schema[kind]).collect()
    assert sorted((r.report_id, r.ordinal, r.z) for r in rows("report_extra")) == [(1, 0, 1), (1, 1, 2), (2, 0, 3)]
    parents = {r.row for r in rows("report_extra")}
    assert [(r.y, r.parent_row in parents) for r in sorted(rows("report_extra_deep"), key=lambda r: r.ordinal)] == [("a", True), ("b", True)]
    assert sorted(r.entry for r in rows("report_grid_entry")) == ["1", "2", "3"]
    assert sorted(r.entry for r in rows("probe_notes")) == ["n1", "n2"]
    one = rows(odd)[0].asDict()
    assert {5, 7, 8, 9} <= {v for v in one.values() if isinstance(v, int)}


def test_damage_is_told_at_any_length(spark):
    from embervane.functions.json import parsed, unwrapped

    pad = "x" * 100
    good = ['{"a":1}', ' [1, 2] ', '"t"', "null", "12", json.dumps({"a": pad})]
    bad = ['{"a":1} trailing', json.dumps({"a": pad}) + " trailing", json.dumps({"a": pad}) + ' "', '{"a":1},', '{"a":1}{"a":1}', "", " ", "{", '{"a":1,"a":2}', "nope", None]
    df = spark.createDataFrame([(t, t in good) for t in [*good, *bad]], "t string, good boolean")
    assert {(r.t, r.ok) for r in df.selectExpr("t", f"{parsed('t')} is not null as ok").collect()} == {(t, t in good) for t in [*good, *bad]}
    assert spark.createDataFrame([(json.dumps(json.dumps([1])),)], "t string").selectExpr(f"cast({unwrapped(parsed('t'))} as string) as v").first().v == "[1]"


def test_several_renames_with_equal_values(spark):
    lines = [line(1, 1, 1, [{"extractor": "e", "a": None, "b": None, "c": 5}]), line(2, 2, 1, [{"extractor": "e", "x": None, "y": None, "z": 5}])]
    rows = D.parsed_rows(spark.createDataFrame(lines, "line_id bigint, stream_id string, file_seq bigint, line_no int, record string"))
    assert {tuple(r)[2:] for r in D.changes(rows).collect()} == {("renamed", "a", "x"), ("renamed", "b", "y"), ("renamed", "c", "z")}


def test_merge_of_many_copies_in_bounded_memory(spark, monkeypatch, tmp_path):
    import numpy as np

    state = C._Range()
    monkeypatch.setattr(C, "MERGE_ROWS", 50)
    for i in range(200):
        state.add(np.arange(0, 40, 1 + i % 3))
        assert state.size <= 50 + 40 and len(state.keys) <= 40
    state.fold()
    assert state.keys.tolist() == list(range(40)) and state.copies[0] == 200 and state.copies.sum() == sum(len(range(0, 40, 1 + i % 3)) for i in range(200))
    monkeypatch.setattr(C, "FLUSH_BYTES", 100)
    files = [(i, f"k{i % 5}/shards/{i}-of-9", [j, j + 1, j + 9], "s") for i in range(60) for j in (i,)]
    m = merged(spark, files, [(f"k{i}", 80, 4.0) for i in range(5)], 16).cache()
    assert C.faults(m).where("fault = 'missing'").count() == 5 * 80 - m.selectExpr("sum(size(indices))").first()[0]
    out = C.write_files(m, str(tmp_path / "out"), target_bytes=40).collect()
    want = {(r.artifact_key, r.file_no): (r.first_index, r.last_index, r.n_records) for r in C.layout(m, target_bytes=40).collect()}
    assert {(r.artifact_key, r.file_no): (r.first_index, r.last_index, r.n_records) for r in out} == want and all(r.distinct and r.n_files == 1 for r in out)
