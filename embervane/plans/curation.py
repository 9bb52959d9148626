"""Queries of the general data operators: consolidation, nested records, schema drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from embervane.operators import compaction, drift, nested, results
from embervane.session import Scratch, table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return compaction.faults(compaction.shard_merge(spark, d))


def p2_layout(spark: SparkSession, d: str) -> DataFrame:
    return compaction.layout(compaction.shard_merge(spark, d), target_bytes=256 * 1024)


def p2_files(spark: SparkSession, d: str) -> DataFrame:
    return compaction.write_files(compaction.shard_merge(spark, d), Scratch(spark).path("consolidated"), target_bytes=256 * 1024)


def shard_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Whether the shards of every artifact hold each of its samples, and each once."""
    files = table(spark, d, "embedding_shards").select("file_id", compaction.artifact_key(F.col("output_key")).alias("artifact"), "sample_indices").distinct()
    keys = files.where("artifact is not null").select("artifact", F.explode("sample_indices").alias("idx")).where("idx >= 0")
    expected = table(spark, d, "memory_estimates").groupBy(F.col("artifact_key").alias("artifact")).agg(F.max("n_samples").alias("n_expected"))
    return results.coverage(keys, expected).select("artifact", "n_expected", "n_rows", "n_distinct", "complete")


def recommendations(spark: SparkSession, d: str) -> DataFrame:
    """Advice on every result, with the weakest class of its reports."""
    classes = nested.report_children(spark, d).where(F.col("kind") == "class").select("report_id", F.expr("try_variant_get(value, '$.f1', 'double')").alias("f1"))
    of = table(spark, d, "score_reports").select("report_id", "result_id").distinct()
    weakest = classes.join(of, "report_id").groupBy("result_id").agg(F.min("f1").alias("weakest"))
    r = table(spark, d, "results").select("result_id", "primary_score", "target_type").distinct().join(weakest, "result_id", "left")
    return r.select("result_id", results.recommendation(F.col("primary_score"), weakest=F.col("weakest"), regression=F.coalesce(F.col("target_type") == "regression", F.lit(False))).alias("advice"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    rows = nested.report_children(spark, d).where(F.col("kind").isin(*nested.KINDS) & F.col("key").isNotNull())
    return rows.select("report_id", F.col("kind").alias("child_kind"), "parent_key", F.col("key").alias("child_key")).distinct()


def p5_levels(spark: SparkSession, d: str) -> DataFrame:
    schema = nested.inferred_schema(nested.score_reports(spark, d), nested.REPORT_PAYLOADS, nested.REPORT_RULES)
    return schema.select("payload", F.array_join("path", ".").alias("path"), F.array_join("types", ", ").alias("types"))


def p5_schema(spark: SparkSession, d: str) -> DataFrame:
    return nested.merged_schema(nested.report_children(spark, d))


def _p5_table(kind: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        rows = nested.report_children(spark, d)
        schema = nested.merged_schema(rows.where(F.col("kind") == kind)).first()
        return nested.child_table(rows, kind, "report_id", schema["merged_schema"] if schema else "")

    return query


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(drift.monitor_rows(spark, d))


def p6_schema(spark: SparkSession, d: str) -> DataFrame:
    fused = drift.fused_schema(drift.file_schemas(drift.typed_cells(drift.monitor_rows(spark, d))))
    return fused.withColumn("types", F.array_join("types", ", "))


def p6_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = drift.monitor_rows(spark, d)
    fused = drift.fused_schema(drift.file_schemas(drift.typed_cells(rows))).select("field", "types", "canonical").collect()  # as large as the schema
    return drift.unified(rows, [tuple(r) for r in fused])


QUERIES = {
    "shard_coverage": shard_coverage, "recommendations": recommendations,
    "p2_found": p2_found, "p2_layout": p2_layout, "p2_files": p2_files,
    "p5_found": p5_found, "p5_levels": p5_levels, "p5_schema": p5_schema, **{f"p5_{k}": _p5_table(k) for k in (*nested.KINDS, "architecture", "probe_folds", "recipe_preprocessing", "report_skipped_diagnostics")},
    "p6_found": p6_found, "p6_schema": p6_schema, "p6_rows": p6_rows,
}

KEY = "'^(?:runs/[^/]+/)?(.+)/shards/\\d+-of-\\d+(?:/(.+))?$'"
_HELD = f"""WITH f AS (SELECT DISTINCT file_id, output_key, sample_indices FROM embedding_shards),
k AS (SELECT regexp_extract(p, {KEY}, 1) AS base, regexp_extract(p, {KEY}, 2) AS output, sample_indices
  FROM (SELECT *, array_to_string(list_filter(string_split(trim(output_key), '/'), lambda s: trim(s) NOT IN ('', '.')), '/') AS p FROM f)),
h AS (SELECT CASE WHEN output = '' THEN base ELSE base || '/' || output END AS artifact_key, unnest(sample_indices) AS sample_index FROM k WHERE base <> ''),
g AS (SELECT artifact_key, sample_index, count(*) AS copies FROM h WHERE sample_index >= 0 GROUP BY ALL)"""

# p5: a text holding JSON is read once more; an entry list is a list, a map of entries by name, or one object
_P5 = r"""WITH RECURSIVE src AS (SELECT DISTINCT report_id, report, per_class, diagnostics FROM score_reports),
raw AS (SELECT report_id, unnest([{'p': 'report', 't': report}, {'p': 'per_class', 't': per_class}, {'p': 'diagnostics', 't': diagnostics}], recursive := true) FROM src),
one AS (SELECT report_id, p, CASE WHEN json_valid(t) AND trim(t) <> '' THEN CAST(t AS JSON) END AS j FROM raw),
doc AS (SELECT report_id, p, CASE WHEN json_type(j) = 'VARCHAR' THEN CASE WHEN json_valid(j ->> '$') THEN CAST(j ->> '$' AS JSON) END ELSE j END AS j FROM one),
"""


def _entries(source: str, value: str, names: tuple[str, ...], maps: bool, keep: str) -> str:
    """SQL of (keep, key, e): the entries in the JSON ``value`` of each row of ``source``."""
    name = "coalesce(" + ", ".join([*(f"CASE WHEN json_type(e, '$.{n}') NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN e ->> '$.{n}' END" for n in names), "NULL"]) + ")"
    own = " OR ".join(f"json_extract(v, '$.{n}') IS NOT NULL" for n in names)
    unread = f"CASE WHEN json_type({value}) = 'VARCHAR' AND json_valid({value} ->> '$') THEN CAST({value} ->> '$' AS JSON) ELSE {value} END"
    out = f"""(WITH w AS (SELECT {keep}, {unread} AS v FROM {source}), x AS (
SELECT {keep}, CAST(NULL AS VARCHAR) AS k, unnest(CAST(v AS JSON[])) AS e FROM w WHERE json_type(v) = 'ARRAY' UNION ALL
SELECT {keep}, CAST(NULL AS VARCHAR), v FROM w WHERE json_type(v) = 'OBJECT' {'AND (' + own + ')' if maps else ''}"""
    if maps:
        out += f""" UNION ALL SELECT {keep}, k, json_extract(v, '$."' || k || '"') FROM (SELECT {keep}, v, unnest(json_keys(v)) AS k FROM w WHERE json_type(v) = 'OBJECT' AND NOT ({own}))"""
    return out + f"), y AS (SELECT {keep}, k, CASE WHEN json_type(e) = 'VARCHAR' AND json_valid(e ->> '$') THEN CAST(e ->> '$' AS JSON) ELSE e END AS e FROM x) SELECT {keep}, coalesce(k, {name}) AS key, e FROM y)"


_P5 += f"""pr AS {_entries("(SELECT report_id, json_extract(j, '$.metrics.probes') AS v0 FROM doc WHERE p = 'report')", 'v0', ('name', 'label'), True, 'report_id')},
ar AS {_entries("(SELECT report_id, json_extract(j, '$.metrics.mlp_recommendation_evidence.architectures') AS v0 FROM doc WHERE p = 'report')", 'v0', ('architecture',), False, 'report_id')},
rs AS (SELECT report_id, coalesce(key, '') AS parent, json_extract(e, '$.recipe') AS v0 FROM pr UNION ALL SELECT report_id, coalesce(key, ''), json_extract(e, '$.recipes') FROM pr UNION ALL SELECT report_id, coalesce(key, ''), json_extract(e, '$.recipe') FROM ar),
re AS {_entries('rs', 'v0', ('recipe_id',), False, 'report_id, parent')},
cl AS {_entries("(SELECT report_id, j AS v0 FROM doc WHERE p = 'per_class')", 'v0', ('label', 'name'), True, 'report_id')},
cs AS (SELECT report_id, coalesce(key, '') AS parent, json_extract(e, '$.confusions') AS v0 FROM cl),
co AS {_entries('cs', 'v0', ('label', 'name'), True, 'report_id, parent')},
wq AS {_entries("(SELECT report_id, json_extract(j, '$.worst_queries') AS v0 FROM doc WHERE p = 'diagnostics')", 'v0', ('query_id',), False, 'report_id')},
hs AS (SELECT report_id, coalesce(key, '') AS parent, json_extract(e, '$.hits') AS v0 FROM wq),
hi AS {_entries('hs', 'v0', ('gallery_id',), False, 'report_id, parent')},
c AS (SELECT report_id, 'probe' AS child_kind, '' AS parent_key, key AS child_key FROM pr UNION SELECT report_id, 'recipe', parent, key FROM re UNION SELECT report_id, 'class', '', key FROM cl
  UNION SELECT report_id, 'confusion', parent, key FROM co UNION SELECT report_id, 'worst_query', '', key FROM wq UNION SELECT report_id, 'hit', parent, key FROM hi)
SELECT report_id, child_kind, parent_key, child_key FROM c WHERE child_key IS NOT NULL"""

# p6: the rows of each readable line, one row per file, evaluation, extractor and key
_P6 = r"""WITH l AS (SELECT DISTINCT line_id, stream_id, file_seq, line_no, CASE WHEN json_valid(record) THEN CAST(record AS JSON) END AS j FROM monitor_lines),
r AS (SELECT line_id, stream_id, file_seq, TRY_CAST(j ->> '$.evaluation_index' AS BIGINT) AS ev, json_extract(j, '$.rows') AS v FROM l WHERE j IS NOT NULL),
u AS (SELECT line_id, stream_id, file_seq, ev, CASE WHEN json_type(v) = 'VARCHAR' AND json_valid(v ->> '$') THEN CAST(v ->> '$' AS JSON) ELSE v END AS v FROM r),
o AS (SELECT line_id, stream_id, file_seq, ev, unnest(CASE json_type(v) WHEN 'ARRAY' THEN CAST(v AS JSON[]) WHEN 'OBJECT' THEN [v] ELSE CAST([] AS JSON[]) END) AS x FROM u),
q AS (SELECT stream_id, file_seq, ev, x ->> '$.extractor' AS ex, x, unnest(json_keys(x)) AS field FROM o WHERE json_type(x) = 'OBJECT'),
k AS (SELECT stream_id, file_seq, ev, ex, field, json_extract(x, '$."' || field || '"') AS val FROM q),
t AS (SELECT stream_id, file_seq, field, list_sort(list_distinct(list(CASE WHEN json_type(val) IN ('UBIGINT', 'BIGINT', 'HUGEINT', 'UHUGEINT') THEN 'integer' WHEN json_type(val) = 'DOUBLE' THEN 'number' WHEN json_type(val) = 'VARCHAR' THEN 'string' WHEN json_type(val) = 'NULL' THEN NULL ELSE lower(json_type(val)) END))) AS types FROM k GROUP BY ALL),
f AS (SELECT stream_id, file_seq, lag(file_seq) OVER (PARTITION BY stream_id ORDER BY file_seq) AS prev FROM (SELECT DISTINCT stream_id, file_seq FROM t)),
a AS (SELECT f.stream_id, f.file_seq, prev, field, types FROM f JOIN t ON t.stream_id = f.stream_id AND t.file_seq = f.file_seq WHERE prev IS NOT NULL),
b AS (SELECT f.stream_id, f.file_seq, prev, field, types FROM f JOIN t ON t.stream_id = f.stream_id AND t.file_seq = f.prev),
d AS (SELECT coalesce(a.stream_id, b.stream_id) AS stream_id, coalesce(a.file_seq, b.file_seq) AS file_seq, coalesce(a.prev, b.prev) AS prev, coalesce(a.field, b.field) AS field,
  CASE WHEN a.field IS NULL THEN 'removed' WHEN b.field IS NULL THEN 'added' WHEN len(a.types) > 0 AND len(b.types) > 0 AND a.types <> b.types THEN 'type' END AS kind FROM a FULL JOIN b ON a.stream_id = b.stream_id AND a.file_seq = b.file_seq AND a.field = b.field),
p AS (SELECT g.stream_id, g.file_seq, g.prev, g.field, n.field AS new_field FROM d g JOIN d n ON n.stream_id = g.stream_id AND n.file_seq = g.file_seq WHERE g.kind = 'removed' AND n.kind = 'added'),
e AS (SELECT DISTINCT stream_id, file_seq, ev, ex FROM k WHERE ev IS NOT NULL AND ex IS NOT NULL),
s AS (SELECT p.*, x.ev, x.ex FROM p JOIN e x ON x.stream_id = p.stream_id AND x.file_seq = p.prev JOIN e y ON y.stream_id = p.stream_id AND y.file_seq = p.file_seq AND y.ev = x.ev AND y.ex = x.ex),
m AS (SELECT s.stream_id, s.file_seq, s.field, s.new_field FROM s LEFT JOIN k o ON o.stream_id = s.stream_id AND o.file_seq = s.prev AND o.ev = s.ev AND o.ex = s.ex AND o.field = s.field
  LEFT JOIN k w ON w.stream_id = s.stream_id AND w.file_seq = s.file_seq AND w.ev = s.ev AND w.ex = s.ex AND w.field = s.new_field
  GROUP BY ALL HAVING bool_and(coalesce(CAST(o.val AS VARCHAR), 'null') = coalesce(CAST(w.val AS VARCHAR), 'null')))
SELECT stream_id, file_seq, kind AS change_kind, field, '' AS new_field FROM d WHERE kind IS NOT NULL AND NOT EXISTS (SELECT 1 FROM m WHERE m.stream_id = d.stream_id AND m.file_seq = d.file_seq AND ((d.kind = 'removed' AND m.field = d.field) OR (d.kind = 'added' AND m.new_field = d.field)))
UNION ALL SELECT stream_id, file_seq, 'renamed', field, new_field FROM m"""

SQL = {
    "shard_coverage": _HELD + """, m AS (SELECT artifact_key AS artifact, max(n_samples) AS n_expected FROM memory_estimates GROUP BY 1), n AS (SELECT artifact_key AS artifact, CAST(sum(copies) AS BIGINT) AS n_rows, count(*) AS n_distinct FROM g GROUP BY 1)
SELECT artifact, n_expected, coalesce(n_rows, 0) AS n_rows, coalesce(n_distinct, 0) AS n_distinct, coalesce(n_rows, 0) = n_expected AND coalesce(n_distinct, 0) = n_expected AS complete FROM m LEFT JOIN n USING (artifact)""",
    "p2_found": _HELD + """,
e AS (SELECT artifact_key, unnest(range(0, max(n_samples))) AS sample_index FROM memory_estimates GROUP BY artifact_key)
SELECT artifact_key, sample_index, 'duplicate' AS fault FROM g WHERE copies > 1
UNION ALL SELECT artifact_key, sample_index, 'missing' AS fault FROM e ANTI JOIN g USING (artifact_key, sample_index)""",
    "p2_layout": _HELD + """,
w AS (SELECT artifact_key, max(embedding_dim * CASE WHEN dtype = 'float16' THEN 2 WHEN dtype = 'float64' THEN 8 WHEN dtype IN ('int8', 'uint8') THEN 1 ELSE 4 END) AS width FROM memory_estimates GROUP BY artifact_key),
n AS (SELECT g.*, coalesce(w.width, 4) AS width, row_number() OVER (PARTITION BY g.artifact_key ORDER BY sample_index) - 1 AS pos FROM g LEFT JOIN w USING (artifact_key)),
o AS (SELECT *, pos // greatest(1, 262144 // width) AS file_no FROM n)
SELECT artifact_key, CAST(file_no AS BIGINT) AS file_no, min(sample_index) AS first_index, max(sample_index) AS last_index, count(*) AS n_records, CAST(sum(width) AS BIGINT) AS n_bytes,
  CAST(CASE WHEN file_no = 0 THEN max(extra) ELSE 0 END AS BIGINT) AS n_extra_copies
FROM o JOIN (SELECT artifact_key, sum(copies - 1) AS extra FROM g GROUP BY artifact_key) USING (artifact_key) GROUP BY artifact_key, file_no""",
    "p2_files": _HELD + """,
w AS (SELECT artifact_key, max(embedding_dim * CASE WHEN dtype = 'float16' THEN 2 WHEN dtype = 'float64' THEN 8 WHEN dtype IN ('int8', 'uint8') THEN 1 ELSE 4 END) AS width FROM memory_estimates GROUP BY artifact_key),
n AS (SELECT g.*, (row_number() OVER (PARTITION BY g.artifact_key ORDER BY sample_index) - 1) // greatest(1, 262144 // coalesce(w.width, 4)) AS file_no FROM g LEFT JOIN w USING (artifact_key))
SELECT artifact_key, CAST(file_no AS BIGINT) AS file_no, min(sample_index) AS first_index, max(sample_index) AS last_index, count(*) AS n_records, true AS distinct, CAST(1 AS BIGINT) AS n_files FROM n GROUP BY ALL""",
    "p5_found": _P5,
    "recommendations": _P5.split(",\nc AS (")[0] + """, w AS (SELECT result_id, min(CAST(e ->> '$.f1' AS DOUBLE)) AS weakest FROM cl JOIN (SELECT DISTINCT report_id, result_id FROM score_reports) USING (report_id) GROUP BY result_id),
r AS (SELECT DISTINCT result_id, primary_score, target_type FROM results)
SELECT result_id, CASE WHEN primary_score IS NULL THEN '' WHEN target_type = 'regression' THEN CASE WHEN primary_score <= 0 THEN 'null-like' ELSE 'above-null' END WHEN primary_score >= 0.9 THEN 'strong' WHEN primary_score >= 0.8 THEN 'promising' WHEN primary_score >= 0.7 THEN 'moderate' ELSE 'poor' END
  || CASE WHEN weakest < 0.7 THEN CASE WHEN primary_score IS NULL THEN '' ELSE '; ' END || 'weak class' ELSE '' END AS advice FROM r LEFT JOIN w USING (result_id)""",
    "p6_found": _P6,
    "p6_schema": _P6.split(",\nf AS")[0] + """, z AS (SELECT field, list_sort(list_distinct(flatten(list(types)))) AS types, count(*) AS n_files, min(file_seq) AS first_seq, max(file_seq) AS last_seq FROM t GROUP BY field)
SELECT field, array_to_string(types, ', ') AS types, n_files, first_seq, last_seq, CASE len(types) WHEN 0 THEN 'string' WHEN 1 THEN types[1] ELSE CASE WHEN len(list_filter(types, lambda y: y NOT IN ('integer', 'number'))) = 0 THEN 'number' ELSE 'string' END END AS canonical FROM z""",
}
