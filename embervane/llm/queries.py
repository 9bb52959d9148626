"""Queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from embervane.llm import calibration, grouping, leakage, mixing, neighbours, truncation
from embervane.session import Scratch, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return calibration.shortfalls(calibration.probe_plan(spark, d)[0])


def p1_sample(spark: SparkSession, d: str) -> DataFrame:
    return calibration.draw(*calibration.probe_plan(spark, d))


def p1_plan(spark: SparkSession, d: str) -> DataFrame:
    plan = calibration.probe_plan(spark, d)[0]
    return plan.select("result_id", "label", "demand", "supply", F.round(F.col("expected") + 1e-7, 4).alias("expected"), F.col("unreachable").cast("bigint").alias("unreachable"))


def p1_totals(spark: SparkSession, d: str) -> DataFrame:
    plan, units = calibration.probe_plan(spark, d)
    plan = Scratch(spark).put(plan, "plan")
    return calibration.totals(plan, calibration.draw(plan, units))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    plan, units = calibration.probe_plan(spark, d)
    plan = Scratch(spark).put(plan, "plan")
    return calibration.report(plan, calibration.draw(plan, units))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_pairs(*neighbours.spatial(spark, d))


def p3_nearest(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.nearest(*neighbours.spatial(spark, d), k=10, every=50)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    related = grouping.related_sets(grouping.grouped_samples(spark, d))
    return related.where("component <> sample_id").select(F.col("component").alias("sample_id_a"), F.col("sample_id").alias("sample_id_b"))


def p4_splits(spark: SparkSession, d: str) -> DataFrame:
    related = Scratch(spark).put(grouping.related_sets(grouping.grouped_samples(spark, d)), "related")
    return grouping.assign_splits(related, table(spark, d, "split_targets"))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    related = grouping.related_sets(grouping.grouped_samples(spark, d))
    true = related.groupBy("dataset_key").agg(F.count_distinct("component").alias("n_groups"))
    results = table(spark, d, "results").where("probe_grouped").select("result_id", "dataset_key", "probe_n_groups").distinct()
    return results.join(true, "dataset_key", "left").select("result_id", "dataset_key", "probe_n_groups", "n_groups")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "split_targets")
    return grouping.split_report(p4_splits(spark, d), targets)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.benchmark_leaks(spark, d).select("doc_id", "item_id")


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(leakage.benchmark_leaks(spark, d), table(spark, d, "benchmark"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.short_sources(mixing.corpus_mix(spark, d)[1])


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    counts, plan = mixing.corpus_mix(spark, d)
    return mixing.realise(counts, Scratch(spark).put(plan, "plan"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    counts, plan = mixing.corpus_mix(spark, d)
    plan = Scratch(spark).put(plan, "plan")
    return mixing.mix_report(plan, mixing.realise(counts, plan))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.corpus_scores(spark, d).where("log_odds > 0").select("doc_id")


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_report(truncation.corpus_scores(spark, d))


QUERIES = {
    "p1_found": p1_found, "p1_plan": p1_plan, "p1_sample": p1_sample, "p1_report": p1_report, "p1_totals": p1_totals,
    "p3_found": p3_found, "p3_nearest": p3_nearest,
    "p4_found": p4_found, "p4_splits": p4_splits, "p4_groups": p4_groups, "p4_report": p4_report,
    "p7_found": p7_found, "p7_items": p7_items,
    "p8_found": p8_found, "p8_mix": p8_mix, "p8_report": p8_report,
    "p9_found": p9_found, "p9_report": p9_report,
}

BLANK = "'^[\\s\\x{00a0}]+|[\\s\\x{00a0}]+$'"
# an item's opening sentence, cut at . ? or ! before a blank, is not own text where two items share it
_OWN = r"""cut AS (SELECT item_id, text, regexp_extract(text, '^(.*?[.?!])\s', 1, 's') AS opening FROM (SELECT DISTINCT item_id, trim(text) AS text FROM benchmark)),
common AS (SELECT lower(opening) AS o FROM cut WHERE opening <> '' GROUP BY 1 HAVING count(DISTINCT item_id) > 1),
own AS (SELECT item_id, CASE WHEN o IS NULL THEN text ELSE substr(text, length(opening) + 1) END AS text FROM cut LEFT JOIN common ON lower(opening) = o),"""
_WORDS = r"list_filter(string_split_regex(regexp_replace(regexp_replace(lower(text), '<[^<>]{0,200}>', ' ', 'g'), '[^\p{L}\p{M}\p{N}\s\p{Z}]', '', 'g'), '[\s\p{Z}]+'), lambda w: w <> '')"

_PLANS = f"""WITH RECURSIVE u AS (SELECT dataset_key, regexp_replace(lower(l), {BLANK}, '', 'g') AS cat FROM (SELECT dataset_key, unnest(labels) AS l FROM (SELECT DISTINCT parent_id, dataset_key, labels FROM unit_annotations))),
s AS (SELECT dataset_key, cat, count(*) AS n FROM u WHERE cat <> '' GROUP BY ALL),
t AS (SELECT dataset_key, regexp_replace(lower(label), {BLANK}, '', 'g') AS cat, min(label) AS label, sum(target_percent) AS percent, max(min_samples) AS least FROM (SELECT DISTINCT * FROM sample_targets) GROUP BY ALL),
r AS (SELECT DISTINCT result_id, dataset_key, probe_n_samples_used AS size FROM results WHERE probe_n_samples_used IS NOT NULL),
c AS (SELECT r.result_id, r.size, t.label, greatest((r.size * t.percent + 99) // 100, t.least)::BIGINT AS demand, coalesce(s.n, 0) AS supply, r.size * t.percent / 100.0 AS share, CAST(least(t.least, coalesce(s.n, 0)) AS DOUBLE) AS low,
  CASE WHEN r.size * t.percent > 0 THEN coalesce(s.n, 0) ELSE least(t.least, coalesce(s.n, 0)) END AS high FROM r JOIN t USING (dataset_key) LEFT JOIN s ON s.dataset_key = t.dataset_key AND s.cat = t.cat),
w AS (SELECT result_id, greatest(sum(low), least(sum(high), max(size)))::DOUBLE AS want, list({{'share': share, 'low': low, 'high': high}}) AS parts, coalesce(max(CASE WHEN share > 0 THEN greatest(high, low) / share END), 0) AS top FROM c GROUP BY result_id),
b(result_id, lo, hi, k) AS (SELECT result_id, CAST(0 AS DOUBLE), top::DOUBLE, 0 FROM w UNION ALL
  SELECT result_id, CASE WHEN got < want THEN mid ELSE lo END, CASE WHEN got < want THEN hi ELSE mid END, k + 1
  FROM (SELECT b.*, (lo + hi) / 2 AS mid, want, list_sum(list_transform(parts, lambda p: greatest(p.low, least(p.high, p.share * (lo + hi) / 2)))) AS got FROM b JOIN w USING (result_id) WHERE k < 80)),
e AS (SELECT c.*, greatest(low, least(high, share * hi)) AS expected FROM c JOIN (SELECT result_id, hi FROM b WHERE k = 80) USING (result_id))"""
_SETS = f"""WITH RECURSIVE g AS (SELECT DISTINCT sample_id, dataset_key, groups FROM sample_groups WHERE dataset_key IN (SELECT dataset_key FROM results WHERE probe_grouped)),
e AS (SELECT sample_id, dataset_key, unnest(groups) AS x FROM g),
k AS (SELECT DISTINCT sample_id, dataset_key, regexp_replace(lower(split_part(x, ':', 1)), {BLANK}, '', 'g') AS tag, regexp_replace(lower(substr(x, instr(x, ':') + 1)), {BLANK}, '', 'g') AS val FROM e WHERE contains(x, ':')),
m AS (SELECT sample_id, min(sample_id) OVER (PARTITION BY dataset_key, tag, val) AS rep FROM k WHERE tag <> '' AND NOT regexp_full_match(val, '[-?]*|n/?a|nan|nil|null|none|missing|(not )?known|unknown|unspecified')),
l AS (SELECT DISTINCT sample_id AS a, rep AS b FROM m WHERE sample_id <> rep UNION SELECT DISTINCT rep, sample_id FROM m WHERE sample_id <> rep),
c(a, b) AS (SELECT a, a FROM l UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a),
d AS (SELECT a, min(b) AS low FROM c GROUP BY a), q AS (SELECT DISTINCT g.sample_id, g.dataset_key, coalesce(d.low, g.sample_id) AS component FROM g LEFT JOIN d ON d.a = g.sample_id)"""
_SPLIT = _SETS + """, z AS (SELECT dataset_key, component, count(*) AS n FROM q GROUP BY ALL),
o AS (SELECT dataset_key, component, (sum(n) OVER (PARTITION BY dataset_key ORDER BY md5(CAST(component AS VARCHAR)), component) - n / 2.0) / sum(n) OVER (PARTITION BY dataset_key) AS mid FROM z),
x AS (SELECT split_name, target_share / sum(target_share) OVER () AS target_share, sum(target_share) OVER (ORDER BY split_name) / sum(target_share) OVER () AS upto, row_number() OVER (ORDER BY split_name DESC) AS back FROM (SELECT DISTINCT * FROM split_targets) WHERE target_share > 0),
y AS (SELECT dataset_key, component, coalesce(min(CASE WHEN mid <= upto THEN split_name END), max(CASE WHEN back = 1 THEN split_name END)) AS split_name FROM o, x GROUP BY ALL)"""
_TOKENLESS = r"""WITH d AS (SELECT doc_id, regexp_replace(regexp_replace(lower(source), '^[\s\x{00a0}]+|[\s\x{00a0}]+$', '', 'g'), '[-\s\x{00a0}]', '_', 'g') AS source, length(text) AS n FROM (SELECT DISTINCT doc_id, source, text FROM documents)),
s AS (SELECT source, coalesce(sum(n), 0) AS n FROM d WHERE source <> '' GROUP BY source)"""

SQL = {
    "p1_found": f"""WITH u AS (SELECT dataset_key, regexp_replace(lower(l), {BLANK}, '', 'g') AS cat FROM (SELECT dataset_key, unnest(labels) AS l FROM (SELECT DISTINCT parent_id, dataset_key, labels FROM unit_annotations))),
s AS (SELECT dataset_key, cat, count(*) AS n FROM u WHERE cat <> '' GROUP BY ALL),
t AS (SELECT DISTINCT dataset_key, label, target_percent, min_samples FROM sample_targets),
r AS (SELECT DISTINCT result_id, dataset_key, probe_n_samples_used AS n FROM results WHERE probe_n_samples_used IS NOT NULL)
SELECT r.result_id, t.label FROM r JOIN t USING (dataset_key) LEFT JOIN s ON s.dataset_key = t.dataset_key AND s.cat = lower(trim(t.label))
WHERE greatest((r.n * t.target_percent + 99) // 100, t.min_samples) > coalesce(s.n, 0)""",
    "p1_plan": _PLANS + " SELECT result_id, label, demand, supply, round(expected + 1e-7, 4) AS expected, greatest(demand - supply, 0) AS unreachable FROM e",
    "p1_totals": _PLANS + " SELECT result_id, CAST(want AS BIGINT) AS n_drawn, CAST(want AS BIGINT) AS n_expected, true AS within_one FROM w",
    # brute force over all pairs of an output
    "p3_found": """WITH v AS (SELECT DISTINCT token_id, output_name, CAST(embeddings AS DOUBLE[]) AS x FROM spatial_tokens JOIN (SELECT DISTINCT output_name, embedding_dim FROM spatial_outputs) USING (output_name)
  WHERE token_id IS NOT NULL AND len(embeddings) = embedding_dim AND len(list_filter(embeddings, lambda y: y IS NOT NULL AND isfinite(y))) = embedding_dim),
u AS (SELECT token_id, output_name, list_transform(x, lambda y: y / sqrt(list_dot_product(x, x))) AS x FROM v WHERE list_dot_product(x, x) > 0)
SELECT a.token_id AS token_id_a, b.token_id AS token_id_b FROM u a JOIN u b ON a.output_name = b.output_name AND a.token_id < b.token_id WHERE list_dot_product(a.x, b.x) >= 0.95""",
    "p4_found": _SETS + " SELECT component AS sample_id_a, sample_id AS sample_id_b FROM q WHERE component <> sample_id",
    "p4_splits": _SPLIT + " SELECT sample_id, q.dataset_key, q.component, split_name FROM q JOIN y USING (dataset_key, component)",
    "p4_groups": _SETS + ", n AS (SELECT dataset_key, count(DISTINCT component) AS n_groups FROM q GROUP BY ALL) SELECT result_id, dataset_key, probe_n_groups, n_groups FROM (SELECT DISTINCT result_id, dataset_key, probe_n_groups FROM results WHERE probe_grouped) LEFT JOIN n USING (dataset_key)",
    "p4_report": _SPLIT + """, r AS (SELECT dataset_key, split_name, sum(n)::BIGINT AS n_samples, count(*) AS n_components FROM y JOIN z USING (dataset_key, component) GROUP BY ALL), v AS (SELECT dataset_key, sum(n)::BIGINT AS total FROM z GROUP BY ALL)
SELECT v.dataset_key, x.split_name, coalesce(n_samples, 0) AS n_samples, coalesce(n_components, 0) AS n_components, round(coalesce(n_samples, 0) / total, 6) AS reached_share, round(target_share, 6) AS target_share
FROM v CROSS JOIN x LEFT JOIN r ON r.dataset_key = v.dataset_key AND r.split_name = x.split_name""",
    # no case lies close to the limit, so characters stand in for tokens
    "p8_found": _TOKENLESS + r""", t AS (SELECT mix_id, regexp_replace(regexp_replace(lower(source), '^[\s\x{00a0}]+|[\s\x{00a0}]+$', '', 'g'), '[-\s\x{00a0}]', '_', 'g') AS source, size_factor, target_weight, max_repeats FROM (SELECT DISTINCT * FROM mix_targets))
SELECT mix_id, t.source FROM t LEFT JOIN s USING (source) WHERE target_weight * size_factor * (SELECT sum(n) FROM s) > max_repeats * coalesce(s.n, 0)""",
    "p7_found": f"""WITH {_OWN}
iw AS (SELECT item_id, {_WORDS} AS w FROM own), dw AS (SELECT doc_id, {_WORDS} AS w FROM (SELECT DISTINCT doc_id, text FROM documents)),
i12 AS (SELECT DISTINCT item_id, array_to_string(w[k + 1:k + 12], ' ') AS p FROM (SELECT item_id, w, unnest(range(len(w) - 11)) AS k FROM iw)),
d12 AS (SELECT DISTINCT doc_id, array_to_string(w[k + 1:k + 12], ' ') AS p FROM (SELECT doc_id, w, unnest(range(len(w) - 11)) AS k FROM dw))
SELECT DISTINCT doc_id, item_id FROM d12 JOIN i12 USING (p)""",
    "p7_items": f"""WITH {_OWN}
iw AS (SELECT item_id, {_WORDS} AS w FROM own), dw AS (SELECT doc_id, {_WORDS} AS w FROM (SELECT DISTINCT doc_id, text FROM documents)),
i12 AS (SELECT item_id, n, k, array_to_string(w[k + 1:k + 12], ' ') AS p FROM (SELECT item_id, w, len(w) AS n, unnest(range(len(w) - 11)) AS k FROM iw)),
d12 AS (SELECT DISTINCT doc_id, array_to_string(w[k + 1:k + 12], ' ') AS p FROM (SELECT doc_id, w, unnest(range(len(w) - 11)) AS k FROM dw)),
m AS (SELECT doc_id, item_id, n, unnest(range(k, k + 12)) AS word FROM d12 JOIN i12 USING (p)), c AS (SELECT doc_id, item_id, count(DISTINCT word) / max(n) AS share FROM m GROUP BY ALL),
g AS (SELECT item_id, count(*) AS n_docs, max(round(share, 6)) AS largest_share FROM c GROUP BY item_id)
SELECT item_id, task, coalesce(n_docs, 0) AS n_docs, coalesce(largest_share, 0) AS largest_share FROM (SELECT DISTINCT item_id, task FROM benchmark) LEFT JOIN g USING (item_id)""",
}
