"""Queries of the representation-evaluation operators, each with its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from embervane.functions import vectors as V
from embervane.operators import complexity, compression as C, labels as L, metrics as K, probe as P, prototypes as O, resources, results as R, retrieval as T, structured as S, targets as G
from embervane.plans import benchmark as B
from embervane.session import Scratch, table
from embervane.sources import datasets as D, extractors as X
from embervane.streaming import monitor as M

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def emb(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vec"), F.col("label").cast("bigint").alias("label"))


def r6(name: str):
    return F.round(name, 6).alias(name)


E = "e AS (SELECT vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS vec, CAST(label AS BIGINT) AS label FROM embeddings)"
U = "u AS (SELECT row_id, label, list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec))) AS vec FROM e)"
MD5 = "md5('42|' || CAST({} AS VARCHAR))"

# --- vector algebra ---------------------------------------------------------------------------------------


@query(f"WITH {E} SELECT row_id, round(sqrt(list_dot_product(vec, vec)), 6) AS norm, len(vec) = 64 AND list_bool_and(list_transform(vec, lambda x: isfinite(x))) AS valid FROM e")
def vector_norms(spark, d):
    return emb(spark, d).select("row_id", F.round(V.norm(F.col("vec")), 6).alias("norm"), V.valid(F.col("vec"), 64).alias("valid"))


_PAIRS = f"WITH {E}, p AS (SELECT a.row_id, a.vec AS a, b.vec AS b FROM e a JOIN e b ON b.row_id = a.row_id + 1)"


def _pairs(spark, d):
    e = emb(spark, d)
    return e.select("row_id", F.col("vec").alias("a")).join(e.select((F.col("row_id") - 1).alias("row_id"), F.col("vec").alias("b")), "row_id")


@query(_PAIRS + " SELECT row_id, round(list_dot_product(a, b), 6) AS dot, round(list_cosine_similarity(a, b), 6) AS cosine, round(list_sum(list_transform(list_zip(a, b), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), 6) AS squared_l2 FROM p")
def pair_similarities(spark, d):
    a, b = F.col("a"), F.col("b")
    return _pairs(spark, d).select("row_id", F.round(V.dot(a, b), 6).alias("dot"), F.round(V.cosine(a, b), 6).alias("cosine"), F.round(V.squared_l2(a, b), 6).alias("squared_l2"))


@query(_PAIRS + """, z AS (SELECT row_id, a, b, list_zip(a, b) AS z FROM p)
SELECT row_id, len(a) + len(b) AS concat_n, round(list_sum(a) + list_sum(b), 6) AS concat_sum, round(list_sum(list_transform(z, lambda x: x[1] * x[2])), 6) AS hadamard_sum,
round(list_sum(list_transform(z, lambda x: abs(x[1] - x[2]))), 6) AS abs_diff_sum, round(list_sum(list_transform(z, lambda x: (x[1] + x[2]) / 2)), 6) AS average_sum FROM z""")  # fmt: skip
def edge_compositions(spark, d):
    e = emb(spark, d)
    nodes = e.select(F.col("row_id").alias("id"), "vec")
    edges = e.select("row_id", F.col("row_id").alias("src"), (F.col("row_id") + 1).alias("dst")).join(e.select(F.col("row_id").alias("dst")), "dst", "left_semi")
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda s, x: s + x), 6)
    out = None
    for how in V.COMPOSITIONS:
        v = D.compose_edges(edges, nodes, how).select("row_id", total(F.col("vec")).alias(f"{how}_sum"), *([F.size("vec").cast("bigint").alias("concat_n")] if how == "concat" else []))
        out = v if out is None else out.join(v, "row_id")
    return out


@query(f"""WITH {E} SELECT a.row_id, CAST(2 * len(a.vec) AS INT) AS width,
round(list_sum(list_transform(list_zip(a.vec, p.vec), lambda x: x[1] * x[2])) + 2 * list_sum(list_transform(list_zip(a.vec, n.vec), lambda x: x[1] * x[2])), 6) AS weighted
FROM e a JOIN e p ON p.row_id = a.row_id + 1 JOIN e n ON n.row_id = a.row_id + 2""")
def triplet_composition(spark, d):
    e = emb(spark, d)
    ids = e.select("row_id")
    t = e.select("row_id", F.col("row_id").alias("anchor"), (F.col("row_id") + 1).alias("positive"), (F.col("row_id") + 2).alias("negative")).join(ids.select(F.col("row_id").alias("negative")), "negative", "left_semi")
    v = D.compose_triplets(t, e.select(F.col("row_id").alias("id"), "vec"), "hadamard")
    half = (F.size("vec") / 2).cast("int")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    return v.select("row_id", F.size("vec").alias("width"), F.round(total(F.slice("vec", F.lit(1), half)) + 2 * total(F.slice("vec", half + 1, half)), 6).alias("weighted"))


@query(f"WITH {E} SELECT row_id, round(list_sum(vec[1:16]), 6) AS head_sum, CAST(len(vec[1:16]) AS INT) AS width FROM e")
def prefix_truncation(spark, d):
    v = V.doubles(V.prefix(F.col("vec"), 16))
    return emb(spark, d).select("row_id", F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 6).alias("head_sum"), F.size(v).alias("width"))


_DIMS = f"WITH {E}, x AS (SELECT row_id, unnest(vec) AS x, unnest(range(1, len(vec) + 1)) AS pos FROM e), c AS (SELECT pos, min(x) AS lo, max(x) AS hi, max(abs(x)) AS peak FROM x GROUP BY pos)"


@query(_DIMS + ", q AS (SELECT row_id, x, s, greatest(-127, least(127, round_even(x / s * 127, 0))) * s / 127 AS y FROM x JOIN (SELECT pos, CASE WHEN peak = 0 THEN 1 ELSE peak END AS s FROM c) USING (pos)) SELECT row_id, round(sum(y), 5) AS total, round(max(abs(x - y)), 6) AS worst FROM q GROUP BY row_id")
def quantize_int8(spark, d):
    return _quantized(spark, d, "int8")


@query(_DIMS + ", q AS (SELECT row_id, x, greatest(0, least(255, round_even((x - lo) / s * 255, 0))) * s / 255 + lo AS y FROM x JOIN (SELECT pos, lo, CASE WHEN hi = lo THEN 1 ELSE hi - lo END AS s FROM c) USING (pos)) SELECT row_id, round(sum(y), 5) AS total, round(max(abs(x - y)), 6) AS worst FROM q GROUP BY row_id")
def quantize_uint8(spark, d):
    return _quantized(spark, d, "uint8")


def _quantized(spark, d, how):
    e = emb(spark, d)
    q = C.quantize(e.withColumn("old", V.doubles(F.col("vec"))), how)
    total = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x)
    return q.select("row_id", F.round(total, 5).alias("total"), F.round(F.array_max(F.zip_with("vec", "old", lambda x, y: F.abs(x - y))), 6).alias("worst"))


@query(f"""WITH {E}, x AS (SELECT row_id, unnest(vec) AS x, unnest(range(0, len(vec))) AS i FROM e), j AS (SELECT unnest(range(0, 4)) AS j),
s AS (SELECT i, j, CASE WHEN substr(md5(CAST(i AS VARCHAR) || '|' || CAST(j AS VARCHAR)), 1, 1) < '8' THEN 1.0 ELSE -1.0 END AS s FROM (SELECT unnest(range(0, 64)) AS i), j)
SELECT row_id, j, round(sum(x * s) / 2, 6) AS value FROM x JOIN s USING (i) GROUP BY ALL""")
def sign_projection(spark, d):
    return C.sign_projection(emb(spark, d), 4).select("row_id", F.posexplode("vec").alias("j", "value")).select("row_id", F.col("j").cast("bigint").alias("j"), r6("value"))


@query()
def principal_components(spark, d):
    return C.pca(emb(spark, d), 8).select("row_id", F.transform("vec", lambda x: F.round(x, 6)).alias("vec"))


@query()
def truncated_svd(spark, d):
    return C.pca(emb(spark, d), 8, center=False).select("row_id", F.transform("vec", lambda x: F.round(x, 6)).alias("vec"))


@query()
def gaussian_projection(spark, d):
    return C.gaussian_projection(emb(spark, d), 64, 16)


@query()
def sparse_projection(spark, d):
    return C.sparse_projection(emb(spark, d), 64, 16)


@query()
def float16_round_trip(spark, d):
    return C.float16(emb(spark, d))


# --- targets ----------------------------------------------------------------------------------------------


@query("SELECT label, count(*) AS n FROM embeddings WHERE label IS NOT NULL GROUP BY label")
def class_counts(spark, d):
    return G.class_counts(table(spark, d, "embeddings"), "label")


_UA = "a AS (SELECT DISTINCT parent_id, dataset_key, coarse, labels FROM unit_annotations)"


def annotations(spark, d):
    return table(spark, d, "unit_annotations").select("parent_id", "dataset_key", "coarse", "labels").distinct()


@query(f"WITH {_UA} SELECT label, count(*) AS n FROM (SELECT unnest(list_distinct(labels)) AS label FROM a) WHERE label IS NOT NULL GROUP BY label")
def multilabel_counts(spark, d):
    return G.multilabel_counts(annotations(spark, d), "labels")


@query(f"WITH {_UA} SELECT array_to_string(list_sort(list_distinct(labels)), '|') AS labelset, count(*) AS n FROM a WHERE labels IS NOT NULL GROUP BY 1")
def labelset_counts(spark, d):
    return G.labelset_counts(annotations(spark, d), "labels")


@query("WITH u AS (SELECT user_id, list_distinct(list(event_type)) AS labels FROM events GROUP BY user_id) SELECT count(*) AS n_rows, round(avg(len(labels)), 6) AS cardinality, round(avg(len(labels)) / (SELECT count(DISTINCT event_type) FROM events), 6) AS density FROM u")
def multilabel_summary(spark, d):
    ev = table(spark, d, "events")
    return G.target_summary(ev.groupBy("user_id").agg(F.collect_set("event_type").alias("labels")), "labels", ev.select("event_type").distinct().count())


@query("SELECT user_id, CAST(bool_or(event_type = 'click') AS INT) AS click, CAST(bool_or(event_type = 'purchase') AS INT) AS purchase, CAST(bool_or(event_type = 'view') AS INT) AS view FROM events GROUP BY user_id")
def multilabel_indicator(spark, d):
    u = table(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("labels"))
    names = ["click", "purchase", "view"]
    return u.select("user_id", G.indicator(F.col("labels"), names).alias("x")).select("user_id", *(F.col("x")[i].alias(n) for i, n in enumerate(names)))


@query("SELECT count(o_totalprice) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS std, min(o_totalprice) AS low, max(o_totalprice) AS high, min(o_totalprice) = max(o_totalprice) AS constant FROM orders")
def regression_summary(spark, d):
    return G.regression_summary(table(spark, d, "orders"), "o_totalprice")


@query("WITH c AS (SELECT count(*) AS n FROM embeddings WHERE label IS NOT NULL GROUP BY label) SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_classes, min(n) AS smallest, count(*) >= 2 AND min(n) >= 2 AS valid FROM c")
def validate_dataset(spark, d):
    return G.validate(table(spark, d, "embeddings"), "label")


@query(f"WITH e AS (SELECT vec_id, label, count(*) OVER (PARTITION BY label) AS n, row_number() OVER (PARTITION BY label ORDER BY {MD5.format('vec_id')}, vec_id) AS r FROM embeddings) SELECT vec_id, label FROM e WHERE r <= greatest(1, least(n, CASE WHEN n >= 5 THEN greatest(5, floor(n * 0.1)) ELSE floor(n * 0.1) END))")
def stratified_subsample(spark, d):
    return G.stratified_subsample(table(spark, d, "embeddings"), "vec_id", "label", 0.1, 5).select("vec_id", "label")


@query(f"""WITH a AS (SELECT * FROM (SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1) UNION SELECT * FROM (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1))
SELECT o_orderkey FROM a UNION ALL SELECT * FROM (SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM a) ORDER BY {MD5.format('o_orderkey')}, o_orderkey LIMIT 98)""")
def regression_subsample(spark, d):
    return G.regression_subsample(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", "o_totalprice", 100).select("o_orderkey")


@query("""WITH p AS (SELECT c_custkey, r_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT sha256('["' || r_name || '"]') AS level_0, sha256('["' || r_name || '","' || n_name || '"]') AS level_1, count(*) AS n FROM p GROUP BY ALL""")
def label_hierarchy(spark, d):
    p = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    p = p.select(F.array("r_name", "n_name").alias("path"))
    return p.select(G.label_view(F.col("path"), 0).alias("level_0"), G.label_view(F.col("path"), -1).alias("level_1")).groupBy("level_0", "level_1").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT view, label, count(*) AS n FROM (SELECT 'lang' AS view, lang AS label FROM documents UNION ALL SELECT 'source', source FROM documents) WHERE label IS NOT NULL GROUP BY ALL""")
def target_views(spark, d):
    return G.target_views(table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id", ["lang", "source"]).groupBy("view", "label").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n, count(DISTINCT label) AS n_classes FROM embeddings WHERE label NOT IN (0, 3)")
def exclude_classes(spark, d):
    return G.exclude_classes(table(spark, d, "embeddings"), "label", [0, 3]).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("label").alias("n_classes"))


# --- retrieval --------------------------------------------------------------------------------------------

_LOO = f"""WITH {E}, {U}, s AS (SELECT q.row_id AS q, g.row_id AS g, q.label = g.label AS rel, round(list_dot_product(q.vec, g.vec), 10) AS sc FROM u q JOIN u g ON q.row_id <> g.row_id),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sc DESC, g) AS rk FROM s), p AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY rk) AS j FROM k WHERE rel),
m AS (SELECT q, count(*) AS n_positive, 1.0 / min(rk) AS mrr, avg(j / rk) AS map, sum(CAST(rk <= 10 AS INT)) / 10 AS precision_10, sum(CAST(rk <= 10 AS INT)) / count(*) AS recall_10, CAST(min(rk) <= 10 AS DOUBLE) AS hit_10,
  sum(CASE WHEN rk <= 10 THEN 1 / log2(rk + 1) ELSE 0 END) / sum(CASE WHEN j <= 10 THEN 1 / log2(j + 1) ELSE 0 END) AS ndcg_10, max(sc) AS best FROM p GROUP BY q)"""


def _loo(spark, d):
    return T.label_scores(emb(spark, d), ks=(10,))


@query(_LOO + " SELECT count(*) AS n_queries, round(avg(mrr), 6) AS mrr, round(avg(map), 6) AS map, round(avg(precision_10), 6) AS precision_10, round(avg(recall_10), 6) AS recall_10, round(avg(hit_10), 6) AS hit_10, round(avg(ndcg_10), 6) AS ndcg_10 FROM m")
def label_retrieval(spark, d):
    return T.mean_metrics(_loo(spark, d))


@query(_LOO + " SELECT q, round(ndcg_10, 6) AS ndcg_10 FROM m ORDER BY round(ndcg_10, 6), q LIMIT 10")
def worst_queries(spark, d):
    return T.worst_queries(_loo(spark, d).withColumn("ndcg_10", F.round("ndcg_10", 6)), "ndcg_10", 10).select("q", "ndcg_10")


@query(_LOO + ", n AS (SELECT q, max(sc) AS neg FROM k WHERE NOT rel GROUP BY q) SELECT round(avg(best - neg), 6) AS mean, round(median(best - neg), 6) AS median, round(min(best - neg), 6) AS min, round(max(best - neg), 6) AS max FROM m JOIN n USING (q)")
def retrieval_margins(spark, d):
    return T.margin_summary(_loo(spark, d))


_GRADED = f"""WITH {E}, {U}, s AS (SELECT q.row_id AS q, g.row_id AS g, CASE WHEN q.label = g.label THEN 1 + g.row_id % 3 ELSE 0 END AS grade, round(list_dot_product(q.vec, g.vec), 10) AS sc FROM u q JOIN u g ON q.row_id % 50 = 0 AND g.row_id % 50 <> 0 WHERE (q.row_id + g.row_id) % 7 <> 0),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sc DESC, g) AS rk FROM s), p AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY rk) AS j, row_number() OVER (PARTITION BY q ORDER BY grade DESC, g) AS i FROM k WHERE grade > 0)"""


_GRADED_ALL = _GRADED.replace("q.row_id % 50 = 0 AND g.row_id % 50 <> 0 WHERE (q.row_id + g.row_id) % 7 <> 0", "q.row_id % 50 = 0 AND g.row_id <> q.row_id")
_GRADED_METRICS = """ SELECT q, count(*) AS n_positive, round(1.0 / min(rk), 6) AS mrr, round(avg(j / rk), 6) AS map, round(sum(CAST(rk <= 5 AS INT)) / 5, 6) AS precision_5, round(sum(CAST(rk <= 5 AS INT)) / count(*), 6) AS recall_5, CAST(min(rk) <= 5 AS DOUBLE) AS hit_5,
round(sum(CASE WHEN rk <= 5 THEN (pow(2, grade) - 1) / log2(rk + 1) ELSE 0 END) / sum(CASE WHEN i <= 5 THEN (pow(2, grade) - 1) / log2(i + 1) ELSE 0 END), 6) AS ndcg_5 FROM p GROUP BY q"""


@query(_GRADED + _GRADED_METRICS)
def graded_retrieval(spark, d):
    """Graded relevance with exclusions; queries are the rows whose id is divisible by 50, against the rest without
    the pairs whose ids sum to a multiple of 7. ``graded_retrieval_all`` searches every row."""
    e = emb(spark, d)
    q, g = e.where("row_id % 50 = 0"), e.where("row_id % 50 <> 0")
    rel = q.select(F.col("row_id").alias("q"), "label").join(g.select(F.col("row_id").alias("g"), "label"), "label").select("q", "g", (1 + F.col("g") % 3).alias("grade"))
    excl = q.select(F.col("row_id").alias("q"), F.pmod(-F.col("row_id"), F.lit(7)).alias("m")).join(g.select(F.col("row_id").alias("g"), (F.col("row_id") % 7).alias("m")), "m").select("q", "g")
    m = T.query_scores(q.select(F.col("row_id").alias("q"), "vec"), g.select(F.col("row_id").alias("g"), "vec"), rel, excl, ks=(5,))
    return m.select("q", "n_positive", *(r6(c) for c in ("mrr", "map", "precision_5", "recall_5", "hit_5", "ndcg_5")))


@query(_GRADED_ALL + _GRADED_METRICS)
def graded_retrieval_all(spark, d):
    """Graded relevance; queries are the rows whose id is divisible by 50, against all rows but themselves."""
    e = emb(spark, d)
    q = e.where("row_id % 50 = 0")
    rel = q.select(F.col("row_id").alias("q"), "label").join(e.select(F.col("row_id").alias("g"), "label"), "label").where("q <> g").select("q", "g", (1 + F.col("g") % 3).alias("grade"))
    r = T.query_scores(q.select(F.col("row_id").alias("q"), "vec"), e.select(F.col("row_id").alias("g"), "vec"), rel, exclude_self=True, ks=(5,))
    return r.select("q", "n_positive", *(r6(c) for c in ("mrr", "map", "precision_5", "recall_5", "hit_5", "ndcg_5")))


# --- zero-shot --------------------------------------------------------------------------------------------

_PROMPT = f"row_number() OVER (PARTITION BY label ORDER BY {MD5.format('row_id')}, row_id)"
_ZS = f"""WITH {E}, {U}, n AS (SELECT *, {_PROMPT} AS r FROM u), m AS (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(vec) AS x, unnest(range(1, len(vec) + 1)) AS pos FROM n WHERE r <= 5) GROUP BY ALL),
a AS (SELECT label, list(x ORDER BY pos) AS v FROM m GROUP BY label), p AS (SELECT label, sqrt(list_dot_product(v, v)) AS coherence, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM a),
s AS (SELECT n.row_id, n.label, p.label AS cls, round(list_dot_product(n.vec, p.v), 12) AS sim FROM n, p WHERE n.r > 5), k AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY sim DESC, cls) AS rk FROM s),
t AS (SELECT row_id, label, max(CASE WHEN rk = 1 THEN cls END) AS predicted, max(CASE WHEN rk = 1 THEN sim END) - max(CASE WHEN rk = 2 THEN sim END) AS margin, CAST(min(CASE WHEN cls = label THEN rk END) <= 5 AS INT) AS top_5 FROM k GROUP BY row_id, label)"""


def _zs_parts(spark, d):
    e = Scratch(spark).put(G.hash_rank(emb(spark, d), ["label"], "row_id", name="r"), "ranked")
    return e.where("r <= 5"), e.where("r > 5")


def _zs(spark, d):
    prompts, samples = _zs_parts(spark, d)
    return O.zero_shot(samples, O.class_prototypes(prompts))


@query(_ZS + " SELECT row_id, label, predicted, round(margin, 6) AS margin, top_5 FROM t")
def zero_shot_predictions(spark, d):
    return _zs(spark, d).select("row_id", "label", "predicted", r6("margin"), "top_5")


@query(_ZS + " SELECT label, round(coherence, 6) AS coherence, CAST(5 AS BIGINT) AS n_prompts FROM p")
def zero_shot_prototypes(spark, d):
    return O.class_prototypes(_zs_parts(spark, d)[0]).select("label", r6("coherence"), "n_prompts")


@query(_ZS + " SELECT label, predicted, count(*) AS n FROM t GROUP BY ALL")
def zero_shot_confusion(spark, d):
    return O.confusion(_zs(spark, d))


_PRF = ", c AS (SELECT label, count(*) AS support, sum(CAST(label = predicted AS INT)) AS hit FROM t GROUP BY label), b AS (SELECT predicted AS label, count(*) AS called FROM t GROUP BY predicted), f AS (SELECT label, coalesce(support, 0) AS support, coalesce(hit / nullif(called, 0), 0) AS precision, coalesce(hit / nullif(support, 0), 0) AS recall FROM c FULL JOIN b USING (label)), g AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM f)"


@query(_ZS + _PRF + " SELECT label, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM g")
def zero_shot_per_class(spark, d):
    return O.per_class(O.confusion(_zs(spark, d))).select("label", "support", r6("precision"), r6("recall"), r6("f1"))


@query(_ZS + _PRF + " SELECT round((SELECT avg(CAST(label = predicted AS INT)) FROM t), 6) AS accuracy, round(avg(recall), 6) AS balanced_accuracy, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM g")
def zero_shot_summary(spark, d):
    return O.classification_summary(O.confusion(_zs(spark, d)))


@query(_ZS + " SELECT row_id, label, predicted, round(margin, 6) AS margin FROM t ORDER BY round(margin, 6), row_id LIMIT 10")
def zero_shot_worst_samples(spark, d):
    return _zs(spark, d).select("row_id", "label", "predicted", r6("margin")).orderBy("margin", "row_id").limit(10)


def _per_template(t: int) -> str:
    return f"SELECT {t} AS template, * FROM ({_ZS.replace('WHERE r <= 5', f'WHERE r <= 5 AND r % 2 = {t}')}{_PRF} SELECT round((SELECT avg(CAST(label = predicted AS INT)) FROM t), 6) AS accuracy, round(avg(recall), 6) AS balanced_accuracy, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM g)"


@query(f"SELECT CAST(template AS BIGINT) AS template, accuracy, balanced_accuracy, macro_f1, weighted_f1 FROM ({_per_template(0)} UNION ALL {_per_template(1)})")
def zero_shot_per_template(spark, d):
    prompts, samples = _zs_parts(spark, d)
    protos = O.class_prototypes(prompts.withColumn("template", F.col("r") % 2), ("template", "label"))
    return O.classification_summary(O.confusion(O.zero_shot(samples, protos, keys=("template",)), ("template",)), keys=("template",))


@query("SELECT label, template_id, CASE template_id WHEN 0 THEN CAST(label AS VARCHAR) ELSE 'a row of class ' || CAST(label AS VARCHAR) END AS prompt FROM (SELECT DISTINCT label FROM embeddings), (SELECT CAST(unnest([0, 1]) AS INT) AS template_id)")
def prompt_templates(spark, d):
    return D.prompts(table(spark, d, "embeddings").select("label").distinct(), ["{label}", "a row of class {label}"])


# --- overlap ----------------------------------------------------------------------------------------------


@query("WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label) SELECT label, n, CAST(least(least(50, greatest(1, n // 5), greatest(2, 10, floor(sqrt(n)))), n) AS BIGINT) AS k FROM c")
def overlap_auto_k(spark, d):
    return O.auto_k(G.class_counts(table(spark, d, "embeddings"), "label"))


def _overlap_sql(seed: int = 42, k: int = 5) -> str:
    return f"""WITH {E}, {U}, x AS (SELECT label AS cls, row_id AS p, vec FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('{seed}|' || CAST(row_id AS VARCHAR)), row_id) AS r FROM u) WHERE r <= {k}),
s AS (SELECT u.row_id, u.label, x.cls, row_number() OVER (PARTITION BY u.row_id ORDER BY round(list_sum(list_transform(list_zip(u.vec, x.vec), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 12), x.cls, x.p) AS rk FROM u, x),
t AS (SELECT row_id, label, max(CASE WHEN rk = 1 THEN cls END) AS a, max(CASE WHEN rk = 2 THEN cls END) AS b FROM s GROUP BY row_id, label),
v AS (SELECT row_id, label, CASE WHEN a <> label THEN a WHEN b <> label THEN b END AS f FROM t), c AS (SELECT label, count(*) AS n, 1 - count(f) / count(*) AS score FROM v GROUP BY label)"""


def _events(spark, d, seed=42, k=5):
    e = emb(spark, d)
    return O.overlap_events(e, O.exemplars(e, k, seed))


@query(_overlap_sql() + " SELECT label, n, round(score, 6) AS score FROM c")
def overlap_per_class(spark, d):
    return O.overlap_per_class(_events(spark, d)).select("label", "n", r6("score"))


@query(_overlap_sql() + " SELECT round(avg(score), 6) AS macro, round(sum(score * n) / sum(n), 6) AS weighted, arg_min(label, (score, label)) AS weakest FROM c WHERE label NOT IN (9)")
def overlap_summary(spark, d):
    return O.overlap_summary(O.overlap_per_class(_events(spark, d)), excluded=(9,))


@query(_overlap_sql() + ", m AS (SELECT least(label, f) AS label_a, greatest(label, f) AS label_b, count(*) AS met FROM v WHERE f IS NOT NULL GROUP BY ALL) SELECT label_a, label_b, round(1 - met / (x.n + y.n), 6) AS score FROM m JOIN c x ON x.label = label_a JOIN c y ON y.label = label_b")
def overlap_pairs(spark, d):
    return O.overlap_pairs(_events(spark, d))


@query(_overlap_sql(k=1) + " SELECT label, n, round(score, 6) AS score FROM (SELECT label, count(*) AS n, 1 - count(CASE WHEN a <> label THEN 1 END) / count(*) AS score FROM t GROUP BY label)")
def overlap_single_prototype(spark, d):
    return O.overlap_per_class(_events(spark, d, k=1)).select("label", "n", r6("score"))


def _repeat_scores(spark, d, n=4):
    out = None
    for seed in range(n):
        s = O.overlap_per_class(_events(spark, d, seed, 3)).select(F.lit(seed).alias("repeat"), "label", "score")
        out = s if out is None else out.unionByName(s)
    return out


_REPEATS = " UNION ALL ".join(f"SELECT {seed} AS seed, label, score FROM ({_overlap_sql(seed, 3)} SELECT label, score FROM c)" for seed in range(4))


@query(f"""WITH r AS ({_REPEATS}), a AS (SELECT label, count(*) AS n, avg(score) AS mean, stddev_samp(score) AS std, min(score) AS low, max(score) AS high, quantile_cont(score, 0.025) AS q1, quantile_cont(score, 0.975) AS q2 FROM r GROUP BY label)
SELECT label, n, round(mean, 6) AS mean, round(std, 6) AS std, round(low, 6) AS low, round(high, 6) AS high, round(q1, 6) AS "from", round(q2, 6) AS upto, round(q2 - q1, 6) AS width FROM a""")
def overlap_stability(spark, d):
    return O.stability(_repeat_scores(spark, d), keys=("label",))


@query()
def overlap_kmeans(spark, d):
    e = emb(spark, d)
    return O.overlap_per_class(O.overlap_events(e, O.kmeans_prototypes(e, O.auto_k(G.class_counts(e, "label")))))


def _fold_sql(f: int) -> str:
    fold = f"(row_number() OVER (PARTITION BY label ORDER BY {MD5.format('row_id')}, row_id) - 1) % 3"
    sql = _overlap_sql().replace(", x AS (", f", w AS (SELECT *, {fold} AS fold FROM u), x AS (", 1).replace("AS r FROM u) WHERE", f"AS r FROM w WHERE fold <> {f}) WHERE", 1).replace("FROM u, x)", f"FROM w u, x WHERE u.fold = {f})", 1)
    return f"SELECT label, score FROM ({sql} SELECT label, score FROM c)"


@query("SELECT label, round(avg(score), 6) AS score FROM (" + " UNION ALL ".join(_fold_sql(f) for f in range(3)) + ") GROUP BY label")
def overlap_cross_fitted(spark, d):
    e = G.folds(emb(spark, d), "row_id", "label", 3)
    out = None
    for f in range(3):
        own = O.overlap_per_class(O.overlap_events(e.where(F.col("fold") == f), O.exemplars(e.where(F.col("fold") != f), 5))).withColumn("fold", F.lit(f))
        out = own if out is None else out.unionByName(own)
    return out.groupBy("label").agg(F.round(F.avg("score"), 6).alias("score"))


@query(f"""WITH {E}, {U}, m AS (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(vec) AS x, unnest(range(1, len(vec) + 1)) AS pos FROM u) GROUP BY ALL), p AS (SELECT label AS cls, list(x ORDER BY pos) AS vec FROM m GROUP BY label),
s AS (SELECT u.row_id, u.label, p.cls, row_number() OVER (PARTITION BY u.row_id ORDER BY round(list_sum(list_transform(list_zip(u.vec, p.vec), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 12), p.cls) AS rk FROM u, p)
SELECT label, count(*) AS n, round(1 - sum(CAST(cls <> label AS INT)) / count(*), 6) AS score FROM s WHERE rk = 1 GROUP BY label""")
def overlap_centroid(spark, d):
    e = emb(spark, d)
    return O.overlap_per_class(O.overlap_events(e, O.centroids(e))).select("label", "n", r6("score"))


def _fitted(spark, rows, on, seed=42):
    """Events of ``rows`` among prototypes fitted on all rows of ``on``."""
    return O.overlap_events(rows, O.kmeans_prototypes(on, O.auto_k(G.class_counts(on, "label")), seed=seed))


@query()
def overlap_fitted_summary(spark, d):
    e = emb(spark, d)
    return O.overlap_summary(O.overlap_per_class(_fitted(spark, e, e)), excluded=(9,))


@query()
def overlap_fitted_pairs(spark, d):
    e = emb(spark, d)
    return O.overlap_pairs(_fitted(spark, e, e))


@query()
def overlap_fitted_stability(spark, d):
    e, out = emb(spark, d), None
    for seed in range(4):
        s = O.overlap_per_class(_fitted(spark, e, e, seed)).select(F.lit(seed).alias("repeat"), "label", "score")
        out = s if out is None else out.unionByName(s)
    return O.stability(out, keys=("label",))


@query()
def overlap_fitted_cross_fitted(spark, d):
    e, out = Scratch(spark).put(G.folds(emb(spark, d), "row_id", "label", 3), "folds"), None
    for f in range(3):
        own = O.overlap_per_class(_fitted(spark, e.where(F.col("fold") == f), e.where(F.col("fold") != f)))
        out = own if out is None else out.unionByName(own)
    return out.groupBy("label").agg(F.round(F.avg("score"), 6).alias("score"))


@query()
def overlap_continuous(spark, d):
    """Regression analogue: variance of the price within prototypes of the standardised quantity, discount and tax
    against 20 seeded permutations of the price."""
    li = table(spark, d, "lineitem")
    names = ("l_quantity", "l_discount", "l_tax")
    size = li.agg(*(F.avg(c).alias(f"{c}_mean") for c in names), *(F.stddev_pop(c).alias(f"{c}_std") for c in names)).first()
    vec = F.array(*((F.col(c) - size[f"{c}_mean"]) / (size[f"{c}_std"] or 1.0) for c in names))
    o = O.continuous_overlap(li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), vec.alias("vec"), F.col("l_extendedprice").alias("y")), normalize=False)
    return o.select(F.round("loss", 2).alias("loss"), F.round("null_loss", 2).alias("null_loss"), r6("loss_ratio"), r6("score"))


# --- probes -----------------------------------------------------------------------------------------------


@query(f"SELECT vec_id AS row_id, CAST((row_number() OVER (PARTITION BY label ORDER BY {MD5.format('vec_id')}, vec_id) - 1) % 5 AS INT) AS fold FROM embeddings")
def probe_folds(spark, d):
    return G.folds(emb(spark, d), "row_id", "label", 5).select("row_id", F.col("fold").cast("int").alias("fold"))


@query(f"WITH g AS (SELECT o_custkey, CAST(CAST('0x' || substr({MD5.format('o_custkey')}, 1, 8) AS BIGINT) % 5 AS INT) AS fold FROM (SELECT DISTINCT o_custkey FROM orders)) SELECT fold, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_groups FROM orders JOIN g USING (o_custkey) GROUP BY fold")
def probe_group_folds(spark, d):
    o = G.folds(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", "o_orderkey", 5, group="o_custkey")
    return o.groupBy(F.col("fold").cast("int").alias("fold")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("o_custkey").alias("n_groups"))


@query(f"""WITH f AS (SELECT l_quantity AS x, l_extendedprice AS y, l_orderkey * 10 + l_linenumber AS id FROM lineitem), k AS (SELECT *, CAST('0x' || substr({MD5.format('id')}, 1, 8) AS BIGINT) % 3 AS fold FROM f),
r AS (SELECT t.fold, s.sxy / (s.sxx + 1) AS w, s.my - s.mx * s.sxy / (s.sxx + 1) AS b FROM (SELECT unnest([0, 1, 2]) AS fold) t, LATERAL (SELECT covar_pop(y, x) * count(*) AS sxy, var_pop(x) * count(*) AS sxx, avg(y) AS my, avg(x) AS mx FROM k WHERE k.fold <> t.fold) s),
p AS (SELECT y, w * x + b AS z FROM k JOIN r USING (fold)) SELECT round(avg(abs(y - z)), 4) AS mae, round(sqrt(avg((y - z) * (y - z))), 4) AS rmse, round(sqrt(avg((y - z) * (y - z))) / stddev_pop(y), 6) AS nrmse, round(1 - avg((y - z) * (y - z)) / var_pop(y), 6) AS r2 FROM p""")
def ridge_probe(spark, d):
    li = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), F.array("l_quantity").alias("vec"), F.col("l_extendedprice").alias("target"))
    f = Scratch(spark).put(G.folds(li, "row_id", None, 3), "folds")
    m = P.regression_metrics(P.ridge_out_of_fold(f, 3))
    return m.select(F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"), "nrmse", "r2")


@query()
def logistic_probe(spark, d):
    f = G.folds(emb(spark, d), "row_id", "label", 3)
    return O.classification_summary(O.confusion(P.logistic_out_of_fold(f, 3, max_iter=50)))


@query("""WITH u AS (SELECT user_id, list_distinct(list(event_type)) AS t, list_distinct(list(event_type) FILTER (WHERE value > 50)) AS p FROM events GROUP BY user_id),
v AS (SELECT t, coalesce(p, []) AS p FROM u), i AS (SELECT t, p, len(list_intersect(t, p)) AS b, len(list_distinct(list_concat(t, p))) AS a FROM v),
l AS (SELECT unnest(list_distinct(list_concat(t, p))) AS label, t, p FROM v), m AS (SELECT label, sum(CAST(list_contains(t, label) AS INT)) AS t, sum(CAST(list_contains(p, label) AS INT)) AS p, sum(CAST(list_contains(t, label) AND list_contains(p, label) AS INT)) AS b FROM l GROUP BY label)
SELECT round(avg(CAST(a = b AS INT)), 6) AS subset_accuracy, round(avg(CASE WHEN a = 0 THEN 1 ELSE b / a END), 6) AS jaccard, round(2 * sum(b) / sum(len(t) + len(p)), 6) AS micro_f1, round((SELECT avg(2 * b / (t + p)) FROM m), 6) AS macro_f1 FROM i""")
def multilabel_metrics(spark, d):
    u = table(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("truth"), F.collect_set(F.when(F.col("value") > 50, F.col("event_type"))).alias("predicted"))
    return P.multilabel_metrics(u)


# --- structured units and segmentation --------------------------------------------------------------------

_UNITS = "WITH a AS (SELECT DISTINCT parent_id, labels, unit_ids FROM unit_annotations), u AS (SELECT parent_id AS parent, CAST(unnest(range(0, len(labels))) AS INT) AS position, unnest(labels) AS label, unit_ids, len(labels) AS n FROM a)"


def _units(spark, d):
    return S.explode_units(table(spark, d, "unit_annotations").select("parent_id", "labels", "unit_ids").distinct(), "parent_id", "labels", unit_id="unit_ids")


@query(_UNITS + " SELECT parent, position, label, sha256(parent || '|' || CAST(position AS VARCHAR)) AS unit_key, unit_ids[position + 1] AS unit_id FROM u")
def structured_units(spark, d):
    return _units(spark, d)


@query(_UNITS + " SELECT parent, position - 1 AS position, label FROM u WHERE position >= 1 AND position < n - 1")
def drop_special_rows(spark, d):
    return S.drop_special(_units(spark, d), 1, 1).select("parent", "position", "label")


@query(_UNITS + " SELECT parent, position, label FROM u WHERE position >= 1 AND (position - 1) % 3 = 0")
def select_frame_rows(spark, d):
    return S.select_frames(_units(spark, d), 3, 1).select("parent", "position", "label")


@query(_UNITS + ", c AS (SELECT parent, count(*) AS n_units FROM u GROUP BY parent), v AS (SELECT parent_id AS parent, len(unit_ids) AS n_vectors FROM a WHERE len(unit_ids) > 0) SELECT parent, coalesce(n_units, 0) AS n_units, coalesce(n_vectors, 0) AS n_vectors FROM c FULL JOIN v USING (parent) WHERE coalesce(n_units, 0) <> coalesce(n_vectors, 0)")
def unit_alignment(spark, d):
    a = table(spark, d, "unit_annotations").select("parent_id", "labels", "unit_ids").distinct()
    return S.alignment_report(_units(spark, d), a.select(F.col("parent_id").alias("parent"), F.explode("unit_ids").alias("v")))


_PIX = "px AS (SELECT vec_id AS img, r, c, CAST((vec_id * 7 + (r // 3) * 5 + (c // 4) * 3 + CASE WHEN (r * c + vec_id) % 11 = 0 THEN 1 ELSE 0 END) % 4 AS INT) AS label, CAST((r // 6 + c // 6) % 3 AS INT) AS instance FROM embeddings, (SELECT CAST(unnest(range(0, 12)) AS INT) AS r), (SELECT CAST(unnest(range(0, 12)) AS INT) AS c))"
_CELLS = f"WITH {_PIX}, x AS (SELECT img, r // 3 AS i, c // 3 AS j, label, count(*) AS n FROM px GROUP BY ALL), y AS (SELECT *, sum(n) OVER w AS total, row_number() OVER (PARTITION BY img, i, j ORDER BY n DESC, label) AS place FROM x WINDOW w AS (PARTITION BY img, i, j)), t AS (SELECT img, i, j, max(CASE WHEN place = 1 THEN label END) AS label, round(max(CASE WHEN place = 1 THEN n / total END), 6) AS share, round(coalesce(max(CASE WHEN place = 2 THEN n / total END), 0), 6) AS second FROM y GROUP BY ALL)"


def _pixels(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("img"))
    at = F.expr("explode(flatten(transform(sequence(0, 11), r -> transform(sequence(0, 11), c -> struct(r, c)))))")
    p = e.select("img", at.alias("p")).select("img", "p.r", "p.c")
    return p.selectExpr("img", "r", "c", "cast((img * 7 + (r div 3) * 5 + (c div 4) * 3 + if((r * c + img) % 11 = 0, 1, 0)) % 4 as int) as label", "cast((r div 6 + c div 6) % 3 as int) as instance")


@query(_CELLS + " SELECT img, i, j, label, share, second, CASE WHEN label = 3 THEN 'ignored' WHEN share < 0.7 THEN 'low_coverage' WHEN share - second < 0.2 THEN 'low_margin' END AS dropped FROM t")
def segmentation_grid(spark, d):
    return S.grid_tokens(_pixels(spark, d), 12, 12, 4, 4, ignored=(3,))


@query(_CELLS + ", n AS (SELECT img, r // 3 AS i, c // 3 AS j, label, instance, count(*) AS n FROM px WHERE instance <> 0 GROUP BY ALL), m AS (SELECT img, i, j, label, arg_max(instance, (n, -instance)) AS instance FROM n GROUP BY ALL) SELECT t.img, t.i, t.j, t.label, m.instance FROM t LEFT JOIN m USING (img, i, j, label)")
def segmentation_instances(spark, d):
    px = _pixels(spark, d)
    return S.instances(px, S.grid_tokens(px, 12, 12, 4, 4), 12, 12, 4, 4).select("img", "i", "j", "label", "instance")


@query(f"""WITH t AS (SELECT DISTINCT token_id, image_id, semantic_label FROM spatial_tokens WHERE semantic_label IS NOT NULL), a AS (SELECT *, row_number() OVER (PARTITION BY semantic_label, image_id ORDER BY {MD5.format('token_id')}, token_id) AS r FROM t),
b AS (SELECT *, row_number() OVER (PARTITION BY semantic_label ORDER BY {MD5.format('token_id')}, token_id) AS s FROM a WHERE r <= 4) SELECT token_id, semantic_label FROM b WHERE s <= 17""")
def capped_tokens(spark, d):
    t = table(spark, d, "spatial_tokens").select("token_id", "image_id", "semantic_label").where("semantic_label is not null").distinct()
    return S.capped(t, "token_id", "semantic_label", 17, "image_id", 4).select("token_id", "semantic_label")


# --- results, artifacts, monitoring -----------------------------------------------------------------------

_RES = "r AS (SELECT DISTINCT result_id, dataset_key, extractor, primary_metric, primary_score, overlap_macro, target_type, embedding_dim FROM results)"


def results(spark, d):
    return table(spark, d, "results").select("result_id", "dataset_key", "extractor", "primary_metric", "primary_score", "overlap_macro", "target_type", "embedding_dim").distinct()


@query(f"WITH {_RES} SELECT result_id, dataset_key, primary_metric, primary_score, CAST(row_number() OVER (PARTITION BY dataset_key, primary_metric ORDER BY CASE WHEN primary_metric IN ('rmse', 'mae', 'nrmse') THEN -primary_score ELSE primary_score END DESC, result_id) AS INT) AS place FROM r WHERE primary_score IS NOT NULL AND NOT isnan(primary_score)")
def ranked_results(spark, d):
    low = F.col("primary_metric").isin("rmse", "mae", "nrmse")
    return R.ranked(results(spark, d), "primary_score", "result_id", ("dataset_key", "primary_metric"), low).select("result_id", "dataset_key", "primary_metric", "primary_score", "place")


@query(f"WITH {_RES}, b AS (SELECT dataset_key, max(overlap_macro) AS best FROM r GROUP BY dataset_key) SELECT result_id, dataset_key, overlap_macro FROM r JOIN b USING (dataset_key) WHERE round(best - overlap_macro, 9) <= 0.01")
def quality_cohort(spark, d):
    return R.cohort(results(spark, d), "overlap_macro", ("dataset_key",)).select("result_id", "dataset_key", "overlap_macro")


@query("SELECT event_type, count(value) AS n, round(median(value), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, round(max(value), 6) AS largest, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def latency_profile(spark, d):
    return R.latency_profile(table(spark, d, "events"), "value", ("event_type",))


@query("WITH w AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS r FROM events) SELECT event_type, count(value) AS n, round(median(value), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, round(max(value), 6) AS largest, round(avg(value), 6) AS mean FROM w WHERE r > 1 GROUP BY event_type")
def warm_latency_profile(spark, d):
    return R.latency_profile(table(spark, d, "events"), "value", ("event_type",), ("ts", "event_id"))


@query("WITH p AS (SELECT event_type, user_id % 8 AS shard, count(value) AS n, avg(value) AS mean, max(value) AS peak FROM events GROUP BY ALL) SELECT event_type, CAST(sum(n) AS BIGINT) AS n, round(sum(n * mean) / sum(n), 6) AS mean, max(peak) AS peak, count(*) AS n_shards FROM p GROUP BY event_type")
def merged_profiles(spark, d):
    parts = table(spark, d, "events").groupBy("event_type", (F.col("user_id") % 8).alias("shard")).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("peak"))
    return R.merge_profiles(parts, ("event_type",))


@query("WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) SELECT user_id, event_type, event_id, value FROM e WHERE r = 1")
def history_latest(spark, d):
    return M.latest(table(spark, d, "events"), ("user_id", "event_type"), ("ts", "event_id")).select("user_id", "event_type", "event_id", "value")


@query("SELECT user_id, event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id), 6) AS change FROM events")
def history_changes(spark, d):
    return M.changes(table(spark, d, "events"), "value", ("user_id",), "event_id").select("user_id", "event_id", r6("change"))


@query("SELECT doc_id, CAST(len(text) - len(replace(text, ' ', '')) AS DOUBLE) AS blanks FROM documents WHERE text IS NOT NULL")
def callable_extractor(spark, d):
    import numpy as np

    rows = table(spark, d, "documents").where("text is not null").select("doc_id", "text")
    return X.call(rows, lambda s: np.array([[t.count(" ")] for t in s], float).reshape(-1, 1), "text").select("doc_id", F.col("vec")[0].alias("blanks"))


@query()
def text_extractor(spark, d):
    t = X.text_pipeline(table(spark, d, "documents").select("doc_id", "text"), "text", features=256)
    return t.select("doc_id", F.round(V.norm(F.col("vec")), 6).alias("norm"))


@query()
def tree_leaf_extractor(spark, d):
    return X.tree_leaves(emb(spark, d), "vec", "label").select("row_id", "leaves")


@query(f"WITH {E} SELECT row_id, round(list_sum(list_transform(list_zip(vec[1:32], vec[33:64]), lambda x: (x[1] + x[2]) / 2)), 6) AS mean_sum, round(list_sum(vec[33:64]), 6) AS last_sum FROM e")
def pooled_tokens(spark, d):
    tokens = F.array(F.slice("vec", 1, 32), F.slice("vec", 33, 32))
    total = lambda c: F.round(F.aggregate(V.doubles(c), F.lit(0.0), lambda s, x: s + x), 6)
    return emb(spark, d).withColumn("t", tokens).select("row_id", total(X.pool(F.col("t"), "mean")).alias("mean_sum"), total(X.pool(F.col("t"), "last")).alias("last_sum"))


# --- benchmark runs ---------------------------------------------------------------------------------------

_VARIANTS = f"""WITH {E}, b AS (SELECT 'base' AS variant, row_id, label, vec FROM e UNION ALL SELECT 'base[prefix_truncate_16]', row_id, label, vec[1:16] FROM e UNION ALL SELECT 'base[prefix_truncate_32]', row_id, label, vec[1:32] FROM e),
u AS (SELECT variant, row_id, label, list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec))) AS vec FROM b)"""
_BENCH = _VARIANTS + """, x AS (SELECT variant, label AS cls, row_id AS p, vec FROM (SELECT *, row_number() OVER (PARTITION BY variant, label ORDER BY md5('42|' || CAST(row_id AS VARCHAR)), row_id) AS r FROM u) WHERE r <= 5),
s AS (SELECT u.variant, u.row_id, u.label, x.cls, row_number() OVER (PARTITION BY u.variant, u.row_id ORDER BY round(list_sum(list_transform(list_zip(u.vec, x.vec), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 12), x.cls, x.p) AS rk FROM u JOIN x ON u.variant = x.variant),
t AS (SELECT variant, row_id, label, max(CASE WHEN rk = 1 THEN cls END) AS a, max(CASE WHEN rk = 2 THEN cls END) AS b FROM s GROUP BY ALL),
c AS (SELECT variant, label, 1 - count(CASE WHEN a <> label THEN a WHEN b <> label THEN b END) / count(*) AS score FROM t GROUP BY ALL),
o AS (SELECT variant, 'overlap' AS metric, round(avg(score), 6) AS score FROM c GROUP BY variant),
k AS (SELECT q.variant, q.row_id AS q, q.label = g.label AS rel, row_number() OVER (PARTITION BY q.variant, q.row_id ORDER BY round(list_dot_product(q.vec, g.vec), 10) DESC, g.row_id) AS rk FROM u q JOIN u g ON q.variant = g.variant AND q.row_id <> g.row_id),
p AS (SELECT *, row_number() OVER (PARTITION BY variant, q ORDER BY rk) AS j FROM k WHERE rel),
m AS (SELECT variant, q, sum(CASE WHEN rk <= 10 THEN 1 / log2(rk + 1) ELSE 0 END) / sum(CASE WHEN j <= 10 THEN 1 / log2(j + 1) ELSE 0 END) AS ndcg FROM p GROUP BY ALL),
f AS (SELECT * FROM o UNION ALL SELECT variant, 'label_retrieval', round(avg(ndcg), 6) FROM m GROUP BY variant)
SELECT variant, metric, score, row_number() OVER (PARTITION BY metric ORDER BY score DESC, variant) AS place FROM f"""


@query(_BENCH)
def benchmark_run(spark, d):
    """Three compressions by two metrics, ranked by each metric."""
    data = D.Dataset(emb(spark, d))
    b = B.Benchmark(data, {"base": None}, (C.Compression(), C.Compression("prefix_truncate", 16), C.Compression("prefix_truncate", 32)), (K.OverlapMetric("exemplar", 5), K.LabelRetrievalMetric(10)))
    r = b.run().withColumn("score", F.round("score", 6))
    return R.ranked(r, "score", "variant", ("metric",), ~F.col("higher_is_better")).select("variant", "metric", "score", F.col("place").cast("bigint").alias("place"))


@query()
def benchmark_views(spark, d):
    """Views, stability, weakest class and advice of one variant; a view of one class is left out."""
    e = emb(spark, d).withColumn("half", F.when(F.col("label") < 5, "low").otherwise("high")).withColumn("one", F.lit("x"))
    b = B.Benchmark(D.Dataset(e), {"base": None}, metrics=(K.OverlapMetric("exemplar", 5),), views={"half": "half", "one": "one"}, repeats=3)
    return b.run().select("view", "variant", "score", "weakest_class", "weakest_score", "stability_width", "advice")


@query(_GRADED_ALL + ", v AS (SELECT 'base' AS variant, q, 1.0 / min(rk) AS mrr, avg(j / rk) AS map, sum(CASE WHEN rk <= 5 THEN (pow(2, grade) - 1) / log2(rk + 1) ELSE 0 END) / sum(CASE WHEN i <= 5 THEN (pow(2, grade) - 1) / log2(i + 1) ELSE 0 END) AS ndcg_5 FROM p GROUP BY q) SELECT variant, round(avg(mrr), 6) AS mrr, round(avg(map), 6) AS map, round(avg(ndcg_5), 6) AS score, CAST(1 AS INT) AS place FROM v GROUP BY variant")
def retrieval_run(spark, d):
    e = emb(spark, d)
    q = e.where("row_id % 50 = 0")
    rel = q.select(F.col("row_id").alias("q"), "label").join(e.select(F.col("row_id").alias("g"), "label"), "label").where("q <> g").select("q", "g", (1 + F.col("g") % 3).cast("double").alias("grade"))
    data = D.RetrievalDataset(q.select(F.col("row_id").alias("q"), "vec"), e.select(F.col("row_id").alias("g"), "vec"), rel, q.select(F.col("row_id").alias("q"), F.col("row_id").alias("g"))).validate()
    return B.retrieval_run(data, {"base": (None, None)}, ks=(5,)).select("variant", "mrr", "map", "score", "place")


@query(_ZS + _PRF + " SELECT 'base' AS variant, round((SELECT avg(CAST(label = predicted AS INT)) FROM t), 6) AS accuracy, round(avg(recall), 6) AS balanced_accuracy, round(avg(f1), 6) AS macro_f1, CAST(1 AS INT) AS place FROM g")
def zero_shot_run(spark, d):
    prompts, samples = _zs_parts(spark, d)
    data = D.ZeroShotDataset(samples, prompts).validate()
    return B.zero_shot_run(data, {"base": (None, None)}, overlap=False).select("variant", "accuracy", "balanced_accuracy", "macro_f1", "place")


_ML = "e AS (SELECT vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS vec, unnest(CASE WHEN embedding[1] > 0 THEN ['c' || label, 'positive'] ELSE ['c' || label] END) AS label FROM embeddings)"


def _multi(spark, d):
    e = emb(spark, d)
    return e.select("row_id", "vec", F.array_compact(F.array(F.concat(F.lit("c"), F.col("label").cast("string")), F.when(F.get("vec", F.lit(0)) > 0, F.lit("positive")))).alias("labels"))


@query(_overlap_sql().replace(E, _ML).replace("PARTITION BY u.row_id ORDER", "PARTITION BY u.row_id, u.label ORDER") + " SELECT label, n, round(score, 6) AS score FROM c")
def overlap_multilabel(spark, d):
    rows = O.by_label(_multi(spark, d), "labels")
    return O.overlap_per_class(O.overlap_events(rows, O.exemplars(rows, 5))).select("label", "n", r6("score"))


@query()
def multilabel_probe(spark, d):
    f = Scratch(spark).put(G.folds(_multi(spark, d).select("row_id", "vec", F.filter("labels", lambda x: x.isin("positive", "c1")).alias("labels")), "row_id", None, 3), "folds")
    return P.multilabel_metrics(P.multilabel_out_of_fold(f, "labels", 3, max_iter=30))


@query("""WITH p AS (SELECT o_orderkey, o_custkey % 40 AS g, o_orderpriority AS l FROM orders), n AS (SELECT l, count(DISTINCT g) AS n FROM p GROUP BY l) SELECT least(5, min(n)) AS n_folds, CAST(0 AS BIGINT) AS n_split_groups, (SELECT count(*) FROM p) AS n_rows FROM n""")
def probe_stratified_group_folds(spark, d):
    """Whole groups in one fold, every class in several: the number of folds, of groups in several folds, and of rows."""
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 40).alias("g"), "o_orderpriority")
    _, f = G.safe_folds(o, "o_orderkey", "o_orderpriority", 5, "g")
    f = Scratch(spark).put(f, "folds")
    split = f.groupBy("g").agg(F.count_distinct("fold").alias("n")).agg(F.sum((F.col("n") > 1).cast("bigint")).alias("n_split_groups"))
    return f.agg(F.count_distinct("fold").alias("n_folds"), F.count(F.lit(1)).alias("n_rows")).join(F.broadcast(split))


@query(f"""WITH f AS (SELECT l_quantity AS x, l_extendedprice AS y1, l_discount AS y2, l_orderkey * 10 + l_linenumber AS id FROM lineitem), k AS (SELECT *, CAST('0x' || substr({MD5.format('id')}, 1, 8) AS BIGINT) % 3 AS fold FROM f),
r AS (SELECT t.fold, s.* FROM (SELECT unnest([0, 1, 2]) AS fold) t, LATERAL (SELECT covar_pop(y1, x) / (var_pop(x) + 1.0 / count(*)) AS w1, covar_pop(y2, x) / (var_pop(x) + 1.0 / count(*)) AS w2, avg(y1) AS m1, avg(y2) AS m2, avg(x) AS mx FROM k WHERE k.fold <> t.fold) s),
p AS (SELECT y1, y2, w1 * (x - mx) + m1 AS z1, w2 * (x - mx) + m2 AS z2 FROM k JOIN r USING (fold)), a AS (SELECT avg((y1 - z1) ** 2) AS e1, avg((y2 - z2) ** 2) AS e2, var_pop(y1) AS v1, var_pop(y2) AS v2, avg(abs(y1 - z1)) AS a1, avg(abs(y2 - z2)) AS a2 FROM p)
SELECT round((a1 + a2) / 2, 3) AS mae, round((sqrt(e1 / v1) + sqrt(e2 / v2)) / 2, 5) AS nrmse, round(1 - (e1 + e2) / (v1 + v2), 5) AS r2, round(((1 - e1 / v1) + (1 - e2 / v2)) / 2, 5) AS r2_uniform FROM a""")
def ridge_probe_two_targets(spark, d):
    li = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), F.array("l_quantity").alias("vec"), F.array("l_extendedprice", "l_discount").alias("target"))
    f = Scratch(spark).put(G.folds(li, "row_id", None, 3), "folds")
    m = P.target_metrics(P.ridge_out_of_fold(f, 3))
    return m.select(F.round("mae", 3).alias("mae"), F.round("nrmse", 5).alias("nrmse"), F.round("r2", 5).alias("r2"), F.round("r2_uniform", 5).alias("r2_uniform"))


@query()
def complexity_ladder(spark, d):
    """The ladder on the two commonest classes, run whatever the overlap."""
    e = emb(spark, d).where("label < 2")
    return complexity.diagnose(e, 1.0, probes=("dummy", "linear", "smooth_poly", "knn"))[1]


@query("SELECT round(avg(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))), 6) AS score FROM embeddings")
def custom_metric(spark, d):
    m = K.CallableMetric(lambda rows: rows.agg(F.avg(V.norm(F.col("vec"))).alias("score")), "mean_norm").score(emb(spark, d))
    return spark.createDataFrame([(round(m.score, 6),)], "score double")


@query("SELECT CAST(row_number() OVER (ORDER BY 'string:' || lang) - 1 AS INT) AS position, 'string:' || lang AS label_key, 'string' AS label_type, lang AS display, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def label_catalog(spark, d):
    return L.catalog(table(spark, d, "documents"), "lang").select(F.col("position").cast("int").alias("position"), "label_key", "label_type", "display", "n")


@query("SELECT target, count(*) AS n FROM (SELECT array_to_string(list_sort(list_filter([CASE WHEN bool_or(event_type = 'click') THEN 'click' END, CASE WHEN bool_or(event_type = 'purchase') THEN 'purchase' END], lambda x: x IS NOT NULL)), '|') AS target FROM events GROUP BY user_id) GROUP BY target")
def normalized_targets(spark, d):
    u = table(spark, d, "events").groupBy("user_id").agg(*(F.max((F.col("event_type") == t).cast("int")).alias(t) for t in ("click", "purchase")))
    rows, _ = L.normalize_targets(u, ["click", "purchase"])
    return rows.groupBy(F.array_join("target", "|").alias("target")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH m AS (SELECT DISTINCT artifact_key, n_samples, embedding_dim, dtype FROM memory_estimates), b AS (SELECT artifact_key, n_samples * embedding_dim * CASE lower(dtype) WHEN 'float16' THEN 2 WHEN 'half' THEN 2 WHEN 'float64' THEN 8 WHEN 'double' THEN 8 WHEN 'int8' THEN 1 WHEN 'uint8' THEN 1 ELSE 4 END AS bytes FROM m)
SELECT artifact_key, bytes, bytes <= 1000000 AS fits, round(least(1, 1000000.0 / nullif(bytes, 0)), 6) AS rate, CAST(greatest(1, ceil(bytes / 1000000)) AS BIGINT) AS n_shards FROM b""")
def memory_plan(spark, d):
    m = table(spark, d, "memory_estimates").select("artifact_key", "n_samples", "embedding_dim", "dtype").distinct()
    return resources.memory_plan(m, 1_000_000).select("artifact_key", "bytes", "fits", "rate", "n_shards")


@query(_CELLS + ", n AS (SELECT img, r // 3 AS i, c // 3 AS j, label, instance, count(*) AS n FROM px WHERE instance <> 0 AND label IN (1, 2) GROUP BY ALL), m AS (SELECT img, i, j, label, arg_max(instance, (n, -instance)) AS instance FROM n GROUP BY ALL) SELECT t.img, t.i, t.j, t.label, m.instance, t.label = 0 AS background, round(e.vec[t.i * 4 + t.j + 1], 6) AS feature FROM t JOIN (SELECT row_id, vec FROM e) e ON e.row_id = t.img LEFT JOIN m USING (img, i, j, label) WHERE t.label <> 3 AND t.share >= 0.7 AND t.share - t.second >= 0.2")
def segmentation_tokens(spark, d):
    """Masks to labelled tokens with the features of their cells: class 3 ignored, 0 the background, 1 and 2 things."""
    e = emb(spark, d).select(F.col("row_id").alias("img"), F.posexplode(F.slice("vec", 1, 16)).alias("at", "x"))
    features = e.select("img", F.floor(F.col("at") / 4).cast("int").alias("i"), (F.col("at") % 4).cast("int").alias("j"), F.array("x").alias("vec"))
    t = S.segment_tokens(_pixels(spark, d), features, 12, 12, 4, 4, ignored=(3,), background=(0,), things=(1, 2))
    return t.select("img", "i", "j", "label", "instance", "background", F.round(F.col("vec")[0].cast("double"), 6).alias("feature"))


SQL["segmentation_tokens"] = SQL["segmentation_tokens"].replace("WITH px", f"WITH {E}, px", 1)


@query("""WITH a AS (SELECT DISTINCT parent_id, labels FROM unit_annotations WHERE labels IS NOT NULL), u AS (SELECT parent_id AS "group", CAST(unnest(range(0, len(labels))) AS INT) AS position, unnest(labels) AS label FROM a)
SELECT sha256("group" || '|slot-' || CAST(position AS VARCHAR)) AS row_id, "group", position, label, CAST(position AS DOUBLE) AS feature FROM u""")
def structured_outputs(spark, d):
    """Latent slots of each parent with one vector a slot, as labelled unit rows."""
    a = table(spark, d, "unit_annotations").select("parent_id", "labels").where("labels is not null").distinct()
    units = S.slot_units(a, "parent_id", "labels")
    vectors = a.select(F.col("parent_id").alias("parent"), F.transform("labels", lambda x, i: F.array(i.cast("double"))).alias("vecs"))
    rows = S.materialize(units, {"slots": vectors})["slots"]
    return rows.select("row_id", "group", "position", "label", F.col("vec")[0].alias("feature"))
