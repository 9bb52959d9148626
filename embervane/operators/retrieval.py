"""Exact similarity ranking and retrieval metrics.

Similarities are matrix products. A gallery of bounded size goes to every task, and each Arrow batch of queries is
ranked and measured where it lies (``query_scores``, ``label_scores``). Beyond that, Arrow batches of the gallery meet
blocks of queries (``ranks``): no gallery is sorted then, as the rank of a positive is one more than the gallery rows
that beat it, which partial counts add up to. Both give the same metrics.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Values of queries held by a task at once; larger query sets are handled block by block.
BLOCK_VALUES = 4_000_000
#: Most values of a gallery that is sent to every task, and similarities that a task holds at once.
GALLERY_VALUES, BLOCK_SCORES = 20_000_000, 4_000_000


def _matrix(col: pa.Array, normalize: bool) -> np.ndarray:
    x = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = x.reshape(len(col), -1) if len(col) else x.reshape(0, 1)
    if normalize:
        n = np.sqrt((x * x).sum(1, keepdims=True))
        if not (n > 0).all():
            raise ValueError("a vector of zero norm has no cosine similarity")
        x = x / n
    return x


def similarity(q: np.ndarray, g: np.ndarray, metric: str) -> np.ndarray:
    """cosine and dot products, or the negative squared distance in expanded form; rounded so that ties are ties."""
    s = q @ g.T
    if metric == "squared_l2":
        s = 2 * s - (q * q).sum(1)[:, None] - (g * g).sum(1)[None, :]
    return np.round(s, 10)


def _query_blocks(queries: DataFrame, metric: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    ids, rows = [], []
    for r in queries.orderBy("q").toLocalIterator():
        ids.append(r["q"])
        rows.append(r["vec"])
        if len(ids) * len(rows[0]) >= BLOCK_VALUES:
            yield np.array(ids), _matrix(pa.array(rows, pa.list_(pa.float64())), metric == "cosine")
            ids, rows = [], []
    if ids:
        yield np.array(ids), _matrix(pa.array(rows, pa.list_(pa.float64())), metric == "cosine")


def ranks(queries: DataFrame, gallery: DataFrame, relevance: DataFrame, exclusions: DataFrame | None = None, metric: str = "cosine", exclude_self: bool = False) -> DataFrame:
    """(q, g, grade, score, rank, nearest_negative) of every relevant pair.

    queries(q, vec), gallery(g, vec), relevance(q, g, grade > 0), exclusions(q, g). Rank counts eligible gallery
    rows of higher similarity, and of equal similarity and lower id. Excluded pairs are neither candidates nor
    positives; a query without positives has no row. Queries and their positives come to the driver block by block.
    """
    rel = relevance.where("grade > 0").select("q", "g", F.col("grade").cast("double").alias("grade"))
    if exclusions is not None:
        rel = rel.join(exclusions.select("q", "g"), ["q", "g"], "left_anti")
    if exclude_self:
        rel = rel.where("q <> g")
    out = None
    cosine = metric == "cosine"
    for ids, x in _query_blocks(queries, metric):
        own = rel.join(F.broadcast(gallery.sparkSession.createDataFrame([(int(i),) for i in ids], "q bigint")), "q")
        pos_scores = own.join(gallery.select("g", "vec"), "g")

        def score(batches, ids=ids, x=x):
            for b in batches:
                g = _matrix(b.column("vec"), cosine)
                at = np.searchsorted(ids, b.column("q").to_numpy())
                s = np.einsum("ij,ij->i", x[at], g)
                if metric == "squared_l2":
                    s = 2 * s - (x[at] * x[at]).sum(1) - (g * g).sum(1)
                s = np.round(s, 10)
                yield pa.RecordBatch.from_arrays([b.column("q"), b.column("g"), b.column("grade"), pa.array(s, pa.float64())], names=["q", "g", "grade", "score"])

        scored = pos_scores.select("q", "g", "grade", "vec").mapInArrow(score, "q bigint, g bigint, grade double, score double")
        lists = scored.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("score", "g"))).alias("p")).orderBy("q")
        ex = None if exclusions is None else exclusions.where(F.col("q").isin([int(i) for i in ids])).select("q", "g").collect()
        positives = {r["q"]: (np.array([p["score"] for p in r["p"]]), np.array([p["g"] for p in r["p"]], np.int64)) for r in lists.toLocalIterator()}
        banned: dict[int, set] = {}
        for r in ex or []:
            banned.setdefault(r["q"], set()).add(r["g"])

        def count(batches, ids=ids, x=x, positives=positives, banned=banned):
            sums = {q: np.zeros(len(p[0]), np.int64) for q, p in positives.items()}
            top = {q: -np.inf for q in positives}
            for b in batches:
                if not b.num_rows:
                    continue
                g, gid = _matrix(b.column("vec"), cosine), b.column("g").to_numpy()
                o = np.argsort(gid, kind="stable")
                g, gid = g[o], gid[o]
                s = similarity(x, g, metric)
                for i, q in enumerate(ids):
                    if q not in positives:
                        continue
                    ok = np.ones(len(gid), bool)
                    if exclude_self:
                        ok &= gid != q
                    if q in banned:
                        ok &= ~np.isin(gid, list(banned[q]))
                    ps, pg = positives[q]
                    row, rid = s[i][ok], gid[ok]
                    key = np.lexsort((-rid, row))
                    row, rid = row[key], rid[key]
                    # rows after (score, falling id) of the positive beat it
                    lo, hi = np.searchsorted(row, ps, "left"), np.searchsorted(row, ps, "right")
                    beat = len(row) - hi
                    for j in np.flatnonzero(hi > lo):
                        beat[j] += (rid[lo[j] : hi[j]] < pg[j]).sum()
                    sums[q] += beat
                    neg = row[~np.isin(rid, pg)]
                    if len(neg):
                        top[q] = max(top[q], neg[-1])
            n = {q: (p, sums[q], top[q]) for q, p in positives.items()}
            if n:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(list(n), [len(v[1]) for v in n.values()])), pa.array(np.concatenate([v[0][1] for v in n.values()])), pa.array(np.concatenate([v[1] for v in n.values()])), pa.array(np.repeat([v[2] for v in n.values()], [len(v[1]) for v in n.values()]))],
                    names=["q", "g", "beat", "neg"],
                )

        beats = gallery.select("g", "vec").mapInArrow(count, "q bigint, g bigint, beat bigint, neg double").groupBy("q", "g").agg((F.sum("beat") + 1).alias("rank"), F.max("neg").alias("neg"))
        part = scored.join(beats, ["q", "g"]).select("q", "g", "grade", "score", "rank", F.when(F.col("neg") > float("-inf"), F.col("neg")).alias("nearest_negative"))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else gallery.sparkSession.createDataFrame([], "q bigint, g bigint, grade double, score double, rank bigint, nearest_negative double")


def query_metrics(ranked: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Per query: mrr, map, precision, recall, hit and ndcg at each k, and the margin to the nearest negative.

    Gains are 2^grade - 1, by their logarithms relative to that of the highest grade of the query, so that neither huge
    nor tiny grades leave the range of numbers.
    """
    by = W.partitionBy("q")
    r = ranked.withColumn("j", F.row_number().over(by.orderBy("rank"))).withColumn("ideal", F.row_number().over(by.orderBy(F.col("grade").desc(), "g"))).withColumn("top", F.max("grade").over(by))
    x = lambda c: F.col(c) * math.log(2)
    log_gain = lambda c: F.when(x(c) > 30, x(c) + F.log1p(-F.exp(-F.least(x(c), F.lit(700.0))))).otherwise(F.log(F.expm1(x(c))))
    gain = F.exp(log_gain("grade") - log_gain("top"))
    log2 = lambda c: F.log2(c + 1)
    aggs: list[Column] = [F.count(F.lit(1)).alias("n_positive"), (1 / F.min("rank")).alias("mrr"), F.avg(F.col("j") / F.col("rank")).alias("map")]
    for k in ks:
        hit = F.sum((F.col("rank") <= k).cast("double"))
        dcg = F.sum(F.when(F.col("rank") <= k, gain / log2(F.col("rank"))).otherwise(0.0))
        best = F.sum(F.when(F.col("ideal") <= k, gain / log2(F.col("ideal"))).otherwise(0.0))
        aggs += [(hit / k).alias(f"precision_{k}"), (hit / F.count(F.lit(1))).alias(f"recall_{k}"), (hit > 0).cast("double").alias(f"hit_{k}"), F.least(F.lit(1.0), F.coalesce(dcg / F.nullif(best, F.lit(0.0)), F.lit(0.0))).alias(f"ndcg_{k}")]
    return r.groupBy("q").agg(*aggs, (F.max("score") - F.max("nearest_negative")).alias("margin"))


def _log_gain(grades: np.ndarray) -> np.ndarray:
    x = grades * np.log(2)
    with np.errstate(over="ignore", divide="ignore"):
        return np.where(x > 30, x + np.log1p(-np.exp(-np.minimum(x, 700))), np.log(np.expm1(np.minimum(x, 700))))


def _measure(s: np.ndarray, grades: np.ndarray, eligible: np.ndarray, ks: tuple[int, ...]) -> dict[str, np.ndarray]:
    """The metrics of ``query_metrics`` for rows of similarities to a gallery in the order of its ids."""
    grades = np.where(eligible, grades, 0.0)
    s = np.where(eligible, s, -np.inf)
    order = np.argsort(-s, axis=1, kind="stable")  # ties to the lower id
    g = np.take_along_axis(grades, order, 1)
    hit, place = g > 0, np.arange(1, s.shape[1] + 1)
    n = hit.sum(1)
    if not n.all():
        raise ValueError("a query has no positive left in the gallery")
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(hit, np.exp(_log_gain(np.where(hit, g, 1.0)) - _log_gain(g.max(1))[:, None]), 0.0)
    out = {"n_positive": n, "mrr": 1 / (hit.argmax(1) + 1), "map": (hit * hit.cumsum(1) / place).sum(1) / n}
    ideal = -np.sort(-gain, axis=1)
    discount = 1 / np.log2(place + 1)
    for k in ks:
        found = hit[:, :k].sum(1)
        out |= {f"precision_{k}": found / k, f"recall_{k}": found / n, f"hit_{k}": (found > 0).astype(float), f"ndcg_{k}": np.minimum(1.0, (gain[:, :k] @ discount[:k]) / (ideal[:, :k] @ discount[:k]))}
    positive = grades > 0
    negative = np.where(~positive & eligible, s, -np.inf).max(1)
    out["margin"] = np.where(positive, s, -np.inf).max(1) - negative
    return out


def _fits(gallery: DataFrame) -> bool:
    size = gallery.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d")).first()  # two numbers
    return (size["n"] or 0) * (size["d"] or 0) <= GALLERY_VALUES


def _scored(queries: DataFrame, gallery: DataFrame, ks: tuple[int, ...], metric: str, grade_of) -> DataFrame:
    """Metrics of every query row against a gallery that goes to every task; ``grade_of(batch, gallery)`` gives the grades
    and what is eligible."""
    held = gallery.orderBy("g").toArrow().combine_chunks()  # at most GALLERY_VALUES values
    columns = {c: held.column(c) for c in held.column_names}
    sent = gallery.sparkSession.sparkContext.broadcast(columns)
    names = ["n_positive", "mrr", "map", *(f"{m}_{k}" for k in ks for m in ("precision", "recall", "hit", "ndcg")), "margin"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vec = sent.value["vec"]
        g = _matrix(vec.combine_chunks() if isinstance(vec, pa.ChunkedArray) else vec, metric == "cosine")
        step = max(1, BLOCK_SCORES // max(1, len(g)))
        for whole in batches:
            for lo in range(0, whole.num_rows, step):
                b = whole.slice(lo, step)
                s = similarity(_matrix(b.column("vec"), metric == "cosine"), g, metric)
                m = _measure(s, *grade_of(b, sent.value), ks)
                margin = pa.array(m.pop("margin"), pa.float64())
                margin = pc.if_else(pc.is_finite(margin), margin, pa.scalar(None, pa.float64()))
                cols = [b.column("q"), pa.array(m["n_positive"], pa.int64()), *(pa.array(m[c], pa.float64()) for c in names[1:-1]), margin]
                yield pa.RecordBatch.from_arrays(cols, names=["q", *names])

    return queries.mapInArrow(run, "q bigint, n_positive bigint, " + ", ".join(f"{c} double" for c in names[1:]))


def label_scores(rows: DataFrame, ks: tuple[int, ...] = (1, 5, 10), metric: str = "cosine") -> DataFrame:
    """rows(row_id, label, vec) to the metrics of each row as a query for the other rows of its label.

    Relevance is read from the labels where the similarities are, so no pair is written. Rows with a null label are
    candidates but no queries. A label with one row is an error.
    """
    labelled = rows.where("label is not null")
    codes = labelled.select("label").distinct().withColumn("code", F.xxhash64("label"))
    coded = rows.join(codes, "label", "left").select(F.col("row_id").alias("g"), "vec", F.coalesce("code", F.lit(0)).alias("code"))
    queries = coded.where("code <> 0").withColumnRenamed("g", "q")
    if not _fits(coded):
        return query_metrics(ranks(queries.select("q", "vec"), coded.select("g", "vec"), label_relevance(labelled, "row_id", "label"), exclude_self=True, metric=metric), ks)

    def grades(b: pa.RecordBatch, gallery: dict) -> tuple[np.ndarray, np.ndarray]:
        ids, code = gallery["g"].to_numpy(), gallery["code"].to_numpy()
        return (b.column("code").to_numpy()[:, None] == code).astype(float), b.column("q").to_numpy()[:, None] != ids

    return _scored(queries, coded, ks, metric, grades)


def query_scores(queries: DataFrame, gallery: DataFrame, relevance: DataFrame, exclusions: DataFrame | None = None, ks: tuple[int, ...] = (1, 5, 10), metric: str = "cosine", exclude_self: bool = False) -> DataFrame:
    """The metrics of every query: queries(q, vec), gallery(g, vec), relevance(q, g, grade), exclusions(q, g).

    Excluded pairs are neither candidates nor positives. Relevance to a row that is not in the gallery counts for
    nothing; a query without a positive is an error.
    """
    rel = relevance.where("grade > 0").groupBy("q").agg(F.collect_list("g").alias("ids"), F.collect_list(F.col("grade").cast("double")).alias("grades"))
    if not _fits(gallery):
        return query_metrics(ranks(queries, gallery, relevance, exclusions, metric, exclude_self), ks)
    q = queries.select("q", "vec").join(rel, "q", "left")
    if exclusions is not None:
        q = q.join(exclusions.groupBy("q").agg(F.collect_set("g").alias("banned")), "q", "left")

    def grades(b: pa.RecordBatch, gallery: dict) -> tuple[np.ndarray, np.ndarray]:
        ids = gallery["g"].to_numpy()

        def places(column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            lists = b.column(column)
            row = np.repeat(np.arange(b.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            g = lists.flatten().to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(ids, g), len(ids) - 1)
            return row, at, ids[at] == g if len(ids) else np.zeros(len(g), bool)

        out, ok = np.zeros((b.num_rows, len(ids))), np.ones((b.num_rows, len(ids)), bool)
        row, at, here = places("ids")
        out[row[here], at[here]] = b.column("grades").flatten().to_numpy(zero_copy_only=False)[here]
        if exclude_self:
            ok &= b.column("q").to_numpy()[:, None] != ids
        if "banned" in b.schema.names:
            row, at, here = places("banned")
            ok[row[here], at[here]] = False
        return out, ok

    return _scored(q, gallery.select("g", "vec"), ks, metric, grades)


def mean_metrics(per_query: DataFrame) -> DataFrame:
    names = [c for c in per_query.columns if c not in ("q", "n_positive", "margin")]
    return per_query.agg(F.count(F.lit(1)).alias("n_queries"), *(F.round(F.avg(c), 6).alias(c) for c in names))


def margin_summary(per_query: DataFrame) -> DataFrame:
    return per_query.agg(*(F.round(f("margin"), 6).alias(n) for n, f in (("mean", F.avg), ("median", F.median), ("min", F.min), ("max", F.max))))


def worst_queries(per_query: DataFrame, metric: str, n: int) -> DataFrame:
    return per_query.orderBy(metric, "q").limit(n)


def label_relevance(df: DataFrame, row_id: str, label: str) -> DataFrame:
    """Leave-one-out relevance: rows of the same label; a self equi-join on the label, row by row."""
    a = df.select(F.col(row_id).alias("q"), F.col(label).alias("l"))
    b = df.select(F.col(row_id).alias("g"), F.col(label).alias("l"))
    return a.join(b, "l").where("q <> g").select("q", "g", F.lit(1.0).alias("grade"))


def transpose(relevance: DataFrame) -> DataFrame:
    return relevance.select(F.col("g").alias("q"), F.col("q").alias("g"), "grade")
