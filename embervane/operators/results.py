"""Ranking, cohorts and recommendations over result rows; profiles of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def ranked(results: DataFrame, score: str, row_id: str, keys: tuple[str, ...] = (), lower_is_better: Column | None = None) -> DataFrame:
    """Results with their ``place`` among those of equal ``keys``; invalid (null) scores are left out, ties go to the lower id."""
    s = F.when(lower_is_better, -F.col(score)).otherwise(F.col(score)) if lower_is_better is not None else F.col(score)
    by = W.partitionBy(*keys).orderBy(s.desc(), row_id)
    return results.where(F.col(score).isNotNull() & ~F.isnan(score)).withColumn("place", F.row_number().over(by))


def cohort(results: DataFrame, score: str, keys: tuple[str, ...], tolerance: float = 0.01) -> DataFrame:
    """Results within ``tolerance`` of the best of equal ``keys``."""
    best = results.groupBy(*keys).agg(F.max(score).alias("_best"))
    return results.join(best, list(keys)).where(F.round(F.col("_best") - F.col(score), 9) <= tolerance).drop("_best")


def recommendation(score: Column, width: Column | None = None, weakest: Column | None = None, regression: Column | None = None) -> Column:
    w = width if width is not None else F.lit(0.0)
    c = F.when(score.isNull(), F.lit(None)).when((score >= 0.9) & (w <= 0.05), "strong").when(score >= 0.8, "promising").when(score >= 0.7, "moderate").otherwise("poor")
    if regression is not None:
        c = F.when(regression, F.when(score.isNull(), F.lit(None)).when(score <= 0, "null-like").otherwise("above-null")).otherwise(c)
    parts = [c]
    if weakest is not None:
        parts.append(F.when(weakest < 0.7, "weak class"))
    parts.append(F.when(w > 0.15, "unstable"))
    return F.concat_ws("; ", *parts)


def latency_profile(calls: DataFrame, value: str, keys: tuple[str, ...], order: tuple[str, ...] = ()) -> DataFrame:
    """Count, median, 95th percentile, maximum and mean of the calls; with ``order``, columns that tell the calls of
    a key apart, of the warm ones: all but the first of each key."""
    if order:
        first = calls.groupBy(*(F.col(k).alias(f"_k_{k}") for k in keys)).agg(F.min(F.struct(*order)).alias("_first"))
        on = F.lit(True)
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        calls = calls.join(F.broadcast(first), on).where(~F.struct(*order).eqNullSafe(F.col("_first")))
    return calls.groupBy(*keys).agg(F.count(value).alias("n"), F.round(F.median(value), 6).alias("median"), F.round(F.percentile(value, F.lit(0.95)), 6).alias("p95"), F.round(F.max(value), 6).alias("largest"), F.round(F.avg(value), 6).alias("mean"))


def merge_profiles(parts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """parts(keys, n, mean, peak) of shards to one profile: the weighted mean, the largest peak."""
    return parts.groupBy(*keys).agg(F.sum("n").alias("n"), F.round(F.sum(F.col("n") * F.col("mean")) / F.sum("n"), 6).alias("mean"), F.max("peak").alias("peak"), F.count(F.lit(1)).alias("n_shards"))


def coverage(keys: DataFrame, expected: DataFrame) -> DataFrame:
    """(artifact, n_expected, n_rows, n_distinct, complete) of merged shards: every index once and none missing."""
    a = keys.groupBy("artifact").agg(F.count("idx").alias("n_rows"), F.count_distinct("idx").alias("n_distinct"))
    j = expected.join(a, "artifact", "left").fillna(0, ["n_rows", "n_distinct"])
    return j.withColumn("complete", (F.col("n_rows") == F.col("n_expected")) & (F.col("n_distinct") == F.col("n_expected")))


def advice(score: float | None, width: float | None = None, weakest: float | None = None, regression: bool = False, interval: tuple[float, float] | None = None) -> str:
    """The recommendation for one result, as ``recommendation`` gives it for columns; a regression interval that holds 0 is
    indeterminate."""
    if score is None:
        return "no score"
    if regression:
        return "indeterminate" if interval and interval[0] <= 0 <= interval[1] else "null-like" if score <= 0 else "above-null"
    w = width or 0.0
    out = ["strong" if score >= 0.9 and w <= 0.05 else "promising" if score >= 0.8 else "moderate" if score >= 0.7 else "poor"]
    out += ["weak class"] if weakest is not None and weakest < 0.7 else []
    return "; ".join(out + (["unstable"] if w > 0.15 else []))


def overall_advice(results: DataFrame, score: str, name: str, tolerance: float = 0.01) -> list[str]:
    """Sentences on ranked results: the best, those as good, and the smallest of them where there is ``output_dim``."""
    rows = sorted((r.asDict() for r in results.where(F.col(score).isNotNull()).collect()), key=lambda r: (r["place"], r[name]))  # a row a variant
    if not rows:
        return ["No variant has a valid score."]
    best = rows[0]
    out = [f"{best[name]} ranks first with {best[score]:.4f}."]
    near = [r for r in rows[1:] if round(abs(best[score] - r[score]), 9) <= tolerance]
    if near:
        out.append("Within tolerance: " + ", ".join(r[name] for r in near) + ".")
    sized = [r for r in [best, *near] if r.get("output_dim")]
    if sized and (small := min(sized, key=lambda r: (r["output_dim"], r["place"])))[name] != best[name]:
        out.append(f"{small[name]} is as good with {small['output_dim']} dimensions.")
    return out
