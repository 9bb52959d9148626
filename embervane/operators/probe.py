"""Out-of-fold linear probes and their metrics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F



def fold_moments(rows: DataFrame, width: int) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """rows(vec, fold) to fold -> (n, sum, X'X) in one pass: partial Gram matrices of each partition and fold."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            x, fold = np.stack(b["vec"].to_numpy()).astype(np.float64) if len(b) else np.empty((0, width)), b["fold"].to_numpy()
            x = np.concatenate([np.ones((len(x), 1)), x], 1)  # the Gram matrix with a constant holds n and the sums
            for f in np.unique(fold):
                own = x[fold == f]
                held[int(f)] = held.get(int(f), 0) + own.T @ own
        if held:
            yield pd.DataFrame({"fold": list(held), "g": [g.ravel() for g in held.values()]})

    flat = rows.select("vec", "fold").mapInPandas(part, "fold int, g array<double>").select("fold", F.posexplode("g").alias("pos", "x"))
    out: dict[int, np.ndarray] = {}
    for r in flat.groupBy("fold", "pos").agg(F.sum("x").alias("x")).collect():  # folds times dimensions squared
        out.setdefault(r["fold"], np.zeros((width + 1) ** 2))[r["pos"]] = r["x"]
    grams = {f: g.reshape(width + 1, width + 1) for f, g in out.items()}
    return {f: (g[0, 0], g[0, 1:], g[1:, 1:]) for f, g in grams.items()}


def ridge_out_of_fold(rows: DataFrame, k: int, alpha: float = 1.0) -> DataFrame:
    """rows(row_id, vec, target, fold) to (row_id, target, fold, predicted): exact ridge with free intercept.

    ``target`` is a number or an array of them (one solution for each). Each fold is predicted by the solution for the
    other folds, whose Gram matrices are the whole less its own. A constant target is predicted as it is.
    """
    many = dict(rows.dtypes)["target"].startswith("array")
    target = F.col("target").cast("array<double>") if many else F.array(F.col("target").cast("double"))
    joint = rows.select(F.concat(F.col("vec").cast("array<double>"), target).alias("vec"), "fold", F.size(target).alias("m"))
    size = joint.agg(F.max(F.size("vec")).alias("width"), F.max("m").alias("m")).first()
    kind = "array<double>" if many else "double"
    if size["width"] is None:
        return rows.select("row_id", F.col("target").cast(kind).alias("target"), "fold", F.lit(None).cast(kind).alias("predicted"))
    m = size["m"]
    moments = fold_moments(joint, size["width"])
    solved: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for f in moments:
        others = [v for g, v in moments.items() if g != f]
        if not others:
            raise ValueError("a probe needs at least two folds")
        n, s, g = (sum(v[i] for v in others) for i in range(3))
        mean = s / n
        c = g - n * np.outer(mean, mean)
        w = np.linalg.solve(c[:-m, :-m] + alpha * np.eye(len(s) - m), c[:-m, -m:])
        solved[f] = (w, mean[-m:] - mean[:-m] @ w)
    sent = rows.sparkSession.sparkContext.broadcast(solved)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            if len(p):
                x = np.stack(p["vec"].to_numpy()).astype(np.float64)
                z = np.empty((len(x), m))
                for f in p["fold"].unique():
                    at = (p["fold"] == f).to_numpy()
                    w, b = sent.value[int(f)]
                    z[at] = x[at] @ w + b
                yield pd.DataFrame({"row_id": p["row_id"], "target": p["target"], "fold": p["fold"], "predicted": list(z) if many else z[:, 0]})

    return rows.select("row_id", "vec", F.col("target").cast(kind).alias("target"), F.col("fold").cast("int").alias("fold")).mapInPandas(predict, f"row_id {dict(rows.dtypes)['row_id']}, target {kind}, fold int, predicted {kind}")


def logistic_out_of_fold(rows: DataFrame, k: int, c: float = 1.0, max_iter: int = 200, balanced: bool = False) -> DataFrame:
    """rows(row_id, vec, label, fold) to (row_id, label, predicted), L2-regularised as C * loss + |w|^2 / 2.

    Labels may be of any type. ``balanced`` weighs rows by the inverse of their class's frequency.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    kind = dict(rows.dtypes)["label"]
    classes = [r["label"] for r in rows.where("label is not null").groupBy("label").count().orderBy("label").collect()]  # the classes
    place = F.create_map(*(F.lit(x) for i, v in enumerate(classes) for x in (v, float(i)))) if classes else F.lit(None)
    data = rows.where("label is not null").select("row_id", array_to_vector(F.col("vec").cast("array<double>")).alias("features"), place[F.col("label")].alias("label"), "fold")
    names, out = F.array(*(F.lit(v) for v in classes)), None
    for f in range(k):
        train = data.where(F.col("fold") != f)
        n = train.count()
        if balanced:
            w = train.groupBy("label").agg((F.lit(n) / (len(classes) * F.count(F.lit(1)))).alias("weight"))
            train = train.join(F.broadcast(w), "label")  # the classes
        model = LogisticRegression(regParam=1 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=max_iter, **({"weightCol": "weight"} if balanced else {})).fit(train)
        part = model.transform(data.where(F.col("fold") == f)).select("row_id", F.get(names, F.col("label").cast("int")).cast(kind).alias("label"), F.get(names, F.col("prediction").cast("int")).cast(kind).alias("predicted"))
        out = part if out is None else out.unionByName(part)
    return out


def multilabel_out_of_fold(rows: DataFrame, labels: str, k: int, c: float = 1.0, max_iter: int = 200) -> DataFrame:
    """rows(row_id, vec, labels, fold) to (row_id, truth, predicted): one logistic probe per label and fold. A label that all
    or none of a training set have is predicted as it is there."""
    flat = rows.select("row_id", "vec", "fold", F.array_distinct(labels).alias("truth"))
    names = [r["x"] for r in flat.select(F.explode("truth").alias("x")).where("x is not null").distinct().orderBy("x").collect()]  # the labels
    hits = None
    for name in names:
        own = flat.select("row_id", "vec", "fold", F.array_contains("truth", name).cast("int").alias("label"))
        part = logistic_out_of_fold(own, k, c, max_iter).where("predicted = 1").select("row_id", F.lit(name).alias("x"))
        hits = part if hits is None else hits.unionByName(part)
    none = F.array().cast(dict(flat.dtypes)["truth"])
    if hits is None:
        return flat.select("row_id", "truth", none.alias("predicted"))
    found = hits.groupBy("row_id").agg(F.array_sort(F.collect_set("x")).alias("predicted"))
    return flat.join(found, "row_id", "left").select("row_id", "truth", F.coalesce("predicted", none).alias("predicted"))


def target_metrics(pred: DataFrame) -> DataFrame:
    """(target, predicted), numbers or arrays of them, to mae, rmse, nrmse (over the population deviation), r2 weighted by
    variance and uniform. Constant targets are left out of nrmse and r2."""
    many = dict(pred.dtypes)["target"].startswith("array")
    t = pred.select(F.posexplode(F.arrays_zip(F.col("target").alias("t"), F.col("predicted").alias("p"))).alias("pos", "x")) if many else pred.select(F.lit(0).alias("pos"), F.struct(F.col("target").alias("t"), F.col("predicted").alias("p")).alias("x"))
    e = F.col("x.t") - F.col("x.p")
    a = t.groupBy("pos").agg(F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.var_pop("x.t").alias("var"))
    live = F.col("var") > 0
    return a.agg(F.round(F.avg("mae"), 6).alias("mae"), F.round(F.sqrt(F.avg("mse")), 6).alias("rmse"), F.round(F.avg(F.when(live, F.sqrt(F.col("mse") / F.col("var")))), 6).alias("nrmse"), F.round(1 - F.sum(F.when(live, F.col("mse"))) / F.sum(F.when(live, F.col("var"))), 6).alias("r2"), F.round(F.avg(F.when(live, 1 - F.col("mse") / F.col("var"))), 6).alias("r2_uniform"))


def regression_metrics(pred: DataFrame) -> DataFrame:
    """(target, predicted) to mae, rmse, nrmse (over the population deviation) and r2."""
    e = F.col("target") - F.col("predicted")
    a = pred.agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.stddev_pop("target").alias("sd"))
    return a.select(F.round("mae", 6).alias("mae"), F.round("rmse", 6).alias("rmse"), F.round(F.col("rmse") / F.nullif(F.col("sd"), F.lit(0.0)), 6).alias("nrmse"), F.round(1 - F.pow(F.col("rmse") / F.nullif(F.col("sd"), F.lit(0.0)), F.lit(2.0)), 6).alias("r2"))


def multilabel_metrics(pred: DataFrame, excluded: tuple = ()) -> DataFrame:
    """(truth array, predicted array) to subset accuracy, mean Jaccard (1 where both are empty), micro and macro F1, without
    the excluded labels."""
    kept = lambda c: F.array_except(F.array_distinct(c), F.array(*(F.lit(x) for x in excluded))) if excluded else F.array_distinct(c)
    p = pred.select(kept("truth").alias("t"), kept("predicted").alias("p"))
    both, any_ = F.size(F.array_intersect("t", "p")), F.size(F.array_union("t", "p"))
    rows = p.agg(F.avg((both == any_).cast("double")).alias("subset_accuracy"), F.avg(F.when(any_ == 0, 1.0).otherwise(both / any_)).alias("jaccard"), (2 * F.sum(both) / F.nullif(F.sum(F.size("t") + F.size("p")), F.lit(0))).alias("micro_f1"))
    seen = p.select(F.explode(F.array_union("t", "p")).alias("label"), "t", "p").groupBy("label").agg(F.sum(F.array_contains("t", F.col("label")).cast("int")).alias("t"), F.sum(F.array_contains("p", F.col("label")).cast("int")).alias("p"), F.sum((F.array_contains("t", F.col("label")) & F.array_contains("p", F.col("label"))).cast("int")).alias("b"))
    macro = seen.agg(F.avg(2 * F.col("b") / (F.col("t") + F.col("p"))).alias("macro_f1"))
    return rows.join(F.broadcast(macro)).select(*(F.round(c, 6).alias(c) for c in ("subset_accuracy", "jaccard", "micro_f1", "macro_f1")))
