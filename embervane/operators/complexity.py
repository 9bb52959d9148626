"""Complexity diagnostic: how simple a classifier the embeddings need, by a ladder of probes.

dummy (largest class), linear (logistic), smooth_poly (squares and products of the first principal components), kernel_approx
(random Fourier features), knn (votes of the nearest rows). It runs only where the overlap score says that there is
something to separate, and recommends the simplest family within a tolerance of the best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from embervane.operators import probe as P, prototypes as O, retrieval as T, targets as G
from embervane.operators.compression import _map_vectors, pca
from embervane.session import Scratch

#: Families from simple to complex.
LADDER = ("dummy", "linear", "smooth_poly", "kernel_approx", "knn")
REPORT = "probe string, place int, balanced_accuracy double, accuracy double, macro_f1 double, weighted_f1 double"


def _products(x: np.ndarray) -> np.ndarray:
    i, j = np.triu_indices(x.shape[1])
    return np.concatenate([x, x[:, i] * x[:, j]], 1)


def _fourier(x: np.ndarray, n: int, seed: int, width: float) -> np.ndarray:
    rng = np.random.default_rng(seed)
    w, b = rng.normal(0, width, (x.shape[1], n)), rng.uniform(0, 2 * np.pi, n)
    return np.sqrt(2 / n) * np.cos(x @ w + b)


def nearest_votes(rows: DataFrame, k: int = 5) -> DataFrame:
    """rows(row_id, vec, label, fold) to (row_id, label, predicted): the label that most of the k nearest rows of other folds
    have, ties to the lower label. The rows go to every task, so their size is checked."""
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d")).first()
    if size["n"] * (size["d"] or 0) > T.GALLERY_VALUES:
        raise ValueError("nearest votes are for evaluation sets; the rows are too many to go to every task")
    held = rows.select("vec", "label", "fold").orderBy("row_id").toPandas()
    classes, codes = np.unique(held["label"].to_numpy(), return_inverse=True)
    sent = rows.sparkSession.sparkContext.broadcast((np.stack(held["vec"].to_numpy()).astype(float) if len(held) else None, codes, held["fold"].to_numpy(), classes))

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, codes, fold, classes = sent.value
        for b in batches:
            if len(b):
                q = np.stack(b["vec"].to_numpy()).astype(float)
                d = np.round((q * q).sum(1)[:, None] + (x * x).sum(1) - 2 * q @ x.T, 10)
                d[b["fold"].to_numpy()[:, None] == fold] = np.inf
                near = np.argsort(d, axis=1, kind="stable")[:, :k]
                votes = np.zeros((len(b), len(classes)))
                np.add.at(votes, (np.arange(len(b))[:, None], codes[near]), 1)
                yield pd.DataFrame({"row_id": b["row_id"], "label": b["label"], "predicted": classes[votes.argmax(1)]})

    kinds = dict(rows.dtypes)
    return rows.select("row_id", "vec", "label", "fold").mapInPandas(vote, f"row_id {kinds['row_id']}, label {kinds['label']}, predicted {kinds['label']}")


def majority(rows: DataFrame, k: int) -> DataFrame:
    """(row_id, label, predicted): the largest class of the other folds."""
    n = rows.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n"))
    whole = n.groupBy("label").agg(F.sum("n").alias("all"))
    other = n.select("fold").distinct().withColumn("j", F.lit(1)).join(whole.withColumn("j", F.lit(1)), "j").join(n, ["fold", "label"], "left")
    best = other.groupBy("fold").agg(F.min_by("label", F.struct(-(F.col("all") - F.coalesce("n", F.lit(0))), "label")).alias("predicted"))
    return rows.join(F.broadcast(best), "fold").select("row_id", "label", "predicted")  # a row a fold


def diagnose(rows: DataFrame, overlap_score: float | None, threshold: float = 0.8, folds: int = 3, tolerance: float = 0.02, seed: int = 42, probes: tuple[str, ...] = LADDER) -> tuple[dict, DataFrame]:
    """(summary, one row per probe with its out-of-fold metrics) of rows(row_id, vec, label[, group]).

    Without a score, or with one below ``threshold``, nothing runs: the summary says so and the table is empty. Too few
    rows or groups for two folds are a skip as well.
    """
    spark = rows.sparkSession
    none = spark.createDataFrame([], REPORT)
    if overlap_score is None or overlap_score < threshold:
        return skipped("no overlap score" if overlap_score is None else "overlap below threshold", overlap_score, threshold), none
    try:
        k, data = G.safe_folds(rows, "row_id", "label", folds, "group" if "group" in rows.columns else None, seed)
    except ValueError as e:
        return skipped(str(e), overlap_score, threshold), none
    scratch = Scratch(spark)
    data = scratch.put(data.where("label is not null").select("row_id", "vec", "label", "fold"), "folds")
    dim = data.agg(F.max(F.size("vec"))).first()[0]
    features = {
        "linear": lambda: data,
        "smooth_poly": lambda: _map_vectors(pca(data, min(8, dim - 1), whiten=True) if dim > 1 else data, _products),
        "kernel_approx": lambda: _map_vectors(data, lambda x: _fourier(x, 128, seed, 1 / np.sqrt(x.shape[1]))),
    }
    out = None
    for name in probes:
        pred = majority(data, k) if name == "dummy" else nearest_votes(data) if name == "knn" else P.logistic_out_of_fold(features[name](), k)
        m = O.classification_summary(O.confusion(scratch.put(pred, name)))
        m = m.select(F.lit(name).alias("probe"), F.lit(LADDER.index(name)).alias("place"), "balanced_accuracy", "accuracy", "macro_f1", "weighted_f1")
        out = m if out is None else out.unionByName(m)
    report = scratch.put(out, "report")
    return summary(report, tolerance) | {"status": "ok", "overlap_score": overlap_score, "threshold": threshold, "folds": k}, report


def skipped(reason: str, overlap_score: float | None, threshold: float) -> dict:
    return {"status": "skipped", "reason": reason, "overlap_score": overlap_score, "threshold": threshold}


def summary(report: DataFrame, tolerance: float = 0.02, metric: str = "balanced_accuracy") -> dict:
    """The best probe, the simplest within ``tolerance`` of it, and by how much the best nonlinear probe beats the linear one."""
    rows = {r["probe"]: r for r in report.where(F.col(metric).isNotNull()).collect()}  # a row a probe
    if not rows:
        return {"best_probe": None, "recommended": None, "nonlinear_gain": None, "primary_metric": metric}
    best = min(rows.values(), key=lambda r: (-r[metric], r["place"]))
    simple = min((r for r in rows.values() if r[metric] >= best[metric] - tolerance - 1e-12), key=lambda r: r["place"])
    curved = [r[metric] for p, r in rows.items() if p not in ("dummy", "linear")]
    gain = round(max(curved) - rows["linear"][metric], 6) if curved and "linear" in rows else None
    return {"best_probe": best["probe"], "recommended": simple["probe"], "nonlinear_gain": gain, "primary_metric": metric, "guidance": guidance(simple["probe"], gain)}


def guidance(recommended: str, gain: float | None) -> str:
    return {"dummy": "no probe beats the largest class", "linear": "a linear classifier is enough"}.get(recommended, f"a nonlinear classifier ({recommended}) gains {gain:+.3f} over a linear one" if gain is not None else f"use {recommended}")
