"""Metrics over embeddings: functions from rows to one result row, built in or supplied by the user."""

from __future__ import annotations

import importlib
import inspect
import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import DataFrame, functions as F

from embervane.operators import probe as P, prototypes as O, retrieval as T, targets as G
from embervane.session import Scratch


@dataclass(frozen=True)
class MetricResult:
    """One score, how it is read, and what else was measured. ``score`` is None where it does not exist."""

    name: str
    score: float | None
    higher_is_better: bool = True
    details: dict[str, float] = field(default_factory=dict)
    per_class: DataFrame | None = None


class EmbeddingMetric(Protocol):
    """rows(row_id, vec, label or labels or target[, group]) to a result."""

    name: str

    def score(self, rows: DataFrame, target_type: str, seed: int) -> MetricResult: ...


def coerce(raw: Any, name: str, higher_is_better: bool = True) -> MetricResult:
    """A result from a MetricResult, a mapping with ``score``, a one-row DataFrame with ``score``, or a number; it must be finite."""
    if isinstance(raw, DataFrame):
        rows = raw.limit(2).collect()
        if len(rows) != 1:
            raise ValueError(f"metric {name} gave {len(rows)} rows and not one")
        raw = rows[0].asDict()
    if isinstance(raw, MetricResult):
        got = raw
    elif isinstance(raw, Mapping):
        if "score" not in raw:
            raise ValueError(f"metric {name} gave no score")
        details = {k: float(v) for k, v in raw.items() if k != "score" and isinstance(v, (int, float)) and not isinstance(v, bool)}
        got = MetricResult(name, raw["score"], bool(raw.get("higher_is_better", higher_is_better)), details)
    elif isinstance(raw, (int, float)) and not isinstance(raw, bool):
        got = MetricResult(name, float(raw), higher_is_better)
    else:
        raise TypeError(f"metric {name} gave {type(raw).__name__}")
    if got.score is not None and not math.isfinite(got.score):
        raise ValueError(f"metric {name} gave the score {got.score}")
    return got


@dataclass(frozen=True)
class CallableMetric:
    """Any function as a metric; of rows, target_type and seed it is given what it has parameters for."""

    f: Callable
    name: str = "custom"
    higher_is_better: bool = True

    def score(self, rows: DataFrame, target_type: str = "single_label", seed: int = 42) -> MetricResult:
        known = {"rows": rows, "target_type": target_type, "seed": seed}
        wanted = inspect.signature(self.f).parameters
        open_ended = any(p.kind is p.VAR_KEYWORD for p in wanted.values())
        return coerce(self.f(**{k: v for k, v in known.items() if open_ended or k in wanted}), self.name, self.higher_is_better)


def load(path: str, **how) -> CallableMetric:
    """A metric from ``module:attribute``."""
    module, sep, attribute = path.partition(":")
    if not sep or not module or not attribute:
        raise ValueError(f"a metric is named module:attribute, not {path!r}")
    f = importlib.import_module(module)
    for part in attribute.split("."):
        f = getattr(f, part)
    if not callable(f):
        raise TypeError(f"{path} is not callable")
    return CallableMetric(f, how.pop("name", attribute), **how)


@dataclass(frozen=True)
class OverlapMetric:
    """Prototype overlap: k-means, exemplar or centroid prototypes; multi-label rows count once for each label; a numeric
    target has the continuous form. ``excluded`` classes are fitted and listed but not averaged."""

    prototypes: str = "kmeans"
    k: int | dict | None = None
    excluded: tuple = ()
    name: str = "overlap"

    def score(self, rows: DataFrame, target_type: str = "single_label", seed: int = 42) -> MetricResult:
        if target_type == "regression":
            r = O.continuous_overlap(rows.select("row_id", "vec", F.col("target")[0].alias("y") if dict(rows.dtypes)["target"].startswith("array") else F.col("target").alias("y")), seed=seed).first()
            return MetricResult(self.name, r["score"], details={"loss": r["loss"], "null_loss": r["null_loss"]})
        if target_type == "multi_label":
            rows = O.by_label(rows, "labels")
        protos = self.fit(rows, seed)
        per_class = Scratch(rows.sparkSession).put(O.overlap_per_class(O.overlap_events(rows, protos)), "overlap")
        s = O.overlap_summary(per_class, self.excluded).first()
        return MetricResult(self.name, s["macro"], details={"weighted": s["weighted"]}, per_class=per_class)

    def fit(self, rows: DataFrame, seed: int) -> DataFrame:
        if self.prototypes == "centroid":
            p = O.centroids(rows)
        elif self.prototypes == "exemplar":
            p = O.exemplars(rows, self.k if isinstance(self.k, int) else 5, seed)
        else:
            p = O.kmeans_prototypes(rows, O.resolve_k(G.class_counts(rows, "label"), self.k), seed=seed)
        return Scratch(rows.sparkSession).put(p, "prototypes")


@dataclass(frozen=True)
class LabelRetrievalMetric:
    """Leave-one-out retrieval of rows of the same label; single labels only."""

    k: int = 10
    metric: str = "ndcg"
    name: str = "label_retrieval"

    def score(self, rows: DataFrame, target_type: str = "single_label", seed: int = 42) -> MetricResult:
        if target_type != "single_label":
            raise ValueError("label retrieval needs single labels")
        m = T.mean_metrics(T.label_scores(rows, ks=(self.k,))).first().asDict()
        return MetricResult(self.name, m[f"{self.metric}_{self.k}" if f"{self.metric}_{self.k}" in m else self.metric], details={k: v for k, v in m.items() if k != "n_queries"})


@dataclass(frozen=True)
class LinearProbeMetric:
    """Out-of-fold linear probe: balanced accuracy for single labels, macro F1 for label sets, RMSE (lower is better) for
    numbers; folds keep groups together where there is a column ``group``."""

    folds: int = 5
    c: float = 1.0
    alpha: float = 1.0
    balanced: bool = False
    excluded: tuple = ()
    name: str = "linear_probe"

    def score(self, rows: DataFrame, target_type: str = "single_label", seed: int = 42) -> MetricResult:
        group = "group" if "group" in rows.columns else None
        scratch = Scratch(rows.sparkSession)
        if target_type == "regression":
            f = scratch.put(G.folds(rows, "row_id", None, self.folds, group, seed), "folds")
            m = P.target_metrics(P.ridge_out_of_fold(f, self.folds, self.alpha)).first().asDict()
            return MetricResult(self.name, m["rmse"], False, {k: v for k, v in m.items() if v is not None})
        if target_type == "multi_label":
            f = scratch.put(G.folds(rows, "row_id", None, self.folds, group, seed), "folds")
            m = P.multilabel_metrics(P.multilabel_out_of_fold(f, "labels", self.folds, self.c), self.excluded).first().asDict()
            return MetricResult(self.name, m["macro_f1"], details=m)
        k, f = G.safe_folds(rows, "row_id", "label", self.folds, group, seed)
        f = scratch.put(f, "folds")
        pred = scratch.put(P.logistic_out_of_fold(f, k, self.c, balanced=self.balanced), "predicted")
        m = O.classification_summary(O.confusion(pred), self.excluded).first().asDict()
        return MetricResult(self.name, m["balanced_accuracy"], details=m)


BUILT_IN = {"overlap": OverlapMetric, "linear_probe": LinearProbeMetric, "label_retrieval": LabelRetrievalMetric}
