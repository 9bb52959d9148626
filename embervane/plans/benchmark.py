"""Benchmark runs: datasets by extractors by compressions by metrics, ranked."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from embervane.operators import complexity, compression as C, labels as L, metrics as M, prototypes as O, results as R, retrieval as T, targets as G
from embervane.session import Scratch
from embervane.sources.datasets import Dataset, RetrievalDataset, ZeroShotDataset, exact_hash

#: An extractor gives rows their vectors: a function of rows, or None where the vectors are there.
Extractor = Callable[[DataFrame], DataFrame] | None
RESULT = "view string, variant string, extractor string, compression string, metric string, score double, higher_is_better boolean, details string, input_dim int, output_dim int, weakest_class string, weakest_score double, stability_width double, advice string, warnings string"


@dataclass
class Benchmark:
    """Every view of a dataset by every extractor, compression and metric. Overlap is always measured, and first; the first
    metric ranks unless ``primary`` names another.

    ``views`` maps names to label columns that are evaluated besides the dataset's own; a view with fewer than two classes
    of two rows is left out with a warning. ``repeats`` seeds give the stability of the overlap score. ``diagnose`` runs
    the complexity ladder where the overlap reaches ``threshold``.
    """

    dataset: Dataset
    extractors: dict[str, Extractor]
    compressions: tuple[C.Compression, ...] = (C.Compression(),)
    metrics: tuple = ()
    primary: str | None = None
    views: dict[str, str] = field(default_factory=dict)
    repeats: int = 0
    diagnose: bool = False
    threshold: float = 0.8
    seed: int = 42
    warnings: list[str] = field(default_factory=list)
    diagnostics: dict[tuple[str, str], dict] = field(default_factory=dict)

    def __post_init__(self):
        if not self.extractors:
            raise ValueError("a benchmark needs an extractor")
        if not any(m.name == "overlap" for m in self.metrics):
            self.metrics = (M.OverlapMetric(), *self.metrics)
        names = [m.name for m in self.metrics]
        if len(set(names)) < len(names):
            raise ValueError(f"metrics share a name: {names}")
        self.primary = self.primary or names[0]
        if self.primary not in names:
            raise ValueError(f"no metric {self.primary!r} among {names}")

    def evaluation_views(self) -> dict[str, Dataset]:
        """The dataset and its views that can be evaluated."""
        out = {}
        for name, column in {"labels": self.dataset.label_col, **self.views}.items():
            d = replace(self.dataset, label_col=column, target_type=self.dataset.target_type if name == "labels" else "single_label")
            try:
                d.validate()
                out[name] = d
            except ValueError as e:
                if name == "labels" and not self.views:
                    raise
                self.warnings.append(f"view {name} is left out: {e}")
        return out

    def run(self) -> DataFrame:
        """One row per view, variant and metric. Each variant's vectors are written once and read by all metrics."""
        spark = self.dataset.rows.sparkSession
        scratch, out = Scratch(spark), []
        for view, d in self.evaluation_views().items():
            for name, extract in self.extractors.items():
                rows = scratch.put(metric_rows(d, extract), "embeddings")
                for how in self.compressions:
                    small, meta = C.compress(rows, how)
                    small = scratch.put(small, "compressed") if how.method != "none" else rows
                    out += self._variant(view, d, name, how, small, meta)
        return spark.createDataFrame(out, RESULT)

    def _variant(self, view: str, d: Dataset, name: str, how: C.Compression, rows: DataFrame, meta: dict) -> list[tuple]:
        out, weakest, variant = [], (None, None), how.name(name)
        width = interval = None
        if self.repeats:
            overlap = next(m for m in self.metrics if m.name == "overlap")
            scores = [overlap.score(rows, d.target_type, self.seed + i).score for i in range(self.repeats)]
            held = rows.sparkSession.createDataFrame([(i, s) for i, s in enumerate(scores) if s is not None], "repeat int, score double")
            s = O.stability(held).first()
            width, interval = s["width"], (s["from"], s["upto"])
        for metric in self.metrics:
            r = metric.score(rows, d.target_type, self.seed)
            if r.per_class is not None:
                w = r.per_class.where(~F.col("label").isin(*metric.excluded)) if getattr(metric, "excluded", ()) else r.per_class
                w = w.orderBy("score", "label").first()
                weakest = (str(w["label"]), w["score"]) if w else (None, None)
            if metric.name == "overlap" and self.diagnose and d.target_type == "single_label":
                self.diagnostics[view, variant] = complexity.diagnose(rows, r.score, self.threshold, seed=self.seed)[0]
            first = metric.name == "overlap"
            text = R.advice(r.score, width, weakest[1], d.target_type == "regression", interval) if first else None
            out.append((view, variant, name, how.method, metric.name, r.score, r.higher_is_better, json.dumps(r.details, sort_keys=True), meta["input_dim"], meta["output_dim"], weakest[0] if first else None, weakest[1] if first else None, width if first else None, text, "; ".join(meta["warnings"])))
        return out

    def ranked(self, results: DataFrame) -> DataFrame:
        """The primary metric's rows with their place in each view."""
        own = results.where(F.col("metric") == self.primary)
        return R.ranked(own, "score", "variant", ("view",), ~F.col("higher_is_better"))


def metric_rows(d: Dataset, extract: Extractor = None) -> DataFrame:
    """(row_id, vec, label or labels or target[, group]) of a dataset, with the vectors of an extractor."""
    rows = extract(d.rows) if extract else d.rows
    vec = "vec" if extract else d.input_col
    name = {"single_label": "label", "multi_label": "labels", "regression": "target"}[d.target_type]
    cols = [F.col(d.row_id).alias("row_id"), F.col(vec).alias("vec"), F.col(d.label_col).alias(name)]
    return rows.select(*cols, *([F.col(d.group_col).alias("group")] if d.group_col else [])).where("vec is not null")


def evaluate(dataset: Dataset, extractor: Extractor = None, **how) -> dict:
    """One extractor on one dataset: the rows of its results by metric."""
    b = Benchmark(dataset, {"extractor": extractor}, **how)
    return {r["metric"]: r.asDict() for r in b.run().collect()}


def retrieval_run(d: RetrievalDataset, extractors: dict[str, tuple[Extractor, Extractor]], compressions: tuple[C.Compression, ...] = (C.Compression(),), ks: tuple[int, ...] = (1, 5, 10), metric: str = "cosine", primary: str | None = None, both_ways: bool = False) -> DataFrame:
    """One row per extractor (of queries, of gallery) and compression, fitted on the gallery: the mean metrics, and, with
    ``both_ways``, those of the gallery's rows as queries and the mean of both primaries. Ranked by ``score``."""
    primary, out, scratch = primary or f"ndcg_{ks[-1]}", None, Scratch(d.queries.sparkSession)
    for name, (of_query, of_gallery) in extractors.items():
        q0 = scratch.put(of_query(d.queries) if of_query else d.queries, "queries").select("q", "vec")
        g0 = scratch.put(of_gallery(d.gallery) if of_gallery else d.gallery, "gallery").select("g", "vec")
        for how in compressions:
            g, q, meta = C.compress_pair(g0, q0, how)
            m = T.mean_metrics(T.query_scores(q, g, d.relevance, d.exclusions, ks, metric)).withColumn("score", F.col(primary))
            if both_ways:
                back = T.transpose(d.relevance)
                ex = d.exclusions.select(F.col("g").alias("q"), F.col("q").alias("g")) if d.exclusions is not None else None
                asked = g.withColumnRenamed("g", "q").join(back.where("grade > 0").select("q").distinct(), "q", "left_semi")
                r = T.mean_metrics(T.query_scores(asked, q.withColumnRenamed("q", "g"), back, ex, ks, metric)).select(F.col(primary).alias("reverse"))
                m = m.join(r).withColumn("score", (F.col("score") + F.col("reverse")) / 2)  # one row each
            m = m.select(F.lit(how.name(name)).alias("variant"), F.lit(meta["output_dim"]).alias("output_dim"), "*")
            out = m if out is None else out.unionByName(m)
    return scratch.put(out.withColumn("place", F.row_number().over(W.orderBy(F.desc("score"), "variant"))), "results")  # a row a variant


def zero_shot_run(d: ZeroShotDataset, extractors: dict[str, tuple[Extractor, Extractor]], compressions: tuple[C.Compression, ...] = (C.Compression(),), metric: str = "cosine", overlap: bool = True) -> DataFrame:
    """One row per extractor (of samples, of prompts) and compression, fitted on the samples: zero-shot metrics and, beside
    them, the overlap of the samples' classes. Ranked by accuracy."""
    scratch, rows = Scratch(d.samples.sparkSession), []
    for name, (of_sample, of_prompt) in extractors.items():
        s0 = scratch.put(of_sample(d.samples) if of_sample else d.samples, "samples").select("row_id", "label", "vec")
        p0 = scratch.put(of_prompt(d.prompts) if of_prompt else d.prompts, "prompts").select("label", "vec")
        for how in compressions:
            s, p, meta = C.compress_pair(s0, p0, how)
            pred = scratch.put(O.zero_shot(s, O.class_prototypes(p), metric), "predictions")
            m = O.classification_summary(O.confusion(pred)).first().asDict()
            ties = pred.where("tie").count()
            rows.append((how.name(name), meta["output_dim"], m["accuracy"], m["balanced_accuracy"], m["macro_f1"], M.OverlapMetric().score(s).score if overlap else None, ties, "; ".join(meta["warnings"] + ([f"{ties} ties went to the lower class"] if ties else [])), d.fingerprint()))
    out = d.samples.sparkSession.createDataFrame(rows, "variant string, output_dim int, accuracy double, balanced_accuracy double, macro_f1 double, overlap double, ties bigint, warnings string, protocol string")
    return out.withColumn("place", F.row_number().over(W.orderBy(F.desc("accuracy"), "variant")))  # a row a variant


def collect_scores(parts: list[DataFrame], keys: tuple[str, ...] = ("variant", "metric"), level: float = 0.95) -> DataFrame:
    """Results of several seeds, each with a column ``seed``, to their stability; a seed that stands twice is an error."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    twice = rows.groupBy(*keys, "seed").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"seed {twice[0]['seed']} stands twice for {[twice[0][k] for k in keys]}")
    return O.stability(rows.select(*keys, F.col("seed").alias("repeat"), "score"), level, keys)


def protocol(b: Benchmark) -> str:
    """A hash of what a run depends on besides the data: extractors, compressions, metrics and seed."""
    return exact_hash({"extractors": sorted(b.extractors), "compressions": [vars(c) for c in b.compressions], "metrics": [{"name": m.name, **{k: v for k, v in vars(m).items() if isinstance(v, (int, float, str, bool, type(None), tuple))}} for m in b.metrics], "seed": b.seed})
