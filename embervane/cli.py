"""Command line: the steps of an evaluation over tables and artifacts, each one Spark job.

    python -m embervane.cli <step> [options] --out <folder>

Planning, embedding and merging of shards are one job here; the steps that write, score, compress, diagnose, collect and
report are left.
"""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from embervane.operators import complexity, compression as C, metrics as M, prototypes as O, retrieval as T
from embervane.plans import benchmark as B
from embervane.session import build_session
from embervane.sources import datasets as D


def _function(path: str):
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


def _rows(spark: SparkSession, path: str) -> DataFrame:
    """A table, or the rows of an artifact."""
    try:
        return D.read_artifact(spark, path)[0]
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.read.parquet(path)


def _how(a) -> C.Compression:
    return C.Compression(a.method, float(a.components) if a.components and "." in a.components else int(a.components) if a.components else None)


def embed(spark, a) -> None:
    """A table through an extractor (module:function of rows) to an artifact; every row must come out."""
    rows = spark.read.parquet(a.table)
    vec = _function(a.extractor)(rows) if a.extractor else rows.withColumn("vec", F.col(a.vec))
    D.write_artifact(vec.select(F.col(a.id).alias("row_id"), "vec"), a.out, {"extractor": a.extractor or a.vec}, n_expected=rows.count())


def write_labels(spark, a) -> None:
    rows = spark.read.parquet(a.table)
    D.write_labels(D.Dataset(rows, a.id, a.id, a.label, a.target_type), a.out)


def write_groups(spark, a) -> None:
    rows = spark.read.parquet(a.table).select(F.col(a.id).alias("row_id"), F.col(a.group).alias("group"))
    if rows.where("group is null").limit(1).count():
        raise ValueError("a group is null")
    D.write_artifact(rows, a.out, {})


def compress(spark, a) -> None:
    rows, meta = C.compress(_rows(spark, a.embeddings), _how(a), _rows(spark, a.fit_on) if a.fit_on else None)
    D.write_artifact(rows, a.out, meta)


def score(spark, a) -> None:
    rows = D.aligned(spark, a.embeddings, a.labels)
    name = {"single_label": "label", "multi_label": "labels", "regression": "target"}[a.target_type]
    rows = rows.withColumnRenamed("label", name)
    if a.groups:
        rows = rows.join(_rows(spark, a.groups), "row_id")
    metric = M.load(a.metric) if ":" in a.metric else M.BUILT_IN[a.metric]()
    out = [(a.embeddings, r.name, a.seed + i, r.score, r.higher_is_better) for i in range(a.repeats) for r in [metric.score(rows, a.target_type, a.seed + i)]]
    spark.createDataFrame(out, "variant string, metric string, seed bigint, score double, higher_is_better boolean").coalesce(1).write.mode("overwrite").parquet(a.out)


def diagnose(spark, a) -> None:
    rows = D.aligned(spark, a.embeddings, a.labels)
    overlap = M.OverlapMetric().score(rows, "single_label", a.seed).score
    D.put_json(spark, a.out, complexity.diagnose(rows, overlap, a.threshold, seed=a.seed)[0])


def collect(spark, a) -> None:
    B.collect_scores([spark.read.parquet(p) for p in a.scores]).coalesce(1).write.mode("overwrite").parquet(a.out)


def from_artifacts(spark, a) -> None:
    """Ranked results of score files as JSON."""
    rows = None
    for p in a.scores:
        part = spark.read.parquet(p).groupBy("variant", "metric").agg(F.avg("score").alias("score"), F.first("higher_is_better").alias("higher_is_better"))
        rows = part if rows is None else rows.unionByName(part)
    from embervane.operators import results as R

    D.save_json_report(R.ranked(rows, "score", "variant", ("metric",), ~F.col("higher_is_better")).orderBy("metric", "place"), a.out)


def score_retrieval(spark, a) -> None:
    q, g = _rows(spark, a.queries).withColumnRenamed("row_id", "q"), _rows(spark, a.gallery).withColumnRenamed("row_id", "g")
    m = T.mean_metrics(T.query_scores(q.select("q", "vec"), g.select("g", "vec"), spark.read.parquet(a.relevance), spark.read.parquet(a.exclusions) if a.exclusions else None, metric=a.similarity))
    m.coalesce(1).write.mode("overwrite").parquet(a.out)


def compress_retrieval(spark, a) -> None:
    g, q, meta = C.compress_pair(_rows(spark, a.gallery), _rows(spark, a.queries), _how(a))
    D.write_artifact(g, f"{a.out}/gallery", meta)
    D.write_artifact(q, f"{a.out}/queries", meta)


def write_relevance(spark, a) -> None:
    """A table (q, grades) of one grade for each gallery row to pairs."""
    D.relevance_from_matrix(spark.read.parquet(a.table)).write.mode("overwrite").parquet(a.out)


def score_zero_shot(spark, a) -> None:
    samples, prompts = D.aligned(spark, a.embeddings, a.labels), spark.read.parquet(a.prompts)
    m = O.classification_summary(O.confusion(O.zero_shot(samples, O.class_prototypes(prompts), a.similarity)))
    m.coalesce(1).write.mode("overwrite").parquet(a.out)


def write_protocol(spark, a) -> None:
    prompts = spark.read.parquet(a.prompts)
    D.put_json(spark, a.out, {"fingerprint": D.ZeroShotDataset(prompts, prompts).fingerprint(), "n_prompts": prompts.count()})


TEXT, NEEDED = {}, {"required": True}
STEPS = {
    "embed": (embed, {"--table": NEEDED, "--id": {"default": "row_id"}, "--extractor": TEXT, "--vec": {"default": "vec"}}),
    "write-labels": (write_labels, {"--table": NEEDED, "--id": {"default": "row_id"}, "--label": {"default": "label"}, "--target-type": {"default": "single_label"}}),
    "write-groups": (write_groups, {"--table": NEEDED, "--id": {"default": "row_id"}, "--group": {"default": "group"}}),
    "compress": (compress, {"--embeddings": NEEDED, "--fit-on": TEXT, "--method": NEEDED, "--components": TEXT}),
    "score": (score, {"--embeddings": NEEDED, "--labels": NEEDED, "--groups": TEXT, "--metric": {"default": "overlap"}, "--target-type": {"default": "single_label"}, "--seed": {"type": int, "default": 42}, "--repeats": {"type": int, "default": 1}}),
    "diagnose-complexity": (diagnose, {"--embeddings": NEEDED, "--labels": NEEDED, "--threshold": {"type": float, "default": 0.8}, "--seed": {"type": int, "default": 42}}),
    "collect-scores": (collect, {"--scores": {"nargs": "+", "required": True}}),
    "benchmark-from-artifacts": (from_artifacts, {"--scores": {"nargs": "+", "required": True}}),
    "score-retrieval": (score_retrieval, {"--queries": NEEDED, "--gallery": NEEDED, "--relevance": NEEDED, "--exclusions": TEXT, "--similarity": {"default": "cosine"}}),
    "compress-retrieval": (compress_retrieval, {"--queries": NEEDED, "--gallery": NEEDED, "--method": NEEDED, "--components": TEXT}),
    "write-retrieval-relevance": (write_relevance, {"--table": NEEDED}),
    "score-zero-shot": (score_zero_shot, {"--embeddings": NEEDED, "--labels": NEEDED, "--prompts": NEEDED, "--similarity": {"default": "cosine"}}),
    "write-zero-shot-protocol": (write_protocol, {"--prompts": NEEDED}),
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="embervane", description=__doc__)
    steps = p.add_subparsers(dest="step", required=True)
    for name, (f, options) in STEPS.items():
        s = steps.add_parser(name, help=(f.__doc__ or "").split("\n")[0])
        s.add_argument("--out", required=True)
        for flag, how in options.items():
            s.add_argument(flag, **how)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    STEPS[a.step][0](spark or SparkSession.getActiveSession() or build_session("embervane"), a)


if __name__ == "__main__":
    main()
