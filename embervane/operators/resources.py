"""What a run needs and took: memory plans, guards and profiles."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

BYTES = {"float16": 2, "half": 2, "float32": 4, "float": 4, "float64": 8, "double": 8, "int8": 1, "uint8": 1}


def memory_plan(estimates: DataFrame, budget: int) -> DataFrame:
    """estimates(artifact_key, n_samples, embedding_dim, dtype) with resident bytes, whether they fit the budget, the rate of a
    subsample that would, and the number of shards of a budget each. Unknown types count 4 bytes a value."""
    item = F.lit(4)
    for name, size in BYTES.items():
        item = F.when(F.lower("dtype") == name, F.lit(size)).otherwise(item)
    need = (F.col("n_samples") * F.col("embedding_dim") * item).cast("bigint")
    return estimates.withColumn("bytes", need).withColumn("fits", F.col("bytes") <= budget).withColumn("rate", F.round(F.least(F.lit(1.0), F.lit(float(budget)) / F.nullif(F.col("bytes").cast("double"), F.lit(0.0))), 6)).withColumn("n_shards", F.greatest(F.lit(1), F.ceil(F.col("bytes") / budget)).cast("bigint"))


def require_pairs(n_left: int, n_right: int, most: int) -> None:
    """Raises before a comparison of more pairs than allowed begins."""
    if n_left * n_right > most:
        raise ValueError(f"{n_left} x {n_right} pairs are more than {most}")


def profiled(rows: DataFrame, f, input_col: str) -> DataFrame:
    """(partition, batch, n_rows, seconds, rss_mb): how long ``f`` takes for each Arrow batch; its results are thrown away."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import resource

        from pyspark import TaskContext

        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        for i, b in enumerate(batches):
            began = time.perf_counter()
            f(b[input_col])
            yield pd.DataFrame({"partition": [part], "batch": [i], "n_rows": [len(b)], "seconds": [time.perf_counter() - began], "rss_mb": [resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024]})

    return rows.mapInPandas(run, "partition int, batch int, n_rows bigint, seconds double, rss_mb double")


def profile_summary(profile: DataFrame) -> DataFrame:
    """One row: batches, rows, median, 95th percentile and maximum of the seconds a row, the mean of the warm batches (all but
    the first of each partition) weighted by rows, and the largest memory."""
    per = F.col("seconds") / F.col("n_rows")
    warm = F.col("batch") > 0
    return profile.where("n_rows > 0").agg(F.count(F.lit(1)).alias("n_batches"), F.sum("n_rows").alias("n_rows"), F.median(per).alias("median"), F.percentile(per, F.lit(0.95)).alias("p95"), F.max(per).alias("largest"), (F.sum(F.when(warm, F.col("seconds"))) / F.sum(F.when(warm, F.col("n_rows")))).alias("warm_mean"), F.max("rss_mb").alias("rss_mb"))
