"""Append-only evaluation history, in batches or as a stream."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

RECORD = "kind string, protocol string, stream string, evaluation_index bigint, context string, status string, error string, scores map<string,double>"
SCHEMA = "stream string, evaluation_index bigint, status string, recorded_at timestamp, metric string, value double"


def append(history: str, records: DataFrame) -> None:
    """Appends evaluation records; an evaluation that is there already (stream and index) is not appended again."""
    spark = records.sparkSession
    try:
        seen = spark.read.schema(SCHEMA).parquet(history).select("stream", "evaluation_index").distinct()
        records = records.join(seen, ["stream", "evaluation_index"], "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    records.select(*(c.split()[0] for c in SCHEMA.split(", "))).write.mode("append").parquet(history)


def latest(records: DataFrame, keys: tuple[str, ...] = ("stream",), order: tuple[str, ...] = ("evaluation_index",)) -> DataFrame:
    """The last evaluation of each key, by partial aggregates (no key is ordered in one task)."""
    rest = [c for c in records.columns if c not in keys]
    last = records.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last"))
    return last.select(*keys, *(F.col("_last")[c].alias(c) for c in rest)).select(*records.columns)


class Monitor:
    """Evaluates snapshots of a model one after the other and keeps their history as JSON lines in one folder.

    The first record is a header with the protocol; a monitor that resumes a history of another protocol is an error. A
    failed evaluation is recorded and raised, or, with ``on_error`` "continue", only recorded.
    """

    def __init__(self, spark: SparkSession, path: str, stream: str, protocol: str, on_error: str = "raise", report=print):
        if on_error not in ("raise", "continue"):
            raise ValueError("on_error is raise or continue")
        self.spark, self.path, self.stream, self.on_error, self.report = spark, path, stream, on_error, report
        held = self.records()
        known = {r["protocol"] for r in held.where("kind = 'header'").select("protocol").distinct().collect()}
        if known and known != {protocol}:
            raise ValueError("the history was written under another protocol")
        if not known:
            self._write([{"kind": "header", "protocol": protocol, "stream": stream}])

    def records(self) -> DataFrame:
        try:
            return self.spark.read.schema(RECORD).json(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], RECORD)

    def _write(self, rows: list[dict]) -> None:
        self.spark.createDataFrame([(json.dumps(r, sort_keys=True),) for r in rows], "value string").coalesce(1).write.mode("append").text(self.path)

    def evaluate(self, run, context: dict) -> dict | None:
        """``run()`` gives scores by name; they are recorded with the context (snapshot, epoch, step, ...)."""
        done = self.records().where("kind = 'evaluation'")
        index = (done.agg(F.max("evaluation_index")).first()[0] or 0) + 1
        text = json.dumps(context, sort_keys=True)
        if done.where(F.col("context") == text).limit(1).count():
            self.report(f"{self.stream}: this context was evaluated before")
        record = {"kind": "evaluation", "stream": self.stream, "evaluation_index": index, "context": text}
        try:
            scores = {k: float(v) for k, v in run().items()}
        except Exception as e:
            self._write([record | {"status": "failure", "error": f"{type(e).__name__}: {e}"}])
            if self.on_error == "raise":
                raise
            self.report(f"{self.stream} {index}: failed, {e}")
            return None
        self._write([record | {"status": "success", "scores": scores}])
        self.report(f"{self.stream} {index}: " + ", ".join(f"{k} {v:.4f}" for k, v in sorted(scores.items())))
        return scores

    def scores(self) -> DataFrame:
        """(stream, evaluation_index, status, metric, value), a failure with one row of nulls."""
        r = self.records().where("kind = 'evaluation'")
        return r.select("stream", "evaluation_index", "status", F.explode_outer("scores").alias("metric", "value"))


def changes(records: DataFrame, value: str, keys: tuple[str, ...], order: str) -> DataFrame:
    """Each evaluation's value with the change against the one before."""
    by = W.partitionBy(*keys).orderBy(order)
    return records.withColumn("change", F.col(value) - F.lag(value).over(by))


def follow(spark: SparkSession, source: str, schema: str, history: str, checkpoint: str, lateness: str = "1 day", window: str = "1 hour", **trigger):
    """Structured Streaming form: new files of evaluations to windowed means, appended once their window is over.

    ``source`` holds JSON lines of ``schema`` with recorded_at, stream, metric and value. State is bounded by the
    watermark; later records are dropped, which the query's progress reports. Returns the running query.
    """
    s = spark.readStream.schema(schema).json(source).withWatermark("recorded_at", lateness)
    g = s.groupBy(F.window("recorded_at", window).alias("w"), "stream", "metric").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    g = g.select(F.col("w.start").alias("since"), "stream", "metric", "n", "mean")
    return g.writeStream.format("parquet").option("path", history).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
