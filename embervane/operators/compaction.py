"""Consolidation of many tiny sorted files into few well-sized ones.

Every input file is a sorted run. Runs are cut at key-range borders, the cuts of one range meet in one task
(a range is of bounded width, so a hot artifact is spread over many tasks), and each task merges its runs in
sorted order. Duplicates survive the merge and are counted, gaps are found against the expected key space,
and the merged records are rolled into output files by bytes with updated range metadata.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from embervane.session import table

RANGE_WIDTH = 65_536
#: Indices of waiting runs that are merged at a time, and bytes of merged ranges that are handed on at a time.
MERGE_ROWS, FLUSH_BYTES = 1_000_000, 8_000_000
TARGET_BYTES = 64 * 1024 * 1024

MERGED = "artifact_key string, range_id bigint, indices array<bigint>, extra_indices array<bigint>, extra_copies array<bigint>, missing array<bigint>, n_runs bigint, record_bytes double"


def artifact_key(output_key: Column) -> Column:
    """``[runs/<id>/]<base>/shards/<shard>-of-<total>[/<output>]`` to ``<base>[/<output>]``; null if it is no such key.

    Empty and ``.`` segments and outer blanks mean nothing.
    """
    parts = F.filter(F.split(F.trim(output_key), "/"), lambda s: ~F.trim(s).isin("", "."))
    path = F.array_join(F.transform(parts, lambda s: F.trim(s)), "/")
    pattern = r"^(?:runs/[^/]+/)?(.+)/shards/\d+-of-\d+(?:/(.+))?$"
    base, output = F.regexp_extract(path, pattern, 1), F.regexp_extract(path, pattern, 2)
    return F.when(base != "", F.concat_ws("/", base, F.when(output != "", output)))


def file_runs(files: DataFrame, range_width: int = RANGE_WIDTH) -> DataFrame:
    """One row per file and key range: (artifact_key, range_id, file_id, run), the run sorted ascending.

    Null and negative indices mark places without a record and are left out; so are files whose key or
    index list is null. Repeated indices inside one file stay.
    """
    clean = F.array_sort(F.filter("sample_indices", lambda i: i.isNotNull() & (i >= 0)))
    rid = lambda i: F.floor(i / F.lit(range_width)).cast("bigint")
    runs = files.select("file_id", artifact_key(F.col("output_key")).alias("artifact_key"), clean.alias("run")).where("artifact_key is not null and size(run) > 0")
    one = rid(F.element_at("run", 1)) == rid(F.element_at("run", -1))
    whole = F.array(F.struct(rid(F.element_at("run", 1)).alias("range_id"), F.col("run").alias("run")))
    cuts = F.transform(F.array_distinct(F.transform("run", rid)), lambda r: F.struct(r.alias("range_id"), F.filter("run", lambda i: rid(i) == r).alias("run")))
    return runs.select("artifact_key", "file_id", F.inline(F.when(one, whole).otherwise(cuts))).select("artifact_key", "range_id", "file_id", "run")


def expected_ranges(artifacts: DataFrame, range_width: int = RANGE_WIDTH) -> DataFrame:
    """One marker per artifact and key range with the number of keys expected in it."""
    last = F.floor((F.col("n_samples") - 1) / F.lit(range_width)).cast("bigint")
    a = artifacts.where("artifact_key is not null and n_samples > 0").select(F.trim("artifact_key").alias("artifact_key"), "n_samples", "record_bytes")
    a = a.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("range_id"))
    return a.select("artifact_key", "range_id", F.least(F.lit(range_width).cast("bigint"), F.col("n_samples") - F.col("range_id") * range_width).alias("expected"), "record_bytes")


class _Range:
    """The merge of the runs of one key range, in bounded memory: runs wait until they hold ``MERGE_ROWS`` indices, are
    then merged (runs are sorted, so a stable sort of their concatenation is a natural merge) and folded into one run of
    distinct indices with their number of copies, which is no longer than the range."""

    def __init__(self):
        self.waiting, self.size, self.n_runs = [], 0, 0
        self.keys, self.copies = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, run: np.ndarray) -> None:
        self.waiting.append(run)
        self.size += len(run)
        self.n_runs += 1
        if self.size > MERGE_ROWS:
            self.fold()

    def fold(self) -> None:
        merged = np.sort(np.concatenate([*self.waiting, np.empty(0, np.int64)]), kind="stable")
        at = np.flatnonzero(np.concatenate([[True], merged[1:] != merged[:-1]])) if len(merged) else np.empty(0, np.int64)
        keys, copies = np.concatenate([self.keys, merged[at]]), np.concatenate([self.copies, np.diff(np.append(at, len(merged)))])
        order = np.argsort(keys, kind="stable")
        keys, copies = keys[order], copies[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
        self.keys, self.copies = keys[first], np.add.reduceat(copies, first) if len(first) else copies
        self.waiting, self.size = [], 0


def _merge(range_width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges the runs of each (artifact, range); rows arrive grouped, the marker first, then by file_id."""
    schema = pa.schema([("artifact_key", pa.string()), ("range_id", pa.int64()), *((n, pa.list_(pa.int64())) for n in ("indices", "extra_indices", "extra_copies", "missing")), ("n_runs", pa.int64()), ("record_bytes", pa.float64())])
    out: list[dict] = []
    key, state, last, expected, width, held_bytes = None, _Range(), None, 0, None, 0

    def close() -> int:
        state.fold()
        kept, copies, lo = state.keys, state.copies, key[1] * range_width
        held = np.zeros(expected, bool)
        held[kept[kept < lo + expected] - lo] = True
        row = {"artifact_key": key[0], "range_id": key[1], "indices": kept, "extra_indices": kept[copies > 1], "extra_copies": copies[copies > 1], "missing": np.flatnonzero(~held) + lo, "n_runs": state.n_runs, "record_bytes": width}
        out.append(row)
        return sum(v.nbytes for v in row.values() if isinstance(v, np.ndarray))

    def flush() -> pa.RecordBatch:
        cols = [pa.array([r[f.name] for r in out], f.type) for f in schema]
        out.clear()
        return pa.RecordBatch.from_arrays(cols, schema=schema)

    for batch in batches:
        names, ranges, ids = (batch.column(n).to_pylist() for n in ("artifact_key", "range_id", "file_id"))
        wants, widths, lists = batch.column("expected").to_pylist(), batch.column("record_bytes").to_pylist(), batch.column("run")
        for i, k in enumerate(zip(names, ranges)):
            if k != key:
                if key is not None:
                    held_bytes += close()
                key, state, last, expected, width = k, _Range(), None, 0, None
                if held_bytes > FLUSH_BYTES:
                    held_bytes = 0
                    yield flush()
            if wants[i] is not None:
                if wants[i] >= expected:
                    expected, width = wants[i], widths[i] if widths[i] is not None else width
            elif ids[i] is None or ids[i] != last:  # a file listed twice stands twice in a row
                last = ids[i]
                state.add(lists[i].values.to_numpy(zero_copy_only=False))
    if key is not None:
        close()
    if out:
        yield flush()


def merge_runs(files: DataFrame, artifacts: DataFrame, range_width: int = RANGE_WIDTH) -> DataFrame:
    """Merges all files of each artifact range by range.

    files(file_id, output_key, sample_indices); artifacts(artifact_key, n_samples, record_bytes).
    A file that is listed twice (same file_id) counts once; a null file_id is never a repeat. An artifact
    without files has all its keys missing; files of an unknown artifact are merged but nothing is missing
    from them. One shuffle, on (artifact, range); the external sort brings the runs of a range together, and
    a task holds one range and ``MERGE_ROWS`` indices at most, however many copies there are.
    Returns one row per range: the sorted distinct ``indices``, those held more than once with their number
    of copies, those expected but ``missing``, and the number of merged runs.
    """
    runs = file_runs(files, range_width).select("artifact_key", "range_id", F.lit(None).cast("bigint").alias("expected"), "file_id", "run", F.lit(None).cast("double").alias("record_bytes"))
    marks = expected_ranges(artifacts, range_width).select("artifact_key", "range_id", "expected", F.lit(None).cast("bigint").alias("file_id"), F.lit(None).cast("array<bigint>").alias("run"), "record_bytes")
    rows = runs.unionByName(marks).repartition("artifact_key", "range_id")
    rows = rows.sortWithinPartitions("artifact_key", "range_id", F.col("expected").desc_nulls_last(), "file_id")
    return rows.mapInArrow(lambda it: _merge(range_width, it), MERGED)


def faults(merged: DataFrame) -> DataFrame:
    """(artifact_key, sample_index, fault): ``duplicate`` or ``missing``."""
    tag = lambda c, what: F.transform(c, lambda i: F.struct(i.alias("sample_index"), F.lit(what).alias("fault")))
    return merged.select("artifact_key", F.inline(F.concat(tag("extra_indices", "duplicate"), tag("missing", "missing"))))


def pieces(merged: DataFrame, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """The parts of each range that go to one output file: (artifact_key, file_no, indices, width, extra). A file holds
    at most ``target_bytes`` (one record at least); records of unknown width count as 4 bytes."""
    width = F.coalesce(F.max("record_bytes").over(W.partitionBy("artifact_key")), F.lit(4.0))
    before = F.coalesce(F.sum("n").over(W.partitionBy("artifact_key").orderBy("range_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = merged.select("artifact_key", "range_id", "indices", F.size("indices").cast("bigint").alias("n"), F.aggregate("extra_copies", F.lit(0).cast("bigint"), lambda a, c: a + c - 1).alias("extra"), "record_bytes")
    ranges = ranges.where("n > 0").withColumn("width", width).withColumn("before", before)
    ranges = ranges.withColumn("per_file", F.greatest(F.lit(1), F.floor(target_bytes / F.col("width"))).cast("bigint"))
    numbers = F.sequence(F.floor(F.col("before") / F.col("per_file")), F.floor((F.col("before") + F.col("n") - 1) / F.col("per_file")))
    parts = ranges.select("artifact_key", "indices", "n", "before", "per_file", "width", "extra", F.posexplode(numbers).alias("piece", "file_no"))
    lo = F.greatest(F.lit(0), F.col("file_no") * F.col("per_file") - F.col("before"))
    hi = F.least(F.col("n"), (F.col("file_no") + 1) * F.col("per_file") - F.col("before"))
    return parts.select("artifact_key", "file_no", F.slice("indices", (lo + 1).cast("int"), (hi - lo).cast("int")).alias("indices"), "width", F.when(F.col("piece") == 0, F.col("extra")).otherwise(0).alias("extra"))


def layout(merged: DataFrame, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Rolls the merged records of each artifact into files by bytes (see ``pieces``).

    One row per output file: (artifact_key, file_no, first_index, last_index, n_records, n_bytes, n_extra_copies).
    Each distinct index lands in exactly one file; ``n_extra_copies`` counts the copies merged away.
    """
    p = pieces(merged, target_bytes).withColumn("k", F.size("indices").cast("bigint"))
    return p.groupBy("artifact_key", "file_no").agg(F.min(F.element_at("indices", 1)).alias("first_index"), F.max(F.element_at("indices", -1)).alias("last_index"), F.sum("k").alias("n_records"), F.sum(F.col("k") * F.col("width")).cast("bigint").alias("n_bytes"), F.sum("extra").alias("n_extra_copies"))


def write_files(merged: DataFrame, target: str, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Writes the consolidated files below ``target`` and returns the manifest read back from them: (artifact_key,
    file_no, first_index, last_index, n_records, distinct, n_files). A file holds its records in order, one file a task."""
    spark = merged.sparkSession
    rows = pieces(merged, target_bytes).select("artifact_key", "file_no", F.explode("indices").alias("sample_index"))
    rows.repartition("artifact_key", "file_no").sortWithinPartitions("artifact_key", "file_no", "sample_index").write.partitionBy("artifact_key", "file_no").parquet(target)
    new = spark.read.schema("sample_index bigint, artifact_key string, file_no bigint").parquet(target).withColumn("file", F.input_file_name())
    return new.groupBy("artifact_key", "file_no").agg(F.min("sample_index").alias("first_index"), F.max("sample_index").alias("last_index"), F.count(F.lit(1)).alias("n_records"), (F.count_distinct("sample_index") == F.count(F.lit(1))).alias("distinct"), F.count_distinct("file").alias("n_files"))


def compact_files(spark: SparkSession, source: str, target: str, keys: list[str], target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Rewrites a folder of tiny parquet files into files of about ``target_bytes``, sorted and range-cut by ``keys``.

    Spark's external sort merges the runs; every record is kept, repeated rows included. The row count is
    read back and compared, and an unequal count is an error that leaves the source untouched. Returns the
    manifest (file, n_rows, first and last key) of the new files.
    """
    rows = spark.read.parquet(source)
    size = sum(_sizes(spark, source))
    n = max(1, -(-size // target_bytes))
    before = rows.count()
    rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).write.parquet(target)
    new = spark.read.parquet(target)
    after = new.count()
    if before != after:
        raise ValueError(f"compaction read {before} rows and wrote {after}")
    k = F.struct(*keys)
    return new.groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("n_rows"), F.min(k).alias("first_key"), F.max(k).alias("last_key"))


def _sizes(spark: SparkSession, path: str) -> Iterator[int]:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = fs.listFiles(p, True)
    while files.hasNext():
        f = files.next()
        if f.getPath().getName().endswith(".parquet"):
            yield f.getLen()


def artifacts_table(estimates: DataFrame) -> DataFrame:
    """Artifacts with the bytes of one record, from the memory estimates (unknown dtypes count 4 bytes a value)."""
    item = F.when(F.lower("dtype").isin("float16", "half"), 2).when(F.lower("dtype").isin("float64", "double"), 8).when(F.lower("dtype").isin("int8", "uint8"), 1).otherwise(4)
    return estimates.select("artifact_key", "n_samples", (F.col("embedding_dim") * item).cast("double").alias("record_bytes")).distinct()


def shard_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "embedding_shards").select("file_id", "output_key", "sample_indices")
    return merge_runs(files, artifacts_table(table(spark, sf_dir, "memory_estimates")))
