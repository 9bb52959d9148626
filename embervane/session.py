"""Session, table and scratch helpers.

Everything that has to survive a lost executor is written below the folder that the cluster names in
``spark.checkpoint.dir``; only where that setting is absent and the master is local (tests, a laptop) is a temporary
folder used.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "embervane", cores: str = "*", **conf: str) -> SparkSession:
    """A session with the settings the plans are written for; ``conf`` overrides them."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=settings).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_local_root: str | None = None


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables; a cluster without one is an error, as its executors share no disk."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    global _local_root
    if _local_root is None:
        _local_root = "file://" + tempfile.mkdtemp(prefix="embervane-")
        atexit.register(_remove, spark, _local_root)
    return _local_root


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone already; the folder is temporary then
        pass


class Scratch:
    """Intermediate tables of one operator run, written to the shared folder so that lineage ends there.

    ``put`` writes and reads back; ``drop`` removes a table that a later one has replaced. What is left
    is removed when the interpreter ends, as results are lazy and may still read it until then.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/embervane-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._embervane_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_embervane_path", None)
        if path:
            _remove(self.spark, path)


def empty(df: DataFrame) -> bool:
    return not df.take(1)
