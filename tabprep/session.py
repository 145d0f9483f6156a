"""Spark session and shared-folder helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark import SparkConf
from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

#: Paths of the tables written inside the innermost open ``scope``.
_SCOPE: ContextVar[list | None] = ContextVar("tabprep_scope", default=None)


def get_spark(master: str | None = None, app: str = "tabprep", shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the operators assume.

    On a cluster ``master`` stays None (spark-submit decides) and the cluster's
    own settings win; locally it defaults to ``local[*]``.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    elif not SparkConf().contains("spark.master"):  # spark-submit / cluster config wins
        b = b.master("local[*]")
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there. Where it is unset a local run gets a fresh
    folder under the system temp dir; any other master raises, because its
    executors would each write to a disk of their own.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) \
        or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="tabprep-ckpt-")
        sc.setCheckpointDir(d)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path inside the shared checkpoint folder (for written tables)."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df, name: str = "stage", written: list | None = None, options: dict | None = None):
    """Write ``df`` once as parquet in the shared checkpoint folder and read it
    back: later passes scan the written table instead of recomputing the plan,
    and the data survives the loss of the executors that computed it. The path is
    appended to ``written``, with which its owner calls ``release``, and belongs to
    the open ``scope`` besides. ``options`` go to the writer."""
    path = scratch_path(df.sparkSession, name)
    owner = _SCOPE.get()
    for paths in (written, owner):
        if paths is not None:
            paths.append(path)
    df.write.mode("error").options(**(options or {})).parquet(path)
    return df.sparkSession.read.parquet(path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[list]:
    """Owner of every table written inside it by any operator or query: they are deleted when it closes, so
    results must be collected or written before. Scopes nest; a table belongs to the innermost one."""
    paths: list = []
    token = _SCOPE.set(paths)
    try:
        yield paths
    finally:
        _SCOPE.reset(token)
        release(spark, paths)


def release(spark: SparkSession, written: list) -> None:
    """Delete the written tables of ``written`` and empty the list; one that is gone already is passed over."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while written:
        path = jvm.org.apache.hadoop.fs.Path(written.pop())
        path.getFileSystem(conf).delete(path, True)
