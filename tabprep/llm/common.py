"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import types

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabprep.session import materialize, scratch_path

#: A table is broadcast only if it has been counted and has at most this many
#: rows of bounded width; a larger one goes through a shuffle join.
BROADCAST_ROWS = 100_000

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, UPPER, LOWER)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count shows at most ``rows`` rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def worker_state(name: str) -> dict:
    """A dict that lives as long as the (reused) Python worker process."""
    holder = sys.modules.setdefault("tabprep_llm_worker_state", types.ModuleType("tabprep_llm_worker_state"))
    return holder.__dict__.setdefault(name, {})


def lean_worker(*keep: str) -> None:
    """Give back what this (reused) Python worker holds for other operators than ``keep``, and what its allocators
    hold though it is free."""
    import ctypes
    import gc

    import pyarrow as pa

    holder = sys.modules.get("tabprep_llm_worker_state")
    for name in [k for k, v in vars(holder).items() if isinstance(v, dict) and not k.startswith("__") and k not in keep] if holder else ():
        del holder.__dict__[name]
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: Bytes of an Arrow batch between Spark and a Python worker, in place of Spark's default of 64 MB: a task holds a batch on
#: both sides, and texts come back through the same channel.
ARROW_BYTES = 8_000_000
ARROW_CONF, ARROW_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", 64 * 1024 * 1024


def small_batches(spark: SparkSession) -> None:
    """Set the size of Arrow batches to ARROW_BYTES in a session that has Spark's default."""
    if spark.conf.get(ARROW_CONF).rstrip("b") in (str(ARROW_DEFAULT), "64m"):
        spark.conf.set(ARROW_CONF, str(ARROW_BYTES))


def filesystem(uri: str):
    """(pyarrow filesystem, path) of a folder in the shared storage."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(uri) if ":" in uri.split("/")[0] else (fs.LocalFileSystem(), uri)


def batches_of(rows, schema: pa.Schema, size: int = 2000):
    """Arrow record batches from an iterator of tuples."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def arrow_schema(ddl: str) -> pa.Schema:
    """Arrow schema of a flat DDL string with the types used here."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(),
             "boolean": pa.bool_(), "double": pa.float64(), "float": pa.float32()}
    return pa.schema([(part.split()[0], kinds[part.split()[1]]) for part in ddl.split(",")])


__all__ = ["ascii_lower", "arrow_schema", "batches_of", "filesystem", "lean_worker", "materialize", "scratch_path", "small",
           "small_batches", "table", "worker_state"]
