"""Intermediate tables, written where every executor can read them."""

from __future__ import annotations

import functools
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder: spark.checkpoint.dir; without that setting, in local mode alone, a new temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="runlens-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def extended(schema: StructType, **more: str) -> StructType:
    """A new schema with more fields, name=type."""
    added = StructType.fromDDL(", ".join(f"{name} {kind}" for name, kind in more.items()))
    return StructType([*schema.fields, *added.fields])


#: Rows of whole texts that go to a Python worker at once.
TEXT_ROWS = 2000
#: Bytes that go to a Python worker at once; a longer row goes alone.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def narrow_batches(spark: SparkSession) -> None:
    """Sends at most TEXT_ROWS rows and about BATCH_BYTES to a Python worker at once in this session, since a row may be a long text.

    No result depends on it: it bounds the buffers that the executor and the worker hold for a batch.
    """
    if not 0 < int(spark.conf.get(_BATCH)) <= TEXT_ROWS:
        spark.conf.set(_BATCH, str(TEXT_ROWS))
    size = spark.conf.get(_BYTES)
    if not size.isdigit() or not 0 < int(size) <= BATCH_BYTES:
        spark.conf.set(_BYTES, str(BATCH_BYTES))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as no column of df has it."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


_scopes = threading.local()


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from a Parquet table in the shared folder: computed once, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if getattr(_scopes, "open", None):
        _scopes.open[-1].append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def scratch(f: Callable) -> Callable:
    """f, whose result needs none of the tables that it wrote on the way: they are deleted when it ends."""

    @functools.wraps(f)
    def run(*args, **kw):
        if not hasattr(_scopes, "open"):
            _scopes.open = []
        _scopes.open.append([])
        try:
            return f(*args, **kw)
        finally:
            for spark, path in _scopes.open.pop():
                _delete(spark, path)

    return run


def tidy(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """f with its result written; the tables that it wrote on the way are deleted, since nothing reads them any more."""

    @functools.wraps(f)
    def run(*args, **kw) -> DataFrame:
        if not hasattr(_scopes, "open"):
            _scopes.open = []
        _scopes.open.append([])
        try:
            result = f(*args, **kw)
        except BaseException:
            _scopes.open.pop()
            raise
        inner = _scopes.open.pop()
        result = written(result, f.__name__)
        for spark, path in inner:
            _delete(spark, path)
        return result

    return run
