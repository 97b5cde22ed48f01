"""Incremental ingest by Structured Streaming. Each stream also runs over what is there and then ends (availableNow)."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def state_folder(spark: SparkSession) -> str:
    """A new folder for a stream's progress and output, in the cluster's shared folder (spark.checkpoint.dir); only local mode may do without."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="runlens-stream-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def file_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """New Parquet files of a folder (or one file) as a stream, some files a micro-batch."""
    schema = spark.read.parquet(path).schema
    path = f"{path[:-1]}[{path[-1]}]"  # as a pattern, the path may also name a single file
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_batches(stream: DataFrame, apply: Callable[[DataFrame, int], None], folder: str, every: str | None = None):
    """Starts `apply` on each micro-batch: all that is there, then stop, or with `every` at that interval until stopped."""
    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", f"{folder}/progress")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def append_once(stream: DataFrame, key: list[str], folder: str) -> DataFrame:
    """Appends rows whose key is not stored yet; a batch that is run again after a failure replaces its own output."""
    spark, store = stream.sparkSession, f"{folder}/rows"

    def apply(batch: DataFrame, number: int) -> None:
        fresh = batch.dropDuplicates(key)
        if number:
            stored = spark.read.schema(batch.schema.add("batch", "long") if "batch" not in batch.columns else batch.schema).parquet(store).where(F.col("batch") < number).select(*key)
            fresh = fresh.join(stored, key, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{store}/batch={number}")

    run_batches(stream, apply, folder).awaitTermination()
    return spark.read.parquet(store).drop("batch")


def windowed_counts(stream: DataFrame, time: str, width: str, lateness: str, folder: str, *by: str) -> DataFrame:
    """by, start, n, total: counts per tumbling window, each window written when the watermark has passed it.

    Rows that come later than `lateness` after the newest time seen do not count. Windows still open when the stream
    ends are not written.
    """
    counts = stream.withWatermark(time, lateness).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    flat = counts.select(*by, F.col("window.start").alias("start"), "n", "total")
    flat.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(flat.schema).parquet(f"{folder}/rows")


def latest_entries(stream: DataFrame, key: str, time: str, keep: int, folder: str) -> DataFrame:
    """key, entries, newest: the number of rows seen and the times of the last `keep`, held as state per key."""

    def step(k, frames, state: GroupState):
        seen, times = state.get if state.exists else (0, [])
        for pdf in frames:
            seen += len(pdf)
            times = sorted([*times, *pdf[time].tolist()])[-keep:]
        state.update((seen, times))
        import pandas as pd

        yield pd.DataFrame({key: [k[0]], "entries": [seen], "times": [times]})

    kind = stream.schema[key].dataType.simpleString()
    out = stream.select(key, time).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, entries long, times array<double>", "entries long, times array<double>", "update", GroupStateTimeout.NoTimeout)

    def apply(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/rows/n={number}")

    out.writeStream.outputMode("update").foreachBatch(apply).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    rows = stream.sparkSession.read.parquet(f"{folder}/rows")
    return rows.groupBy(key).agg(F.max_by("entries", "batch").alias("entries"), F.max_by("times", "batch").alias("times"))
