"""JSON documents and JSON lines: readers with declared schemas, and sinks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _or_empty(spark: SparkSession, schema: StructType | str, read) -> DataFrame:
    """What read() gives, or an empty table where the path doesn't exist."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A folder or file of whole JSON documents; a missing path gives an empty table."""
    return _or_empty(spark, schema, lambda: spark.read.schema(schema).option("multiLine", True).json(path))


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines; blank lines are skipped, a line that isn't JSON or doesn't fit the schema is an error, a missing path gives an empty table."""
    return _or_empty(spark, schema, lambda: spark.read.schema(schema).option("mode", "FAILFAST").json(path))


def append_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def metric_lines(fact: DataFrame) -> DataFrame:
    """run, tag, line: a metric's values in the order of its steps as one JSON line, gaps as null, numbers that are not finite too."""
    value = F.when(F.abs(F.col("value")) < float("inf"), F.round("value", 6))
    cells = F.transform(F.array_sort(F.collect_list(F.struct("step", value.alias("value")))), lambda c: c["value"])
    line = F.to_json(F.create_map("tag", "cells"))
    return fact.groupBy("run", "tag").agg(cells.alias("cells")).select("run", "tag", line.alias("line"))


def write_metric_lines(fact: DataFrame, path: str) -> None:
    """A folder a run, one metric a line, sorted by tag over all files of the folder."""
    lines = metric_lines(fact).repartitionByRange("run", "tag").sortWithinPartitions("run", "tag")
    lines.select("run", "line").write.partitionBy("run").mode("overwrite").text(path)
