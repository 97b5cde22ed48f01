"""Consecutive numbers of rows in one order over the whole table, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import unused, written

#: monotonically_increasing_id() holds the partition above this bit and the row's place in it below.
_PLACE_BITS = 33


def numbered(df: DataFrame, order: list[Column], name: str, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all) and `name`, which is 0, 1, 2, ... in the given order; rows that tie come in any order.

    Rows are dealt by ranges of the order, so a partition holds a stretch of it and equal keys share one: an order whose
    last column differs within a large group of ties spreads that group. The driver gets one count per partition.
    """
    spark = df.sparkSession
    at, part, before = unused(df, "at", "part", "before")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order).select(*(keep or df.columns), F.monotonically_increasing_id().alias(at))
    dealt = written(dealt, "numbered").withColumn(part, F.shiftright(at, _PLACE_BITS))
    counts, total, rows = sorted(tuple(r) for r in dealt.groupBy(part).count().collect()), 0, []
    for p, count in counts:
        rows.append((p, total))
        total += count
    offsets = F.broadcast(spark.createDataFrame(rows, f"{part} long, {before} long"))  # a row for each partition
    place = F.col(at).bitwiseAND((1 << _PLACE_BITS) - 1)
    return dealt.join(offsets, part).select(*(keep or df.columns), (F.col(before) + place).alias(name))
