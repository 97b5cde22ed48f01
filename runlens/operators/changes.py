"""Level shifts and drifts along series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sequence import SERIES, along, median_of


def level_shift(fact: DataFrame, least: int = 3) -> DataFrame:
    """run, tag, k, ratio, disjoint: the cut with the largest ratio of medians before and after; do the ranges not overlap?

    A series is held as one array, cut at every place with `least` values on either side. A cut beside a zero median has
    no ratio and counts only where no cut has one.
    """
    series = fact.where("value is not null").groupBy(*SERIES).agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "value"))), lambda x: x["value"]).alias("_v"))
    n = F.size("_v")
    cuts = series.where(n >= 2 * least).withColumn("k", F.explode(F.sequence(F.lit(least), n - least)))
    before, after = F.slice("_v", 1, F.col("k")), F.slice("_v", F.col("k") + 1, n - F.col("k"))
    a, b = median_of(before), median_of(after)
    ratio = F.greatest(F.try_divide(a, b), F.try_divide(b, a))
    disjoint = (F.array_max(before) < F.array_min(after)) | (F.array_max(after) < F.array_min(before))
    best = F.min_by(F.struct("k", "ratio", "disjoint"), F.struct(F.col("ratio").isNull(), -F.round("ratio", 9), "k"))
    return cuts.select(*SERIES, "k", ratio.alias("ratio"), disjoint.alias("disjoint")).groupBy(*SERIES).agg(best.alias("b")).select(*SERIES, "b.*")


def boundary_drift(fact: DataFrame, boundaries: list[int]) -> DataFrame:
    """run, tag, boundary, ratio: median from the boundary step on over the median before it."""
    rows = fact.where("value is not null").withColumn("boundary", F.explode(F.array(*map(F.lit, boundaries))))
    after = F.col("step") >= F.col("boundary")
    m = rows.groupBy(*SERIES, "boundary").agg(F.median(F.when(~after, F.col("value"))).alias("before"), F.median(F.when(after, F.col("value"))).alias("after"))
    return m.where("before is not null and after is not null").select(*SERIES, "boundary", F.try_divide("after", "before").alias("ratio"))


def boundary_jumps(fact: DataFrame, step: int, width: int, quantile: float) -> DataFrame:
    """run, tag, jump, limit: the change of means around `step`, and the quantile of that change over all steps of the series."""
    present = fact.where("value is not null")
    w = along()
    jump = F.avg("value").over(w.rowsBetween(0, width - 1)) - F.avg("value").over(w.rowsBetween(-width, -1))
    jumps = present.withColumn("jump", F.abs(jump)).where("jump is not null")
    limits = jumps.groupBy(*SERIES).agg(F.percentile("jump", quantile).alias("limit"))
    return jumps.where(F.col("step") == step).select(*SERIES, "jump").join(limits, list(SERIES))
