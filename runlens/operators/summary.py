"""Aggregates per series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sequence import SERIES


def deviation_from_median(fact: DataFrame, key: tuple[str, ...] = SERIES) -> DataFrame:
    """key, center, mad: the median, and the median distance from it (unscaled)."""
    center = fact.groupBy(*key).agg(F.median("value").alias("center"))
    return fact.join(center, list(key)).groupBy(*key).agg(F.first("center").alias("center"), F.median(F.abs(F.col("value") - F.col("center"))).alias("mad"))


def modal(fact: DataFrame, key: tuple[str, ...] = SERIES) -> DataFrame:
    """key, mode (the smallest of the most frequent values), mode_n, share, n_distinct."""
    counts = fact.where("value is not null").groupBy(*key, "value").agg(F.count("*").alias("n"))
    best = F.max_by("value", F.struct("n", -F.col("value")))
    out = counts.groupBy(*key).agg(best.alias("mode"), F.max("n").alias("mode_n"), F.sum("n").alias("_all"), F.count("*").alias("n_distinct"))
    return out.select(*key, "mode", "mode_n", (F.col("mode_n") / F.col("_all")).alias("share"), "n_distinct")


def series_summary(fact: DataFrame, key: tuple[str, ...] = SERIES) -> DataFrame:
    """One row per series: counts, first and last value and their change, mean, spread, extremes and where they are."""
    v, present = F.col("value"), F.col("value").isNotNull()
    at = F.when(present, F.col("step"))
    rows = fact.groupBy(*key).agg(
        F.count("value").alias("n"),
        F.count_if(~present).alias("missing"),
        F.min_by("value", at).alias("first"),
        F.max_by("value", at).alias("last"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("sd"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.min_by("step", F.when(present, F.struct(v, "step"))).alias("low_step"),
        F.min_by("step", F.when(present, F.struct(-v, "step"))).alias("high_step"),
        F.count_distinct("value").alias("n_distinct"),
    )
    change = F.col("last") - F.col("first")
    return rows.withColumns({"change": change, "change_share": ratio(change, F.abs("first")), "cv": ratio(F.col("sd"), F.abs("mean")), "constant": F.col("n_distinct") <= 1})


def ratio(a: Column, b: Column) -> Column:
    """a / b; NULL for a zero divisor."""
    return F.try_divide(a, b)


def weighted_mean(value: str, weight: str) -> Column:
    """Mean of present values by weight; rows with a missing or non-positive weight do not count."""
    ok = F.col(value).isNotNull() & (F.col(weight) > 0)
    return F.try_divide(F.sum(F.when(ok, F.col(value) * F.col(weight))), F.sum(F.when(ok, F.col(weight))))


def top_and_other(rows: DataFrame, name: str, amount: str, k: int, other: str = "other") -> DataFrame:
    """name, amount: the k largest totals by name, and the sum of the rest as `other`. Ties go to the smaller name."""
    totals = rows.groupBy(name).agg(F.sum(amount).alias(amount))
    top = totals.orderBy(F.desc(amount), name).limit(k).withColumn("_top", F.lit(True))
    label = F.when(F.col("_top"), F.col(name)).otherwise(other)
    return totals.join(F.broadcast(top.select(name, "_top")), name, "left").groupBy(label.alias(name)).agg(F.sum(amount).alias(amount))
