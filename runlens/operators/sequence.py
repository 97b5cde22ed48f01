"""Operators along a series: differences, ranks, averages, segments and splits.

A series is all rows of the key columns (run and tag by default) in order of step. Windows partition by series, so a
fact of any size is split by series; rows of one series meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SERIES = ("run", "tag")


def along(key: tuple[str, ...] = SERIES, order: str = "step") -> Window:
    return Window.partitionBy(*key).orderBy(order)


def with_difference(fact: DataFrame, key: tuple[str, ...] = SERIES, name: str = "delta") -> DataFrame:
    """Adds the change from the step before; NULL if either is missing: gaps are not bridged."""
    w = along(key)
    neighbour = F.lag("step").over(w) == F.col("step") - 1
    return fact.withColumn(name, F.when(neighbour, F.col("value") - F.lag("value").over(w)))


def with_bridged_difference(fact: DataFrame, key: tuple[str, ...] = SERIES, name: str = "delta") -> DataFrame:
    """Drops missing values and adds the change from the value before, however far back."""
    present = fact.where("value is not null")
    return present.withColumn(name, F.col("value") - F.lag("value").over(along(key)))


def with_average_rank(fact: DataFrame, key: tuple[str, ...] = SERIES, value: str = "value", name: str = "rank") -> DataFrame:
    """Adds the rank of each value that is present, from 1; equal values share the mean of their ranks."""
    present = F.col(value).isNotNull()
    w = Window.partitionBy(*key, present).orderBy(value)
    ties = F.count("*").over(Window.partitionBy(*key, value))
    return fact.withColumn(name, F.when(present, F.rank().over(w) + (ties - 1) / 2))


def with_running_sum(fact: DataFrame, key: tuple[str, ...] = SERIES, value: str = "value", name: str = "total", order: str = "step") -> DataFrame:
    return fact.withColumn(name, F.sum(value).over(along(key, order).rowsBetween(Window.unboundedPreceding, 0)))


def median_of(values: Column) -> Column:
    """Median of an array without nulls; NULL if it is empty."""
    s, n = F.array_sort(values), F.size(values)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def with_rolling_median(fact: DataFrame, width: int, key: tuple[str, ...] = SERIES, name: str = "rolling") -> DataFrame:
    """Adds the median of the last `width` rows' values that are present."""
    return fact.withColumn(name, median_of(F.collect_list("value").over(along(key).rowsBetween(1 - width, 0))))


def with_rolling_mean(fact: DataFrame, width: int, least: int, key: tuple[str, ...] = SERIES, name: str = "rolling") -> DataFrame:
    """Adds the mean of the last `width` rows; NULL with fewer than `least` values."""
    w = along(key).rowsBetween(1 - width, 0)
    return fact.withColumn(name, F.when(F.count("value").over(w) >= least, F.avg("value").over(w)))


def with_debiased_ema(fact: DataFrame, weight: float, key: tuple[str, ...] = SERIES, name: str = "ema") -> DataFrame:
    """Adds the exponential average of the present values so far, divided by the weight it has seen; NULL where the value is missing."""
    seen = F.collect_list("value").over(along(key).rowsBetween(Window.unboundedPreceding, 0))
    folded = F.aggregate(seen, F.lit(0.0), lambda acc, x: acc * weight + x * (1 - weight))
    return fact.withColumn(name, F.when(F.col("value").isNotNull(), folded / (1 - F.pow(F.lit(weight), F.size(seen)))))


def with_segment(rows: DataFrame, cut: Column, key: tuple[str, ...], order: str, name: str = "segment", position: str = "position") -> DataFrame:
    """Gaps and islands: adds a segment number, which rises where `cut` holds, and the position in the segment from 1."""
    w = Window.partitionBy(*key).orderBy(order)
    numbered = rows.withColumn(name, F.sum(F.coalesce(cut, F.lit(False)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.withColumn(position, F.row_number().over(Window.partitionBy(*key, name).orderBy(order)))


def null_runs(fact: DataFrame, axis: DataFrame) -> DataFrame:
    """Per series: n steps of its run, missing, leading, trailing, interior missing steps, late_start, early_stop.

    axis: run, step. A step without a row counts as missing; a series without any value has leading = n.
    """
    extent = axis.groupBy("run").agg(F.min("step").alias("lo"), F.max("step").alias("hi"), F.count("*").alias("n"))
    have = fact.groupBy(*SERIES).agg(
        F.count("value").alias("present"), F.min(F.when(F.col("value").isNotNull(), F.col("step"))).alias("first"), F.max(F.when(F.col("value").isNotNull(), F.col("step"))).alias("last")
    )
    rows = have.join(F.broadcast(extent), "run")  # one row a run
    leading = F.when(F.col("present") == 0, F.col("n")).otherwise(F.col("first") - F.col("lo")).cast("long")
    trailing = F.when(F.col("present") == 0, 0).otherwise(F.col("hi") - F.col("last")).cast("long")
    missing = F.col("n") - F.col("present")
    return rows.select(
        *SERIES, "n", missing.alias("missing"), leading.alias("leading"), trailing.alias("trailing"), (missing - leading - trailing).alias("interior"), (leading > 0).alias("late_start"), (trailing > 0).alias("early_stop")
    )


def best_split(fact: DataFrame, least: int = 3, key: tuple[str, ...] = SERIES) -> DataFrame:
    """Per series of present values: the cut with the least sum of squares around two means, each of `least` values or more.

    Columns: k (values before the cut), sse, sse_whole, mean_square. Ties (to nine digits of the mean square) go to the smallest k.
    """
    present = fact.where("value is not null")
    w, whole = along(key).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*key)
    sums = present.select(
        *key,
        F.row_number().over(along(key)).alias("k"),
        F.sum("value").over(w).alias("s"),
        F.sum(F.col("value") * F.col("value")).over(w).alias("q"),
        F.count("*").over(whole).alias("n"),
        F.sum("value").over(whole).alias("all_s"),
        F.sum(F.col("value") * F.col("value")).over(whole).alias("all_q"),
    )
    rest = F.col("n") - F.col("k")
    sse = F.col("q") - F.col("s") * F.col("s") / F.col("k") + (F.col("all_q") - F.col("q")) - F.pow(F.col("all_s") - F.col("s"), 2) / rest
    cuts = sums.where((F.col("k") >= least) & (rest >= least)).withColumn("sse", sse)
    best = F.min_by(F.struct("k", "sse"), F.struct(F.round(F.try_divide(F.col("sse") * F.col("n"), F.col("all_q")), 9), "k"))
    whole = F.max(F.col("all_q") - F.col("all_s") * F.col("all_s") / F.col("n"))
    found = cuts.groupBy(*key).agg(best.alias("b"), whole.alias("sse_whole"), F.max(F.col("all_q") / F.col("n")).alias("mean_square"))
    return found.select(*key, "b.k", "b.sse", "sse_whole", "mean_square")


def filled(fact: DataFrame, key: tuple[str, ...] = SERIES) -> DataFrame:
    """Missing values by linear interpolation over steps, with the nearest value held at either end."""
    back, ahead = along(key).rowsBetween(Window.unboundedPreceding, 0), along(key).rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col("value").isNotNull(), F.struct("step", "value"))
    rows = fact.withColumn("_p", F.last(known, ignorenulls=True).over(back)).withColumn("_n", F.first(known, ignorenulls=True).over(ahead))
    share = (F.col("step") - F.col("_p.step")) / F.nullif(F.col("_n.step") - F.col("_p.step"), F.lit(0))
    between = F.col("_p.value") + F.coalesce(share, F.lit(0.0)) * (F.col("_n.value") - F.col("_p.value"))
    return rows.withColumn("value", F.coalesce("value", between, "_p.value", "_n.value")).drop("_p", "_n")
