"""Runs on a common scale, cuts of a run explained, and pools that only a total shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .temporal import as_of


def interpolated(points: DataFrame, grid: DataFrame, on: list[str], x: str, y: str, bucket: float = 86_400.0) -> DataFrame:
    """grid (on, x) with y: linear between the neighbouring points of each key, NULL outside their range.

    points: on, x, y without nulls. Both neighbours come from as-of joins by buckets of x, so no key's points are sorted
    in one task.
    """
    probes = grid.select(*on, F.col(x).alias("_c"))
    before = as_of(probes, points.select(*on, F.col(x).alias("_x"), F.col(y).alias("_y")), on, "_c", "_x", ["_x", "_y"], bucket=bucket).withColumnsRenamed({"_x": "_x0", "_y": "_y0"})
    both = as_of(before, points.select(*on, F.col(x).alias("_x"), F.col(y).alias("_y")), on, "_c", "_x", ["_x", "_y"], backward=False, bucket=bucket)
    slope = (F.col("_y") - F.col("_y0")) / F.nullif(F.col("_x") - F.col("_x0"), F.lit(0.0))
    value = F.when(F.col("_x") == F.col("_x0"), F.col("_y0")).otherwise(F.col("_y0") + (F.col("_c") - F.col("_x0")) * slope)
    return both.select(*on, F.col("_c").alias(x), value.alias(y))


def aligned_by_cost(fact: DataFrame, cost: DataFrame, one: str, two: str, width: float) -> DataFrame:
    """tag, cost, a, b: values of two runs where both had cost the same, at multiples of `width` up to the cheaper run's cost.

    fact: run, tag, step, value; cost: run, step, cost, rising with the step. A value is NULL before a run's first and
    after its last value. Points where both are NULL are left out.
    """
    cost = cost.where(F.col("run").isin(one, two))
    most = cost.groupBy("run").agg(F.max("cost").alias("m")).agg(F.min("m").alias("m"))
    grid = most.where(F.col("m") >= width).select(F.explode(F.sequence(F.lit(1), F.floor(F.col("m") / width))).alias("k")).select((F.col("k") * width).alias("cost"))
    points = fact.where("value is not null").join(F.broadcast(cost), ["run", "step"]).select("run", "tag", "cost", "value")  # cost: a row a step
    probes = points.select("run", "tag").distinct().crossJoin(F.broadcast(grid))  # a grid of fixed width, not of rows
    found = interpolated(points, probes, ["run", "tag"], "cost", "value", bucket=16 * width)
    at = lambda r: F.max(F.when(F.col("run") == r, F.col("value")))
    return found.groupBy("tag", "cost").agg(at(one).alias("a"), at(two).alias("b")).where("a is not null or b is not null")


def lead_counts(aligned: DataFrame) -> DataFrame:
    """tag, n, a_leads, b_leads, mean_diff, least_diff, most_diff, first_cost, last_cost over the points that both runs have."""
    d = F.col("b") - F.col("a")
    return aligned.where("a is not null and b is not null").groupBy("tag").agg(
        F.count("*").alias("n"),
        F.count_if(d < 0).alias("a_leads"),
        F.count_if(d > 0).alias("b_leads"),
        F.avg(d).alias("mean_diff"),
        F.min(d).alias("least_diff"),
        F.max(d).alias("most_diff"),
        F.min("cost").alias("first_cost"),
        F.max("cost").alias("last_cost"),
    )


def hidden_pool(parts: DataFrame, total: DataFrame) -> DataFrame:
    """run, step, rate, common_rate, common_parts, all_rate, all_parts, hidden_rate, feasible, gap: what the parts leave for a pool that is not listed.

    parts: run, part, step, weight, rate; total: run, step, rate (of everything), hidden (the unlisted weight). The hidden
    rate solves rate (weight + hidden) = sum of weight times rate + hidden times hidden rate; it is feasible between 0 and
    1. The common rate is that of the parts that have a rate and weight at the run's first and last step; gap is its
    distance from the total's.
    """
    known = parts.where("rate is not null and weight > 0")
    ends = total.groupBy("run").agg(F.min("step").alias("first"), F.max("step").alias("last"))  # a row a run
    at_ends = known.join(F.broadcast(ends), "run").groupBy("run", "part").agg(F.count_if(F.col("step") == F.col("first")).alias("f"), F.count_if(F.col("step") == F.col("last")).alias("l"))
    common = at_ends.where("f > 0 and l > 0").select("run", "part", F.lit(True).alias("common"))
    rows = known.join(common, ["run", "part"], "left").withColumn("common", F.coalesce("common", F.lit(False)))
    in_common = lambda c: F.when(F.col("common"), c)
    product = F.col("weight") * F.col("rate")
    sums = rows.groupBy("run", "step").agg(
        F.sum(product).alias("num"), F.sum("weight").alias("den"), F.count("*").alias("all_parts"),
        F.try_divide(F.sum(in_common(product)), F.sum(in_common(F.col("weight")))).alias("common_rate"), F.count_if("common").alias("common_parts"),
    )
    found = total.select("run", "step", "rate", "hidden").join(sums, ["run", "step"], "left")
    hidden_rate = F.when(F.col("hidden") > 0, (F.col("rate") * (F.col("den") + F.col("hidden")) - F.col("num")) / F.col("hidden"))
    found = found.withColumn("hidden_rate", hidden_rate)
    return found.select(
        "run", "step", "rate", "common_rate", F.coalesce("common_parts", F.lit(0)).alias("common_parts"), F.try_divide("num", "den").alias("all_rate"), F.coalesce("all_parts", F.lit(0)).alias("all_parts"),
        "hidden_rate", F.col("hidden_rate").between(0, 1).alias("feasible"), (F.col("common_rate") - F.col("rate")).alias("gap"),
    )


def cut_diagnostics(z: DataFrame, cuts: DataFrame, axis: DataFrame, events: DataFrame, family: Column, around: int = 3) -> DataFrame:
    """run, step, shift, reversion, family, family_shift, family_share, event_t, event_gap: a row for each cut (run, step: a segment's first step).

    shift: length of the change of all series' means from the `around` steps before to those after; reversion: length of
    the change from there to the mean of all later steps, over the shift (0: the new level stays; NULL: no later steps).
    family: the one with the largest mean squared shift (family is a column of tag), family_share its share of the sum of
    squares over its share of the series. event: the one nearest to the cut's wall time, of equal ones the earlier.
    """
    place = axis.select("run", "step", "wall", F.row_number().over(Window.partitionBy("run").orderBy("step")).alias("pos"))  # a row a step
    where = cuts.select("run", F.col("step").alias("cut")).join(place.withColumnRenamed("step", "cut"), ["run", "cut"]).select("run", "cut", F.col("pos").alias("at"), "wall").where("at > 1")
    rows = z.join(F.broadcast(place.drop("wall")), ["run", "step"]).join(F.broadcast(where.drop("wall")), "run")
    mean = lambda low, high: F.avg(F.when((F.col("pos") >= low) & (F.col("pos") < high), F.col("z")))
    at, end = F.col("at"), F.col("at") + around
    one = rows.groupBy("run", "cut", "tag").agg(mean(at - around, at).alias("before"), mean(at, end).alias("after"), F.avg(F.when(F.col("pos") >= end, F.col("z"))).alias("rest"))
    one = one.withColumns({"d": (F.col("after") - F.col("before")) ** 2, "back": (F.col("rest") - F.col("after")) ** 2, "family": family})
    whole = one.groupBy("run", "cut").agg(F.sum("d").alias("d"), F.sum("back").alias("back"), F.count("*").alias("n"))
    parts = one.groupBy("run", "cut", "family").agg(F.avg("d").alias("mean_d"), F.sum("d").alias("sum_d"), F.count("*").alias("m"))
    top = parts.groupBy("run", "cut").agg(F.min_by(F.struct("family", "mean_d", "sum_d", "m"), F.struct(-F.round("mean_d", 9), "family")).alias("top"))
    probes = where.select("run", "cut", F.col("wall").alias("t"))
    times = events.select("run", F.col("t").alias("event"))
    near = as_of(as_of(probes, times, ["run"], "t", "event", ["event"]).withColumnRenamed("event", "e0"), times, ["run"], "t", "event", ["event"], backward=False)
    closer = F.when(F.col("event").isNull() | (F.col("t") - F.col("e0") <= F.col("event") - F.col("t")), F.col("e0")).otherwise(F.col("event"))
    near = near.withColumn("event_t", closer).select("run", "cut", "event_t", F.abs(F.col("event_t") - F.col("t")).alias("event_gap"))
    found = whole.join(top, ["run", "cut"]).join(near, ["run", "cut"], "left")
    shift = F.sqrt("d")
    return found.select(
        "run", F.col("cut").alias("step"), shift.alias("shift"), F.try_divide(F.sqrt("back"), shift).alias("reversion"), F.col("top.family").alias("family"), F.col("top.mean_d").alias("family_shift"),
        F.try_divide(F.try_divide(F.col("top.sum_d"), F.col("d")), F.col("top.m") / F.col("n")).alias("family_share"), "event_t", "event_gap",
    )
