"""Operators that describe one series by a row: gaps, shape, noise around the trend, and its possible splits."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .association import pearson, theil_sen, trend, with_anchor
from .sequence import SERIES, along, with_difference


def profile(fact: DataFrame, key: tuple[str, ...] = SERIES) -> DataFrame:
    """key, steps, present, leading, trailing, interior (missing rows by place), kind, factor (largest change by a factor)."""
    w = along(key)
    ranked = fact.withColumn("_i", F.row_number().over(w).cast("long")).withColumn("_before", F.lag("value").over(w))
    at = F.when(F.col("value").isNotNull(), F.col("_i"))
    moved = (F.col("value") != 0) & (F.col("_before") != 0)
    factor = F.when(moved, F.greatest(F.abs(F.try_divide("value", "_before")), F.abs(F.try_divide("_before", "value"))))
    s = ranked.groupBy(*key).agg(
        F.count("*").alias("steps"), F.count("value").alias("present"), F.min(at).alias("_lo"), F.max(at).alias("_hi"), F.count_distinct("value").alias("_kinds"), F.max(factor).alias("factor")
    )
    kind = F.when(F.col("_kinds") == 0, "empty").when(F.col("_kinds") == 1, "constant").when(F.col("_kinds") == 2, "two-valued").otherwise("varying")
    zero = F.lit(0).cast("long")
    return s.select(
        *key,
        "steps",
        "present",
        F.coalesce(F.col("_lo") - 1, "steps").alias("leading"),
        F.coalesce(F.col("steps") - F.col("_hi"), zero).alias("trailing"),
        F.coalesce(F.col("_hi") - F.col("_lo") + 1 - F.col("present"), zero).alias("interior"),
        kind.alias("kind"),
        "factor",
    )


def partial_given_step(fact: DataFrame, anchor: DataFrame, least: int = 6) -> DataFrame:
    """run, tag, n, r: correlation with the anchor of what the step does not explain; NULL for fewer than `least` pairs."""
    pairs = with_anchor(fact, anchor).withColumn("s", F.col("step").cast("double"))
    c = pairs.groupBy("run", "tag").agg(F.count("*").alias("n"), pearson("x", "y", least).alias("xy"), pearson("x", "s", least).alias("xs"), pearson("y", "s", least).alias("ys"))
    rest = F.sqrt(F.greatest((1 - F.col("xs") * F.col("xs")) * (1 - F.col("ys") * F.col("ys")), F.lit(0.0)))
    return c.select("run", "tag", "n", F.try_divide(F.col("xy") - F.col("xs") * F.col("ys"), rest).alias("r"))


def detectable_change(rows: DataFrame, key: list[str]) -> DataFrame:
    """key, n, sigma, mde, beyond: noise around the Theil-Sen line (scaled MAD), the least change between two steps that
    stands out of it at 95 %, and how many changes from the row before do."""
    present = rows.where("value is not null")
    left = present.join(theil_sen(present, key), key).withColumn("_e", F.col("value") - F.col("intercept") - F.col("slope") * F.col("step"))
    middle = F.median("_e").over(Window.partitionBy(*key))
    w = Window.partitionBy(*key).orderBy("step")
    left = left.withColumn("_off", F.abs(F.col("_e") - middle)).withColumn("_move", F.abs(F.col("value") - F.lag("value").over(w)))
    s = left.groupBy(*key).agg(F.count("*").alias("n"), (F.median("_off") * 1.4826).alias("sigma"), F.collect_list("_move").alias("_moves"))
    mde = F.col("sigma") * (1.96 * math.sqrt(2))
    return s.select(*key, "n", "sigma", mde.alias("mde"), F.size(F.filter("_moves", lambda x: x > mde)).cast("long").alias("beyond"))


def recent_trend(fact: DataFrame, last: int, quantile: float, key: tuple[str, ...] = SERIES) -> DataFrame:
    """key, slope, low, high: the trend of the last `last` present values; quantile: of Student's t for last - 2."""
    newest = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("step")))
    recent = fact.where("value is not null").withColumn("_new", newest).where(F.col("_new") <= last)
    t = trend(key, recent).where(F.col("n") == last)
    return t.select(*key, "slope", (F.col("slope") - quantile * F.col("se")).alias("low"), (F.col("slope") + quantile * F.col("se")).alias("high"))


def shape(fact: DataFrame, key: tuple[str, ...] = SERIES, least: int = 8) -> DataFrame:
    """key, n, r2 of the straight line, jump (the largest change as a share of the range), for series of `least` values or more."""
    jumps = with_difference(fact, key).groupBy(*key).agg(F.try_divide(F.max(F.abs("delta")), F.max("value") - F.min("value")).alias("jump"))
    return trend(key, fact).where(F.col("n") >= least).join(jumps, list(key)).select(*key, "n", "r2", "jump")


def split_profile(fact: DataFrame, key: tuple[str, ...] = SERIES, least: int = 3) -> DataFrame:
    """key, step, gain: by how much two means, parted after the step, lower the squared error; `least` values on each side."""
    every, w = Window.partitionBy(*key), along(key)
    p = fact.where("value is not null").select(
        *key, "step", F.row_number().over(w).alias("_k"), F.count("*").over(every).alias("_n"), F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_s"), F.sum("value").over(every).alias("_t")
    )
    inside = p.where((F.col("_k") >= least) & (F.col("_k") <= F.col("_n") - least))
    gap = F.col("_s") / F.col("_k") - (F.col("_t") - F.col("_s")) / (F.col("_n") - F.col("_k"))
    return inside.select(*key, "step", (gap * gap * F.col("_k") * (F.col("_n") - F.col("_k")) / F.col("_n")).alias("gain"))
