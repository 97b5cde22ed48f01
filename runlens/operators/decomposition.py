"""Decompositions of rates, time and cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cost(rate_per_second: float, start: float, at: Column, ended_at: Column | None = None) -> Column:
    """Rate times the time since start, never below 0; a run that has ended costs no more."""
    until = F.least(at, ended_at) if ended_at is not None else at
    return F.greatest(F.lit(0.0), until - start) * rate_per_second


def shares(rows: DataFrame, key: list[str], order: str, part: str, amount: str) -> DataFrame:
    """Adds share (of the key's total at each `order`) and change (from the part's share one before)."""
    whole = F.sum(amount).over(Window.partitionBy(*key, order))
    out = rows.withColumn("share", F.try_divide(F.col(amount), whole))
    w = Window.partitionBy(*key, part).orderBy(order)
    return out.withColumn("change", F.when(F.lag(order).over(w) == F.col(order) - 1, F.col("share") - F.lag("share").over(w)))


def shift_share(before: DataFrame, after: DataFrame, part: str) -> DataFrame:
    """within, mix, interaction, total: why a weighted mean rate changed between two periods.

    before, after: part, weight, rate; parts that either lacks do not count. within: rates changed at the old mix; mix:
    the mix changed at the old rates; interaction: both. The three add up to the change of the mean.
    """
    def shared(df: DataFrame, tag: str) -> DataFrame:
        return df.where("weight > 0 and rate is not null").select(part, F.col("weight").alias(f"w{tag}"), F.col("rate").alias(f"r{tag}"))

    both = shared(before, "0").join(shared(after, "1"), part)
    whole = both.agg(F.sum("w0").alias("_s0"), F.sum("w1").alias("_s1"))
    s0, s1 = F.col("w0") / whole.select("_s0").scalar(), F.col("w1") / whole.select("_s1").scalar()
    out = both.select((s0 * (F.col("r1") - F.col("r0"))).alias("a"), ((s1 - s0) * F.col("r0")).alias("b"), ((s1 - s0) * (F.col("r1") - F.col("r0"))).alias("c"), (s1 * F.col("r1") - s0 * F.col("r0")).alias("d"))
    return out.agg(F.sum("a").alias("within"), F.sum("b").alias("mix"), F.sum("c").alias("interaction"), F.sum("d").alias("total"), F.count("*").alias("parts"))


def shift_shares(panel: DataFrame, part: str, width: int) -> DataFrame:
    """step, within, mix, interaction, paasche, total, parts, left_out: shift_share of every step and the one `width` later.

    paasche: rates changed at the new mix (within + interaction). left_out: parts with a row at either step that lack a
    rate or a positive weight at one of them. Steps without any row `width` later have no row; all but the counts are
    NULL where no part is left.
    """
    rows = panel.select(part, "step", "weight", "rate", ((F.col("weight") > 0) & F.col("rate").isNotNull()).alias("ok"))
    before = rows.select(part, "step", *(F.col(c).alias(f"{c}0") for c in ("weight", "rate", "ok")))
    after = rows.select(part, (F.col("step") - width).alias("step"), *(F.col(c).alias(f"{c}1") for c in ("weight", "rate", "ok")))
    both = before.join(after, [part, "step"], "full").withColumn("ok", F.coalesce(F.col("ok0") & F.col("ok1"), F.lit(False)))
    w0, w1, r0, r1 = (F.when(F.col("ok"), F.col(c)) for c in ("weight0", "weight1", "rate0", "rate1"))
    mean = lambda w, r: F.try_divide(F.sum(w * r), F.sum(w))
    s = both.groupBy("step").agg(
        mean(w0, r0).alias("m00"), mean(w0, r1).alias("m01"), mean(w1, r0).alias("m10"), mean(w1, r1).alias("m11"),
        F.count_if("ok").alias("parts"), F.count_if(~F.col("ok")).alias("left_out"), F.count("ok0").alias("_n0"), F.count("ok1").alias("_n1"),
    ).where("_n0 > 0 and _n1 > 0")
    within, paasche, m = F.col("m01") - F.col("m00"), F.col("m11") - F.col("m10"), F.col("m10") - F.col("m00")
    return s.select("step", within.alias("within"), m.alias("mix"), (paasche - within).alias("interaction"), paasche.alias("paasche"), (F.col("m11") - F.col("m00")).alias("total"), "parts", "left_out")


def fixed_weight_curve(panel: DataFrame, part: str, base_steps: int) -> DataFrame:
    """step, actual, fixed: the weighted mean rate, and that at each part's mean weight in the first `base_steps` steps."""
    ok = panel.where("weight > 0 and rate is not null")
    base = ok.where(F.col("step") <= base_steps).groupBy(part).agg(F.avg("weight").alias("_base"))
    return ok.join(base, part).groupBy("step").agg(
        F.try_divide(F.sum(F.col("weight") * F.col("rate")), F.sum("weight")).alias("actual"), F.try_divide(F.sum(F.col("_base") * F.col("rate")), F.sum("_base")).alias("fixed")
    )


def classified(trends: DataFrame, critical: float = 2.0, small: float = 1e-4) -> DataFrame:
    """Adds verdict by slope and t of operators.association.trend: learned, regressing, slow, stagnant."""
    clear = F.abs("t") >= critical
    verdict = F.when(clear & (F.col("slope") > 0), "learned").when(clear & (F.col("slope") < 0), "regressing").when(F.abs("slope") >= small, "slow").otherwise("stagnant")
    return trends.withColumn("verdict", F.when(F.col("slope").isNotNull(), verdict))


def standing(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """Adds z and place (1: highest) of each row within its key."""
    w = Window.partitionBy(*key)
    z = F.try_divide(F.col(value) - F.avg(value).over(w), F.stddev_samp(value).over(w))
    return rows.withColumn("z", z).withColumn("place", F.rank().over(w.orderBy(F.desc(value))))


def time_ledger(axis: DataFrame, reported: DataFrame, rate_per_second: float) -> DataFrame:
    """run, step, real, reported, gap, gap_share, cost: wall time of each step against the seconds it reports."""
    real = F.col("wall") - F.lag("wall").over(Window.partitionBy("run").orderBy("step"))
    rows = axis.withColumn("real", real).join(reported.select("run", "step", "reported"), ["run", "step"], "left")
    gap = F.col("real") - F.col("reported")
    return rows.select("run", "step", "real", "reported", gap.alias("gap"), F.try_divide(gap, F.col("real")).alias("gap_share"), (F.col("real") * rate_per_second).alias("cost"))


def intervals(events: DataFrame, key: str, t: str) -> DataFrame:
    """key, n, mtbf, shortest, longest: gaps between consecutive events."""
    gap = F.col(t) - F.lag(t).over(Window.partitionBy(key).orderBy(t))
    return events.withColumn("_gap", gap).groupBy(key).agg(F.count("*").alias("n"), F.avg("_gap").alias("mtbf"), F.min("_gap").alias("shortest"), F.max("_gap").alias("longest"))
