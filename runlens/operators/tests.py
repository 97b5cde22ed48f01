"""Hypothesis tests and resampling over long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.functions.distributions import two_sided_normal_p

from .sequence import with_average_rank


def mann_whitney(rows: DataFrame, key: list[str], group: str, value: str) -> DataFrame:
    """key, n1, n0, u, z, p, biserial: do values of group true rank above those of false? Tie-corrected, normal p."""
    ranked = with_average_rank(rows.where(F.col(value).isNotNull()), tuple(key), value, "_rank")
    ties = ranked.groupBy(*key, value).agg(F.count("*").alias("t")).groupBy(*key).agg(F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("_ties"))
    g = F.col(group)
    s = ranked.groupBy(*key).agg(F.count_if(g).alias("n1"), F.count_if(~g).alias("n0"), F.sum(F.when(g, F.col("_rank"))).alias("_sum")).join(ties, key)
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    n = n1 + n0
    s = s.withColumn("u", F.col("_sum") - n1 * (n1 + 1) / 2)
    variance = n1 * n0 / 12 * ((n + 1) - F.try_divide("_ties", n * (n - 1)))
    s = s.withColumn("z", F.try_divide(F.col("u") - n1 * n0 / 2, F.sqrt(F.greatest(variance, F.lit(0.0)))))
    return s.select(*key, "n1", "n0", "u", "z", two_sided_normal_p(F.col("z")).alias("p"), (2 * F.try_divide("u", n1 * n0) - 1).alias("biserial"))


def cliffs_delta(rows: DataFrame, key: list[str], group: str, value: str) -> DataFrame:
    """key, delta: P(true above false) - P(below), from ranks instead of all pairs."""
    m = mann_whitney(rows, key, group, value)
    return m.select(*key, F.col("biserial").alias("delta"))


def welch(rows: DataFrame, key: list[str], group: str, value: str) -> DataFrame:
    """key, n1, n0, gap, t, df: difference of means without equal variances."""
    g, v = F.col(group), F.col(value)
    s = rows.groupBy(*key).agg(
        *(f(F.when(c, v)).alias(f"{name}{k}") for k, c in ((1, g), (0, ~g)) for name, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp)))
    )
    a, b = F.try_divide("v1", "n1"), F.try_divide("v0", "n0")
    df = F.try_divide(F.pow(a + b, F.lit(2)), F.try_divide(a * a, F.col("n1") - 1) + F.try_divide(b * b, F.col("n0") - 1))
    return s.select(*key, "n1", "n0", (F.col("m1") - F.col("m0")).alias("gap"), F.try_divide(F.col("m1") - F.col("m0"), F.sqrt(a + b)).alias("t"), df.alias("df"))


def sign_test_p(wins: Column, n: Column) -> Column:
    """Exact two-sided binomial p of `wins` of n fair draws."""
    k = F.least(wins, n - wins).cast("int")
    # ln C(n, i) as a running sum; n is the number of untied pairs of one series.
    term = lambda i: F.aggregate(F.sequence(F.lit(1), F.greatest(i, F.lit(1))), F.lit(0.0), lambda a, j: a + F.when(j <= i, F.ln((n - j + 1).cast("double")) - F.ln(j.cast("double"))).otherwise(0.0))
    tail = F.aggregate(F.sequence(F.lit(0), k), F.lit(0.0), lambda a, i: a + F.exp(term(i) - n * F.ln(F.lit(2.0))))
    return F.when(n > 0, F.least(F.lit(1.0), 2 * tail))


def holm(rows: DataFrame, key: list[str], p: str, alpha: float = 0.05) -> DataFrame:
    """Adds holm (rejected by the step-down rule) and hochberg (by the step-up rule), per group of tests.

    Step-down stops at the first p above alpha / (m - rank + 1); step-up rejects up to the last p at or below it.
    """
    w = Window.partitionBy(*key) if key else Window.partitionBy(F.lit(1))
    order = w.orderBy(p)
    r = rows.where(F.col(p).isNotNull()).withColumn("_rank", F.row_number().over(order)).withColumn("_m", F.count("*").over(w))
    r = r.withColumn("_ok", F.col(p) <= alpha / (F.col("_m") - F.col("_rank") + 1))
    r = r.withColumn("_stop", F.min(F.when(~F.col("_ok"), F.col("_rank"))).over(w)).withColumn("_last", F.max(F.when(F.col("_ok"), F.col("_rank"))).over(w))
    return r.withColumn("holm", F.col("_stop").isNull() | (F.col("_rank") < F.col("_stop"))).withColumn("hochberg", F.coalesce(F.col("_rank") <= F.col("_last"), F.lit(False))).drop("_rank", "_m", "_ok", "_stop", "_last")


def _draw(seed: int, *parts: Column) -> Column:
    """A fraction in [0, 1) that depends on seed and parts alone, not on the order of rows."""
    return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1 << 40)) / float(1 << 40)


def bootstrap_mean(rows: DataFrame, key: list[str], value: str, replicates: int = 200, seed: int = 1) -> DataFrame:
    """key, low, mid, high: percentiles 2.5, 50 and 97.5 of resampled means. Draws come from hashes of (seed, key, replicate, place).

    A series is held as one array, and each replicate draws from it by place, so no rows are joined.
    """
    arrays = rows.where(F.col(value).isNotNull()).groupBy(*key).agg(F.array_sort(F.collect_list(value)).alias("_v"))
    each = arrays.withColumn("_b", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    n = F.size("_v")
    keys = [F.col(k) for k in key]
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda a, i: a + F.get("_v", F.floor(_draw(seed, *keys, F.col("_b"), i) * n).cast("int")))
    means = each.withColumn("_mean", total / n)
    return means.groupBy(*key).agg(*(F.percentile("_mean", q).alias(c) for q, c in ((0.025, "low"), (0.5, "mid"), (0.975, "high"))))


def sign_flip_p(differences: DataFrame, key: list[str], value: str, replicates: int = 400, seed: int = 2) -> DataFrame:
    """key, observed, p: how often random signs give a mean at least as far from 0; p = (c + 1) / (B + 1)."""
    arrays = differences.where(F.col(value).isNotNull()).groupBy(*key).agg(F.array_sort(F.collect_list(value)).alias("_v"))
    arrays = arrays.withColumn("observed", F.aggregate("_v", F.lit(0.0), lambda a, x: a + x) / F.size("_v"))
    each = arrays.withColumn("_b", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    keys = [F.col(k) for k in key]
    flipped = F.aggregate(F.transform("_v", lambda x, i: F.when(_draw(seed, *keys, F.col("_b"), i) < 0.5, x).otherwise(-x)), F.lit(0.0), lambda a, x: a + x) / F.size("_v")
    c = each.withColumn("_far", F.abs(flipped) >= F.abs("observed") - 1e-12).groupBy(*key).agg(F.first("observed").alias("observed"), F.count_if("_far").alias("_c"))
    return c.select(*key, "observed", ((F.col("_c") + 1) / (replicates + 1)).alias("p"))
