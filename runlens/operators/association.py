"""Correlation and regression over long tables. Pairs with a missing side never count; too few pairs or no spread give NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.functions.distributions import fisher_interval, t_quantile_975, t_test_p

from .sequence import along, with_average_rank


def pearson(x: str, y: str, least: int = 3) -> Column:
    """Correlation as an aggregate; NULL for fewer than `least` pairs or a constant side (where corr() would fail)."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    return F.when(F.count_if(both) >= least, F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def spearman(pairs: DataFrame, key: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """key, n, rho: rank correlation of the pairs of each group; ranks are over the pairs that count."""
    both = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = with_average_rank(with_average_rank(both, tuple(key), x, "_rx"), tuple(key), y, "_ry")
    return ranked.groupBy(*key).agg(F.count("*").alias("n"), pearson("_rx", "_ry").alias("rho"))


def with_anchor(fact: DataFrame, anchor: DataFrame) -> DataFrame:
    """run, tag, step, x, y: each series (y) beside the anchor's value (x) at every common step. anchor: run, step, value."""
    a = anchor.where("value is not null").select("run", "step", F.col("value").alias("x"))
    return fact.where("value is not null").select("run", "tag", "step", F.col("value").alias("y")).join(a, ["run", "step"])


def correlation_record(pairs: DataFrame, key: list[str], least: int = 3) -> DataFrame:
    """key, n, r, low, high, n_diff, r_diff: each group's correlation of x and y over steps, with Fisher's limits, and that of their changes.

    pairs: key, step, x, y. Changes are from the step before, without bridging gaps. Groups of fewer than `least` pairs
    are left out; limits are NULL for fewer than 4 pairs or |r| = 1.
    """
    w = Window.partitionBy(*key).orderBy("step")
    near = F.lag("step").over(w) == F.col("step") - 1
    both = pairs.where("x is not null and y is not null")
    d = both.withColumns({c: F.when(near, F.col(v) - F.lag(v).over(w)) for c, v in (("dx", "x"), ("dy", "y"))})
    found = d.groupBy(*key).agg(F.count("*").alias("n"), pearson("x", "y").alias("r"), F.count("dx").alias("n_diff"), pearson("dx", "dy").alias("r_diff")).where(F.col("n") >= least)
    low, high = fisher_interval(F.col("r"), F.col("n"))
    return found.withColumns({"low": low, "high": high})


def trend(key: tuple[str, ...], rows: DataFrame, x: str = "step", y: str = "value") -> DataFrame:
    """key, n, slope, intercept, r2, se, t: least squares; NULL for fewer than 3 points or a constant x."""
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*key, F.col(x).cast("double").alias("_x"), F.col(y).alias("_y"))
    s = both.groupBy(*key).agg(
        F.count("*").alias("n"), F.avg("_x").alias("mx"), F.avg("_y").alias("my"), F.regr_sxx("_y", "_x").alias("sxx"), F.regr_syy("_y", "_x").alias("syy"), F.regr_sxy("_y", "_x").alias("sxy")
    )
    slope = F.when(F.col("n") >= 3, F.try_divide("sxy", "sxx"))
    s = s.withColumn("slope", slope).withColumn("intercept", F.col("my") - F.col("slope") * F.col("mx"))
    s = s.withColumn("_rss", F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0)))
    s = s.withColumn("r2", 1 - F.try_divide("_rss", "syy")).withColumn("se", F.sqrt(F.try_divide(F.try_divide("_rss", F.nullif(F.col("n") - 2, F.lit(0))), F.col("sxx"))))
    return s.select(*key, "n", "slope", "intercept", "r2", "se", F.try_divide("slope", "se").alias("t"))


def trend_test(key: tuple[str, ...], rows: DataFrame, x: str = "step", y: str = "value") -> DataFrame:
    """trend() with r (the slope in standard deviations of x and y), p (two-sided, by Student's t), low and high (95 % limits of the slope).

    t and p are NULL where the points lie on a line without error; r also where they are level.
    """
    t = trend(key, rows, x, y)
    df = (F.col("n") - 2).cast("double")
    half = t_quantile_975(df) * F.col("se")
    return t.withColumns({"r": F.signum("slope") * F.sqrt("r2"), "p": t_test_p("t", df), "low": F.col("slope") - half, "high": F.col("slope") + half})


def residuals(rows: DataFrame, key: tuple[str, ...], x: str = "step", y: str = "value", name: str = "residual") -> DataFrame:
    """Adds what the group's straight line over x leaves."""
    w = Window.partitionBy(*key)
    both = F.col(y).isNotNull() & F.col(x).isNotNull()
    a, b = F.when(both, F.col(x).cast("double")), F.when(both, F.col(y))
    slope = F.try_divide(F.covar_pop(a, b).over(w), F.var_pop(a).over(w))
    return rows.withColumn(name, F.col(y) - (F.avg(b).over(w) + slope * (F.col(x) - F.avg(a).over(w))))


def theil_sen(rows: DataFrame, key: list[str], x: str = "step", y: str = "value") -> DataFrame:
    """key, slope, intercept: the median slope of all pairs of a series' points, and the median offset from it.

    Pairs are formed within a series, whose length the step axis bounds.
    """
    p = rows.where(F.col(y).isNotNull()).select(*key, F.col(x).alias("x1"), F.col(y).alias("y1"))
    q = p.toDF(*key, "x2", "y2")
    slopes = p.join(q, key).where("x1 < x2").groupBy(*key).agg(F.median((F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1"))).alias("slope"))
    return p.join(slopes, key).groupBy(*key).agg(F.first("slope").alias("slope"), F.median(F.col("y1") - F.col("slope") * F.col("x1")).alias("intercept"))


def newey_west(rows: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """key, n, lags, slope, se: the trend's standard error that allows for correlated residuals (Bartlett weights)."""
    present = rows.where("value is not null").withColumn("step", F.col("step").cast("double"))
    r = residuals(present, key)
    w = Window.partitionBy(*key)
    scored = r.withColumn("u", F.col("residual") * (F.col("step") - F.avg("step").over(w))).withColumn("n", F.count("*").over(w))
    scored = scored.withColumn("i", F.row_number().over(along(key))).withColumn("lags", F.greatest(F.lit(1), F.floor(4 * F.pow(F.col("n") / 100, F.lit(2 / 9)))).cast("int"))
    past = F.collect_list("u").over(along(key).rowsBetween(Window.unboundedPreceding, -1))
    weight = lambda u, k: u * (1 - k / (F.col("lags") + 1))
    recent = F.aggregate(F.transform(F.slice(F.reverse(past), F.lit(1), F.col("lags")), lambda u, k: weight(u, k + 1)), F.lit(0.0), lambda a, b: a + b)
    s = scored.withColumn("cross", F.col("u") * recent).groupBy(*key).agg(F.first("n").alias("n"), F.first("lags").alias("lags"), F.sum(F.col("u") * F.col("u")).alias("own"), F.sum("cross").alias("cross"))
    line = trend(key, present).select(*key, "slope")
    sxx = present.groupBy(*key).agg((F.var_pop("step") * F.count("*")).alias("sxx"))
    joined = s.join(line, list(key)).join(sxx, list(key))
    return joined.select(*key, "n", "lags", "slope", F.try_divide(F.sqrt(F.greatest(F.col("own") + 2 * F.col("cross"), F.lit(0.0))), "sxx").alias("se"))


def lag_one(rows: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """key, n, rho, n_effective: lag-1 autocorrelation of present values in order, and the sample size it leaves."""
    w = Window.partitionBy(*key)
    d = rows.where("value is not null").withColumn("d", F.col("value") - F.avg("value").over(w))
    d = d.withColumn("before", F.lag("d").over(along(key)))
    s = d.groupBy(*key).agg(F.count("*").alias("n"), F.try_divide(F.sum(F.col("d") * F.col("before")), F.sum(F.col("d") * F.col("d"))).alias("rho"))
    r = F.greatest(F.lit(-0.99), F.least(F.lit(0.99), F.col("rho")))
    return s.withColumn("n_effective", F.least(F.col("n").cast("double"), F.col("n") * (1 - r) / (1 + r)))


def without_leverage(rows: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """key, n, slope: the trend without the point whose step is farthest from the mean (ties: the first)."""
    distance = F.abs(F.col("step") - F.avg("step").over(Window.partitionBy(*key)))
    ranked = rows.withColumn("_d", distance).withColumn("_far", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("_d"), "step")))
    return trend(key, ranked.where("_far > 1")).select(*key, "n", "slope")


def quadratic(rows: DataFrame, key: list[str], x: str, y: str) -> DataFrame:
    """key, n, curve: the quadratic coefficient of a least-squares parabola, from moments around the mean of x."""
    centre = F.avg(x).over(Window.partitionBy(*key))
    c = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_x", F.col(x) - centre).withColumn("_y", F.col(y))
    p = lambda k: F.pow("_x", F.lit(k))
    s = c.groupBy(*key).agg(
        F.count("*").alias("n"), F.sum("_x").alias("s1"), F.sum(p(2)).alias("s2"), F.sum(p(3)).alias("s3"), F.sum(p(4)).alias("s4"), F.sum("_y").alias("t0"), F.sum(F.col("_x") * F.col("_y")).alias("t1"), F.sum(p(2) * F.col("_y")).alias("t2")
    )
    n, s1, s2, s3, s4, t0, t1, t2 = (F.col(k) for k in ("n", "s1", "s2", "s3", "s4", "t0", "t1", "t2"))
    det = n * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2)
    top = n * (s2 * t2 - s3 * t1) - s1 * (s1 * t2 - s2 * t1) + t0 * (s1 * s3 - s2 * s2)
    return s.select(*key, "n", F.try_divide(top, det).alias("curve"))
