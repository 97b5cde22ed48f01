"""Unusual steps, co-moving metrics, breakpoints and identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.functions.paths import CODE_FAMILIES, family

from .association import pearson, spearman, with_anchor
from .sequence import along, with_difference

MAD_SCALE = 1.4826


def step_anomaly(fact: DataFrame, step: int, least: int = 5) -> DataFrame:
    """run, tag, n, value, prev, delta, pct, z, zr, score of every series with a value at `step`.

    delta is the change from the last value before; z measures it by mean and spread of all single-step changes, zr by
    their median and scaled MAD, both with `least` changes or more. score is the smaller of |z| and |zr|: unusual by
    both counts.
    """
    d = with_difference(fact)
    moments = d.groupBy("run", "tag").agg(
        F.count("value").alias("n"), F.count("delta").alias("_nd"), F.avg("delta").alias("_mean"), F.stddev_samp("delta").alias("_sd"), F.median("delta").alias("_mid"),
        F.max(F.when(F.col("step") == step, F.col("value"))).alias("value"),
        F.max_by("value", F.when((F.col("step") < step) & F.col("value").isNotNull(), F.col("step"))).alias("prev"),
    )
    here = moments.where("value is not null")
    mad = d.where("delta is not null").join(here.select("run", "tag", "_mid"), ["run", "tag"]).groupBy("run", "tag").agg((F.median(F.abs(F.col("delta") - F.col("_mid"))) * MAD_SCALE).alias("_mad"))
    delta = F.col("value") - F.col("prev")
    enough = F.col("_nd") >= least
    z = F.when(enough & (F.col("_sd") > 0), (delta - F.col("_mean")) / F.col("_sd"))
    zr = F.when(enough & (F.col("_mad") > 0), (delta - F.col("_mid")) / F.col("_mad"))
    out = here.join(mad, ["run", "tag"], "left").select("run", "tag", "n", "value", "prev", delta.alias("delta"), F.try_divide(delta, F.col("prev")).alias("pct"), z.alias("z"), zr.alias("zr"))
    return out.withColumn("score", F.when(F.col("z").isNotNull() & F.col("zr").isNotNull(), F.least(F.abs("z"), F.abs("zr"))).otherwise(F.abs(F.coalesce("z", "zr"))))


def movers(fact: DataFrame, step: int, top: int = 12, least: int = 5, folded: Column | None = None) -> DataFrame:
    """The `top` families of each run with the most unusual change at `step`, by their most unusual member."""
    scored = step_anomaly(fact, step, least).where((F.col("n") >= least) & F.col("score").isNotNull()).withColumn("family", folded if folded is not None else family(F.col("tag"), CODE_FAMILIES))
    best = F.min_by(F.struct("tag", "value", "prev", "delta", "pct", "z", "zr", "score"), F.struct(-F.col("score"), "tag"))
    families = scored.groupBy("run", "family").agg(best.alias("b"), F.count("*").alias("member_count")).select("run", "family", "b.*", "member_count")
    rank = F.row_number().over(Window.partitionBy("run").orderBy(F.desc("score"), "family"))
    return families.withColumn("rank", rank).where(F.col("rank") <= top)


def correlation_panel(fact: DataFrame, anchor: str, top: int = 12, least: int = 8, folded: Column | None = None) -> DataFrame:
    """The `top` families of each run whose member follows the anchor metric most closely by rank correlation.

    d_spearman, over single-step changes, is for information only.
    """
    is_anchor = F.col("tag") == anchor
    levels = with_anchor(fact.where(~is_anchor), fact.where(is_anchor))
    changes = with_difference(fact).drop("value").withColumnRenamed("delta", "value")
    moved = with_anchor(changes.where(~is_anchor), changes.where(is_anchor))
    linear = levels.groupBy("run", "tag").agg(F.count("*").alias("n"), pearson("x", "y").alias("pearson")).where(F.col("n") >= least)
    ranks = spearman(levels, ["run", "tag"]).select("run", "tag", F.col("rho").alias("spearman"))
    diffs = spearman(moved, ["run", "tag"]).select("run", "tag", F.when(F.col("n") >= least, F.col("rho")).alias("d_spearman"), F.col("n").alias("n_diff"))
    rows = linear.join(ranks, ["run", "tag"]).join(diffs, ["run", "tag"], "left").where("pearson is not null or spearman is not null")
    rows = rows.withColumn("strength", F.abs(F.coalesce("spearman", "pearson"))).withColumn("family", folded if folded is not None else family(F.col("tag"), CODE_FAMILIES))
    best = F.min_by(F.struct("tag", "n", "pearson", "spearman", "d_spearman", "n_diff", "strength"), F.struct(-F.round("strength", 9), "tag"))
    families = rows.groupBy("run", "family").agg(best.alias("b"), F.count("*").alias("member_count")).select("run", "family", "b.*", "member_count")
    rank = F.row_number().over(Window.partitionBy("run").orderBy(F.desc(F.round("strength", 9)), "family"))
    return families.withColumn("rank", rank).where(F.col("rank") <= top)


def breakpoints(fact: DataFrame, times: float = 8.0, share: float = 0.05) -> DataFrame:
    """run, tag, step, delta, score: changes of over `times` the typical size and over `share` of the value before.

    The typical size is the scaled MAD of the changes, or where that is 0 the median absolute change.
    """
    d = with_difference(fact).withColumn("before", F.lag("value").over(along())).where("delta is not null")
    mid = d.groupBy("run", "tag").agg(F.median("delta").alias("mid"), F.median(F.abs("delta")).alias("typical"))
    mad = d.join(mid, ["run", "tag"]).groupBy("run", "tag").agg((F.median(F.abs(F.col("delta") - F.col("mid"))) * MAD_SCALE).alias("mad"), F.first("typical").alias("typical"))
    scale = F.when(F.col("mad") > 0, F.col("mad")).otherwise(F.nullif("typical", F.lit(0.0)))
    scored = d.join(mad, ["run", "tag"]).withColumn("score", F.try_divide(F.abs("delta"), scale))
    return scored.where((F.col("score") > times) & (F.abs("delta") > share * F.abs("before"))).select("run", "tag", "step", "delta", "score")


def pairwise_identities(fact: DataFrame, overlap: int = 6) -> DataFrame:
    """run, x, y, n, kind of pairs of series that are identical, affine, nearly affine or closely correlated.

    Residuals of the fitted line, as a share of y's range: 1e-9 affine, 1e-4 near; |r| of .999 or more correlated.
    Series pair up within a run at equal steps; equal series first fold into one, so copies do not multiply pairs.
    """
    present = fact.where("value is not null")
    shape = F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("step", "value")))), 256)
    shapes = present.groupBy("run", "tag").agg(shape.alias("shape"), F.count("*").alias("n"))
    reps = shapes.groupBy("run", "shape").agg(F.min("tag").alias("rep"))
    named = shapes.join(reps, ["run", "shape"])
    copies = named.where((F.col("tag") != F.col("rep")) & (F.col("n") >= overlap)).select("run", F.col("rep").alias("x"), F.col("tag").alias("y"), "n", F.lit("identical").alias("kind"))
    distinct = present.join(reps.select("run", F.col("rep").alias("tag")), ["run", "tag"], "left_semi")
    a, b = (distinct.select("run", "step", F.col("tag").alias(t), F.col("value").alias(f"v{t}")) for t in ("x", "y"))
    met = a.join(b, ["run", "step"]).where("x < y")
    fits = met.groupBy("run", "x", "y").agg(
        F.count("*").alias("n"), pearson("vx", "vy").alias("r"), F.regr_slope("vy", "vx").alias("slope"), F.regr_intercept("vy", "vx").alias("intercept"), (F.max("vy") - F.min("vy")).alias("range"),
        F.max(F.abs(F.col("vx") - F.col("vy"))).alias("apart"),
    ).where((F.col("n") >= overlap) & (F.abs("r") >= 0.999))
    worst = met.join(fits, ["run", "x", "y"]).groupBy("run", "x", "y").agg(F.max(F.abs(F.col("vy") - F.col("intercept") - F.col("slope") * F.col("vx"))).alias("worst"))
    off = F.try_divide("worst", "range")
    kind = F.when(F.col("apart") == 0, "identical").when(off <= 1e-9, "affine").when(off <= 1e-4, "near").otherwise("correlated")
    return fits.join(worst, ["run", "x", "y"]).select("run", "x", "y", "n", kind.alias("kind")).unionByName(copies)


def identity_check(rows: DataFrame, key: list[str], left: Column, right: Column, exact: float = 1e-9, near: float = 1e-3) -> DataFrame:
    """key, n, worst, worst_step, verdict: does left equal right at every step? exact, near, broken or not comparable."""
    off = F.abs(left - right) / F.greatest(F.abs(left), F.abs(right), F.lit(1e-12))
    s = rows.withColumn("_off", off).groupBy(*key).agg(F.count("_off").alias("n"), F.max("_off").alias("worst"), F.min_by("step", F.when(F.col("_off").isNotNull(), F.struct(-F.round("_off", 12), "step"))).alias("worst_step"))
    verdict = F.when(F.col("n") == 0, "not comparable").when(F.col("worst") <= exact, "exact").when(F.col("worst") <= near, "near").otherwise("broken")
    return s.withColumn("verdict", verdict)
