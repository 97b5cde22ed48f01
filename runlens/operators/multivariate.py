"""Structure among many series: cohorts, Gram matrix, principal components, partitions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .association import pearson
from .sequence import SERIES, filled


def cohort(fact: DataFrame, axis: DataFrame, coverage: float = 0.8) -> DataFrame:
    """run, tag, step, z: series that cover enough steps and vary, with gaps filled, in population standard scores."""
    steps = F.broadcast(axis.groupBy("run").agg(F.count("*").alias("_n")))  # one row a run
    keep = fact.groupBy(*SERIES).agg(F.count("value").alias("_c"), F.count_distinct("value").alias("_d")).join(steps, "run")
    keep = keep.where((F.col("_c") >= coverage * F.col("_n")) & (F.col("_d") > 1)).select(*SERIES)
    grid = axis.select("run", "step").join(keep, "run")
    whole = filled(grid.join(fact.select(*SERIES, "step", "value"), [*SERIES, "step"], "left"))
    w = Window.partitionBy(*SERIES)
    return whole.select(*SERIES, "step", ((F.col("value") - F.avg("value").over(w)) / F.stddev_pop("value").over(w)).alias("z"))


def gram(z: DataFrame) -> DataFrame:
    """run, s1, s2, g: inner products of steps over all series. Its size is that of the axis squared, not of the series."""
    a, b = (z.select("run", "tag", F.col("step").alias(s), F.col("z").alias(f"z{s}")) for s in ("s1", "s2"))
    return a.join(b, ["run", "tag"]).groupBy("run", "s1", "s2").agg(F.sum(F.col("zs1") * F.col("zs2")).alias("g"))


def spectrum(g: DataFrame) -> DataFrame:
    """run, k, eigenvalue, share, cumulative of each run's Gram matrix, which is as large as its axis (one task a run)."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot(index="s1", columns="s2", values="g").to_numpy()
        values = np.maximum(np.linalg.eigvalsh((m + m.T) / 2)[::-1], 0)
        share = values / max(values.sum(), 1e-300)
        return pd.DataFrame({"run": pdf["run"].iloc[0], "k": np.arange(1, len(values) + 1, dtype=np.int64), "eigenvalue": values, "share": share, "cumulative": share.cumsum()})

    return g.groupBy("run").applyInPandas(solve, "run string, k long, eigenvalue double, share double, cumulative double")


def participation_ratio(g: DataFrame) -> DataFrame:
    """run, ratio: squared trace over squared norm of the Gram matrix, the effective number of dimensions."""
    trace = F.sum(F.when(F.col("s1") == F.col("s2"), F.col("g")))
    return g.groupBy("run").agg(F.try_divide(trace * trace, F.sum(F.col("g") * F.col("g"))).alias("ratio"))


def spectrum_summary(z: DataFrame) -> DataFrame:
    """run, n_steps, n_series, n80, n90, n95, ratio, edge, n_above, n_above_scaled: how many dimensions a run's series need.

    n80 to n95: eigenvalues of the Gram matrix that hold this share of its trace; ratio: the participation ratio; edge:
    (1 + sqrt(series / (steps - 1)))^2, where eigenvalues of pure noise end; n_above counts eigenvalues of the Gram matrix
    beyond it, n_above_scaled those divided by steps - 1, as the edge of a correlation matrix asks. One step: edge is NULL.
    """
    values = spectrum(gram(z))
    series = z.groupBy("run").agg(F.count_distinct("tag").alias("n_series"), F.count_distinct("step").alias("n_steps"))
    edge = F.pow(1 + F.sqrt(F.try_divide("n_series", F.col("n_steps") - 1)), F.lit(2.0))
    rows = values.join(F.broadcast(series), "run").withColumn("edge", edge)  # a row a run
    first = lambda share: F.min(F.when(F.col("cumulative") >= share - 1e-12, F.col("k")))
    total = F.sum("eigenvalue")
    return rows.groupBy("run", "n_steps", "n_series", "edge").agg(
        first(0.8).alias("n80"), first(0.9).alias("n90"), first(0.95).alias("n95"), F.try_divide(total * total, F.sum(F.col("eigenvalue") * F.col("eigenvalue"))).alias("ratio"),
        F.count_if(F.col("eigenvalue") > F.col("edge")).alias("n_above"), F.count_if(F.try_divide("eigenvalue", F.col("n_steps") - 1) > F.col("edge")).alias("n_above_scaled"),
    )


def adjusted_rand(labels: DataFrame, a: str, b: str) -> DataFrame:
    """ari: agreement of two partitions of the same rows, from their contingency table."""
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    cells = labels.groupBy(a, b).agg(F.count("*").alias("n"))
    both = cells.agg(pairs("n").alias("ij"), F.sum("n").alias("n"))
    rows = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(pairs("n").alias("i"))
    columns = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(pairs("n").alias("j"))
    expected = F.col("i") * F.col("j") / (F.col("n") * (F.col("n") - 1) / 2)
    joined = both.withColumn("i", rows.scalar()).withColumn("j", columns.scalar())
    return joined.select(F.try_divide(F.col("ij") - expected, (F.col("i") + F.col("j")) / 2 - expected).alias("ari"))


def distances(z: DataFrame) -> DataFrame:
    """run, x, y, d: one minus the absolute correlation of each pair of a run's series (x < y)."""
    a, b = (z.select("run", "step", F.col("tag").alias(t), F.col("z").alias(f"z{t}")) for t in ("x", "y"))
    return a.join(b, ["run", "step"]).where("x < y").groupBy("run", "x", "y").agg((1 - F.abs(pearson("zx", "zy"))).alias("d"))
