"""Queries: fitted curves, change points and bases. Tests hold those beyond SQL against plain twins."""

from pyspark.sql import functions as F

from runlens.operators import curves as U
from runlens.operators import factors as K
from runlens.operators import multivariate as V
from runlens.operators import profile as P
from runlens.operators import saturation as S

from .catalog import query
from .decompositions import Z


@query()
def mlt18_saturation(v):
    return U.saturation_fits(v.fact, ["run", "tag"])


@query()
def mlt12_change_points(v):
    return K.change_points(V.cohort(v.fact, v.axis))


@query()
def mlt11_greedy_basis(v):
    return K.greedy_basis(V.cohort(v.fact, v.axis), 5)


@query()
def mlt07_loadings(v):
    return K.loadings(V.cohort(v.fact, v.axis))


@query()
def tst12_block_permutation(v):
    return U.block_permutation_p(v.fact, ["run", "tag"])


@query(f"{Z} select a.run, a.tag as x, b.tag as y, round(1 - abs(covar_pop(a.z, b.z) / nullif(stddev_pop(a.z) * stddev_pop(b.z), 0)), 6) as d from z a join z b on a.run = b.run and a.step = b.step and a.tag < b.tag group by all")
def mlt08_distances(v):
    return V.distances(V.cohort(v.fact, v.axis)).withColumn("d", F.round("d", 6))


@query("""select a.tag, count(*) as n, round(covar_pop(a.value, b.value) / nullif(stddev_pop(a.value) * stddev_pop(b.value), 0), 6) as r from fact a join fact b using (tag, step)
where a.run = 'r0' and b.run = 'r1' and a.value is not null and b.value is not null group by a.tag having count(*) >= 3""")
def mlt16_across_runs(v):
    from runlens.operators.association import pearson

    r0, r1 = (v.fact.where((F.col("run") == r) & F.col("value").isNotNull()).select("tag", "step", F.col("value").alias(r)) for r in ("r0", "r1"))
    return r0.join(r1, ["tag", "step"]).groupBy("tag").agg(F.count("*").alias("n"), F.round(pearson("r0", "r1"), 6).alias("r")).where("n >= 3")


@query()
def tst15_bootstrap_spectrum(v):
    """How sure is a run's spectrum? Its series are drawn anew 200 times."""
    return K.bootstrap_spectrum(V.cohort(v.fact, v.axis))


@query()
def tst19_leave_one_step_out(v):
    return K.leave_one_step_out(V.cohort(v.fact, v.axis))


@query()
def mlt15_matched_components(v):
    return K.matched_components(V.cohort(v.fact, v.axis), "r0", "r1")


@query()
def tst14_bootstrapped_fits(v):
    """Every model of every series, with what its residuals leave open of the plateau and the way to it."""
    return S.with_headroom(S.bootstrapped_fits(v.fact, ["run", "tag"]))


@query()
def mlt19_headroom(v):
    """What is each series' room above its last value, and do the models agree?"""
    fits = S.with_headroom(S.bootstrapped_fits(v.fact, ["run", "tag"]))
    return S.saturation_verdicts(fits, P.detectable_change(v.fact, ["run", "tag"]), ["run", "tag"])
