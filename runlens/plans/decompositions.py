"""Queries: decompositions, ledgers, multivariate structure."""

from pyspark.sql import functions as F

from runlens.operators import decomposition as C
from runlens.operators import factors as K
from runlens.operators import multivariate as V
from runlens.operators.association import pearson, trend
from runlens.operators.sequence import with_average_rank

from .catalog import query


@query("select run, step, round(greatest(0, least(wall, 1706000000.0) - 1704067200.0) * 0.0125, 6) as cost from axis")
def dom01_cost(v):
    return v.axis.select("run", "step", F.round(C.cost(0.0125, 1704067200.0, F.col("wall"), F.lit(1706000000.0)), 6).alias("cost"))


@query("select bkey, run, step, round(value, 9) as value from bench semi join (select run, step from axis where wall <= 1705300000) a using (run, step)")
def dom04_visible_benchmarks(v):
    seen = v.axis.where("wall <= 1705300000").select("run", "step")
    return v.bench.join(seen, ["run", "step"], "left_semi").select("bkey", "run", "step", F.round("value", 9).alias("value"))


@query("select * from (select run, t, kind from run_events order by t desc, run, kind limit 40)")
def dom05_feed(v):
    return v.run_events.select("run", "t", "kind").orderBy(F.desc("t"), "run", "kind").limit(40)


@query(""", s as (select run, step, tag, value / nullif(sum(value) over (partition by run, step), 0) as share from fact where tag like '%/c')
select run, step, tag, round(share, 9) as share, round(case when lag(step) over w = step - 1 then share - lag(share) over w end, 9) as change from s window w as (partition by run, tag order by step)""")
def dom07_shares(v):
    s = C.shares(v.fact.where("tag like '%/c'"), ["run"], "step", "tag", "value")
    return s.select("run", "step", "tag", F.round("share", 9).alias("share"), F.round("change", 9).alias("change"))


@query(""", b as (select a.dataset, a.weight as w0, b.weight as w1, a.rate as r0, b.rate as r1 from panel a join panel b using (dataset) where a.step = 3 and b.step = 20 and a.weight > 0 and b.weight > 0 and a.rate is not null and b.rate is not null),
s as (select *, w0 / sum(w0) over () as s0, w1 / sum(w1) over () as s1 from b)
select round(sum(s0 * (r1 - r0)), 8) as within, round(sum((s1 - s0) * r0), 8) as mix, round(sum((s1 - s0) * (r1 - r0)), 8) as interaction, round(sum(s1 * r1 - s0 * r0), 8) as total, count(*) as parts from s""")
def dom08_shift_share(v):
    r = C.shift_share(v.panel.where("step = 3"), v.panel.where("step = 20"), "dataset")
    return r.select(*(F.round(c, 8).alias(c) for c in ("within", "mix", "interaction", "total")), "parts")


@query(""", ok as (select * from panel where weight > 0 and rate is not null), base as (select dataset, avg(weight) as base from ok where step <= 8 group by dataset)
select step, round(sum(weight * rate) / sum(weight), 8) as actual, round(sum(base * rate) / sum(base), 8) as fixed from ok join base using (dataset) group by step""")
def dom10_fixed_weights(v):
    return C.fixed_weight_curve(v.panel, "dataset", 8).select("step", F.round("actual", 8).alias("actual"), F.round("fixed", 8).alias("fixed"))


@query(""", f as (select dataset, count(*) as n, regr_slope(rate, step) as slope, sqrt(greatest(regr_syy(rate, step) - regr_slope(rate, step) * regr_sxy(rate, step), 0) / (count(*) - 2) / nullif(regr_sxx(rate, step), 0)) as se from panel where rate is not null group by dataset)
select dataset, n, round(slope, 9) as slope, case when slope is null then null when abs(slope / nullif(se, 0)) >= 2 and slope > 0 then 'learned' when abs(slope / nullif(se, 0)) >= 2 and slope < 0 then 'regressing'
when abs(slope) >= 1e-4 then 'slow' else 'stagnant' end as verdict from f where n >= 3""")
def dom13_classified(v):
    t = C.classified(trend(("dataset",), v.panel, y="rate")).where("n >= 3")
    return t.select("dataset", "n", F.round("slope", 9).alias("slope"), "verdict")


@query(""", s as (select min(step) as lo, max(step) as hi from panel) select dataset, count(*) as have, (max(hi) - max(lo) + 1 - count(*))::bigint as holes, round(sum(weight), 4) as weight from panel, s group by dataset""")
def dom14_inventory(v):
    steps = v.panel.agg((F.max("step") - F.min("step") + 1).alias("n"))
    inv = v.panel.groupBy("dataset").agg(F.count("*").alias("have"), F.round(F.sum("weight"), 4).alias("weight"))
    return inv.select("dataset", "have", (steps.scalar() - F.col("have")).cast("long").alias("holes"), "weight")


@query("select step, dataset, round((rate - avg(rate) over w) / nullif(stddev_samp(rate) over w, 0), 6) as z, rank() over (partition by step order by round(rate, 12) desc)::int as place from panel window w as (partition by step)")
def dom15_standing(v):
    s = C.standing(v.panel.withColumn("rate", F.round("rate", 12)), ["step"], "rate")
    return s.select("step", "dataset", F.round("z", 6).alias("z"), "place")


@query(""", s as (select dataset, regr_slope(weight, step) as growth, regr_slope(rate, step) as gain from panel group by dataset),
r as (select rank() over (order by round(growth, 9)) + (count(*) over (partition by round(growth, 9)) - 1) / 2 as x, rank() over (order by round(gain, 12)) + (count(*) over (partition by round(gain, 12)) - 1) / 2 as y from s)
select count(*) as n, round(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 6) as rho from r""")
def dom17_share_and_gain(v):
    s = v.panel.groupBy("dataset").agg(F.round(F.regr_slope("weight", "step"), 9).alias("x"), F.round(F.regr_slope("rate", "step"), 12).alias("y")).withColumn("all", F.lit(1))
    ranked = with_average_rank(with_average_rank(s, ("all",), "x", "rx"), ("all",), "y", "ry")
    return ranked.agg(F.count("*").alias("n"), F.round(pearson("rx", "ry"), 6).alias("rho"))


@query(""", a as (select *, wall - lag(wall) over (partition by run order by step) as real from axis), r as (select run, step, sum(value) * 12 as reported from ev where event_type <> 'error' group by all)
select run, step, round(real, 3) as real, round(reported, 4) as reported, round(real - reported, 3) as gap, round((real - reported) / nullif(real, 0), 6) as gap_share, round(real * 0.01, 6) as cost from a left join r using (run, step)""")
def dom22_time_ledger(v):
    reported = v.ev.where("event_type <> 'error'").groupBy("run", "step").agg((F.sum("value") * 12).alias("reported"))
    t = C.time_ledger(v.axis, reported, 0.01)
    return t.select("run", "step", F.round("real", 3).alias("real"), F.round("reported", 4).alias("reported"), F.round("gap", 3).alias("gap"), F.round("gap_share", 6).alias("gap_share"), F.round("cost", 6).alias("cost"))


@query("select run, count(*) as n, round(avg(gap), 4) as mtbf, round(min(gap), 4) as shortest, round(max(gap), 4) as longest from (select run, t - lag(t) over (partition by run order by t) as gap from restarts) group by run")
def dom26_restart_intervals(v):
    i = C.intervals(v.restarts, "run", "t")
    return i.select("run", "n", *(F.round(c, 4).alias(c) for c in ("mtbf", "shortest", "longest")))


@query("select tag, round(max(value) filter (run = 'r0'), 9) as r0, round(max(value) filter (run = 'r1'), 9) as r1 from (select run, tag, avg(value) as value from fact group by all) group by tag")
def dom29_side_by_side(v):
    means = v.fact.groupBy("run", "tag").agg(F.avg("value").alias("value"))
    wide = means.groupBy("tag").pivot("run", ["r0", "r1"]).agg(F.max("value"))
    return wide.select("tag", F.round("r0", 9).alias("r0"), F.round("r1", 9).alias("r1"))


Z = """, steps as (select run, count(*) as n from axis group by run),
keep as (select run, tag from fact join steps using (run) group by run, tag having count(value) >= 0.8 * any_value(n) and count(distinct value) > 1),
grid as (select run, tag, step, value from axis join keep using (run) left join fact using (run, tag, step)),
known as (select *, last_value(case when value is not null then step end ignore nulls) over b as ps, last_value(value ignore nulls) over b as pv,
first_value(case when value is not null then step end ignore nulls) over a as ns, first_value(value ignore nulls) over a as nv from grid
window b as (partition by run, tag order by step rows unbounded preceding), a as (partition by run, tag order by step rows between current row and unbounded following)),
whole as (select run, tag, step, coalesce(value, pv + coalesce((step - ps) / nullif(ns - ps, 0)::double, 0) * (nv - pv), pv, nv) as value from known),
z as (select run, tag, step, (value - avg(value) over (partition by run, tag)) / stddev_pop(value) over (partition by run, tag) as z from whole)"""
G = f"{Z}, g as (select a.run, a.step as s1, b.step as s2, sum(a.z * b.z) as g from z a join z b using (run, tag) group by all)"


@query(f"{Z} select run, tag, step, round(z, 6) as z from z")
def mlt03_cohort(v):
    return V.cohort(v.fact, v.axis).withColumn("z", F.round("z", 6))


@query(f"{G} select run, s1, s2, round(g, 5) as g from g")
def mlt04_gram(v):
    return V.gram(V.cohort(v.fact, v.axis)).withColumn("g", F.round("g", 5))


@query()
def mlt05_spectrum(v):
    return V.spectrum(V.gram(V.cohort(v.fact, v.axis)))


@query(f"{G} select run, round(power(sum(case when s1 = s2 then g end), 2) / nullif(sum(g * g), 0), 6) as ratio from g group by run")
def mlt06_participation(v):
    return V.participation_ratio(V.gram(V.cohort(v.fact, v.axis))).withColumn("ratio", F.round("ratio", 6))


@query()
def mlt09_average_linkage(v):
    return K.average_linkage(V.distances(V.cohort(v.fact, v.axis)), 4)


@query(""", cells as (select label as a, vec_id % 7 as b, count(*) as n from embeddings group by all),
i as (select sum(n * (n - 1) / 2) as i from (select sum(n) as n from cells group by a)), j as (select sum(n * (n - 1) / 2) as j from (select sum(n) as n from cells group by b)), ij as (select sum(n * (n - 1) / 2) as ij, sum(n) as n from cells)
select round((ij - i * j / (n * (n - 1) / 2)) / nullif((i + j) / 2 - i * j / (n * (n - 1) / 2), 0), 9) as ari from i, j, ij""")
def mlt10_adjusted_rand(v):
    rows = v.table("embeddings").select("label", (F.col("vec_id") % 7).alias("other"))
    return V.adjusted_rand(rows, "label", "other").withColumn("ari", F.round("ari", 9))


@query(""", q as (select dataset, step, weight, rate, weight > 0 and rate is not null as ok from panel),
b as (select coalesce(x.step, y.step - 4) as step, x.ok as ok0, y.ok as ok1, coalesce(x.ok and y.ok, false) as ok, x.weight as w0, y.weight as w1, x.rate as r0, y.rate as r1 from q x full join q y on x.dataset = y.dataset and x.step = y.step - 4),
s as (select step, sum(w0 * r0) filter (ok) / sum(w0) filter (ok) as m00, sum(w0 * r1) filter (ok) / sum(w0) filter (ok) as m01, sum(w1 * r0) filter (ok) / sum(w1) filter (ok) as m10, sum(w1 * r1) filter (ok) / sum(w1) filter (ok) as m11,
count(*) filter (ok) as parts, count(*) filter (not ok) as left_out from b group by step having count(ok0) > 0 and count(ok1) > 0)
select step, round(m01 - m00, 8) as within, round(m10 - m00, 8) as mix, round(m11 - m10 - m01 + m00, 8) as interaction, round(m11 - m10, 8) as paasche, round(m11 - m00, 8) as total, parts, left_out from s""")
def dom09_shift_shares(v):
    """Why the mean rate changed within a year, from every quarter on."""
    s = C.shift_shares(v.panel, "dataset", 4)
    return s.select("step", *(F.round(c, 8).alias(c) for c in ("within", "mix", "interaction", "paasche", "total")), "parts", "left_out")


@query()
def mlt06_spectrum_summary(v):
    return V.spectrum_summary(V.cohort(v.fact, v.axis))
