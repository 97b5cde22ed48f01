"""Queries: correlation, regression, tests."""

from pyspark.sql import functions as F

from runlens.functions import distributions as D
from runlens.operators import association as A
from runlens.operators import sequence as S
from runlens.operators import tests as H

from .catalog import query

KEY = ["run", "tag"]
ANCHOR = "events/view/m"
PAIRS = f""", x as (select run, step, value as x from fact where tag = '{ANCHOR}' and value is not null),
pairs as (select run, tag, step, x, value as y from fact join x using (run, step) where value is not null and tag <> '{ANCHOR}')"""
R = "covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0)"
RANKED = """, ranked as (select run, tag, rank() over (partition by run, tag order by x) + (count(*) over (partition by run, tag, x) - 1) / 2 as x,
rank() over (partition by run, tag order by y) + (count(*) over (partition by run, tag, y) - 1) / 2 as y from pairs)"""


def pairs(v):
    return A.with_anchor(v.fact.where(F.col("tag") != ANCHOR), v.fact.where(F.col("tag") == ANCHOR))


@query(f"{PAIRS} select run, tag, count(*) as n, count(distinct step) as steps from pairs group by all")
def sta01_pairs(v):
    return pairs(v).groupBy(*KEY).agg(F.count("*").alias("n"), F.count_distinct("step").alias("steps"))


@query(f"{PAIRS} select run, tag, count(*) as n, round(case when count(*) >= 3 then {R} end, 6) as r from pairs group by all")
def sta02_pearson(v):
    return pairs(v).groupBy(*KEY).agg(F.count("*").alias("n"), F.round(A.pearson("x", "y"), 6).alias("r"))


@query(f"{PAIRS}{RANKED} select run, tag, count(*) as n, round(case when count(*) >= 3 then {R} end, 6) as rho from ranked group by all")
def sta03_spearman(v):
    return A.spearman(pairs(v), KEY).withColumn("rho", F.round("rho", 6))


@query()
def sta05_correlation_p(v):
    """n, r, p by Student's t: beyond SQL; unit tests hold the distribution against closed forms."""
    r = pairs(v).groupBy(*KEY).agg(F.count("*").alias("n"), A.pearson("x", "y").alias("r"))
    return r.withColumn("p", D.correlation_p(F.col("r"), F.col("n")))


@query(f"""{PAIRS}, c as (select run, tag, count(*) as n, {R} as r from pairs group by all)
select run, tag, n, case when n >= 4 and abs(r) < 1 then round(tanh(atanh(r) - 1.959963984540054 / sqrt(greatest(n - 3, 1))), 6) end as low,
case when n >= 4 and abs(r) < 1 then round(tanh(atanh(r) + 1.959963984540054 / sqrt(greatest(n - 3, 1))), 6) end as high from c""")
def sta06_fisher_interval(v):
    r = pairs(v).groupBy(*KEY).agg(F.count("*").alias("n"), A.pearson("x", "y").alias("r"))
    low, high = D.fisher_interval(F.col("r"), F.col("n"))
    return r.select(*KEY, "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query(f"""{PAIRS}, f as (select run, tag, regr_slope(x, step) as sx, regr_intercept(x, step) as ix, regr_slope(y, step) as sy, regr_intercept(y, step) as iy from pairs group by all),
d as (select run, tag, x - ix - sx * step as x, y - iy - sy * step as y from pairs join f using (run, tag))
select run, tag, count(*) as n, round(case when count(*) >= 6 then {R} end, 6) as r from d group by all""")
def sta07_detrended(v):
    p = pairs(v)
    for side in ("x", "y"):
        p = A.residuals(p, ("run", "tag"), y=side, name=f"{side}_rest")
    return p.groupBy(*KEY).agg(F.count("*").alias("n"), F.round(A.pearson("x_rest", "y_rest", 6), 6).alias("r"))


@query(f"""{PAIRS}, marks as (select distinct run, step from (select run, day(to_timestamp(t))::int as step from restarts) where step % 4 = 0)
select run, tag, count(*) as n, round(case when count(*) >= 3 then {R} end, 6) as r from pairs anti join marks using (run, step) group by all""")
def sta09_without_affected_steps(v):
    marks = v.ev.where("event_type = 'error' and step % 4 = 0").select("run", "step").distinct()
    return pairs(v).join(marks, ["run", "step"], "left_anti").groupBy(*KEY).agg(F.count("*").alias("n"), F.round(A.pearson("x", "y"), 6).alias("r"))


@query(f"""{PAIRS}{RANKED}, c as (select run, tag, count(*) as n, {R} as rho from ranked group by all having count(*) >= 8),
o as (select *, row_number() over (partition by run order by round(abs(rho), 9) desc, tag) as k from c where rho is not null)
select run, tag, n, round(rho, 6) as rho, k from o where k <= 10""")
def sta11_top_correlations(v):
    from pyspark.sql import Window

    c = A.spearman(pairs(v), KEY).where("n >= 8 and rho is not null")
    k = F.row_number().over(Window.partitionBy("run").orderBy(F.desc(F.round(F.abs("rho"), 9)), "tag")).cast("long")
    return c.withColumn("k", k).where("k <= 10").select(*KEY, "n", F.round("rho", 6).alias("rho"), "k")


@query(f""", lags as (select l as lag, m.run, m.value as x, b.value as y from (select * from fact where tag = '{ANCHOR}') m, (select * from fact where tag = 'events/click/m') b, range(0, 9) r(l)
where b.run = m.run and b.step - l = m.step and m.value is not null and b.value is not null)
select run, lag, count(*) as n, round(case when count(*) >= 3 then {R} end, 6) as r, round(1.959963984540054 / sqrt(greatest(count(*) - 3, 1)), 6) as band from lags group by all""")
def sta12_lag_scan(v):
    m = v.fact.where((F.col("tag") == ANCHOR) & F.col("value").isNotNull()).select("run", F.col("value").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(8))).alias("lag"), "step")
    b = v.fact.where("tag = 'events/click/m' and value is not null").select("run", "step", F.col("value").alias("y"))
    met = m.withColumn("step", F.col("step") + F.col("lag")).join(b, ["run", "step"])
    band = F.round(1.959963984540054 / F.sqrt(F.greatest(F.count("*") - 3, F.lit(1))), 6)
    return met.groupBy("run", F.col("lag").cast("long").alias("lag")).agg(F.count("*").alias("n"), F.round(A.pearson("x", "y"), 6).alias("r"), band.alias("band"))


@query("""select run, tag, count(*) as n, round(case when count(*) >= 3 then regr_slope(value, step) end, 8) as slope,
round(case when count(*) >= 3 then regr_intercept(value, step) end, 6) as intercept, round(case when count(*) >= 3 then 1 - greatest(regr_syy(value, step) - regr_slope(value, step) * regr_sxy(value, step), 0) / nullif(regr_syy(value, step), 0) end, 6) as r2,
round(case when count(*) >= 3 then sqrt(greatest(regr_syy(value, step) - regr_slope(value, step) * regr_sxy(value, step), 0) / (count(*) - 2) / nullif(regr_sxx(value, step), 0)) end, 6) as se
from fact where value is not null group by all""")
def sta14_trend(v):
    t = A.trend(("run", "tag"), v.fact)
    return t.select(*KEY, "n", F.round("slope", 8).alias("slope"), F.round("intercept", 6).alias("intercept"), F.round("r2", 6).alias("r2"), F.round("se", 6).alias("se"))


@query(""", p as (select * from fact where value is not null),
s as (select a.run, a.tag, median((b.value - a.value) / (b.step - a.step)) as slope from p a join p b on a.run = b.run and a.tag = b.tag and a.step < b.step group by all)
select run, tag, round(slope, 8) as slope, round(median(value - slope * step), 6) as intercept from p join s using (run, tag) group by run, tag, slope""")
def sta15_theil_sen(v):
    return A.theil_sen(v.fact, KEY).select(*KEY, F.round("slope", 8).alias("slope"), F.round("intercept", 6).alias("intercept"))


@query(""", p as (select run, tag, step::double as step, value, count(*) over (partition by run, tag) as n, row_number() over (partition by run, tag order by step) as i from fact where value is not null),
f as (select run, tag, regr_slope(value, step) as slope, regr_intercept(value, step) as intercept, avg(step) as mx, regr_sxx(value, step) as sxx, greatest(1, floor(4 * power(any_value(n) / 100, 2.0 / 9)))::int as lags from p group by all),
u as (select run, tag, i, n, lags, slope, sxx, (value - intercept - slope * step) * (step - mx) as u from p join f using (run, tag)),
own as (select run, tag, any_value(n) as n, any_value(lags) as lags, any_value(slope) as slope, any_value(sxx) as sxx, sum(u * u) as own from u group by all),
c as (select a.run, a.tag, sum(a.u * b.u * (1 - (a.i - b.i) / (a.lags + 1))) as crossed from u a join u b on a.run = b.run and a.tag = b.tag and a.i > b.i and a.i - b.i <= a.lags group by all)
select run, tag, n, lags, round(slope, 8) as slope, round(sqrt(greatest(own + 2 * coalesce(crossed, 0), 0)) / nullif(sxx, 0), 6) as se from own left join c using (run, tag) where n >= 3""")
def sta16_newey_west(v):
    r = A.newey_west(v.fact, ("run", "tag")).where("n >= 3")
    return r.select(*KEY, "n", "lags", F.round("slope", 8).alias("slope"), F.round("se", 6).alias("se"))


@query(""", d as (select run, tag, value - avg(value) over (partition by run, tag) as d, step from fact where value is not null),
l as (select *, lag(d) over (partition by run, tag order by step) as before from d), s as (select run, tag, count(*) as n, sum(d * before) / nullif(sum(d * d), 0) as rho from l group by all)
select run, tag, n, round(rho, 6) as rho, round(least(n, n * (1 - greatest(-0.99, least(0.99, rho))) / (1 + greatest(-0.99, least(0.99, rho)))), 5) as n_effective from s where n > 2""")
def sta17_lag_one(v):
    s = A.lag_one(v.fact, ("run", "tag")).where("n > 2")
    return s.select(*KEY, "n", F.round("rho", 6).alias("rho"), F.round("n_effective", 5).alias("n_effective"))


@query(""", g as (select run, tag, arg_min(value, step) as a, arg_max(value, step) as b, min(step) as s, max(step) as e from fact where value > 0 group by all)
select run, tag, round(ln(b / a), 8) as growth, round(ln(b / a) / nullif(e - s, 0), 8) as per_step from g""")
def sta21_log_growth(v):
    g = v.fact.where("value > 0").groupBy(*KEY).agg(F.min_by("value", "step").alias("a"), F.max_by("value", "step").alias("b"), F.min("step").alias("s"), F.max("step").alias("e"))
    growth = F.ln(F.col("b") / F.col("a"))
    return g.select(*KEY, F.round(growth, 8).alias("growth"), F.round(F.try_divide(growth, F.col("e") - F.col("s")), 8).alias("per_step"))


@query(""", grid as (select run, 1704067200 + 43200 * i as t from (select distinct run from axis), range(0, 60) r(i)),
b as (select g.run, g.t, a.step as s0, a.wall as w0 from grid g asof left join axis a on g.run = a.run and g.t >= a.wall), x as (select b.*, a.step as s1, a.wall as w1 from b asof left join axis a on b.run = a.run and b.t <= a.wall)
select run, t::bigint as t, round(case when w1 = w0 then s0 else s0 + (t - w0) / (w1 - w0) * (s1 - s0) end, 6) as at_step from x""")
def sta22_interpolation(v):
    from runlens.operators.temporal import as_of

    times = F.sequence(F.lit(1704067200), F.lit(1704067200 + 59 * 43200), F.lit(43200)).cast("array<bigint>")
    grid = v.axis.select("run").distinct().select("run", F.explode(times).alias("t"))
    b = as_of(grid, v.axis, ["run"], "t", "wall", ["step", "wall"]).withColumnsRenamed({"step": "s0", "wall": "w0"})
    x = as_of(b, v.axis, ["run"], "t", "wall", ["step", "wall"], backward=False).withColumnsRenamed({"step": "s1", "wall": "w1"})
    between = F.col("s0") + (F.col("t") - F.col("w0")) / F.nullif(F.col("w1") - F.col("w0"), F.lit(0.0)) * (F.col("s1") - F.col("s0"))
    return x.select("run", "t", F.round(F.when(F.col("w1") == F.col("w0"), F.col("s0")).otherwise(between), 6).alias("at_step"))


ERF = "(sign({z}) * (1 - ((((1.061405429 * k + -1.453152027) * k + 1.421413741) * k + -0.284496736) * k + 0.254829592) * k * exp(-({z}) * ({z}))))"


@query(f""", z as (select run, tag, step, (value - 50) / 20 / sqrt(2.0) as z from fact where value is not null), k as (select *, 1 / (1 + 0.3275911 * abs(z)) as k from z)
select run, tag, step, round((1 + {ERF.format(z='z')}) / 2, 8) as cdf from k""")
def tst03_normal_cdf(v):
    return v.fact.where("value is not null").select(*KEY, "step", F.round(D.normal_cdf((F.col("value") - 50) / 20), 8).alias("cdf"))


@query("select df, round(df * power(1 - 2.0 / (9 * df) + 1.959963984540054 * sqrt(2.0 / (9 * df)), 3), 6) as q975 from (select distinct step::double as df from axis)")
def tst04_chi2_quantile(v):
    df = v.axis.select(F.col("step").cast("double").alias("df")).distinct()
    return df.select("df", F.round(D.chi2_quantile(F.lit(1.959963984540054), F.col("df")), 6).alias("q975"))


@query(f""", g as (select tag, run = 'r1' as g, value from fact where value is not null),
r as (select *, rank() over (partition by tag order by value) + (count(*) over (partition by tag, value) - 1) / 2 as rk from g),
t as (select tag, sum(n ** 3 - n) as ties from (select tag, value, count(*)::double as n from g group by all) group by tag),
s as (select tag, count(*) filter (g) as n1, count(*) filter (not g) as n0, sum(rk) filter (g) as total from r group by tag),
u as (select *, total - n1 * (n1 + 1) / 2 as u, n1 + n0 as n from s join t using (tag)),
z as (select *, (u - n1 * n0 / 2) / nullif(sqrt(greatest(n1 * n0 / 12 * (n + 1 - ties / (n * (n - 1))), 0)), 0) as z from u), k as (select *, abs(z) / sqrt(2.0) as y, 1 / (1 + 0.3275911 * abs(z) / sqrt(2.0)) as k from z)
select tag, n1, n0, u, round(z, 6) as z, round(2 * (1 - (1 + {ERF.format(z='y')}) / 2), 6) as p, round(2 * u / (n1 * n0) - 1, 6) as biserial from k""")
def tst05_mann_whitney(v):
    rows = v.fact.where("value is not null").withColumn("g", F.col("run") == "r1")
    return H.mann_whitney(rows, ["tag"], "g", "value").select("tag", "n1", "n0", "u", *(F.round(c, 6).alias(c) for c in ("z", "p", "biserial")))


@query(""", g as (select tag, run = 'r1' as g, value from fact where value is not null)
select a.tag, round(avg(sign(a.value - b.value)), 6) as delta from g a join g b on a.tag = b.tag and a.g and not b.g group by a.tag""")
def tst06_cliffs_delta(v):
    rows = v.fact.where("value is not null").withColumn("g", F.col("run") == "r1")
    return H.cliffs_delta(rows, ["tag"], "g", "value").withColumn("delta", F.round("delta", 6))


@query(""", s as (select tag, count(value) filter (run = 'r1') as n1, count(value) filter (run <> 'r1') as n0, avg(value) filter (run = 'r1') as m1, avg(value) filter (run <> 'r1') as m0,
var_samp(value) filter (run = 'r1') as v1, var_samp(value) filter (run <> 'r1') as v0 from fact group by tag)
select tag, n1, n0, round(m1 - m0, 6) as gap, round((m1 - m0) / nullif(sqrt(v1 / n1 + v0 / n0), 0), 6) as t,
round(power(v1 / n1 + v0 / n0, 2) / nullif(power(v1 / n1, 2) / (n1 - 1) + power(v0 / n0, 2) / (n0 - 1), 0), 6) as df from s""")
def tst07_welch(v):
    rows = v.fact.withColumn("g", F.col("run") == "r1")
    return H.welch(rows, ["tag"], "g", "value").select("tag", "n1", "n0", *(F.round(c, 6).alias(c) for c in ("gap", "t", "df")))


@query(""", d as (select a.tag, b.value - a.value as d from fact a join fact b using (tag, step) where a.run = 'r0' and b.run = 'r1'),
s as (select tag, count(*) filter (d > 0) as wins, count(*) filter (d <> 0) as n from d group by tag)
select tag, wins, n, round(least(1, 2 * list_sum(list_transform(range(0, least(wins, n - wins) + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2.0))))), 6) as p from s where n > 0""")
def tst08_sign_test(v):
    r0, r1 = (v.fact.where(F.col("run") == r).select("tag", "step", F.col("value").alias(r)) for r in ("r0", "r1"))
    s = r0.join(r1, ["tag", "step"]).groupBy("tag").agg(F.count_if(F.col("r1") > F.col("r0")).alias("wins"), F.count_if(F.col("r1") != F.col("r0")).alias("n")).where("n > 0")
    return s.withColumn("p", F.round(H.sign_test_p(F.col("wins"), F.col("n")), 6))


@query(""", p as (select dataset, round(abs(regr_r2(rate, step)), 9) / 4 as p from panel group by dataset), r as (select *, row_number() over (order by p) as k, count(*) over () as m from p where p is not null),
o as (select *, p <= 0.05 / (m - k + 1) as ok from r), s as (select *, min(case when not ok then k end) over () as stop, max(case when ok then k end) over () as last from o)
select dataset, round(p, 6) as p, stop is null or k < stop as holm, coalesce(k <= last, false) as hochberg from s""")
def tst09_holm(v):
    p = v.panel.groupBy("dataset").agg((F.round(F.abs(F.regr_r2("rate", "step")), 9) / 4).alias("p"))
    return H.holm(p, [], "p").withColumn("p", F.round("p", 6))


@query()
def tst10_bootstrap(v):
    return H.bootstrap_mean(v.fact, KEY, "value")


@query()
def tst13_sign_flip(v):
    return H.sign_flip_p(S.with_difference(v.fact), KEY, "delta")


@query()
def sta14_trend_test(v):
    """Each series' line with its error, p and interval."""
    return A.trend_test(tuple(KEY), v.fact)


@query(f"""{PAIRS}, d as (select *, case when lag(step) over w = step - 1 then x - lag(x) over w end as dx, case when lag(step) over w = step - 1 then y - lag(y) over w end as dy from pairs window w as (partition by run, tag order by step)),
c as (select run, tag, count(*) as n, {R} as r, count(dx) as n_diff, case when count(dx) >= 3 then covar_pop(dx, dy) / nullif(stddev_pop(dx) * stddev_pop(dy), 0) end as r_diff from d group by all having count(*) >= 3),
z as (select *, case when n >= 4 and abs(r) < 1 then atanh(r) end as z, 1.959963984540054 / sqrt(greatest(n - 3, 1)) as h from c)
select run, tag, n, round(r, 6) as r, round(tanh(z - h), 6) as low, round(tanh(z + h), 6) as high, n_diff, round(r_diff, 6) as r_diff from z""")
def sta04_intervals(v):
    c = A.correlation_record(pairs(v), KEY)
    return c.select(*KEY, "n", *(F.round(x, 6).alias(x) for x in ("r", "low", "high")), "n_diff", F.round("r_diff", 6).alias("r_diff"))
