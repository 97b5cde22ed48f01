"""Queries: anomalies, breakpoints, identities and checks."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from runlens.functions.paths import is_round
from runlens.operators import anomaly as N
from runlens.operators import sequence as S
from runlens.operators.summary import modal

from .catalog import query

DIFF = ", d as (select *, case when lag(step) over w = step - 1 then value - lag(value) over w end as delta, lag(value) over w as before from fact window w as (partition by run, tag order by step))"
STEP = 12
ANOMALY = f"""{DIFF},
mo as (select run, tag, count(value) as n, count(delta) as nd, avg(delta) as mean, stddev_samp(delta) as sd, median(delta) as mid, max(value) filter (step = {STEP}) as value,
arg_max(value, step) filter (step < {STEP} and value is not null) as prev from d group by all),
md as (select run, tag, 1.4826 * median(abs(delta - mid)) as mad from d join mo using (run, tag) where delta is not null group by all),
zs as (select mo.*, mo.value - prev as delta, case when nd >= 5 and sd > 0 then (mo.value - prev - mean) / sd end as z, case when nd >= 5 and mad > 0 then (mo.value - prev - mid) / mad end as zr
from mo left join md using (run, tag) where mo.value is not null),
sc as (select *, case when z is not null and zr is not null then least(abs(z), abs(zr)) else abs(coalesce(z, zr)) end as score, regexp_replace(tag, '/[a-z]+$', '/*') as family from zs)"""


@query(f"{ANOMALY} select run, tag, n, round(value, 9) as value, round(prev, 9) as prev, round(delta, 9) as delta, round(delta / nullif(prev, 0), 6) as pct, round(z, 6) as z, round(zr, 6) as zr, round(score, 6) as score from sc")
def ano01_step_anomaly(v):
    a = N.step_anomaly(v.fact, STEP)
    return a.select("run", "tag", "n", *(F.round(c, 9).alias(c) for c in ("value", "prev", "delta")), *(F.round(c, 6).alias(c) for c in ("pct", "z", "zr", "score")))


@query(f"""{ANOMALY}, b as (select *, row_number() over (partition by run, family order by score desc, tag) as o, count(*) over (partition by run, family) as member_count from sc where n >= 5 and score is not null),
r as (select *, row_number() over (partition by run order by score desc, family)::int as rank from b where o = 1)
select run, family, tag, round(score, 6) as score, member_count, rank from r where rank <= 12""")
def ano02_movers(v):
    m = N.movers(v.fact, STEP, folded=F.regexp_replace("tag", "/[a-z]+$", "/*"))
    return m.select("run", "family", "tag", F.round("score", 6).alias("score"), "member_count", "rank")


@query(f"""{DIFF}, x as (select run, step, value as x, delta as dx from d where tag = 'events/view/m'),
p as (select run, tag, x, value as y from d join x using (run, step) where x is not null and value is not null and tag <> 'events/view/m'),
rk as (select run, tag, rank() over (partition by run, tag order by x) + (count(*) over (partition by run, tag, x) - 1) / 2 as x, rank() over (partition by run, tag order by y) + (count(*) over (partition by run, tag, y) - 1) / 2 as y from p),
c as (select run, tag, count(*) as n, covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) as rho from rk group by all having count(*) >= 8),
f as (select *, regexp_replace(tag, '/[a-z]+$', '/*') as family from c where rho is not null),
b as (select *, row_number() over (partition by run, family order by round(abs(rho), 9) desc, tag) as o, count(*) over (partition by run, family) as member_count from f),
r as (select *, row_number() over (partition by run order by round(abs(rho), 9) desc, family)::int as rank from b where o = 1)
select run, family, tag, n, round(rho, 6) as spearman, member_count, rank from r where rank <= 12""")
def ano03_correlation_panel(v):
    c = N.correlation_panel(v.fact, "events/view/m", folded=F.regexp_replace("tag", "/[a-z]+$", "/*"))
    return c.select("run", "family", "tag", "n", F.round("spearman", 6).alias("spearman"), "member_count", "rank")


@query(f"""{DIFF}, m as (select run, tag, median(delta) as mid, median(abs(delta)) as typical from d where delta is not null group by all),
s as (select run, tag, 1.4826 * median(abs(delta - mid)) as mad, any_value(typical) as typical from d join m using (run, tag) where delta is not null group by all)
select run, tag, step, round(delta, 9) as delta, round(abs(delta) / (case when mad > 0 then mad else nullif(typical, 0) end), 6) as score from d join s using (run, tag)
where delta is not null and abs(delta) / (case when mad > 0 then mad else nullif(typical, 0) end) > 3 and abs(delta) > 0.05 * abs(before)""")
def ano08_breakpoints(v):
    return N.breakpoints(v.fact, times=3).select("run", "tag", "step", F.round("delta", 9).alias("delta"), F.round("score", 6).alias("score"))


@query(f"""{DIFF}, s as (select run, tag, step, abs(delta) / nullif(abs(before), 0) as rel from d where delta is not null) select run, step, count(*) as n, count(*) filter (rel >= 0.15) as jumps,
round(count(*) filter (rel >= 0.15) / count(*), 6) as share from s group by all""")
def ano07_jumps_per_step(v):
    d = S.with_difference(v.fact).withColumn("rel", F.try_divide(F.abs("delta"), F.abs(F.lag("value").over(S.along())))).where("delta is not null")
    return d.groupBy("run", "step").agg(F.count("*").alias("n"), F.count_if(F.col("rel") >= 0.15).alias("jumps"), F.round(F.count_if(F.col("rel") >= 0.15) / F.count("*"), 6).alias("share"))


@query("""select dataset, step::int as step, mode, share, mode = high and share >= 0.3 as capped, is_round from (
select p_brand as dataset, 0 as step, arg_max(value, n * 1e9 - value) as mode, round(max(n) / sum(n), 6) as share, max(value) as high, any_value(true) and (arg_max(value, n * 1e9 - value) >= 2
and (abs(log2(arg_max(value, n * 1e9 - value)) - round(log2(arg_max(value, n * 1e9 - value)))) < 1e-9
or abs(arg_max(value, n * 1e9 - value) / power(10, floor(log10(arg_max(value, n * 1e9 - value)))) - round(arg_max(value, n * 1e9 - value) / power(10, floor(log10(arg_max(value, n * 1e9 - value)))))) < 1e-9)) as is_round
from (select p_brand, least(p_size, 30)::double as value, count(*) as n from part group by all) group by p_brand)""")
def ano10_caps(v):
    rows = v.table("part").select(F.col("p_brand").alias("dataset"), F.least("p_size", F.lit(30)).cast("double").alias("value"))
    high = rows.groupBy("dataset").agg(F.max("value").alias("high"))
    m = modal(rows, ("dataset",)).join(high, "dataset")
    return m.select("dataset", F.lit(0).alias("step"), "mode", F.round("share", 6).alias("share"), ((F.col("mode") == F.col("high")) & (F.col("share") >= 0.3)).alias("capped"), is_round(F.col("mode")).alias("is_round"))


@query("select run, tag, step from (select *, lag(value) over (partition by run, tag order by step) as before from fact where value is not null) where abs(value) >= 3 * abs(before) and before <> 0")
def ano12_scale_jumps(v):
    rows = v.fact.where("value is not null").withColumn("before", F.lag("value").over(S.along()))
    return rows.where("abs(value) >= 3 * abs(before) and before <> 0").select("run", "tag", "step")


@query("""select run, kind, count(*) as tags from (select run, tag, case when count(value) = 0 then 'empty' when count(distinct value) = 1 then 'constant' when count(distinct value) = 2 then 'two-valued' else 'varied' end as kind from fact group by all) group by all""")
def ano13_constant_kinds(v):
    d = F.count_distinct("value")
    kind = F.when(d == 0, "empty").when(d == 1, "constant").when(d == 2, "two-valued").otherwise("varied")
    return v.fact.groupBy("run", "tag").agg(kind.alias("kind")).groupBy("run", "kind").agg(F.count("*").alias("tags"))


@query(""", n as (select run, count(*) as n from axis group by run), c as (select run, tag, count(value) / any_value(n) as cover from fact join n using (run) group by all)
select run, case when cover < 0.5 then 0 when cover < 0.8 then 1 when cover < 1 then 2 else 3 end as bin, count(*) as tags from c group by all""")
def ano14_coverage(v):
    from runlens.functions.paths import histogram_bin

    n = F.broadcast(v.axis.groupBy("run").agg(F.count("*").alias("n")))
    c = v.fact.join(n, "run").groupBy("run", "tag").agg((F.count("value") / F.first("n")).alias("cover"))
    return c.groupBy("run", histogram_bin(F.col("cover"), [0.5, 0.8, 1]).alias("bin")).agg(F.count("*").alias("tags"))


@query(""", wide as (select * from fact where tag like '%/c' or tag like '%/s' union all select run, tag || '/twice', step, 2 * value + 1 from fact where tag like '%/c' union all select run, tag || '/copy', step, value from fact where tag like '%/c')
select run, tag as x, tag || '/copy' as y, count(*) as n, 'identical' as kind from fact where tag like '%/c' group by run, tag having count(*) >= 6
union all select run, tag, tag || '/twice', count(*), 'affine' from fact where tag like '%/c' group by run, tag having count(*) >= 6""")
def ano15_identities(v):
    c = v.fact.where("tag like '%/c'")
    twice = c.select("run", F.concat("tag", F.lit("/twice")).alias("tag"), "step", (2 * F.col("value") + 1).alias("value"))
    copy = c.withColumn("tag", F.concat("tag", F.lit("/copy")))
    found = N.pairwise_identities(c.unionByName(twice).unionByName(copy))
    return found.where("kind in ('identical', 'affine')").select("run", "x", "y", "n", "kind")


@query(""", w as (select run, step, max(value) filter (tag like '%/s') as s, max(value) filter (tag like '%/m') * max(value) filter (tag like '%/c') as mc, string_split(tag, '/')[2] as kind from fact group by run, step, string_split(tag, '/')[2])
select run, kind, count(abs(s - mc)) as n, case when count(abs(s - mc)) = 0 then 'not comparable' when max(abs(s - mc) / greatest(abs(s), abs(mc), 1e-12)) <= 1e-9 then 'exact' when max(abs(s - mc) / greatest(abs(s), abs(mc), 1e-12)) <= 1e-3 then 'near' else 'broken' end as verdict from w group by all""")
def ano19_identity_check(v):
    kind, stat = F.split("tag", "/")[1], F.split("tag", "/")[2]
    wide = v.fact.groupBy("run", "step", kind.alias("kind")).agg(*(F.max(F.when(stat == s, F.col("value"))).alias(s) for s in ("s", "m", "c")))
    return N.identity_check(wide, ["run", "kind"], F.col("s"), F.col("m") * F.col("c")).select("run", "kind", "n", "verdict")


@query("""select 'steps are contiguous' as rule, run, case when max(step) - min(step) + 1 = count(*) then 'ok' else 'fail' end as verdict from axis group by run
union all select 'walls rise', run, case when count(*) filter (wall <= before) = 0 then 'ok' else 'fail' end from (select *, lag(wall) over (partition by run order by step) as before from axis) group by run
union all select 'counts are positive', run, case when min(value) > 0 then 'ok' else 'fail' end from fact where tag like '%/c' group by run
union all select 'no series is empty', run, case when count(*) filter (n = 0) = 0 then 'ok' else 'warn' end from (select run, tag, count(value) as n from fact group by all) group by run""")
def ano20_self_check(v):
    w = Window.partitionBy("run").orderBy("step")
    rules = [
        ("steps are contiguous", v.axis.groupBy("run").agg((F.max("step") - F.min("step") + 1 == F.count("*")).alias("ok")), "fail"),
        ("walls rise", v.axis.withColumn("before", F.lag("wall").over(w)).groupBy("run").agg((F.count_if(F.col("wall") <= F.col("before")) == 0).alias("ok")), "fail"),
        ("counts are positive", v.fact.where("tag like '%/c'").groupBy("run").agg((F.min("value") > 0).alias("ok")), "fail"),
        ("no series is empty", v.fact.groupBy("run", "tag").agg(F.count("value").alias("n")).groupBy("run").agg((F.count_if(F.col("n") == 0) == 0).alias("ok")), "warn"),
    ]
    out = None
    for rule, rows, otherwise in rules:
        one = rows.select(F.lit(rule).alias("rule"), "run", F.when(F.col("ok"), "ok").otherwise(otherwise).alias("verdict"))
        out = one if out is None else out.unionByName(one)
    return out
