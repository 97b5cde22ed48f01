"""Queries: context of a step, replayed snapshots, pools, ledgers and registry checks."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from runlens.functions import text as T
from runlens.functions.distributions import student_quantile
from runlens.operators import context as X
from runlens.operators import curves as U
from runlens.operators.sequence import with_segment
from runlens.operators.temporal import as_of
from runlens.sources.documents import metric_lines

from .catalog import query


@query(""", w as (select run, unnest([0, 1, 15, 400]) as wanted from (select distinct run from axis)),
f as (select run, wanted, max(case when step <= wanted then step end) as below, min(step) as first from w join axis using (run) group by all)
select run, wanted, coalesce(below, first) as step, case when below is null then 'before the first step' when below < wanted then 'step not there yet' else 'exact' end as caveat from f""")
def ano04_resolved_step(v):
    wanted = v.axis.select("run").distinct().withColumn("wanted", F.explode(F.array(*map(F.lit, (0, 1, 15, 400)))))
    return X.resolved_step(v.axis, wanted)


@query(""", n as (select run, event_id as notice_id, t as seen from ev where event_type = 'signup'),
near as (select n.run, notice_id, seen, t as anchor, row_number() over (partition by notice_id order by abs(t - seen), t) as k from n join restarts r on r.run = n.run and abs(t - seen) <= 1800),
covered as (select r.event_id, notice_id, r.t - seen as delta, row_number() over (partition by r.event_id order by seen, notice_id) as k from near join restarts r on r.run = near.run and abs(r.t - anchor) <= 600 where near.k = 1)
select event_id, run, notice_id, round(delta, 6) as delta from restarts left join (select * from covered where k = 1) using (event_id)""")
def jon11_attributed_restarts(v):
    notices = v.ev.where("event_type = 'signup'").select("run", F.col("event_id").alias("notice_id"), "t")
    return X.attributed(v.restarts, notices, 1800.0, 600.0).withColumn("delta", F.round("delta", 6))


@query(""", wide as (select run, step, string_split(tag, '/')[2] as kind, max(case when tag like '%/c' then value end) as c, max(case when tag like '%/m' then value end) as m, max(case when tag like '%/s' then value end) as s,
max(case when tag like '%/lo' then value end) as lo, max(case when tag like '%/hi' then value end) as hi, max(case when tag like '%/sd' then value end) as sd from fact group by all),
r as (select unnest(['A sum', 'B low', 'C high', 'D spread', 'E range', 'F count']) as identity, unnest([abs(c * m - s) <= 1e-9 * greatest(abs(s), 1), lo <= m + 1e-9, m <= hi + 1e-9, sd >= 0, sd <= (hi - lo) * sqrt(c / (4 * nullif(c - 1, 0))) + 1e-9, c >= 1 and c = floor(c)]) as ok from wide)
select identity, count(ok) as n, count_if(not ok) as broken from r group by identity""")
def ano18_identities(v):
    """What sums, means, counts, extremes and spreads of one type and day must obey."""
    kind, stat = F.split("tag", "/")[1], F.split("tag", "/")[2]
    wide = v.fact.groupBy("run", "step", kind.alias("kind")).agg(*(F.max(F.when(stat == s, F.col("value"))).alias(s) for s in ("c", "m", "s", "lo", "hi", "sd")))
    c, m, s, lo, hi, sd = (F.col(x) for x in ("c", "m", "s", "lo", "hi", "sd"))
    rules = {
        "A sum": F.abs(c * m - s) <= 1e-9 * F.greatest(F.abs(s), F.lit(1.0)),
        "B low": lo <= m + 1e-9,
        "C high": m <= hi + 1e-9,
        "D spread": sd >= 0,
        "E range": sd <= (hi - lo) * F.sqrt(F.try_divide(c, 4 * (c - 1))) + 1e-9,
        "F count": (c >= 1) & (c == F.floor(c)),
    }
    long = wide.select(F.explode(F.array(*(F.struct(F.lit(n).alias("identity"), r.alias("ok")) for n, r in rules.items()))).alias("x")).select("x.*")
    return long.groupBy("identity").agg(F.count("ok").alias("n"), F.count_if(~F.col("ok")).alias("broken"))


@query(""", hit as (select run, list(distinct day) as days from (select run, (floor(t / 86400) - 19723)::int + 1 as day from restarts) group by run),
gaps as (select run, tag, list(step) as steps from fact where value is null group by all)
select run, tag, len(steps) as n_gaps, len(list_filter(steps, lambda x: not list_contains(days, x))) = 0 as only_at_restarts from gaps join hit using (run)""")
def ano25_restart_fingerprint(v):
    """Metrics whose gaps fall on days with restarts alone."""
    days = v.restarts.groupBy("run").agg(F.collect_set((F.floor(F.col("t") / 86400) - 19723).cast("int") + 1).alias("days"))
    gaps = v.fact.where("value is null").groupBy("run", "tag").agg(F.collect_list("step").alias("steps"))
    return gaps.join(days, "run").select("run", "tag", F.size("steps").cast("long").alias("n_gaps"), (F.size(F.array_except("steps", "days")) == 0).alias("only_at_restarts"))


@query(""", want as (select run, tag, unnest([2, 10, 99]) as step from (select distinct run, tag from fact)) select run, tag, step, round(value, 9) as value from want left join fact using (run, tag, step)""")
def prj04_cells(v):
    want = v.fact.select("run", "tag").distinct().withColumn("step", F.explode(F.array(F.lit(2), F.lit(10), F.lit(99))))
    return want.join(v.fact, ["run", "tag", "step"], "left").withColumn("value", F.round("value", 9))


@query(""", redo as (select distinct run, step from axis where step % 7 = 0)
select run, tag, step, round(case when redo.step is not null then coalesce(n.value, o.value) else coalesce(o.value, n.value) end, 9) as value from snap_old o full join snap_new n using (run, tag, step) left join redo using (run, step)""")
def mrg11_extended(v):
    """Stored cells stay; empty ones and those of redone steps take the incoming value."""
    redo = v.axis.where("step % 7 = 0").select("run", "step").withColumn("again", F.lit(True))
    both = v.snap_old.withColumnRenamed("value", "o").join(v.snap_new.withColumnRenamed("value", "n"), ["run", "tag", "step"], "full").join(redo, ["run", "step"], "left")
    return both.select("run", "tag", "step", F.round(F.when(F.col("again"), F.coalesce("n", "o")).otherwise(F.coalesce("o", "n")), 9).alias("value"))


@query(""", st as (select run || ':' || tag as run, max(step) filter (value is not null) as last_step, count(*) filter (value is null) as n_redo, count(*) % 14 as skips from snap_old group by all),
inc as (select run || ':' || tag as run, max(step) filter (value is not null and (step <= 19 or tag not like '%/m')) as new_step, count(*) filter (value is null and step <= 20) as new_redo from fact group by all),
w as (select run, case when st.run is null or last_step is null then 'no data' when last_step <> new_step then 'new steps' when new_redo > n_redo then 'redone steps' when skips >= 12 then 'full refresh due' else 'unchanged' end as why from inc left join st using (run))
select run, why = 'unchanged' as skip, why from w""")
def mrg13_skip_decision(v):
    """Each series as a stored and an incoming state: is there anything new in it?"""
    series, there = F.concat_ws(":", "run", "tag"), F.col("value").isNotNull()
    stored = v.snap_old.groupBy(series.alias("run")).agg(F.max(F.when(there, F.col("step"))).alias("last_step"), F.count_if(~there).alias("n_redo"), (F.count("*") % 14).alias("skips"))
    seen = there & ((F.col("step") <= 19) | ~F.col("tag").endswith("/m"))
    incoming = v.fact.groupBy(series.alias("run")).agg(F.max(F.when(seen, F.col("step"))).alias("last_step"), F.count_if(~there & (F.col("step") <= 20)).alias("n_redo"))
    return X.skip_decision(stored, incoming)


CAPTURES = """, k as (select unnest([1, 2, 3]) as capture), caps as (select capture, run, tag, step, case when step % 3 <> capture % 3 then value + 100 * capture end as value from fact, k where step <= 11 * capture),
again as (select run, step, 3 as capture from axis where step % 10 = 0)"""


@query(f"""{CAPTURES} select run, tag, step, round(coalesce(max_by(value, c.capture) filter (c.capture >= a.capture and value is not null), min_by(value, c.capture) filter (value is not null)), 9) as value
from caps c left join again a using (run, step) where value is not null group by run, tag, step""")
def mrg15_replayed(v):
    """Three snapshots in their order, with late values and redone steps."""
    k = v.spark.range(1, 4).select(F.col("id").cast("int").alias("capture"))
    value = F.when(F.col("step") % 3 != F.col("capture") % 3, F.col("value") + 100 * F.col("capture"))
    caps = v.fact.crossJoin(F.broadcast(k)).where("step <= 11 * capture").withColumn("value", value)
    again = v.axis.where("step % 10 = 0").select("run", "step", F.lit(3).alias("capture"))
    return X.replayed(caps, again).withColumn("value", F.round("value", 9))


@query(""", done as (select run, step, max(t) as wall from run_events where kind = 'step' group by all)
select event_id, max(done.step) as badge from ev left join done on ev.run = done.run and wall <= t where event_type = 'purchase' group by event_id""")
def win23_step_badge(v):
    """The step that was done last when each purchase came: an as-of join on the steps' last completions."""
    done = v.run_events.where("kind = 'step'").groupBy("run", "step").agg(F.max("t").alias("wall"))
    probes = v.ev.where("event_type = 'purchase'").select("event_id", "run", "t")
    return as_of(probes, done.withColumnRenamed("wall", "at"), ["run"], "t", "at", ["step"]).select("event_id", F.col("step").alias("badge"))


@query()
def sta13_critical_r(v):
    """The least correlation that is significant at 5 %, for each number of points that occurs."""
    n = v.fact.where("value is not null").groupBy("run", "tag").agg(F.count("*").alias("n")).select("n").distinct().where("n > 2")
    crit = F.pandas_udf(lambda s: s.map(lambda k: (t := student_quantile(0.975, k - 2)) / (t * t + k - 2) ** 0.5), "double")
    return n.select("n", F.round(crit("n"), 9).alias("critical"))


@query()
def tst11_shuffle_permutation(v):
    return U.shuffle_permutation_p(v.fact, ["run", "tag"])


@query(""", pool as (select run, part, step, max(case when stat = 'c' then value end) as accepted, max(case when stat = 'hi' then value end) as held, max(case when stat = 'lo' then value end) as carryover
from (select run, string_split(tag, '/')[2] as part, string_split(tag, '/')[3] as stat, step, value from fact) group by all),
size as (select run, step, sum(accepted) + (step % 2) * 1000 as size from pool group by run, step),
i as (select *, greatest(0, lag(held) over (partition by run, part order by step) + accepted - held) as raw from (select p.*, size from pool p join size using (run, step))),
j as (select *, case when lag(held) over (partition by run, part order by step) is not null then raw end as implied from i),
t as (select *, sum(implied) over w as total, count(implied) over w = count(*) over w as known, sum(carryover) over w as carried, sum(accepted) over w as fresh from j window w as (partition by run, step)),
u as (select *, known and abs(total - size) <= 0.05 * size as sane from t)
select run, part, step, round(case when sane then implied else carryover + accepted * greatest(0, size - carried) / case when fresh = 0 then 1 else fresh end end, 6) as trained, not sane as approx from u""")
def dom06_trained_shares(v):
    part, stat = F.split("tag", "/")[1], F.split("tag", "/")[2]
    pool = v.fact.groupBy("run", part.alias("part"), "step").agg(*(F.max(F.when(stat == s, F.col("value"))).alias(n) for s, n in (("c", "accepted"), ("hi", "held"), ("lo", "carryover"))))
    target = pool.groupBy("run", "step").agg((F.sum("accepted") + F.col("step") % 2 * 1000).alias("size"))
    return X.trained_shares(pool, target).withColumn("trained", F.round("trained", 6))


@query(""", q as (select p_brand as dataset, p_type as kind, ((year(l_shipdate) - 1995) * 4 + quarter(l_shipdate))::int as step, l_returnflag, l_quantity from lineitem join part on l_partkey = p_partkey),
m as (select kind, step, avg((l_returnflag = 'A')::int::double) as zero, avg((l_returnflag = 'R')::int::double) as one, avg(case l_returnflag when 'R' then 1.0 when 'A' then 0.0 else l_quantity / 100 end) as mean from q group by all),
r as (select *, 1 - zero - one as big, (mean - one) / (1 - zero - one) as m from m where zero + one <> 1),
e as (select kind, arg_min(mean, step) as a1, arg_max(mean, step) as z1, arg_min(one, step) as a2, arg_max(one, step) as z2, arg_min(big, step) as a3, arg_max(big, step) as z3, arg_min(m, step) as a4, arg_max(m, step) as z4 from r group by kind)
select kind, round(z1 - a1, 8) as d_mean, round(z2 - a2, 8) as solved, round((a4 + z4) / 2 * (z3 - a3), 8) as pool_loss, round((a3 + z3) / 2 * (z4 - a4), 8) as within_pool,
round((z1 - a1) - (z2 - a2) - (a4 + z4) / 2 * (z3 - a3) - (a3 + z3) / 2 * (z4 - a4), 8) + 0.0 as interaction from e""")
def dom18_pool_decomposition(v):
    line = v.table("lineitem").select("l_partkey", "l_quantity", "l_returnflag", "l_shipdate")
    part = v.table("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("kind"))
    step = ((F.year("l_shipdate") - 1995) * 4 + F.quarter("l_shipdate")).cast("int")
    flag = F.col("l_returnflag")
    mean = F.when(flag == "R", 1.0).when(flag == "A", 0.0).otherwise(F.col("l_quantity") / 100)
    rows = line.join(part, "l_partkey").groupBy("kind", step.alias("step")).agg(F.avg((flag == "A").cast("double")).alias("zero"), F.avg((flag == "R").cast("double")).alias("one"), F.avg(mean).alias("mean"))
    d = X.pool_decomposition(rows, ["kind"])
    return d.select("kind", *((F.round(c, 8) + F.lit(0.0)).alias(c) for c in d.columns[1:]))


@query(""", s as (select run, step, wall, lag(wall) over (partition by run order by step) as low from axis), rep as (select run, step, max(t) - min(t) as seconds from ev where event_type = 'view' group by all),
i as (select s.run, s.step, wall, low, max(t) as last, min(t) as first from s join restarts r on r.run = s.run and t > low and t <= wall group by all),
j as (select run, step, wall - low - seconds as gap, last - low as before_last, wall - last as tail, last - first as between_ from i join rep using (run, step))
select run, step, round(gap, 3) as gap, round(before_last, 3) as before_last, round(tail, 3) as tail, round(between_, 3) as between_, between_ <= gap as explained, gap < 0 as overlong from j""")
def dom23_gap_attribution(v):
    """Unreported time of steps with restarts: does the stretch from the first restart to the last fit into it, and is more time reported than went by?"""
    reported = v.ev.where("event_type = 'view'").groupBy("run", "step").agg((F.max("t") - F.min("t")).alias("seconds"))
    g = X.gap_attribution(v.axis, v.restarts, reported)
    explained, overlong = (F.col("between") <= F.col("gap")).alias("explained"), (F.col("gap") < 0).alias("overlong")
    return g.select("run", "step", F.round("gap", 3).alias("gap"), F.round("before_last", 3).alias("before_last"), F.round("tail", 3).alias("tail"), F.round("between", 3).alias("between_"), explained, overlong)


@query(""", j as (select run, step, max(case when tag = 'events/error/c' then value end) as groups, max(case when tag = 'events/error/m' then value end) as seconds from fact group by all),
s as (select run, step, wall - lag(wall) over (partition by run order by step) as real_s from axis)
select run, step, round(groups * seconds / real_s, 9) as concurrent, round(median(groups * seconds / real_s) over (partition by run), 9) as usual from j join s using (run, step) where real_s > 0 and groups > 0 and seconds is not null""")
def dom21_grader_concurrency(v):
    """Groups judged at once: groups times seconds a group over the step's real time."""
    pick = lambda t: F.max(F.when(F.col("tag") == t, F.col("value")))
    judged = v.fact.groupBy("run", "step").agg(pick("events/error/c").alias("groups"), pick("events/error/m").alias("seconds"))
    real = v.axis.select("run", "step", (F.col("wall") - F.lag("wall").over(Window.partitionBy("run").orderBy("step"))).alias("real_s"))
    rows = judged.join(real, ["run", "step"]).where("real_s > 0 and groups > 0 and seconds is not null").withColumn("c", F.col("groups") * F.col("seconds") / F.col("real_s"))
    return rows.select("run", "step", F.round("c", 9).alias("concurrent"), F.round(F.median("c").over(Window.partitionBy("run")), 9).alias("usual"))


@query(""", cut as (select run, tag, step, value, sum(case when step % 8 = 0 then 1 else 0 end) over (partition by run, tag order by step) as segment from fact where value is not null),
r as (select *, rank() over x + (count(*) over (partition by run, tag, segment, value) - 1) / 2.0 as ry, row_number() over (partition by run, tag, segment order by step) as rx from cut window x as (partition by run, tag, segment order by value))
select run, tag, segment::int as segment, count(*) as n, round(covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0), 6) as rho from r group by all having count(*) >= 3""")
def dom25_staleness_chain(v):
    """Spearman's correlation with time within the segments between resets."""
    s = with_segment(v.fact.where("value is not null"), F.col("step") % 8 == 0, ("run", "tag"), "step").withColumn("segment", F.col("segment").cast("int"))
    w = Window.partitionBy("run", "tag", "segment")
    r = s.withColumns({"ry": F.rank().over(w.orderBy("value")) + (F.count("*").over(Window.partitionBy("run", "tag", "segment", "value")) - 1) / 2, "rx": F.row_number().over(w.orderBy("step"))})
    rho = F.try_divide(F.covar_pop("rx", "ry"), F.stddev_pop("rx") * F.stddev_pop("ry"))
    return r.groupBy("run", "tag", "segment").agg(F.count("*").alias("n"), F.round(rho, 6).alias("rho")).where("n >= 3")


@query(""", size as (select run, step, count(*) as n, coalesce(lag(count(*)) over (partition by run order by step), count(*)) as target, min(t) as t0, max(t) as t1 from ev group by run, step),
o as (select run, step, t, t0, t1, n, target, row_number() over (partition by run, step order by t, event_id) as done from ev join size using (run, step))
select run, step, any_value(n) as n, any_value(target) as target, max(done) >= any_value(target) as complete, round(avg(done / target::double - (t - t0) / nullif(t1 - t0, 0)), 9) as bias, count_if(done > target) as outside from o group by all""")
def dom27_progress_audit(v):
    """A step's progress as its events so far over those planned (as many as the step before had), against the share of its time: is it ever complete, above one, or biased?"""
    size = v.ev.groupBy("run", "step").agg(F.count("*").alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1"))
    size = size.withColumn("target", F.coalesce(F.lag("n").over(Window.partitionBy("run").orderBy("step")), "n"))  # a row a step
    o = v.ev.withColumn("done", F.row_number().over(Window.partitionBy("run", "step").orderBy("t", "event_id"))).join(F.broadcast(size), ["run", "step"])
    ahead = F.col("done") / F.col("target") - F.try_divide(F.col("t") - F.col("t0"), F.col("t1") - F.col("t0"))
    return o.groupBy("run", "step").agg(F.first("n").alias("n"), F.first("target").alias("target"), (F.max("done") >= F.first("target")).alias("complete"), F.round(F.avg(ahead), 9).alias("bias"), F.count_if(F.col("done") > F.col("target")).alias("outside"))


@query(""", d as (select *, coalesce(value < lag(value) over (partition by run, tag order by step), false) as cut from fact where value is not null),
g as (select *, sum(cut::int) over (partition by run, tag order by step) as segment from d),
l as (select run, tag, segment, count(*) as n, min(step) as first, max(step) as last, min(value) as low, max(value) as high from g group by all)
select run, tag, n, first, last, round(low, 9) as low, round(high, 9) as high from (select *, row_number() over (partition by run, tag order by n desc, segment) as k from l) where k = 1""")
def dom28_trajectory(v):
    """The longest rising stretch of each series."""
    cut = F.coalesce(F.col("value") < F.lag("value").over(Window.partitionBy("run", "tag").orderBy("step")), F.lit(False))
    s = with_segment(v.fact.where("value is not null").withColumn("cut", cut), F.col("cut"), ("run", "tag"), "step")
    l = s.groupBy("run", "tag", "segment").agg(F.count("*").alias("n"), F.min("step").alias("first"), F.max("step").alias("last"), F.min("value").alias("low"), F.max("value").alias("high"))
    best = l.groupBy("run", "tag").agg(F.min_by(F.struct("n", "first", "last", "low", "high"), F.struct(-F.col("n"), "segment")).alias("b")).select("run", "tag", "b.*")
    return best.withColumns({"low": F.round("low", 9), "high": F.round("high", 9)})


KINDS = "case o_orderkey % 6 when 0 then 'ratio' when 1 then 'num2' when 2 then 'num1' when 3 then 'int' when 4 then 'gb' else 'num0' end"


@query(f"""select o_orderkey, case kind when 'int' then x::bigint::varchar when 'num0' then x::bigint::varchar when 'gb' then printf('%.1f GB', x) when 'num1' then printf('%.1f', x) when 'num2' then printf('%.2f', x) else printf('%.3f', x) end as text
from (select o_orderkey, {KINDS} as kind, floor(o_totalprice)::double as x from orders) union all select -1, '—'""")
def sca03_typed_text(v):
    o = v.table("orders").select("o_orderkey", F.expr(KINDS).alias("kind"), F.floor("o_totalprice").cast("double").alias("x"))
    none = v.spark.createDataFrame([(-1, "pct", None)], "o_orderkey long, kind string, x double")
    return o.unionByName(none).select("o_orderkey", X.typed_text(F.col("x"), F.col("kind")).alias("text"))


@query(""", dict as (select distinct source, 'Source ' || upper(source) || ' has {0} of {1} texts' as phrase from documents where source <> 'src3'),
n as (select source, lang, count(*) as n, sum(count(*)) over (partition by source) as total from documents group by source, lang)
select source, lang, replace(replace(coalesce(phrase, source), '{0}', n::varchar), '{1}', total::bigint::varchar) as text from n left join dict using (source)""")
def sca19_dictionary(v):
    d = v.table("documents").select("source", "lang")
    dictionary = d.where("source <> 'src3'").select("source", F.concat(F.lit("Source "), T.upper_by_character(F.col("source")), F.lit(" has {0} of {1} texts")).alias("phrase")).distinct()
    n = d.groupBy("source", "lang").agg(F.count("*").alias("n")).withColumn("total", F.sum("n").over(Window.partitionBy("source")))
    text = F.coalesce("phrase", "source")
    for i, c in enumerate(("n", "total")):
        text = F.replace(text, F.lit(f"{{{i}}}"), F.col(c).cast("string"))
    return n.join(dictionary, "source", "left").select("source", "lang", text.alias("text"))


@query(""", e as (select p_partkey, p_name, p_brand || '-' || p_type as base, p_size::varchar as quote from part), f as (select base, quote, min(p_partkey) as first from e group by all),
n as (select base, quote, row_number() over (partition by base order by first) as k from f)
select p_partkey, case when k = 1 then base else base || '-' || k end as id from e join n using (base, quote)""")
def sca21_suffixed_ids(v):
    e = v.table("part").select("p_partkey", F.concat_ws("-", "p_brand", "p_type").alias("base"), F.col("p_size").cast("string").alias("quote"))
    return X.suffixed_ids(e, "base", "quote", "p_partkey").select("p_partkey", "id")


@query(""", own as (select p_partkey as id, unnest([p_size, p_size, 60]) as ref, generate_subscripts([1, 2, 3], 1) as i from part where p_partkey % 3 <> 0), store as (select range::int as ref from range(1, 51)),
o as (select id, list(distinct ref) filter (ref in (select ref from store)) as refs, count(*) - count(distinct ref) as repeated, count_if(ref not in (select ref from store)) as unknown from own group by id)
select p_partkey as id, coalesce(list_sort(refs)[1], 0)::int as ref, refs is null as fallback, coalesce(repeated, 0) as repeated, coalesce(unknown, 0) as unknown from part left join o on id = p_partkey""")
def sca28_resolved_refs(v):
    """References of entries that the store knows, with a fallback where there are none; repeated and unknown ones counted."""
    part = v.table("part")
    own = part.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("id"), F.explode(F.array("p_size", "p_size", F.lit(60))).alias("ref"))
    store = v.spark.range(1, 51).select(F.col("id").cast("int").alias("ref"), F.lit(True).alias("known"))
    o = own.join(store, "ref", "left").groupBy("id").agg(
        F.min(F.when(F.col("known"), F.col("ref"))).alias("ref"), (F.count("*") - F.count_distinct("ref")).alias("repeated"), F.count_if(F.col("known").isNull()).alias("unknown")
    )
    j = part.select(F.col("p_partkey").alias("id")).join(o, "id", "left")
    return j.select("id", F.coalesce("ref", F.lit(0)).alias("ref"), F.col("ref").isNull().alias("fallback"), F.coalesce("repeated", F.lit(0)).alias("repeated"), F.coalesce("unknown", F.lit(0)).alias("unknown"))


@query(""", refs as (select distinct label as ref, 'events/' || (['signup', 'purchase', 'view', 'click', 'error'])[(label % 5 + 1)::int] as family from embeddings),
a as (select tag, ref, row_number() over (partition by tag order by ref) as k from (select distinct tag from fact) t join refs on starts_with(tag, family || '/'))
select tag, ref, k = 1 as first from a""")
def sca29_attached_refs(v):
    """References of a family go to all its members, the first of each marked."""
    kinds = F.array(*map(F.lit, ("signup", "purchase", "view", "click", "error")))
    refs = v.table("embeddings").select(F.col("label").alias("ref")).distinct().withColumn("family", F.concat(F.lit("events/"), F.get(kinds, F.pmod("ref", F.lit(5)))))
    tags = v.fact.select("tag").distinct().withColumn("family", F.regexp_extract("tag", "^(.*)/[^/]*$", 1))
    k = F.row_number().over(Window.partitionBy("tag").orderBy("ref"))
    return tags.join(refs, "family").select("tag", "ref", (k == 1).alias("first"))


@query()
def sca30_verified_titles(v):
    """Whether an entry's title is that of its source: a mismatch is a Jaccard below 0.6 and a containment below 0.9; and whether the text has the claimed title's first words."""
    b = v.table("benchmark").select("item_id", "text")
    title = F.array_join(F.slice(F.split("text", " "), 1, 9), " ")
    claimed = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("another name of "), F.reverse(title))).otherwise(title)
    words = F.array_join(F.slice(F.split(T.lower_by_character(claimed), " "), 1, 8), " ")
    r = b.select("item_id", T.word_set(claimed).alias("a"), T.word_set(title).alias("b"), (F.instr(T.lower_by_character(F.col("text")), words) > 0).alias("quoted"))
    j, c = T.jaccard(F.col("a"), F.col("b")), T.containment(F.col("b"), F.col("a"))
    return r.select("item_id", ((j < 0.6) & (c < 0.9)).alias("mismatch"), "quoted")


@query(""", c as (select p_partkey, p_name as en, case p_partkey % 4 when 0 then '' when 1 then p_name when 2 then p_name || ' 零件' else p_brand end as zh from part)
select p_partkey, case when zh = '' then 'empty' when not regexp_matches(zh, '[一-鿿]') then 'no Chinese' when lower(trim(zh)) = lower(trim(en)) then 'identical' else 'ok' end as verdict from c""")
def sca32_translation_check(v):
    zh = F.when(F.col("p_partkey") % 4 == 0, "").when(F.col("p_partkey") % 4 == 1, F.col("p_name")).when(F.col("p_partkey") % 4 == 2, F.concat("p_name", F.lit(" 零件"))).otherwise(F.col("p_brand"))
    verdict = F.when(F.col("zh") == "", "empty").when(~T.has_cjk(F.col("zh")), "no Chinese").when(F.lower(F.trim("zh")) == F.lower(F.trim("p_name")), "identical").otherwise("ok")
    return v.table("part").select("p_partkey", "p_name", zh.alias("zh")).select("p_partkey", verdict.alias("verdict"))


@query(""", c as (select run, tag, step, case when isfinite(value) then round(value, 6) end as value from fact)
select run, tag, count(*) as cells, count(value) as filled from c group by run, tag""")
def snk03_metric_lines(v):
    """The lines of metrics, counted back from their text."""
    cells = F.split(F.regexp_extract("line", r"\[(.*)\]", 1), ",")
    return metric_lines(v.fact).select("run", "tag", F.size(cells).cast("long").alias("cells"), F.size(F.filter(cells, lambda c: c != "null")).cast("long").alias("filled"))


@query(""", n as (select event_id as notice_id, t as seen, case when event_id % 3 = 0 then run end as hint_run, case when event_id % 4 = 0 then step end as hint_step from ev where event_type = 'signup'),
m as (select event_id, run, step, t from ev where event_type = 'error'),
near as (select notice_id, seen, m.run, m.t as anchor, row_number() over (partition by notice_id order by abs(m.t - seen), m.t, m.event_id) as k from n join m on abs(m.t - seen) <= 900 and (hint_run is null or hint_run = m.run) and (hint_step is null or abs(m.step - hint_step) <= 1)),
covered as (select m.event_id, notice_id, m.t - seen as delta, row_number() over (partition by m.event_id order by seen, notice_id) as k from near join m on m.run = near.run and abs(m.t - anchor) <= 300 where near.k = 1)
select event_id, run, notice_id, round(delta, 6) as delta from m left join (select * from covered where k = 1) using (event_id)""")
def jon11_attributed_by_hints(v):
    """Restarts beside notices of which some name a run, some a step, and some neither."""
    notices = v.ev.where("event_type = 'signup'").select(
        F.col("event_id").alias("notice_id"), "t", F.when(F.col("event_id") % 3 == 0, F.col("run")).alias("hint_run"), F.when(F.col("event_id") % 4 == 0, F.col("step")).alias("hint_step")
    )
    restarts = v.ev.where("event_type = 'error'").select("event_id", "run", "step", "t")
    return X.attributed_by_hints(restarts, notices, 900.0, 300.0).withColumn("delta", F.round("delta", 6))
