"""Queries: further paths, windows, associations and checks."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from runlens.functions import paths as P
from runlens.operators import association as A
from runlens.operators import changes as G
from runlens.operators import sequence as S

from .catalog import query
from .statistics import ANCHOR, KEY, PAIRS, R, pairs


@query("select distinct tag, case when tag like 'events/error/%' then 'faults' when tag like '%/c' then 'volume' when tag like '%/sd' then 'spread' else 'level' end as family from fact")
def prj07_family_by_prefix(v):
    return v.fact.select("tag").distinct().select("tag", P.first_match(F.col("tag"), [("^events/error/", "faults"), ("/c$", "volume"), ("/sd$", "spread")], "level").alias("family"))


@query(r"""select distinct p_type, regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '_[0-9]+$', '_<k>') as key from part""")
def prj08_key_normal_form(v):
    key = F.regexp_replace(F.regexp_replace(F.lower("p_type"), "[^a-z0-9]+", "_"), "_[0-9]+$", "_<k>")
    return v.table("part").select("p_type", key.alias("key")).distinct()


@query(""", rules(priority, kind, pattern, grp) as (values (1, 'exact', 'events/view/m', 'attention'), (2, 'prefix', 'events/purchase/', 'revenue'), (3, 'prefix', 'events/', 'traffic')),
m as (select distinct tag, arg_min(grp, priority) over (partition by tag) as grp from (select distinct tag from fact) t join rules on (kind = 'exact' and tag = pattern) or (kind = 'prefix' and starts_with(tag, pattern)))
select tag, grp from m""")
def prj11_group_lookup(v):
    rules = v.spark.createDataFrame([(1, "exact", "events/view/m", "attention"), (2, "prefix", "events/purchase/", "revenue"), (3, "prefix", "events/", "traffic")], "priority int, kind string, pattern string, grp string")
    return P.ranked_lookup(v.fact.select("tag").distinct(), "tag", rules)


@query(""", t(template) as (values ('events/*/m'), ('events/view/*'), ('lines/?'))
select template, tag from t join (select distinct tag from fact) f on regexp_full_match(tag, replace(replace(template, '*', '[^/]+'), '?', '.'))""")
def prj12_templates(v):
    t = v.spark.createDataFrame([("events/*/m",), ("events/view/*",), ("lines/?",)], "template string")
    return P.template_matches(t, v.fact.select("tag").distinct())


@query("select distinct tag, case when tag like '%/s' then 'sum of events' when tag like '%/c' then 'counter' end as reason from fact")
def prj19_mechanical(v):
    return v.fact.select("tag").distinct().select("tag", P.first_match(F.col("tag"), [("/s$", "sum of events"), ("/c$", "counter")]).alias("reason"))


@query("select distinct tag, regexp_matches(tag, '/(m|sd)$') as is_ratio, regexp_matches(tag, '/(c|s)$') as is_count from fact")
def prj21_suffix_kinds(v):
    return v.fact.select("tag").distinct().select("tag", F.col("tag").rlike("/(m|sd)$").alias("is_ratio"), F.col("tag").rlike("/(c|s)$").alias("is_count"))


@query(""", n as (select item_id, 'Restart of r' || (item_id % 2) || ' at Step ' || (item_id * 3) || case when item_id % 3 = 0 then ' after out of memory' when item_id % 3 = 1 then ' by node loss' else '' end as text from benchmark)
select item_id, regexp_extract(text, '(r[0-9]+)', 1) as run, regexp_extract(text, '(?i)step\\s*([0-9]+)', 1)::int as step, case when text like '%memory%' then 'memory' when text like '%node%' then 'hardware' else 'unknown' end as reason from n""")
def prj22_mentions(v):
    cause = F.when(F.col("item_id") % 3 == 0, " after out of memory").when(F.col("item_id") % 3 == 1, " by node loss").otherwise("")
    text = F.concat(F.lit("Restart of r"), (F.col("item_id") % 2).cast("string"), F.lit(" at Step "), (F.col("item_id") * 3).cast("string"), cause)
    n = v.table("benchmark").select("item_id", text.alias("text"))
    return n.select("item_id", *P.mentions(F.col("text"), [("memory", "memory"), ("node", "hardware")]))


@query(""", l as (select '#step/r' || (n_nationkey % 2) || '/' || n_nationkey || case when n_nationkey % 3 = 0 then '/events%2Fview%2Fm' else '' end as link from nation)
select link, string_split(link, '/')[2] as run, string_split(link, '/')[3]::int as step, url_decode(string_split(link, '/')[4]) as anchor from l""")
def prj23_deep_links(v):
    tail = F.when(F.col("n_nationkey") % 3 == 0, "/events%2Fview%2Fm").otherwise("")
    links = v.table("nation").select(F.concat(F.lit("#step/r"), (F.col("n_nationkey") % 2).cast("string"), F.lit("/"), F.col("n_nationkey").cast("string"), tail).alias("link"))
    part = F.split("link", "/")
    return links.select("link", part[1].alias("run"), part[2].cast("int").alias("step"), F.url_decode(F.get(part, F.lit(3))).alias("anchor"))


@query(""", c as (select run, tag, step, value, sum(value) over (partition by run, tag order by step) as total, value > 6 as reset from fact where tag like '%/c'),
s as (select *, sum(reset::int) over (partition by run, tag order by step rows unbounded preceding) as segment from c)
select run, tag, segment, count(*) as n, round(sum(value), 4) as total from s group by all""")
def win10_reset_segments(v):
    c = v.fact.where("tag like '%/c'").withColumn("reset", F.col("value") > 6)
    s = S.with_segment(c, F.col("reset"), ("run", "tag"), "step")
    return s.groupBy("run", "tag", "segment").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(""", p as (select run, tag, step, value, row_number() over (partition by run, tag order by step) as i, count(*) over (partition by run, tag) as n from fact where value is not null),
cuts as (select a.run, a.tag, a.i as k, a.n, median(b.value) filter (b.i <= a.i) as before, median(b.value) filter (b.i > a.i) as after, max(b.value) filter (b.i <= a.i) as hi0, min(b.value) filter (b.i <= a.i) as lo0,
max(b.value) filter (b.i > a.i) as hi1, min(b.value) filter (b.i > a.i) as lo1 from p a join p b using (run, tag) where a.i >= 3 and a.n - a.i >= 3 group by a.run, a.tag, a.i, a.n),
r as (select *, greatest(before / nullif(after, 0), after / nullif(before, 0)) as ratio, hi0 < lo1 or hi1 < lo0 as disjoint from cuts), o as (select *, row_number() over (partition by run, tag order by round(ratio, 9) desc, k) as rk from r)
select run, tag, k::int as k, round(ratio, 9) as ratio, disjoint from o where rk = 1""")
def win19_level_shift(v):
    s = G.level_shift(v.fact, 3)
    return s.select("run", "tag", "k", F.round("ratio", 9).alias("ratio"), "disjoint")


@query(""", b as (select unnest([8, 16, 24]) as boundary), m as (select run, tag, boundary, median(value) filter (step < boundary) as before, median(value) filter (step >= boundary) as after from fact, b where value is not null group by all)
select run, tag, boundary::int as boundary, round(after / nullif(before, 0), 9) as ratio from m where before is not null and after is not null""")
def win20_version_drift(v):
    return G.boundary_drift(v.fact, [8, 16, 24]).withColumn("ratio", F.round("ratio", 9))


@query(""", j as (select run, tag, step, avg(value) over (w rows between current row and 2 following) - avg(value) over (w rows between 3 preceding and 1 preceding) as jump from fact where value is not null window w as (partition by run, tag order by step)),
q as (select run, tag, quantile_cont(abs(jump), 0.9) as q90 from j where jump is not null group by all)
select run, tag, round(abs(jump), 9) as jump, round(q90, 9) as q90, round(abs(jump), 9) > round(q90, 9) as unusual from j join q using (run, tag) where step = 15""")
def win21_boundary_jump(v):
    j = G.boundary_jumps(v.fact, 15, 3, 0.9)
    return j.select("run", "tag", F.round("jump", 9).alias("jump"), F.round("limit", 9).alias("q90"), (F.round("jump", 9) > F.round("limit", 9)).alias("unusual"))


@query(f"""{PAIRS}, ranked as (select run, tag, x, y, rank() over (partition by run, tag order by x) + (count(*) over (partition by run, tag, x) - 1) / 2 as rx,
rank() over (partition by run, tag order by y) + (count(*) over (partition by run, tag, y) - 1) / 2 as ry from pairs)
select run, tag, count(*) as n, round({R}, 6) as r, round(covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0), 6) as rho from ranked group by all having count(*) >= 3""")
def sta04_record(v):
    p = pairs(v)
    r = p.groupBy(*KEY).agg(A.pearson("x", "y").alias("r"))
    return A.spearman(p, KEY).where("n >= 3").join(r, KEY).select(*KEY, "n", F.round("r", 6).alias("r"), F.round("rho", 6).alias("rho"))


@query(f""", d as (select run, tag, step, (value - lag(value) over w) / nullif(lag(value) over w, 0) as y, lag(step) over w = step - 1 as near from fact window w as (partition by run, tag order by step)),
x as (select run, step, y as x from d where tag = '{ANCHOR}' and near and y is not null), p as (select tag, x, y from d join x using (run, step) where near and y is not null and tag <> '{ANCHOR}')
select tag, count(*) as n, round(case when count(*) >= 3 then {R} end, 6) as r from p group by tag""")
def sta10_pooled(v):
    d = S.with_difference(v.fact).withColumn("value", F.try_divide("delta", F.lag("value").over(S.along())))
    p = A.with_anchor(d.where(F.col("tag") != ANCHOR), d.where(F.col("tag") == ANCHOR))
    return p.groupBy("tag").agg(F.count("*").alias("n"), F.round(A.pearson("x", "y"), 6).alias("r"))


@query(""", x as (select run, tag, step, value, row_number() over (partition by run, tag order by abs(step - m) desc, step) as far from (select *, avg(step) over (partition by run, tag) as m from fact where value is not null))
select run, tag, count(*) as n, round(regr_slope(value, step), 9) as slope from x where far > 1 group by all having count(*) >= 5""")
def sta19_leverage_drop(v):
    return A.without_leverage(v.fact.where("value is not null"), ("run", "tag")).where("n >= 5").select(*KEY, "n", F.round("slope", 9).alias("slope"))


@query(f"""{PAIRS} select run, tag, count(*) as n, round(regr_slope(y, x), 6) as level, round(regr_slope(ln(y), ln(x)) , 6) as elasticity from pairs where x > 0 and y > 0 group by all having count(*) >= 6""")
def sta20_elasticity(v):
    p = pairs(v).where("x > 0 and y > 0").withColumns({"lx": F.ln("x"), "ly": F.ln("y")})
    return p.groupBy(*KEY).agg(F.count("*").alias("n"), F.round(F.regr_slope("y", "x"), 6).alias("level"), F.round(F.regr_slope("ly", "lx"), 6).alias("elasticity")).where("n >= 6")


@query(""", q as (select dataset, step::double as x, rate as y from panel where rate is not null), c as (select dataset, x - avg(x) over (partition by dataset) as x, y from q),
s as (select dataset, count(*) as n, sum(x) as sx, sum(x ** 2) as s2, sum(x ** 3) as s3, sum(x ** 4) as s4, sum(y) as sy, sum(x * y) as sxy, sum(x ** 2 * y) as s2y from c group by dataset),
d as (select *, n * (s2 * s4 - s3 * s3) - sx * (sx * s4 - s3 * s2) + s2 * (sx * s3 - s2 * s2) as det from s)
select dataset, n, round((n * (s2 * s2y - s3 * sxy) - sx * (sx * s2y - s2 * sxy) + sy * (sx * s3 - s2 * s2)) / nullif(det, 0), 9) as curve from d where n >= 10""")
def sta18_quadratic(v):
    return A.quadratic(v.panel, ["dataset"], "step", "rate").where("n >= 10").select("dataset", "n", F.round("curve", 9).alias("curve"))


@query(""", d as (select *, case when lag(step) over w = step - 1 then abs(value - lag(value) over w) end as delta, abs(lag(value) over w) as before from fact window w as (partition by run, tag order by step)),
s as (select run, tag, count(value) as n, count(*) filter (value <> 0) / nullif(count(value), 0) as nonzero, count(distinct value) as kinds, max(delta / nullif(before, 0)) as jump from d group by all)
select run, tag, round(jump, 6) as jump from s where nonzero >= 0.6 and kinds >= 5 and jump >= 0.15""")
def ano06_jump_candidates(v):
    d = S.with_difference(v.fact).withColumn("rel", F.try_divide(F.abs("delta"), F.abs(F.lag("value").over(S.along()))))
    s = d.groupBy(*KEY).agg(F.try_divide(F.count_if(F.col("value") != 0), F.count("value")).alias("nonzero"), F.count_distinct("value").alias("kinds"), F.max("rel").alias("jump"))
    return s.where("nonzero >= 0.6 and kinds >= 5 and jump >= 0.15").select(*KEY, F.round("jump", 6).alias("jump"))


@query("""select dataset, count(*) as n, count(*) filter (rate = 0) as zeros, min(rate) filter (rate > 0) is not null and count(*) filter (rate = 0) > 0 as suspicious from panel group by dataset""")
def ano11_suspicious_zeros(v):
    zero = F.count_if(F.col("rate") == 0)
    return v.panel.groupBy("dataset").agg(F.count("*").alias("n"), zero.alias("zeros"), ((F.count_if(F.col("rate") > 0) > 0) & (zero > 0)).alias("suspicious"))


@query(""", s as (select run, event_type as source, step, count(*) filter (value > 20) as accepted, case when step % 6 <> 0 then count(value) end as judged, count(*) filter (value is not null and event_id % 50 <> 0) as logged from ev group by run, event_type, step)
select run, step, sum(accepted)::bigint as accepted, coalesce(sum(judged), 0)::bigint + coalesce(sum(accepted) filter (judged is null), 0)::bigint as judged, max(total) as total, bool_and(coalesce(accepted <= logged, true)) as within,
max(total) = coalesce(sum(judged), 0) + coalesce(sum(accepted) filter (judged is null), 0) as adds_up from s join (select run, step, count(value) as total from ev group by all) using (run, step) group by run, step""")
def ano21_sampler_identities(v):
    """Per step: the sources' judged entries, or accepted ones where none are stated, against the run's own count; and accepted ones against those logged."""
    s = v.ev.groupBy("run", F.col("event_type").alias("source"), "step").agg(
        F.count_if(F.col("value") > 20).alias("accepted"), F.when(F.col("step") % 6 != 0, F.count("value")).alias("judged"), F.count_if(F.col("value").isNotNull() & (F.col("event_id") % 50 != 0)).alias("logged")
    )
    own = v.ev.groupBy("run", "step").agg(F.count("value").alias("total"))
    summed = s.groupBy("run", "step").agg(F.sum("accepted").alias("accepted"), F.sum(F.coalesce("judged", "accepted")).alias("judged"), F.min(F.col("accepted") <= F.col("logged")).alias("within"))
    return summed.join(own, ["run", "step"]).select("run", "step", "accepted", "judged", "total", "within", (F.col("total") == F.col("judged")).alias("adds_up"))


@query(""", f as (select tag, min(step) as first_step from fact where value is not null group by tag) select first_step, count(*) as cohort from f group by first_step""")
def ano24_cohorts(v):
    return v.fact.where("value is not null").groupBy("tag").agg(F.min("step").alias("first_step")).groupBy("first_step").agg(F.count("*").alias("cohort"))


@query(""", t as (select distinct tag from fact), docs(pattern) as (values ('^events/view/'), ('/c$'))
select tag, bool_or(regexp_matches(tag, pattern)) as covered from t, docs group by tag""")
def ano26_coverage(v):
    docs = v.spark.createDataFrame([("^events/view/",), ("/c$",)], "pattern string")
    return P.covered(v.fact.select("tag").distinct(), "tag", docs)


@query(""", claims as (select run, tag, max(value) as claimed from fact where step <= 20 group by all), s as (select run, tag, max(value) as now from fact group by all)
select run, tag, round(claimed, 9) as claimed, round(now, 9) as now, case when claimed is null or now is null then 'not there' when abs(now - claimed) / greatest(abs(now), abs(claimed), 1e-12) <= 0.001 then 'ok' else 'stale' end as verdict from s left join claims using (run, tag)""")
def ano27_claims(v):
    """Claims made at step 20, the largest value of each series so far, against what the series says now."""
    from runlens.functions.formats import relative_error

    claims = v.fact.where("step <= 20").groupBy("run", "tag").agg(F.max("value").alias("claimed"))
    found = v.fact.groupBy("run", "tag").agg(F.max("value").alias("now")).join(claims, ["run", "tag"], "left")
    verdict = F.when(F.col("claimed").isNull() | F.col("now").isNull(), "not there").when(relative_error(F.col("now"), F.col("claimed")) <= 0.001, "ok").otherwise("stale")
    return found.select("run", "tag", F.round("claimed", 9).alias("claimed"), F.round("now", 9).alias("now"), verdict.alias("verdict"))


@query(""", recursive_edges as (select c_custkey as a, c_custkey + 1 as b from customer where c_custkey % 5 in (1, 2)), both_ as (select a, b from recursive_edges union all select b, a from recursive_edges),
reach as (with recursive r(n, m) as (select a, a from both_ union select r.n, both_.b from r join both_ on r.m = both_.a) select * from r)
select n as node, min(m) as component from reach group by n""")
def ano16_identity_clusters(v):
    from runlens.operators.clusters import connected

    k = v.table("customer").where("c_custkey % 5 in (1, 2)")
    return connected(k.select(F.col("c_custkey").alias("a"), (F.col("c_custkey") + 1).alias("b")))


@query("select run, tag, step, round(value, 9) as value from (select *, count(value) over (partition by run, tag) / count(*) over (partition by run, tag) as cover, stddev_pop(value) over (partition by run, tag) as sd from fact) where cover >= 0.8 and sd > 0")
def mlt01_cohort_rows(v):
    w = Window.partitionBy(*KEY)
    kept = v.fact.withColumns({"cover": F.count("value").over(w) / F.count("*").over(w), "sd": F.stddev_pop("value").over(w)}).where("cover >= 0.8 and sd > 0")
    return kept.select(*KEY, "step", F.round("value", 9).alias("value"))


@query(""", a as (select run, tag, value from fact where step = 5), b as (select run, tag, value from fact where step = 20)
select tag, count(*) as runs, round(avg(b.value - a.value), 9) as mean_change from a join b using (run, tag) where a.value is not null and b.value is not null group by tag""")
def dom32_gap(v):
    a, b = (v.fact.where((F.col("step") == s) & F.col("value").isNotNull()).select("run", "tag", F.col("value").alias(f"v{s}")) for s in (5, 20))
    return a.join(b, ["run", "tag"]).groupBy("tag").agg(F.count("*").alias("runs"), F.round(F.avg(F.col("v20") - F.col("v5")), 9).alias("mean_change"))
