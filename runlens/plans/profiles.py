"""Queries: profiles of series, entries and their checks, names and snapshots."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from runlens.functions.distributions import student_quantile
from runlens.functions.formats import nice_step, significant
from runlens.functions.paths import first_match
from runlens.operators import profile as P
from runlens.operators.association import pearson
from runlens.operators.clusters import connected
from runlens.sources.telemetry import epoch

from .catalog import query

KEY = ("run", "tag")


def _rounded(digits, *names):
    return [F.round(n, digits).alias(n) for n in names]


@query(""", r as (select *, row_number() over w as i, lag(value) over w as before from fact window w as (partition by run, tag order by step)),
p as (select run, tag, count(*) as steps, count(value) as present, min(i) filter (value is not null) as lo, max(i) filter (value is not null) as hi, count(distinct value) as kinds,
max(case when value <> 0 and before <> 0 then greatest(abs(value / before), abs(before / value)) end) as factor from r group by all)
select run, tag, steps, present, coalesce(lo - 1, steps) as leading, coalesce(steps - hi, 0) as trailing, coalesce(hi - lo + 1 - present, 0) as interior,
case kinds when 0 then 'empty' when 1 then 'constant' when 2 then 'two-valued' else 'varying' end as kind, round(factor, 6) as factor from p""")
def agg16_profile(v):
    return P.profile(v.fact).withColumn("factor", F.round("factor", 6))


@query(""", p as (select f.run, f.tag, f.step, a.value as x, f.value as y from fact f join fact a using (run, step) where a.tag = 'events/view/m' and f.tag <> 'events/view/m' and a.value is not null and f.value is not null),
c as (select run, tag, count(*) as n, covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) as xy, covar_pop(x, step) / nullif(stddev_pop(x) * stddev_pop(step), 0) as xs,
covar_pop(y, step) / nullif(stddev_pop(y) * stddev_pop(step), 0) as ys from p group by all)
select run, tag, n, case when n >= 6 then round((xy - xs * ys) / nullif(sqrt(greatest((1 - xs * xs) * (1 - ys * ys), 0)), 0), 6) end as r from c""")
def sta08_partial(v):
    return P.partial_given_step(v.fact.where("tag <> 'events/view/m'"), v.fact.where("tag = 'events/view/m'")).withColumn("r", F.round("r", 6))


@query(""", p as (select a.bkey, a.run, median((b.value - a.value) / (b.step - a.step)) as slope from bench a join bench b on a.bkey = b.bkey and a.run = b.run and a.step < b.step where a.value is not null and b.value is not null group by all),
l as (select bkey, run, slope, median(value - slope * step) as intercept from bench join p using (bkey, run) where value is not null group by all),
e as (select bkey, run, step, value - intercept - slope * step as e, abs(value - lag(value) over (partition by bkey, run order by step)) as move from bench join l using (bkey, run) where value is not null),
m as (select *, abs(e - median(e) over (partition by bkey, run)) as off from e),
s as (select bkey, run, count(*) as n, 1.4826 * median(off) as sigma from m group by all)
select bkey, run, n, round(any_value(sigma), 6) as sigma, round(any_value(sigma) * 1.96 * sqrt(2), 6) as mde, count(*) filter (move > sigma * (1.96 * sqrt(2))) as beyond from s join m using (bkey, run) group by bkey, run, n""")
def tst17_detectable_change(v):
    d = P.detectable_change(v.bench, ["bkey", "run"])
    return d.select("bkey", "run", "n", *_rounded(6, "sigma", "mde"), "beyond")


@query(""", r as (select *, row_number() over (partition by run, tag order by step desc) as i from fact where value is not null),
f as (select run, tag, k, any_value(q) as q, count(*) as n, regr_slope(value, step) as slope, sqrt(greatest(regr_syy(value, step) - regr_slope(value, step) * regr_sxy(value, step), 0) / (k - 2) / regr_sxx(value, step)) as se
from r, (values (5, 3.182446305284263), (8, 2.446911851144979)) c(k, q) where i <= k group by run, tag, k)
select run, tag, k, round(slope, 6) as slope, round(slope - q * se, 6) as low, round(slope + q * se, 6) as high from f where n = k""")
def tst18_recent_trend(v):
    parts = [P.recent_trend(v.fact, k, student_quantile(0.975, k - 2)).withColumn("k", F.lit(k)) for k in (5, 8)]
    return parts[0].unionByName(parts[1]).select(*KEY, "k", *_rounded(6, "slope", "low", "high"))


@query(""", d as (select *, case when lag(step) over w = step - 1 then value - lag(value) over w end as delta from fact window w as (partition by run, tag order by step))
select run, tag, count(value) as n, round(1 - greatest(regr_syy(value, step) - regr_slope(value, step) * regr_sxy(value, step), 0) / nullif(regr_syy(value, step), 0), 6) as r2,
round(max(abs(delta)) / nullif(max(value) - min(value), 0), 6) as jump from d group by run, tag having count(value) >= 8""")
def ano09_shape(v):
    return P.shape(v.fact).select(*KEY, "n", *_rounded(6, "r2", "jump"))


@query(""", p as (select run, tag, step, row_number() over w as k, count(*) over e as n, sum(value) over (partition by run, tag order by step rows unbounded preceding) as s, sum(value) over e as t, sum(value * value) over e / count(*) over e as ms
from fact where value is not null window w as (partition by run, tag order by step), e as (partition by run, tag))
select run, tag, step, round(power(s / k - (t - s) / (n - k), 2) * k * (n - k) / n / nullif(ms, 0), 6) as gain from p where k >= 3 and k <= n - 3""")
def mlt13_split_profile(v):
    """Gains as shares of the series' mean square."""
    scale = v.fact.where("value is not null").groupBy("run", "tag").agg(F.avg(F.col("value") * F.col("value")).alias("ms"))
    return P.split_profile(v.fact).join(scale, ["run", "tag"]).select("run", "tag", "step", F.round(F.try_divide("gain", "ms"), 6).alias("gain"))


GROUPS = """, g as (select run, tag, split_part(tag, '/', 2) as part, step, value from fact where value is not null),
c as (select a.run, a.part, a.tag as x, b.tag as y, abs(covar_pop(a.value, b.value) / nullif(stddev_pop(a.value) * stddev_pop(b.value), 0)) as r
from g a join g b on a.run = b.run and a.part = b.part and a.step = b.step and a.tag < b.tag group by all having count(*) >= 3)"""


def _pairs(v):
    """Correlations of the series of one event type and run, whose number the statistics bound."""
    g = v.fact.where("value is not null").withColumn("part", F.split_part("tag", F.lit("/"), F.lit(2)))
    a, b = (g.select("run", "part", "step", F.col("tag").alias(t), F.col("value").alias(f"v{t}")) for t in ("x", "y"))
    met = a.join(b, ["run", "part", "step"]).where("x < y")
    return met.groupBy("run", "part", "x", "y").agg(F.abs(pearson("vx", "vy")).alias("r"), F.count("*").alias("n")).where("n >= 3")


@query(f"{GROUPS} select run, part, count(r) as pairs, round(avg(r), 6) as mean from c group by run, part")
def mlt17_copy_groups(v):
    return _pairs(v).groupBy("run", "part").agg(F.count("r").alias("pairs"), F.round(F.avg("r"), 6).alias("mean"))


@query(f"""{GROUPS}, l as (select run || ' ' || x as a, run || ' ' || y as b from c where r >= 0.9), both_ as (select a, b from l union all select b, a from l),
reach as (with recursive r(n, m) as (select a, a from both_ union select r.n, both_.b from r join both_ on r.m = both_.a) select * from r)
select n as node, min(m) as component from reach group by n""")
def ano17_near_duplicates(v):
    name = lambda c: F.concat_ws(" ", "run", c)
    return connected(_pairs(v).where("r >= 0.9").select(name("x").alias("a"), name("y").alias("b")))


@query("""select run, step, count(*) as n, count(*) filter (value < before) as drops, round(max(value), 9) as peak, round(arg_max(value, t), 9) as final
from (select *, lag(value) over (partition by run, step order by t, event_id) as before from ev where event_type = 'view') group by run, step""")
def ano22_within_steps(v):
    w = Window.partitionBy("run", "step").orderBy("t", "event_id")
    e = v.ev.where("event_type = 'view'").withColumn("before", F.lag("value").over(w))
    s = e.groupBy("run", "step").agg(F.count("*").alias("n"), F.count_if(F.col("value") < F.col("before")).alias("drops"), F.max("value").alias("peak"), F.max_by("value", "t").alias("final"))
    return s.select("run", "step", "n", "drops", *_rounded(9, "peak", "final"))


@query("""select p_brand as dataset, count(*) as n, round(avg((l_returnflag = 'R')::int), 9) as returned, round(avg((l_returnflag = 'A')::int), 9) as accepted, round(avg((l_linestatus = 'O')::int), 9) as open
from lineitem join part on l_partkey = p_partkey group by all""")
def dom20_outcome_shares(v):
    line = v.table("lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_returnflag", "l_linestatus")
    share = lambda c, x: F.round(F.avg((F.col(c) == x).cast("double")), 9)
    met = line.join(v.table("part").select("p_partkey", F.col("p_brand").alias("dataset")), "p_partkey")
    return met.groupBy("dataset").agg(F.count("*").alias("n"), share("l_returnflag", "R").alias("returned"), share("l_returnflag", "A").alias("accepted"), share("l_linestatus", "O").alias("open"))


@query(""", s as (select run, step, max(t) as wall, count(*) as events, count(*) filter (event_type = 'error') as restarts, sum(value) filter (event_type <> 'error') as work from ev group by run, step)
select run, step, round(wall - lag(wall) over (partition by run order by step), 3) as seconds, events, restarts, round(work, 4) as work from s""")
def dom31_step_table(v):
    work = F.sum(F.when(F.col("event_type") != "error", F.col("value")))
    s = v.ev.groupBy("run", "step").agg(F.max("t").alias("wall"), F.count("*").alias("events"), F.count_if(F.col("event_type") == "error").alias("restarts"), F.round(work, 4).alias("work"))
    w = Window.partitionBy("run").orderBy("step")
    return s.select("run", "step", F.round(F.col("wall") - F.lag("wall").over(w), 3).alias("seconds"), "events", "restarts", "work")


@query("""select case when regexp_matches(tag, '/(c|s)$') then 'volume' when regexp_matches(tag, '/sd$') then 'spread' else 'level' end as family, count(distinct tag) as tags, count(value) as cells from fact group by family""")
def prj09_audit_family(v):
    family = first_match(F.col("tag"), [("/(c|s)$", "volume"), ("/sd$", "spread")], "level")
    return v.fact.groupBy(family.alias("family")).agg(F.count_distinct("tag").alias("tags"), F.count("value").alias("cells"))


@query("select regexp_replace(tag, '/(hi|lo|m)$', '/*') as copy_key, string_agg(tag, ' ' order by tag) as tags from (select distinct tag from fact) group by copy_key")
def prj10_copy_key(v):
    key = F.regexp_replace("tag", "/(hi|lo|m)$", "/*").alias("copy_key")
    return v.fact.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("tag")), " ").alias("tags"))


@query("""select pattern, tag from (select distinct tag from fact), (values ('events/*/c'), ('events/view/*'), ('*/error/sd')) p(pattern) where regexp_full_match(tag, replace(pattern, '*', '[^/]+'))""")
def prj13_wildcards(v):
    patterns = ["events/*/c", "events/view/*", "*/error/sd"]
    fits = F.array(*(F.when(F.col("tag").rlike("^" + p.replace("*", "[^/]+") + "$"), F.lit(p)) for p in patterns))
    return v.fact.select("tag").distinct().select(F.explode(F.array_compact(fits)).alias("pattern"), "tag")


@query(""", d as (select distinct p_brand || '/0' as name, 'part 0 of ' || p_brand as about from part union all select distinct p_brand, 'any part of ' || p_brand from part where p_size > 25)
select p_partkey, p_brand || '/' || (p_size % 3) as name, coalesce(a.about, b.about) as about from part left join d a on a.name = p_brand || '/' || (p_size % 3) left join d b on b.name = p_brand""")
def prj17_description(v):
    part = v.table("part").select("p_partkey", "p_brand", "p_size")
    exact = part.select(F.concat("p_brand", F.lit("/0")).alias("name"), F.concat(F.lit("part 0 of "), "p_brand").alias("exact")).distinct()
    base = part.where("p_size > 25").select(F.col("p_brand").alias("base_name"), F.concat(F.lit("any part of "), "p_brand").alias("base")).distinct()
    named = part.select("p_partkey", F.concat_ws("/", "p_brand", F.col("p_size") % 3).alias("name"))
    met = named.join(exact, "name", "left").join(base, F.regexp_replace("name", "/[0-9]+$", "") == F.col("base_name"), "left")
    return met.select("p_partkey", "name", F.coalesce("exact", "base").alias("about"))


@query("select run, step, '{\"run\":\"' || run || '\",\"step\":' || step || '}' as line from axis")
def snk06_json_lines(v):
    """JSON lines without the key `wall`; keys without a value go."""
    return v.axis.select("run", "step", F.to_json(F.struct("run", "step")).alias("line"))


@query("select event_id, 'snapshots/' || strftime(ts, '%Y%m%dT%H%M%SZ') as path, floor(epoch(ts))::double as captured from events")
def src06_snapshot_names(v):
    path = F.concat(F.lit("snapshots/"), F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'"))
    named = v.table("events").select("event_id", path.alias("path"))
    stamp = F.regexp_extract("path", r"([0-9]{8}T[0-9]{6}Z)$", 1)
    return named.withColumn("at", F.to_timestamp_ntz(stamp, F.lit("yyyyMMdd'T'HHmmss'Z'"))).select("event_id", "path", epoch("at").alias("captured"))


@query("select p_partkey, (i - 1)::int as ord, words[i] as word from (select p_partkey, words, unnest(generate_series(1, len(words))) as i from (select p_partkey, string_split(p_name, ' ') as words from part))")
def srt04_source_order(v):
    return v.table("part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("ord", "word"))


@query(""", r as (select p_brand as dataset, min(p_retailprice) as lo, max(p_retailprice) as hi from part group by p_brand having max(p_retailprice) > min(p_retailprice)),
m as (select *, (hi - lo) / 5 as raw, power(10.0, floor(log10((hi - lo) / 5))) as size from r),
s as (select *, size * case when raw / size <= 1 then 1 when raw / size <= 2 then 2 when raw / size <= 5 then 5 else 10 end as tick from m)
select dataset, round(tick, 9) as tick, (floor(hi / tick) - ceil(lo / tick) + 1)::bigint as ticks from s""")
def sca05_nice_ticks(v):
    r = v.table("part").groupBy(F.col("p_brand").alias("dataset")).agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi")).where("hi > lo")
    t = r.withColumn("tick", nice_step((F.col("hi") - F.col("lo")) / 5))
    return t.select("dataset", F.round("tick", 9).alias("tick"), (F.floor(F.col("hi") / F.col("tick")) - F.ceil(F.col("lo") / F.col("tick")) + 1).cast("long").alias("ticks"))


@query("select c_custkey, case when c_acctbal > 0 then round(log10(c_acctbal), 9) end as exponent from customer")
def sca06_log_scale(v):
    return v.table("customer").select("c_custkey", F.round(F.log10(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))), 9).alias("exponent"))


@query("""select s_suppkey, round(case when s_acctbal = 0 then 0 else round(s_acctbal * power(10.0, 2 - floor(log10(abs(s_acctbal))))) / power(10.0, 2 - floor(log10(abs(s_acctbal)))) end, 6) as three from supplier""")
def sca08_significant(v):
    return v.table("supplier").select("s_suppkey", F.round(significant(F.col("s_acctbal"), 3), 6).alias("three"))


@query("select key, count(*) as n, sum(value)::bigint as total from (select unnest(json_keys(props)) as key, (props::json ->> 'k')::bigint as value from events) group by key")
def sca09_map_entries(v):
    entries = v.table("events").select(F.explode(F.from_json("props", "map<string,bigint>")))
    return entries.groupBy("key").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("select page_id, printf('24%02d.%05d', (page_id % 12 + 1)::int, (page_id % 90000)::int) as arxiv from pages")
def sca14_arxiv_id(v):
    month, number = (F.col("page_id") % 12 + 1).cast("int"), (F.col("page_id") % 90000).cast("int")
    url = F.format_string("https://arxiv.org/abs/24%02d.%05dv2", month, number)
    return v.table("pages").select("page_id", F.regexp_extract(url, r"arxiv\.org/(?:abs|pdf)/([0-9]{4}\.[0-9]{4,5})", 1).alias("arxiv"))


@query("""select p_partkey, 'size' as field, 'hard' as level from part where p_size is null or p_size not between 1 and 40
union all select p_partkey, 'name', 'hard' from part where coalesce(trim(p_name), '') = '' union all select p_partkey, 'group', 'soft' from part where p_brand not in ('Brand#11', 'Brand#12', 'Brand#13') or p_brand is null""")
def sca20_entry_checks(v):
    rules = [
        ("size", "hard", ~F.coalesce(F.col("p_size").between(1, 40), F.lit(False))),
        ("name", "hard", F.trim(F.coalesce("p_name", F.lit(""))) == ""),
        ("group", "soft", ~F.coalesce(F.col("p_brand").isin("Brand#11", "Brand#12", "Brand#13"), F.lit(False))),
    ]
    found = F.array(*(F.when(bad, F.struct(F.lit(field).alias("field"), F.lit(level).alias("level"))) for field, level, bad in rules))
    return v.table("part").select("p_partkey", F.inline(F.array_compact(found)))


@query("""select split_part(tag, '/', 2) as part, round(avg(value) filter (run = 'r0'), 6) as r0_mean, round(min(value) filter (run = 'r0'), 9) as r0_least, round(max(value) filter (run = 'r1'), 9) as r1_most,
string_agg(distinct split_part(tag, '/', 3), ' ' order by split_part(tag, '/', 3)) as stats from fact group by part""")
def sca25_family_entry(v):
    piece = lambda k: F.split_part("tag", F.lit("/"), F.lit(k))
    of = lambda run: F.when(F.col("run") == run, F.col("value"))
    return v.fact.groupBy(piece(2).alias("part")).agg(
        F.round(F.avg(of("r0")), 6).alias("r0_mean"), F.round(F.min(of("r0")), 9).alias("r0_least"), F.round(F.max(of("r1")), 9).alias("r1_most"), F.array_join(F.array_sort(F.collect_set(piece(3))), " ").alias("stats")
    )


@query("""select conv_id, count(*) as versions, arg_min(role, turn) as role, md5(arg_max(text, strlen(text) * 1000000 - turn)) as quote from conversations where text is not null group by conv_id""")
def sca26_registry(v):
    """Entries of one id become one: the longest text (ties: the earliest), and the first role."""
    rows = v.table("conversations").where("text is not null")
    longest = F.octet_length("text").cast("long") * 1000000 - F.col("turn")
    return rows.groupBy("conv_id").agg(F.count("*").alias("versions"), F.min_by("role", "turn").alias("role"), F.md5(F.max_by("text", longest)).alias("quote"))
