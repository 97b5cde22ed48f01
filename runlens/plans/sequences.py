"""Queries: windows along series, and paths."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from runlens.functions.paths import CODE_FAMILIES, family, first_match, is_round, prefixes, tag_matches
from runlens.operators import sequence as S

from .catalog import query

SERIES = ["run", "tag"]


@query("""select run, tag, step, round(case when lag(step) over w = step - 1 then value - lag(value) over w end, 9) as delta
from fact window w as (partition by run, tag order by step)""")
def win01_difference(v):
    return S.with_difference(v.fact).select("run", "tag", "step", F.round("delta", 9).alias("delta"))


@query("select run, tag, step, round(value - lag(value) over (partition by run, tag order by step), 9) as delta from fact where value is not null")
def win02_bridged_difference(v):
    return S.with_bridged_difference(v.fact).select("run", "tag", "step", F.round("delta", 9).alias("delta"))


@query("""select run, tag, step, round((case when lag(step) over w = step - 1 then value - lag(value) over w end) / nullif(lag(value) over w, 0), 9) as by_before,
round((case when lag(step) over w = step - 1 then value - lag(value) over w end) / nullif(avg(value) over (partition by run, tag), 0), 9) as by_mean
from fact window w as (partition by run, tag order by step)""")
def win03_relative_difference(v):
    d = S.with_difference(v.fact)
    before, mean = F.lag("value").over(S.along()), F.avg("value").over(Window.partitionBy(*SERIES))
    return d.select("run", "tag", "step", F.round(F.try_divide("delta", before), 9).alias("by_before"), F.round(F.try_divide("delta", mean), 9).alias("by_mean"))


@query("""select run, tag, step, case when value is not null then rank() over (partition by run, tag, value is not null order by value)
+ (count(*) over (partition by run, tag, value) - 1) / 2 end as rank from fact""")
def win04_average_rank(v):
    return S.with_average_rank(v.fact).select("run", "tag", "step", "rank")


@query("select run, tag, step, round(sum(value) over (partition by run, tag order by step rows unbounded preceding), 9) as total from fact")
def win05_running_sum(v):
    return S.with_running_sum(v.fact).select("run", "tag", "step", F.round("total", 9).alias("total"))


@query("select run, tag, step, round(median(value) over (partition by run, tag order by step rows between 2 preceding and current row), 9) as rolling from fact")
def win06_rolling_median(v):
    return S.with_rolling_median(v.fact, 3).select("run", "tag", "step", F.round("rolling", 9).alias("rolling"))


@query(""", r as (select dataset, step, case when count(rate) over w >= 2 then avg(rate) over w end as rolling from panel
window w as (partition by dataset order by step rows between 2 preceding and current row)),
base as (select dataset, arg_min(rolling, step) as base from r where rolling is not null group by all)
select dataset, round(any_value(base), 9) as base, min(step) filter (rolling >= base + 0.02) as breakthrough from r join base using (dataset) group by dataset""")
def win07_breakthrough(v):
    panel = v.panel.withColumnRenamed("rate", "value")
    r = S.with_rolling_mean(panel, 3, 2, ("dataset",))
    w = Window.partitionBy("dataset").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    r = r.withColumn("base", F.first("rolling", ignorenulls=True).over(w))
    return r.groupBy("dataset").agg(F.round(F.first("base"), 9).alias("base"), F.min(F.when(F.col("rolling") >= F.col("base") + 0.02, F.col("step"))).alias("breakthrough"))


@query(""", p as (select *, row_number() over (partition by run, tag order by step) as i from fact where value is not null)
select a.run, a.tag, a.step, round(sum(power(0.8, a.i - b.i) * 0.2 * b.value) / (1 - power(0.8, a.i)), 9) as ema
from p a join p b on a.run = b.run and a.tag = b.tag and b.i <= a.i group by a.run, a.tag, a.step, a.i""")
def win08_debiased_ema(v):
    return S.with_debiased_ema(v.fact, 0.8).where("ema is not null").select("run", "tag", "step", F.round("ema", 9).alias("ema"))


@query(""", s as (select *, sum((kind = 'restart')::int) over (partition by run order by t, kind, step rows unbounded preceding) as segment from run_events)
select run, segment, count(*) as n, count(*) filter (kind = 'step') as steps from s group by all""")
def win09_segments_since_restart(v):
    w = Window.partitionBy("run").orderBy("t", "kind", "step").rowsBetween(Window.unboundedPreceding, 0)
    s = v.run_events.withColumn("segment", F.sum((F.col("kind") == "restart").cast("int")).over(w))
    return s.groupBy("run", "segment").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "step").alias("steps"))


@query(""", c as (select *, value < lag(value) over (partition by run, tag order by step) as cut from fact),
s as (select *, sum(coalesce(cut, false)::int) over (partition by run, tag order by step rows unbounded preceding) as segment from c)
select run, tag, segment, count(*) as n, min(step) as first_step, max(step) as last_step from s group by all""")
def win11_monotone_segments(v):
    cut = F.col("value") < F.lag("value").over(S.along())
    s = S.with_segment(v.fact.withColumn("cut", cut), F.col("cut"), ("run", "tag"), "step")
    return s.groupBy("run", "tag", "segment").agg(F.count("*").alias("n"), F.min("step").alias("first_step"), F.max("step").alias("last_step"))


@query(""", p as (select run, step, tag, row_number() over (partition by run, step order by value desc, tag) as k from fact where tag like '%/c'),
top as (select run, step, tag as phase from p where k = 1)
select run, step, phase from (select *, lag(phase) over (partition by run order by step) as before from top) where before <> phase""")
def win12_phase_flips(v):
    top = v.fact.where("tag like '%/c'").groupBy("run", "step").agg(F.min_by("tag", F.struct(-F.col("value"), "tag")).alias("phase"))
    before = F.lag("phase").over(Window.partitionBy("run").orderBy("step"))
    return top.withColumn("before", before).where("before <> phase").select("run", "step", "phase")


@query("select run, step, round(wall - lag(wall) over (partition by run order by step), 3) as seconds from axis")
def win13_step_duration(v):
    return v.axis.select("run", "step", F.round(F.col("wall") - F.lag("wall").over(Window.partitionBy("run").orderBy("step")), 3).alias("seconds"))


@query(""", d as (select run, tag, case when lag(step) over w = step - 1 then value - lag(value) over w end as delta from fact window w as (partition by run, tag order by step))
select run, tag, count(delta) as n, count(*) filter (delta < 0) as falls, count(delta) > 0 and count(*) filter (delta < 0) = 0 as cumulative from d group by all""")
def win14_cumulative(v):
    d = S.with_difference(v.fact).groupBy("run", "tag").agg(F.count("delta").alias("n"), F.count_if(F.col("delta") < 0).alias("falls"))
    return d.withColumn("cumulative", (F.col("n") > 0) & (F.col("falls") == 0))


@query("select run, tag, step from (select *, lag(value) over (partition by run, tag order by step) as before from fact) where value < 0.5 * before")
def win15_counter_resets(v):
    before = F.lag("value").over(S.along())
    return v.fact.withColumn("before", before).where("value < 0.5 * before").select("run", "tag", "step")


@query(""", ext as (select run, min(step) as lo, max(step) as hi, count(*) as n from axis group by run),
have as (select run, tag, count(value) as present, min(step) filter (value is not null) as first, max(step) filter (value is not null) as last from fact group by all)
select run, tag, n, n - present as missing, (case when present = 0 then n else first - lo end)::bigint as leading, (case when present = 0 then 0 else hi - last end)::bigint as trailing,
(n - present - case when present = 0 then n else first - lo end - case when present = 0 then 0 else hi - last end)::bigint as interior,
(case when present = 0 then n else first - lo end) > 0 as late_start, (case when present = 0 then 0 else hi - last end) > 0 as early_stop from have join ext using (run)""")
def win16_null_runs(v):
    return S.null_runs(v.fact, v.axis)


@query("select run, tag, step, round(value, 9) as value from fact where abs(step - 12) <= 2")
def win17_neighbours(v):
    return v.fact.where("abs(step - 12) <= 2").select("run", "tag", "step", F.round("value", 9).alias("value"))


@query(""", p as (select run, tag, value, row_number() over w as k, sum(value) over (w rows unbounded preceding) as s, sum(value * value) over (w rows unbounded preceding) as q,
count(*) over x as n, sum(value) over x as ts, sum(value * value) over x as tq from fact where value is not null window w as (partition by run, tag order by step), x as (partition by run, tag)),
c as (select *, q - s * s / k + (tq - q) - power(ts - s, 2) / (n - k) as sse from p where k >= 3 and n - k >= 3),
r as (select *, row_number() over (partition by run, tag order by round(sse * n / nullif(tq, 0), 9) nulls first, k) as o from c)
select run, tag, k::int as k, round(sse * n / nullif(tq, 0), 6) + 0.0 as sse from r where o = 1""")
def win18_best_split(v):
    return S.best_split(v.fact).select("run", "tag", "k", (F.round(F.try_divide("sse", "mean_square"), 6) + F.lit(0.0)).alias("sse"))


@query(""", peak as (select run, tag, arg_min(step, {'v': -round(value, 9), 's': step}) as peak_step, max(value) as peak, arg_max(value, step) as last from fact where value is not null group by all)
select run, tag, peak_step, round(peak, 9) as peak, round(last - peak, 9) as after_peak from peak""")
def win22_peak(v):
    rows = v.fact.where("value is not null")
    p = rows.groupBy("run", "tag").agg(F.min_by("step", F.struct(-F.round("value", 9), "step")).alias("peak_step"), F.max("value").alias("peak"), F.max_by("value", "step").alias("last"))
    return p.select("run", "tag", "peak_step", F.round("peak", 9).alias("peak"), F.round(F.col("last") - F.col("peak"), 9).alias("after_peak"))


@query(""", known as (select *, last_value(case when value is not null then step end ignore nulls) over b as ps, last_value(value ignore nulls) over b as pv,
first_value(case when value is not null then step end ignore nulls) over a as ns, first_value(value ignore nulls) over a as nv from fact
window b as (partition by run, tag order by step rows unbounded preceding), a as (partition by run, tag order by step rows between current row and unbounded following))
select run, tag, step, round(coalesce(value, pv + coalesce((step - ps) / nullif(ns - ps, 0)::double, 0) * (nv - pv), pv, nv), 9) as value from known""")
def mlt02_gap_fill(v):
    return S.filled(v.fact).select("run", "tag", "step", F.round("value", 9).alias("value"))


@query("select run, tag, step from fact join axis using (run, step) where wall <= 1705000000.5 and value is not null")
def prj01_visible_steps(v):
    return v.fact.where("value is not null").join(v.axis.where("wall <= 1705000000.5"), ["run", "step"], "left_semi").select("run", "tag", "step")


@query("select run, tag, first_seen from (select run, tag, min(wall) as first_seen from fact join axis using (run, step) group by all) where first_seen <= 1704200000")
def prj02_visible_tags(v):
    return v.fact.join(v.axis, ["run", "step"]).groupBy("run", "tag").agg(F.min("wall").alias("first_seen")).where("first_seen <= 1704200000")


@query("""select run, step, round(max(value) filter (tag = 'events/view/m'), 9) as view_mean, round(max(value) filter (tag = 'events/view/sd'), 9) as view_spread
from axis left join fact using (run, step) group by all""")
def prj03_aligned_tags(v):
    wide = v.fact.where("tag in ('events/view/m', 'events/view/sd')").groupBy("run", "step").pivot("tag", ["events/view/m", "events/view/sd"]).agg(F.max("value"))
    return v.axis.join(wide, ["run", "step"], "left").select("run", "step", F.round("events/view/m", 9).alias("view_mean"), F.round("events/view/sd", 9).alias("view_spread"))


@query("""select run, tag, round(arg_min(value, step), 9) as first, round(arg_max(value, step), 9) as last,
round(list_sort(list({'s': -step, 'v': value}) filter (value is not null))[2].v, 9) as before_last from fact group by all""")
def prj05_first_last_before(v):
    at = F.when(F.col("value").isNotNull(), F.col("step"))
    known = F.collect_list(F.when(F.col("value").isNotNull(), F.struct((-F.col("step")).alias("s"), F.col("value").alias("v"))))
    return v.fact.groupBy("run", "tag").agg(
        F.round(F.min_by("value", at), 9).alias("first"), F.round(F.max_by("value", at), 9).alias("last"), F.round(F.try_element_at(F.array_sort(known), F.lit(2))["v"], 9).alias("before_last")
    )


@query("""select tag, array_to_string(list_transform(string_split(regexp_replace(tag, 'dataset-[a-z0-9]+', 'dataset-*', 'g'), '/'),
lambda x: case when regexp_full_match(x, '[0-9]+') then '<k>' else x end), '/') as family
from (select distinct 'partial/' || (p_size % 3) || '/dataset-' || lower(substr(p_name, 1, 3)) || '/len' as tag from part)""")
def prj06_family(v):
    tags = v.table("part").select(F.concat(F.lit("partial/"), (F.col("p_size") % 3).cast("string"), F.lit("/dataset-"), F.lower(F.substring("p_name", 1, 3)), F.lit("/len")).alias("tag")).distinct()
    return tags.select("tag", family(F.col("tag"), CODE_FAMILIES).alias("family"))


@query("""select tag, case when regexp_matches(tag, '/c$') then 'int' when regexp_matches(tag, '/(sd|m)$') then 'num2' when regexp_matches(tag, '^events/') then 'num1' else 'auto' end as format
from (select tag from fact union select tag from monthly)""")
def prj14_first_format_rule(v):
    tags = v.fact.select("tag").union(v.monthly.select("tag")).distinct()
    return tags.select("tag", first_match(F.col("tag"), [("/c$", "int"), ("/(sd|m)$", "num2"), ("^events/", "num1")], "auto").alias("format"))


@query("select distinct tag, contains(lower(tag), 'view') as by_text, regexp_matches(tag, '(?i)/S$') as by_pattern from fact")
def prj15_tag_search(v):
    return v.fact.select("tag").distinct().select("tag", tag_matches(F.col("tag"), "VIEW").alias("by_text"), tag_matches(F.col("tag"), "/\\/S$/i").alias("by_pattern"))


@query(""", t as (select distinct tag, string_split(tag, '/') as parts from fact)
select prefix, count(*) as tags from (select unnest(list_transform(range(1, len(parts) + 1), lambda k: array_to_string(parts[1:k], '/'))) as prefix from t) group by prefix""")
def prj16_tag_tree(v):
    return v.fact.select("tag").distinct().select(F.explode(prefixes(F.col("tag"))).alias("prefix")).groupBy("prefix").agg(F.count("*").alias("tags"))


@query("select distinct regexp_extract(tag, '^events/([a-z]+)/', 1) as bucket from fact where regexp_matches(tag, '^events/[a-z]+/')")
def prj18_bucket_discovery(v):
    return v.fact.select(F.regexp_extract("tag", "^events/([a-z]+)/", 1).alias("bucket")).where("bucket <> ''").distinct()


@query("""select p_partkey, p_retailprice, p_size, p_size >= 2 and (abs(log2(p_size) - round(log2(p_size))) < 1e-9
or abs(p_size / power(10, floor(log10(p_size))) - round(p_size / power(10, floor(log10(p_size))))) < 1e-9) as is_round from part""")
def prj20_round_values(v):
    return v.table("part").select("p_partkey", "p_retailprice", "p_size", is_round(F.col("p_size").cast("double")).alias("is_round"))
