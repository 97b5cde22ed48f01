"""Queries: aggregates, sorting, set operations."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from runlens.functions.paths import histogram_bin
from runlens.operators.summary import deviation_from_median, modal, series_summary, top_and_other, weighted_mean

from .catalog import query


@query("select run, tag, round(avg(value), 9) as mean, round(sum(value), 4) as total, round(min(value), 9) as low, round(max(value), 9) as high, count(value) as n from fact group by all")
def agg01_basic(v):
    return v.fact.groupBy("run", "tag").agg(
        F.round(F.avg("value"), 9).alias("mean"), F.round(F.sum("value"), 4).alias("total"), F.round(F.min("value"), 9).alias("low"), F.round(F.max("value"), 9).alias("high"), F.count("value").alias("n")
    )


@query("select run, tag, round(stddev_samp(value), 9) as sd from fact group by all")
def agg02_sample_deviation(v):
    return v.fact.groupBy("run", "tag").agg(F.round(F.stddev_samp("value"), 9).alias("sd"))


@query("select run, tag, round(stddev_pop(value), 9) as sd from fact group by all")
def agg03_population_deviation(v):
    return v.fact.groupBy("run", "tag").agg(F.round(F.stddev_pop("value"), 9).alias("sd"))


@query("select run, tag, round(median(value), 9) as median from fact group by all")
def agg04_median(v):
    return v.fact.groupBy("run", "tag").agg(F.round(F.median("value"), 9).alias("median"))


@query(""", c as (select run, tag, median(value) as center from fact group by all)
select run, tag, round(center, 9) as center, round(median(abs(value - center)), 9) as mad, round(1.4826 * median(abs(value - center)), 9) as scaled
from fact join c using (run, tag) group by run, tag, center""")
def agg05_mad(v):
    return deviation_from_median(v.fact).select("run", "tag", F.round("center", 9).alias("center"), F.round("mad", 9).alias("mad"), F.round(F.col("mad") * 1.4826, 9).alias("scaled"))


@query("select run, tag, round(quantile_cont(value, 0.1), 9) as q10, round(quantile_cont(value, 0.25), 9) as q25, round(quantile_cont(value, 0.9), 9) as q90 from fact group by all")
def agg06_quantiles(v):
    return v.fact.groupBy("run", "tag").agg(*(F.round(F.percentile("value", p), 9).alias(f"q{round(p * 100)}") for p in (0.1, 0.25, 0.9)))


@query(""", k as (select run, tag, round(value, 6) as value, count(*) as n from fact where value is not null group by all)
select run, tag, arg_max(value, n * 1e9 - value) as mode, max(n) as mode_n, round(max(n) / sum(n), 9) as share, count(*) as n_distinct from k group by run, tag""")
def agg07_mode(v):
    return modal(v.fact.withColumn("value", F.round("value", 6))).withColumn("share", F.round("share", 9))


@query("select run, tag, round(stddev_samp(value) / nullif(abs(avg(value)), 0), 9) as cv from fact group by all")
def agg08_variation(v):
    return v.fact.groupBy("run", "tag").agg(F.round(F.try_divide(F.stddev_samp("value"), F.abs(F.avg("value"))), 9).alias("cv"))


@query("select regexp_replace(tag, '^events/[a-z]+/', 'events/*/') as family, count(distinct tag) as tags, count(*) as n_cells from fact group by all")
def agg09_group_counts(v):
    return v.fact.groupBy(F.regexp_replace("tag", "^events/[a-z]+/", "events/*/").alias("family")).agg(F.count_distinct("tag").alias("tags"), F.count("*").alias("n_cells"))


@query("select run, step, count(distinct event_type) as types, array_to_string(list_sort(list(distinct event_type)), ',') as names from ev group by all")
def agg10_distinct(v):
    return v.ev.groupBy("run", "step").agg(F.count_distinct("event_type").alias("types"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("names"))


@query("""select run, tag, arg_min(step, value * 1e3 + step * 1e-9) as low_step, arg_max(step, value * 1e3 - step * 1e-9) as high_step
from fact group by all""")
def agg11_where_extremes_are(v):
    s = series_summary(v.fact)
    return s.select("run", "tag", "low_step", "high_step")


@query("select step, round(sum(weight * rate) / sum(weight), 8) as mean from panel where weight > 0 and rate is not null group by step")
def agg12_weighted_mean(v):
    return v.panel.groupBy("step").agg(F.round(weighted_mean("rate", "weight"), 8).alias("mean"))


@query("select run, event_type, round(count(*) filter (value > 50) / count(*), 9) as share from ev group by all")
def agg13_conditional_share(v):
    return v.ev.groupBy("run", "event_type").agg(F.round(F.count_if(F.col("value") > 50) / F.count("*"), 9).alias("share"))


@query("""select event_type, case when value < 10 then 0 when value < 25 then 1 when value < 50 then 2 when value < 100 then 3 else 4 end as bin,
count(*) as n from ev where value is not null group by all""")
def agg14_histogram(v):
    return v.ev.where("value is not null").groupBy("event_type", histogram_bin(F.col("value"), [10, 25, 50, 100]).alias("bin")).agg(F.count("*").alias("n"))


@query("""select run, tag, count(value) as n, count(*) - count(value) as missing, round(arg_min(value, step), 9) as first, round(arg_max(value, step), 9) as last,
round(avg(value), 9) as mean, round(stddev_samp(value), 9) as sd, round(min(value), 9) as low, round(max(value), 9) as high,
round(arg_max(value, step) - arg_min(value, step), 9) as change, round((arg_max(value, step) - arg_min(value, step)) / nullif(abs(arg_min(value, step)), 0), 9) as change_share,
round(stddev_samp(value) / nullif(abs(avg(value)), 0), 9) as cv, count(distinct value) <= 1 as constant from fact group by all""")
def agg15_series_summary(v):
    s = series_summary(v.fact)
    numbers = ["first", "last", "mean", "sd", "low", "high", "change", "change_share", "cv"]
    return s.select("run", "tag", "n", "missing", *(F.round(c, 9).alias(c) for c in numbers), "constant")


@query(""", tags as (select distinct run, tag from fact), grid as (select run, tag, step from tags join axis using (run))
select run, count(distinct tag) as tags, count(distinct step) as steps, count(value) as n_filled, round(count(value) / count(*), 9) as fill_rate
from grid left join fact using (run, tag, step) group by run""")
def agg17_fill_rate(v):
    cells = v.fact.groupBy("run").agg(F.count_distinct("tag").alias("tags"), F.count("value").alias("n_filled"))
    steps = v.axis.groupBy("run").agg(F.count("*").alias("steps"))
    return cells.join(steps, "run").select("run", "tags", "steps", "n_filled", F.round(F.col("n_filled") / (F.col("tags") * F.col("steps")), 9).alias("fill_rate"))


@query("""select run, step, round(sum(k * part) , 9) as weighted, round(sum(part), 9) as whole from (
select run, step, case event_type when 'click' then 1 when 'error' then 2 when 'purchase' then 3 when 'signup' then 4 else 5 end as k,
c / sum(c) over (partition by run, step) as part from daily) group by all""")
def agg18_bucket_weighted(v):
    counts = v.fact.where("tag like '%/c'").withColumn("part", F.col("value") / F.sum("value").over(Window.partitionBy("run", "step")))
    k = F.array_position(F.array(*map(F.lit, ["click", "error", "purchase", "signup", "view"])), F.split("tag", "/")[1])
    return counts.groupBy("run", "step").agg(F.round(F.sum(k * F.col("part")), 9).alias("weighted"), F.round(F.sum("part"), 9).alias("whole"))


@query(""", totals as (select dataset, sum(weight) as weight from panel group by all), ranked as (select *, row_number() over (order by weight desc, dataset) as k from totals)
select case when k <= 5 then dataset else 'other' end as dataset, sum(weight) as weight from ranked group by 1""")
def agg19_top_and_other(v):
    return top_and_other(v.panel, "dataset", "weight", 5)


@query("select * from (select run, step, wall from axis order by wall desc, run limit 60) order by wall, run")
def srt01_last_60(v):
    return v.axis.orderBy(F.desc("wall"), "run").limit(60).orderBy("wall", "run").select("run", "step", "wall")


@query("""select family, tag, n, k from (select regexp_replace(tag, '^events/[a-z]+/', 'events/*/') as family, tag, n,
row_number() over (partition by regexp_replace(tag, '^events/[a-z]+/', 'events/*/') order by n desc, tag) as k from
(select tag, count(value) as n from fact group by tag)) where k <= 4""")
def srt02_top_per_group(v):
    counts = v.fact.groupBy("tag").agg(F.count("value").alias("n")).withColumn("family", F.regexp_replace("tag", "^events/[a-z]+/", "events/*/"))
    k = F.row_number().over(Window.partitionBy("family").orderBy(F.desc("n"), "tag")).cast("long")
    return counts.withColumn("k", k).where("k <= 4").select("family", "tag", "n", "k")


@query("select dataset, row_number() over (order by regexp_extract(dataset, '([0-9]+)', 1)::int, dataset) as k from (select distinct dataset from panel)")
def srt03_numeric_names(v):
    number = F.regexp_extract("dataset", "([0-9]+)", 1).cast("int")
    return v.panel.select("dataset").distinct().select("dataset", F.row_number().over(Window.orderBy(number, "dataset")).cast("long").alias("k"))


@query("""select run, tag, round(change, 9) as change, direction from (select run, tag, change, case when up <= 3 then 'up' else 'down' end as direction, up, down from (
select run, tag, change, row_number() over (partition by run order by change desc, tag) as up, row_number() over (partition by run order by change, tag) as down
from (select run, tag, arg_max(value, step) - arg_min(value, step) as change from fact where value is not null group by all))) where up <= 3 or down <= 3""")
def srt05_rises_and_falls(v):
    s = series_summary(v.fact).where("change is not null")
    up = F.row_number().over(Window.partitionBy("run").orderBy(F.desc("change"), "tag"))
    down = F.row_number().over(Window.partitionBy("run").orderBy("change", "tag"))
    ranked = s.withColumns({"up": up, "down": down}).where("up <= 3 or down <= 3")
    return ranked.select("run", "tag", F.round("change", 9).alias("change"), F.when(F.col("up") <= 3, "up").otherwise("down").alias("direction"))


@query("select tag from (select distinct tag from fact) order by tag limit 10 offset 10")
def srt06_paging(v):
    return v.fact.select("tag").distinct().orderBy("tag").offset(10).limit(10)


@query("select tag, 'both' as side from (select tag from fact where run = 'r0' intersect select tag from fact where run = 'r1') union all select tag, 'any' from (select tag from fact union select tag from monthly)")
def set01_union_and_intersection(v):
    r0, r1 = (v.fact.where(F.col("run") == r).select("tag") for r in ("r0", "r1"))
    return r0.intersect(r1).withColumn("side", F.lit("both")).unionByName(v.fact.select("tag").union(v.monthly.select("tag")).distinct().withColumn("side", F.lit("any")))


@query("select distinct run, tag, 'dropped' as side from snap_old anti join (select distinct run, tag from snap_new) n using (run, tag)")
def set02_difference(v):
    return v.snap_old.select("run", "tag").distinct().join(v.snap_new.select("run", "tag").distinct(), ["run", "tag"], "left_anti").withColumn("side", F.lit("dropped"))


@query("select run, tag, step, round(value, 9) as value from (select *, row_number() over (partition by run, tag, step order by src desc) as k from (select *, 0 as src from snap_old union all select *, 1 from snap_new)) where k = 1")
def set03_last_wins(v):
    both = v.snap_old.withColumn("src", F.lit(0)).unionByName(v.snap_new.withColumn("src", F.lit(1)))
    return both.groupBy("run", "tag", "step").agg(F.round(F.max_by("value", "src"), 9).alias("value"))


@query(""", s as (select run, tag, string_agg(coalesce(round(value, 6)::decimal(20, 6)::varchar, 'null'), ',' order by step) as shape from fact where tag like '%/c' or tag like '%/s' group by all)
select run, min(tag) as tag, count(*) as copies from s group by run, shape""")
def set04_equal_series(v):
    rows = v.fact.where("tag like '%/c' or tag like '%/s'").withColumn("cell", F.coalesce(F.round("value", 6).cast("decimal(20,6)").cast("string"), F.lit("null")))
    shape = F.sha2(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("step", "cell"))), lambda x: x["cell"])), 256)
    return rows.groupBy("run", "tag").agg(shape.alias("shape")).groupBy("run", "shape").agg(F.min("tag").alias("tag"), F.count("*").alias("copies")).select("run", "tag", "copies")


