"""The serving views: one DataFrame per question, each as of a moment. A later fact never shows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.operators.anomaly import correlation_panel, movers
from runlens.sources.telemetry import START, Telemetry

from .catalog import query


def _until(df: DataFrame, time: str, asof: float | None) -> DataFrame:
    return df if asof is None else df.where(F.col(time) <= asof)


def runs(v: Telemetry, asof: float | None = None) -> DataFrame:
    """run, steps, started, last_wall."""
    return _until(v.axis, "wall", asof).groupBy("run").agg(F.count("*").alias("steps"), F.min("wall").alias("started"), F.max("wall").alias("last_wall"))


def status(v: Telemetry, asof: float | None = None, rate_per_second: float = 0.0125) -> DataFrame:
    """run, step (the last that ended), since, restarts, cost."""
    last = _until(v.axis, "wall", asof).groupBy("run").agg(F.max_by("step", "wall").alias("step"), F.max("wall").alias("since"), F.min("wall").alias("_start"))
    n = _until(v.restarts, "t", asof).groupBy("run").agg(F.count("*").alias("restarts"))
    at = F.lit(asof) if asof is not None else F.col("since")
    return last.join(n, "run", "left").select("run", "step", "since", F.coalesce("restarts", F.lit(0)).alias("restarts"), (F.greatest(F.lit(0.0), at - F.col("_start")) * rate_per_second).alias("cost"))


def tags(v: Telemetry, asof: float | None = None) -> DataFrame:
    """run, tag of the metrics that have a step by then, in order."""
    steps = _until(v.axis, "wall", asof).select("run", "step")
    return v.fact.join(steps, ["run", "step"], "left_semi").select("run", "tag").distinct()


def series(v: Telemetry, names: list[str], asof: float | None = None) -> DataFrame:
    """run, tag, step, value of the named metrics; every visible step has a row, missing values are NULL."""
    steps = _until(v.axis, "wall", asof).select("run", "step")
    fact = v.fact.where(F.col("tag").isin(names))
    grid = steps.join(fact.select("run", "tag").distinct(), "run")
    return grid.join(fact, ["run", "tag", "step"], "left").select("run", "tag", "step", "value")


def visible_fact(v: Telemetry, asof: float | None = None) -> DataFrame:
    return v.fact.join(_until(v.axis, "wall", asof).select("run", "step"), ["run", "step"], "left_semi")


def benchmarks(v: Telemetry, asof: float | None = None) -> DataFrame:
    return v.bench.join(_until(v.axis, "wall", asof).select("run", "step"), ["run", "step"], "left_semi")


def timeline(v: Telemetry, asof: float | None = None) -> DataFrame:
    return _until(v.run_events, "t", asof)


def correlate(v: Telemetry, step: int, anchor: str, asof: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(movers at the step, families that follow the anchor), from what is visible."""
    fact = visible_fact(v, asof)
    return movers(fact, step), correlation_panel(fact, anchor)


ASOF = 1705500000.25
SEEN = f", seen as (select run, step, wall from axis where wall <= {ASOF})"


@query(f"{SEEN} select run, count(*) as steps, round(min(wall), 3) as started, round(max(wall), 3) as last_wall from seen group by run")
def api_runs(v):
    return runs(v, ASOF).select("run", "steps", F.round("started", 3).alias("started"), F.round("last_wall", 3).alias("last_wall"))


@query(f"""{SEEN}, l as (select run, arg_max(step, wall) as step, max(wall) as since, min(wall) as started from seen group by run), n as (select run, count(*) as restarts from restarts where t <= {ASOF} group by run)
select run, step, round(since, 3) as since, coalesce(restarts, 0) as restarts, round(greatest(0, {ASOF} - started) * 0.0125, 4) as cost from l left join n using (run)""")
def dom02_status(v):
    return status(v, ASOF).select("run", "step", F.round("since", 3).alias("since"), "restarts", F.round("cost", 4).alias("cost"))


@query(f"{SEEN} select distinct run, tag from fact semi join seen using (run, step)")
def api_tags(v):
    return tags(v, ASOF)


@query(f"{SEEN}, t as (select distinct run, tag from fact where tag in ('events/view/sd', 'events/click/c')) select run, tag, step, round(value, 9) as value from seen join t using (run) left join fact using (run, tag, step)")
def api_series(v):
    return series(v, ["events/view/sd", "events/click/c"], ASOF).withColumn("value", F.round("value", 9))


@query(f"{SEEN} select bkey, run, step, round(value, 9) as value from bench semi join seen using (run, step)")
def api_benchmarks(v):
    return benchmarks(v, ASOF).select("bkey", "run", "step", F.round("value", 9).alias("value"))


@query(f"select run, kind, count(*) as n, round(max(t), 3) as newest from run_events where t <= {ASOF} group by all")
def dom03_timeline(v):
    return timeline(v, ASOF).groupBy("run", "kind").agg(F.count("*").alias("n"), F.round(F.max("t"), 3).alias("newest"))


@query(f"{SEEN}, s as (select run, tag, count(value) as n, max(step) as last_step from fact semi join seen using (run, step) group by all) select run, count(*) as tags, sum(n)::bigint as n_cells, max(last_step) as last_step from s group by run")
def ano05_visible_summary(v):
    s = visible_fact(v, ASOF).groupBy("run", "tag").agg(F.count("value").alias("n"), F.max("step").alias("last_step"))
    return s.groupBy("run").agg(F.count("*").alias("tags"), F.sum("n").alias("n_cells"), F.max("last_step").alias("last_step"))


@query(""", e as (select dataset, step, weight, lag(weight) over (partition by dataset order by step) as before, lag(step) over (partition by dataset order by step) as at_step from panel)
select dataset, step, round((weight - before) / nullif(before, 0), 9) as growth, abs(weight - before) <= 0.05 * before as held from e where at_step = step - 1""")
def ano23_carryover(v):
    w = Window.partitionBy("dataset").orderBy("step")
    e = v.panel.withColumns({"before": F.lag("weight").over(w), "at_step": F.lag("step").over(w)}).where("at_step = step - 1")
    return e.select("dataset", "step", F.round(F.try_divide(F.col("weight") - F.col("before"), F.col("before")), 9).alias("growth"), (F.abs(F.col("weight") - F.col("before")) <= 0.05 * F.col("before")).alias("held"))


@query("""select dataset, round(regr_slope(weight, step), 6) as weight_slope, round(regr_slope(rate, step), 9) as rate_slope, sign(regr_slope(weight, step)) = sign(regr_slope(rate, step)) as same_way from panel group by dataset""")
def dom11_directions(v):
    a, b = F.regr_slope("weight", "step"), F.regr_slope("rate", "step")
    return v.panel.groupBy("dataset").agg(F.round(a, 6).alias("weight_slope"), F.round(b, 9).alias("rate_slope"), (F.signum(a) == F.signum(b)).alias("same_way"))


@query(""", m as (select step, sum(weight * rate) / sum(weight) as mean from panel group by step), w as (select step, mean, lead(mean, 4) over (order by step) as later from m)
select step, round(later - mean, 9) as change from w where later is not null""")
def dom09_windowed_change(v):
    from runlens.operators.summary import weighted_mean

    m = v.panel.groupBy("step").agg(weighted_mean("rate", "weight").alias("mean"))  # one row a step
    return m.withColumn("later", F.lead("mean", 4).over(Window.orderBy("step"))).where("later is not null").select("step", F.round(F.col("later") - F.col("mean"), 9).alias("change"))


@query(""", p as (select dataset, step, weight, rate from panel), l as (select l as lag, a.dataset, a.weight as x, b.rate as y from p a, p b, range(-4, 5) r(l) where a.dataset = b.dataset and b.step = a.step + l)
select lag, count(*) as n, round(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 6) as r from l group by lag""")
def dom16_lead_lag(v):
    from runlens.operators.association import pearson

    a = v.panel.select("dataset", F.col("weight").alias("x"), F.explode(F.sequence(F.lit(-4), F.lit(4))).alias("lag"), "step").withColumn("step", F.col("step") + F.col("lag"))
    b = v.panel.select("dataset", "step", F.col("rate").alias("y"))
    return a.join(b, ["dataset", "step"]).groupBy(F.col("lag").cast("long").alias("lag")).agg(F.count("*").alias("n"), F.round(pearson("x", "y"), 6).alias("r"))


@query(""", w as (select run, step, max(value) filter (tag = 'events/purchase/s') as revenue, max(value) filter (tag = 'events/view/c') as views, max(value) filter (tag = 'events/error/c') as errors from fact group by all)
select run, step, round(revenue / nullif(views, 0), 9) as per_view, round(errors / nullif(views, 0), 9) as error_rate from w""")
def dom19_derived_ratios(v):
    named = {"revenue": "events/purchase/s", "views": "events/view/c", "errors": "events/error/c"}
    w = v.fact.where(F.col("tag").isin(*named.values())).groupBy("run", "step").agg(*(F.max(F.when(F.col("tag") == t, F.col("value"))).alias(c) for c, t in named.items()))
    rows = v.fact.select("run", "step").distinct().join(w, ["run", "step"], "left")
    return rows.select("run", "step", F.round(F.try_divide("revenue", "views"), 9).alias("per_view"), F.round(F.try_divide("errors", "views"), 9).alias("error_rate"))


@query(""", s as (select *, sum((kind = 'restart')::int) over (partition by run order by t, kind, step rows unbounded preceding) as segment from run_events), g as (select run, segment, count(*) as n, max(t) - min(t) as seconds from s group by all)
select run, count(*) as segments, round(avg(n / nullif(seconds, 0)), 8) as arrival_rate, round(avg(seconds), 3) as stay from g where n > 1 group by run""")
def dom24_flow(v):
    w = Window.partitionBy("run").orderBy("t", "kind", "step").rowsBetween(Window.unboundedPreceding, 0)
    g = v.run_events.withColumn("segment", F.sum((F.col("kind") == "restart").cast("int")).over(w)).groupBy("run", "segment").agg(F.count("*").alias("n"), (F.max("t") - F.min("t")).alias("seconds"))
    return g.where("n > 1").groupBy("run").agg(F.count("*").alias("segments"), F.round(F.avg(F.try_divide("n", "seconds")), 8).alias("arrival_rate"), F.round(F.avg("seconds"), 3).alias("stay"))


@query("select run, step, round(count(*) filter (event_type = 'error') / count(*), 9) as pressure, count(*) filter (event_type = 'error') >= 0.2 * count(*) as over from ev group by all".replace("as over ", "as above "))
def dom30_backpressure(v):
    errors = F.count_if(F.col("event_type") == "error")
    return v.ev.groupBy("run", "step").agg(F.round(errors / F.count("*"), 9).alias("pressure"), (errors >= 0.2 * F.count("*")).alias("above"))


@query(""", marks as (select run, step from axis where step % 5 = 0), d as (select run, tag, step, case when lag(step) over w = step - 1 then value - lag(value) over w end as delta from fact window w as (partition by run, tag order by step))
select run, tag, round(avg(delta) filter (m.step is not null), 9) as marked, round(avg(delta) filter (m.step is null), 9) as other from d left join marks m using (run, step) group by run, tag""")
def dom33_restart_contrast(v):
    from runlens.operators.sequence import with_difference

    marks = v.axis.where("step % 5 = 0").select("run", "step", F.lit(True).alias("mark"))
    d = with_difference(v.fact).join(marks, ["run", "step"], "left")
    return d.groupBy("run", "tag").agg(F.round(F.avg(F.when(F.col("mark"), F.col("delta"))), 9).alias("marked"), F.round(F.avg(F.when(F.col("mark").isNull(), F.col("delta"))), 9).alias("other"))


@query(f"""select run, step, round(sum(value) * 1e9 / nullif(sum(length), 0), 4) as cost_per_billion from (select 'r' || (user_id % 2) as run, (datediff('day', date '{START}', ts) + 1)::int as step, value, length(props) as length from events) group by all""")
def dom34_normalised_cost(v):
    rows = v.table("events").select(F.concat(F.lit("r"), (F.col("user_id") % 2).cast("string")).alias("run"), v.day("ts").alias("step"), "value", F.length("props").alias("length"))
    return rows.groupBy("run", "step").agg(F.round(F.try_divide(F.sum("value") * 1e9, F.sum("length").cast("double")), 4).alias("cost_per_billion"))


@query("select json_extract_string(doc, '$.run') as run, json_array_length(doc, '$.steps')::int as steps from (select to_json({'run': run, 'steps': list(step order by step)}) as doc from axis group by run)")
def snk04_bundle(v):
    doc = v.axis.groupBy("run").agg(F.array_sort(F.collect_list("step")).alias("steps")).select(F.to_json(F.struct("run", "steps")).alias("doc"))
    return doc.select(F.get_json_object("doc", "$.run").alias("run"), F.size(F.from_json(F.get_json_object("doc", "$.steps"), "array<int>")).alias("steps"))


@query("select run, tag, count(value) as n, round(list_sum(list(value) filter (value is not null)), 4) as total from fact group by all")
def src08_array_round_trip(v):
    packed = v.fact.groupBy("run", "tag").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "value"))), lambda x: x["value"]).alias("values"))
    present = F.filter("values", lambda x: x.isNotNull())
    total = F.when(F.size(present) > 0, F.aggregate(present, F.lit(0.0), lambda a, x: a + x))
    return packed.select("run", "tag", F.size(present).cast("long").alias("n"), F.round(total, 4).alias("total"))
