"""Queries: joins, as-of and interval joins."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from runlens.operators import temporal as T

from .catalog import query

ASOF = 1705000000.5


@query("select run, count(*) as n, round(sum(wall - 1704067200), 3) as walls from fact join axis using (run, step) group by run")
def jon01_equi(v):
    return v.fact.join(v.axis, ["run", "step"]).groupBy("run").agg(F.count("*").alias("n"), F.round(F.sum(F.col("wall") - 1704067200), 3).alias("walls"))


@query("select e.event_id, e.run, a.step from restarts e asof left join axis a on e.run = a.run and e.t >= a.wall")
def jon02_as_of(v):
    return T.step_at(v.restarts, v.axis, "t", "last").select("event_id", "run", "step")


@query(f"select run, arg_max(step, wall) as step from axis where wall <= {ASOF} group by run")
def jon03_last_step_at(v):
    return v.axis.where(F.col("wall") <= ASOF).groupBy("run").agg(F.max_by("step", "wall").alias("step"))


@query("select e.event_id, e.run, a.step from restarts e asof left join axis a on e.run = a.run and e.t <= a.wall")
def jon04_next_step(v):
    return T.step_at(v.restarts, v.axis, "t", "first").select("event_id", "run", "step")


@query(""", n as (select run, max(step) as n from axis group by run)
select e.event_id, e.run, least(coalesce(a.step, 0) + 1, n) as step from restarts e asof left join axis a on e.run = a.run and e.t >= a.wall join n on n.run = e.run""")
def jon05_running_step(v):
    return T.step_at(v.restarts, v.axis, "t", "running").select("event_id", "run", "step")


@query(""", w as (select run, step, lag(wall) over (partition by run order by step) as start, wall from axis)
select w.run, w.step, count(event_id) as restarts, round(max(wall) - coalesce(max(start), max(wall)), 3) as seconds
from w left join restarts e on e.run = w.run and e.t <= w.wall and (w.start is null or e.t > w.start) group by w.run, w.step""")
def jon06_events_in_steps(v):
    per = T.step_at(v.restarts, v.axis, "t", "first").groupBy("run", "step").agg(F.count("*").alias("restarts"))
    seconds = F.round(F.col("wall") - F.coalesce("start", "wall"), 3).alias("seconds")
    return T.step_windows(v.axis).join(per, ["run", "step"], "left").select("run", "step", F.coalesce("restarts", F.lit(0)).alias("restarts"), seconds)


@query("select run, t, kind, step from run_events where t between 1704400000 and 1704700000")
def jon07_closed_window(v):
    return v.run_events.where(F.col("t").between(1704400000, 1704700000)).select("run", "t", "kind", "step")


@query(""", w as (select run, step, wall, lag(wall) over (partition by run order by step) as start, lead(wall) over (partition by run order by step) as until from axis)
select run, step, coalesce(start, wall) as start, coalesce(until, 1706800000.0) as until, count(event_id) as notices, count(*) filter (t > wall) as late
from w join restarts using (run) where t > coalesce(start, wall) and t <= coalesce(until, 1706800000.0) group by all""")
def jon08_extended_window(v):
    w = Window.partitionBy("run").orderBy("step")
    span = v.axis.select("run", "step", "wall", F.coalesce(F.lag("wall").over(w), "wall").alias("start"), F.coalesce(F.lead("wall").over(w), F.lit(1706800000.0)).alias("until"))
    # A notice lies in the windows of at most two steps: that of the first wall at or after it, and the one before.
    ended = T.as_of(v.restarts, v.axis, ["run"], "t", "wall", ["step"]).select("run", "t", "event_id", "step")
    ahead = T.as_of(v.restarts, v.axis, ["run"], "t", "wall", ["step"], backward=False).select("run", "t", "event_id", "step")
    near = ended.unionByName(ahead).where("step is not null").dropDuplicates(["run", "event_id", "step"])
    # A time equal to a wall belongs to the window of the step before it, too.
    near = near.unionByName(near.withColumn("step", F.col("step") - 1)).dropDuplicates(["run", "event_id", "step"])
    found = near.join(span, ["run", "step"]).where("t > start and t <= until")
    return found.groupBy("run", "step", "start", "until").agg(F.count("event_id").alias("notices"), F.count_if(F.col("t") > F.col("wall")).alias("late"))


@query("""select run, t, before, after from (select run, t, kind, last_value(step ignore nulls) over (partition by run order by t, kind rows unbounded preceding) as before,
first_value(step ignore nulls) over (partition by run order by t, kind rows between current row and unbounded following) as after from run_events) where kind = 'restart'""")
def jon09_neighbouring_steps(v):
    # Steps sort after restarts of the same time. Rows without a run are one run, those without a time come last.
    run, latest = F.struct("run").alias("_run"), F.coalesce("t", F.lit(1e18)).alias("_t_or_last")
    ends = v.axis.where("wall is not null").select(run, "wall", "step")
    restarts = v.restarts.select("run", "t", run, latest)
    before = T.as_of(restarts, ends, ["_run"], "_t_or_last", "wall", ["step"], strict=True).withColumnRenamed("step", "before")
    both = T.as_of(before, ends, ["_run"], "_t_or_last", "wall", ["step"], backward=False)
    return both.select("run", "t", "before", F.col("step").alias("after"))


@query("select e.run, e.event_id, arg_min(a.step, round(abs(a.wall - e.t), 9) * 1e3 + a.step * 1e-4) as step, round(min(abs(a.wall - e.t)), 3) as apart from restarts e join axis a using (run) group by e.run, e.event_id")
def jon10_nearest(v):
    before = T.as_of(v.restarts, v.axis, ["run"], "t", "wall", ["step", "wall"]).withColumnsRenamed({"step": "s0", "wall": "w0"})
    both = T.as_of(before, v.axis, ["run"], "t", "wall", ["step", "wall"], backward=False)
    back = F.col("w0").isNotNull() & (F.col("wall").isNull() | (F.col("t") - F.col("w0") <= F.col("wall") - F.col("t")))
    apart = F.least(F.col("t") - F.col("w0"), F.col("wall") - F.col("t"))
    return both.select("run", "event_id", F.when(back, F.col("s0")).otherwise(F.col("step")).alias("step"), F.round(apart, 3).alias("apart"))


@query("""select a.run, a.tag as x, b.tag as y, count(*) as n, round(covar_pop(a.value, b.value) / nullif(stddev_pop(a.value) * stddev_pop(b.value), 0), 9) as r
from fact a join fact b on a.run = b.run and a.step = b.step and a.tag < b.tag and a.value is not null and b.value is not null group by all having count(*) >= 3""")
def jon12_pairs_of_tags(v):
    from runlens.operators.association import pearson

    m = v.fact.where("value is not null")
    x, y = (m.select("run", "step", F.col("tag").alias(t), F.col("value").alias(f"{t}_value")) for t in ("x", "y"))
    pairs = x.join(y, ["run", "step"]).where("x < y")
    return pairs.groupBy("run", "x", "y").agg(F.count("*").alias("n"), F.round(pearson("x_value", "y_value"), 9).alias("r")).where("n >= 3")


@query("""select l as lag, m.run, count(*) as n, round(sum(m.value * b.value), 4) as product from (select * from fact where tag = 'events/view/m') m,
(select * from fact where tag = 'events/click/m') b, range(0, 9) r(l) where b.run = m.run and b.step - l = m.step group by all""")
def jon13_lagged(v):
    m = v.fact.where("tag = 'events/view/m'").select("run", F.col("value").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(8))).alias("lag"), "step")
    m = m.withColumn("step", F.col("step") + F.col("lag"))
    b = v.fact.where("tag = 'events/click/m'").select("run", "step", F.col("value").alias("y"))
    return m.join(b, ["run", "step"]).groupBy(F.col("lag").cast("long").alias("lag"), "run").agg(F.count("*").alias("n"), F.round(F.sum(F.col("x") * F.col("y")), 4).alias("product"))


@query("select a.tag, count(*) as n, round(avg(b.value - a.value), 9) as gap from fact a join fact b using (tag, step) where a.run = 'r0' and b.run = 'r1' and a.value is not null and b.value is not null group by a.tag")
def jon14_common_steps(v):
    r0, r1 = (v.fact.where((F.col("run") == r) & F.col("value").isNotNull()).select("tag", "step", F.col("value").alias(r)) for r in ("r0", "r1"))
    return r0.join(r1, ["tag", "step"]).groupBy("tag").agg(F.count("*").alias("n"), F.round(F.avg(F.col("r1") - F.col("r0")), 9).alias("gap"))


@query("""select item_id, ref, nation.n_name as title, nation.n_name is null as unresolved from (select item_id, unnest([item_id % 30, (item_id * 7) % 40]) as ref from benchmark) u
left join nation on n_nationkey = ref""")
def jon15_registry(v):
    refs = v.table("benchmark").select("item_id", F.explode(F.array(F.col("item_id") % 30, (F.col("item_id") * 7) % 40)).alias("ref"))
    registry = v.table("nation").select(F.col("n_nationkey").cast("long").alias("ref"), F.col("n_name").alias("title"))
    return refs.join(registry, "ref", "left").select("item_id", "ref", "title", F.col("title").isNull().alias("unresolved"))


@query("""select n_nationkey as ref, count(item_id) as users, coalesce(array_to_string(list_sort(list(item_id) filter (item_id is not null)), ','), '') as items from nation
left join (select item_id, unnest([item_id % 30, (item_id * 7) % 40]) as ref from benchmark) u on n_nationkey = ref group by all""")
def jon16_reverse_usage(v):
    refs = v.table("benchmark").select("item_id", F.explode(F.array(F.col("item_id") % 30, (F.col("item_id") * 7) % 40)).alias("ref"))
    users = refs.groupBy("ref").agg(F.count("*").alias("users"), F.array_join(F.array_sort(F.collect_list("item_id")), ",").alias("items"))
    nation = v.table("nation").select(F.col("n_nationkey").alias("ref"))
    return nation.join(users, nation["ref"] == users["ref"], "left").select(nation["ref"], F.coalesce("users", F.lit(0)).alias("users"), F.coalesce("items", F.lit("")).alias("items"))


@query("select distinct f.run, f.tag from fact f anti join (select run, tag from fact where value is not null and step > 25) s using (run, tag)")
def jon17_without_data(v):
    listed = v.fact.select("run", "tag").distinct()
    return listed.join(v.fact.where("value is not null and step > 25").select("run", "tag"), ["run", "tag"], "left_anti")
