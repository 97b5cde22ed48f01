"""Queries: merges of snapshots, events, notices, configurations and lifecycles."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from runlens.functions.text import upper_by_character
from runlens.operators import merge as M

from .catalog import query


@query(""", redo as (select distinct run, step from snap_new where run = 'r1' and step % 11 = 0)
select run, tag, step, round(case when o.value <> n.value and redo.step is not null then n.value else coalesce(o.value, n.value) end, 9) as value,
case when o.value is null and n.value is not null then 'filled' when o.value <> n.value and redo.step is not null then 'rewritten' when o.value <> n.value then 'conflict' else 'kept' end as change
from snap_old o full join snap_new n using (run, tag, step) left join redo using (run, step)""")
def mrg01_series(v):
    redo = v.snap_new.where("run = 'r1' and step % 11 = 0").select("run", "step")
    # Statistics of both snapshots come from one aggregation, so equal cells are equal to the last bit.
    return M.merge_series(v.snap_old, v.snap_new, redo).withColumn("value", F.round("value", 9))


@query(""", incoming as (select run, t, kind, step from run_events where t > 1704800000 union all select run, t + 0.25, kind, step from run_events where kind = 'step'),
stored as (select run, t, kind, step from run_events where t <= 1705300000),
both_ as (select *, 0 as new from stored union all select *, 1 from incoming)
select run, t, kind, step from (select *, row_number() over (partition by run, kind, step, t order by new) as k from both_) where k = 1""")
def mrg02_events(v):
    stored = v.run_events.where("t <= 1705300000")
    incoming = v.run_events.where("t > 1704800000").unionByName(v.run_events.where("kind = 'step'").withColumn("t", F.col("t") + 0.25))
    return M.first_by_key(stored, incoming, ["run", "kind", "step", "t"], [])


@query(""", stored as (select item_id as id, text from benchmark where item_id % 2 = 0), incoming as (select item_id as id, upper(text) as text from benchmark where item_id % 2 = 1 or item_id % 3 = 0)
select * from stored union all select * from incoming anti join stored using (id)""")
def mrg03_notices(v):
    b = v.table("benchmark")
    stored = b.where("item_id % 2 = 0").select(F.col("item_id").alias("id"), "text")
    incoming = b.where("item_id % 2 = 1 or item_id % 3 = 0").select(F.col("item_id").alias("id"), upper_by_character(F.col("text")).alias("text"))
    return M.insert_missing(stored, incoming, ["id"])


@query(""", stored as (select * from bench where step <= 12), incoming as (select bkey, run, step, value + 1 as value from bench where step >= 8)
select bkey, run, step, round(value, 9) as value from (select * from stored union all select * from incoming anti join stored using (bkey, run, step))""")
def mrg04_benchmarks(v):
    incoming = v.bench.where("step >= 8").withColumn("value", F.col("value") + 1)
    return M.insert_missing(v.bench.where("step <= 12"), incoming, ["bkey", "run", "step"]).withColumn("value", F.round("value", 9))


@query("select run, tag, min(wall) as first_seen, max(wall) as last_seen from fact join axis using (run, step) where value is not null group by all")
def mrg05_lifecycle(v):
    return M.lifecycle(v.fact.where("value is not null").join(v.axis, ["run", "step"]).withColumnRenamed("wall", "at"))


@query(""", caps as (select run, wall as "at", 'v' || (step // 7) as version from axis)
select run, "at", version from (select *, lag(version) over (partition by run order by "at") as before from caps) where before is null or before <> version""")
def mrg05_version_changes(v):
    return M.version_changes(v.axis.select("run", F.col("wall").alias("at"), F.concat(F.lit("v"), F.floor(F.col("step") / 7).cast("string")).alias("version")))


@query(""", e as (select run, t, kind, step from run_events union all select run, t + 60, kind, step from run_events where step % 13 = 0)
select run, step, count(*) as n from e where kind = 'step' group by all having count(*) > 1""")
def mrg06_redone(v):
    again = v.run_events.where("step % 13 = 0").withColumn("t", F.col("t") + 60)
    return M.redone_steps(v.run_events.unionByName(again))


@query(""", e as (select run, t, kind, step from run_events union all select run, t + 60, kind, step from run_events where step % 13 = 0),
a as (select run, step, count(*) as n_after from e where kind = 'step' group by all), b as (select run, step, count(*) as n_before from run_events where kind = 'step' and t < 1704900000 group by all)
select run, step, n_after, coalesce(n_before, 0) as n_before from a left join b using (run, step) where n_after > coalesce(n_before, 0) and n_after > 1""")
def mrg07_newly_redone(v):
    again = v.run_events.where("step % 13 = 0").withColumn("t", F.col("t") + 60)
    return M.newly_redone(v.run_events.where("t < 1704900000"), v.run_events.unionByName(again)).select("run", "step", "n_after", "n_before")


@query("""select run, tag, arg_max(value, step) filter (value is not null) as value, arg_max(odd, step) filter (odd is not null) as odd
from (select run, tag, step, round(value, 9) as value, case when step % 2 = 1 then step end as odd from snap_old) group by all""")
def mrg08_latest_not_null(v):
    rows = v.snap_old.select("run", "tag", "step", F.round("value", 9).alias("value"), F.when(F.col("step") % 2 == 1, F.col("step")).alias("odd"))
    return M.latest_not_null(rows, ["run", "tag"], "step")


@query(""", a as (select run, tag, min(step) as f, max(step) as l from snap_old where value is not null group by all), b as (select run, tag, min(step) as f, max(step) as l from snap_new where value is not null group by all)
select run, tag, min(f) as first_seen, max(l) as last_seen from (select * from a union all select * from b) group by all""")
def mrg09_extend_lifecycle(v):
    seen = [M.lifecycle(s.where("value is not null").withColumnRenamed("step", "at")) for s in (v.snap_old, v.snap_new)]
    return M.extend_lifecycle(*seen)


@query("select run, step from (select distinct run, step from snap_old) union select distinct run, step from snap_new")
def mrg10_insert_or_ignore(v):
    old, new = (s.select("run", "step").distinct() for s in (v.snap_old, v.snap_new))
    return M.insert_missing(old, new, ["run", "step"])


@query("select c_custkey from customer where c_custkey % 10 = 0 or c_custkey % 7 = 0 and c_custkey % 3 <> 0 and c_acctbal <> round(c_acctbal, 0)")
def mrg12_changed_configs(v):
    c = v.table("customer")
    old = c.where("c_custkey % 10 <> 0").withColumns({"c_phone": F.lit(1), "c_acctbal": F.when((F.col("c_custkey") % 7 == 0) & (F.col("c_custkey") % 3 != 0), F.round("c_acctbal", 0)).otherwise(F.col("c_acctbal"))})
    return M.changed_configs(old, c.withColumn("c_phone", F.lit(2)), "c_custkey", ["c_phone"])


@query("select run, t from (select run, t, row_number() over (partition by run order by t desc) as k from restarts where t > 1704300000) where k <= 60")
def mrg14_rolling_entries(v):
    k = F.row_number().over(Window.partitionBy("run").orderBy(F.desc("t")))
    return v.restarts.where("t > 1704300000").withColumn("k", k).where("k <= 60").select("run", "t")
