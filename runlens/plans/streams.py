"""Queries: streams that read what is there and end, with SQL over the same table."""

from pyspark.sql import functions as F

from runlens.sources.telemetry import epoch
from runlens.streaming import ingest as I
from runlens.streaming import state as S

from .catalog import query


def events(v):
    return I.file_stream(v.spark, f"{v.dir}/events.parquet")


@query("select event_type, count(*) as n, round(sum(value), 4) as total from events group by event_type")
def stm01_micro_batches(v):
    rows = I.append_once(events(v).select("event_id", "event_type", "value"), ["event_id"], I.state_folder(v.spark))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query()
def stm02_event_windows(v):
    """Tumbling windows behind a watermark: which windows are closed at the end depends on the batches."""
    stream = events(v).select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    return I.windowed_counts(stream, "ts", "1 day", "2 days", I.state_folder(v.spark), "event_type")


@query("""select event_type, count(*) as entries, round(min(t), 3) as oldest, round(max(t), 3) as newest from (select event_type, epoch(ts) as t, row_number() over (partition by event_type order by ts desc) as k,
count(*) over (partition by event_type) as c from events) where k <= 60 group by event_type""".replace("count(*) as entries", "max(c) as entries"))
def stm05_latest_entries(v):
    stream = events(v).select("event_type", epoch("ts").alias("t"))
    e = I.latest_entries(stream, "event_type", "t", 60, I.state_folder(v.spark))
    return e.select("event_type", "entries", F.round(F.array_min("times"), 3).alias("oldest"), F.round(F.array_max("times"), 3).alias("newest"))


#: Captures 1 to 5 of the fact, each with the steps that had ended; every third value comes one capture late, values
#: differ between captures, and each tenth step ends once more from capture 4 on.
LATE = """, k as (select unnest([1, 2, 3, 4, 5]) as cap),
cells as (select cap, run, tag, step, case when step % 3 <> cap % 3 then value + 100 * cap end as value from fact, k where step <= 7 * cap),
ends as (select cap, run, step, 1 as t from axis, k where step <= 7 * cap union all select cap, run, step, 2 from axis, k where step <= 7 * cap and step % 10 = 0 and cap >= 4),
again as (select distinct run, step, cap from (select run, step, t, min(cap) as cap from ends group by all))"""


@query(f"""{LATE} select run, tag, step, round(coalesce(max_by(value, cap) filter (again.run is not null), min_by(value, cap)), 9) as value
from cells left join again using (run, step, cap) where value is not null group by run, tag, step""")
def stm03_late_fills(v):
    """Five snapshots, the files of which come out of order and one of them twice, merged by stream state."""
    k = F.broadcast(v.spark.range(1, 6).select(F.col("id").cast("double").alias("at")))
    value = F.when(F.col("step") % 3 != F.col("at") % 3, F.col("value") + 100 * F.col("at"))
    none = lambda kind: F.lit(None).cast(kind)
    cells = v.fact.crossJoin(k).where("step <= 7 * at").select("at", "run", "step", "tag", value.alias("value"), none("double").alias("t"))
    steps = v.axis.crossJoin(k).where("step <= 7 * at").withColumn("t", F.explode(F.when((F.col("step") % 10 == 0) & (F.col("at") >= 4), F.array(F.lit(1.0), F.lit(2.0))).otherwise(F.array(F.lit(1.0)))))
    rows = cells.unionByName(steps.select("at", "run", "step", none("string").alias("tag"), none("double").alias("value"), "t"))
    folder = I.state_folder(v.spark)
    rows.withColumn("capture", F.col("at")).repartition("capture").write.partitionBy("capture").parquet(f"{folder}/all")
    for at in (2, 5, 1, 2, 4, 3):  # one file a capture
        v.spark.read.schema(rows.schema).parquet(f"{folder}/all/capture={at}.0").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = v.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    return S.merged_cells(stream, folder).withColumn("value", F.round("value", 9))


@query(""", first as (select min(wall) as t0 from axis), hours as (select unnest(range(0, 720)) as k),
s as (select run, k, coalesce(max(step) filter (wall <= t0 + 3600 * k), 0) as last_step, count(*) filter (wall <= t0 + 3600 * k) + count(*) filter (step % 13 = 0 and wall + 20000 <= t0 + 3600 * k) as ends
from axis, first, hours group by all having last_step > 0),
o as (select *, row_number() over (partition by run order by k) as i from s),
f as (with recursive f as (select run, k, i, last_step, ends, 0 as skips, 'no data' as why from o where i = 1
union all select o.run, o.k, o.i, o.last_step, o.ends, case when o.last_step = f.last_step and o.ends = f.ends and f.skips < 12 then f.skips + 1 else 0 end,
case when o.last_step <> f.last_step then 'new steps' when o.ends > f.ends then 'redone steps' when f.skips >= 12 then 'full refresh due' else 'unchanged' end from f join o on o.run = f.run and o.i = f.i + 1) from f)
select run, k::bigint as hour, why = 'unchanged' as skip, why, skips from f""")
def stm04_skipped_fetches(v):
    """Hourly statuses of each run: a fetch is skipped while nothing is new, twelve times in a row at most."""
    t0 = F.broadcast(v.axis.agg(F.min("wall").alias("t0")))
    hours = F.broadcast(v.spark.range(720).select(F.col("id").alias("k")))
    rows = v.axis.crossJoin(t0).crossJoin(hours).withColumn("now", F.col("t0") + 3600 * F.col("k")).where("wall <= now")
    n = F.when((F.col("step") % 13 == 0) & (F.col("wall") + 20000 <= F.col("now")), 2).otherwise(1)
    statuses = rows.groupBy("run", "k").agg(F.max("step").alias("last_step"), F.collect_list(F.struct("step", n.alias("n"))).alias("all"))
    at = F.timestamp_seconds((F.col("k") + 1) * 3600)  # the epoch itself is where a watermark starts
    statuses = statuses.select("run", at.alias("at"), "last_step", F.col("all.step").alias("steps"), F.col("all.n").alias("ends"))
    folder = I.state_folder(v.spark)
    statuses.repartitionByRange(6, "at").write.parquet(f"{folder}/in")
    heartbeat = statuses.agg((F.max("at") + F.expr("interval 11 days")).alias("at"))  # so that the last statuses needn't wait
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) if f.name != "at" else F.col("at") for f in statuses.schema]
    heartbeat.select(nothing).write.mode("append").parquet(f"{folder}/in")
    stream = I.file_stream(v.spark, f"{folder}/in", files_per_batch=2)
    found = S.drained(S.fetch_decisions(stream, "10 days"), folder, "append")
    return found.select("run", (F.unix_timestamp("at") / 3600 - 1).cast("long").alias("hour"), "skip", "why", "skips")
