"""Queries over stored tables, snapshot folders and versioned results."""

import uuid

from pyspark.sql import functions as F

from runlens.sources import store as S
from runlens.streaming.ingest import state_folder

from .catalog import query

ASOF = 1_705_400_000.0
TAGS = ["events/purchase/m", "events/click/c", "events/error/hi", "events/none"]


def _stored(v) -> str:
    name = f"runlens_fact_{uuid.uuid4().hex}"
    seen = v.fact.join(F.broadcast(v.axis), ["run", "step"]).withColumnRenamed("wall", "at")  # the axis: a row a step
    S.store_fact(seen, name, f"{state_folder(v.spark)}/fact", period=7 * S.DAY)
    return name


@query(f"""select run, tag, step, round(value, 9) as value from fact join axis using (run, step) where run = 'r0' and tag in ({", ".join(f"'{t}'" for t in TAGS)}) and wall <= {ASOF}""")
def src07_scan_by_key(v):
    """A run's series by name as of a time, from the stored table."""
    rows = S.scan(v.spark, _stored(v), runs=["r0"], tags=TAGS, asof=ASOF, period=7 * S.DAY)
    return rows.select("run", "tag", "step", F.round("value", 9).alias("value"))


@query("""select tag, run, count(value) as n, max(step) as last_step, round(avg(value), 9) as mean from fact where run in (select run from restarts group by run having count(*) >= 1) group by all""")
def src07_scan_by_selected_runs(v):
    """Profiles of the series of runs that restarted: the runs are found first, and the scan opens only their folders."""
    runs = v.restarts.groupBy("run").agg(F.count("*").alias("n")).where("n >= 1")
    rows = S.scan_selected(v.spark, _stored(v), runs)
    return rows.groupBy("tag", "run").agg(F.count("value").alias("n"), F.max("step").alias("last_step"), F.round(F.avg("value"), 9).alias("mean"))


@query(""", d as (select run, step, strftime(to_timestamp(max(t))::timestamp, '%Y%m%dT%H%M%SZ') as name, floor(max(t))::bigint as captured from ev where step % 5 = 0 group by all)
select run, tag, f.step, round(value, 9) as value, captured from fact f join d using (run, step) where name <= '20240121T000000Z'""")
def src06_snapshots_as_of(v):
    """Snapshots in folders named by time, read as of a moment: later ones are not opened."""
    folder = state_folder(v.spark)
    days = v.axis.where("step % 5 = 0").withColumn("name", F.date_format(F.timestamp_seconds(F.floor("wall")), "yyyyMMdd'T'HHmmss'Z'"))
    v.fact.join(F.broadcast(days), ["run", "step"]).repartition("name").write.partitionBy("name").json(f"{folder}/all")
    rows = S.read_snapshots(v.spark, folder, "run string, tag string, step int, value double", multiLine=False, asof="20240121T000000Z")
    return rows.select("run", "tag", "step", F.round("value", 9).alias("value"), "captured")


@query("select run, tag, count(value) as n, round(sum(value), 6) as total from fact group by all")
def stm06_versioned_results(v):
    """Totals of every series, kept by the version of their run: first as of a snapshot, then refreshed where the run grew."""
    results = S.ResultStore(v.spark, state_folder(v.spark))
    totals = lambda rows: rows.groupBy("run", "tag").agg(F.count("value").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    for rows, axis in ((v.snap_old, v.axis.where("step <= 20")), (v.fact, v.axis), (v.fact, v.axis)):
        versions = axis.groupBy("run").agg(F.max("wall").cast("string").alias("version"))
        found = results.refresh("totals", versions, rows, totals)
    return found.select("run", "tag", "n", "total")
