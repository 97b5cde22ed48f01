"""Canonical telemetry views: long fact tables built from raw event and order tables.

The fact is always long (run, tag, step, value); a missing value is NULL, never NaN. Every view is lazy, reads only the
columns it needs and aggregates before it shuffles.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Steps are days, counted from this one as 1; a parameter of Telemetry.
START = "2024-01-01"
STATS = {"count": "c", "mean": "m", "max": "hi", "min": "lo", "stdev": "sd", "sum": "s"}


def epoch(ts: str) -> Column:
    """Seconds since 1970 with fraction, of a timestamp without time zone: the same in every session."""
    seconds = F.datediff(F.col(ts), F.lit("1970-01-01").cast("date")).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    micros = (F.extract(F.lit("SECOND"), F.col(ts)) * 1_000_000).cast("long")
    return (seconds * 1_000_000 + micros) / 1e6


def finite(c: Column) -> Column:
    """NaN and infinities as NULL."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


class Telemetry:
    """Views over the tables of one directory."""

    def __init__(self, spark: SparkSession, sf_dir: str, start: str = START):
        self.spark, self.dir, self.start = spark, sf_dir, start

    def day(self, ts: str) -> Column:
        """The step of a timestamp: days since the start, which is 1."""
        return F.datediff(F.col(ts), F.lit(self.start).cast("date")) + 1

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def ev(self) -> DataFrame:
        """run, step (day since the start), event_type, value, t (epoch seconds) of every event."""
        return self.table("events").select(
            "event_id",
            F.concat(F.lit("r"), (F.col("user_id") % 2).cast("string")).alias("run"),
            self.day("ts").alias("step"),
            "event_type",
            finite(F.col("value")).alias("value"),
            epoch("ts").alias("t"),
        )

    @cached_property
    def fact(self) -> DataFrame:
        """run, tag, step, value: six statistics of each event type and day; the spread is missing on days 3, 10, ..."""
        daily = self.ev.groupBy("run", "step", "event_type").agg(
            F.count("*").cast("double").alias("c"),
            F.avg("value").alias("m"),
            F.max("value").alias("hi"),
            F.min("value").alias("lo"),
            F.stddev_samp("value").alias("sd"),
            F.sum("value").alias("s"),
        )
        long = daily.unpivot(["run", "step", "event_type"], list(STATS.values()), "stat", "value")
        gap = (F.col("stat") == "sd") & (F.col("step") % 7 == 3)
        return long.select("run", F.concat_ws("/", F.lit("events"), "event_type", "stat").alias("tag"), "step", F.when(~gap, F.col("value")).alias("value"))

    @cached_property
    def axis(self) -> DataFrame:
        """run, step, wall: when each step ended."""
        return self.ev.groupBy("run", "step").agg(F.max("t").alias("wall"))

    @cached_property
    def run_events(self) -> DataFrame:
        """run, t, kind, step: ends of steps, and restarts (error events, without a step)."""
        ends = self.axis.select("run", F.col("wall").alias("t"), F.lit("step").alias("kind"), "step")
        restarts = self.restarts.select("run", "t", F.lit("restart").alias("kind"), F.lit(None).cast("int").alias("step"))
        return ends.unionByName(restarts)

    @cached_property
    def restarts(self) -> DataFrame:
        return self.ev.where("event_type = 'error'").select("run", "event_id", "t")

    @cached_property
    def panel(self) -> DataFrame:
        """dataset, step (quarter), weight, rate: part brands in order lines."""
        line = self.table("lineitem").select("l_partkey", "l_quantity", "l_returnflag", "l_shipdate")
        part = self.table("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("dataset"))
        step = (F.year("l_shipdate") - 1995) * 4 + F.quarter("l_shipdate")
        return line.join(part, "l_partkey").groupBy("dataset", step.cast("int").alias("step")).agg(
            F.sum("l_quantity").alias("weight"), F.avg((F.col("l_returnflag") == "R").cast("double")).alias("rate")
        )

    @cached_property
    def monthly(self) -> DataFrame:
        """run, tag, step, value: monthly means of order lines by return flag."""
        line = self.table("lineitem")
        step = (F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate")
        means = line.groupBy(F.col("l_returnflag").alias("run"), step.cast("int").alias("step")).agg(
            F.avg("l_discount").alias("disc"), F.avg("l_quantity").alias("qty"), F.avg("l_extendedprice").alias("price"), F.avg("l_tax").alias("tax")
        )
        return means.unpivot(["run", "step"], ["disc", "qty", "price", "tax"], "stat", "value").select("run", F.concat(F.lit("lines/"), "stat").alias("tag"), "step", "value")

    @cached_property
    def bench(self) -> DataFrame:
        """bkey, run, step, value: a score on every day."""
        return self.fact.where("tag = 'events/purchase/m'").select(F.lit("score").alias("bkey"), "run", "step", "value")

    @cached_property
    def snap_old(self) -> DataFrame:
        """The fact up to step 20, with every fifth step missing."""
        return self.fact.where("step <= 20").withColumn("value", F.when(F.col("step") % 5 != 0, F.col("value")))

    @cached_property
    def snap_new(self) -> DataFrame:
        """The fact after step 5, up to step 20 without minima, changed at every eleventh step; with snap_old it holds every cell."""
        moved = F.col("value") + F.when(F.col("step") % 11 == 0, 1.0).otherwise(0.0)
        return self.fact.where("step > 20 or step > 5 and not tag like '%/lo'").withColumn("value", moved)


#: The same views in DuckDB's SQL, as common table expressions.
SQL_VIEWS = f"""ev as (select event_id, 'r' || (user_id % 2) as run, (datediff('day', date '{START}', ts) + 1)::int as step, event_type,
  case when isfinite(value) then value end as value, epoch(ts) as t from events),
daily as (select run, step, event_type, count(*)::double as c, avg(value) as m, max(value) as hi, min(value) as lo,
  stddev_samp(value) as sd, sum(value) as s from ev group by all),
daily_long as (from daily unpivot include nulls (value for stat in (c, m, hi, lo, sd, s))),
fact as (select run, 'events/' || event_type || '/' || stat as tag, step, case when not (stat = 'sd' and step % 7 = 3) then value end as value from daily_long),
axis as (select run, step, max(t) as wall from ev group by run, step),
restarts as (select run, event_id, t from ev where event_type = 'error'),
run_events as (select run, wall as t, 'step' as kind, step from axis union all select run, t, 'restart', null::int from restarts),
panel as (select p_brand as dataset, ((year(l_shipdate) - 1995) * 4 + quarter(l_shipdate))::int as step, sum(l_quantity) as weight,
  avg((l_returnflag = 'R')::int::double) as rate from lineitem join part on l_partkey = p_partkey group by all),
monthly_wide as (select l_returnflag as run, ((year(l_shipdate) - 1995) * 12 + month(l_shipdate))::int as step, avg(l_discount) as disc,
  avg(l_quantity) as qty, avg(l_extendedprice) as price, avg(l_tax) as tax from lineitem group by all),
monthly as (select run, 'lines/' || stat as tag, step, value from (from monthly_wide unpivot include nulls (value for stat in (disc, qty, price, tax)))),
bench as (select 'score' as bkey, run, step, value from fact where tag = 'events/purchase/m'),
snap_old as (select run, tag, step, case when step % 5 <> 0 then value end as value from fact where step <= 20),
snap_new as (select run, tag, step, value + case when step % 11 = 0 then 1.0 else 0.0 end as value from fact where step > 20 or step > 5 and tag not like '%/lo')
"""
