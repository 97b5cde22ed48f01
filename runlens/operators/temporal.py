"""As-of and interval joins over time.

Rows are dealt by key and time bucket, so one busy key is spread over many tasks. Within a bucket the latest row before
a probe comes from a window; probes that find none take the last row of an earlier bucket, from a small table with one
row per key and bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(probes: DataFrame, facts: DataFrame, on: list[str], probe_t: str, fact_t: str, take: list[str], backward: bool = True, bucket: float = 86_400.0, strict: bool = False) -> DataFrame:
    """probes with the columns `take` of the latest fact at or before (backward) or the first at or after each probe.

    strict: facts at the probe's own time do not count.
    Without such a fact they are NULL, and no fact from the other side is ever used. Facts at the same time: the one
    whose `take` columns compare greatest counts, or least when looking forward. Keys are compared as equal values.
    """
    sign = 1 if backward else -1
    when = lambda c: F.col(c) * sign
    place = F.floor(F.col("_t") / bucket)
    payload = F.struct(F.col(fact_t).alias("_at"), *take)
    right = facts.select(*on, when(fact_t).alias("_t"), payload.alias("_fact")).groupBy(*on, "_t").agg((F.max if backward else F.min)("_fact").alias("_fact")).withColumn("_b", place)
    left = probes.withColumn("_t", when(probe_t)).withColumn("_b", place)
    joined = left.withColumns({"_fact": F.lit(None).cast(right.schema["_fact"].dataType), "_probe": F.lit(1)}).unionByName(right.withColumn("_probe", F.lit(0)), allowMissingColumns=True)
    near = Window.partitionBy(*on, "_b").orderBy("_t", F.desc("_probe") if strict else F.asc("_probe")).rowsBetween(Window.unboundedPreceding, 0)
    found = joined.withColumn("_near", F.last("_fact", ignorenulls=True).over(near)).where("_probe = 1").drop("_fact")
    # The last fact of each bucket, and for each bucket the last one of those before it.
    ends = right.groupBy(*on, "_b").agg(F.max_by("_fact", "_t").alias("_end"))
    buckets = ends.unionByName(left.select(*on, "_b").distinct(), allowMissingColumns=True).groupBy(*on, "_b").agg(F.max("_end").alias("_end"))
    before = Window.partitionBy(*on).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = buckets.select(*on, "_b", F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    out = found.join(carried, [*on, "_b"], "left").withColumn("_got", F.coalesce("_near", "_carried"))
    return out.select(*probes.columns, *(F.col(f"_got.{c}").alias(c) for c in take))


def step_at(probes: DataFrame, axis: DataFrame, t: str, mode: str) -> DataFrame:
    """probes (with run) and step, by one of the ways to map a time to a step.

    last: the last step that had ended; first: the first step that ends at or after t; running: the step after the last
    ended one, at most the last of the run, 1 before any.
    """
    if mode == "first":
        return as_of(probes, axis, ["run"], t, "wall", ["step"], backward=False)
    found = as_of(probes, axis, ["run"], t, "wall", ["step"])
    if mode == "last":
        return found
    last = F.broadcast(axis.groupBy("run").agg(F.max("step").alias("_n")))  # one row a run
    return found.join(last, "run").withColumn("step", F.least(F.coalesce("step", F.lit(0)) + 1, "_n")).drop("_n")


def step_windows(axis: DataFrame) -> DataFrame:
    """run, step, start, wall: the half-open time window (start, wall] of each step; the first has no start."""
    return axis.select("run", "step", F.lag("wall").over(Window.partitionBy("run").orderBy("step")).alias("start"), "wall")
