"""Merges of a new snapshot into a stored one. Each is one shuffle by key; merging the same snapshot again changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELL = ["run", "tag", "step"]


def merge_series(old: DataFrame, new: DataFrame, redo: DataFrame | None = None) -> DataFrame:
    """run, tag, step, value, change: every cell after the merge, and what happened to it.

    A missing cell is filled; an equal value changes nothing; a different one replaces the old only in a step of `redo`
    (run, step) and is a conflict otherwise. change: kept, filled, rewritten, conflict. A new value is never removed.
    """
    both = old.select(*CELL, F.col("value").alias("was")).join(new.select(*CELL, F.col("value").alias("now")), CELL, "full")
    if redo is None:
        both = both.withColumn("again", F.lit(False))
    else:
        both = both.join(redo.select("run", "step").distinct().withColumn("again", F.lit(True)), ["run", "step"], "left")
    again = F.coalesce("again", F.lit(False))
    differs = F.col("was").isNotNull() & F.col("now").isNotNull() & (F.col("was") != F.col("now"))
    change = F.when(F.col("was").isNull() & F.col("now").isNotNull(), "filled").when(differs & again, "rewritten").when(differs, "conflict").otherwise("kept")
    return both.select(*CELL, F.when(differs & again, F.col("now")).otherwise(F.coalesce("was", "now")).alias("value"), change.alias("change"))


def first_by_key(old: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows of old, and those of new whose key old lacks; within a table the first in `order` counts. Nulls in a key are equal."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("_new", *order))
    return both.withColumn("_rank", rank).where("_rank = 1").drop("_rank", "_new")


def insert_missing(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old with the rows of new whose key it lacks; old rows are never changed."""
    return old.unionByName(new.join(old.select(*key).distinct(), key, "left_anti"))


def latest_not_null(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Per key and column, the last value in `order` that isn't NULL."""
    values = [c for c in rows.columns if c not in (*key, order)]
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in values]
    return rows.groupBy(*key).agg(*last)


def lifecycle(seen: DataFrame) -> DataFrame:
    """run, tag, first_seen, last_seen from sightings (run, tag, at). A tag that is gone keeps its last sighting."""
    return seen.groupBy("run", "tag").agg(F.min("at").alias("first_seen"), F.max("at").alias("last_seen"))


def extend_lifecycle(known: DataFrame, fresh: DataFrame) -> DataFrame:
    """Merged lifecycles: earliest first_seen, latest last_seen."""
    return known.unionByName(fresh).groupBy("run", "tag").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def version_changes(captures: DataFrame) -> DataFrame:
    """run, at, version: the captures (run, at, version) whose version differs from the one before."""
    before = F.lag("version").over(Window.partitionBy("run").orderBy("at"))
    return captures.withColumn("_before", before).where("_before is null or _before <> version").drop("_before")


def redone_steps(events: DataFrame, count: str = "n") -> DataFrame:
    """run, step, n of steps that ended more than once."""
    return events.where("kind = 'step'").groupBy("run", "step").agg(F.count("*").alias(count)).where(F.col(count) > 1)


def newly_redone(before: DataFrame, after: DataFrame) -> DataFrame:
    """run, step, n_before, n_after where a step ended more often in `after` and is redone there."""
    a = after.where("kind = 'step'").groupBy("run", "step").agg(F.count("*").alias("n_after"))
    b = before.where("kind = 'step'").groupBy("run", "step").agg(F.count("*").alias("n_before"))
    joined = a.join(b, ["run", "step"], "left").withColumn("n_before", F.coalesce("n_before", F.lit(0)))
    return joined.where("n_after > n_before and n_after > 1")


def changed_configs(old: DataFrame, new: DataFrame, key: str, ignore: list[str]) -> DataFrame:
    """key of rows that are new or whose columns other than `ignore` differ."""
    columns = [c for c in new.columns if c != key and c not in ignore]
    digest = lambda df, name: df.select(key, F.sha2(F.to_json(F.struct(*columns)), 256).alias(name))
    joined = digest(new, "_now").join(digest(old, "_was"), key, "left")
    return joined.where("_was is null or _was <> _now").select(key)
