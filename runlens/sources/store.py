"""Stored facts and results: a table scanned by key and time, folders of snapshots named by their time, results kept by version."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = 86_400.0


def store_fact(fact: DataFrame, name: str, path: str, buckets: int = 16, period: float = 30 * DAY) -> None:
    """Writes run, tag, step, value, at (epoch seconds when the cell became visible) as table `name` under `path`.

    Files are laid out by run and by period of `at`, and within these bucketed and sorted by tag, so that scans by run or
    time skip folders, scans by tag skip buckets, and grouping or joining by tag needs no shuffle. Cells without run, tag
    or time could never be scanned and are an error.
    """
    known = F.assert_true(F.col("run").isNotNull() & F.col("tag").isNotNull() & F.col("at").isNotNull(), "a cell has no run, tag or time")
    rows = fact.select("run", "tag", "step", "value", "at", F.floor(F.col("at") / period).alias("period")).where(F.coalesce(known.cast("boolean"), F.lit(True)))
    rows.repartition(buckets, "tag").write.partitionBy("run", "period").bucketBy(buckets, "tag").sortBy("tag", "step").option("path", path).mode("overwrite").saveAsTable(name)


def scan(spark: SparkSession, name: str, runs: list[str] | None = None, tags: list[str] | None = None, asof: float | None = None, period: float = 30 * DAY) -> DataFrame:
    """run, tag, step, value, at of a stored fact: of these runs and tags (None: all), as it was visible at `asof`.

    Nothing that became visible later is returned. `period` must be that of store_fact.
    """
    rows = spark.read.table(name)
    if runs is not None:
        rows = rows.where(F.col("run").isin(runs))
    if tags is not None:
        rows = rows.where(F.col("tag").isin(tags))
    if asof is not None:
        rows = rows.where((F.col("period") <= int(asof // period)) & (F.col("at") <= asof))
    return rows.select("run", "tag", "step", "value", "at")


def scan_selected(spark: SparkSession, name: str, selected: DataFrame) -> DataFrame:
    """run, tag, step, value, at of the runs in `selected` (a filtered table with column run, a row for each run): its runs,
    known only when it is read, decide which folders are opened."""
    return spark.read.table(name).join(F.broadcast(selected.select("run").distinct()), "run").select("run", "tag", "step", "value", "at")


_STAMP = r"/(?:[^/=]+=)?(\d{8}T\d{6}Z)/[^/]*$"


def read_snapshots(spark: SparkSession, folder: str, schema: str, form: str = "json", pattern: str = "*", asof: str | None = None, since: str | None = None, **options) -> DataFrame:
    """The files folder/<YYYYMMDDTHHMMSSZ>/<pattern> with column captured, the epoch seconds that the folder's name states.

    A folder may also be named <column>=<time>, as partitionBy writes it.
    asof and since are such names: snapshots after asof or before since are not opened, as the scan is pruned by path.
    Folders with other names are skipped, as is a missing folder. A JSON file is one document, if `multiLine` isn't set.
    """
    if form == "json":
        options = {"multiLine": True, "mode": "FAILFAST", **options}
    try:
        rows = spark.read.schema(schema).format(form).options(**options).load(f"{folder}/*/{pattern}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema).withColumn("captured", F.lit(None).cast("long"))
    stamp = F.regexp_extract(F.col("_metadata.file_path"), _STAMP, 1)
    rows = rows.where(stamp != "")
    if asof is not None:
        rows = rows.where(stamp <= asof)
    if since is not None:
        rows = rows.where(stamp >= since)
    return rows.withColumn("captured", F.unix_timestamp(F.to_timestamp(stamp, "yyyyMMdd'T'HHmmssX")))


class ResultStore:
    """Results by key and version in a folder. A key is computed again only if its version changed.

    Each refresh that changes something writes the changed keys' rows and then a new manifest (key, version, generation)
    under a new number, so readers of the last manifest are never disturbed, and a refresh that fails leaves no trace in
    it. One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str = "run"):
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), key

    def manifest(self, name: str) -> DataFrame | None:
        """key, version, generation of what is stored under a name; None if nothing is."""
        try:
            every = self.spark.read.schema(f"{self.key} string, version string, generation long, manifest long").parquet(f"{self.folder}/{name}/manifests")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        last = every.agg(F.max("manifest")).first()[0]
        return None if last is None else every.where(F.col("manifest") == last)

    def refresh(self, name: str, versions: DataFrame, source: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The rows of compute(source) for every key of `versions` (key, version); its output must hold the key.

        `source` is read for keys that are new or have another version than stored, and not at all if there are none. Keys
        that `versions` lacks are no longer returned. compute() must treat each key on its own.
        """
        key, held = self.key, self.manifest(name)
        wanted = versions.select(F.col(key).cast("string").alias(key), F.col("version").cast("string").alias("version")).where(F.col(key).isNotNull()).distinct()
        number = 0 if held is None else held.first()["manifest"] + 1
        kept = None if held is None else held.join(wanted, [key, "version"], "left_semi").select(key, "version", "generation")
        changed = wanted if held is None else wanted.join(held, [key, "version"], "left_anti")
        changed = self.spark.createDataFrame(changed.collect(), wanted.schema)  # a row for each key
        gone = held is not None and not held.join(wanted, key, "left_anti").isEmpty()
        if not changed.isEmpty():
            part = compute(source.join(F.broadcast(changed.select(key)), key, "left_semi"))
            part.write.mode("overwrite").partitionBy(key).parquet(f"{self.folder}/{name}/rows/generation={number}")
        if gone or not changed.isEmpty():
            now = changed.withColumn("generation", F.lit(number).cast("long"))
            (now if kept is None else now.unionByName(kept)).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/{name}/manifests/manifest={number}")
        try:
            return self.read(name)
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return compute(source.limit(0))  # nothing was ever stored

    def read(self, name: str) -> DataFrame:
        """The rows of the last manifest's keys; the join prunes folders of other generations and keys."""
        held = self.manifest(name)
        live = F.broadcast((self.spark.createDataFrame([], f"{self.key} string, generation long") if held is None else held).select(self.key, "generation"))
        rows = self.spark.read.option("basePath", f"{self.folder}/{name}/rows").parquet(f"{self.folder}/{name}/rows")
        return rows.withColumn(self.key, F.col(self.key).cast("string")).join(live, [self.key, "generation"]).drop("generation")
