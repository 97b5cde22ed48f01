"""Stored facts, snapshot folders and versioned results: what is read, and what is not."""

import json
import re

import pytest
from pyspark.sql import functions as F

from runlens.sources import store as S

FACT = "run string, tag string, step int, value double, at double"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def executed(df):
    df.collect()
    return plan(df)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rows = [(f"r{r}", f"m{t}", s, None if (t + s) % 7 == 0 else float(r + t * s), 86_400.0 * s) for r in range(3) for t in range(12) for s in range(20)]
    S.store_fact(spark.createDataFrame(rows, FACT), "facts_for_tests", str(tmp_path_factory.mktemp("store") / "fact"), buckets=4, period=5 * S.DAY)
    yield rows
    spark.sql("drop table facts_for_tests")


def test_scan_by_key_and_time(spark, stored):
    got = S.scan(spark, "facts_for_tests", ["r1"], ["m3", "m5", "none"], asof=86_400.0 * 7, period=5 * S.DAY)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((r for r in stored if r[0] == "r1" and r[1] in ("m3", "m5") and r[4] <= 86_400.0 * 7), key=repr)
    text = executed(got)
    filters = re.search(r"PartitionFilters: \[(.*?)\], ", text)[1]
    assert "run#" in filters and "period#" in filters
    assert "LessThanOrEqual(at,604800.0)" in text.split("PushedFilters")[1]
    assert len(S.scan(spark, "facts_for_tests").collect()) == len(stored)


def test_one_tag_reads_one_bucket(spark, stored):
    text = plan(S.scan(spark, "facts_for_tests", tags=["m3"]).groupBy("tag").count())
    assert "SelectedBucketsCount: 1 out of 4" in text


def test_grouping_and_joining_by_tag_need_no_exchange(spark, stored):
    rows = S.scan(spark, "facts_for_tests")
    assert "Exchange" not in plan(rows.groupBy("run", "tag").agg(F.avg("value")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        both = rows.where("run = 'r0'").alias("a").join(rows.where("run = 'r1'").alias("b"), "tag").groupBy("tag").count()
        assert "Exchange" not in plan(both) and "SortMergeJoin" in plan(both)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_runs_found_at_run_time_prune_folders(spark, stored, tmp_path):
    spark.createDataFrame([("r0", "a"), ("r2", "b"), (None, "b")], "run string, mode string").write.parquet(str(tmp_path / "runs"))
    got = S.scan_selected(spark, "facts_for_tests", spark.read.parquet(str(tmp_path / "runs")).where("mode = 'b'"))
    assert {r.run for r in got.collect()} == {"r2"} and got.count() == 240
    assert "dynamicpruning" in plan(got)


def test_cells_that_could_not_be_found_are_refused(spark, tmp_path):
    bad = spark.createDataFrame([("r", None, 1, 1.0, 1.0)], FACT)
    with pytest.raises(Exception, match="no run, tag or time"):
        S.store_fact(bad, "facts_refused", str(tmp_path / "x"))
    spark.sql("drop table if exists facts_refused")


def test_snapshots_after_asof_are_not_opened(spark, tmp_path):
    schema = "run string, values array<double>"
    for k, name in enumerate(("20240101T000000Z", "20240102T120000Z", "captured=20240103T000000Z", "notes", "20240104T000000", "20240105T000000Z")):
        (tmp_path / name).mkdir()
        text = json.dumps({"run": "a", "values": [k, None]}, indent=1) if k < 3 else "{broken"
        (tmp_path / name / "series_a.json").write_text(text)
        (tmp_path / name / "status_a.json").write_text("{also broken")
    read = lambda **more: [(r.captured, r["values"]) for r in S.read_snapshots(spark, str(tmp_path), schema, pattern="series_*.json", **more).orderBy("captured").collect()]
    assert read(asof="20240103T000000Z") == [(1704067200, [0.0, None]), (1704196800, [1.0, None]), (1704240000, [2.0, None])]
    assert read(asof="20240102T120000Z", since="20240102T000000Z") == [(1704196800, [1.0, None])]
    assert read(asof="20231231T000000Z") == []
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ"):
        read()
    df = S.read_snapshots(spark, str(tmp_path), schema, pattern="series_*.json", asof="20240101T000000Z")
    df.collect()
    metrics = df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics()
    assert metrics.apply("numFiles").value() == 1
    assert S.read_snapshots(spark, str(tmp_path / "none"), schema).count() == 0


def totals(rows):
    return rows.groupBy("run").agg(F.sum("v").alias("total"))


def test_results_are_computed_again_only_for_changed_versions(spark, tmp_path):
    store, folder = S.ResultStore(spark, str(tmp_path / "s")), tmp_path / "s/totals/rows"
    source = lambda *rows: spark.createDataFrame(rows, "run string, v long")
    versions = lambda **by: spark.createDataFrame(sorted(by.items()), "run string, version string")
    read = lambda df: {r.run: r.total for r in df.collect()}
    assert read(store.refresh("totals", spark.createDataFrame([], "run string, version string"), source(), totals)) == {}
    assert read(store.refresh("totals", versions(a="1", b="1"), source(("a", 1), ("a", 2), ("b", 5)), totals)) == {"a": 3, "b": 5}
    files = set(folder.rglob("*.parquet"))

    lost = tmp_path / "lost"
    source(("a", 7)).write.parquet(str(lost))
    unreadable = spark.read.parquet(str(lost))
    for f in lost.iterdir():
        f.unlink()
    assert read(store.refresh("totals", versions(a="1", b="1"), unreadable, totals)) == {"a": 3, "b": 5}
    assert set(folder.rglob("*.parquet")) == files

    assert read(store.refresh("totals", versions(a="1", b="2", c="1"), source(("a", 100), ("b", 6), ("c", 1)), totals)) == {"a": 3, "b": 6, "c": 1}
    assert {f.parent.name for f in set(folder.rglob("*.parquet")) - files} == {"run=b", "run=c"}
    assert read(store.refresh("totals", versions(b="2"), unreadable, totals)) == {"b": 6}
    with pytest.raises(Exception):
        store.refresh("totals", versions(b="3"), unreadable, totals)
    assert read(store.read("totals")) == {"b": 6}  # a refresh that failed changed nothing
    assert "generation" in re.search(r"PartitionFilters: \[(.*?)\]", executed(store.read("totals")))[1]
