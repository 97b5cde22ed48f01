"""Inputs on which a query once differed from its SQL or did more work than its rows call for."""

import random

import duckdb
from pyspark.sql import functions as F

from runlens.functions.text import lower_by_character, upper_by_character
from runlens.operators.changes import level_shift
from runlens.operators.context import attributed, attributed_by_hints
from runlens.plans import catalog


def test_case_goes_by_character_as_in_sql(spark):
    new = {0x19B, 0x264, 0x1C89, 0x1C8A}  # got a case with Unicode 16, which DuckDB's tables lack
    texts = [chr(i) for i in (*range(1, 0x3000), *range(0xFB00, 0xFB20), *range(0x10400, 0x10450)) if i not in new] + ["Straße, ﬁn, ΑΣ İI", "ΐΰ ß", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    got = rows.select("i", upper_by_character(F.col("text")), lower_by_character(F.col("text"))).collect()
    con = duckdb.connect()
    con.sql("create table t (i bigint, text varchar)")
    con.sql("insert into t select i, chr(i::int) from range(1, 70000) r(i) where i < 55296 or i > 57343")
    one = {chr(i): (u, d) for i, u, d in con.sql("select i, upper(text), lower(text) from t").fetchall()}
    want = {t: (None, None) if t is None else tuple("".join(one[c][k] for c in t) for k in (0, 1)) for t in texts}
    assert {texts[i]: (u, d) for i, u, d in got} == want


def test_a_cut_without_ratio_comes_last(spark):
    """Medians of zero have no ratio: such cuts once beat all others."""
    rows = [("r", "a", i, v) for i, v in enumerate([0.0] * 7 + [2.0] * 3)] + [("r", "z", i, 0.0) for i in range(7)]
    got = {x.tag: (x.k, x.ratio, x.disjoint) for x in level_shift(spark.createDataFrame(rows, "run string, tag string, step int, value double")).collect()}
    assert got == {"a": (4, 0.0, False), "z": (3, None, False)}


catalog.load()


def events(spark, path, rows):
    table = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
    table.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(f"{path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{path}/events.parquet/*.parquet'")
    return con


def key(row):
    return tuple((x is None, x) for x in row)


def test_neighbouring_steps_without_run_or_time(spark, tmp_path):
    """The steps around a restart come from as-of joins: a frame to the end of a run was read anew for every row."""
    at = [("error", "2024-01-01 10:00:00"), ("view", "2024-01-01 12:00:00"), ("error", "2024-01-02 08:00:00"), ("error", "2024-01-02 08:00:00"), ("error", None), ("error", "2024-01-04 00:00:00"), ("view", "2024-01-06 00:00:01")]
    rows = [(i, ts, user, kind, 1.0, "{}") for i, (kind, ts, user) in enumerate((k, t, u) for k, t in at for u in (1, 2, None))]
    con = events(spark, tmp_path, rows)
    got = catalog.QUERIES["jon09_neighbouring_steps"](spark, str(tmp_path))
    assert "unboundedfollowing" not in got._jdf.queryExecution().toString().lower()
    want = con.sql(f"select run, t, before, after from ({catalog.ORACLES['jon09_neighbouring_steps']})").fetchall()
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_dense_restarts_make_no_pairs(spark):
    """1,500 notices within reach of 1,500 restarts gave 2,250,000 pairs; the rows between joins now grow with the input."""
    r = random.Random(3)
    restarts = [(i, "ab"[i % 2], i % 4 or None, r.randrange(4000) / 4) for i in range(1500)]
    notices = [(i, r.randrange(4000) / 4, r.choice(["a", "b", None]), r.choice([1, 3, 9, None])) for i in range(1500)]
    within, episode = 300.0, 7.5

    def want(fits):
        anchored = []
        for i, at, run, step in notices:
            near = [(abs(t - at), t, e, u) for e, u, s, t in restarts if abs(t - at) <= within and fits(u, s, i, run, step)]
            if near:
                anchored.append((at, i, *min(near)[1::2]))
        first = {e: min(((at, i, t - at) for at, i, anchor, run in anchored if run == u and abs(t - anchor) <= episode), default=(None, None, None))[1:] for e, u, _, t in restarts}
        return first

    table = spark.createDataFrame(restarts, "event_id long, run string, step int, t double")
    n = spark.createDataFrame(notices, "notice_id long, t double, hint_run string, hint_step int")
    plain = n.select("notice_id", "t", F.when(F.col("notice_id") % 2 == 0, "a").otherwise("b").alias("run"))
    for found, fits in (
        (attributed(table.drop("step"), plain, within, episode), lambda u, s, i, run, step: u == "ab"[i % 2]),
        (attributed_by_hints(table, n, within, episode), lambda u, s, i, run, step: run in (None, u) and (step is None or s is not None and abs(s - step) <= 1)),
    ):
        assert {x.event_id: (x.notice_id, x.delta) for x in found.collect()} == want(fits)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "<= 300.0" in plan and not [line for line in plan.split("\n") if "Join Inner" in line]
