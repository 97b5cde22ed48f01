"""Stream state: snapshots in any order end in the rows of the batch replay, and a stopped stream goes on from its state."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from runlens.streaming import ingest as I
from runlens.streaming import state as S

SNAP = "run string, at double, tag string, step int, value double, t double"


def snapshots(seed):
    """(capture, rows): cells and ends of steps of two runs, in which values go missing, differ, and steps end twice."""
    r = random.Random(seed)
    out = []
    for at in range(1, 7):
        rows = []
        for run in "ab":
            for step in range(1, 2 * at + 1):
                rows.append((run, float(at), None, step, None, float(step)))
                if step % 3 == 0 and at >= 4:
                    rows.append((run, float(at), None, step, None, 100.0 + step))
                rows += [(run, float(at), f"m{k}", step, r.choice([None, 1.0, float(at), 7.5]), None) for k in range(5)]
        out.append((at, rows + [(None, float(at), "m0", 1, 9.0, None), ("a", None, "m0", 1, 9.0, None), ("a", float(at), "m0", None, 9.0, None)]))
    return out


def replay(captures):
    """Captures in order: an empty cell is filled, a step that has just ended is rewritten, all else stays."""
    cells, ends = {}, {}
    for at, rows in sorted(captures):
        rows = [r for r in rows if r[0] is not None and r[1] is not None and r[3] is not None]
        new = {(r[0], r[3]) for r in rows if r[2] is None and (r[0], r[3], r[5]) not in ends}
        ends.update({(r[0], r[3], r[5]): at for r in rows if r[2] is None})
        for run, _, tag, step, value, _ in rows:
            if tag is not None and value is not None and ((run, tag, step) not in cells or (run, step) in new):
                cells[run, tag, step] = value
    return sorted((*k, v) for k, v in cells.items())


def write(spark, rows, folder):
    spark.createDataFrame(rows, SNAP).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder):
    return spark.readStream.schema(SNAP).option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.mark.parametrize("seed", [1, 2])
def test_shuffled_late_and_repeated_snapshots(spark, tmp_path, seed):
    captures = snapshots(seed)
    order = captures + [captures[2]]
    random.Random(seed).shuffle(order)
    folder = str(tmp_path / "s")
    for _, rows in order[:3]:
        write(spark, rows, f"{folder}/in")
    first = S.merged_cells(stream(spark, f"{folder}/in"), folder, shards=2)
    assert sorted(map(tuple, first.collect())) == replay(order[:3])
    for _, rows in order[3:]:  # a new query on the same folder: it goes on from the checkpoint
        write(spark, rows, f"{folder}/in")
    again = S.merged_cells(stream(spark, f"{folder}/in"), folder, shards=2)
    assert sorted(map(tuple, again.collect())) == replay(captures)
    assert {r.batch for r in spark.read.parquet(f"{folder}/rows").select("batch").distinct().collect()} <= set(range(7))
    rows = sorted(map(tuple, again.collect()))
    assert sorted(map(tuple, S.merged_cells(stream(spark, f"{folder}/in"), folder, shards=2).collect())) == rows  # nothing new


def test_conflicts_are_told_and_change_nothing(spark, tmp_path):
    folder = str(tmp_path / "s")
    for at, value in ((1.0, 5.0), (2.0, 6.0)):
        write(spark, [("a", at, None, 1, None, 1.0), ("a", at, "m", 1, value, None)], f"{folder}/in")
    S.merged_cells(stream(spark, f"{folder}/in"), folder)
    found = spark.read.parquet(f"{folder}/rows").orderBy("batch").select("value", "offered", "change").collect()
    assert [tuple(r) for r in found] == [(5.0, 5.0, "filled"), (5.0, 6.0, "conflict")]


STATUS = "run string, at timestamp, last_step int, steps array<int>, ends array<int>"
T0 = datetime(2024, 1, 1)


def status(k, last=3, ends=(1, 1, 1), run="a"):
    return (run, T0 + timedelta(minutes=k), last, list(range(1, len(ends) + 1)), list(ends))


def decisions(spark, folder, force=3):
    found = S.drained(S.fetch_decisions(I.file_stream(spark, f"{folder}/in"), "30 minutes", force), folder, "append")
    return [(int((r.at - T0).total_seconds()) // 60, r.why, r.skips) for r in found.where("run = 'a'").orderBy("at").collect()]


def test_skips_refreshes_and_the_order_of_captures(spark, tmp_path):
    folder = str(tmp_path / "s")

    def feed(*rows):
        spark.createDataFrame(rows, STATUS).coalesce(1).write.mode("append").parquet(f"{folder}/in")

    feed(status(0), status(2), status(1), status(2))
    feed(status(5, 3, (1, 2, 1)), status(3), status(4), status(8), status(6), status(7), status(9, 4, (1, 2, 1, 1)))
    feed((None, T0 + timedelta(minutes=60), None, None, None))
    want = [(0, "no data", 0), (1, "unchanged", 1), (2, "unchanged", 2), (3, "unchanged", 3), (4, "full refresh due", 0), (5, "redone steps", 0), (6, "unchanged", 1), (7, "unchanged", 2), (8, "unchanged", 3), (9, "new steps", 0)]
    assert decisions(spark, folder) == want
    feed(status(20, 2), status(70, 4, (1, 2, 1, 1)), ("b", T0 + timedelta(minutes=71), 1, [1], [1]))  # the first is later than the watermark
    feed((None, T0 + timedelta(minutes=200), None, None, None))
    assert decisions(spark, folder) == [*want, (70, "unchanged", 1)]
