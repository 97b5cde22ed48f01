"""Stream state that outlives a micro-batch: late fills and redone steps of snapshots, and the counter of skipped fetches.

Both need the RocksDB state store (use_state_store), which keeps state on disk and checkpoints it with the stream.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Parts into which the metrics of one step are dealt.
SHARDS = 16


def use_state_store(spark: SparkSession) -> None:
    """Keeps the state of this session's streams in RocksDB, unless another store is set. Streams that ran before keep theirs."""
    if spark.conf.get(_PROVIDER, _ROCKS) != _ROCKS and "HDFSBackedStateStoreProvider" not in spark.conf.get(_PROVIDER):
        return
    spark.conf.set(_PROVIDER, _ROCKS)


def _settled(cells: pd.DataFrame, redone: set[float]) -> pd.Series:
    """Value by tag of (tag, at, value): that of the last capture of `redone`, else that of the first capture."""
    again = cells[cells["at"].isin(redone)]
    first = cells.loc[cells.groupby("tag")["at"].idxmin()].set_index("tag")["value"]
    if again.empty:
        return first
    last = again.loc[again.groupby("tag")["at"].idxmax()].set_index("tag")["value"]
    return last.reindex(first.index).fillna(first)


class LateFills(StatefulProcessor):
    """State of one (run, step, shard): when each end of the step was first captured, and the values that may still count.

    A capture in which an end of the step first shows may rewrite values (the step was done again); any other capture
    only fills what is empty. So the value of a cell is that of the last rewriting capture that has one, else that of the
    first capture that has one. Captures may come in any order and more than once: of a metric the values of its first
    capture and of the rewriting ones are kept, no others can ever count.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cells = handle.getValueState("cells", "tag array<string>, at array<double>, value array<double>")
        self.ends = handle.getValueState("ends", "t array<double>, at array<double>")

    def handleInputRows(self, key, rows, timerValues):
        run, step, _ = key
        fresh = pd.concat(list(rows), ignore_index=True)
        held = self._read(self.cells, ["tag", "at", "value"])
        ends = self._read(self.ends, ["t", "at"])
        before = _settled(held, set(ends["at"])) if len(held) else pd.Series(dtype=float)
        seen = fresh.loc[fresh["tag"].isna(), ["t", "at"]]
        if len(seen):
            ends = pd.concat([ends, seen]).groupby("t", as_index=False)["at"].min()
            self.ends.update((ends["t"].tolist(), ends["at"].tolist()))
        redone = set(ends["at"])
        offered = fresh.loc[fresh["tag"].notna() & fresh["value"].notna(), ["tag", "at", "value"]].sort_values(["tag", "at", "value"])
        cells = pd.concat([held, offered], ignore_index=True).drop_duplicates(["tag", "at"])
        if cells.empty:
            return
        cells = cells[cells["at"].isin(redone) | (cells["at"] == cells.groupby("tag")["at"].transform("min"))].reset_index(drop=True)
        self.cells.update((cells["tag"].tolist(), cells["at"].tolist(), cells["value"].tolist()))
        now = _settled(cells, redone)
        was = before.reindex(now.index)
        filled, rewritten = was.isna(), was.notna() & (was != now)
        changed = now[filled | rewritten]
        kind = filled.loc[changed.index].map({True: "filled", False: "rewritten"})
        out = [pd.DataFrame({"tag": changed.index, "value": changed.array, "offered": changed.array, "change": kind.array})]
        differs = offered[(offered["value"].to_numpy() != now.reindex(offered["tag"]).to_numpy()) & ~offered["at"].isin(redone).to_numpy()]
        if len(differs):
            out.append(pd.DataFrame({"tag": differs["tag"].array, "value": now.reindex(differs["tag"]).array, "offered": differs["value"].array, "change": "conflict"}))
        for found in out:
            found.insert(0, "run", run)
            found.insert(2, "step", step)
            yield found

    @staticmethod
    def _read(state, names: list[str]) -> pd.DataFrame:
        columns = state.get() if state.exists() else None
        return pd.DataFrame({n: pd.Series(list(columns[k]) if columns is not None else [], dtype=object if n == "tag" else float) for k, n in enumerate(names)})

    def close(self) -> None:
        pass


CHANGES = "run string, tag string, step int, value double, offered double, change string"


def late_fills(snapshots: DataFrame, shards: int = SHARDS) -> DataFrame:
    """A stream of what each micro-batch of snapshots changes: run, tag, step, value, offered, change (filled, rewritten, conflict).

    snapshots: a stream with run, at (time of the capture), and either tag, step, value (a cell) or step, t (an end of the
    step at time t, tag null); all rows of a capture of a run come in one micro-batch, as from one file. Rows without run,
    step or capture, and cells without value, change nothing. Two values of one cell in one capture: the smaller counts.
    A conflict offers a value that neither fills nor rewrites; which conflicts are seen depends on the order of arrival,
    the values do not.
    """
    use_state_store(snapshots.sparkSession)
    rows = snapshots.where("run is not null and step is not null and at is not null")
    columns = [F.col("run").cast("string").alias("run"), F.col("step").cast("int").alias("step"), F.col("tag").cast("string").alias("tag"), F.col("value").cast("double").alias("value"), F.col("t").cast("double").alias("t"), F.col("at").cast("double").alias("at")]
    shard = F.when(F.col("tag").isNull(), F.sequence(F.lit(0), F.lit(shards - 1))).otherwise(F.array(F.pmod(F.xxhash64("tag"), F.lit(shards)).cast("int")))
    dealt = rows.select(*columns, F.explode(shard).alias("shard"))
    return dealt.groupBy("run", "step", "shard").transformWithStateInPandas(LateFills(), CHANGES, "Update", "None")


class FetchDecisions(StatefulProcessor):
    """State of one run: what is stored of it and how often a fetch was skipped, and statuses that wait for their turn."""

    def __init__(self, force: int):
        self.force = force

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stored = handle.getValueState("stored", "last_step int, skips int, step array<int>, n array<int>")
        self.waiting = handle.getListState("waiting", "ms long, last_step int, step array<int>, n array<int>")

    def handleInputRows(self, key, rows, timerValues):
        for frame in rows:
            if len(frame):
                self.waiting.appendList([(int(r.ms), int(r.last_step), [int(x) for x in r.steps], [int(x) for x in r.ends]) for r in frame.itertuples(index=False)])
                self.handle.registerTimer(int(frame["ms"].min()))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """Decides on all that the watermark has passed, in the order of captures; of equal captures one counts."""
        until, due, later = timerValues.getCurrentWatermarkInMs(), {}, []
        for w in self.waiting.get():
            if w[0] <= until:
                due[w[0]] = max(due.get(w[0], w), w)
            else:
                later.append(w)
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(min(w[0] for w in later))
        else:
            self.waiting.clear()
        out = [(key[0], ms, *self._decide(due[ms])) for ms in sorted(due)]
        yield pd.DataFrame(out, columns=["run", "ms", "skip", "why", "skips"])

    def _decide(self, status) -> tuple[bool, str, int]:
        _, last_step, steps, n = status
        ends = dict(zip(steps, n, strict=True))
        old = self.stored.get() if self.stored.exists() else None
        known = dict(zip(old[2], old[3], strict=True)) if old is not None else {}
        if old is None:
            why = "no data"
        elif last_step != old[0]:
            why = "new steps"
        elif any(c > known.get(s, 0) for s, c in ends.items()):
            why = "redone steps"
        elif old[1] >= self.force:
            why = "full refresh due"
        else:
            why = "unchanged"
        skip = why == "unchanged"
        skips = old[1] + 1 if skip else 0
        known |= {s: max(c, known.get(s, 0)) for s, c in ends.items()}
        self.stored.update((old[0] if skip else last_step, skips, list(known), list(known.values())))
        return skip, why, skips

    def close(self) -> None:
        pass


DECISIONS = "run string, ms long, skip boolean, why string, skips int"


def fetch_decisions(statuses: DataFrame, lateness: str, force: int = 12) -> DataFrame:
    """A stream of decisions whether to fetch a run's series: run, at, skip, why, skips (skipped in a row, with this one).

    statuses: a stream with run, at (timestamp of the capture), last_step, steps and ends (how often each step has ended).
    A fetch is skipped if there is no new step, no step has ended once more and fewer than `force` were skipped in a
    row. Decisions are made in the order of captures: a status waits until the watermark, `lateness` behind the newest
    capture, has passed it (a timer); one that comes later still is dropped. A repeated capture is decided once. A row
    without run or last_step is a heartbeat: its capture moves the watermark and is not decided on.
    """
    use_state_store(statuses.sparkSession)
    known = F.when(F.col("at").isNotNull(), F.col("run").isNotNull() & F.col("last_step").isNotNull()).otherwise(F.lit(False))  # names `at`, so that it stays above the watermark
    rows = statuses.withWatermark("at", lateness).where(known)
    rows = rows.select("run", "at", F.unix_millis("at").alias("ms"), F.col("last_step").cast("int").alias("last_step"), F.col("steps").cast("array<int>").alias("steps"), F.col("ends").cast("array<int>").alias("ends"))
    found = rows.groupBy("run").transformWithStateInPandas(FetchDecisions(force), DECISIONS, "Append", "EventTime")
    return found.select("run", F.timestamp_millis("ms").alias("at"), "skip", "why", "skips")


def drained(changes: DataFrame, folder: str, mode: str, before: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Runs a stream of changes over all that is there and returns the table of all batches so far, with column batch.

    Progress, state and rows are kept in the folder: a later call goes on from there, and a batch that is run again after
    a failure replaces its own rows.
    """

    def apply(batch: DataFrame, number: int) -> None:
        if before:
            before(batch, number)
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    changes.writeStream.outputMode(mode).foreachBatch(apply).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    return changes.sparkSession.read.schema(changes.schema.add("batch", "long")).parquet(f"{folder}/rows")


def merged_cells(snapshots: DataFrame, folder: str, shards: int = SHARDS) -> DataFrame:
    """run, tag, step, value after all snapshots that the stream has had so far (see late_fills and drained)."""
    changes = drained(late_fills(snapshots, shards), folder, "update")
    return changes.where("change <> 'conflict'").groupBy("run", "tag", "step").agg(F.max_by("value", "batch").alias("value"))
