"""Operators that explain a step by what surrounds it: anchors, notices, restarts, held pools and replayed snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .temporal import as_of


def resolved_step(axis: DataFrame, wanted: DataFrame) -> DataFrame:
    """run, wanted, step, caveat: the wanted step if the run has it, else the last one before it, else the run's first.

    axis: run, step; wanted: run, wanted. The runs' axes are bounded by their number of steps.
    """
    found = wanted.join(axis.select("run", "step"), "run", "left").groupBy("run", "wanted").agg(
        F.max(F.when(F.col("step") <= F.col("wanted"), F.col("step"))).alias("below"), F.min("step").alias("first")
    )
    caveat = F.when(F.col("first").isNull(), "no data").when(F.col("below").isNull(), "before the first step").when(F.col("below") < F.col("wanted"), "step not there yet").otherwise("exact")
    return found.select("run", "wanted", F.coalesce("below", "first").alias("step"), caveat.alias("caveat"))


def _first_covering(restarts: DataFrame, anchored: DataFrame, episode: float) -> DataFrame:
    """event_id, n (at, notice_id, t): per restart the first notice with an anchor of its run within `episode` seconds.

    anchored: run, anchor, notice_id, at. Time is cut into blocks as long as two episodes, so the anchors around a restart
    are the end of one block and the start of the next: two running minima, whose work grows with the rows alone, however
    dense they are.
    """
    width = 2 * episode
    block = F.floor(F.col("_x") / width).cast("long")
    block = F.when(block * width > F.col("_x"), block - 1).otherwise(block)  # the quotient may have been rounded up
    anchors = anchored.where("run is not null").groupBy("run", F.col("anchor").alias("_x")).agg(F.min(F.struct("at", "notice_id")).alias("_n")).withColumn("_b", block)
    probes = restarts.where("run is not null and t is not null").select("run", "event_id", "t", (F.col("t") - episode).alias("_x")).withColumn("_b", block)
    ahead = probes.withColumns({"_x": F.col("t") + episode, "_b": F.col("_b") + 1})
    rows = anchors.withColumn("_side", F.lit(0)).unionByName(probes.withColumn("_side", F.lit(1)), True).unionByName(ahead.withColumn("_side", F.lit(2)), True)
    near = lambda x: F.min("_n").over(Window.partitionBy("run", "_b").orderBy(x, "_side").rowsBetween(Window.unboundedPreceding, 0))
    found = rows.withColumns({"_from": near(-F.col("_x")), "_to": near(F.col("_x"))}).where("_side > 0").withColumn("_n", F.when(F.col("_side") == 1, F.col("_from")).otherwise(F.col("_to")))
    return found.where("_n is not null").groupBy("event_id").agg(F.min(F.struct("_n.at", "_n.notice_id", "t")).alias("n"))


def _with_first(restarts: DataFrame, anchored: DataFrame, episode: float) -> DataFrame:
    first = _first_covering(restarts, anchored, episode)
    return restarts.join(first, "event_id", "left").select("event_id", "run", "n.notice_id", (F.col("n.t") - F.col("n.at")).alias("delta"))


def attributed(restarts: DataFrame, notices: DataFrame, within: float = 43_200.0, episode: float = 10_800.0) -> DataFrame:
    """event_id, run, notice_id, delta: restarts with the first notice whose episode covers them; nulls for the others.

    A notice's anchor is the nearest restart of its run within `within` seconds (ties: the earlier one); its episode is
    all restarts of the run within `episode` seconds of the anchor. No pairs of notices and restarts are made.
    """
    n = notices.where("run is not null and t is not null").select("run", "notice_id", F.col("t").alias("at"))
    facts = restarts.where("run is not null and t is not null").select("run", F.col("t").alias("anchor"))
    low = as_of(n, facts, ["run"], "at", "anchor", ["anchor"]).withColumnRenamed("anchor", "low")
    both = as_of(low, facts, ["run"], "at", "anchor", ["anchor"], backward=False)
    gap = lambda c: F.abs(F.col(c) - F.col("at"))
    back = F.col("anchor").isNull() | (gap("low") <= gap("anchor"))
    anchors = both.withColumn("anchor", F.when(back, F.col("low")).otherwise(F.col("anchor"))).where(gap("anchor") <= within)
    return _with_first(restarts, anchors.select("run", "anchor", "notice_id", "at"), episode)


def attributed_by_hints(restarts: DataFrame, notices: DataFrame, within: float = 43_200.0, episode: float = 10_800.0) -> DataFrame:
    """event_id, run, notice_id, delta: attributed() for notices that may name a run (hint_run) or a step (hint_step).

    restarts: event_id, run, step, t; notices: notice_id, t, hint_run, hint_step. A named run or step (give or take one)
    must be the anchor's; a restart without a step meets no step. Without a hint any run's nearest restart is the anchor
    (ties: the earlier one, then the smaller event_id). Notices without a time or near restart cover none.

    A restart stands once for each kind of hint: under its run, its step, both and neither. A notice looks under its own
    hints only, and under three steps if it names one.
    """
    key = ["_kind", "_run", "_step"]  # _kind: 1 if a run is named, and 2 more if a step is
    r = restarts.where("t is not null").withColumn("_kind", F.explode(F.array(*map(F.lit, range(4)))))
    r = r.where("(_kind in (0, 2) or run is not null) and (_kind < 2 or step is not null)")
    named = lambda run, step: (F.when(F.col("_kind").isin(1, 3), F.col(run)).otherwise("").alias("_run"), F.when(F.col("_kind") >= 2, step).otherwise(0).cast("int").alias("_step"))
    facts = r.select("_kind", *named("run", F.col("step")), F.col("t").alias("_anchor"), F.struct(F.col("event_id").alias("id"), "run").alias("_up"), F.struct((-F.col("event_id")).alias("id"), "run").alias("_down"))
    n = notices.where("t is not null").select("notice_id", F.col("t").alias("at"), "hint_run", "hint_step", (F.col("hint_run").isNotNull().cast("int") + 2 * F.col("hint_step").isNotNull().cast("int")).alias("_kind"))
    n = n.withColumn("_off", F.explode(F.when(F.col("_kind") >= 2, F.array(*map(F.lit, (-1, 0, 1)))).otherwise(F.array(F.lit(0)))))
    n = n.select("notice_id", "at", "_kind", *named("hint_run", F.col("hint_step") + F.col("_off")))
    # Of restarts at one time the smallest event_id counts, which is the greatest of the negative ones.
    low = as_of(n, facts, key, "at", "_anchor", ["_down", "_anchor"]).withColumnRenamed("_anchor", "_low")
    both = as_of(low, facts, key, "at", "_anchor", ["_up", "_anchor"], backward=False)
    found = lambda t, id_, run: F.when(F.col(t).isNotNull(), F.struct(F.abs(F.col(t) - F.col("at")).alias("gap"), F.col(t).alias("anchor"), id_.alias("id"), F.col(run).alias("run")))
    best = F.least(found("_low", -F.col("_down.id"), "_down.run"), found("_anchor", F.col("_up.id"), "_up.run"))
    anchors = both.withColumn("a", best).where(F.col("a.gap") <= within).groupBy("notice_id", "at").agg(F.min("a").alias("a"))
    return _with_first(restarts, anchors.select("a.run", "a.anchor", "notice_id", "at"), episode)


def trained_shares(pool: DataFrame, target: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """run, part, step, trained, approx: what each part of a pool gave: held before + accepted - held now.

    pool: run, part, step, accepted, held, carryover; target: run, step, size. Where the parts' sum misses the step's
    size by more than `tolerance` (and at the first step), a part gives its carryover and a share of what is left in
    proportion to its accepted ones.
    """
    before = F.lag("held").over(Window.partitionBy("run", "part").orderBy("step"))
    p = pool.withColumn("implied", F.greatest(F.lit(0.0), before + F.col("accepted") - F.col("held"))).join(target, ["run", "step"])
    w = Window.partitionBy("run", "step")
    p = p.withColumns({"total": F.sum("implied").over(w), "known": F.count("implied").over(w) == F.count("*").over(w), "carried": F.sum("carryover").over(w), "fresh": F.sum("accepted").over(w)})
    sane = F.col("known") & (F.abs(F.col("total") - F.col("size")) <= tolerance * F.col("size"))
    share = F.col("carryover") + F.col("accepted") * F.greatest(F.lit(0.0), F.col("size") - F.col("carried")) / F.when(F.col("fresh") == 0, 1.0).otherwise(F.col("fresh"))
    return p.select("run", "part", "step", F.when(sane, F.col("implied")).otherwise(share).alias("trained"), (~sane).alias("approx"))


def pool_decomposition(rows: DataFrame, key: list[str]) -> DataFrame:
    """key, d_mean, solved, pool_loss, within_pool, interaction: the change of a mean from first to last step.

    rows: key, step, zero, one, mean. mean = one + M m with M = 1 - zero - one: the change splits into the solved share's,
    the open pool's at its mean level, and that within the pool at its mean size.
    """
    r = rows.where("zero is not null and one is not null and mean is not null and zero + one <> 1").withColumn("open", 1 - F.col("zero") - F.col("one"))
    r = r.withColumn("level", (F.col("mean") - F.col("one")) / F.col("open"))
    ends = r.groupBy(*key).agg(*(f(F.struct("mean", "one", "open", "level"), F.col("step")).alias(n) for f, n in ((F.min_by, "a"), (F.max_by, "z"))))
    d = lambda c: F.col(f"z.{c}") - F.col(f"a.{c}")
    mid = lambda c: (F.col(f"z.{c}") + F.col(f"a.{c}")) / 2
    parts = {"d_mean": d("mean"), "solved": d("one"), "pool_loss": mid("level") * d("open"), "within_pool": mid("open") * d("level")}
    return ends.select(*key, *(c.alias(n) for n, c in parts.items()), (parts["d_mean"] - parts["solved"] - parts["pool_loss"] - parts["within_pool"]).alias("interaction"))


def gap_attribution(axis: DataFrame, restarts: DataFrame, reported: DataFrame) -> DataFrame:
    """run, step, gap, before_last, tail, between: unreported time of steps with restarts: the identity gap = before_last + tail - reported.

    axis: run, step, wall; restarts: run, t; reported: run, step, seconds. `between` runs from the first restart to the last.
    """
    w = Window.partitionBy("run").orderBy("step")
    spans = axis.withColumn("low", F.lag("wall").over(w)).where("low is not null").withColumn("day", F.explode(F.sequence(F.floor(F.col("low") / 86400), F.floor(F.col("wall") / 86400))))
    inside = spans.join(restarts.withColumn("day", F.floor(F.col("t") / 86400)), ["run", "day"]).where("t > low and t <= wall")
    r = inside.groupBy("run", "step", "low", "wall").agg(F.max("t").alias("last"), F.min("t").alias("first")).join(reported, ["run", "step"])
    return r.select("run", "step", (F.col("wall") - F.col("low") - F.col("seconds")).alias("gap"), (F.col("last") - F.col("low")).alias("before_last"), (F.col("wall") - F.col("last")).alias("tail"), (F.col("last") - F.col("first")).alias("between"))


def replayed(captures: DataFrame, redone: DataFrame) -> DataFrame:
    """run, tag, step, value: snapshots (with column capture, their order) merged one after another.

    The first value that is not null stays, so that late values fill gaps; at redone steps (run, step, capture: from
    which capture on) the last one does. Replaying snapshots once more changes nothing.
    """
    marked = captures.join(redone.select("run", "step", F.col("capture").alias("from")), ["run", "step"], "left").where("value is not null")
    again = F.col("capture") >= F.col("from")
    return marked.groupBy("run", "tag", "step").agg(
        F.coalesce(F.max_by(F.when(again, F.col("value")), F.when(again, F.col("capture"))), F.min_by("value", "capture")).alias("value")
    )


def skip_decision(stored: DataFrame, incoming: DataFrame, force: int = 12) -> DataFrame:
    """run, skip, why: whether a run's snapshot holds nothing new. stored and incoming: run, last_step, n_redo; stored with skips."""
    i = incoming.select("run", F.col("last_step").alias("new_step"), F.col("n_redo").alias("new_redo"))
    why = (
        F.when(F.col("last_step").isNull(), "no data")
        .when(F.col("last_step") != F.col("new_step"), "new steps")
        .when(F.col("new_redo") > F.col("n_redo"), "redone steps")
        .when(F.col("skips") >= force, "full refresh due")
        .otherwise("unchanged")
    )
    return i.join(stored, "run", "left").select("run", (why == "unchanged").alias("skip"), why.alias("why"))


def typed_text(value: Column, kind: Column) -> Column:
    """A number as text by its kind: ratio, num2, num1, num0, int, pct or gb; a dash for null."""
    places = lambda n: F.format_string(f"%.{n}f", value)
    pct = F.when(value * 100 >= 10, F.format_string("%.1f %%", value * 100)).otherwise(F.format_string("%.2f %%", value * 100))
    text = F.when(kind == "pct", pct).when(kind == "gb", F.concat(places(1), F.lit(" GB"))).when(kind.isin("num0", "int"), places(0)).when(kind == "num1", places(1)).when(kind == "num2", places(2)).otherwise(places(3))
    return F.when(value.isNull(), "—").otherwise(text)


def suffixed_ids(entries: DataFrame, base: str, quote: str, order: str) -> DataFrame:
    """entries with id: the base id; entries of one base whose quotes differ get -2, -3, ... by the quote's first appearance."""
    first = entries.groupBy(base, quote).agg(F.min(order).alias("_first"))
    place = F.row_number().over(Window.partitionBy(base).orderBy("_first"))
    numbered = first.withColumn("id", F.when(place == 1, F.col(base)).otherwise(F.concat_ws("-", F.col(base), place.cast("string")))).drop("_first")
    return entries.join(numbered, [base, quote])
