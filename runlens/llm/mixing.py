"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells by source, language and topic. Raking scales the cells' token weights by one marginal after
another until all three hold their target shares. No weight may grow beyond what the cell's tokens can fill of the
sample, so a cell's weight over its tokens is the probability with which its documents are sampled.
"""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import extended, tidy, unused, written
from .topics import Topics, learn_topics, with_tokens_and_topic

MARGINALS = ("source", "lang", "topic")
ROUNDS = 200
CLOSE = 1e-9
#: A marginal that is off by no more than this holds its target.
NEAR = 1e-3
#: The smallest share of all tokens that is tried for a sample.
SMALLEST = 1e-3
#: Cells raked on the driver at most (their number is that of distinct combinations, not of documents); more are raked by Spark jobs.
DRIVER_CELLS = 100_000
#: Cells broadcast at most when documents look up their probability.
BROADCAST_CELLS = 100_000
#: The share of all tokens that a sample should hold at most.
SHARE = 0.6


def tempered(cells: DataFrame, marginal: str, power: float, sample: float = 0.0) -> DataFrame:
    """value, share: targets between the present shares of tokens (power 1) and equal ones (power 0).

    sample: the share of all tokens that a sample is to hold. No value is asked for more than it has of such a sample;
    what a rare value cannot give is dealt to the others.
    """
    sums = written(cells.groupBy(F.col(marginal).alias("value")).agg(F.sum("tokens").cast("double").alias("n")).where("n > 0"), "marginal_sums")
    total = sums.agg(F.sum("n")).first()[0] or 1.0
    most, w = F.col("n") / (sample * total) if sample else F.lit(float("inf")), F.pow("n", F.lit(power))
    level = 0.0
    while True:  # the common level rises until it no longer fills further values
        full = F.lit(level) * w >= most
        given, rest = sums.agg(F.coalesce(F.sum(F.when(full, most)), F.lit(0.0)), F.sum(F.when(~full, w))).first()
        if not rest or (1 - given) / rest <= level * (1 + 1e-12):
            break
        level = (1 - given) / rest
    return sums.select("value", F.least(most, F.lit(level) * w).alias("share"))


class _Progress:
    """Whether raking should go on: not when it is close, nor when ten rounds bring it little nearer."""

    def __init__(self):
        self.seen: list[float] = []

    def ends(self, worst: float) -> bool:
        self.seen.append(worst)
        stuck = len(self.seen) > 20 and worst > NEAR and worst > 0.9 * self.seen[-11]
        return worst < CLOSE or stuck or len(self.seen) >= ROUNDS


def _rake_here(cells: pd.DataFrame, targets: dict[str, pd.DataFrame], share: float | None) -> tuple[np.ndarray, float]:
    """(weight, greatest distance of a marginal's share from its target)."""
    free = cells["tokens"].to_numpy(float)
    cap = free / (share * free.sum()) if share else np.full(len(free), np.inf)
    free = free / max(free.sum(), 1e-300)
    codes, shares = {}, {}
    for m, target in targets.items():
        codes[m], values = pd.factorize(cells[m], use_na_sentinel=False)
        wanted = {None if pd.isna(v) else v: s for v, s in zip(target["value"], target["share"], strict=True)}
        shares[m] = np.array([wanted.get(None if pd.isna(v) else v, 0.0) for v in values])
        shares[m] = shares[m] / max(shares[m].sum(), 1e-300)
    progress, worst = _Progress(), 0.0
    while len(free):
        worst = 0.0
        for m, code in codes.items():
            now = np.bincount(code, np.minimum(free, cap), len(shares[m]))
            worst = max(worst, np.abs(now - shares[m]).max(initial=0))
            free = free * np.divide(shares[m], now, out=np.zeros_like(now), where=now > 0)[code]
        if progress.ends(worst):
            break
    return np.minimum(free, cap), worst


def _rake_in_spark(cells: DataFrame, targets: dict[str, DataFrame], share: float | None) -> tuple[DataFrame, float]:
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    cap = F.col("tokens") / (share * total) if share else F.lit(float("inf"))
    weighted = cells.withColumns({"weight": F.col("tokens") / total, "cap": cap})
    wanted = {}
    for m, t in targets.items():
        present = t.join(cells.select(m).distinct(), F.col("value").eqNullSafe(F.col(m)), "left_semi")
        wanted[m] = present.select("value", (F.col("share") / present.agg(F.sum("share").alias("s")).scalar()).alias("share"))
    progress, worst = _Progress(), 0.0
    while True:
        worst = 0.0
        for m, t in wanted.items():
            now = written(weighted.groupBy(F.col(m).alias("v")).agg(F.sum(F.least("weight", "cap")).alias("now")), "rake_sums")
            ratio = now.join(t, F.col("v").eqNullSafe(F.col("value")), "left").select("v", "now", F.coalesce("share", F.lit(0.0)).alias("share"))
            worst = max(worst, ratio.agg(F.max(F.abs(F.col("now") - F.col("share")))).first()[0] or 0.0)
            step = ratio.select("v", F.when(F.col("now") > 0, F.col("share") / F.col("now")).otherwise(0.0).alias("ratio"))
            weighted = written(weighted.join(step, F.col(m).eqNullSafe(F.col("v"))).withColumn("weight", F.col("weight") * F.col("ratio")).drop("v", "ratio"), "rake")
        if progress.ends(worst):
            break
    return weighted.select(*cells.columns, F.least("weight", "cap").alias("weight")), worst


def _raked(cells: DataFrame, targets: dict[str, DataFrame], driver_cells: int, share: float | None) -> tuple[DataFrame, float]:
    if cells.count() > driver_cells:
        return _rake_in_spark(cells, targets, share)
    here = cells.orderBy(*targets).toPandas()
    here["weight"], worst = _rake_here(here, {m: t.toPandas() for m, t in targets.items()}, share)
    return cells.sparkSession.createDataFrame(here, extended(cells.schema, weight="double")), worst


def _warn(worst: float) -> None:
    if worst > NEAR:
        warnings.warn(f"raking ended at a share off by {worst:.3g}: the targets contradict the cells or each other", stacklevel=3)


@tidy
def rake(cells: DataFrame, targets: dict[str, DataFrame], driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """cells (columns of the marginals, tokens) with weight: shares that meet each target as nearly as the cells allow.

    targets: for each marginal, value and share. A value without a target gets weight 0; targets of absent values are
    dealt to the others in proportion. Null is a value like any other. Empty cells have no weight and are left out.
    """
    cells = written(cells.where("tokens > 0").select(*targets, "tokens"), "cells")
    found, worst = _raked(cells, targets, driver_cells, None)
    _warn(worst)
    return found


@tidy
def calibrated(cells: DataFrame, targets: dict[str, DataFrame], share: float = SHARE, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """cells with weight and prob, by which a sample is expected to hold the target shares and at most `share` of all tokens.

    Raking is bounded: a cell's weight never exceeds what all its tokens are of the sample, so no probability is above 1
    and none has to be cut afterwards. Where the cells don't hold enough at this share, the sample is made smaller, by a
    tenth at a time, until its shares are as near to the targets as those of a sample of any size; if these are off too,
    because targets contradict the cells or each other, a warning says by how much.
    """
    cells = written(cells.where("tokens > 0").select(*targets, "tokens"), "cells")
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    _, least = _raked(cells, targets, driver_cells, None)
    found, worst = _raked(cells, targets, driver_cells, share)
    while worst > max(NEAR, 1.1 * least) and share > SMALLEST:
        share *= 0.9
        found, worst = _raked(cells, targets, driver_cells, share)
    _warn(worst)
    return found.withColumn("prob", F.least(F.lit(1.0), F.col("weight") * F.lit(share * total) / F.col("tokens")))


def expected_shares(found: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """marginal, value, wanted, expected: of the tokens of a sample by the probabilities of calibrated()."""
    rows, total = None, found.agg(F.sum(F.col("prob") * F.col("tokens")).alias("t"))
    for m, t in targets.items():
        now = found.groupBy(F.col(m).cast("string").alias("value")).agg((F.sum(F.col("prob") * F.col("tokens")) / total.scalar()).alias("expected"))
        target = t.select(F.col("value").cast("string").alias("v"), F.col("share").alias("wanted"))
        one = now.join(target, F.col("v").eqNullSafe(F.col("value")), "left").select(F.lit(m).alias("marginal"), "value", F.coalesce("wanted", F.lit(0.0)).alias("wanted"), "expected")
        rows = one if rows is None else rows.unionByName(one)
    return rows


def mix(
    docs: DataFrame, targets: dict[str, DataFrame] | None = None, share: float = SHARE, power: float = 0.5, seed: str = "mix", topics: Topics | None = None
) -> DataFrame:
    """docs with n_tokens, topic, prob and kept: a sample whose tokens have the target shares by source, lang and topic.

    targets: as in rake(); without them, tempered() ones, each marginal's present shares raised to `power` as far as its
    values hold enough. share: as in calibrated(), that is, the sample holds less where cells have too few tokens. topics: a model of
    learn_topics(), learned from docs if not given. A document is kept if a hash of seed and doc_id, as a fraction, is
    below the probability of its cell: the same documents in every run. Texts without words (null, empty) have no tokens
    and are never kept; nor are rows without doc_id. Texts of any length are read whole. Rows repeated whole are all kept
    or none. Null in a marginal is a value of its own. Columns named n_tokens, topic, prob or kept are replaced; others
    stay, whatever their names.
    """
    docs = with_tokens_and_topic(docs, topics or learn_topics(docs)).drop("prob", "kept")
    cells = written(docs.select("source", "lang", "n_tokens", "topic").groupBy(*MARGINALS).agg(F.sum("n_tokens").alias("tokens")), "mix_cells").where("tokens > 0")
    targets = targets or {m: tempered(cells, m, power, share) for m in MARGINALS}
    *keys, prob = unused(docs, *(f"cell_{m}" for m in MARGINALS), "prob")
    cell = written(calibrated(cells, targets, share).select(*(F.col(m).alias(k) for m, k in zip(MARGINALS, keys, strict=True)), F.col("prob").alias(prob)), "mix_probabilities")
    if cell.count() <= BROADCAST_CELLS:
        cell = F.broadcast(cell)
    same = [F.col(m).eqNullSafe(F.col(k)) for m, k in zip(MARGINALS, keys, strict=True)]
    found = docs.join(cell, same[0] & same[1] & same[2], "left").drop(*keys)
    fraction = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 40)) / float(1 << 40)
    chance = F.when((F.col("n_tokens") > 0) & F.col("doc_id").isNotNull(), F.coalesce("prob", F.lit(0.0))).otherwise(0.0)
    return found.withColumn("prob", chance).withColumn("kept", fraction < F.col("prob"))
