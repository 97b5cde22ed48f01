"""Quality classification by Bradley-Terry ranking.

A document's strength is linear in its features; in a preference pair a document of label 1 beats one of label 0 with
the logistic of their strengths' difference. Strengths are learned from pairs alone. The threshold is a quantile of the
strengths of the labelled documents: the share of label 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytestats import FEATURES, text_features
from .storage import scratch, written
from .textbuf import chunks
from .topics import totals

#: About so many labelled documents are paired with one another.
GROUP = 256
PAIRS = 40_000
RIDGE = 1e-3
#: The score at the threshold.
CUT = 0.3


@dataclass
class Ranker:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float

    def strength(self, features: np.ndarray) -> np.ndarray:
        return np.clip((features - self.mean) / self.spread, -8, 8) @ self.weights

    def score(self, features: np.ndarray) -> np.ndarray:
        """Between 0 and 1: the logistic of the strength, moved so that the threshold scores CUT."""
        z = np.clip(self.strength(features) - self.threshold + np.log(CUT / (1 - CUT)), -500, 500)
        return 1 / (1 + np.exp(-z))


def train(features: np.ndarray, labels: np.ndarray, share_of_0: float, seed: int = 11) -> Ranker:
    """Newton's method on the logistic loss of feature differences of random pairs (winner, loser)."""
    mean, spread = features.mean(axis=0), np.maximum(features.std(axis=0), 1e-6)
    ranker = Ranker(mean, spread, np.zeros(features.shape[1]), 0.0)
    winners, losers = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    if not len(winners) or not len(losers):
        ranker.threshold = np.inf if len(losers) else -np.inf
        return ranker
    r = np.random.default_rng(seed)
    x = np.clip((features - mean) / spread, -8, 8)
    gap = x[r.choice(winners, PAIRS)] - x[r.choice(losers, PAIRS)]
    w = ranker.weights
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(gap @ w, -30, 30)))  # of an upset
        hessian = (gap * (p * (1 - p))[:, None]).T @ gap / PAIRS + RIDGE * np.eye(len(w))
        w = w + np.linalg.solve(hessian, gap.T @ p / PAIRS - RIDGE * w)
    ranker.weights = w
    strength = x @ w
    share = np.where(labels == 0, share_of_0 / len(losers), (1 - share_of_0) / len(winners))
    order = np.argsort(strength, kind="stable")
    at = min(int(np.searchsorted(np.cumsum(share[order]), share_of_0)), len(order) - 1)
    ranker.threshold = float((strength[order[at]] + strength[order[min(at + 1, len(order) - 1)]]) / 2)
    return ranker


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, data, offsets in chunks(batch.column(1)):
            found = text_features(data, offsets)[0]
            yield pa.record_batch([batch.column(0).slice(first, last - first), pa.array(list(found))], names=["doc_id", "features"])


def _grouped(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["quality", "features"], key=lambda c: c.map(tuple) if c.name == "features" else c)
    both = [np.array(rows["features"][rows["quality"] == k].tolist(), np.float64).tobytes() for k in (1, 0)]
    return pd.DataFrame({"winners": [both[0]], "losers": [both[1]]})


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for row in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True):
        yield tuple(np.frombuffer(x).reshape(-1, len(FEATURES)) for x in row)


def _whole(x: np.ndarray, scale: int = 1 << 16) -> np.ndarray:
    """Whole numbers, whose sums are equal in every order."""
    return np.rint(np.asarray(x) * scale).astype(np.int64)


def _kth(table: DataFrame, ranker: Ranker, k: int) -> float:
    """The k-th strength (from 0) of all documents, by counts in ever narrower bins."""
    unit, bins = 1 << 32, 1024
    lo, hi = (int(s * unit * (16 * np.abs(ranker.weights).sum() + 1)) for s in (-1, 1))
    while lo < hi:
        width = -(-(hi - lo + 1) // bins)

        def counts(batch, lo=lo, hi=hi, width=width):
            for pair in _groups(batch):
                s = _whole(ranker.strength(np.vstack(pair)), unit)
                yield "n", np.append(np.bincount((s[(s >= lo) & (s <= hi)] - lo) // width, minlength=bins), (s < lo).sum())

        found = totals(table, counts, bins + 1)["n"]
        at = int(np.searchsorted(np.cumsum(found[:-1]) + found[-1], k + 1))
        lo, hi = lo + at * width, min(hi, lo + (at + 1) * width - 1)
    return lo / unit


@scratch
def fit(docs: DataFrame, labels: DataFrame) -> Ranker | None:
    """A ranker from documents (doc_id, text) and labels (doc_id, quality); None without any label.

    labels should hold the rows to learn from alone; all of them are learned from. A hash deals the labelled documents
    into groups of about GROUP, within which each of label 1 is paired with each of label 0, so that the pairs grow with
    the documents. The threshold is the quantile over all. Labels other than 0 and 1, and nulls, are ignored.
    """
    rows = labels.where("quality in (0, 1) and doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("quality"))
    n_labels = rows.count()
    if not n_labels:
        return None
    features = docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(_features, "doc_id long, features array<double>")
    group = F.pmod(F.xxhash64(F.lit("pairs"), "doc_id"), F.lit(max(1, n_labels // GROUP)))
    dealt = features.join(rows, "doc_id").select(group.alias("g"), "quality", "features").groupBy("g").applyInPandas(lambda x: _grouped(x[["quality", "features"]]), "winners binary, losers binary")
    table = written(dealt, "quality_groups")
    d = len(FEATURES)

    def moments(batch):
        for w, l in _groups(batch):
            x = np.vstack([w, l])
            yield "n", np.concatenate([_whole(x).sum(axis=0), _whole(x * x).sum(axis=0), [len(w), len(l)]])

    sums = totals(table, moments, 2 * d + 2).get("n")
    if sums is None:
        return None
    n1, n0 = sums[-2:]
    mean, square = sums[:d] / (1 << 16) / (n0 + n1), sums[d : 2 * d] / (1 << 16) / (n0 + n1)
    ranker = Ranker(mean, np.maximum(np.sqrt(np.maximum(square - mean * mean, 0)), 1e-4), np.zeros(d), 0.0)
    if not n0 or not n1:
        ranker.threshold = np.inf if n0 else -np.inf
        return ranker
    for _ in range(25):

        def slopes(batch):
            for pair in _groups(batch):
                w, l = (np.clip((x - ranker.mean) / ranker.spread, -8, 8) for x in pair)
                gap = (w[:, None, :] - l[None, :, :]).reshape(-1, d)
                p = 1 / (1 + np.exp(np.clip(gap @ ranker.weights, -30, 30)))  # of an upset
                yield "n", _whole(np.concatenate([gap.T @ p, ((gap * (p * (1 - p))[:, None]).T @ gap).ravel(), [len(gap)]]))

        sums = totals(table, slopes, d + d * d + 1)["n"]
        if not sums[-1]:
            break
        sums = sums / sums[-1]
        step = np.linalg.solve(sums[d:-1].reshape(d, d) + RIDGE * np.eye(d), sums[:d] - RIDGE * ranker.weights)
        ranker.weights = ranker.weights + step
        if np.abs(step).max() < 1e-6:
            break
    k = int(n0) - 1
    ranker.threshold = (_kth(table, ranker, k) + _kth(table, ranker, k + 1)) / 2
    return ranker


def _scores(batches: Iterator[pa.RecordBatch], ranker: Ranker | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [np.zeros(0)]
        for _, last, data, offsets in chunks(batch.column(1)):
            found.append(ranker.score(text_features(data, offsets)[0]) if ranker else np.full(len(offsets) - 1, CUT))
        yield pa.record_batch([batch.column(0), pa.array(np.concatenate(found))], names=["doc_id", "score"])


def score_quality(docs: DataFrame, ranker: Ranker | None) -> DataFrame:
    """doc_id, score and predicted (1 at CUT or more) per row. Null texts count as empty; other columns are ignored.

    Without a ranker every score is CUT.
    """
    found = docs.select("doc_id", "text").mapInArrow(lambda it: _scores(it, ranker), "doc_id long, score double")
    return found.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


__all__ = ["FEATURES", "Ranker", "fit", "score_quality", "train"]
