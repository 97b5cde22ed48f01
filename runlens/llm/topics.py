"""Topics of texts: clusters of their content words, learned from all of them in passes of sums.

A text is a vector of hashed words of some length, weighed by their rarity. Spherical k-means finds the directions in
which texts of one language lie apart: each language's own mean is taken off first, so that topics are not languages
once more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import extended, scratch, written
from .textbuf import buffer_of, chunks, mixed, word_hashes, words_of

TOPICS = 6
#: Shorter words (in bytes) carry little content.
LEAST_BYTES = 5
BUCKET_BITS = 8
ROUNDS = 30
#: Vectors are summed as whole multiples of 1 / SCALE, so that sums are equal in every order.
SCALE = 1 << 20
#: Directions that a row of their table holds.
BLOCK = 8
#: Bytes of counts or directions that a pass turns into numbers at once.
PART_BYTES = 1 << 19
#: Partitions that the tasks' sums are dealt to: they are few, and each task writes a file for every partition.
SUM_PARTITIONS = 8
EMPTY = "empty"
#: What a text without a nearest cluster (no word long enough) is about.
PLAIN = "plain"


def word_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(counts of content words by bucket, number of all words) of each text."""
    n = len(offsets) - 1
    starts, ends, at = words_of(data, offsets)
    words = np.diff(at)
    row = np.repeat(np.arange(n, dtype=np.int64), words)
    long = np.flatnonzero(ends - starts >= LEAST_BYTES)
    bucket = (word_hashes(data, starts[long], ends[long]) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    counts = np.bincount((row[long] << BUCKET_BITS) + bucket, minlength=n << BUCKET_BITS).reshape(n, 1 << BUCKET_BITS)
    return counts, words


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


@dataclass
class Topics:
    rarity: np.ndarray
    means: dict  # language: mean direction
    centers: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return _unit(np.log1p(counts) * self.rarity)

    def assign(self, counts: np.ndarray, langs: list) -> np.ndarray:
        """The number of each text's topic, or -1 for one without content words."""
        x = self.vectors(counts)
        known = {lang: i for i, lang in enumerate(self.means)}
        which = np.array([known.get(lang, -1) for lang in langs], np.int64)
        table = np.vstack([*self.means.values(), np.zeros((1, x.shape[1]))])
        best = (x @ self.centers.T - table[which] @ self.centers.T).argmax(axis=1)
        return np.where(counts.any(axis=1), best, -1)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, data, offsets in chunks(batch.column(0)):
            counts = word_counts(data, offsets)[0].astype(np.int32)
            have = np.flatnonzero(counts.any(axis=1))
            rest = [batch.column(k).slice(first, last - first).take(pa.array(have)) for k in (1, 2)]
            yield pa.record_batch([*rest, pa.array([counts[i].tobytes() for i in have.tolist()], pa.binary())], names=["lang", "chance", "counts"])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return buffer_of(batch.column(batch.num_columns - 1))[0].view(np.int32).reshape(-1, 1 << BUCKET_BITS)


def _parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = max(1, PART_BYTES * batch.num_rows // max(batch.nbytes, 1))
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def totals(table: DataFrame, sums: Callable[[pa.RecordBatch], Iterable[tuple[str | None, np.ndarray]]], width: int = (1 << BUCKET_BITS) + 1) -> dict:
    """key: total of the whole numbers that `sums` gives for a few rows; a task gives one vector for each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        for part in _parts(batches):
            for key, row in sums(part):
                found[key] = found.get(key, 0) + row
        for key, row in found.items():
            yield pa.record_batch([pa.array([key] * len(row), pa.string()), pa.array(np.arange(len(row)), pa.int32()), pa.array(row, pa.int64())], names=["key", "at", "total"])

    out: dict = {}
    found = table.mapInArrow(run, "key string, at int, total long").repartition(SUM_PARTITIONS, "key", "at")
    for key, at, total in found.groupBy("key", "at").agg(F.sum("total")).collect():
        out.setdefault(key, np.zeros(width))[at] = total
    return out


def _by_group(keys: np.ndarray, whole: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(group, its sum of rows of whole numbers, with its size behind); doubles hold such sums of a batch exactly."""
    there, which = np.unique(keys, return_inverse=True)
    of = (which == np.arange(len(there))[:, None]).astype(np.float64)
    for k, row, n in zip(there.tolist(), of @ whole, of.sum(axis=1), strict=True):
        yield k, np.append(row, n).astype(np.int64)


def _weighed(counts: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    return _unit(np.log1p(np.arange(counts.max(initial=0) + 1))[counts] * rarity)


def _centered(batches: Iterator[pa.RecordBatch], rarity: np.ndarray, means: dict) -> Iterator[pa.RecordBatch]:
    """The texts' directions off their language's mean, in units of 1 / SCALE, BLOCK texts a row."""
    known = {v: i for i, v in enumerate(means)}
    table = np.vstack([*means.values(), np.zeros((1, 1 << BUCKET_BITS))])
    for part in _parts(batches):
        x = _unit(_weighed(_matrix(part), rarity) - table[[known.get(v, -1) for v in part.column(0).to_pylist()]])
        columns = part.column(1).to_numpy(), np.rint(x * SCALE).astype(np.int32)
        yield pa.record_batch([pa.array([c[k : k + BLOCK].tobytes() for k in range(0, len(x), BLOCK)], pa.binary()) for c in columns], names=["chances", "directions"])


def _far_text(table: DataFrame, centers: np.ndarray) -> np.ndarray | None:
    """One of all texts, drawn in proportion to its distance from the nearest center; None if no text is apart from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for part in _parts(batches):
            x = _matrix(part) / SCALE
            gap = np.maximum(1 - (x @ centers.T).max(axis=1), 0) if len(centers) else np.ones(len(x))
            draw = mixed(buffer_of(part.column(0))[0].view(np.uint64) + np.uint64(len(centers)))
            late = -np.log(((draw >> np.uint64(12)).astype(np.float64) + 0.5) / float(1 << 52)) / np.where(gap > 1e-9, gap, np.nan)
            if not np.isnan(late).all():
                k = int(np.nanargmin(late))
                best = min(best or (np.inf, []), (late[k], x[k].tolist()))
        if best:
            yield pa.record_batch([pa.array([best[0]]), pa.array([best[1]], pa.list_(pa.float64()))], names=["late", "x"])

    first = table.mapInArrow(run, "late double, x array<double>").orderBy("late", "x").limit(1).collect()
    return np.array(first[0].x) if first else None


@scratch
def learn_topics(docs: DataFrame, topics: int = TOPICS) -> Topics | None:
    """Topics of all documents (doc_id, text, lang); None if none of them has a content word.

    Spherical k-means: the texts' counts are written once, then their directions, and every round is one pass that sums
    these by cluster. First centers lie apart; clusters are numbered from the largest. The same documents give the same
    topics in any order.
    """
    rows = docs.where("text is not null and doc_id is not null").select("text", "lang", F.xxhash64(F.lit("topics"), "doc_id").alias("chance"))
    table = written(rows.mapInArrow(_counted, "lang string, chance long, counts binary"), "topic_counts")
    having = totals(table, lambda batch: [("n", np.append((_matrix(batch) > 0).sum(axis=0), batch.num_rows))]).get("n")
    if having is None:
        return None
    rarity = np.log((1 + having[-1]) / (1 + having[:-1]))

    def by_lang(batch):
        langs = batch.column(0).dictionary_encode()
        names = [*langs.dictionary.to_pylist(), None]
        keys = langs.indices.fill_null(len(names) - 1).to_numpy(zero_copy_only=False)
        return ((names[k], row) for k, row in _by_group(keys, np.rint(_weighed(_matrix(batch), rarity) * SCALE)))

    sums = totals(table, by_lang)
    means = {v: sums[v][:-1] / SCALE / sums[v][-1] for v in sorted(v for v in sums if v is not None)}
    table = written(table.mapInArrow(lambda it: _centered(it, rarity, means), "chances binary, directions binary"), "topic_directions")
    centers = np.zeros((0, 1 << BUCKET_BITS))
    while len(centers) < topics and (x := _far_text(table, centers)) is not None:
        centers = np.vstack([centers, x])
    for last in range(ROUNDS, -1, -1):

        def by_center(batch, centers=centers):
            x = _matrix(batch).astype(np.float64)
            return ((str(k), row) for k, row in _by_group((x @ centers.T).argmax(axis=1), x))

        sums = totals(table, by_center)
        sizes = np.array([sums[str(k)][-1] if str(k) in sums else 0 for k in range(len(centers))])
        moved = np.vstack([_unit(sums[str(k)][None, :-1]) if str(k) in sums else centers[k] for k in range(len(centers))])
        if not last or np.allclose(moved, centers, atol=1e-9):
            break
        centers = moved
    return Topics(rarity, means, centers[np.argsort(-sizes, kind="stable")])


def _measured(batches: Iterator[pa.RecordBatch], model: Topics | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, n_tokens = [], [np.zeros(0, np.int64)]
        langs = batch.column(batch.schema.get_field_index("lang")).to_pylist()
        for first, last, data, offsets in chunks(batch.column(batch.schema.get_field_index("text"))):
            counts, words = word_counts(data, offsets)
            best = model.assign(counts, langs[first:last]) if model else np.full(last - first, -1)
            names += [EMPTY if not n else PLAIN if k < 0 else f"topic {k}" for k, n in zip(best.tolist(), words.tolist(), strict=True)]
            n_tokens.append(words)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(n_tokens), pa.int64()), pa.array(names, pa.string())], names=[*batch.schema.names, "n_tokens", "topic"])


def with_tokens_and_topic(docs: DataFrame, model: Topics | None) -> DataFrame:
    """docs (text, lang) with n_tokens (words of the whole text) and topic, which replace columns of that name."""
    docs = docs.drop("n_tokens", "topic")
    return docs.mapInArrow(lambda it: _measured(it, model), extended(docs.schema, n_tokens="long", topic="string"))
