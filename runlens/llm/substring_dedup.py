"""Substring deduplication: word windows that an earlier document also has are removed.

Every window of `window` words gets a Rabin-Karp hash. Consecutive windows that share their least `anchor`-word hash
form a run, and a run's 128-bit hash stands for all its windows: one row a run is counted, not one a window. Windows
are compared one by one only where different runs share an anchor, by the first document of each such run. Equal
windows always have equal anchors, so nothing is missed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import tidy, written
from .textbuf import WORD_BASES, Rolling, chunks, mixed, ranges, word_hashes, words_of

WINDOW = 50
ANCHOR = 10


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def _window_hashes(data, starts, ends):
    """The two rolling hashes over words; together they make 128 bits."""
    return [Rolling(word_hashes(data, starts, ends, k), WORD_BASES[k]) for k in (0, 1)]


def _runs(batches: Iterator[pa.RecordBatch], window: int, anchor: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for first, last, data, offsets in chunks(batch.column(1)):
            starts, ends, at = words_of(data, offsets)
            counts = np.maximum(np.diff(at) - window + 1, 0)
            if not counts.sum():
                continue
            one, two = _window_hashes(data, starts, ends)
            least = _sliding_min(mixed(one.every(anchor)), window - anchor + 1)
            pos, doc = ranges(at[:-1], counts), np.repeat(np.arange(last - first), counts)
            least = least[pos]
            new = np.ones(len(pos), bool)
            new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
            head = np.flatnonzero(new)
            length = np.diff(np.append(head, len(pos)))
            s, e = pos[head], pos[head] + length + window - 1
            size = length.astype(np.uint64)
            yield pa.record_batch(
                [
                    pa.array(ids[first:last][doc[head]], pa.int64()),
                    pa.array((s - at[doc[head]]).astype(np.int32)),
                    pa.array(length.astype(np.int32)),
                    pa.array(least[head].view(np.int64)),
                    pa.array(mixed(one.of(s, e) + size).view(np.int64)),
                    pa.array(mixed(two.of(s, e) + size).view(np.int64)),
                ],
                names=["doc", "start", "n", "anchor", "run1", "run2"],
            )


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """The hash of each window of the listed runs of each text."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        spans = batch.column(2)
        for first, last, data, offsets in chunks(batch.column(1)):
            starts, ends, at = words_of(data, offsets)
            one, two = _window_hashes(data, starts, ends)
            found = []
            for i in range(first, last):
                span = spans[i].values
                begin, n = (np.asarray(span.field(k)).astype(np.int64) for k in (0, 1))
                pos = np.unique(ranges(begin, n))
                found.append((np.full(len(pos), ids[i]), pos, pos + at[i - first]))
            doc, pos, at_word = (np.concatenate(x) for x in zip(*found, strict=True))
            yield pa.record_batch(
                [
                    pa.array(doc, pa.int64()),
                    pa.array(pos.astype(np.int32)),
                    pa.array(mixed(one.of(at_word, at_word + window)).view(np.int64)),
                    pa.array(mixed(two.of(at_word, at_word + window)).view(np.int64)),
                ],
                names=["doc", "start", "win1", "win2"],
            )


@tidy
def removal_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc, spans: array of (start, end) word positions to remove from each document that has any.

    docs: columns doc_id (whole number) and text. A span covers windows whose words also start in a document with a
    smaller doc_id. Rows without doc_id or text take no part. A row that is repeated whole counts once. Spans of one
    document may touch or overlap.
    """
    texts = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    runs = written(
        texts.mapInArrow(lambda it: _runs(it, window, anchor), "doc long, start int, n int, anchor long, run1 long, run2 long"),
        "runs",
    )
    key = ["anchor", "run1", "run2"]
    firsts = runs.groupBy(*key).agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
    shared = firsts.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    live = firsts.join(shared, "anchor", "left").where("first < last or kinds is not null")
    hits = written(
        runs.join(live, key).where("first < doc or kinds is not null").select("doc", "start", "n", (F.col("first") < F.col("doc")).alias("whole")),
        "run_hits",
    )
    whole = hits.where("whole").select("doc", "start", (F.col("start") + F.col("n") + window - 1).alias("end"))
    parts = hits.where("not whole").groupBy("doc").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    windows = written(
        texts.join(parts, texts["doc_id"] == parts["doc"])
        .select("doc_id", "text", "spans")
        .mapInArrow(lambda it: _windows(it, window), "doc long, start int, win1 long, win2 long"),
        "windows",
    )
    seen = windows.groupBy("win1", "win2").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last")
    seen = written(seen.select("win1", "win2", "first"), "windows_seen")  # so that a join by a common window can be split
    single = windows.join(seen, ["win1", "win2"]).where("first < doc").select("doc", "start", (F.col("start") + window).alias("end"))
    return whole.unionByName(single).groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def _cut(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lengths, removed, hashes, kept = [], [], [], []
        for text, spans in zip(batch.column(1), batch.column(2), strict=True):
            words = (text.as_py() or "").encode().split()
            n = len(words)
            if spans.is_valid and len(spans):
                edge = np.zeros(n + 1, np.int64)
                np.add.at(edge, np.asarray(spans.values.field(0)), 1)
                np.add.at(edge, np.asarray(spans.values.field(1)), -1)
                out = np.cumsum(edge[:-1]) > 0
                words = [words[i] for i in np.flatnonzero(~out)]
            text = b" ".join(words)
            lengths.append(n)
            removed.append(n - len(words))
            hashes.append(hashlib.sha256(text).hexdigest())
            if with_text:
                kept.append(text.decode())
        columns = [batch.column(0), pa.array(lengths, pa.int64()), pa.array(removed, pa.int64()), pa.array(hashes, pa.string())]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        yield pa.record_batch(columns + [pa.array(kept, pa.string())] * with_text, names=names + ["kept_text"] * with_text)


def substring_dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, with_text: bool = True) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text.

    Words are runs of characters other than \\x20 and \\x09-\\x0D; kept words are joined by one space. A null text has no
    words; texts shorter than a window lose nothing; a row without doc_id is kept whole and is no other's first. doc_id
    is taken to be unique but for rows that are repeated whole, which all get the same result. Other columns are ignored.
    """
    spans = removal_spans(docs, window, anchor)
    joined = docs.select("doc_id", "text").join(spans, F.col("doc_id") == spans["doc"], "left").select("doc_id", "text", "spans")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return joined.mapInArrow(lambda it: _cut(it, with_text), schema)
