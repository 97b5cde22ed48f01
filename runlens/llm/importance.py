"""Importance resampling towards a target: documents are drawn as if from the distribution of a target's word features.

Features are hashed into buckets by CRC-32. The bytes of an Arrow text column are classified by a lookup table, words
begin and end where the class changes, and a table-driven CRC advances over all words of a chunk at once, byte by byte.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .positions import numbered
from .storage import tidy, written
from .textbuf import chunks, ranges

BUCKETS = 10_000
SEED = 2024
PERCENT = 10
LEAST_WORDS = 20
_FEW = 32

#: The class table: a byte's lower-case form if it belongs to a word (0-9, A-Z, a-z, all above \x7F), else 0.
WORD_BYTE = np.zeros(256, np.uint8)
for _first, _last, _shift in ((0x30, 0x39, 0), (0x41, 0x5A, 0x20), (0x61, 0x7A, 0), (0x80, 0xFF, 0)):
    WORD_BYTE[_first : _last + 1] = np.arange(_first, _last + 1) + _shift


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)  # the polynomial of CRC-32, reflected
    return table


CRC_TABLE = _crc_table()


def crc32_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each range of bytes: all ranges advance by one byte together, the longest first, until few are left."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    at, size = starts[order], size[order]
    crc = np.full(len(at), 0xFFFFFFFF, np.uint32)
    k, live = 0, int(np.searchsorted(-size, 0, "left"))
    while live >= _FEW:
        now = crc[:live]
        crc[:live] = CRC_TABLE[(now ^ data[at[:live] + k]) & 0xFF] ^ (now >> 8)
        k += 1
        live = int(np.searchsorted(-size, -k, "left"))
    for i in range(live):  # ranges that are far longer than the others
        crc[i] = zlib.crc32(data[at[i] + k : at[i] + size[i]], int(crc[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    found = np.empty_like(crc)
    found[order] = crc ^ np.uint32(0xFFFFFFFF)
    return found


def words_and_case(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(classified bytes, starts, ends, first word of each text and the number of words)."""
    low = WORD_BYTE[data]
    edge = np.zeros(len(low) + 1, np.int8)
    edge[:-1] = low > 0
    edge[1:] -= edge[:-1].copy()  # +1 where a word begins after a gap, -1 behind its end
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(low))]
    inner = np.unique(inner[(low[inner] > 0) & (low[inner - 1] > 0)])  # a text ends in a word and the next begins with one
    starts = np.sort(np.concatenate([np.flatnonzero(edge > 0), inner]))
    ends = np.sort(np.concatenate([np.flatnonzero(edge < 0), inner]))
    return low, starts, ends, np.searchsorted(starts, offsets)


def _joined(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words with one space behind each, so that a run of words is one range."""
    size = ends - starts
    to = np.cumsum(size + 1) - size - 1
    out = np.full(int(size.sum()) + len(size), 0x20, np.uint8)
    out[ranges(to, size)] = low[ranges(starts, size)]
    return out, to, to + size


def features_of(data: np.ndarray, offsets: np.ndarray, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each feature, text of each feature, words of each text): runs of 1 to `longest` words of one text."""
    low, starts, ends, at = words_and_case(data, offsets)
    n = np.diff(at)
    if longest > 1:
        low, starts, ends = _joined(low, starts, ends)
    text = np.repeat(np.arange(len(n)), n)
    found, owner = [], []
    for k in range(1, longest + 1):
        first = np.flatnonzero(np.arange(len(starts)) + k <= at[1:][text])
        found.append(crc32_of(low, starts[first], ends[first + k - 1]) % np.uint32(buckets))
        owner.append(text[first])
    return np.concatenate(found).astype(np.int64), np.concatenate(owner), n


def _count(batches: Iterator[pa.RecordBatch], longest: int, buckets: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(buckets, np.int64)
    for batch in batches:
        for _, _, data, offsets in chunks(batch.column(0)):
            total += np.bincount(features_of(data, offsets, longest, buckets)[0], minlength=buckets)
    held = np.flatnonzero(total)
    yield pa.record_batch([pa.array(held), pa.array(total[held])], names=["bucket", "n"])


def bucket_counts(texts: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket; a task counts its own before anything is shuffled. The driver gets a row per bucket."""
    counted = texts.select("text").mapInArrow(lambda it: _count(it, longest, buckets), "bucket long, n long")
    found = np.zeros(buckets, np.int64)
    for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        found[r.bucket] = r.n
    return found


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds to a weight: thousandths of the log ratio of smoothed shares, rounded down."""
    s, t, n = source.astype(float), target.astype(float), len(source)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def _weigh(batches: Iterator[pa.RecordBatch], longest: int, gains: np.ndarray, with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, data, offsets in chunks(batch.column(1)):
            bucket, owner, words = features_of(data, offsets, longest, len(gains))
            n = np.bincount(owner, minlength=last - first)
            weight = np.zeros(last - first, np.int64)
            np.add.at(weight, owner, gains[bucket])
            columns = [batch.column(0).slice(first, last - first), pa.array(words.astype(np.int64)), pa.array(n), pa.array(weight)]
            names = ["doc_id", "n_words", "n_features", "weight"]
            if with_text:
                columns, names = [*columns, batch.column(1).slice(first, last - first)], [*names, "text"]
            yield pa.record_batch(columns, names=names)


@tidy
def importance_resample(
    docs: DataFrame,
    target: DataFrame,
    longest: int = 1,
    buckets: int = BUCKETS,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
    with_text: bool = True,
) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank (of those drawn, from 1; else null) and, if asked for, text.

    docs: doc_id (whole number) and text; target: text. Other columns are ignored, whatever their names. Words are runs
    of 0-9, A-Z (lower-cased), a-z and characters above \\x7F; features are runs of 1 to `longest` words of one text,
    repeats included. A weight sums the gains of a document's features; a score adds Gumbel noise that depends on seed
    and doc_id alone, so the highest scores are a draw without replacement. Drawn are `percent` in a hundred (rounded
    down) of the documents with `least_words` words.

    Null and empty texts have no features and weight 0. Every row is a document, repeated ones too: rows that tie in
    score go by doc_id, then by features and weight; rows equal in all of these in any order. A row without doc_id is
    counted in the features, but has no score and takes no part in the draw. An empty target leaves smoothed shares; an
    empty table gives no rows.
    """
    gains = gains_of(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    schema = "doc_id long, n_words long, n_features long, weight long" + ", text string" * with_text
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    weighed = rows.mapInArrow(lambda it: _weigh(it, longest, gains, with_text), schema)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = written(weighed.withColumn("score", F.col("weight") + noise), "scored")
    may = F.coalesce((F.col("n_words") >= least_words) & F.col("doc_id").isNotNull(), F.lit(False))
    drawn = percent * scored.where(may).count() // 100
    order = [F.col("score").desc(), F.col("doc_id").asc(), F.col("n_features").asc(), F.col("weight").asc()]
    ranked = numbered(scored.where(may), order, "rank").withColumn("rank", F.when(F.col("rank") < drawn, F.col("rank") + 1))
    found = ranked.unionByName(scored.where(~may).withColumn("rank", F.lit(None).cast("long")))
    return found.select("doc_id", "n_features", "weight", "score", "rank", *["text"] * with_text)
