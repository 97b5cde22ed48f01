"""SimHash fingerprints, and groups of documents whose fingerprints differ in a few bits.

The pivot table holds the Hamming distances of every fingerprint to fixed reference fingerprints, block by block. Two
fingerprints that differ in at most `bits` bits have equal coordinates in all but `bits` blocks: equal coordinates in
the remaining blocks are the join key. A pair that meets is discarded if any coordinate over the whole fingerprint
differs by more than `bits`, and what survives is verified bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .links import components
from .storage import tidy, written
from .textbuf import mixed

SHINGLE = 3
BITS = 2
SEED = 42
PIVOTS = 16
#: Keys that more fingerprints share are joined through common neighbours instead of pair by pair.
CROWD = 64
_SLICE = 1 << 15


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> bytes:
    """The 64-bit hashes of a UTF-8 text's shingles, eight bytes each, most significant first."""
    words = text.lower().split()  # of bytes: A-Z and \x20, \x09-\x0D only
    if not words:
        return b""
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = max(1, len(words) - shingle + 1)
    starts, ends = starts[:last].tolist(), ends[-last:].tolist()
    digest = xxhash.xxh64_digest
    return b"".join([digest(joined[s:e], SEED) for s, e in zip(starts, ends, strict=True)])


def fingerprint_of(hashes: bytes) -> bytes:
    """The 64-bit fingerprint of shingles by their hashes, most significant byte first."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 8 * _SLICE):
        part = np.frombuffer(hashes[k : k + 8 * _SLICE], np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.uint32)
    return np.packbits(2 * ones > len(hashes) // 8).tobytes()


def fingerprint(text: bytes, shingle: int = SHINGLE) -> bytes:
    """The 64-bit fingerprint of a UTF-8 text, most significant byte first."""
    return fingerprint_of(shingle_hashes(text, shingle))


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = b"".join(fingerprint((t.as_py() or "").encode(), shingle) for t in batch.column(1))
        yield pa.record_batch([batch.column(0), pa.array(np.frombuffer(found, ">u8").astype(np.uint64).view(np.int64))], names=["doc_id", "fp"])


def simhash(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, a signed 64-bit fingerprint, per row; a text without words (null, empty) has fingerprint 0."""
    return docs.select("doc_id", "text").mapInArrow(lambda it: _fingerprints(it, shingle), "doc_id long, fp long")


def _blocks(bits: int) -> list[int]:
    """Masks of bits + 3 blocks that share out the 64 bits."""
    edges = np.linspace(0, 64, bits + 4).astype(int).tolist()
    return [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:], strict=False)]


def _tables(bits: int) -> list[tuple[int, ...]]:
    """The sets of three blocks, one of which stays equal when `bits` bits change."""
    return list(combinations(range(bits + 3), 3))


def _pivots() -> np.ndarray:
    return mixed(np.arange(1, PIVOTS + 1, dtype=np.uint64))


def _pivot_rows(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """For each fingerprint and table: the key, and the coordinates packed in two longs."""
    blocks, tables = np.array(_blocks(bits), np.uint64), _tables(bits)
    for batch in batches:
        fps = batch.column(0).to_numpy().view(np.uint64)
        away = fps[:, None] ^ _pivots()[None, :]
        by_block = np.stack([np.bitwise_count(away & b) for b in blocks], axis=1).astype(np.uint64)  # fingerprint, block, pivot
        weights = mixed(np.arange(100, 100 + 3 * PIVOTS, dtype=np.uint64)) | np.uint64(1)
        keys = np.stack([mixed((by_block[:, t, :].reshape(len(fps), -1) * weights).sum(axis=1, dtype=np.uint64) + np.uint64(k)) for k, t in enumerate(map(list, tables))], axis=1)
        packed = by_block.sum(axis=1).astype(np.uint8).view(np.int64)  # fingerprint, 2
        each = len(tables)
        yield pa.record_batch(
            [
                pa.array(np.tile(np.arange(each, dtype=np.int32), len(fps))),
                pa.array(keys.ravel().view(np.int64)),
                pa.array(np.repeat(fps.view(np.int64), each)),
                batch.column(1).take(pa.array(np.repeat(np.arange(len(fps)), each))),
                pa.array(np.repeat(packed[:, 0], each)),
                pa.array(np.repeat(packed[:, 1], each)),
            ],
            names=["tab", "key", "fp", "rep", "c0", "c1"],
        )


def _close(bits: int) -> Column:
    """No coordinate of the pair (x, y) differs by more than `bits`."""
    apart = [F.abs(F.shiftright(f"x.{c}", 8 * k).bitwiseAND(255) - F.shiftright(f"y.{c}", 8 * k).bitwiseAND(255)) for c in ("c0", "c1") for k in range(8)]
    return F.greatest(*apart) <= bits


def _crowd_links(crowd: DataFrame, bits: int) -> DataFrame:
    """Links within crowded keys: fingerprints within `bits` (1 or 2) share a neighbour at one bit or are neighbours.

    Each fingerprint names itself and its neighbours at one bit outside the key's blocks, where alone a difference can
    be; all that name a neighbour link to the least of them. The rows grow with the crowd, not with its square.
    """
    masks = _blocks(bits)
    free = [[i for i in range(64) if not any(masks[b] >> i & 1 for b in t)] for t in _tables(bits)]
    signed = [[0, *(int(np.array([1 << i], np.uint64).view(np.int64)[0]) for i in f)] for f in free]
    flips = F.element_at(F.array(*[F.array(*[F.lit(x).cast("long") for x in f]) for f in signed]), F.col("tab") + 1)
    named = crowd.select("tab", "key", "fp", "rep", F.explode(flips).alias("flip")).withColumn("point", F.col("fp").bitwiseXOR(F.col("flip")))
    least = named.groupBy("tab", "key", "point").agg(F.min("rep").alias("least"), F.count("*").alias("n")).where("n > 1")
    return named.join(least, ["tab", "key", "point"]).where("rep <> least").select(F.col("least").alias("a"), F.col("rep").alias("b")).distinct()


@tidy
def fingerprint_links(classes: DataFrame, bits: int = BITS, crowd: int = CROWD) -> DataFrame:
    """a, b: pairs of `rep` whose fingerprints differ in 1 to `bits` bits, at least enough of them to connect all such pairs.

    classes: fp (unique) and rep, the smallest doc_id with it. `bits` is 1 or 2.
    """
    rows = written(classes.select("fp", "rep").mapInArrow(lambda it: _pivot_rows(it, bits), "tab int, key long, fp long, rep long, c0 long, c1 long"), "pivots")
    sizes = rows.groupBy("tab", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = written(rows.join(sizes, ["tab", "key"]), "pivots_met")
    few = met.where(F.col("n") <= crowd)
    pairs = (
        few.alias("x")
        .join(few.alias("y"), (F.col("x.tab") == F.col("y.tab")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp")) & _close(bits))
        .where(F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= bits)
        .select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b"))
        .distinct()
    )
    return pairs.unionByName(_crowd_links(met.where(F.col("n") > crowd), bits))


def simhash_groups(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """doc_id, fp and component_id per row: the smallest doc_id that links of at most `bits` differing bits reach.

    Texts are lower-cased (A-Z), cut into words (runs of characters other than \\x20 and \\x09-\\x0D) and into shingles;
    fewer words than a shingle make one shingle. Null, empty and blank texts have fingerprint 0 and link like any other.
    A row without doc_id has a fingerprint but neither links nor a component. Other columns are ignored.
    """
    fps = written(simhash(docs, shingle), "fingerprints")
    classes = written(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "fingerprint_classes")
    found = components(fingerprint_links(classes, bits))
    named = classes.join(found, classes["rep"] == found["node"], "left").select(F.col("fp").alias("f"), F.coalesce("component", "rep").alias("component_id"))
    return fps.join(named, F.col("fp") == F.col("f"), "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
