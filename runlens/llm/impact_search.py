"""Exact search for the highest inner products, by an impact-ordered index read score at a time.

Vectors are held in blocks. In a block every dimension has its postings in descending order of value, cut into
segments; a segment's impact for a query is the most it can add to a score. A query reads the segments of all
dimensions in descending impact. Whatever a document has not been seen in adds at most the next impact, so each one's
score is bounded from above. Reading stops when the documents whose bound reaches the k-th best exact score are few
enough to be scored exactly; all others are proven out. Blocks' results are then merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import written

TOP = 5
LEVELS = 256
BLOCK = 4096
QUERY_BLOCK = 256
#: Segments of a dimension in a block.
SEGMENTS = 16
#: Reading pauses at these shares of a block's postings, to bound and try to stop.
PAUSES = (0.2, 0.35, 0.5, 0.65, 0.8, 1.0)
#: So many possible members in a block, for each result asked for, are few enough.
MEMBERS = 8


def _limit(dims: int) -> int:
    """Inner products of vectors of components up to this size stay within 62 bits."""
    return math.isqrt((1 << 62) // max(1, dims))


def _quantised(batch: pa.RecordBatch) -> Iterator[tuple[int, bool, int, np.ndarray]]:
    """(dimensions, wide, id, whole-number vector) of the rows that take part; a wide vector's numbers are Python's."""
    for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        if i is None or not v.is_valid:
            continue
        values = v.values
        if not values.null_count and np.isfinite(x := values.to_numpy(zero_copy_only=False).astype(np.float64)).all():
            if np.abs(x).max(initial=0) * LEVELS < _limit(len(x)):
                yield len(x), False, i, np.floor(LEVELS * x).astype(np.int64)
            else:
                yield len(x), True, i, np.array([math.floor(Fraction(y) * LEVELS) for y in x.tolist()], object)


def _packed(rows: np.ndarray, wide: bool) -> bytes:
    """Vectors as bytes: the narrowest whole numbers that hold them, or text."""
    if wide:
        return " ".join(map(str, rows.ravel().tolist())).encode()
    kind = next(k for k in (np.int16, np.int32, np.int64) if k is np.int64 or (rows.min(initial=0) >= np.iinfo(k).min and rows.max(initial=0) <= np.iinfo(k).max))
    return bytes([np.dtype(kind).itemsize]) + rows.astype(kind).tobytes()


def _unpacked(packed: bytes, n: int, wide: bool) -> np.ndarray:
    if wide:
        return np.array([int(x) for x in packed.split()], object).reshape(n, -1)
    return np.frombuffer(packed[1:], f"i{packed[0]}").astype(np.int64).reshape(n, -1)


_BLOCKS = "dims int, wide boolean, spread long, ids binary, vectors binary"


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Blocks of `most` vectors of one size; a task's last ones are smaller."""

    def block(dims: int, wide: bool, rows: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        ids = np.array([i for i, _ in rows], np.int64)
        matrix = np.array([x for _, x in rows], object if wide else np.int64).reshape(len(rows), dims)
        columns = [pa.array([dims], pa.int32()), pa.array([wide]), pa.array([int(ids[0])]), pa.array([ids.tobytes()]), pa.array([_packed(matrix, wide)])]
        return pa.record_batch(columns, names=["dims", "wide", "spread", "ids", "vectors"])

    held: dict[tuple[int, bool], list] = {}
    for batch in batches:
        for dims, wide, i, x in _quantised(batch):
            rows = held.setdefault((dims, wide), [])
            rows.append((i, x))
            if len(rows) == most:
                yield block(dims, wide, held.pop((dims, wide)))
    for (dims, wide), rows in held.items():
        yield block(dims, wide, rows)


class ImpactIndex:
    """The postings of one block of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, segments: int = SEGMENTS):
        self.ids, self.vectors = ids, vectors
        n, self.dims = vectors.shape
        self.order = np.argsort(-vectors, axis=0, kind="stable").T.copy()  # dimension, rank: row
        cuts = np.unique(np.linspace(0, n, min(segments, n) + 1).astype(int))
        self.cuts = cuts
        ranked = np.take_along_axis(vectors.T, self.order, axis=1)
        self.highest, self.lowest = ranked[:, cuts[:-1]], ranked[:, cuts[1:] - 1]
        self.postings = [[self.order[d, a:b] for a, b in zip(cuts, cuts[1:], strict=False)] for d in range(self.dims)]

    def search(self, query: np.ndarray, k: int, skip: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """(ids, scores) of the k best (ties: smaller id), without id `skip`; and the number of postings read."""
        n = len(self.ids)
        allowed = self.ids != skip if skip is not None else np.ones(n, bool)
        most = np.where(query[:, None] > 0, self.highest * query[:, None], self.lowest * query[:, None])  # dimension, segment
        order = np.argsort(-most, axis=None, kind="stable")
        impact = most.ravel()[order]
        sizes = np.diff(self.cuts)[order % most.shape[1]]
        read_by = np.cumsum(sizes)
        bound, seen, at = np.zeros(n), np.zeros(n, np.int64), 0
        members = np.flatnonzero(allowed)
        for share in PAUSES:
            to = len(order) if share == 1 else int(np.searchsorted(read_by, share * n * self.dims))
            if to > at:
                part = order[at:to]
                rows = np.concatenate([self.postings[d][s] for d, s in zip((part // most.shape[1]).tolist(), (part % most.shape[1]).tolist(), strict=True)])
                bound += np.bincount(rows, np.repeat(impact[at:to], sizes[at:to]), minlength=n)
                seen += np.bincount(rows, minlength=n)
                at = to
            rest = float(impact[at]) if at < len(order) else 0.0
            upper = bound + (self.dims - seen) * rest
            upper[~allowed] = -np.inf
            if allowed.sum() > k:
                best = np.argpartition(-upper, k - 1)[:k]
                kth = np.sort(self.vectors[best] @ query)[0]
                members = np.flatnonzero(upper >= kth)
            if len(members) <= MEMBERS * k:
                break
        scores = self.vectors[members] @ query
        top = np.lexsort((self.ids[members], -scores))[:k]
        return self.ids[members][top], scores[top], int(read_by[at - 1]) if at else 0


def _plain(ids: np.ndarray, vectors: np.ndarray, query: np.ndarray, k: int, skip: int) -> tuple[list[int], list[int]]:
    """The k best by plain whole numbers, where they may be too large for the index."""
    scores = (vectors.astype(object) * query.astype(object)).sum(axis=1) if vectors.shape[1] else np.zeros(len(ids), object)
    top = sorted((-int(s), int(i)) for s, i in zip(scores, ids.tolist(), strict=True) if i != skip)[:k]
    return [i for _, i in top], [-s for s, _ in top]


def _ordered(score: int) -> bytes:
    """A score as bytes that sort as the scores do: first its sign and length, then its digits, turned over if negative."""
    size = (abs(score).bit_length() + 7) // 8
    digits = abs(score).to_bytes(size, "big")
    if score >= 0:
        return (0x8000 + size).to_bytes(2, "big") + digits
    return (0x7FFF - size).to_bytes(2, "big") + bytes(255 - x for x in digits)


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """For each block of rows (`asked` false) the blocks of queries that follow it."""
    block = index = None
    for batch in batches:
        for asked, dims, wide, ids, packed in zip(*(batch.column(c) for c in ("asked", "dims", "wide", "ids", "vectors")), strict=True):
            ids = np.frombuffer(ids.as_py(), np.int64)
            vectors, wide = _unpacked(packed.as_py(), len(ids), wide.as_py()), wide.as_py()
            vectors = vectors.reshape(len(ids), dims.as_py())
            if not asked.as_py():
                block = ids, vectors, wide
                index = None if wide else ImpactIndex(ids, vectors)
                continue
            out: tuple[list, list, list, list] = ([], [], [], [])
            for q_id, query in zip(ids.tolist(), vectors, strict=True):
                if wide or index is None:
                    found, scores = _plain(block[0], block[1], query, k, q_id)
                else:
                    near, values, _ = index.search(query, k, q_id)
                    found, scores = near.tolist(), values.tolist()
                for column, values in zip(out, ([q_id] * len(found), found, [max(-(1 << 63), min(x, (1 << 63) - 1)) for x in scores], [_ordered(x) for x in scores]), strict=True):
                    column.extend(values)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.record_batch([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["query_id", "vec_id", "score", "place"])


def top_inner_products(rows: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest integer inner products, ties to the smaller vec_id.

    rows and queries: vec_id and embedding, whose components x count as floor(256 x). A query isn't its own result; with
    fewer than k others it gets all. Rows without vec_id, and vectors that are null or hold a null or non-finite
    component, take no part; vectors of different sizes do not meet, and empty ones score 0 with each other. Ranks are
    those of the exact inner products however large; a score beyond 64 bits is given as the nearest long. vec_id is
    taken to be unique but for rows repeated whole, which count once; of different vectors with one vec_id, any one
    takes part. Other columns are ignored.
    """
    wide = rows.select("vec_id", "embedding").dropDuplicates(["vec_id"])
    index = written(wide.mapInArrow(lambda it: _blocks(it, BLOCK), _BLOCKS), "impact_blocks")
    asked = written(queries.select("vec_id", "embedding").dropDuplicates(["vec_id"]).mapInArrow(lambda it: _blocks(it, QUERY_BLOCK), _BLOCKS), "query_blocks")
    # Blocks are numbered, one row a block, so that each is a part of its own; every block of queries goes to every part of its size.
    numbers = written(index.select("dims", "wide", "spread", F.row_number().over(Window.orderBy("dims", "wide", "spread")).alias("part")), "impact_parts")
    parts = max(1, numbers.count())
    left = index.join(numbers, ["dims", "wide", "spread"]).select("part", F.lit(False).alias("asked"), "dims", "wide", "ids", "vectors")
    right = asked.join(numbers.select("dims", "part"), "dims").select("part", F.lit(True).alias("asked"), "dims", "wide", "ids", "vectors")
    dealt = left.unionByName(right).repartitionByRange(parts, "part").sortWithinPartitions("part", "asked")
    found = dealt.select("asked", "dims", "wide", "ids", "vectors").mapInArrow(lambda it: _search(it, k), "query_id long, vec_id long, score long, place binary")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("place"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
