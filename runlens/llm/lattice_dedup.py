"""Embedding near-duplicates by lattice hashing.

In each of several tables a unit vector is projected twice to 8 dimensions, and each projection is decoded to the
nearest point of the E8 lattice; the two points are its cell. Vectors whose cosine is high fall into the same cell or
into neighbouring ones: every vector is stored under its own cell and probes its own and the nearest cells around it.
Vectors that meet are verified by their cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .links import HUB_SHARE, components
from .storage import tidy, written
from .textbuf import mixed

COSINE = 0.9
TABLES = 10
PROBES = 16
#: Lattice points that make a cell. With one, 2 % of all pairs meet; with two, 0.1 %.
LATTICES = 2
#: Lattice units per unit of projected length.
SCALE = 1.45
#: Pairs up to which a cell is joined row by row; beyond, its vectors are multiplied in blocks of about BLOCK.
CELL_PAIRS = 4096
BLOCK = 1024
#: Pairs looked at in one step.
_PAIRS = 1 << 15
_LINKS = "a long, b long, others long"


def _decode_d8(x: np.ndarray) -> np.ndarray:
    """Nearest points with whole coordinates of even sum."""
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(axis=1).astype(np.int64) & 1)
    if len(odd):
        gap = x[odd] - near[odd]
        worst = np.abs(gap).argmax(axis=1)
        rows = np.arange(len(odd))
        near[odd, worst] += np.where(gap[rows, worst] >= 0, 1, -1)
    return near


def decode_e8(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8, the union of D8 and D8 + 1/2, to each row."""
    whole, half = _decode_d8(x), _decode_d8(x - 0.5) + 0.5
    closer = ((x - half) ** 2).sum(axis=1) < ((x - whole) ** 2).sum(axis=1)
    return np.where(closer[:, None], half, whole)


def _minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: steps to the neighbouring cells."""
    steps = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1, -1), repeat=2):
            v = [0.0] * 8
            v[i], v[j] = a, b
            steps.append(v)
    steps += [[s / 2 for s in signs] for signs in product((1, -1), repeat=8) if signs.count(-1) % 2 == 0]
    return np.array(steps)


def _projection(table: int, dims: int, lattices: int) -> np.ndarray:
    """Orthogonal directions, 8 for each lattice, scaled so that each 8 keep lengths on average."""
    r = np.random.default_rng([20, table, dims])
    wide = 8 * lattices
    basis = np.linalg.qr(r.standard_normal((dims, dims)))[0] if dims >= 8 else np.eye(dims)
    out = np.zeros((dims, wide))
    out[:, : min(wide, dims)] = basis[:, : min(wide, dims)]
    return out * np.sqrt(max(dims, 8) / 8)


def lattice_cells(unit: np.ndarray, table: int, probes: int = PROBES, lattices: int = LATTICES, scale: float = SCALE) -> np.ndarray:
    """Hashes of each unit vector's own cell (column 0) and of the `probes` nearest cells one lattice step away."""
    # Rounded, so that a vector has the same cells in whatever batch they are computed.
    x = np.round(unit @ _projection(table, unit.shape[1], lattices) * scale, 9).reshape(-1, lattices, 8)
    own = decode_e8(x.reshape(-1, 8)).reshape(x.shape)
    steps = _minimal_vectors()
    # A neighbour's distance falls with the step's inner product with the offset from the own point.
    gain = np.round(np.concatenate([(x[:, k] - own[:, k]) @ steps.T for k in range(lattices)], axis=1), 8)
    order = np.argsort(-gain, axis=1, kind="stable")[:, :probes]
    # A cell's hash adds up its coordinates' weights, so a step adds the same whatever the cell.
    weights = mixed(np.arange(1, 8 * lattices + 1, dtype=np.uint64)).reshape(lattices, 8) | np.uint64(1)
    whole = lambda cells: np.rint(cells * 2).astype(np.int64).view(np.uint64)
    home = (whole(own) * weights).sum(axis=(1, 2), dtype=np.uint64)
    moves = np.concatenate([(whole(steps) * w).sum(axis=1, dtype=np.uint64) for w in weights])
    return mixed(np.column_stack([home, home[:, None] + moves[order]]) + np.uint64(1000 * unit.shape[1] + table))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vector's 128-bit hash, and null for a vector that can't be compared."""
    for batch in batches:
        keys: list = []
        for v in batch.column(1):
            values = np.array([np.nan if x is None else x for x in v.as_py()], np.float64) if v.is_valid else np.zeros(0)
            ok = len(values) and np.isfinite(values).all() and values.any()
            keys.append(xxhash.xxh3_128_digest((values + 0.0).tobytes()) if ok else None)
        yield pa.record_batch([*batch.columns, pa.array(keys, pa.binary())], names=["vec_id", "embedding", "sig"])


def _unit(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) for each number of dimensions."""
    sizes = np.asarray(column.value_lengths())
    values, offsets = column.values.to_numpy(zero_copy_only=False).astype(np.float64), np.asarray(column.offsets)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        v = values[offsets[rows][:, None] + np.arange(size)]
        v = v / np.abs(v).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
        yield rows, v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _cells(batches: Iterator[pa.RecordBatch], tables: int, probes: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        reps = batch.column(0).to_numpy()
        for rows, unit in _unit(batch.column(1)):
            for t in range(tables):
                cells = lattice_cells(unit, t, probes).view(np.int64)
                yield pa.record_batch(
                    [pa.array(np.repeat(reps[rows], probes + 1)), pa.array(cells.ravel()), pa.array(np.full(cells.size, t, np.int32)), pa.array(np.tile(np.arange(probes + 1) == 0, len(rows)))],
                    names=["rep", "cell", "t", "own"],
                )


def _first_met(unit: np.ndarray, a: np.ndarray, b: np.ndarray, place: np.ndarray, probes: int) -> np.ndarray:
    """Whether the pairs (a, b), rows of `unit`, meet at no place before `place`.

    Place 2 t is the own cell in table t of the first of a pair, which has the smaller rep; 2 t + 1 that of the second.
    """
    alive = np.ones(len(a), bool)
    for t in range(int(place.max(initial=0)) // 2 + 1):
        todo = np.flatnonzero(alive & (place > 2 * t))
        if not len(todo):
            continue
        cells = lattice_cells(unit, t, probes)
        for k in range(0, len(todo), _PAIRS):
            at = todo[k : k + _PAIRS]
            met = (cells[a[at], :1] == cells[b[at]]).any(axis=1)
            late = np.flatnonzero(~met & (place[at] > 2 * t + 1))
            met[late] = (cells[b[at[late]], :1] == cells[a[at[late]]]).any(axis=1)
            alive[at[met]] = False
    return alive


def _similar(unit: np.ndarray, a: np.ndarray, b: np.ndarray, cosine: float) -> np.ndarray:
    keep = np.zeros(len(a), bool)
    for k in range(0, len(a), _PAIRS):
        keep[k : k + _PAIRS] = np.einsum("ij,ij->i", unit[a[k : k + _PAIRS]], unit[b[k : k + _PAIRS]]) >= cosine
    return keep


def _forest(reps: np.ndarray, copies: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """For every rep on a pair (a, b): the least rep that these pairs reach, and the copies of its partners. reps ascend."""
    label, others = np.arange(len(reps)), np.zeros(len(reps), np.int64)
    np.add.at(others, a, copies[b])
    np.add.at(others, b, copies[a])
    while True:
        least, new = np.minimum(label[a], label[b]), label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    on = np.flatnonzero(others)
    return pa.record_batch([pa.array(reps[on]), pa.array(reps[label[on]]), pa.array(others[on])], names=["a", "b", "others"])


def _pair_links(batches: Iterator[pa.RecordBatch], cosine: float, probes: int) -> Iterator[pa.RecordBatch]:
    """Links among pairs that met: columns a, b, place, u, v, copies of a, copies of b."""
    for batch in batches:
        same = np.flatnonzero(np.asarray(batch.column(3).value_lengths()) == np.asarray(batch.column(4).value_lengths()))
        part = batch.take(pa.array(same))
        a, b, place, ca, cb = (part.column(k).to_numpy() for k in (0, 1, 2, 5, 6))
        for (rows, left), (_, right) in zip(_unit(part.column(3)), _unit(part.column(4)), strict=True):
            close = np.flatnonzero(np.einsum("ij,ij->i", left, right) >= cosine)
            if not len(close):
                continue
            at = rows[close]
            reps, index = np.unique(np.concatenate([a[at], b[at]]), return_index=True)
            unit, copies = np.concatenate([left[close], right[close]])[index], np.concatenate([ca[at], cb[at]])[index]
            x, y = np.searchsorted(reps, a[at]), np.searchsorted(reps, b[at])
            first = _first_met(unit, x, y, place[at], probes)
            yield _forest(reps, copies, x[first], y[first])


def _block_links(group: pa.Table, cosine: float, probes: int) -> pa.Table:
    """Links between the stored vectors (side) of a crowded cell's block and those that probe the cell, by one matrix product."""
    group, found = group.combine_chunks(), []
    rep, t, own, side, copies = (group.column(c).to_numpy() for c in ("rep", "t", "own", "side", "copies"))
    vectors = group.column("embedding").chunk(0) if group.num_rows else pa.array([], group.schema.field("embedding").type)
    for rows, unit in _unit(vectors):
        reps, index = np.unique(rep[rows], return_index=True)
        unit = unit[index]
        stored, probing = np.flatnonzero(side[rows]), np.flatnonzero(~side[rows])
        x, y = np.searchsorted(reps, rep[rows[stored]]), np.searchsorted(reps, rep[rows[probing]])
        lives_here = own[rows[probing]]
        values = unit[x] @ unit[y].T
        # A pair of two stored vectors is taken once, from the smaller side; rounding decides nothing near the threshold.
        i, j = np.nonzero((values >= cosine - 1e-9) & ((x[:, None] < y[None]) | ((x[:, None] > y[None]) & ~lives_here[None])))
        near = np.flatnonzero(values[i, j] < cosine + 1e-9)
        keep = np.ones(len(i), bool)
        keep[near] = _similar(unit, x[i[near]], y[j[near]], cosine)
        left, right = x[i[keep]], y[j[keep]]
        place = 2 * int(t[0]) + (left > right)
        a, b = np.minimum(left, right), np.maximum(left, right)
        first = _first_met(unit, a, b, place, probes)
        found.append(_forest(reps, copies[rows][index], a[first], b[first]))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("others", pa.int64())])
    return pa.Table.from_batches(found, schema) if found else schema.empty_table()


def _with_sizes(cells: DataFrame) -> DataFrame:
    """Entries of cells that some pair shares, with the vectors stored in the cell (m) and all its entries (p).

    Cells with more than a HUB_SHARE of all entries are at most 1 / HUB_SHARE and are broadcast, so that no task gets one whole.
    """
    sizes = written(cells.groupBy("cell", "t").agg(F.count_if("own").alias("m"), F.count("*").alias("p")).where("m > 0 and p > 1"), "cell_sizes")
    most = cells.count() * HUB_SHARE
    crowds = sizes.where(F.col("p") > most)
    in_crowd = cells.join(F.broadcast(crowds), ["cell", "t"])
    rest = cells.join(F.broadcast(crowds), ["cell", "t"], "left_anti").join(sizes.where(F.col("p") <= most), ["cell", "t"])
    return in_crowd.unionByName(rest)


@tidy
def lattice_links(vectors: DataFrame, cosine: float = COSINE, tables: int = TABLES, probes: int = PROBES, pairs: int = CELL_PAIRS, block: int = BLOCK) -> DataFrame:
    """a, b, others: rows that add up to the links at this cosine or more. vectors: rep (unique), embedding and copies, comparable ones alone.

    The sum of `others` over a's rows counts the copies of the vectors linked with a; the rows, taken as edges, have the
    same connected components as all links. Cells of up to `pairs` pairs are joined, and each pair is verified. A larger
    cell is cut into blocks of about `block` vectors whose products give counts and a spanning forest, so that its pairs
    are never rows. A pair counts at the first place where it meets, and nowhere else.
    """
    cells = written(vectors.select("rep", "embedding").mapInArrow(lambda it: _cells(it, tables, probes), "rep long, cell long, t int, own boolean"), "cells")
    sized = written(_with_sizes(cells), "sized_cells")
    few = F.col("m") * F.col("p") <= pairs
    kept = sized.where(few)
    met = kept.where("own").select(F.col("rep").alias("x"), "cell", "t").join(kept.select(F.col("rep").alias("y"), "cell", "t", "own"), ["cell", "t"])
    met = met.where("x < y or (x > y and not own)")
    placed = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), (F.col("t") * 2 + F.when(F.col("x") > F.col("y"), 1).otherwise(0)).alias("place"))
    firsts = placed.groupBy("a", "b").agg(F.min("place").alias("place"))
    left = vectors.select(F.col("rep").alias("a"), F.col("embedding").alias("u"), F.col("copies").alias("ca"))
    right = vectors.select(F.col("rep").alias("b"), F.col("embedding").alias("v"), F.col("copies").alias("cb"))
    verified = firsts.join(left, "a").join(right, "b").select("a", "b", "place", "u", "v", "ca", "cb")
    small = verified.mapInArrow(lambda it: _pair_links(it, cosine, probes), _LINKS)

    blocks = lambda count: F.ceil(F.col(count) / block).cast("int")
    dealt = lambda count: F.pmod(F.xxhash64("rep"), blocks(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), blocks(count) - 1))
    crowded = sized.where(~few).join(vectors.select("rep", "embedding", "copies"), "rep")
    columns = ["cell", "t", "rep", "own", "embedding", "copies"]
    stored = crowded.where("own").select(*columns, F.lit(True).alias("side"), dealt("m").alias("bx"), every("p").alias("by"))
    probing = crowded.select(*columns, F.lit(False).alias("side"), every("m").alias("bx"), dealt("p").alias("by"))
    large = stored.unionByName(probing).groupBy("cell", "t", "bx", "by").applyInArrow(lambda group: _block_links(group, cosine, probes), _LINKS)
    return small.unionByName(large)


def embedding_dedup(embeddings: DataFrame, cosine: float = COSINE, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """One row per vector: vec_id, n_links (other vec_ids linked directly), component_id, kept.

    Vectors link at a cosine of at least `cosine`, in double precision. Vectors that are null, empty or zero or hold a
    null or non-finite component link with nothing; nor do vectors of different sizes. Equal vectors are compared with
    others once. component_id is the smallest vec_id that links reach. A row without vec_id has no links and a null
    component; rows repeated whole count once, and different vectors of one vec_id are each linked under that id. Other
    columns are ignored. Vectors that never meet in a cell are not
    compared: at the default parameters more than 99 % of the links right at the threshold are found, and more than 99.9 % of those
    at 0.95 and above.
    """
    kind = embeddings.schema["embedding"].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    rows = written(rows.mapInArrow(_signatures, f"vec_id long, embedding {kind}, sig binary"), "vectors")
    ids = rows.where("sig is not null and vec_id is not null")
    named = ids.select("sig", "vec_id").distinct()
    classes = named.groupBy("sig").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = written(classes, "vector_classes")
    vectors = written(ids.join(classes, (ids["vec_id"] == classes["rep"]) & (ids["sig"] == classes["sig"])).select("rep", "embedding", "copies").dropDuplicates(["rep"]), "vector_reps")
    links = lattice_links(vectors, cosine, tables, probes)
    degree = links.groupBy("a").agg(F.sum("others").alias("others"))
    found = components(links.select("a", "b"))
    result = (
        classes.join(degree, classes["rep"] == degree["a"], "left")
        .join(found, classes["rep"] == found["node"], "left")
        .select(F.col("sig").alias("s"), "copies", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("c"))
    )
    result = written(result, "vector_results")
    # Classes with more than a HUB_SHARE of all rows are few and broadcast, so that no task gets all copies of one vector.
    crowds = result.where(F.col("copies") > rows.count() * HUB_SHARE)
    crowd_sigs = F.broadcast(crowds.select("s"))
    named_rows = rows.select("vec_id", "sig")
    in_crowd = named_rows.join(F.broadcast(crowds), F.col("sig") == F.col("s"))
    rest = named_rows.join(crowd_sigs, F.col("sig") == F.col("s"), "left_anti").join(result, F.col("sig") == F.col("s"), "left")
    joined = in_crowd.unionByName(rest)
    has_id = F.col("vec_id").isNotNull()
    return joined.select(
        "vec_id",
        F.when(has_id, F.coalesce("n", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        F.when(has_id, F.coalesce("c", "vec_id")).alias("component_id"),
    ).withColumn("kept", F.col("vec_id") == F.col("component_id"))
