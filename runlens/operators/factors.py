"""Factors of many series without one task that holds them all.

A run's series meet only in its Gram matrix, which is as large as its number of steps squared. Whatever is asked of all
series is either read off that matrix (eigenvectors, losses of segments) or a pass over the series, a row each, in which
every task works on its own ones with what the driver knows of the matrix: a few vectors as long as the axis.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.streaming.ingest import state_folder

from .clusters import connected
from .multivariate import gram


def series_vectors(z: DataFrame) -> DataFrame:
    """run, tag, z: each series as an array in the order of its steps. All series of a run have all of its steps."""
    return z.groupBy("run", "tag").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "z"))), lambda x: x["z"]).alias("z"))


def _square(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    wide = pdf.pivot(index="s1", columns="s2", values="g").sort_index()
    m = wide.to_numpy()
    return wide.index.to_numpy(), (m + m.T) / 2


def _eigen(m: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, none below zero, and their vectors as rows; also of a stack of matrices."""
    values, vectors = np.linalg.eigh(m)
    return np.maximum(values[..., ::-1][..., :most], 0), np.swapaxes(vectors[..., ::-1][..., :most], -1, -2)


def components(g: DataFrame, most: int) -> DataFrame:
    """run, k, eigenvalue, step, u: the first eigenvectors of each run's Gram matrix (one task a run)."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        steps, m = _square(pdf)
        values, vectors = _eigen(m, most)
        k, s = np.indices(vectors.shape)
        return pd.DataFrame({"run": pdf["run"].iloc[0], "k": k.ravel() + 1, "eigenvalue": values[k.ravel()], "step": steps[s.ravel()], "u": vectors.ravel()})

    return g.groupBy("run").applyInPandas(solve, "run string, k long, eigenvalue double, step int, u double")


def loadings(z: DataFrame, most: int = 3) -> DataFrame:
    """run, k, tag, loading: unit vectors over a run's series, the largest weight positive (of equal ones the first tag's).

    A loading is a series' product with an eigenvector of the Gram matrix, so series join vectors by step and are summed.
    Components without variance have none.
    """
    u = components(gram(z), most).where("eigenvalue > 1e-9")
    raw = z.join(F.broadcast(u), ["run", "step"]).groupBy("run", "k", "tag").agg((F.sum(F.col("z") * F.col("u")) / F.sqrt(F.first("eigenvalue"))).alias("loading"))
    # weights that differ by rounding alone are equal
    largest = raw.groupBy("run", "k").agg(F.min_by("loading", F.struct(-F.round(F.abs("loading"), 9), "tag")).alias("at"))
    return raw.join(F.broadcast(largest), ["run", "k"]).select("run", "k", "tag", (F.col("loading") * F.signum("at")).alias("loading"))


def segment_starts(m: np.ndarray, least: int = 2, most: int = 20) -> list[int]:
    """Starts of segments by binary segmentation, from the Gram matrix of the steps alone.

    A segment's squared error is the sum of its diagonal less the sum of its square over its length. The cut with the
    largest gain is taken while the gain exceeds ln n times the mean squared error of a step, at most `most` times.
    """
    n = len(m)
    diagonal = np.concatenate([[0], np.cumsum(np.diag(m))])
    block = np.zeros((n + 1, n + 1))
    block[1:, 1:] = m.cumsum(0).cumsum(1)

    def loss(a, b):
        return diagonal[b] - diagonal[a] - (block[b, b] - block[a, b] - block[b, a] + block[a, a]) / (b - a)

    cuts, total = [0, n], float(loss(0, n))
    for _ in range(most):
        best = (-np.inf, 0)
        for a, b in zip(cuts, cuts[1:], strict=False):
            c = np.arange(a + least, b - least + 1)
            if len(c):
                gain = loss(a, b) - loss(a, c) - loss(c, b)
                best = max(best, (float(gain.max()), -int(c[gain.argmax()])))
        if best[0] <= np.log(n) * total / n:
            break
        total -= best[0]
        cuts = sorted([*cuts, -best[1]])
    return cuts[:-1]


def split_candidates(z: DataFrame, most: int = 4, least: int = 2) -> DataFrame:
    """run, step, stat: the steps before which one cut lowers the squared error of all of a run's series most, of equal ones the earliest."""

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        steps, m = _square(pdf)
        n = len(m)
        diagonal, block = np.concatenate([[0], np.cumsum(np.diag(m))]), np.zeros((n + 1, n + 1))
        block[1:, 1:] = m.cumsum(0).cumsum(1)
        loss = lambda a, b: diagonal[b] - diagonal[a] - (block[b, b] - block[a, b] - block[b, a] + block[a, a]) / (b - a)
        c = np.arange(least, n - least + 1)
        stat = loss(0, n) - loss(0, c) - loss(c, n) if len(c) else np.zeros(0)
        best = np.argsort(-np.round(stat, 9), kind="stable")[:most]
        return pd.DataFrame({"run": pdf["run"].iloc[0], "step": steps[c[best]], "stat": stat[best]})

    return gram(z).groupBy("run").applyInPandas(cut, "run string, step int, stat double")


def change_points(z: DataFrame, least: int = 2, most: int = 20) -> DataFrame:
    """run, step: the first step of each segment of a run, over all its series at once (see segment_starts)."""

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        steps, m = _square(pdf)
        return pd.DataFrame({"run": pdf["run"].iloc[0], "step": steps[segment_starts(m, least, most)]})

    return gram(z).groupBy("run").applyInPandas(cut, "run string, step int")


def _by_run(vectors: DataFrame, work: Callable[[str, np.ndarray, pd.DataFrame], pd.DataFrame | None], schema: str) -> DataFrame:
    """What `work` makes of the series of each run in each batch: run, matrix of series by steps, their other columns."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for run, part in frame.groupby("run"):
                if (found := work(run, np.stack(part["z"].to_numpy()), part)) is not None:
                    yield found

    return vectors.mapInPandas(batches, schema)


def _grams(z: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Steps and Gram matrix of each run: axes squared, which is what the driver holds."""
    return {run: _square(part) for run, part in gram(z).toPandas().groupby("run")}


def greedy_basis(z: DataFrame, most: int) -> DataFrame:
    """run, rank, tag, explained: series picked one by one for the most variance they explain, with the share explained so far.

    A round is one pass over all series: with the Gram matrix of what is left, each series knows what it would explain.
    The driver gets the best series of each run, of those that explain equally much the first by name.
    """
    folder = state_folder(z.sparkSession)
    series_vectors(z).write.parquet(f"{folder}/vectors")
    vectors = z.sparkSession.read.parquet(f"{folder}/vectors")
    left = {run: (np.eye(len(m)), m, float(np.trace(m))) for run, (_, m) in _grams(z).items()}
    rows, explained = [], dict.fromkeys(left, 0.0)
    for rank in range(1, most + 1):
        state = dict(left)

        def gains(run, matrix, part, state=state):
            if run not in state:
                return None
            project, m, total = state[run]
            rest = matrix @ project
            norm = (rest**2).sum(axis=1)
            gain = np.where(norm > 1e-9, ((rest @ m) * rest).sum(axis=1) / np.maximum(norm, 1e-300), 0.0) / total
            return pd.DataFrame({"run": run, "tag": part["tag"].array, "gain": gain, "z": list(rest)})

        found = _by_run(vectors, gains, "run string, tag string, gain double, z array<double>")
        best = found.groupBy("run").agg(F.min_by(F.struct("tag", "gain", "z"), F.struct(-F.round("gain", 9), "tag")).alias("b")).collect()
        for run, b in best:
            if b.gain <= 1e-9:
                left.pop(run)
                continue
            q = np.array(b.z) / np.linalg.norm(b.z)
            project, m, total = left[run]
            away = np.eye(len(q)) - np.outer(q, q)
            left[run] = project @ away, away @ m @ away, total
            explained[run] += b.gain
            rows.append((run, rank, b.tag, min(explained[run], 1.0)))
        if not left:
            break
    return z.sparkSession.createDataFrame(rows, "run string, rank long, tag string, explained double")


def average_linkage(distances: DataFrame, clusters: int) -> DataFrame:
    """run, tag, cluster (its first tag): series merged by least mean distance until `clusters` are left.

    distances: run, x, y, d for all x < y. Each round merges all pairs of clusters that are each other's nearest, which
    for mean distances gives the same tree as merging the nearest pair of all; of equal distances the one to the first
    name counts. A round is a few grouped sums over the pairs that are left. At last the highest merges are undone.
    """
    spark, folder = distances.sparkSession, state_folder(distances.sparkSession)

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    pairs = kept(distances.select("run", "x", "y", F.col("d").alias("total"), F.lit(1).cast("long").alias("n")), "pairs-0")
    names = distances.select("run", F.explode(F.array("x", "y")).alias("tag")).distinct()
    merges, number = [], 0
    while not pairs.isEmpty():
        d = F.round(F.col("total") / F.col("n"), 12)
        ends = pairs.select("run", F.col("x").alias("a"), F.col("y").alias("b"), d.alias("d")).unionByName(pairs.select("run", F.col("y").alias("a"), F.col("x").alias("b"), d.alias("d")))
        nearest = ends.groupBy("run", "a").agg(F.min(F.struct("d", F.least("a", "b"), F.greatest("a", "b"), "b")).alias("m")).select("run", "a", "m.b", "m.d")
        other = nearest.select("run", F.col("a").alias("b"), F.col("b").alias("a"))
        merged = kept(nearest.join(other, ["run", "a", "b"]).where("a < b").withColumn("round", F.lit(number)), f"merges-{number}")
        merges.append(merged)
        renamed = merged.select("run", F.col("b").alias("old"), F.col("a").alias("new"))
        for side in ("x", "y"):
            pairs = pairs.join(renamed.withColumnRenamed("old", side), ["run", side], "left").withColumn(side, F.coalesce("new", side)).drop("new")
        pairs = pairs.where("x <> y").groupBy("run", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        number += 1
        pairs = kept(pairs, f"pairs-{number}")
    if not merges:
        return names.select("run", "tag", F.col("tag").alias("cluster"))
    tree = spark.read.parquet(*[f"{folder}/merges-{k}" for k in range(number)])
    # a merge may come before one of equal height that holds it, so rounds break ties; one row a series and run
    undone = F.row_number().over(Window.partitionBy("run").orderBy(F.desc("d"), F.desc("round"), F.desc("a"))) < clusters
    whole = tree.withColumn("undone", undone).where("not undone")
    links = whole.select(F.struct("run", F.col("a").alias("tag")).alias("a"), F.struct("run", F.col("b").alias("tag")).alias("b"))
    found = connected(links).select("node.run", "node.tag", F.col("component.tag").alias("cluster"))
    return names.join(found, ["run", "tag"], "left").withColumn("cluster", F.coalesce("cluster", "tag"))


#: Shares of Poisson(1): a replicate takes a series 0, 1, 2, ... times.
_POISSON = np.cumsum(np.exp(-1) / np.array([1, 1, 2, 6, 24, 120, 720, 5040, 40320], float))


def poisson_weights(hashes: np.ndarray, replicates: int) -> np.ndarray:
    """Times that each replicate (row) takes each series (column), from a 64-bit hash of the series' name alone."""
    h = hashes.astype(np.uint64)[None, :] + np.arange(1, replicates + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    u = ((h ^ (h >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)
    return np.searchsorted(_POISSON, u, "right").astype(float)


def spectrum_of(m: np.ndarray) -> tuple[float, float, int, int]:
    """(share of the first eigenvalue, participation ratio, components for 80 % and for 90 %) of a Gram matrix."""
    values = np.maximum(np.linalg.eigvalsh((m + m.T) / 2)[::-1], 0)
    share = values / max(values.sum(), 1e-300)
    up = share.cumsum() + 1e-12
    return float(share[0]), float(1 / max((share**2).sum(), 1e-300)), int((up < 0.8).sum()) + 1, int((up < 0.9).sum()) + 1


def bootstrap_spectrum(z: DataFrame, replicates: int = 200, seed: int = 5) -> DataFrame:
    """run, stat, low, mid, high: 5, 50 and 95 % of the spectrum's statistics when series are drawn anew.

    stat: share1 (of the first component), ratio (participation), n80 and n90 (components for so much). A replicate
    weights each series by a Poisson number from a hash of its name, so no draw depends on partitions; every task sums
    its series' weighted Gram matrices of all replicates before anything is shuffled. A replicate that takes no series is left out.
    """
    vectors = series_vectors(z).withColumn("h", F.xxhash64(F.lit(seed), "tag"))

    def sums(run, matrix, part):
        w = poisson_weights(part["h"].to_numpy().view(np.uint64), replicates)
        n = matrix.shape[1]
        outer = np.einsum("js,jt->jst", matrix, matrix).reshape(len(matrix), n * n)
        return pd.DataFrame({"run": run, "replicate": np.arange(1, replicates + 1), "g": list(w @ outer)})

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.sum(np.stack(pdf["g"].to_numpy()), axis=0)
        n = int(round(len(m) ** 0.5))
        found = [spectrum_of(m.reshape(n, n))] if m.any() else []
        return pd.DataFrame(found, columns=["share1", "ratio", "n80", "n90"]).assign(run=pdf["run"].iloc[0])[["run", "share1", "ratio", "n80", "n90"]]

    partial = _by_run(vectors, sums, "run string, replicate long, g array<double>")
    drawn = partial.groupBy("run", "replicate").applyInPandas(solve, "run string, share1 double, ratio double, n80 double, n90 double")
    long = drawn.unpivot("run", ["share1", "ratio", "n80", "n90"], "stat", "v")
    return long.groupBy("run", "stat").agg(*(F.percentile("v", q).alias(name) for name, q in (("low", 0.05), ("mid", 0.5), ("high", 0.95))))


def _without_steps(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mean, spread) of each series (row) when each step (column) is left out; a spread of zero counts as one."""
    n = matrix.shape[1]
    mean = (matrix.sum(axis=1, keepdims=True) - matrix) / (n - 1)
    square = ((matrix**2).sum(axis=1, keepdims=True) - matrix**2) / (n - 1) - mean**2
    spread = np.sqrt(np.maximum(square, 0))
    return mean, np.where(spread > 1e-12, spread, 1.0)


def leave_one_step_out(z: DataFrame, most: int = 3) -> DataFrame:
    """run, step, k, congruence: the absolute cosine of each component's loadings with those found without one step.

    Every series is put in standard scores again without the step. One pass over the series sums a Gram matrix for each
    step left out, their eigenvectors come from one task a run, and a second pass sums the products of loadings.
    """
    spark = z.sparkSession
    folder = state_folder(spark)
    series_vectors(z).write.parquet(f"{folder}/vectors")
    vectors = spark.read.parquet(f"{folder}/vectors")
    whole = {run: (steps, *_eigen(m, most)) for run, (steps, m) in _grams(z).items()}

    def sums(run, matrix, part):
        n = matrix.shape[1]
        mean, spread = _without_steps(matrix)
        out = []
        for h in range(n):
            y = (matrix - mean[:, [h]]) / spread[:, [h]]
            y[:, h] = 0.0
            out.append((y.T @ y).ravel())
        return pd.DataFrame({"run": run, "held": np.arange(n), "g": out})

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.sum(np.stack(pdf["g"].to_numpy()), axis=0)
        n = int(round(len(m) ** 0.5))
        values, u = _eigen(m.reshape(n, n), most)
        return pd.DataFrame({"run": pdf["run"].iloc[0], "held": pdf["held"].iloc[0], "k": np.arange(len(u)) + 1, "value": values, "u": list(u)})

    partial = _by_run(vectors, sums, "run string, held long, g array<double>")
    solved = partial.groupBy("run", "held").applyInPandas(solve, "run string, held long, k long, value double, u array<double>").toPandas()  # axes times axes
    by_run = {run: part.sort_values(["held", "k"]) for run, part in solved.groupby("run")}

    def products(run, matrix, part):
        steps, values, u = whole[run]
        mine = by_run[run]
        k = int(mine["k"].max())
        mean, spread = _without_steps(matrix)
        whole_loading = matrix @ u[:k].T / np.sqrt(np.maximum(values[:k], 1e-300))
        held_u = np.stack(mine["u"].to_numpy()).reshape(-1, k, matrix.shape[1])
        held_value = mine["value"].to_numpy().reshape(-1, k)
        rows = []
        for h in range(matrix.shape[1]):
            y = (matrix - mean[:, [h]]) / spread[:, [h]]
            y[:, h] = 0.0
            loading = y @ held_u[h].T / np.sqrt(np.maximum(held_value[h], 1e-300))
            rows += [(run, int(steps[h]), c + 1, float((loading[:, c] * whole_loading[:, c]).sum())) for c in range(k)]
        return pd.DataFrame(rows, columns=["run", "step", "k", "dot"])

    dots = _by_run(vectors, products, "run string, step int, k long, dot double")
    return dots.groupBy("run", "step", "k").agg(F.abs(F.sum("dot")).alias("congruence"))


def best_assignment(gain: np.ndarray) -> list[int]:
    """The column for each row with the largest sum, each column once; of equal sums the lexically first (rows <= columns)."""
    k, n = gain.shape
    best = {0: (0.0, ())}
    for row in range(k):
        found: dict[int, tuple[float, tuple[int, ...]]] = {}
        for used, (total, picked) in best.items():
            for c in range(n):
                if not used >> c & 1:
                    new = (total + gain[row, c], (*picked, c))
                    key = used | 1 << c
                    if key not in found or (round(-new[0], 12), new[1]) < (round(-found[key][0], 12), found[key][1]):
                        found[key] = new
        best = found
    return list(min(best.values(), key=lambda x: (round(-x[0], 12), x[1]))[1])


def matched_components(z: DataFrame, one: str, two: str, most: int = 5) -> DataFrame:
    """k, nearest, cosine, assigned, assigned_cosine: components of run `one` by those of run `two`, over their common series.

    nearest has the largest absolute cosine of loadings; assigned is part of the assignment, each component once, with the
    largest sum. Loadings are joined by series and summed; what one task gets is a table of at most `most` squared cosines.
    """
    both = z.where(F.col("run") == one).select("tag").distinct().join(z.where(F.col("run") == two).select("tag").distinct(), "tag")
    found = loadings(z.where(F.col("run").isin(one, two)).join(both, "tag"), most)
    a, b = (found.where(F.col("run") == r).select("tag", F.col("k").alias(k), F.col("loading").alias(f"w{k}")) for r, k in ((one, "ka"), (two, "kb")))
    cosines = a.join(b, "tag").groupBy("ka", "kb").agg((F.sum(F.col("wka") * F.col("wkb")) / F.sqrt(F.sum(F.col("wka") ** 2) * F.sum(F.col("wkb") ** 2))).alias("c"))

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="ka", columns="kb", values="c").sort_index().sort_index(axis=1)
        c = wide.to_numpy()
        size = np.round(np.abs(c), 12)
        near = size.argmax(axis=1)
        if c.shape[0] <= c.shape[1]:
            picked = dict(enumerate(best_assignment(size)))
        else:
            picked = {row: column for column, row in enumerate(best_assignment(size.T))}
        rows = [(int(k), int(wide.columns[near[i]]), c[i, near[i]], int(wide.columns[picked[i]]) if i in picked else None, c[i, picked[i]] if i in picked else None) for i, k in enumerate(wide.index)]
        return pd.DataFrame(rows, columns=["k", "nearest", "cosine", "assigned", "assigned_cosine"]).astype({"assigned": "Int64"})

    return cosines.groupBy().applyInPandas(match, "k long, nearest long, cosine double, assigned long, assigned_cosine double")
