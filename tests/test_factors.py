"""Factors of series, held against numpy on whole matrices."""

from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.operators import factors as K


def planted(seed, tags=14, steps=12, runs=("r0", "r1")):
    r = np.random.default_rng(seed)
    out, rows = {}, []
    shared = r.normal(size=(tags, 3))
    for run in runs:
        m = r.normal(size=(steps, 3)) * [3, 2, 1] @ shared.T + r.normal(size=(steps, tags)) * 0.3
        m = (m - m.mean(0)) / m.std(0)
        out[run] = m
        rows += [(run, f"t{j:02d}", s + 5, float(m[s, j])) for s in range(steps) for j in range(tags)]
    return out, rows


@pytest.fixture
def z(spark):
    out, rows = planted(1)
    return out, spark.createDataFrame(rows, "run string, tag string, step int, z double").repartition(5)


def unit_loadings(m, most):
    values, vectors = np.linalg.eigh(m.T @ m)
    return vectors[:, ::-1][:, :most].T


def test_bootstrap_is_that_of_weighted_matrices(spark, z):
    matrices, table = z
    got = {(r.run, r.stat): (r.low, r.mid, r.high) for r in K.bootstrap_spectrum(table, 40).collect()}
    names = spark.createDataFrame([(f"t{j:02d}",) for j in range(14)], "tag string").withColumn("h", F.xxhash64(F.lit(5), "tag")).orderBy("tag").collect()
    w = K.poisson_weights(np.array([r.h for r in names]).view(np.uint64), 40)
    assert 0.9 < w.mean() < 1.1 and 0.8 < w.var() < 1.25
    for run, m in matrices.items():
        drawn = []
        for b in range(40):
            s = np.linalg.svd(np.repeat(m, w[b].astype(int), axis=1), compute_uv=False) ** 2
            share = s / s.sum()
            drawn.append((share[0], 1 / (share**2).sum(), 1 + (share.cumsum() + 1e-12 < 0.8).sum(), 1 + (share.cumsum() + 1e-12 < 0.9).sum()))
        for stat, values in zip(("share1", "ratio", "n80", "n90"), zip(*drawn, strict=True), strict=True):
            assert got[run, stat] == pytest.approx(tuple(np.percentile(values, (5, 50, 95))), rel=1e-9)
    again = {(r.run, r.stat): (r.low, r.mid, r.high) for r in K.bootstrap_spectrum(table.coalesce(1), 40).collect()}
    assert {k: pytest.approx(x, rel=1e-9) for k, x in again.items()} == got


def test_leave_one_step_out_is_that_of_refits(z):
    matrices, table = z
    got = {(r.run, r.step, r.k): r.congruence for r in K.leave_one_step_out(table).collect()}
    assert len(got) == 2 * 12 * 3
    for run, m in matrices.items():
        whole = unit_loadings(m, 3)
        for h in range(12):
            y = np.delete(m, h, axis=0)
            part = unit_loadings((y - y.mean(0)) / y.std(0), 3)
            for k in range(3):
                assert got[run, h + 5, k + 1] == pytest.approx(abs(whole[k] @ part[k]), abs=1e-9)


def test_matched_components(z):
    matrices, table = z
    got = {r.k: r for r in K.matched_components(table, "r0", "r1", 4).collect()}
    a, b = (unit_loadings(matrices[r], 4) for r in ("r0", "r1"))
    c = np.abs(a @ b.T)
    want = max(permutations(range(4)), key=lambda p: sum(c[i, j] for i, j in enumerate(p)))
    for k in range(4):
        assert got[k + 1].nearest == c[k].argmax() + 1 and abs(got[k + 1].cosine) == pytest.approx(c[k].max(), abs=1e-9)
        assert got[k + 1].assigned == want[k] + 1 and abs(got[k + 1].assigned_cosine) == pytest.approx(c[k, want[k]], abs=1e-9)


def test_assignment_of_ties_and_unequal_sides():
    r = np.random.default_rng(4)
    for shape in ((3, 3), (2, 4), (4, 4)):
        for _ in range(20):
            g = np.round(r.random(shape), 1)
            want = min(permutations(range(shape[1]), shape[0]), key=lambda p: (round(-sum(g[i, j] for i, j in enumerate(p)), 9), p))
            assert tuple(K.best_assignment(g)) == want


def test_runs_without_common_series(spark):
    rows = [("r0", "a", 1, 1.0), ("r0", "a", 2, -1.0), ("r1", "b", 1, 1.0), ("r1", "b", 2, -1.0)]
    table = spark.createDataFrame(rows, "run string, tag string, step int, z double")
    assert K.matched_components(table, "r0", "r1").count() == 0
    assert sorted((r.run, r.tag, r.rank, round(r.explained, 9)) for r in K.greedy_basis(table, 3).collect()) == [("r0", "a", 1, 1.0), ("r1", "b", 1, 1.0)]
    assert K.change_points(table).count() == 2


def test_segments_by_the_gram_matrix():
    r = np.random.default_rng(6)
    m = r.normal(size=(30, 8)) * 0.2
    m[9:] += r.normal(size=8) * 3
    m[20:] += r.normal(size=8) * 3

    def loss(a, b):
        return ((m[a:b] - m[a:b].mean(0)) ** 2).sum()

    cuts, total = [0, 30], loss(0, 30)
    while True:
        gain, c = max((loss(a, b) - loss(a, c) - loss(c, b), -c) for a, b in zip(cuts, cuts[1:], strict=False) for c in range(a + 2, b - 1))
        if gain <= np.log(30) * total / 30:
            break
        total -= gain
        cuts = sorted([*cuts, -c])
    assert K.segment_starts(m @ m.T) == cuts[:-1] and {9, 20} < set(cuts)


def test_linkage_with_ties_and_many_clusters(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(25, 2))
    rows = [("r", f"t{i:02d}", f"t{j:02d}", float(np.hypot(*(x[i] - x[j])))) for i in range(25) for j in range(i + 1, 25)]
    table = spark.createDataFrame(rows, "run string, x string, y string, d double")
    d = {(a, b): v for _, a, b, v in rows}
    for clusters in (1, 3, 25):
        groups = [[f"t{i:02d}"] for i in range(25)]
        while len(groups) > clusters:
            mean = lambda a, b: np.mean([d[min(p, q), max(p, q)] for p in groups[a] for q in groups[b]])  # noqa: B023, E731
            _, a, b = min((mean(a, b), b, a) for a in range(len(groups)) for b in range(a))
            groups[min(a, b)] += groups.pop(max(a, b))
        found = {}
        for row in K.average_linkage(table, clusters).collect():
            found.setdefault(row.cluster, set()).add(row.tag)
        assert {frozenset(g) for g in found.values()} == {frozenset(g) for g in groups}
    same = spark.createDataFrame([("r", a, b, 0.5) for a, b in ("ab", "ac", "bc")], "run string, x string, y string, d double")
    assert len({row.cluster for row in K.average_linkage(same, 2).collect()}) == 2
