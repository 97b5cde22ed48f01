"""Operators against plain twins, closed forms and invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.functions import distributions as D
from runlens.functions import formats as M
from runlens.operators import curves as U
from runlens.operators import factors as K
from runlens.operators import merge as G
from runlens.operators import multivariate as V
from runlens.operators import sequence as S
from runlens.operators import temporal as T
from runlens.operators import tests as H
from runlens.operators.clusters import connected


def test_student_against_closed_forms():
    t = np.array([0.0, 0.3, 1.0, 2.5, 12.0])
    assert D.student_p(t, np.full(5, 1.0)) == pytest.approx(1 - 2 / math.pi * np.arctan(t), abs=1e-12)
    assert D.student_p(t, np.full(5, 2.0)) == pytest.approx(1 - t / np.sqrt(2 + t * t), abs=1e-12)
    assert D.student_quantile(0.975, 1) == pytest.approx(math.tan(math.pi * 0.475), rel=1e-6)
    assert D.student_quantile(0.975, 2) == pytest.approx(0.95 * math.sqrt(2 / (1 - 0.95**2)), rel=1e-6)


def test_betainc_and_normal():
    x = np.array([0.0, 0.1, 0.5, 0.9, 1.0])
    assert D.betainc(1.0, 1.0, x) == pytest.approx(x)
    assert D.betainc(2.0, 1.0, x) == pytest.approx(x**2)
    assert D.betainc(3.5, 2.0, x) == pytest.approx(1 - D.betainc(2.0, 3.5, 1 - x))
    assert D.normal_quantile(np.array([0.5, 0.975])) == pytest.approx([0, 1.959963984540054], abs=1e-9)


def test_t_test_on_columns(spark):
    rows = spark.createDataFrame([(1.0, 1.0), (None, 3.0), (2.0, 0.0)], "t double, df double")
    assert [x.p if x.p is None else round(x.p, 9) for x in rows.select(D.t_test_p("t", "df").alias("p")).collect()] == [0.5, None, None]


def test_as_of_in_buckets(spark):
    r = np.random.default_rng(1)
    facts = [("ab"[int(i % 2)], float(t), int(i)) for i, t in enumerate(r.integers(0, 500, 120))]
    probes = [("abc"[int(i % 3)], float(t)) for i, t in enumerate(r.integers(-20, 520, 150))]
    f = spark.createDataFrame(facts, "k string, at double, v long")
    p = spark.createDataFrame(probes, "k string, t double")
    for backward in (True, False):
        got = sorted((x.k, x.t, -1 if x.v is None else x.v) for x in T.as_of(p, f, ["k"], "t", "at", ["v"], backward, bucket=7.0).collect())

        def want(k, t):
            ok = [(at, v) for kk, at, v in facts if kk == k and (at <= t if backward else at >= t)]
            return -1 if not ok else (max if backward else min)(ok)[1]

        assert got == sorted((k, t, want(k, t)) for k, t in probes)


def test_merging_again_changes_nothing(spark):
    old = spark.createDataFrame([("r", "a", 1, 1.0), ("r", "a", 2, None), ("r", "b", 1, 5.0)], "run string, tag string, step int, value double")
    new = spark.createDataFrame([("r", "a", 1, 2.0), ("r", "a", 2, 3.0), ("r", "b", 1, None), ("r", "c", 1, 4.0)], old.schema)
    once = G.merge_series(old, new)
    assert {(x.tag, x.step): (x.value, x.change) for x in once.collect()} == {("a", 1): (1.0, "conflict"), ("a", 2): (3.0, "filled"), ("b", 1): (5.0, "kept"), ("c", 1): (4.0, "filled")}
    twice = G.merge_series(once.drop("change"), new)
    assert {(x.tag, x.step): x.value for x in twice.collect()} == {(x.tag, x.step): x.value for x in once.collect()}
    redo = spark.createDataFrame([("r", 1)], "run string, step int")
    assert {(x.tag, x.step): (x.value, x.change) for x in G.merge_series(old, new, redo).collect()}[("a", 1)] == (2.0, "rewritten")


def test_differences_do_not_bridge_gaps(spark):
    f = spark.createDataFrame([("r", "t", s, v) for s, v in ((1, 1.0), (2, 3.0), (4, 9.0), (5, None), (6, 10.0))], "run string, tag string, step int, value double")
    assert [x.delta for x in S.with_difference(f).orderBy("step").collect()] == [None, 2.0, None, None, None]
    assert [x.delta for x in S.with_bridged_difference(f).orderBy("step").collect()] == [None, 2.0, 6.0, 1.0]
    assert [x.rank for x in S.with_average_rank(f.withColumn("value", F.when(F.col("step") < 3, 1.0).otherwise(F.col("value")))).orderBy("step").collect()] == [1.5, 1.5, 3.0, None, 4.0]


def test_holm_is_stricter_than_hochberg(spark):
    p = spark.createDataFrame([(0.011,), (0.026,), (0.03,), (0.04,), (None,)], "p double")
    got = H.holm(p, [], "p").orderBy("p").collect()
    assert [x.holm for x in got] == [True, False, False, False] and [x.hochberg for x in got] == [True] * 4


def test_fits_find_the_curve(spark):
    x = np.arange(1.0, 31.0)
    for name, k in (("exponential", 0.2), ("logistic", 0.3), ("gompertz", 0.25), ("plateau", 12.0)):
        y = U.MODELS[name](x, 2.0, 5.0, k)
        a, b, found, rss = U.fit_shape(name, x, y)
        assert rss < 1e-4 * ((y - y.mean()) ** 2).sum()
        assert found == pytest.approx(k, rel=0.05)


def test_change_points_and_spectrum(spark):
    m = np.vstack([np.zeros((10, 3)), np.full((8, 3), 4.0)]) + np.random.default_rng(2).normal(0, 0.1, (18, 3))
    assert K.segment_starts(m @ m.T) == [0, 10]
    z = spark.createDataFrame([("r", f"t{j}", i, float(m[i, j])) for i in range(18) for j in range(3)], "run string, tag string, step int, z double")
    assert [x.step for x in K.change_points(z).orderBy("step").collect()] == [0, 10]
    values = [x.eigenvalue for x in V.spectrum(V.gram(z)).orderBy("k").collect()]
    assert values[:3] == pytest.approx(np.linalg.svd(m, compute_uv=False) ** 2) and max(values[3:]) < 1e-9
    ratio = V.participation_ratio(V.gram(z)).first().ratio
    assert ratio == pytest.approx(sum(values) ** 2 / sum(v * v for v in values))


def test_average_linkage_against_a_naive_twin(spark):
    r = np.random.default_rng(3)
    points = np.concatenate([r.normal(c, 0.2, (5, 2)) for c in (0, 4, 9)])
    d = np.linalg.norm(points[:, None] - points[None], axis=2)
    rows = [("r", f"p{i:02}", f"p{j:02}", float(d[i, j])) for i in range(15) for j in range(i + 1, 15)]
    got = K.average_linkage(spark.createDataFrame(rows, "run string, x string, y string, d double"), 3).collect()
    assert {frozenset(x.tag for x in got if x.cluster == c) for c in {x.cluster for x in got}} == {frozenset(f"p{i:02}" for i in range(k, k + 5)) for k in (0, 5, 10)}


def test_connected_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 40), (7, 7)], "a long, b long")
    assert {x.node: x.component for x in connected(links).collect()} == {i: 0 for i in range(21)} | {40: 40, 50: 40}


def test_formats(spark):
    rows = [(0.0, "0", "0s"), (1234567.0, "1.23M", "14d 06h"), (950.0, "950", "15m"), (-2500.0, "-2.5k", "0s"), (None, "—", "—"), (7260.0, "7.26k", "2h 01m")]
    df = spark.createDataFrame([(v,) for v, *_ in rows], "v double")
    got = df.select(M.compact(F.col("v")).alias("c"), M.duration(F.col("v")).alias("d")).collect()
    assert [(x.c, x.d) for x in got] == [(c, d) for _, c, d in rows]
