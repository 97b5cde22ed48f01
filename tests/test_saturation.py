"""Bootstraps of fitted curves and headroom, held against one refit at a time and bisection."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.operators import curves as U
from runlens.operators import saturation as S

SCHEMA = "run string, tag string, step int, value double"
X = np.arange(3, 24)


def series():
    r = np.random.default_rng(4)
    noise = r.normal(size=(4, len(X)))
    return {
        "clear": 2 + 5 * (1 - np.exp(-0.35 * X)) + 0.05 * noise[0],
        "sigmoid": 1 + 3 / (1 + np.exp(-0.6 * (X - X.mean()))) + 0.05 * noise[1],
        "line": 0.1 * X + 0.02 * noise[2],
        "falling": 9 - 4 * (1 - np.exp(-0.3 * X)) + 0.05 * noise[3],
    }


@pytest.fixture(scope="module")
def table(spark):
    rows = [("r0", tag, int(x), float(y)) for tag, ys in series().items() for x, y in zip(X, ys, strict=True)]
    rows += [("r0", "clear", 99, None), ("r0", "clear", None, 1.0), ("r1", "short", 1, 2.0), ("r1", "gone", 1, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def found(table):
    rows = S.bootstrapped_fits(table, ["run", "tag"], replicates=40, block=15).collect()
    return {(r.tag, r.model): r for r in rows}


def bisected(model, x, y0, a, b, k):
    """Where the curve first has 90 % of the way behind it, by halving."""
    end = S.plateau(model, a, b, k)
    shape = {
        "exponential": lambda t: 1 - np.exp(-k * t),
        "logistic": lambda t: 1 / (1 + np.exp(-k * (t - x.mean()))),
        "gompertz": lambda t: np.exp(-np.exp(-k * (t - x.mean()))),
        "plateau": lambda t: min(t, k),
    }[model]
    value = lambda t: a + b * shape(t)
    target = y0 + 0.9 * (end - y0)
    low, high = x[0], x[-1] + S.AHEAD
    if end <= y0 or value(high) < target:
        return None
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < target else (low, mid)
    return (low + high) / 2


def test_every_series_and_model_has_a_row(found):
    assert set(found) == {(t, m) for t in series() for m in U.MODELS}


def test_refits_are_those_of_one_at_a_time(found):
    x = X.astype(float)
    for (tag, model), row in found.items():
        y = series()[tag]
        a, b, k, rss = U.fit_shape(model, x, y)
        assert row.rss == pytest.approx(rss)
        curve = U.MODELS[model](x, a, b, k)
        rest = y - curve - (y - curve).mean()
        ys = np.array([curve + rest[S.drawn(f"r0/{tag}/{model}", i, len(x), 11)] for i in range(40)])
        one = [U.fit_shape(model, x, v) for v in ys]
        at_once = S.refits(model, x, ys)
        for v, (*_, loss), *mine in zip(ys, one, *at_once, strict=True):
            assert ((v - U.MODELS[model](x, *mine)) ** 2).sum() == pytest.approx(loss, rel=1e-6, abs=1e-12)
        ends = np.array([S.plateau(model, *f[:3]) for f in one])
        if row.plateau_hi - row.plateau_lo <= 2 * np.ptp(y):
            got = [row[f"plateau_{q}"] for q in S.QUANTILES]
            assert got == pytest.approx(np.quantile(ends, list(S.QUANTILES.values())).tolist(), rel=1e-4)
            assert row.far_above == pytest.approx((ends > y.max() + np.ptp(y)).mean())
        assert (row.n_ok, row.first_value, row.last_value, row.most_value) == (40, y[0], y[-1], y.max())
        assert row.plateau == pytest.approx(S.plateau(model, a, b, k))


def test_ninety_per_cent_is_where_bisection_finds_it(found):
    x = X.astype(float)
    seen = 0
    for (tag, model), row in found.items():
        want = bisected(model, x, series()[tag][0], row.a, row.b, row.k)
        assert (row.x90 is None) == (want is None)
        if want is not None:
            assert row.x90 == pytest.approx(want - x[-1], abs=1e-5)
            seen += row.x90 > x[0] - x[-1]
        assert row.n_x90 <= row.n_ok and (row.x90_mid is None) == (row.n_x90 == 0)
    assert seen >= 4
    assert found["falling", "exponential"].x90 is None


def test_blocks_and_partitions_change_nothing(table, found):
    again = S.bootstrapped_fits(table.repartition(7, "value"), ["run", "tag"], replicates=40, block=40).collect()
    assert {(r.tag, r.model): r for r in again} == found


def test_verdicts(table, found, spark):
    fits = S.with_headroom(S.bootstrapped_fits(table, ["run", "tag"], replicates=40, block=20))
    noise = spark.createDataFrame([("r0", "clear", 0.1), ("r0", "sigmoid", 0.0), ("r0", "line", 1e9)], "run string, tag string, mde double")
    got = {r.tag: r for r in S.saturation_verdicts(fits, noise, ["run", "tag"]).collect()}
    assert set(got) == set(series())
    for tag, row in got.items():
        mine = {m: r for (t, m), r in found.items() if t == tag}
        sure = {m for m, r in mine.items() if r.plateau_hi - r.plateau_lo <= 2 * (r.most_value - r.least_value)}
        best = min(mine, key=lambda m: (mine[m].aicc, m))
        assert row.best == best and row.identifiable == ",".join(sorted(sure))
        assert row.best_identifiable == min(sure, key=lambda m: (mine[m].aicc, m), default=None)
        ends = [r.plateau for r in mine.values()]
        assert row.spread == pytest.approx(max(ends) - min(ends))
        assert row.common_lo == max(r.plateau_lo for r in mine.values()) and row.common_hi == min(r.plateau_hi for r in mine.values())
        assert row.overlap == (row.common_lo <= row.common_hi)
        assert row.headroom == mine[best].plateau - mine[best].last_value
        assert row.n_inside == sum(r.plateau_lo <= r.last_value <= r.plateau_hi for r in mine.values())
        assert (row.n_models, row.n_identifiable) == (4, len(sure))
    assert got["clear"].headroom_over_mde == pytest.approx(got["clear"].headroom / 0.1)
    assert got["sigmoid"].headroom_over_mde is None and got["falling"].mde is None
    assert got["line"].n_exceeds == 0 and got["sigmoid"].n_exceeds == 0
    assert got["clear"].best == "exponential"


def test_odd_inputs(spark):
    assert S.bootstrapped_fits(spark.createDataFrame([], SCHEMA), ["run", "tag"], replicates=5).count() == 0
    level = [("r0", "level", i, 4.0) for i in range(8)]
    rows = spark.createDataFrame(level + level, SCHEMA)  # repeated rows are points of their own
    for r in S.with_headroom(S.bootstrapped_fits(rows, ["run", "tag"], replicates=5)).collect():
        assert (r.n, r.n_ok) == (16, 5)
        assert (r.plateau, r.plateau_lo, r.plateau_hi) == pytest.approx((4, 4, 4)) and r.identifiable


def test_queries_take_every_series(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    fits = entry.queries()["mlt18_saturation"](spark, sf).select("run", "tag", "model")
    boot = entry.queries()["tst14_bootstrapped_fits"](spark, sf)
    assert boot.count() == fits.count() and boot.join(fits, ["run", "tag", "model"]).count() == fits.count()
    assert entry.queries()["mlt19_headroom"](spark, sf).count() == fits.select("run", "tag").distinct().count()
    assert boot.where(F.col("plateau_lo") > F.col("plateau_hi")).count() == 0
