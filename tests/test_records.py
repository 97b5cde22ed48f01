"""Trend tests, spectra in short, shift-shares of windows and attribution by hints, on small tables."""

import numpy as np
import pytest

from runlens.functions.distributions import student_p
from runlens.operators import association as A
from runlens.operators import context as X
from runlens.operators import decomposition as C
from runlens.operators import multivariate as V
from runlens.sources.telemetry import Telemetry


def test_trend_test(spark):
    r = np.random.default_rng(2)
    series = {f"t{k}": 0.2 * k * np.arange(5 + k) + r.normal(size=5 + k) for k in range(6)}
    rows = [(t, i, float(v)) for t, s in series.items() for i, v in enumerate(s)]
    rows += [("line", i, 2.0 * i) for i in range(5)] + [("level", i, 1.0) for i in range(5)] + [("two", i, 1.0 * i) for i in range(2)] + [("gap", 0, None)]
    got = {x.tag: x for x in A.trend_test(("tag",), spark.createDataFrame(rows, "tag string, step int, value double")).collect()}
    assert set(got) == {*series, "line", "level", "two"}
    for t, s in series.items():
        x, row = np.arange(len(s)), got[t]
        design = np.column_stack([np.ones(len(s)), x])
        coef, rss, *_ = np.linalg.lstsq(design, s, rcond=None)
        se = np.sqrt(rss[0] / (len(s) - 2) / ((x - x.mean()) ** 2).sum())
        assert (row.slope, row.intercept, row.se, row.t) == pytest.approx((coef[1], coef[0], se, coef[1] / se))
        assert row.r == pytest.approx(np.corrcoef(x, s)[0, 1])
        # The interval's half, over the error, is where the two-sided p is 0.05; p by the density summed up.
        assert (row.low + row.high) / 2 == pytest.approx(row.slope)
        assert float(student_p(np.array((row.high - row.low) / 2 / se), np.array(len(s) - 2.0))) == pytest.approx(0.05, abs=1e-6)
        df, grid = len(s) - 2, np.linspace(0, abs(row.t), 200_001)
        density = (1 + grid**2 / df) ** (-(df + 1) / 2)
        angle = np.linspace(0, np.pi / 2, 200_001)
        whole = np.trapezoid(np.sqrt(df) * np.cos(angle) ** (df - 1), angle)
        assert row.p == pytest.approx(1 - np.trapezoid(density, grid) / whole, abs=1e-6)
    assert got["line"].slope == 2 and got["line"].t is None and got["line"].p is None
    assert got["level"].slope == 0 and got["level"].r is None
    assert got["two"].slope is None and got["two"].low is None and got["two"].p is None


def test_spectrum_summary(spark):
    r = np.random.default_rng(8)
    m = r.normal(size=(7, 2)) @ r.normal(size=(2, 20)) + 0.2 * r.normal(size=(7, 20))
    m = (m - m.mean(0)) / m.std(0)
    rows = [("r0", f"t{j}", s, float(m[s, j])) for s in range(7) for j in range(20)]
    row = V.spectrum_summary(spark.createDataFrame(rows, "run string, tag string, step int, z double")).first()
    values = np.sort(np.linalg.eigvalsh(m @ m.T))[::-1]
    shares = values.cumsum() / values.sum()
    edge = (1 + np.sqrt(20 / 6)) ** 2
    assert [row.n80, row.n90, row.n95] == [int((shares >= q).argmax()) + 1 for q in (0.8, 0.9, 0.95)]
    assert (row.n_steps, row.n_series, row.edge) == (7, 20, pytest.approx(edge))
    assert row.ratio == pytest.approx(values.sum() ** 2 / (values**2).sum())
    assert (row.n_above, row.n_above_scaled) == ((values > edge).sum(), (values / 6 > edge).sum())


def test_shift_shares_leave_out_parts_without_weight_or_rate(spark):
    rows = [("a", 1, 2.0, 0.5), ("b", 1, 6.0, 0.1), ("a", 2, 3.0, 0.7), ("b", 2, 1.0, 0.3), ("c", 1, 1.0, 0.9), ("d", 2, 1.0, 0.9), ("e", 1, 0.0, 0.4), ("e", 2, 5.0, 0.4), ("f", 1, 1.0, None), ("f", 2, 1.0, 0.2), ("a", 3, 0.0, 1.0)]
    table = spark.createDataFrame(rows, "part string, step int, weight double, rate double")
    got = {x.step: x for x in C.shift_shares(table, "part", 1).collect()}
    assert set(got) == {1, 2}
    row = got[1]
    assert (row.parts, row.left_out) == (2, 4)
    assert row.within == pytest.approx(0.25 * 0.2 + 0.75 * 0.2)
    assert row.mix == pytest.approx(0.5 * 0.5 - 0.5 * 0.1)
    assert row.paasche == pytest.approx(0.2) and row.within + row.mix + row.interaction == pytest.approx(row.total)
    assert row.total == pytest.approx((0.75 * 0.7 + 0.25 * 0.3) - (0.25 * 0.5 + 0.75 * 0.1))
    assert got[2].parts == 0 and got[2].total is None
    whole = C.shift_share(table.where("step = 1"), table.where("step = 2"), "part").first()
    assert (row.within, row.mix, row.interaction, row.total) == pytest.approx((whole.within, whole.mix, whole.interaction, whole.total))


def test_hints_choose_the_anchor(spark):
    restarts = spark.createDataFrame([(1, "r0", 3, 100.0), (2, "r1", 9, 110.0), (3, "r1", 9, 130.0), (4, "r0", None, 5000.0)], "event_id long, run string, step int, t double")

    def found(*notices):
        table = spark.createDataFrame(list(notices), "notice_id long, t double, hint_run string, hint_step int")
        return {x.event_id: (x.notice_id, x.delta) for x in X.attributed_by_hints(restarts, table, 1000.0, 50.0).collect()}

    none = (None, None)
    assert found((7, 101.0, None, None)) == {1: (7, -1.0), 2: none, 3: none, 4: none}
    assert found((7, 101.0, "r1", None)) == {1: none, 2: (7, 9.0), 3: (7, 29.0), 4: none}
    assert found((7, 101.0, None, 10)) == {1: none, 2: (7, 9.0), 3: (7, 29.0), 4: none}
    assert found((7, 101.0, "r0", 10))[1] == none
    assert found((7, 105.0, None, None))[1] == (7, -5.0)  # a tie: the earlier restart
    assert found((7, 4990.0, None, 3))[4] == none  # no step fits no hint of one
    assert found((8, 120.0, "r1", None), (7, 90.0, "r1", None))[3] == (7, 40.0)  # the first notice wins
    assert found((7, None, None, None)) == dict.fromkeys((1, 2, 3, 4), none)


def test_a_second_month_has_steps_of_its_own(spark, tmp_path):
    days = spark.createDataFrame([(0, "2024-01-31", 2, "view", 1.0), (1, "2024-02-01", 2, "view", 2.0), (2, "2024-01-01", 3, "view", 4.0)], "event_id long, ts string, user_id long, event_type string, value double")
    days.selectExpr("event_id", "cast(ts as timestamp_ntz) as ts", "user_id", "event_type", "value").write.parquet(f"{tmp_path}/events.parquet")
    assert {x.event_id: x.step for x in Telemetry(spark, str(tmp_path)).ev.collect()} == {0: 31, 1: 32, 2: 1}
    assert {x.event_id: x.step for x in Telemetry(spark, str(tmp_path), "2024-01-31").ev.collect()} == {0: 1, 1: 2, 2: -29}
