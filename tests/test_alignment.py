"""Alignment by cost, hidden pools and diagnostics of cuts, held against plain twins."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.operators import alignment as A
from runlens.operators import factors as K


def test_interpolation_is_numpys(spark):
    r = np.random.default_rng(2)
    points, want = [], {}
    grid = [0.0, 1.0, 2.5, 7.0, 99.0, 250.0, 1000.0]
    for key in "abc":
        x = np.unique(np.round(r.uniform(0, 300, 40), 1)) if key != "c" else np.array([2.5])
        y = r.normal(size=len(x))
        points += [(key, float(p), float(q)) for p, q in zip(x, y, strict=True)]
        want |= {(key, c): None if c < x[0] or c > x[-1] else float(np.interp(c, x, y)) for c in grid}
    got = A.interpolated(spark.createDataFrame(points, "k string, x double, y double"), spark.createDataFrame([(k, c) for k in "abc" for c in grid], "k string, x double"), ["k"], "x", "y", bucket=50.0)
    assert {(g.k, g.x): g.y if g.y is None else pytest.approx(g.y) for g in got.collect()} == want


def test_leads_by_cost(spark):
    fact = [("p", "m", s, float(s)) for s in range(1, 6)] + [("q", "m", s, 2.0 * s) for s in range(2, 4)] + [("q", "m", 4, None), ("p", "only", 1, 1.0)]
    cost = [("p", s, 10.0 * s) for s in range(1, 6)] + [("q", s, 20.0 * s) for s in range(1, 5)] + [("z", 1, 1.0)]
    aligned = A.aligned_by_cost(spark.createDataFrame(fact, "run string, tag string, step int, value double"), spark.createDataFrame(cost, "run string, step int, cost double"), "p", "q", 10.0)
    assert sorted(map(tuple, aligned.collect())) == [("m", 10.0, 1.0, None), ("m", 20.0, 2.0, None), ("m", 30.0, 3.0, None), ("m", 40.0, 4.0, 4.0), ("m", 50.0, 5.0, 5.0), ("only", 10.0, 1.0, None)]
    assert [tuple(r) for r in A.lead_counts(aligned).collect()] == [("m", 2, 0, 0, 0.0, 0.0, 0.0, 40.0, 50.0)]
    none = A.aligned_by_cost(spark.createDataFrame(fact, "run string, tag string, step int, value double"), spark.createDataFrame(cost, "run string, step int, cost double"), "p", "q", 1e6)
    assert none.count() == 0


def test_a_hidden_pool_is_found_again(spark):
    r = np.random.default_rng(4)
    parts, total, want = [], [], {}
    for step in (1, 2, 3):
        w, p = r.uniform(1, 9, 4), r.uniform(0, 1, 4)
        parts += [("r", f"d{k}", step, float(w[k]), float(p[k])) for k in range(3) if not (k == 2 and step == 3)]
        listed = [k for k in range(3) if not (k == 2 and step == 3)]
        whole = [*listed, 3]
        rate = float((w[whole] * p[whole]).sum() / w[whole].sum())
        total.append(("r", step, rate, float(w[3])))
        common = float((w[:2] * p[:2]).sum() / w[:2].sum())
        want[step] = (p[3], common, 2, common - rate, len(listed))
    parts += [("r", "null", 1, 3.0, None), ("r", "none", 1, 0.0, 0.5)]
    total += [("r", 4, 0.5, 2.0), ("s", 1, 0.9, 1.0)]
    parts += [("r", f"d{k}", 4, 5.0, 0.1) for k in range(2)] + [("s", "d", 1, 9.0, 0.1)]
    got = {(x.run, x.step): x for x in A.hidden_pool(spark.createDataFrame(parts, "run string, part string, step int, weight double, rate double"), spark.createDataFrame(total, "run string, step int, rate double, hidden double")).collect()}
    for step, (hidden, common, n, gap, listed) in want.items():
        x = got["r", step]
        assert (x.hidden_rate, x.common_rate, x.common_parts, x.gap, x.all_parts, x.feasible) == (pytest.approx(hidden), pytest.approx(common), n, pytest.approx(gap), listed, True)
    assert got["s", 1].feasible is False and got["s", 1].hidden_rate == pytest.approx(0.9 * 10 - 0.9)


def test_cuts_and_their_diagnostics(spark):
    r = np.random.default_rng(5)
    m = r.normal(size=(16, 6)) * 0.1
    m[7:, :4] += 3.0  # stays
    m[12:15, 4:] += 2.0  # comes back
    z = [("r", f"{'ab'[j >= 4]}/{j}", s + 1, float(m[s, j])) for s in range(16) for j in range(6)]
    table = spark.createDataFrame(z, "run string, tag string, step int, z double")
    cuts = K.split_candidates(table, 3)
    profile = {p: (p * (16 - p) / 16) * ((m[:p].mean(0) - m[p:].mean(0)) ** 2).sum() for p in range(2, 15)}
    best = sorted(profile, key=lambda p: -profile[p])[:3]
    assert {x.step: pytest.approx(x.stat) for x in cuts.collect()} == {p + 1: profile[p] for p in best} and best[0] == 7
    axis = spark.createDataFrame([("r", s, 100.0 * s) for s in range(1, 17)], "run string, step int, wall double")
    events = spark.createDataFrame([("r", 790.0), ("r", 815.0), ("r", 1400.0), ("x", 801.0)], "run string, t double")
    chosen = spark.createDataFrame([("r", 1), ("r", 8), ("r", 13), ("r", 15)], "run string, step int")
    got = {x.step: x for x in A.cut_diagnostics(table, chosen, axis, events, F.substring("tag", 1, 1)).collect()}
    assert set(got) == {8, 13, 15}
    for step in (8, 13):
        p = step - 1
        before, after = m[max(0, p - 3) : p].mean(0), m[p : p + 3].mean(0)
        shift = np.linalg.norm(after - before)
        assert got[step].shift == pytest.approx(shift) and got[step].reversion == pytest.approx(np.linalg.norm(m[p + 3 :].mean(0) - after) / shift)
        squares = (after - before) ** 2
        family, part = ("a", squares[:4]) if step == 8 else ("b", squares[4:])
        assert (got[step].family, got[step].family_shift) == (family, pytest.approx(part.mean()))
        assert got[step].family_share == pytest.approx(part.sum() / squares.sum() / (len(part) / 6))
    assert got[8].reversion < 0.5 < got[13].reversion and got[15].reversion is None
    assert (got[8].event_t, got[8].event_gap) == (790.0, 10.0) and (got[15].event_t, got[15].event_gap) == (1400.0, 100.0)
