"""Queries beyond SQL, held against plain twins over their whole results."""

import struct

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
from runlens.operators import curves as U
from runlens.operators import factors as K
from runlens.operators import multivariate as V
from runlens.plans import catalog
from runlens.sources import documents as J
from runlens.sources.telemetry import Telemetry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def matrices(spark):
    """run: (steps, tags, matrix of steps by tags) of the standardised series."""
    v = Telemetry(spark, SF)
    z = V.cohort(v.fact, v.axis).toPandas()
    out = {}
    for run, part in z.groupby("run"):
        wide = part.pivot(index="step", columns="tag", values="z").sort_index()
        out[run] = list(wide.index), list(wide.columns), wide.to_numpy()
    return out


def rows_of(spark, name):
    return entry.queries()[name](spark, SF).collect()


def test_spectrum(spark, matrices):
    got = rows_of(spark, "mlt05_spectrum")
    for run, (steps, _, m) in matrices.items():
        mine = sorted((x for x in got if x.run == run), key=lambda x: x.k)
        want = np.zeros(len(steps))
        s = np.linalg.svd(m, compute_uv=False) ** 2
        want[: len(s)] = s
        assert [x.eigenvalue for x in mine] == pytest.approx(want.tolist(), abs=1e-6 * s[0])
        assert mine[-1].cumulative == pytest.approx(1)


def test_loadings(spark, matrices):
    got = rows_of(spark, "mlt07_loadings")
    for run, (_, tags, m) in matrices.items():
        values, vectors = np.linalg.eigh(m.T @ m)
        for k in (1, 2, 3):
            mine = np.array([next(x.loading for x in got if (x.run, x.k, x.tag) == (run, k, t)) for t in tags])
            assert mine @ mine == pytest.approx(1)
            assert abs(mine @ vectors[:, -k]) == pytest.approx(1, abs=1e-5) or values[-k] - values[-k - 1] < 1e-6 * values[-1]
            assert mine[np.abs(mine).argmax()] > 0


def test_greedy_basis(spark, matrices):
    got = rows_of(spark, "mlt11_greedy_basis")
    for run, (_, tags, m) in matrices.items():
        picked = [tags.index(x.tag) for x in sorted((x for x in got if x.run == run), key=lambda x: x.rank)]

        def explained(cols):
            fit, *_ = np.linalg.lstsq(m[:, cols], m, rcond=None)
            return 1 - ((m - m[:, cols] @ fit) ** 2).sum() / (m**2).sum()

        for k, x in enumerate(sorted((x for x in got if x.run == run), key=lambda x: x.rank)):
            best = max(explained(picked[:k] + [c]) for c in range(len(tags)) if c not in picked[:k])
            assert x.explained == pytest.approx(explained(picked[: k + 1]), abs=1e-8) and x.explained == pytest.approx(best, abs=1e-8)


def test_average_linkage(spark, matrices):
    got = rows_of(spark, "mlt09_average_linkage")
    for run, (_, tags, m) in matrices.items():
        d = 1 - np.abs(np.corrcoef(m.T))
        groups = [[i] for i in range(len(tags))]
        while len(groups) > 4:
            pairs = [(np.mean([d[i, j] for i in groups[a] for j in groups[b]]), a, b) for a in range(len(groups)) for b in range(a)]
            _, a, b = min(pairs)
            groups[b] += groups.pop(a)
        want = {frozenset(tags[i] for i in g) for g in groups}
        found = {}
        for x in got:
            if x.run == run:
                found.setdefault(x.cluster, set()).add(x.tag)
        assert {frozenset(g) for g in found.values()} == want


def test_change_points_find_a_planted_break(spark):
    r = np.random.default_rng(3)
    rows = [("r", f"t{i}", s, float(r.normal() * 0.1 + (2.0 if s >= 12 else 0.0))) for i in range(6) for s in range(1, 25)]
    z = spark.createDataFrame(rows, "run string, tag string, step int, z double")
    assert sorted(x.step for x in K.change_points(z).collect()) == [1, 12]


def test_saturation_fits_are_least(spark):
    v = Telemetry(spark, SF)
    facts = {}
    for x in v.fact.where("value is not null").collect():
        facts.setdefault((x.run, x.tag), []).append((x.step, x.value))
    got = rows_of(spark, "mlt18_saturation")
    assert {(x.run, x.tag) for x in got} == {k for k, s in facts.items() if len(s) >= 6}
    for x in got[:: max(1, len(got) // 40)]:
        s = np.array(sorted(facts[x.run, x.tag]))
        y = U.MODELS[x.model](s[:, 0], x.a, x.b, x.k)
        assert ((s[:, 1] - y) ** 2).sum() == pytest.approx(x.rss, rel=1e-6, abs=1e-6)
        assert x.rss <= ((s[:, 1] - s[:, 1].mean()) ** 2).sum() * (1 + 1e-9) + 1e-6


def hashed(seed, *parts):
    h = 42
    for p in (seed, *parts):
        h = xxhash.xxh64_intdigest(p.encode() if isinstance(p, str) else struct.pack("<i", p), h)
    signed = h - (1 << 64) if h >> 63 else h
    return signed % (1 << 40) / (1 << 40)


def test_bootstrap_and_sign_flips(spark):
    v = Telemetry(spark, SF)
    boot = {(x.run, x.tag): x for x in rows_of(spark, "tst10_bootstrap")}
    flips = {(x.run, x.tag): x for x in rows_of(spark, "tst13_sign_flip")}
    some = sorted(boot)[::17]
    facts = {}
    for x in v.fact.where("value is not null").collect():
        facts.setdefault((x.run, x.tag), {})[x.step] = x.value
    for key in some:
        values = sorted(facts[key].values())
        means = [np.mean([values[int(hashed(1, *key, b, i) * len(values))] for i in range(1, len(values) + 1)]) for b in range(1, 201)]
        x = boot[key]
        assert (x.low, x.mid, x.high) == pytest.approx(tuple(np.percentile(means, (2.5, 50, 97.5))), rel=1e-9)
        deltas = sorted(v - facts[key][s - 1] for s, v in facts[key].items() if s - 1 in facts[key])
        if key in flips:
            far = sum(abs(np.mean([d if hashed(2, *key, b, i) < 0.5 else -d for i, d in enumerate(deltas)])) >= abs(np.mean(deltas)) - 1e-12 for b in range(1, 401))
            assert flips[key].p == pytest.approx((far + 1) / 401)


def test_permutations_tell_a_trend_from_noise(spark):
    r = np.random.default_rng(8)
    rows = [("r", "trend", s, s + float(r.normal())) for s in range(30)] + [("r", "flat", s, float(r.normal())) for s in range(30)] + [("r", "same", s, 1.0) for s in range(30)]
    table = spark.createDataFrame(rows, "run string, tag string, step int, value double")
    shuffled = {x.tag: x for x in U.shuffle_permutation_p(table, ["run", "tag"]).collect()}
    blocks = {x.tag: x for x in U.block_permutation_p(table, ["run", "tag"]).collect()}
    assert set(shuffled) == {"trend", "flat"} and shuffled["trend"].p < 0.01 < shuffled["flat"].p
    assert blocks["trend"].p < 0.05 < blocks["flat"].p


def test_critical_correlations(spark):
    for x in rows_of(spark, "sta13_critical_r"):
        if x.n == 4:
            assert x.critical == pytest.approx(0.95, abs=1e-6)  # two degrees of freedom: the correlation is uniform
        assert 0 < x.critical < 1


def test_titles(spark):
    got = rows_of(spark, "sca30_verified_titles")
    assert all(x.quoted == (x.item_id % 3 != 0) for x in got) and {x.mismatch for x in got if x.item_id % 3} == {False} and any(x.mismatch for x in got)


def test_json_documents_and_lines(spark, tmp_path):
    schema = "run string, n int"
    assert J.read_json(spark, str(tmp_path / "none"), schema).count() == 0 == J.read_jsonl(spark, str(tmp_path / "none"), schema).count()
    (tmp_path / "a.json").write_text('{\n "run": "x",\n "n": 3}')
    (tmp_path / "b.jsonl").write_text('{"run": "x", "n": 3}\n\n{"run": "y", "n": null}\n')
    assert [tuple(x) for x in J.read_json(spark, str(tmp_path / "a.json"), schema).collect()] == [("x", 3)]
    assert sorted(map(tuple, J.read_jsonl(spark, str(tmp_path / "b.jsonl"), schema).collect())) == [("x", 3), ("y", None)]
    for _ in range(2):
        J.append_jsonl(spark.createDataFrame([("z", 1)], schema), str(tmp_path / "out"))
    assert J.read_jsonl(spark, str(tmp_path / "out"), schema).count() == 2
    for k, bad in enumerate(('{"run": "x", "n"', '{"run": "x", "n": "three"}')):
        (tmp_path / f"bad{k}.jsonl").write_text('{"run": "x", "n": 3}\n' + bad + "\n")
        with pytest.raises(Exception, match="MALFORMED"):
            J.read_jsonl(spark, str(tmp_path / f"bad{k}.jsonl"), schema).collect()
    fact = spark.createDataFrame([("r", "b", 1, 1.5), ("r", "a", 2, None), ("r", "a", 1, float("inf")), ("r", "a", 3, 2.0), ("r", 'c"\\\n', 1, 1.0)], "run string, tag string, step int, value double")
    J.write_metric_lines(fact, str(tmp_path / "lines"))
    assert [x.value for x in spark.read.text(str(tmp_path / "lines" / "run=r")).collect()] == ['{"a":[null,null,2.0]}', '{"b":[1.5]}', '{"c\\"\\\\\\n":[1.0]}']


def test_replaying_twice_changes_nothing(spark):
    from runlens.operators.context import replayed

    r = np.random.default_rng(2)
    rows = [(c, "r", t, s, None if r.random() < 0.4 else float(r.integers(9))) for c in (1, 2, 3, 4) for t in "ab" for s in range(8)]
    caps = spark.createDataFrame(rows, "capture int, run string, tag string, step int, value double")
    again = spark.createDataFrame([("r", 5, 3)], "run string, step int, capture int")
    want = {}
    for c, _, t, s, value in sorted(rows, key=lambda x: x[0]):
        if value is not None and ((t, s) not in want or s == 5 and c >= 3):
            want[t, s] = value
    once = replayed(caps, again)
    assert {(x.tag, x.step): x.value for x in once.collect()} == want
    assert {(x.tag, x.step): x.value for x in replayed(caps.unionByName(caps.withColumn("capture", F.col("capture") + 4)), again).collect() if x.step != 5} == {k: v for k, v in want.items() if k[1] != 5}


def test_every_query_is_registered_once():
    assert not set(catalog.ORACLES) - set(catalog.QUERIES)
