import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.llm import mixing
from runlens.llm.mixing import MARGINALS, SHARE, calibrated, expected_shares, mix, rake, tempered


def cells_of(spark):
    r = np.random.default_rng(1)
    rows = [(f"s{i}", j, f"t{k}", int(r.integers(0, 5000))) for i in range(5) for j in ("en", "de", None) for k in range(3)]
    return spark.createDataFrame(rows, "source string, lang string, topic string, tokens long"), rows


def test_raked_weights_meet_all_targets(spark):
    cells, rows = cells_of(spark)
    targets = {m: tempered(cells, m, 0.3) for m in MARGINALS}
    for driver_cells in (10_000, 3):  # on the driver and in Spark
        if driver_cells == 3:
            small = cells.where("source in ('s0', 's1') and topic <> 't2'")
            targets = {m: tempered(small, m, 0.3) for m in MARGINALS}
        else:
            small = cells
        raked = rake(small, targets, driver_cells).cache()
        for m, t in targets.items():
            want = {x.value: x.share for x in t.collect()}
            got = {x[0]: x[1] for x in raked.groupBy(m).agg(F.sum("weight")).collect()}
            assert got == pytest.approx(want, abs=1e-6) and sum(want.values()) == pytest.approx(1)


def off(found, targets):
    return max(abs(x.wanted - x.expected) for x in expected_shares(found, targets).collect())


def test_a_sample_holds_its_targets(spark):
    cells, rows = cells_of(spark)
    total = cells.agg(F.sum("tokens")).first()[0]
    for share, power in ((0.1, 0.5), (0.6, 0.3), (1.0, 1.0)):
        targets = {m: tempered(cells, m, power, share) for m in MARGINALS}
        found = calibrated(cells, targets, share).cache()
        assert off(found, targets) < 2e-3
        kept, most = found.agg(F.sum(F.col("prob") * F.col("tokens")), F.max("prob")).first()
        assert most <= 1 and kept / total <= share * 1.002
        if share == 0.1 or power == 1.0:
            assert kept / total == pytest.approx(share, rel=2e-3)  # nothing binds


def test_spark_rakes_as_the_driver_does(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROUNDS", 4)
    cells, _ = cells_of(spark)
    cells = cells.where("source in ('s0', 's1')")
    targets = {m: tempered(cells, m, 0.3) for m in MARGINALS}
    for share in (None, 0.7):
        (a, x), (b, y) = (mixing._raked(cells, targets, n, share) for n in (10_000, 3))
        assert x == pytest.approx(y, abs=1e-9)
        assert {tuple(r)[:3]: r.weight for r in a.collect()} == pytest.approx({tuple(r)[:3]: r.weight for r in b.collect()}, abs=1e-9)


def test_tempered_targets_ask_for_no_more_than_there_is(spark):
    cells = spark.createDataFrame([("a", 900), ("b", 90), (None, 10)], "source string, tokens long")
    plain = {r.value: r.share for r in tempered(cells, "source", 0.5).collect()}
    assert plain == pytest.approx({k: n**0.5 / (30 + 90**0.5 + 10**0.5) for k, n in (("a", 900), ("b", 90), (None, 10))})
    held = {r.value: r.share for r in tempered(cells, "source", 0.5, 0.5).collect()}
    assert held == pytest.approx({None: 0.02, "b": 0.18, "a": 0.8})
    assert {r.value: r.share for r in tempered(cells, "source", 0.0, 1.0).collect()} == pytest.approx({None: 0.01, "b": 0.09, "a": 0.9})
    assert tempered(cells.limit(0), "source", 0.5, 0.5).count() == 0


def test_scarce_cells_make_the_sample_smaller_and_contradictions_are_told(spark):
    rows = [("a", "en", "x", 900), ("b", "en", "x", 50), ("b", "de", "x", 50)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    share = lambda **by: spark.createDataFrame(sorted(by.items()), "value string, share double")
    targets = {"source": share(a=0.5, b=0.5), "lang": share(en=0.7, de=0.3), "topic": share(x=1.0)}
    found = calibrated(cells, targets, 0.6).cache()
    assert off(found, targets) < 2e-3 and found.agg(F.max("prob")).first()[0] <= 1
    kept = found.agg(F.sum(F.col("prob") * F.col("tokens"))).first()[0]
    assert 0.1 < kept / 1000 <= 0.1667  # de fills 0.3 of the sample with 50 tokens at most
    with pytest.warns(UserWarning, match="contradict"):
        calibrated(cells, {"source": share(a=0.2, b=0.8), "lang": share(en=0.1, de=0.9), "topic": share(x=1.0)}, 0.5)


def test_the_given_documents_are_sampled_at_their_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = mix(docs).cache()
    cells = found.groupBy(*MARGINALS).agg(F.sum("n_tokens").alias("tokens"), F.max("prob").alias("prob")).where("tokens > 0")
    targets = {m: tempered(cells, m, 0.5, SHARE) for m in MARGINALS}
    assert off(cells, targets) < 0.01
    kept, total = cells.agg(F.sum(F.col("prob") * F.col("tokens")), F.sum("tokens")).first()
    assert 0.5 < kept / total <= 0.601


def test_mix_against_a_plain_twin(spark):
    r = np.random.default_rng(5)
    rows = [(i, " ".join(f"{'abcd'[int(r.integers(4))]}word{int(r.integers(50))}" for _ in range(int(r.integers(1, 40)))), ("en", "de", None)[int(r.integers(3))], f"s{int(r.integers(3))}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = mix(docs, share=0.5, power=0.8).collect()
    tokens = {}
    for x in found:
        assert x.n_tokens == len(x.text.split())
        tokens[x.source, x.lang, x.topic] = tokens.get((x.source, x.lang, x.topic), 0) + x.n_tokens
    keys, n = list(tokens), np.array(list(tokens.values()), float)
    want = []
    for m in range(3):
        sums = {v: sum(c for k, c in tokens.items() if k[m] == v) for v in {k[m] for k in keys}}
        powers = {v: s**0.8 for v, s in sums.items()}
        assert all(p / sum(powers.values()) < sums[v] / (0.5 * sum(sums.values())) for v, p in powers.items())
        want.append((m, {v: p / sum(powers.values()) for v, p in powers.items()}))
    free, cap = n / n.sum(), n / (0.5 * n.sum())
    for _ in range(200):
        for m, shares in want:
            now = {v: sum(min(f, c) for f, c, k in zip(free, cap, keys, strict=True) if k[m] == v) for v in shares}
            free = free * np.array([shares[k[m]] / now[k[m]] for k in keys])
    prob = dict(zip(keys, np.minimum(free, cap) * 0.5 * n.sum() / n, strict=True))
    for x in found:
        assert x.prob == pytest.approx(prob[x.source, x.lang, x.topic], abs=1e-6)


def test_sample_of_documents(spark):
    rows = [(i, "word " * (1 + i % 7), ("en", "de")[i % 5 == 0], f"s{i % 3 * (i % 2)}", "x") for i in range(600)]
    rows += [(None, "a b", "en", "s0", "x"), (900, None, "en", "s0", "x"), (901, "", None, None, "x"), (902, "só", None, None, "x"), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, prob string").repartition(4)
    found = mix(docs).collect()
    assert len(found) == len(rows)
    by_id = {x.doc_id: x for x in found}
    assert not by_id[None].kept and not by_id[900].kept and not by_id[901].kept and by_id[902].prob > 0
    assert by_id[900].topic == "empty" and by_id[5].n_tokens == len(rows[5][1].split())
    kept = sum(x.n_tokens for x in found if x.kept) / sum(x.n_tokens for x in found)
    assert 0.3 < kept < 0.7
    assert sorted(x.doc_id for x in mix(docs.repartition(2)).collect() if x.kept) == sorted(x.doc_id for x in found if x.kept)
    assert mix(docs.limit(0)).count() == 0


def test_columns_named_like_the_cells(spark):
    docs = spark.createDataFrame([(i, "some words here " * 5, "en", "s") for i in range(20)], "doc_id long, text string, lang string, source string")
    docs = docs.withColumns({f"cell_{m}": F.lit(1) for m in MARGINALS} | {"prob": F.lit("old")})
    got = mix(docs)
    assert got.columns == ["doc_id", "text", "lang", "source", "cell_source", "cell_lang", "cell_topic", "n_tokens", "topic", "prob", "kept"]
    assert got.where("cell_lang = 1 and prob between 0 and 1").count() == 20
