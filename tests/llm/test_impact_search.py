import duckdb
import numpy as np
from pyspark.sql import functions as F

from runlens.llm import impact_search, registry
from runlens.llm.impact_search import ImpactIndex, top_inner_products


def test_one_block_stops_early_and_is_exact():
    r = np.random.default_rng(1)
    vectors = np.floor(256 * r.standard_normal((3000, 32)) / 6).astype(np.int64)
    vectors[1000:1010] = vectors[0] + r.integers(-3, 3, (10, 32))
    ids = r.permutation(3000).astype(np.int64)
    index = ImpactIndex(ids, vectors)
    least = 1 << 60
    for q in (0, 5, 1005):
        scores = vectors @ vectors[q]
        want = sorted((-s, i) for s, i in zip(scores.tolist(), ids.tolist(), strict=True) if i != ids[q])[:5]
        found, got, read = index.search(vectors[q], 5, int(ids[q]))
        assert [(-s, i) for s, i in zip(got.tolist(), found.tolist(), strict=True)] == want
        least = min(least, read)
    assert least < 3000 * 32


def brute(rows, queries, k):
    ok = {i: [int(np.floor(256 * float(x))) for x in v] for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()}
    out = set()
    for q in {i for i, _ in queries if i in ok}:
        scores = sorted((-sum(a * b for a, b in zip(ok[q], v, strict=True)), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))
        out |= {(q, n, i, -s) for n, (s, i) in enumerate(scores[:k], 1)}
    return out


def test_against_brute_force(spark):
    r = np.random.default_rng(2)
    rows = [(i - 7, np.float32(r.integers(-3, 4, 8) / 3).tolist()) for i in range(120)]
    rows += [rows[10], (200, rows[10][1]), (201, None), (202, [float("inf")] * 8), (203, [None] * 8), (204, []), (205, [1.0]), (None, rows[1][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).withColumns({"ids": F.lit("a"), "rank": F.lit(1)})
    got = top_inner_products(table, table.where("vec_id % 5 = 0 or vec_id > 199")).collect()
    assert len(got) == len(set(got)) and {tuple(x) for x in got} == brute(rows, [x for x in rows if x[0] is not None and (x[0] % 5 == 0 or x[0] > 199)], 5)


def test_fewer_than_k_and_empty(spark):
    table = spark.createDataFrame([(1, [1.0]), (2, [0.5]), (3, [-1.0])], "vec_id long, embedding array<float>")
    assert [tuple(x) for x in top_inner_products(table, table.where("vec_id = 1")).orderBy("rank").collect()] == [(1, 1, 2, 32768), (1, 2, 3, -65536)]
    assert top_inner_products(table.limit(0), table.limit(0)).count() == 0


def test_huge_components_rank_exactly(spark):
    rows = [(1, [1e30, 1.0]), (2, [1e30, 0.0]), (3, [1.0, 1.0]), (4, [-1e30, 5.0]), (5, [3.0e38, -3.0e38]), (6, [1e30, 2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = top_inner_products(table, table, 5).collect()
    exact = {i: [int(x * 256) for x in v] for i, v in rows}
    for q in exact:
        want = sorted((-sum(a * b for a, b in zip(exact[q], v, strict=True)), i) for i, v in exact.items() if i != q)
        assert [x.vec_id for x in sorted(got, key=lambda x: x["rank"]) if x.query_id == q] == [i for _, i in want]
    assert {x.score for x in got if x.query_id == 1 and x.vec_id == 2} == {(1 << 63) - 1}


def test_many_blocks(spark, monkeypatch):
    r = np.random.default_rng(6)
    rows = [(i, r.standard_normal(6).astype(np.float32).tolist()) for i in range(300)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(2)
    monkeypatch.setattr(impact_search, "BLOCK", 40)
    monkeypatch.setattr(impact_search, "QUERY_BLOCK", 7)
    got = top_inner_products(table, table.where("vec_id % 4 = 0")).collect()
    assert {tuple(x) for x in got} == brute(rows, [x for x in rows if x[0] % 4 == 0], 5)


def test_query_and_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    want = con.sql(registry.ORACLES["op4_exact_top_k"])
    got = registry.op4_exact_top_k(spark, sf).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
