import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.llm.lattice_dedup import TABLES, _minimal_vectors, decode_e8, embedding_dedup, lattice_cells, lattice_links
from runlens.llm.links import components


def test_decoder_finds_the_nearest_point():
    x = np.random.default_rng(1).uniform(-2, 2, (300, 8))
    near = decode_e8(x)
    whole = np.all(near == np.rint(near), axis=1) & (near.sum(axis=1) % 2 == 0)
    half = np.all(near * 2 % 2 == 1, axis=1) & (near.sum(axis=1) % 2 == 0)
    assert np.all(whole | half)
    steps = _minimal_vectors()
    assert len(steps) == 240 and np.allclose((steps**2).sum(axis=1), 2)
    gap = ((x - near) ** 2).sum(axis=1)
    around = ((x[:, None, :] - near[:, None, :] - steps[None]) ** 2).sum(axis=2).min(axis=1)
    assert np.all(gap <= around + 1e-12) and gap.max() <= 1 + 1e-12


def test_recall_at_the_threshold():
    r = np.random.default_rng(2)
    x = r.standard_normal((1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = r.standard_normal((1500, 64))
    y -= (y * x).sum(axis=1, keepdims=True) * x
    y = 0.9 * x + np.sqrt(1 - 0.81) * y / np.linalg.norm(y, axis=1, keepdims=True)
    met = np.zeros(1500, bool)
    for t in range(TABLES):
        a, b = lattice_cells(x, t), lattice_cells(y, t)
        met |= (a[:, :1] == b).any(axis=1) | (a == b[:, :1]).any(axis=1)
    assert met.mean() > 0.99


def brute(rows):
    ok = {i: np.array(v, np.float64) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    unit = {i: v / np.linalg.norm(v) for i, v in ok.items()}
    links = {i: {j for j in unit if j != i and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= 0.9} for i in unit}
    out = set()
    for i, _ in rows:
        if i is None:
            out.add((None, 0, None, None))
            continue
        reach, todo = {i}, [i]
        while todo:
            new = links.get(todo.pop(), set()) - reach
            reach |= new
            todo += new
        out.add((i, len(links.get(i, ())), min(reach), i == min(reach)))
    return out


def test_against_brute_force(spark):
    r = np.random.default_rng(3)
    base = r.standard_normal((12, 16))
    rows = []
    for i in range(90):
        v = base[r.integers(12)] + r.standard_normal(16) * r.choice([0.0, 0.1, 0.25])
        rows.append((i * 2 + 1, np.float32(v * r.uniform(0.01, 5)).tolist()))
    rows += [(500 + k, rows[k][1]) for k in range(6)] + [rows[3], (600, None), (601, []), (602, [0.0] * 16), (603, [float("nan")] * 16), (604, [None, *[1.0] * 15]), (605, [1.0, 2.0]), (None, rows[0][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).withColumns({"sig": F.lit(1), "n": F.lit(2)})
    got = embedding_dedup(table).collect()
    assert len(got) == len(rows) and {tuple(x) for x in got} == brute(rows)
    assert embedding_dedup(table.limit(0)).count() == 0


def test_crowded_cells_in_blocks(spark):
    """Whatever the size from which cells are multiplied in blocks, and whatever the blocks, links count once."""
    r = np.random.default_rng(5)
    base = r.standard_normal((3, 16))
    rows = [(i, np.float32(base[i % 3] + r.standard_normal(16) * r.choice([0.02, 0.15, 0.3])).tolist()) for i in range(150)]
    rows += [(1000 + i, rows[i][1]) for i in range(0, 60, 7)]
    vectors = spark.createDataFrame([(i, v, 1 + i % 3) for i, v in rows[:150]], "rep long, embedding array<float>, copies long").repartition(3)
    found = set()
    for pairs, block in ((10**9, 1024), (0, 1024), (0, 7), (300, 16)):
        links = lattice_links(vectors, pairs=pairs, block=block)
        degree = {x["a"]: x["n"] for x in links.groupBy("a").agg(F.sum("others").alias("n")).collect()}
        reach = {x["node"]: x["component"] for x in components(links.select("a", "b")).collect()}
        found.add((tuple(sorted(degree.items())), tuple(sorted(reach.items()))))
    assert len(found) == 1
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert {tuple(x) for x in embedding_dedup(table).collect()} == brute(rows)


def test_a_hot_group_makes_no_row_per_pair(spark):
    r = np.random.default_rng(6)
    base = r.standard_normal(32)
    rows = [(i, np.float32(base + r.standard_normal(32) * 0.02).tolist(), 1) for i in range(700)]
    links = lattice_links(spark.createDataFrame(rows, "rep long, embedding array<float>, copies long"))
    assert links.agg(F.sum("others")).first()[0] == 700 * 699
    assert links.count() < 700 * 60


@pytest.mark.parametrize("kind", ["float", "double", "int"])
def test_components_of_any_numeric_type(spark, kind):
    r = np.random.default_rng(7)
    base = r.integers(-9, 10, (30, 16))
    rows = [(i, [int(x) for x in base[i % 20]]) for i in range(30)] + [(40, None), (41, [0] * 16)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<int>").withColumn("embedding", F.col("embedding").cast(f"array<{kind}>"))
    got = {x.vec_id: (x.n_links, x.component_id) for x in embedding_dedup(table).collect()}
    assert got == {i: (int(i < 10 or i >= 20), i % 20) for i in range(30)} | {40: (0, 40), 41: (0, 41)}

