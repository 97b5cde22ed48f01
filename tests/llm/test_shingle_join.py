import random

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.llm import shingle_join
from runlens.llm.shingle_join import shingle_groups, sketch, sketches_apart
from runlens.llm.storage import written


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    top = {i: i for i in sets}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for a in sets:
        for b in sets:
            x, y = sets[a], sets[b]
            if a < b and (x == y or 5 * len(x & y) >= 4 * len(x | y)):
                low, high = sorted((root(a), root(b)))
                top[high] = low
    return {i: root(i) for i in sets}


def corpus(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    base = [[r.choice(words) for _ in range(r.choice([3, 12, 40, 200]))] for _ in range(12)]

    def near(text):
        text = list(text)
        for _ in range(r.randint(0, max(1, len(text) // 30))):
            text[r.randrange(len(text))] = r.choice(words)
        return " ".join(text)

    rows = [(i, near(r.choice(base))) for i in range(120)]
    opening = " ".join(r.choice(words) for _ in range(60))
    rows += [(200 + i, f"{opening} " + " ".join(r.choice(words) for _ in range(30))) for i in range(10)]
    rows += [(300, None), (301, ""), (302, rows[0][1].upper())]
    return r.sample(rows, len(rows))


@pytest.mark.parametrize("crowd", [64, 1])
def test_groups_are_those_of_all_pairs(spark, crowd):
    rows = corpus(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x.doc_id: x.component_id for x in shingle_groups(docs, crowd=crowd).collect()}
    assert got == brute(rows)


def test_planted_near_copies_leave_the_pipeline(spark):
    r = random.Random(8)
    words = [f"w{i}" for i in range(2000)]
    rows = []
    for k in range(20):
        text = [r.choice(words) for _ in range(200)]
        rows.append((2 * k, " ".join(text)))
        for at in r.sample(range(10, 190, 10), 3):
            text[at] = "changed"
        rows.append((2 * k + 1, " ".join(text)))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {x.doc_id for x in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert kept == {2 * k for k in range(20)}
    assert corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), "").count() == 0


def test_sketches_bound_what_only_one_set_has():
    """Never more bits than members that only one set has, whatever the sizes; far fewer sets are read than pairs meet."""
    rng = np.random.default_rng(5)
    for size, other, shared in [(0, 0, 0), (0, 3, 0), (5, 4, 4), (460, 460, 306), (460, 380, 373), (3000, 700, 650)]:
        members = np.unique(rng.integers(-(1 << 63), 1 << 63, size + other - shared))
        x, y = members[:size], members[size - shared :]
        apart = sketches_apart(sketch(x), sketch(y))
        assert apart == sketches_apart(sketch(y), sketch(x)) <= size + other - 2 * shared and sketches_apart(sketch(x), sketch(x)) == 0
        if (size, shared) == (460, 306):  # a similarity of one half: their sets need not be compared
            assert apart * 180 > 20 * (size + other)


def test_far_pairs_with_common_hashes_are_given_up_by_their_sketches(spark, monkeypatch):
    rng = np.random.default_rng(6)
    common = [f"c{i}" for i in range(150)]
    docs = [(k, " ".join([*common, *(f"w{x}" for x in rng.integers(0, 10**9, 60))])) for k in range(8)]
    docs += [(100, docs[0][1] + " x"), (100, docs[0][1] + " x")]
    left = []
    monkeypatch.setattr(shingle_join, "written", lambda df, name: (left.append(df.count()) if name == "set_pairs_left" else None, written(df, name))[1])
    found = shingle_join.shingle_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(map(tuple, found)) == [(k, k) for k in range(8)] + [(100, 0), (100, 0)]
    assert sum(left) <= 2


@pytest.mark.parametrize("spare", [0, 24])
def test_common_passages_make_few_pairs(spark, monkeypatch, spare):
    """Texts that share a long passage meet by what few of them have; the groups are those of all pairs."""
    r = random.Random(4)
    words = [f"w{i}" for i in range(5000)]
    passage = [r.choice(words) for _ in range(120)]
    rows = [(k, " ".join([*passage, *(r.choice(words) for _ in range(60))])) for k in range(60)]
    rows += [(100 + k, "x " + rows[k][1]) for k in range(0, 60, 7)]
    rows += [(200 + k, " ".join(passage[: 100 + k])) for k in range(0, 20, 4)]
    rare, pairs = shingle_join._rare_keys, []

    def met(rows):
        return rows.alias("x").join(rows.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.rep") < F.col("y.rep"))).count()

    def counted(keys, *args):
        parts = rare(keys, *args)
        pairs.extend([met(keys), met(parts)])
        return parts

    monkeypatch.setattr(shingle_join, "SPARE", spare)
    monkeypatch.setattr(shingle_join, "ORDERS", 8)
    monkeypatch.setattr(shingle_join, "_rare_keys", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {x.doc_id: x.component_id for x in shingle_groups(docs).collect()} == brute(rows)
    assert pairs[1] < pairs[0] / 10
