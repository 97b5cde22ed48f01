import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from runlens.llm import line_dedup as lines_module
from runlens.llm.line_dedup import line_dedup, within


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


def points(s):
    return np.frombuffer(s.encode("utf-32-le"), np.uint32)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("ab", max_size=9), st.text("ab", max_size=9)), min_size=1, max_size=6), st.integers(1, 3))
def test_banded_distance(pairs, edits):
    got = within([points(a) for a, _ in pairs], [points(b) for _, b in pairs], edits)
    assert got.tolist() == [distance(a, b) <= edits for a, b in pairs]


def brute(rows, min_chars, longer=()):
    lines = sorted({x for _, t in rows if t is not None for x in t.split("\n")})
    top = {x: x for x in lines}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in lines:
        for b in lines:
            edits = max([1, *(k for n, k in longer if min(len(a), len(b)) >= n)])
            if a < b and min(len(a), len(b)) >= min_chars and abs(len(a) - len(b)) <= edits and a.strip() and b.strip() and distance(a, b) <= edits:
                top[root(b)] = root(a)
    seen, out = set(), set()
    for i, t in sorted(rows):
        kept = []
        for x in [] if t is None else t.split("\n"):
            if not x.strip():
                kept.append(x)
            elif root(x) not in seen:
                seen.add(root(x))
                kept.append(x)
        text = "\n".join(kept)
        n = 0 if t is None else len(t.split("\n"))
        out.add((i, n, n - len(kept), None if t is None else hashlib.sha256(text.encode()).hexdigest()))
    return out


def corpus(seed, n=40):
    r = random.Random(seed)
    base = ["".join(r.choice("abcé ") for _ in range(r.randint(0, 40))) for _ in range(14)] + ["", " ", "\t", "short"]

    def line():
        x = r.choice(base)
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            k = r.randint(0, len(x))
            x = x[:k] + r.choice(["", "z", "é"]) + x[k + r.randint(0, 1) :]
        return x

    rows = [(i * 2 - 9, "\n".join(line() for _ in range(r.randint(1, 6)))) for i in range(n)]
    return rows + [(500, None), (501, ""), (502, rows[3][1])]


def run(spark, rows, **kw):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, found string").repartition(4)
    return {(x.doc_id, x.n_lines, x.n_removed, x.kept_sha256) for x in line_dedup(docs, **kw).collect()}


def test_against_brute_force(spark):
    rows = corpus(1)
    assert run(spark, rows, min_chars=8) == brute(rows, 8)


def test_crowded_segments(spark):
    rows = corpus(2) + [(700 + i, f"the common line number {i} of the page\nthe common line number {i} of the pag") for i in range(14)]
    for crowd in (1, 0):
        assert run(spark, rows, min_chars=8, crowd=crowd) == brute(rows, 8)


def test_repeated_rows_missing_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a line here\nx"), (1, "a line here\nx"), (2, "a line here"), (None, "a line here")], "doc_id long, text string")
    got = sorted((x.doc_id or 0, x.n_removed, x.kept_text) for x in line_dedup(docs).collect())
    assert got == [(0, 0, "a line here"), (1, 0, "a line here\nx"), (1, 0, "a line here\nx"), (2, 1, "")]
    assert line_dedup(docs.limit(0)).count() == 0


def long_lines(seed, n, edits):
    r = random.Random(seed)
    base = ["".join(r.choice("abcde ") for _ in range(r.randint(26, 60))) for _ in range(6)]
    base += [base[0][:20] + "".join(r.choice("xyz") for _ in range(30)) for _ in range(4)]

    def line():
        x = r.choice(base)
        for _ in range(r.randint(0, edits + 1)):
            k = r.randint(0, len(x))
            x = x[:k] + r.choice(["", "z", "é"]) + x[k + r.randint(0, 1) :]
        return x

    return [(i, "\n".join(line() for _ in range(3))) for i in range(n)]


def test_the_threshold_grows_with_the_length(spark):
    for crowd in (64, 1, 0):
        rows, longer = long_lines(3, 22, 3), ((30, 2), (45, 3))
        assert run(spark, rows, min_chars=8, crowd=crowd, longer=longer) == brute(rows, 8, longer)


def test_clashing_names_and_very_long_lines(spark):
    rows = [(1, "x" * 300_000 + "\nshort"), (2, "x" * 299_998 + "yy\nshort"), (3, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("_doc", "_found", "doc", "found", "h1", "a", "component")})
    got = {x.doc_id: x for x in line_dedup(docs).collect()}
    assert (got[1].n_removed, got[2].n_removed, got[3].n_removed) == (0, 2, 1) and got[1].found == 1


def test_lines_that_share_two_crowded_segments_are_compared_by_blocks(spark, monkeypatch):
    """70 lines of one frame, all three or more edits apart but for some, made a row for each pair in different groups."""
    r = random.Random(9)
    frame = "".join(r.choice("abcdefgh") for _ in range(80))
    mark = lambda: "".join(r.choice("mnopqrst") for _ in range(6))
    texts = [frame[:45] + mark() + frame[45:] for _ in range(64)]
    texts += [x[:47] + "zz" + x[49:] for x in texts[:6]]
    rows = [(i, x) for i, x in enumerate(texts)]
    made, write = {}, lines_module.written

    def counted(df, name):
        out = write(df, name)
        if name in ("block_pairs", "groups_apart"):
            made[name] = out.count()
        return out

    monkeypatch.setattr(lines_module, "written", counted)
    assert run(spark, rows, min_chars=8, crowd=1, longer=((30, 2),)) == brute(rows, 8, ((30, 2),))
    assert 0 < made["block_pairs"] < 1000 and "groups_apart" not in made
