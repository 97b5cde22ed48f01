import hashlib
import random
import re

from runlens.llm.substring_dedup import substring_dedup


def brute(rows, window):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    first = {}
    for i, w in sorted(words.items()):
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    out = set()
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.add((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def corpus(seed, n=60):
    r = random.Random(seed)
    vocab = [f"w{i}é" for i in range(40)] + [" x", "a\x85b"]
    passages = [[r.choice(vocab) for _ in range(r.randint(5, 60))] for _ in range(6)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(r.randint(0, 5)):
            words += r.choice(passages) if r.random() < 0.6 else [r.choice(vocab) for _ in range(r.randint(1, 30))]
            if r.random() < 0.2:
                words += [r.choice(vocab)] * r.randint(5, 40)
        rows.append((i * 3 - 20, r.choice([" ", "\n", "\t "]).join(words)))
    rows += [(900, None), (901, ""), (902, rows[5][1]), (-99, rows[8][1])]
    return rows


def check(spark, rows, window, anchor):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {tuple(x)[:4] for x in substring_dedup(docs, window, anchor).collect()}
    assert got == brute(rows, window)


def test_against_brute_force(spark):
    check(spark, corpus(1), 12, 4)
    check(spark, corpus(2), 20, 5)


def test_production_window(spark):
    check(spark, corpus(3, 150), 50, 10)


def test_repeated_rows_missing_ids_and_clashing_columns(spark):
    text = " ".join(f"t{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text, 1), (1, text, 2), (2, text, 3), (None, text, 4)], "doc_id long, text string, spans int")
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substring_dedup(docs, 10, 3).collect())
    assert got == [(0, 30, 0), (1, 30, 0), (1, 30, 0), (2, 30, 30)]


def test_empty_table(spark):
    assert substring_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
