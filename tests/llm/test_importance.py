import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from runlens.llm.importance import crc32_of, importance_resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def brute(rows, target, longest, buckets, percent, least):
    count = [[0] * buckets, [0] * buckets]
    for side, texts in enumerate(([t for _, t in rows], target)):
        for t in texts:
            for f in features(t, longest)[1]:
                count[side][zlib.crc32(f.encode()) % buckets] += 1
    s, t = count
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    found, may = [], []
    for i, (doc, text) in enumerate(rows):
        n, fs = features(text, longest)
        weight, score = sum(gain[zlib.crc32(f.encode()) % buckets] for f in fs), None
        if doc is not None:
            h = int(hashlib.sha256(f"2024:{doc}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
            if n >= least:
                may.append((-score, doc, len(fs), weight, i))
        found.append([doc, len(fs), weight, score, None])
    for rank, (*_, i) in enumerate(sorted(may)[: percent * len(may) // 100], 1):
        found[i][4] = rank
    return sorted(map(tuple, found), key=repr)


def corpus(seed, n=150):
    r = random.Random(seed)
    vocab = ["Alpha", "beta", "ÄÖ", "straße", "x1", "42", "日本語", "İ", "k" * 300, "gamma", " "]
    rows = [(i * 7 - 30, "".join(r.choice(vocab) + r.choice([" ", "-", "\n", "_", "\x00", "\x7f"]) for _ in range(r.randint(0, 60)))) for i in range(n)]
    rows += [(5000, None), (5001, ""), (5002, "..."), (rows[3][0], rows[3][1]), (rows[4][0], "other words " * 30), (None, "alpha beta " * 20)]
    return rows + [(6000, "Z" * 200_000 + " " + "word " * 5000)], [r.choice(["alpha beta", "x1 x1 gamma", None, "", "ÄÖ"]) for _ in range(20)]


@pytest.mark.parametrize("longest,buckets,percent,least", [(1, 10_000, 10, 20), (3, 97, 35, 1), (2, 5, 100, 0)])
def test_against_brute_force(spark, longest, buckets, percent, least):
    rows, target = corpus(longest)
    docs = spark.createDataFrame([(*x, "clash", 1) for x in rows], "doc_id long, text string, rank string, weight int").repartition(5)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance_resample(docs, aim, longest, buckets, percent, least, with_text=False)
    assert sorted((tuple(x) for x in got.collect()), key=repr) == brute(rows, target, longest, buckets, percent, least)


def test_text_stays_with_its_row(spark):
    rows, target = corpus(9)
    docs, aim = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string")
    got = importance_resample(docs, aim).select("doc_id", "text").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(rows, key=repr)


def test_crc_of_ranges_of_very_unequal_length():
    data = np.random.default_rng(1).integers(0, 256, 100_000, dtype=np.uint8)
    starts = np.array([0, 5, 5, 17, *range(100, 300), 1000])
    ends = np.array([0, 6, 5, 40, *range(101, 301), 100_000])
    assert crc32_of(data, starts, ends).tolist() == [zlib.crc32(data[s:e]) for s, e in zip(starts, ends, strict=True)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "one two " * 12), (2, "three " * 20)], "doc_id long, text string")
    assert importance_resample(none, some).count() == 0
    assert importance_resample(some, none, percent=50).where("rank = 1").count() == 1
