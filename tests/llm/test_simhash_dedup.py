import random
import re

import xxhash
from pyspark.sql import functions as F

from runlens.llm import simhash_dedup
from runlens.llm.links import components
from runlens.llm.simhash_dedup import fingerprint, fingerprint_links, simhash_groups


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    parent = {n: n for n in nodes}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {n: top(n) for n in nodes}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprint():
    for t in ("", "Ä b", "One two THREE", "a b c d\te\x0bf\x85g  h", "x " * 500, None):
        assert int.from_bytes(fingerprint((t or "").encode()), "big") == brute_fingerprint(t)


def test_groups_of_documents(spark):
    r = random.Random(4)
    base = [" ".join(r.choice("abcdefgh") * r.randint(1, 3) for _ in range(r.randint(30, 300))) for _ in range(12)]
    rows = [(i, r.choice(base) + r.choice(["", "", " z", " end here"])) for i in range(80)]
    rows += [(100, None), (101, ""), (99, " \n"), (102, rows[0][1].upper()), (5, rows[5][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("fp", F.lit("x"))
    fps = {i: brute_fingerprint(t) for i, t in rows}
    want = brute_components(sorted(fps), lambda a, b: bin(fps[a] ^ fps[b]).count("1") <= 2)
    got = simhash_groups(docs).collect()
    assert len(got) == len(rows)
    assert all(x.fp == signed(fps[x.doc_id]) and x.component_id == want[x.doc_id] for x in got)


def fingerprints(seed, n):
    r = random.Random(seed)
    out = {r.getrandbits(64) for _ in range(n)}
    while len(out) < 4 * n:
        x = r.choice(sorted(out)[: 3 * n])
        for _ in range(r.randint(1, 4)):
            x ^= 1 << r.randrange(64)
        out.add(x)
    return sorted(out)


def test_links_connect_all_pairs(spark):
    fps = fingerprints(7, 60)
    classes = spark.createDataFrame([(signed(f), i) for i, f in enumerate(fps)], "fp long, rep long")
    want = brute_components(range(len(fps)), lambda a, b: bin(fps[a] ^ fps[b]).count("1") <= 2)
    for crowd in (simhash_dedup.CROWD, 1):
        links = fingerprint_links(classes, crowd=crowd)
        assert all(1 <= bin(fps[x.a] ^ fps[x.b]).count("1") <= 2 for x in links.collect())
        found = {x.node: x.component for x in components(links).collect()}
        assert {i: found.get(i, i) for i in range(len(fps))} == want


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 130)] + [(7, 7), (200, 201), (201, 200)]
    found = {x.node: x.component for x in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(1, 41)} | {x: 100 for x in range(101, 130)} | {201: 200}


def test_missing_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b c"), (3, "a b c")], "doc_id long, text string")
    assert {(x.doc_id, x.component_id) for x in simhash_groups(docs).collect()} == {(None, None), (3, 3)}
    assert simhash_groups(docs.limit(0)).count() == 0
