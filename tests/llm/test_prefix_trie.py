import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from runlens.llm.prefix_trie import conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows, splice):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(ts)] for c, ts in own.items()}
    if not splice:
        return own
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + ts[h:]
    return out


def brute(rows, splice):
    convs = rebuilt(rows, splice)
    members, kids = defaultdict(list), defaultdict(set)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            key = tuple(convs[c][:d])
            members[key].append(c)
            if d:
                kids[key[:-1]].add(key)
    leaves, saved = {}, {}
    for key in sorted(members, key=len, reverse=True):
        leaves[key] = sum(leaves[k] for k in kids[key]) or 1
        saved[key] = (len(members[key]) - 1) * (len(key[-1][1].encode()) if key else 0) + sum(saved[k] for k in kids[key])
    out = []
    for key, cs in members.items():
        ends = ",".join(str(c) for c in cs if len(convs[c]) == len(key))
        parent = members[key[:-1]][0] if key else None
        out.append((cs[0], len(key), parent, len(cs), len(kids[key]), leaves[key], saved[key], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def check(spark, rows, splice, extra=False):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    if extra:
        df = df.selectExpr("*", "1 as depth", "'x' as node", "2 as pos", "3 as digest")
    got = [tuple(r) for r in conversation_trie(df, splice).select(COLUMNS).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows, splice), key=repr)


def corpus(seed):
    r = random.Random(seed)
    rows = []
    for c in range(-12, 90):
        same = c % 3 == 0  # a third of all conversations are equal
        for t in range(6 if same else r.randint(1, 7)):
            rows.append((c, t if r.random() < 0.95 or same else None, r.choice(["user", None, ""]) if not same else "user", f"hot {t}" if same else r.choice(["a", "ü", "", None, "a long text"])))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("splice", [True, False])
def test_against_brute_force(spark, splice):
    check(spark, corpus(1), splice)


def test_odd_rows(spark):
    rows = [(None, 1, "user", "x"), (7, None, None, None), (7, 1, "u", "y" * 300_000), (7, 1, "u", "y" * 300_000), (7, 1, "a", "b"), (8, 2, "", ""), (9, 2, None, ""), (10, 5, "ab", "c"), (11, 5, "a", "bc")]
    check(spark, rows, False, extra=True)
    check(spark, rows, True)


def test_one_conversation_and_no_rows(spark):
    check(spark, [(3, 1, "user", "x"), (3, 2, "bot", "y")], False)
    assert conversation_trie(spark.createDataFrame([], SCHEMA), True).count() == 0
    assert conversation_trie(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)).count() == 0
