import random

import duckdb
from pyspark.sql import functions as F

from runlens.llm import registry
from runlens.llm.url_filter import BloomCascade, Rule, url_filter

RULES = [Rule("block", "com", "/a"), Rule("allow", "x.com", "/a/b"), Rule("block", "net", "/")]


def keys(spark, values):
    return spark.createDataFrame([(v,) for v in values], "key string")


def test_cascade_is_exact(spark):
    r = random.Random(1)
    universe = [f"k{i}" for i in range(3000)]
    for share, bits in ((0.3, 1 << 23), (0.001, 1 << 23), (0.4, 2048)):
        listed = {k for k in universe if r.random() < share} | {"k1"}
        cascade = BloomCascade(keys(spark, [*universe, None]), keys(spark, sorted(listed)), bits)
        assert cascade.segments == (1 if bits > 4096 else -(-len(listed) * 8 // bits))
        got = cascade.mark(keys(spark, [*universe, None]), F.col("key")).collect()
        assert {x.key for x in got if x.listed} == listed and len(got) == 3001


def test_nothing_listed_and_everything_listed(spark):
    some = keys(spark, ["a", "b", "b"])
    assert [x.listed for x in BloomCascade(some, some.limit(0)).mark(some, F.col("key")).collect()] == [False] * 3
    assert [x.listed for x in BloomCascade(some, some).mark(some, F.col("key")).collect()] == [True] * 3


def test_urls(spark):
    rows = [
        (1, "http://X.com/a?q=1", "x.com", "/a", "com/a", "block"),
        (2, "http://m.x.com/a/bc#z", "m.x.com", "/a/bc", "x.com/a/b", "allow"),
        (3, "https://yx.com/a/b", "yx.com", "/a/b", "com/a", "block"),
        (4, "ftp://net?/", "net", "", None, "allow"),
        (5, "http://net/", "net", "/", "net/", "block"),
        (6, None, "", "", None, "allow"),
        (7, "no scheme.com/a", "", "", None, "allow"),
        (8, "http://É.COM/A", "É.com", "/A", None, "allow"),
        (9, "a://b://c.com/a", "b:", "//c.com/a", None, "allow"),
        (9, "a://bad.org/x", "bad.org", "/x", None, "block"),
        (None, "", "", "", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u, *_ in rows], "page_id long, url string, host string, rule string")
    got = url_filter(pages, RULES, keys(spark, ["bad.org/x"])).drop("listed").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((i, *rest)) for i, _, *rest in rows)
    assert url_filter(pages.limit(0), RULES).count() == 0


def test_the_verdict_is_the_cascades(spark, monkeypatch):
    """A cascade whose levels let everything pass turns the verdicts over: nothing beside it decides."""
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(["http://a.com/a", "http://b.net/", "http://c.org/", "http://x.com/a/b"])], "page_id long, url string")
    listed = keys(spark, ["c.org/", "x.com/a/b"])
    got = {x.page_id: (x.verdict, x.rule) for x in url_filter(pages, RULES, listed).collect()}
    assert got == {0: ("block", "com/a"), 1: ("block", "net/"), 2: ("block", None), 3: ("allow", "x.com/a/b")}
    monkeypatch.setattr(BloomCascade, "mark", lambda self, rows, key, name="listed": rows.withColumn(name, F.lit(False)))
    assert {x.verdict for x in url_filter(pages, RULES, listed).collect()} == {"allow"}


def test_query_and_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{sf}/pages.parquet'")
    want = con.sql(registry.ORACLES["op10_url_filters"])
    got = registry.op10_url_filters(spark, sf).select(*want.columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want.fetchall(), key=str)
