import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from runlens.llm import topics
from runlens.llm.storage import narrow_batches
from runlens.llm.textbuf import buffer_of
from runlens.llm.topics import learn_topics, word_counts


def test_topics_come_from_all_documents(spark):
    """Rarities are those of all 6,000 texts, whatever their order; a sample of about 2,000 texts gave others."""
    words = [[f"{a}{b}word" for b in "abcdefgh"] for a in ("north", "south", "ocean")]
    rows = [(i, " ".join(words[0 if i % 2 else 1] if i % 100 else words[2]), "en" if i % 3 else None) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = learn_topics(docs, 3)
    counts = word_counts(*buffer_of(pa.array([t for _, t, _ in rows])))[0]
    assert np.allclose(model.rarity, np.log(6001 / (1 + (counts > 0).sum(axis=0))))
    assert np.allclose(np.linalg.norm(model.centers, axis=1), 1) and 1 < len(model.centers) <= 3
    again = learn_topics(docs.repartition(7, F.rand(3)), 3)
    assert (again.centers == model.centers).all()
    assert learn_topics(docs.limit(0)) is None and learn_topics(docs.withColumn("text", F.lit("a b"))) is None


def test_rounds_read_directions_that_are_written_once(spark, monkeypatch):
    """Of the counts, only two passes are made; all rounds read the directions, which are whole numbers of length SCALE."""
    seen, sums = [], topics.totals
    monkeypatch.setattr(topics, "totals", lambda table, f, **kw: (seen.append(table), sums(table, f, **kw))[1])
    lengths = []
    old = topics._far_text
    monkeypatch.setattr(topics, "_far_text", lambda table, centers: (lengths.append(table.collect()), old(table, centers))[1])
    learn_topics(spark.createDataFrame([(i, f"{'alpha' if i % 2 else 'omega'}words text{i}s", "en") for i in range(21)], "doc_id long, text string, lang string"), 2)
    assert [t.columns[-1] for t in seen] == ["counts"] * 2 + ["directions"] * (len(seen) - 2) and len(seen) > 2
    found = np.vstack([np.frombuffer(bytes(r.directions), np.int32).reshape(-1, 256) for r in lengths[0]])
    assert len(found) == 21 and np.allclose(np.linalg.norm(found / topics.SCALE, axis=1), 1, atol=1e-4)


def test_a_pass_holds_few_rows_and_deals_its_sums_to_few_partitions(spark, monkeypatch):
    """A worker turned 2,000 rows of 8 KB into numbers at once, and every task of a pass wrote a file for each of the session's shuffle partitions."""
    plans, frame = [], type(spark.range(0))
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), collect(df))[1])
    wide = spark.range(0, 900, 1, 2).select(F.repeat(F.lit("x"), 8192).alias("directions"))
    sizes = topics.totals(wide, lambda part: [(str(part.num_rows), np.full(257, part.num_rows))])
    assert max(map(int, sizes)) <= topics.PART_BYTES // 8192 and sum(v[0] for v in sizes.values()) == 900
    dealt = [line for line in plans[-1].splitlines() if "Exchange" in line]
    assert len(dealt) == 1 and f", {topics.SUM_PARTITIONS})" in dealt[0]


def test_batches_are_bounded_by_bytes(spark):
    narrow_batches(spark)
    rows = spark.range(0, 40, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))
    sizes = [r.n for r in rows.mapInArrow(lambda it: (b.select([]).append_column("n", __import__("pyarrow").array([b.num_rows] * b.num_rows)) for b in it), "n long").collect()]
    assert len(sizes) == 40 and max(sizes) <= 5
