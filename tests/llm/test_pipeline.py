import corpus_pipeline
from pyspark.sql import functions as F

from runlens.llm.pieces import decode, load_vocabulary
from runlens.llm.registry import PIECES

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_filter(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(corpus_pipeline.COLUMNS)
    odd = spark.createDataFrame([(9001, None, "en", "s", 0), (9002, "", None, None, 0), (9003, "123 456", "en", "s", 7)], docs.schema)
    docs = docs.unionByName(odd)
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF).cache()
        counts.append(docs.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == corpus_pipeline.COLUMNS
            assert docs.join(before, "doc_id", "left_anti").count() == 0
        assert docs.limit(0).count() == 0
    assert counts[0] - counts[1] >= 3 and counts == sorted(counts, reverse=True) and counts[4] < counts[2] and counts[5] == counts[4]
    back = decode(docs, load_vocabulary(PIECES)).join(before.select("doc_id", "text"), "doc_id")
    assert back.where(F.col("decoded") == F.col("text")).count() == counts[5]


def test_clean_documents_stay_in_the_language_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.keep_known_languages(spark, docs, SF)
    assert kept.count() > 0.95 * docs.count()


def test_run(spark):
    found = corpus_pipeline.run(spark, SF)
    assert "ids" in found.columns and 0 < found.count() < 200
