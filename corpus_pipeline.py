"""The corpus pipeline: language ID, line and near-duplicate removal, mixing and tokenizing, each on what is left.

Every stage takes (spark, docs, sf_dir) and returns rows with the columns of documents, which are written as Parquet
and read again as the next stage's docs; the last returns piece ids in place of texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm import language_id
from runlens.llm.line_dedup import line_dedup
from runlens.llm.mixing import mix
from runlens.llm.pieces import encode, load_vocabulary
from runlens.llm.registry import PIECES
from runlens.llm.shingle_join import shingle_groups
from runlens.llm.storage import narrow_batches, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without text or letters, and those whose best language is less certain than least_score asks."""
    narrow_batches(spark)
    model, languages = language_id.fit(docs)
    found = written(language_id.identify_language(docs.select(COLUMNS), model, languages), "languages")
    known = found.where(F.col("lang_pred") != language_id.UNDETERMINED)
    return known.where(F.col("score") >= language_id.least_score(known, len(languages))).select(COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that an earlier line repeats but for one edit, and documents of which nothing is left."""
    narrow_batches(spark)
    found = line_dedup(docs.select(COLUMNS))
    emptied = (F.col("n_removed") > 0) & ~F.col("kept_text").rlike(r"[^\x20\x09-\x0D]")
    return found.where(~F.coalesce(emptied, F.lit(False))).select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest doc_id of each group that shares four fifths of its five-word shingles, and documents without doc_id."""
    narrow_batches(spark)
    others = shingle_groups(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.select(COLUMNS).join(others, "doc_id", "left_anti").select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents so that tokens by source, language and topic meet tempered shares."""
    narrow_batches(spark)
    return mix(docs.select(COLUMNS)).where("kept").select(COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts as piece ids: doc_id, lang, source, n_chars, ids."""
    narrow_batches(spark)
    return encode(docs.select(COLUMNS), load_vocabulary(PIECES))


STAGES = [
    ("language ID", keep_known_languages),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: Trained networks, sampling hashes and XXH64 are beyond SQL; tests of the operators compare them with brute-force versions, not the whole run.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline_{k}")
    return docs
