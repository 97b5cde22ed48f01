import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.llm import language_id, quality_rank
from runlens.llm.language_id import ByteGRU, document_probabilities, fit, identify_language
from runlens.llm.textbuf import buffer_of

SF = "/root/testdata/sf0.01"


def test_gradients_are_those_of_the_loss():
    r = np.random.default_rng(1)
    model = ByteGRU(3, hidden=4, seed=2)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    words, labels = r.integers(97, 101, (6, 5)).astype(np.uint8), r.integers(0, 3, 6)
    _, grads = model.gradients(words, labels)
    for name, g in grads.items():
        flat = model.weights[name].reshape(-1)
        for k in np.argsort(-np.abs(g.reshape(-1)))[:4]:
            old, step = flat[k], 1e-2
            flat[k] = old + step
            up = model.gradients(words, labels)[0]
            flat[k] = old - step
            down = model.gradients(words, labels)[0]
            flat[k] = old
            assert abs((up - down) / (2 * step) - g.reshape(-1)[k]) < 2e-3


def sequences(text):
    """Six words each from the first's start to the last's end, in parts of 64 bytes that begin at a character."""
    words, out = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", text)], []
    for k in range(0, len(words), 6):
        whole = text[words[k][0] : words[min(k + 6, len(words)) - 1][1]]
        cuts = [0]
        for at in range(64, len(whole), 64):
            while at < len(whole) and whole[at] & 0xC0 == 0x80:
                at -= 1
            cuts.append(at)
        out += [whole[a:b] for a, b in zip(cuts, [*cuts[1:], len(whole)], strict=True)]
    return out


def test_state_crosses_words():
    model = ByteGRU(3, seed=4)
    import pyarrow as pa

    one, other = document_probabilities(model, *buffer_of(pa.array(["ab cd ef", "ef cd ab"])))
    assert not np.allclose(one, other, atol=1e-6)


def test_pooling_counts_every_position():
    import pyarrow as pa

    model = ByteGRU(3, seed=4)
    texts = ["ab cde ab", "", None, "x" * 60 + " ab", "ä\x85ö", "ab " * 30, "aö€" * 80 + " b", "日本語" * 50]
    got = document_probabilities(model, *buffer_of(pa.array(texts)))
    for text, row in zip(texts, got, strict=True):
        parts = sequences((text or "").encode())
        each = [p for w in parts for p in model.forward(np.frombuffer(w, np.uint8)[None])[0][:, 0]]
        assert np.allclose(row, np.mean(each, axis=0) if each else 0, atol=1e-5)


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model, languages = fit(docs.where(language_id.fold("doc_id", 4) != 2), 100)
    found = identify_language(docs.where(language_id.fold("doc_id", 4) == 2), model, languages)
    assert languages == ["de", "en", "es", "fr"]
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97


def test_texts_without_letters(spark):
    rows = [(1, None), (2, ""), (3, " 123 !?"), (4, "abc def")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("old"))
    got = {x.doc_id: (x.lang_pred, x.score > 0) for x in identify_language(docs, ByteGRU(2), ["aa", "bb"]).collect()}
    assert {k: got[k] for k in (1, 2, 3)} == {1: ("und", False), 2: ("und", False), 3: ("und", False)} and got[4][0] in ("aa", "bb")
    empty = docs.limit(0).withColumn("lang", F.lit("x"))
    assert fit(empty) == (None, []) and identify_language(docs, None, []).where("lang_pred = 'und' and score = 0").count() == 4


def test_quality_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    ranker = quality_rank.fit(docs, labels.where(language_id.fold("doc_id", 5) != 0))
    found = quality_rank.score_quality(docs, ranker).join(labels.where(language_id.fold("doc_id", 5) == 0), "doc_id")
    right = found.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0]
    assert right > 0.93
    assert found.where("score not between 0 and 1").count() == 0


def test_scores_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a" * 300_000), (None, "x y"), (3, "b")], "doc_id long, text string")
    labels = spark.createDataFrame([(3, 1), (1, 0), (9, 1), (None, 0), (2, 5), (2, None)], "doc_id long, quality int")
    got = quality_rank.score_quality(docs, quality_rank.fit(docs, labels)).collect()
    assert len(got) == 5 and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.3) for x in got)
    for some in (labels.limit(0), labels.where("quality = 1"), labels.where("doc_id = 9")):
        assert quality_rank.score_quality(docs, quality_rank.fit(docs, some)).where("score between 0 and 1").count() == 5
    assert quality_rank.score_quality(docs.limit(0), None).count() == 0


def test_pairs_order_the_labels():
    r = np.random.default_rng(5)
    x = r.standard_normal((400, 5))
    y = (x[:, 2] + 0.1 * r.standard_normal(400) > -0.8).astype(int)
    ranker = quality_rank.train(x, y, (y == 0).mean())
    assert ((ranker.score(x) >= 0.3) == y).mean() > 0.95
    assert ranker.score(x) == pytest.approx(1 / (1 + np.exp(-(ranker.strength(x) - ranker.threshold + np.log(0.3 / 0.7)))))
    random.seed(0)


def test_every_labelled_document_is_learned_from(spark):
    """5,000 documents: means and the threshold are those of all, not of about 2,000 of each label."""
    rows = [(i, ("good plain words. " if i % 5 else "$$ !! ## ") * (1 + i % 37), int(i % 5 > 0)) for i in range(5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    ranker = quality_rank.fit(docs, docs.select("doc_id", "quality"))
    x = quality_rank.text_features(*buffer_of(__import__("pyarrow").array([t for _, t, _ in rows])))[0]
    assert np.allclose(ranker.mean, x.mean(axis=0), atol=1e-4)
    s = np.sort(ranker.strength(x))
    assert ranker.threshold == pytest.approx((s[999] + s[1000]) / 2, abs=1e-6)
