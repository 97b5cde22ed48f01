import os

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from runlens.llm import registry
from runlens.llm import pieces
from runlens.llm.pieces import SPACE, Met, Vocabulary, decode, decode_buffer, encode, encode_and_decode, encode_buffer, encode_text, load_vocabulary
from runlens.llm.textbuf import buffer_of

PATH = "/opt/tokenizers/piece_bpe_32k.model"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no public tokenizer here")
TEXTS = ["", "a", " a  b ", "Hello world.\nNext line\t x", "héllo ▁ wörld", "日本語 テキスト 🎉", "a" * 200, "     ", "The quick brown fox jumps over the lazy dog, again and again."]


@pytest.fixture(scope="module")
def vocabulary():
    return load_vocabulary(PATH)


def ids_of(vocabulary, texts):
    ids, counts = encode_buffer(vocabulary, *buffer_of(pa.array(texts)))
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


def brute(vocabulary, text):
    """The best segmentation of the whole text by a search character by character."""
    score, ids = dict(zip(vocabulary.texts, vocabulary.scores, strict=True)), dict(zip(vocabulary.texts, vocabulary.ids, strict=True))
    s = (" " + text if text else "").replace(chr(SPACE), "\0").replace(" ", chr(SPACE))
    best = [(0.0, 0, None)] + [(-np.inf, 0, None)] * len(s)
    for e in range(1, len(s) + 1):
        for b in range(max(0, e - vocabulary.longest), e):
            piece = s[b:e]
            if piece in score and best[b][0] + score[piece] > best[e][0]:
                best[e] = (best[b][0] + score[piece], b, piece)
        if s[e - 1] not in score and best[e - 1][0] + vocabulary.unknown > best[e][0]:
            best[e] = (best[e - 1][0] + vocabulary.unknown, e - 1, None)
    out, e = [], len(s)
    while e:
        _, b, piece = best[e]
        out.append([ids[piece]] if piece else [vocabulary.byte_ids[x] for x in s[b:e].replace("\0", chr(SPACE)).encode()])
        e = b
    return [i for x in reversed(out) for i in x]


def test_against_brute_force(vocabulary):
    assert ids_of(vocabulary, TEXTS) == [brute(vocabulary, t) for t in TEXTS]


def test_against_the_library(vocabulary):
    """The model's pieces as a unigram model: the library's own search finds no better segmentation, and decodes ours."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(open(PATH, "rb").read())
    proto.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    model = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    worst = dict.fromkeys(vocabulary.byte_ids, vocabulary.unknown) | dict(zip(vocabulary.ids, vocabulary.scores, strict=True))
    texts = [t for t in TEXTS if chr(SPACE) not in t]
    same = 0
    for text, ids in zip(texts, ids_of(vocabulary, texts), strict=True):
        theirs = model.encode(text)
        same += ids == theirs
        assert sum(worst[i] for i in ids) >= sum(worst[i] for i in theirs)
        assert model.decode(ids) == text
    assert same >= len(texts) - 1


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), min_size=1, max_size=5))
def test_round_trip(vocabulary, texts):
    data, offsets = buffer_of(pa.array(texts))
    back, at = decode_buffer(vocabulary, *encode_buffer(vocabulary, data, offsets))
    assert back.tobytes() == data.tobytes() and at.tolist() == offsets.tolist()


def test_tables(spark, vocabulary):
    rows = [(i, t) for i, t in enumerate([*TEXTS, None, TEXTS[3], "long text " * 20_000])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit(1), "decoded": F.lit(2)})
    found = {x.doc_id: x for x in decode(encode(docs, vocabulary), vocabulary).collect()}
    assert {i: x.decoded for i, x in found.items()} == dict(rows)
    assert found[0].ids == [] and found[len(TEXTS)].ids is None
    assert decode(encode(docs.limit(0), vocabulary), vocabulary).count() == 0


def test_vocabularies_that_cannot_be_cut():
    with pytest.raises(ValueError):
        Vocabulary([0], [f"a{chr(SPACE)}b"], [0.0], list(range(1, 257)))
    with pytest.raises(ValueError):
        Vocabulary([0], ["a"], [0.0], [])


def test_long_texts_in_slices(vocabulary):
    text = ("some words,  and   gaps of spaces \u2581 and 日本語 " * 40)[3:]
    data = np.frombuffer(text.encode(), np.uint8)
    whole = ids_of(vocabulary, [text])[0]
    for most in (1, 7, 100, 4096):
        assert encode_text(vocabulary, data, most).tolist() == whole
    spaceless = np.frombuffer(b"x" * 500, np.uint8)
    assert encode_text(vocabulary, spaceless, 50).tolist() == ids_of(vocabulary, ["x" * 500])[0]


def test_one_pass_is_encode_then_decode(spark, vocabulary):
    rows = [(i, t) for i, t in enumerate([*TEXTS, None, TEXTS[3], "many words here " * 1_300_000])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit(1), "decoded": F.lit(2)})
    once = encode_and_decode(docs, vocabulary)
    twice = decode(encode(docs, vocabulary), vocabulary)
    digest = lambda d: sorted(map(tuple, d.select("doc_id", F.xxhash64("ids"), F.sha2("decoded", 256)).collect()))
    assert digest(once) == digest(twice)
    assert once.columns == twice.columns == ["doc_id", "ids", "decoded"]
    back = once.join(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id")
    assert back.where(~F.col("text").eqNullSafe(F.col("decoded"))).count() == 0


def test_the_query_against_brute_force(spark, vocabulary):
    sf = "/root/testdata/sf0.001"
    short = {x.doc_id: x.text for x in spark.read.parquet(f"{sf}/documents.parquet").collect() if len(x.text or "") < 600}
    got = {x.doc_id: x for x in registry.op7_sentencepiece(spark, sf).collect()}
    assert all(x.round_trip for x in got.values())
    want = spark.createDataFrame([(i, brute(vocabulary, t or "")) for i, t in short.items()], "doc_id long, ids array<int>").select("doc_id", F.size("ids").alias("n"), F.xxhash64("ids").alias("h"))
    for x in want.collect():
        assert (got[x.doc_id].n_ids, got[x.doc_id].ids_hash) == (x.n, x.h)


@pytest.mark.parametrize("most", [3, 12, 1 << 19])
def test_parts_met_before_are_not_searched_again(vocabulary, monkeypatch, most):
    """The same ids with parts kept, whatever the bound; without pressure a part is searched once in a task."""
    searched, search = [], pieces._best
    monkeypatch.setattr(pieces, "_best", lambda v, parts, lengths: (searched.append(len(lengths)), search(v, parts, lengths))[1])
    met, batches = Met(most), [TEXTS, TEXTS[::-1], ["Hello world. again", "q" * 200, *TEXTS]]
    for texts in batches:
        ids, counts = encode_buffer(vocabulary, *buffer_of(pa.array(texts)), met=met)
        before = len(searched)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == ids_of(vocabulary, texts)
        assert len(met.keys) <= most and (np.diff(met.keys) > 0).all()
        del searched[before:]
        if texts is batches[1] and most == 1 << 19:
            assert sum(searched) == once + 1  # the part of 200 characters is too long to be kept
        once = sum(searched) if texts is TEXTS else 0
