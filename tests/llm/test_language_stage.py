import random

import corpus_pipeline

SF = "/root/testdata/sf0.01"

FOREIGN = [
    "la vita è un viaggio che inizia ogni mattina quando il sole sorge sopra le montagne e gli uccelli cantano nella valle mentre i contadini lavorano",
    "każdego ranka słońce wschodzi nad górami i ptaki śpiewają w dolinie podczas gdy rolnicy pracują na polach przed wielkim miastem",
    "каждое утро солнце встает над горами и птицы поют в долине пока крестьяне работают на полях",
    "joka aamu aurinko nousee vuorten ylle ja linnut laulavat laaksossa samalla kun maanviljelijät työskentelevät pelloilla",
    "elke ochtend komt de zon op boven de bergen en zingen de vogels in het dal terwijl de boeren op het veld werken",
    "her sabah güneş dağların üzerinde doğar ve kuşlar vadide şarkı söylerken çiftçiler tarlalarda çalışır",
]


def test_foreign_and_junk_texts_go_and_short_clean_ones_stay(spark):
    r = random.Random(5)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(corpus_pipeline.COLUMNS)
    clean = docs.where("length(text) > 800 and lang is not null").orderBy("doc_id").limit(60).collect()
    assert len(clean) == 60
    short = [(10_000 + i, " ".join(x.text.split()[:12]), x.lang) for i, x in enumerate(clean)]
    foreign = [(20_000 + i, " ".join(t.split() * 6), None) for i, t in enumerate(FOREIGN)]
    junk = [(30_000 + i, " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 10))) for _ in range(120)), None) for i, letters in enumerate(("abcdefghijklmnopqrstuvwxyz", "zxqjkvw"))]
    rows = [(i, t, lang, "s", len(t)) for i, t, lang in short + foreign + junk]
    all_docs = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    kept = {x.doc_id for x in corpus_pipeline.keep_known_languages(spark, all_docs, SF).select("doc_id").collect()}
    assert not [i for i, *_ in foreign + junk if i in kept]
    assert sum(i in kept for i, *_ in short) >= 0.95 * len(short)
    assert len([i for i in kept if i < 10_000]) > 0.97 * docs.count()


def test_two_languages_can_reject(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(corpus_pipeline.COLUMNS).where("lang in ('de', 'en')")
    text = " ".join(FOREIGN[1].split() * 6)
    planted = docs.unionByName(spark.createDataFrame([(20_000, text, None, "s", len(text))], docs.schema))
    kept = corpus_pipeline.keep_known_languages(spark, planted, SF)
    assert kept.where("doc_id = 20000").count() == 0 and kept.count() > 0.97 * docs.count()
