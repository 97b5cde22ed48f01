"""Registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, quality_rank
from .impact_search import top_inner_products
from .importance import importance_resample
from .lattice_dedup import embedding_dedup
from .line_dedup import line_dedup
from .mixing import mix
from .pieces import encode_and_decode, load_vocabulary
from .prefix_trie import conversation_trie
from .simhash_dedup import simhash_groups
from .storage import narrow_batches, shared_folder
from .substring_dedup import substring_dedup
from .url_filter import Rule, url_filter
from .warc import archived_pages

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    narrow_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_table(spark, sf_dir, "documents"), with_text=False)


@_query
def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_groups(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@_query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "kept_text")


URL_RULES = [Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"), Rule("allow", "net", "/de/"), Rule("block", "example.net", "/de/8"), Rule("block", "org", "/es/")]


@_query
def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(_table(spark, sf_dir, "pages"), URL_RULES)


ORACLES["op10_url_filters"] = """
with rules(verdict, h, p) as (values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
  ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
cut as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
parsed as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut),
fits as (select page_id, max_by(h || p, length(h || p)) as rule, max_by(verdict, length(h || p)) as verdict
  from parsed join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by page_id)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict, coalesce(verdict = 'block', false) as listed
from parsed left join fits using (page_id)
"""


def _fold(folds: int):
    return language_id.fold("doc_id", folds)


@_query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model, languages = language_id.fit(docs.where(_fold(4) != 2))
    found = language_id.identify_language(docs.select("doc_id", "text"), model, languages)
    return found.select("doc_id", F.coalesce(_fold(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


@_query
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    ranker = quality_rank.fit(docs, _table(spark, sf_dir, "labels").where(_fold(5) != 0))
    found = quality_rank.score_quality(docs, ranker)
    return found.select("doc_id", F.coalesce(_fold(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


@_query
def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(_table(spark, sf_dir, "embeddings"))


@_query
def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return top_inner_products(rows, rows.where("vec_id % 50 = 0"))


ORACLES["op2_embedding_near_dedup"] = """
with recursive v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
n as (select vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as norm from v),
u as (select vec_id, list_transform(e, lambda x: x / norm) as e from n where norm > 0),
links as (select a.vec_id as a, b.vec_id as b from u a join u b on a.vec_id <> b.vec_id and list_inner_product(a.e, b.e) >= 0.9),
reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
least as (select a, min(b) as m from reach group by a), degree as (select a, count(*) as n_links from links group by a)
select vec_id, coalesce(n_links, 0) as n_links, least(vec_id, coalesce(m, vec_id)) as component_id,
  vec_id = least(vec_id, coalesce(m, vec_id)) as kept
from embeddings left join degree on degree.a = vec_id left join least on least.a = vec_id
"""

ORACLES["op4_exact_top_k"] = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score
  from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""


@_query
def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")).drop("text")


#: A model file of a public tokenizer; any SentencePiece model with byte pieces will do.
PIECES = os.environ.get("RUNLENS_PIECES", "/opt/tokenizers/piece_bpe_32k.model")


@_query
def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = load_vocabulary(PIECES)
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("text_sha256"), "text")
    back = encode_and_decode(docs, vocabulary)
    return back.select(
        "doc_id",
        F.when(F.col("ids").isNull(), 0).otherwise(F.size("ids")).cast("long").alias("n_ids"),
        F.xxhash64("ids").alias("ids_hash"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.sha2("decoded", 256).eqNullSafe(F.col("text_sha256")).alias("round_trip"),
    )


@_query
def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(_table(spark, sf_dir, "pages"), f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}")


ORACLES["op11_warc"] = """
with p as (select page_id, coalesce(html, '') as html from pages),
s as (select html, max(page_id) as stored from p where strlen(html) >= 1000 group by html)
select page_id, strlen(p.html) as payload_bytes, sha1(p.html) as payload_digest,
  case when page_id < stored or page_id is null and stored is not null then 'revisit' else 'response' end as record_type,
  case when page_id < stored or page_id is null then stored end as refers_to, true as intact
from p left join s using (html)
"""


@_query
def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(_table(spark, sf_dir, "conversations"), splice=True)


@_query
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), with_text=False)


#: CRC-32 of the UTF-8 bytes of a column w, in DuckDB: a table of 256 steps and a fold over the bytes.
_CRC = """xor(list_reduce(list_transform(range(strlen(w)), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::bigint),
  lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]), 4294967295::bigint), 4294967295)"""
_CRC_STEPS = """crc_steps as (select list_transform(range(256), lambda i: list_reduce(range(8),
  lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i)) as steps)"""

ORACLES["op12_conversation_trie"] = f"""
with {_CRC_STEPS},
own as (select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text,
  row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos from conversations where conv_id is not null),
named as (select distinct c, c::varchar as w from own),
h as (select c, c - c % 5 as base, {_CRC} % 9 as h from named, crc_steps),
taken as (select h.c, h.h, count(o.pos) as k from h left join own o on o.c = h.base and o.pos <= h.h group by all),
turns as (select h.c, o.pos, o.role, o.text from h join own o on o.c = h.base and o.pos <= h.h
  union all select t.c, o.pos - t.h + t.k, o.role, o.text from taken t join own o on o.c = t.c and o.pos > t.h),
paths as (select c, 0 as d, '' as path, 0 as bytes from h union all
  select c, pos, string_agg(sha256(strlen(role) || ':' || role || text), '' order by pos) over (partition by c order by pos), strlen(text) from turns),
ended as (select c, max(d) as d from paths group by c),
nodes as (select d, path, min(c) as node, count(*) as n, max(bytes) as bytes,
  sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (e.d is not null), '')) as ends from paths left join ended e using (c, d) group by d, path),
placed as (select p.c, p.d, n.node, n.n, n.bytes, n.ends from paths p join nodes n using (d, path)),
edges as (select distinct b.node, b.d, a.node as parent from placed b join placed a on a.c = b.c and a.d = b.d - 1),
kids as (select parent as node, d - 1 as d, count(*) as kids from edges group by all),
tops as (select node as c, * from placed where c = node),
subtree as (select a.node, a.d, sum((b.n - 1) * b.bytes) as saved, count(*) filter (k.kids is null) as leaves
  from tops b join placed a on a.c = b.c and a.d <= b.d left join kids k on k.node = b.node and k.d = b.d group by all)
select t.node as conv_id, t.d::bigint as depth, e.parent as parent_conv_id, t.n as n_convs, coalesce(k.kids, 0) as n_children,
  s.leaves as n_leaves, s.saved::bigint as saved_tokens, t.ends as ends_sha256
from tops t join subtree s on s.node = t.node and s.d = t.d left join edges e on e.node = t.node and e.d = t.d left join kids k on k.node = t.node and k.d = t.d
"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')".format(_LOWER.format("text"))
ORACLES["op13_importance_resampling"] = f"""
with {_CRC_STEPS},
docs as (select row_number() over () as id, doc_id, {_WORDS} as words from documents),
word as (select id, unnest(words) as w from docs), goal as (select unnest({_WORDS}) as w from benchmark),
hashed as (select w, {_CRC} % 10000 as b from (select w from word union select w from goal), crc_steps),
s as (select b, count(*) as s from word join hashed using (w) group by b), t as (select b, count(*) as t from goal join hashed using (w) group by b),
sums as (select (select coalesce(sum(s), 0) from s)::double as ss, (select coalesce(sum(t), 0) from t)::double as tt),
gain as (select b, floor(1000 * ln((coalesce(t, 0) + 1) * (ss + 10000) / ((coalesce(s, 0) + 1) * (tt + 10000))))::bigint as g from s full join t using (b), sums),
weighed as (select id, sum(g)::bigint as weight from word join hashed using (w) join gain using (b) group by id),
scored as (select id, doc_id, len(coalesce(words, [])) as n, coalesce(weight, 0) as weight,
  ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint as h from docs left join weighed using (id)),
final as (select *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0::double)))::bigint as score, n >= 20 and doc_id is not null as may from scored),
ranked as (select id, row_number() over (order by score desc, doc_id, n, weight) as rank, count(*) over () as total from final where may)
select doc_id, n as n_features, weight, score, case when rank <= 10 * total // 100 then rank end as rank from final left join ranked using (id)
"""
