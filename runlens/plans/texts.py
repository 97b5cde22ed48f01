"""Queries: scalar functions over numbers, times and texts."""

from pyspark.sql import functions as F

from runlens.functions import formats as M
from runlens.functions import text as X

from .catalog import query


@query("""select c_custkey, case when a >= 1e6 then 'M' when a >= 1e3 then 'k' else '' end as suffix,
round(case when a >= 1e6 then sg(x / 1e6) when a >= 1e3 then sg(x / 1e3) else sg(x) end, 6) as head from (select c_custkey, c_acctbal * 173 as x, abs(c_acctbal * 173) as a from customer)"""
       .replace("sg(x / 1e6)", "round(x / 1e6 * power(10, 2 - floor(log10(a / 1e6)))) / power(10, 2 - floor(log10(a / 1e6)))")
       .replace("sg(x / 1e3)", "round(x / 1e3 * power(10, 2 - floor(log10(a / 1e3)))) / power(10, 2 - floor(log10(a / 1e3)))")
       .replace("sg(x)", "case when x = 0 then 0 else round(x * power(10, 2 - floor(log10(a)))) / power(10, 2 - floor(log10(a))) end"))
def sca01_compact(v):
    text = M.compact(F.col("c_acctbal") * 173)
    return v.table("customer").select("c_custkey", F.regexp_extract(text, "[kMBT]?$", 0).alias("suffix"), F.round(F.regexp_replace(text, "[kMBT]$", "").cast("double"), 6).alias("head"))


@query("""select event_id, case when d > 0 then d || 'd ' || lpad(h::varchar, 2, '0') || 'h' when h > 0 then h || 'h ' || lpad(m::varchar, 2, '0') || 'm' when m > 0 then m || 'm' else sec || 's' end as duration,
case when d > 0 then d || 'd ' else '' end || lpad(h::varchar, 2, '0') || ':' || lpad(m::varchar, 2, '0') || ':' || lpad(sec::varchar, 2, '0') as clock
from (select event_id, s // 86400 as d, (s % 86400) // 3600 as h, (s % 3600) // 60 as m, s % 60 as sec from (select event_id, (event_id * 37 % 200000)::bigint as s from events))""")
def sca02_durations(v):
    s = F.col("event_id") * 37 % 200000
    return v.table("events").select("event_id", M.duration(s).alias("duration"), M.clock(s).alias("clock"))


@query("select run, step, strftime(make_timestamp(floor(wall)::bigint * 1000000), '%Y-%m-%dT%H:%M:%SZ') as ended from axis")
def sca04_iso_time(v):
    return v.axis.select("run", "step", M.iso_time(F.col("wall")).alias("ended"))


@query("select s_suppkey, round(abs(s_acctbal - round(s_acctbal, 0)) / greatest(abs(s_acctbal), abs(round(s_acctbal, 0)), 1e-12), 9) as error from supplier")
def sca07_relative_error(v):
    return v.table("supplier").select("s_suppkey", F.round(M.relative_error(F.col("s_acctbal"), F.round("s_acctbal", 0)), 9).alias("error"))


@query("select event_id, (props::json ->> 'k')::bigint as k, try_cast(props as json) is not null as ok from events")
def sca10_json(v):
    return v.table("events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"), F.try_parse_json("props").isNotNull().alias("ok"))


@query("select page_id, sha256(html) as sha256, sha1(html) as sha1 from pages")
def sca11_digests(v):
    return v.table("pages").select("page_id", F.sha2("html", 256).alias("sha256"), F.sha1("html").alias("sha1"))


@query(""", w as (select item_id, list_distinct(list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: len(x) > 2)) as words from benchmark)
select a.item_id as a, b.item_id as b, round(len(list_intersect(a.words, b.words)) / nullif(len(list_distinct(list_concat(a.words, b.words))), 0), 9) as jaccard,
round(len(list_intersect(a.words, b.words)) / nullif(least(len(a.words), len(b.words)), 0), 9) as containment from w a join w b on b.item_id = a.item_id + 1""")
def sca12_word_sets(v):
    w = v.table("benchmark").select("item_id", X.word_set(F.col("text")).alias("words"))
    a, b = w.toDF("a", "wa"), w.toDF("b", "wb")
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", F.round(X.jaccard(F.col("wa"), F.col("wb")), 9).alias("jaccard"), F.round(X.containment(F.col("wa"), F.col("wb")), 9).alias("containment"))


@query(r"""select page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'),
'(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t\r\n\f]+', ' ', 'g')) as text from pages""")
def sca13_html_text(v):
    return v.table("pages").select("page_id", X.html_text(F.col("html")).alias("text"))


@query("select conv_id, count(*) as turns, count(*) filter (regexp_matches(text, '[\\x{4e00}-\\x{9fff}]')) as cjk from conversations group by conv_id")
def sca15_cjk(v):
    return v.table("conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(X.has_cjk(F.col("text"))).alias("cjk"))


@query(""", recursive_rows as (select conv_id, turn, length(text) as size, row_number() over (partition by conv_id order by turn) as i from conversations where text is not null)
select conv_id, turn, size::int as size, batch from (with recursive f(conv_id, i, turn, size, batch, used) as (select conv_id, i, turn, size, 0, size from recursive_rows where i = 1
union all select r.conv_id, r.i, r.turn, r.size, case when used + r.size <= 600 then batch else batch + 1 end, case when used + r.size <= 600 then used + r.size else r.size end from f join recursive_rows r on r.conv_id = f.conv_id and r.i = f.i + 1)
select * from f)""")
def src04_length_batches(v):
    turns = v.table("conversations").where("text is not null")
    return X.length_batches(turns, ["conv_id"], "turn", F.length("text"), 600)


@query("select p_brand, arg_max(p_name, (case when p_name <> '' then 1 else 0 end + case when p_type <> '' then 1 else 0 end) * 1e6 + (length(p_name) + length(p_type))) is not null as found, max(length(p_name) + length(p_type)) as length from part group by p_brand")
def sca24_more_complete(v):
    best = X.more_complete(v.table("part").select("p_brand", "p_name", "p_type"), "p_brand", ["p_name", "p_type"])
    return best.select("p_brand", F.col("p_name").isNotNull().alias("found"), (F.length("p_name") + F.length("p_type")).cast("long").alias("length"))


@query("select count(distinct coalesce(nullif(n_name, ''), 'id:' || n_nationkey)) as materials from nation")
def sca27_materials(v):
    return v.table("nation").agg(F.count_distinct(F.coalesce(F.nullif("n_name", F.lit("")), F.concat(F.lit("id:"), F.col("n_nationkey").cast("string")))).alias("materials"))


@query("""select item_id, state from (select item_id, case when item_id % 3 = 0 then 'new' when item_id % 3 = 1 then 'changed' else 'same' end as state from benchmark) where state <> 'same' order by item_id limit 20""")
def sca31_work_selection(v):
    b = v.table("benchmark")
    known = b.where("item_id % 3 <> 0").select("item_id", F.when(F.col("item_id") % 3 == 1, F.sha1(F.lit("old"))).otherwise(F.sha1("text")).alias("was"))
    state = F.when(F.col("was").isNull(), "new").when(F.col("was") != F.sha1("text"), "changed").otherwise("same")
    return b.join(known, "item_id", "left").select("item_id", state.alias("state")).where("state <> 'same'").orderBy("item_id").limit(20)


@query("select page_id, sha256(html) as now, case when page_id % 5 = 0 then 'new' when page_id % 5 = 1 then 'changed' else 'same' end as state from pages")
def src09_manifest(v):
    pages = v.table("pages").select("page_id", F.sha2("html", 256).alias("now"))
    old = pages.where("page_id % 5 <> 0").select("page_id", F.when(F.col("page_id") % 5 == 1, "stale").otherwise(F.col("now")).alias("was"))
    state = F.when(F.col("was").isNull(), "new").when(F.col("was") != F.col("now"), "changed").otherwise("same")
    return pages.join(old, "page_id", "left").select("page_id", "now", state.alias("state"))


@query("select tag, '| ' || tag || ' | ' || count(value) || ' |' as line from fact group by tag")
def snk05_table_lines(v):
    return v.fact.groupBy("tag").agg(F.count("value").alias("n")).select("tag", F.concat(F.lit("| "), "tag", F.lit(" | "), F.col("n").cast("string"), F.lit(" |")).alias("line"))
