"""URL filters: prefix rules, and exact membership in a list of keys by a cascade of Bloom filters.

The cascade answers exactly for every key of a known universe. Level 1 encodes the listed keys; level 2 those unlisted
keys that level 1 lets pass; level 3 the listed keys that level 2 lets pass; and so on until none pass. A key's first
level that stops it tells the answer. Everything is built and asked by DataFrame functions alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import written

#: Bits per key and hash functions of a level: about one other key in 40 passes.
BITS_PER_KEY = 8
HASHES = 4
#: Bits of one level held in one array (1 MB), read as a scalar. Longer lists are dealt into segments by a key hash,
#: each with an array of its own, and asked by an equi-join on the segment.
SEGMENT_BITS = 1 << 23

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    """Holds for `host` and its subdomains, on paths that start with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def with_host_and_path(pages: DataFrame) -> DataFrame:
    """Adds host and path of column url; both are empty if url is null or has no "://"."""
    start = F.coalesce(F.instr("url", "://"), F.lit(0))
    rest = F.when(start > 0, F.substring(F.col("url"), start + 3, F.length("url"))).otherwise("")
    host, path = F.regexp_extract(rest, r"^([^/?#]*)", 1), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return pages.withColumns({"host": F.translate(host, _UPPER, _UPPER.lower()), "path": path})


def winning_rule(rules: list[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits columns host and path (ties: the first in text order), or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), [-ord(c) for c in r.text])):
        fits = ((F.col("host") == r.host) | F.endswith(F.col("host"), F.lit("." + r.host))) & F.startswith(F.col("path"), F.lit(r.path))
        found = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def key_hashes(key: Column) -> dict[str, Column]:
    """Three independent hashes of a key: two stand for it, the third gives the segment."""
    return {f"k{i}": F.xxhash64(F.lit(i), key) for i in range(3)}


def _positions(bits: int, level: int) -> list[Column]:
    """Each level hashes anew: keys that meet in one filter need not meet in the next."""
    start, step = (F.shiftright(F.xxhash64(F.lit(2 * level + i), F.col("k0"), F.col("k1")), 3) for i in (0, 1))
    return [F.pmod(start + step * i, F.lit(bits)) for i in range(HASHES)]


@dataclass
class _Level:
    words: DataFrame  # segment, words
    bits: int
    number: int

    def passing(self, keys: DataFrame, segments: int, name: str) -> DataFrame:
        """Adds a boolean column: this level lets the key pass."""
        if segments == 1:
            words = self.words.select("words").scalar()
        else:
            keys = keys.join(self.words.withColumnRenamed("words", f"{name}_words"), "segment", "left")
            words = F.col(f"{name}_words")
        set_bits = [F.getbit(F.get(words, (p / 64).cast("int")), F.pmod(p, F.lit(64)).cast("int")) == 1 for p in _positions(self.bits, self.number)]
        every = set_bits[0]
        for x in set_bits[1:]:
            every = every & x
        return keys.withColumn(name, F.coalesce(every, F.lit(False))).drop(f"{name}_words")


class BloomCascade:
    """Exact membership in `listed` for the keys of `universe` (each: one string column named key; nulls are ignored)."""

    def __init__(self, universe: DataFrame, listed: DataFrame, segment_bits: int = SEGMENT_BITS):
        marked = universe.select("key", F.lit(False).alias("is_listed")).unionByName(listed.select("key", F.lit(True).alias("is_listed")))
        keys = marked.where("key is not null").groupBy("key").agg(F.max("is_listed").alias("is_listed"))
        keys = written(keys.select(*(c.alias(n) for n, c in key_hashes(F.col("key")).items()), "is_listed"), "url_keys")
        self.n_listed = keys.where("is_listed").count()
        self.segments = -(-self.n_listed * BITS_PER_KEY // segment_bits) or 1
        self.levels: list[_Level] = []
        keys = keys.withColumn("segment", self._segment())
        inside, outside = keys.where("is_listed"), keys.where("not is_listed")
        while not inside.isEmpty():
            level = self._encode(inside)
            self.levels.append(level)
            passed = written(level.passing(outside, self.segments, "passed").where("passed").drop("passed"), "bloom_passed")
            inside, outside = passed, inside

    def _segment(self) -> Column:
        return F.pmod("k2", F.lit(self.segments)).cast("int")

    def _encode(self, keys: DataFrame) -> _Level:
        largest = keys.groupBy("segment").count().agg(F.max("count")).first()[0]
        n_words = -(-largest * BITS_PER_KEY // 64)
        bits = 64 * n_words
        position = keys.select("segment", F.explode(F.array(*_positions(bits, len(self.levels)))).alias("p"))
        word, bit = F.floor(F.col("p") / 64).cast("int"), F.pmod("p", F.lit(64)).cast("int")
        filled = position.groupBy("segment", word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits"))
        slots = filled.sparkSession.range(n_words).select(F.col("id").cast("int").alias("word"))
        every = filled.select("segment").distinct().select("segment", F.explode(F.sequence(F.lit(0), F.lit(n_words - 1))).alias("word")) if self.segments > 1 else slots.withColumn("segment", F.lit(0))
        dense = every.join(filled, ["segment", "word"], "left").select("segment", F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")).alias("slot"))
        words = dense.groupBy("segment").agg(F.transform(F.array_sort(F.collect_list("slot")), lambda s: s["bits"]).alias("words"))
        return _Level(written(words, "bloom_level"), bits, len(self.levels))

    def mark(self, rows: DataFrame, key: Column, name: str = "listed") -> DataFrame:
        """Adds a boolean column: the row's key is listed. Exact for keys of the universe; false for a null key."""
        if not self.levels:
            return rows.withColumn(name, F.lit(False))
        asked = rows.withColumns(key_hashes(key)).withColumn("segment", self._segment())
        for i, level in enumerate(self.levels):
            asked = level.passing(asked, self.segments, f"pass{i}")
        answer = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            answer = F.when(~F.col(f"pass{i}"), F.lit(i % 2 == 1)).otherwise(answer)
        return asked.withColumn(name, answer & key.isNotNull()).drop("k0", "k1", "k2", "segment", *(f"pass{i}" for i in range(len(self.levels))))


def _ruled_keys(listed: DataFrame, rules: list[Rule]) -> DataFrame:
    """The keys of `listed` but those that an allowing rule wins."""
    parts = listed.select("key", F.regexp_extract("key", r"^([^/]*)", 1).alias("host"), F.regexp_extract("key", r"^[^/]*(.*)", 1).alias("path"))
    return parts.withColumn("won", winning_rule(rules)).where(F.coalesce(F.col("won.verdict") == "block", F.lit(True))).select("key")


def url_filter(pages: DataFrame, rules: list[Rule], listed: DataFrame | None = None, segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """One row per page: page_id, host, path, rule (null if none fits), verdict (allow or block), listed.

    A key is host + path. The cascade's list holds the keys of `pages` that a blocking rule wins and those of `listed`
    (column key) that no allowing rule wins; its universe is the keys of all pages. The verdict is the cascade's answer
    alone; `rule` names the rule that fits and decides nothing. Repeated pages each get a row. A url that is null or
    has no "://" has the empty key. Other columns are ignored.
    """
    parsed = with_host_and_path(pages.select("page_id", "url")).withColumn("won", winning_rule(rules)).withColumn("key", F.concat("host", "path"))
    blocked = parsed.where("won.verdict = 'block'").select("key")
    if listed is not None:
        blocked = blocked.unionByName(_ruled_keys(listed, rules))
    cascade = BloomCascade(parsed.select("key"), blocked, segment_bits)
    return cascade.mark(parsed, F.col("key")).select("page_id", "host", "path", F.col("won.rule").alias("rule"), F.when(F.col("listed"), "block").otherwise("allow").alias("verdict"), "listed")
