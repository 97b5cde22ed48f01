"""Groups of documents that share most of their word shingles: candidates by fingerprints, made whole by a prefix join.

Two sets of shingles with a Jaccard similarity of `similarity` per cent or more share one of the least hashes of both:
each set of n names n - ceil(similarity * n) + 1 of them, so that no pair is missed. Pairs that the pivot tables of the
fingerprints find are verified first; then the prefixes are joined between different groups only, so that a large group
of near copies meets once and not pair by pair. Any one order of all hashes gives such prefixes: those that many groups
share come last in it, so that a set with a common passage is found by what it shares with few. Pairs whose parity sketches show too many members that only one of them
has are given up before their sets are compared. Every link is a pair whose true similarity was computed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .links import components
from .simhash_dedup import CROWD, fingerprint_links, fingerprint_of, shingle_hashes
from .storage import tidy, written

SHINGLE = 5
#: Jaccard similarity in per cent.
SIMILARITY = 80
#: A hash whose sets would meet more sets of other groups each, on average, comes behind all that don't.
COMMON = 8
#: Hashes that are kept behind each prefix, to follow up those that go to the end; beyond them the text is read again.
SPARE = 24
#: The order is changed so often at most; hashes that are common in the last order are joined all the same.
ORDERS = 3
#: Up to so many ids (8 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def shingle_set(hashes: bytes) -> np.ndarray:
    """The distinct hashes, in ascending order."""
    return np.unique(np.frombuffer(hashes, ">u8").astype(np.uint64).view(np.int64))


def prefix_size(n: int, similarity: int) -> int:
    """Of how many least hashes a set of n and any set as similar share one."""
    return n + (-n * similarity) // 100 + 1 if n else 0


def sketch(found: np.ndarray) -> bytes:
    """Of each value of the hashes' last bits, whether an odd number of members has it, in at least four bits a member.

    Sets differ in at least as many members as their sketches in bits.
    """
    bits = 1 << max(6, int(4 * len(found) - 1).bit_length())
    return np.packbits(np.bincount(found & (bits - 1), minlength=bits) & 1, bitorder="little").tobytes()


def sketches_apart(x: bytes, y: bytes) -> int:
    """In how many bits two sketches differ, the longer one folded to the other's size."""
    short, long = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
    return int(np.bitwise_count(short ^ np.bitwise_xor.reduce(long.reshape(-1, len(short)))).sum())


def _maybe(batches: Iterator[pa.RecordBatch], similarity: int) -> Iterator[pa.RecordBatch]:
    """The pairs of sets (a, b, sizes n and m, sketches) that can be similar."""
    for batch in batches:
        n, m, x, y = (batch.column(k).to_pylist() for k in range(2, 6))
        keep = [sketches_apart(x[i], y[i]) * (100 + similarity) <= (n[i] + m[i]) * (100 - similarity) for i in range(len(batch))]
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _heads(batches: Iterator[pa.RecordBatch], shingle: int, similarity: int) -> Iterator[pa.RecordBatch]:
    task, n_rows = TaskContext.get(), 0
    first = (task.partitionId() if task else 0) << 40  # rows are numbered, since rows repeated whole differ in nothing else
    for batch in batches:
        fps, ids, sizes, prefixes, heads, sketches = [], [], [], [], [], []
        for t in batch.column(1):
            hashes = shingle_hashes((t.as_py() or "").encode(), shingle)
            found = shingle_set(hashes)
            fps.append(int.from_bytes(fingerprint_of(hashes), "big", signed=True))
            ids.append(xxhash.xxh128_digest(found.tobytes()))
            sizes.append(len(found))
            sketches.append(sketch(found))
            prefixes.append(prefix_size(len(found), similarity))
            heads.append(found[: prefixes[-1] + SPARE])
        columns = [pa.array(fps, pa.int64()), pa.array(ids, pa.binary()), pa.array(sizes, pa.int32()), pa.array(prefixes, pa.int32()), pa.array(heads, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
        rows = pa.array(np.arange(first + n_rows, first + n_rows + len(batch)))
        n_rows += len(batch)
        yield pa.record_batch([batch.column(0), rows, *columns], names=["doc_id", "row", "fp", "set_id", "n", "p", "head", "sketch"])


SETS = "doc_id long, set_id binary, hashes array<long>"


def _sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [shingle_set(shingle_hashes((t.as_py() or "").encode(), shingle)) for t in batch.column(1)]
        ids = pa.array([xxhash.xxh128_digest(x.tobytes()) for x in found], pa.binary())
        yield pa.record_batch([batch.column(0), ids, pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "set_id", "hashes"])


def _similar(common: Column, n: Column, m: Column, similarity: int) -> Column:
    """Sets of n and m with `common` shared members are similar."""
    return common * (100 + similarity) >= (n + m) * similarity


def _can_be(c: Column, n: Column, m: Column, similarity: int) -> Column:
    """Sets of n and m whose prefixes share c members can be similar.

    All shared members up to the end of the prefix that ends first are among the c; the others lie in that set's rest.
    """
    rest = F.greatest(*(F.ceil(x * similarity / 100) - 1 for x in (n, m)))
    return _similar(F.least(c + rest, n, m), n, m, similarity)


def _few(rows: DataFrame) -> DataFrame:
    """The same rows of ids, broadcast if they are few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _common(keys: DataFrame, before: DataFrame | None) -> DataFrame:
    """key and its pairs: those not in `before` that would make each of their rows (rep, key, component) meet more than COMMON of other components."""
    each = keys.groupBy("key", "component").agg(F.count("*").alias("c")).groupBy("key").agg(F.sum("c").alias("many"), F.sum(F.col("c") * F.col("c")).alias("own"))
    found = each.withColumn("pairs", F.col("many") * F.col("many") - F.col("own")).where(F.col("pairs") > COMMON * F.col("many")).select("key", "pairs")
    return written(found if before is None else found.join(_few(before), "key", "left_anti"), "common_hashes")


def _ordered(rows: DataFrame, common: DataFrame) -> DataFrame:
    """The rows (set_id, head and others) with order: the hashes of head, common ones behind all others; known: how many come before these."""
    late = rows.select("set_id", F.explode("head").alias("key")).join(_few(common), "key", "left_semi")
    late = written(late.groupBy("set_id").agg(F.array_sort(F.collect_list("key")).alias("late")), "hashes_late")
    marked = rows.join(_few(late), "set_id", "left").withColumn("late", F.coalesce("late", F.array().cast("array<long>")))
    return marked.select("*", F.concat(F.array_except("head", "late"), "late").alias("order"), (F.size("head") - F.size("late")).alias("known"))


def _followers(hit: DataFrame, reps: DataFrame, texts: DataFrame, common: DataFrame, shingle: int) -> DataFrame:
    """rep, n, key: the hashes that come into the prefixes of the sets of `hit` (rep) as the common ones go to the end."""
    here = written(_ordered(reps.join(_few(hit), "rep", "left_semi").select("set_id", "rep", "n", "p", "head"), common), "hashes_ordered")
    enough = (F.col("known") >= F.col("p")) | (F.size("head") == F.col("n"))
    short = written(here.where(~enough).select("set_id", "rep", "n", "p"), "prefixes_short")
    picked = texts.join(_few(short.select(F.col("rep").alias("doc_id")).distinct()), "doc_id", "left_semi")
    sets = picked.mapInArrow(lambda it: _sets(it, shingle), SETS).dropDuplicates(["set_id"]).select("set_id", F.col("hashes").alias("head"))
    both = here.where(enough).unionByName(_ordered(written(sets.join(_few(short), "set_id"), "sets_short"), common))
    stay = F.array_except(F.slice("head", F.lit(1), F.col("p")), F.col("late"))
    return both.select("rep", "n", F.explode(F.array_except(F.slice("order", F.lit(1), F.col("p")), stay)).alias("key")).distinct()


def _met(pairs: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """pairs (a, b) with the columns of both rows (doc_id), named x_ and y_.

    A row goes once to each of its pairs with a smaller doc_id, and those of the smaller ones meet it there.
    """
    firsts = pairs.select("a").distinct()
    if pairs.count() <= BROADCAST_ROWS:
        pairs, firsts = F.broadcast(pairs), F.broadcast(firsts)
    x, y = (rows.select(F.col("doc_id").alias(end), *(F.col(c).alias(f"{side}_{c}") for c in columns)) for end, side in (("a", "x"), ("b", "y")))
    return y.join(pairs, "b").join(x.join(firsts, "a", "left_semi"), "a").select("a", "b", *(f"{side}_{c}" for c in columns for side in "xy"))


@tidy
def _rare_keys(keys: DataFrame, reps: DataFrame, texts: DataFrame, found: DataFrame, shingle: int) -> DataFrame:
    """rep, n, key, component: hashes that the sets' prefixes share, in an order in which few are common.

    keys: rep, n and key of the prefixes in ascending order, if more than one has it. A hash that many sets of different
    components share goes behind all others, in all sets, and others follow up in the prefixes; those may be common in
    turn. This ends when common hashes would make no more than one pair for each row.
    """
    named = lambda rows: written(rows.join(found, "rep", "left").withColumn("component", F.coalesce("component", "rep")), "shingle_parts")
    parts, common = named(keys.select("rep", "n", "key").distinct()), None
    for _ in range(ORDERS):
        new = _common(parts, common)
        if (new.agg(F.sum("pairs")).first()[0] or 0) <= 2 * parts.count():  # each pair counts from both sides
            break
        new = new.select("key")
        common = new if common is None else written(common.unionByName(new), "common_hashes")
        hit = written(parts.join(_few(new), "key", "left_semi").select("rep").distinct(), "sets_hit")
        followers = written(_followers(hit, reps, texts, common, shingle), "followers")
        # What else has a hash that came in: no other prefix may have shared it before.
        old = reps.select("rep", "n", F.explode(F.slice("head", F.lit(1), F.col("p"))).alias("key"))
        old = old.join(_few(followers.select("key").distinct()), "key", "left_semi").join(_few(common), "key", "left_anti")
        stay = parts.select("rep", "n", "key").join(_few(new), "key", "left_anti")
        parts = named(stay.unionByName(old).unionByName(followers).distinct())
    return parts


@tidy
def _verified(pairs: DataFrame, reps: DataFrame, texts: DataFrame, shingle: int, similarity: int) -> DataFrame:
    """The pairs (a, b) of doc_id whose sets of shingles are similar; reps: rep with n and sketch."""
    pairs = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "set_pairs")
    sketched = _met(pairs, reps.withColumnRenamed("rep", "doc_id"), ["n", "sketch"])
    pairs = written(sketched.mapInArrow(lambda it: _maybe(it, similarity), "a long, b long"), "set_pairs_left")
    wanted = written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "sets_wanted")
    picked = texts.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted, "doc_id", "left_semi")
    sets = written(picked.mapInArrow(lambda it: _sets(it, shingle), SETS).select("doc_id", "hashes"), "sets_met")
    met = _met(pairs, sets, ["hashes"])
    close = _similar(F.size(F.array_intersect("x_hashes", "y_hashes")), F.size("x_hashes"), F.size("y_hashes"), similarity)
    return met.where(close).select("a", "b").distinct()


@tidy
def shingle_groups(docs: DataFrame, shingle: int = SHINGLE, similarity: int = SIMILARITY, crowd: int = CROWD) -> DataFrame:
    """doc_id and component_id per row with doc_id: the smallest doc_id that links of similar texts reach.

    Two texts are similar if the Jaccard similarity of their sets of shingles is `similarity` per cent or more. Words
    and shingles are those of the fingerprints; texts without words are alike. Other columns are ignored.
    """
    texts = docs.where("doc_id is not null").select("doc_id", "text")
    schema = "doc_id long, row long, fp long, set_id binary, n int, p int, head array<long>, sketch binary"
    heads = written(texts.mapInArrow(lambda it: _heads(it, shingle, similarity), schema), "shingle_heads")
    # The least document of each set stands for it; the hashes, most of the bytes, stay where they are.
    firsts = written(heads.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.min_by("row", "doc_id").alias("first"), F.count("*").alias("copies")), "shingle_firsts")
    later = written(heads.select("set_id", "row").join(firsts.where("copies > 1"), "set_id").where("row <> first").select("row"), "shingle_copies")
    reps = heads.join(F.broadcast(later) if later.count() <= BROADCAST_ROWS else later, "row", "left_anti").select("set_id", F.col("doc_id").alias("rep"), "fp", "n", "p", "head", "sketch")
    keys = reps.select("rep", "n", F.explode(F.slice("head", F.lit(1), F.col("p"))).alias("key"))
    sizes = keys.groupBy("key").agg(F.count("*").alias("many"), F.min("rep").alias("least")).where("many > 1")
    keys = written(keys.join(sizes, "key"), "shingle_keys")
    by_print = written(reps.groupBy("fp").agg(F.min("rep").alias("first")), "shingle_prints")
    same = reps.join(by_print, "fp").select(F.col("first").alias("a"), F.col("rep").alias("b"))
    near = fingerprint_links(by_print.select("fp", F.col("first").alias("rep")), crowd=crowd)
    # Not all of the members that a least one meets, but those that it shares enough keys with.
    rest = keys.select(F.col("rep").alias("a"), F.col("n").alias("m")).distinct()
    stars = keys.where((F.col("many") > crowd) & (F.col("rep") != F.col("least"))).groupBy(F.col("least").alias("a"), F.col("rep").alias("b"), "n").agg(F.count("*").alias("c")).join(rest, "a")
    stars = stars.where(_can_be(F.col("c"), F.col("n"), F.col("m"), similarity)).select("a", "b")
    links = _verified(same.unionByName(near).unionByName(stars), reps, texts, shingle, similarity)
    found = components(links).toDF("rep", "component")
    parts = _rare_keys(keys, reps, texts, found, shingle)
    met = (
        parts.alias("x")
        .join(parts.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.rep") < F.col("y.rep")) & (F.col("x.component") != F.col("y.component")) & _similar(F.least("x.n", "y.n"), F.col("x.n"), F.col("y.n"), similarity))
        .groupBy(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"), F.col("x.n").alias("n"), F.col("y.n").alias("m"))
        .agg(F.count("*").alias("c"))
        .where(_can_be(F.col("c"), F.col("n"), F.col("m"), similarity))
        .select("a", "b")
    )
    links = links.unionByName(_verified(met, reps, texts, shingle, similarity))
    found = components(links).toDF("rep", "component")
    named = firsts.select("set_id", "rep").join(found, "rep", "left").select("set_id", F.coalesce("component", "rep").alias("component_id"))
    return heads.select("doc_id", "set_id").join(named, "set_id").select("doc_id", "component_id")
