"""Line deduplication: of lines that are equal or a few edits apart, over the whole corpus, the first stays.

Exact copies meet by a 128-bit hash. For the edit join each distinct line of `min_chars` or more is cut into
threshold + 1 segments; a line within the threshold of it must contain one of them unchanged, near its old place. So
the segments, with their number and the line's length, are an index, and every line probes it, for each length within
the threshold, with its own substrings at the places where a match can begin. A segment that many lines share is split:
its lines are cut into one segment more, of which two must be found unchanged. Lines that meet are verified by a banded
bit-parallel edit distance over their characters. The threshold grows with the length of the shorter line.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .links import components
from .storage import extended, tidy, unused, written
from .textbuf import WORD_BASES, Rolling, chunks, mixed, ranges

MIN_CHARS = 16
#: Edits allowed from MIN_CHARS on, and from so many characters on.
EDITS = 1
LONGER = ((256, 2),)
#: Segments that make more than CROWD pairs for each line that holds or probes them are not joined, so that the pairs
#: that meet are at most CROWD times the keys, however large a group of near copies grows (see edit_links).
CROWD = 4
#: Lines of a block of those that share two crowded segments; pairs of blocks are rows, pairs of their lines are not.
BLOCK_LINES = 32
#: Pairs of two blocks' lines that are verified before those that links have joined by then are left out.
_STEP = 64
#: Counts of characters, by their code modulo so many, that tell most lines apart.
_KINDS = 64
#: Up to so many line hashes (8 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
NEWLINE = 10
#: Characters that a step of the verification holds at once.
_CELLS = 1 << 20
_BLANK = np.array([9, 10, 11, 12, 13, 32, 0x85, 0xA0], np.uint32)


def _characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 texts, and where each text begins among them."""
    head = (data & 0xC0) != 0x80
    at = np.concatenate([[0], np.cumsum(head)])[offsets]
    return np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32), at


def _lines(chars: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, number in the text, start, end) of each line."""
    breaks = np.flatnonzero(chars == NEWLINE)
    per = np.searchsorted(breaks, at)
    counts = np.diff(per) + 1
    text = np.repeat(np.arange(len(counts)), counts)
    number = ranges(np.zeros(len(counts), np.int64), counts)
    first, last = number == 0, number == np.repeat(counts, counts) - 1
    starts, ends = np.empty(len(text), np.int64), np.empty(len(text), np.int64)
    starts[first], ends[last] = at[:-1], at[1:]
    starts[~first], ends[~last] = breaks + 1, breaks
    return text, number, starts, ends


Thresholds = tuple[tuple[int, int], ...]


def allowed(lengths: np.ndarray, thresholds: Thresholds) -> np.ndarray:
    """The edits allowed between a line of this length and a longer one; 0 for lines too short."""
    return np.array([0, *(k for _, k in thresholds)])[np.searchsorted([n for n, _ in thresholds], lengths, "right")]


def segments(length: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, sizes) of `count` segments of lines of these lengths, one column a segment; sizes differ by 1 at most."""
    starts = (length[:, None] * np.arange(count + 1)) // count
    return starts[:, :-1], np.diff(starts, axis=1)


def _alignments(edits: int, shorter: int, many: int) -> Iterator[tuple[tuple[int, ...], tuple[int, ...]]]:
    """(segments, shifts): which `many` of a line's edits + many segments a line longer by `shorter` can hold unchanged, and where."""
    if many == 1:
        for i in range(edits + 1):
            # Edits before the segment shift it by i at most; those after it, by edits - i from the other end.
            for shift in range(max(-i, shorter - (edits - i)), min(i, shorter + edits - i) + 1):
                yield (i,), (shift,)
        return
    for picked in combinations(range(edits + many), many):
        for shifts in product(range(-edits, edits + 1), repeat=many):
            path = (0, *shifts, shorter)
            if sum(abs(y - x) for x, y in zip(path, path[1:], strict=False)) <= edits:
                yield picked, shifts


def _keys(rolling: Rolling, starts: np.ndarray, lengths: np.ndarray, thresholds: Thresholds, many: int = 1) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
    """(is it a probe, line, key): the index keys of all lines, then their probes."""

    def key(picked, shifts, lines, target, seg_start, seg_size):
        h = mixed((target * 64 + len(picked)).astype(np.uint64))
        for i, shift in zip(picked, shifts, strict=True):
            s = starts[lines] + seg_start[:, i] + shift
            h = mixed(rolling.of(s, s + seg_size[:, i]) + h + np.uint64(i))
        return h

    for edits in sorted({k for _, k in thresholds}):
        lines = np.flatnonzero(allowed(lengths, thresholds) == edits)
        where = segments(lengths[lines], edits + many)
        for picked in combinations(range(edits + many), many):
            yield False, lines, key(picked, (0,) * many, lines, lengths[lines], *where)
        for shorter in range(edits + 1):
            lines = np.flatnonzero(allowed(lengths - shorter, thresholds) == edits)
            target = lengths[lines] - shorter
            seg_start, seg_size = segments(target, edits + many)
            for picked, shifts in _alignments(edits, shorter, many):
                ok = np.ones(len(lines), bool)
                for i, shift in zip(picked, shifts, strict=True):
                    s = seg_start[:, i] + shift
                    ok &= (s >= 0) & (s + seg_size[:, i] <= lengths[lines])
                yield True, lines[ok], key(picked, shifts, lines[ok], target[ok], seg_start[ok], seg_size[ok])


def _most_keys(thresholds: Thresholds) -> tuple[int, int]:
    """The largest number of index keys and of probes of any line."""
    found = []
    for n in {n + d for n, _ in thresholds for d in range(thresholds[-1][1] + 1)} | {thresholds[-1][0] + 99}:
        keys = [probe for probe, line, _ in _keys(Rolling(np.zeros(n), 3), np.zeros(1, np.int64), np.array([n]), thresholds) for _ in line]
        found.append((keys.count(False), keys.count(True)))
    return max(x for x, _ in found), max(x for _, x in found)


def _line_rows(batches: Iterator[pa.RecordBatch], thresholds: Thresholds) -> Iterator[pa.RecordBatch]:
    """Each line that is not blank: its hash, place and length, and its keys (none for a short line)."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for first, last, data, offsets in chunks(batch.column(1)):
            chars, at = _characters(data, offsets)
            text, number, starts, ends = _lines(chars, at)
            ink = np.concatenate([[0], np.cumsum(~np.isin(chars, _BLANK))])
            keep = ink[ends] > ink[starts]
            text, number, starts, ends = text[keep], number[keep], starts[keep], ends[keep]
            lengths = ends - starts
            one, two = Rolling(chars, WORD_BASES[0]), Rolling(chars, WORD_BASES[1])
            size = lengths.astype(np.uint64)
            found = list(_keys(one, starts, lengths, thresholds))
            columns = []
            for side in (False, True):
                line = np.concatenate([x[1] for x in found if x[0] == side])
                key = np.concatenate([x[2] for x in found if x[0] == side])
                order = np.argsort(line, kind="stable")
                cuts = np.searchsorted(line[order], np.arange(len(text) + 1)).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(cuts), pa.array(key[order].view(np.int64))))
            yield pa.record_batch(
                [
                    pa.array(ids[first:last][text], pa.int64()),
                    pa.array(number.astype(np.int32)),
                    pa.array(mixed(one.of(starts, ends) + size).view(np.int64)),
                    pa.array(mixed(two.of(starts, ends) + size).view(np.int64)),
                    *columns,
                ],
                names=["doc", "no", "h1", "h2", "own", "probes"],
            )


def _line_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, offsets in chunks(batch.column(0)):
            chars, at = _characters(data, offsets)
            _, _, starts, ends = _lines(chars, at)
            one = Rolling(chars, WORD_BASES[0])
            hashes = mixed(one.of(starts, ends) + (ends - starts).astype(np.uint64))
            _, once = np.unique(hashes, return_index=True)
            raw = chars.tobytes()
            lines = [raw[4 * starts[k] : 4 * ends[k]].decode("utf-32-le") for k in once]
            yield pa.record_batch([pa.array(hashes[once].view(np.int64)), pa.array(lines, pa.string())], names=["h1", "line"])


def within(left: list[np.ndarray], right: list[np.ndarray], edits: int) -> np.ndarray:
    """Whether each pair of code point arrays is within `edits` edits: a bit-parallel distance over a diagonal band.

    Bit b of a vector stands for the pattern's row `column - edits + b`; all pairs advance by one column a step.
    """
    swap = [len(a) > len(b) for a, b in zip(left, right, strict=True)]
    pattern = [b if s else a for a, b, s in zip(left, right, swap, strict=True)]
    text = [a if s else b for a, b, s in zip(left, right, swap, strict=True)]
    m, n = np.array([len(x) for x in pattern], np.int64), np.array([len(x) for x in text], np.int64)
    result = np.zeros(len(m), bool)
    todo = np.flatnonzero(n - m <= edits)
    order = todo[np.argsort(-n[todo], kind="stable")]
    width = 2 * edits + 1
    full, one = np.uint64((1 << width) - 1), np.uint64(1)
    k = 0
    while k < len(order):
        part = order[k : k + max(1, _CELLS // max(1, int(n[order[k]])))]
        k += len(part)
        rows = np.full((len(part), n[part].max(initial=0) + width), 0xFFFFFFFF, np.uint32)
        cols = np.full((len(part), n[part].max(initial=0)), 0xFFFFFFFE, np.uint32)
        for r, p in enumerate(part):
            rows[r, edits : edits + m[p]] = pattern[p]
            cols[r, : n[p]] = text[p]
        up = np.full(len(part), full >> np.uint64(edits), np.uint64) << np.uint64(edits)
        down = np.zeros(len(part), np.uint64)
        distance = np.zeros(len(part), np.int64)
        live = len(part)
        for j in range(cols.shape[1]):
            live = int(np.searchsorted(-n[part], -j, "left"))  # texts longer than j; they are sorted by length
            equal = rows[:live, j : j + width] == cols[:live, j : j + 1]
            match = (equal * (one << np.arange(width, dtype=np.uint64))).sum(axis=1, dtype=np.uint64)
            vp, vn = up[:live], down[:live]
            diagonal = ((((match & vp) + vp) ^ vp) | match | vn) & full
            hp, hn = (vn | ~(diagonal | vp)) & full, diagonal & vp
            distance[:live] += ((diagonal >> np.uint64(edits)) & one) == 0
            right_of = diagonal >> one
            up[:live], down[:live] = (hn | ~(right_of | hp)) & full, right_of & hp
        # `distance` is that at the diagonal's end; the pattern ends n - m rows above it.
        rise = np.zeros(len(part), np.int64)
        for b in range(edits):
            step = ((up >> np.uint64(edits - 1 - b)) & one).astype(np.int64) - ((down >> np.uint64(edits - 1 - b)) & one).astype(np.int64)
            rise += step * (b < n[part] - m[part])
        result[part] = distance - rise <= edits
    return result


def _are_close(left: list[np.ndarray], right: list[np.ndarray], thresholds: Thresholds) -> np.ndarray:
    edits = allowed(np.array([min(len(x), len(y)) for x, y in zip(left, right, strict=True)], np.int64), thresholds)
    keep = np.zeros(len(left), bool)
    for k in np.unique(edits[edits > 0]).tolist():
        rows = np.flatnonzero(edits == k)
        keep[rows] = within([left[i] for i in rows], [right[i] for i in rows], k)
    return keep


def _verified(batches: Iterator[pa.RecordBatch], thresholds: Thresholds) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = ([np.frombuffer(t.as_py().encode("utf-32-le"), np.uint32) for t in batch.column(c)] for c in (2, 3))
        yield batch.select([0, 1]).filter(pa.array(_are_close(left, right, thresholds)))


def _block_links(left: list[dict], right: list[dict], thresholds: Thresholds) -> Iterator[tuple[int, int]]:
    """Links between lines (h1, component, line) of two blocks, enough to join all groups that close lines connect."""
    texts = [[np.frombuffer(x["line"].encode("utf-32-le"), np.uint32) for x in side] for side in (left, right)]
    sizes = [np.array([len(t) for t in side], np.int64) for side in texts]
    kinds = [np.array([np.bincount(t % _KINDS, minlength=_KINDS) for t in side], np.int64) for side in texts]
    edits = allowed(np.minimum.outer(*sizes), thresholds)
    # An edit changes the counts of characters by two in all at most.
    near = (np.abs(np.subtract.outer(*sizes)) <= edits) & (np.abs(kinds[0][:, None] - kinds[1][None]).sum(axis=2) <= 2 * edits)
    above: dict[int, int] = {}

    def group(x: int) -> int:
        while x in above:
            x = above[x]
        return x

    i, j = np.nonzero(near)
    while len(i):
        apart = [group(left[a]["component"]) != group(right[b]["component"]) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
        i, j = i[apart], j[apart]
        now, later = slice(_STEP), slice(_STEP, None)
        close = _are_close([texts[0][a] for a in i[now]], [texts[1][b] for b in j[now]], thresholds)
        for a, b in zip(i[now][close].tolist(), j[now][close].tolist(), strict=True):
            x, y = group(left[a]["component"]), group(right[b]["component"])
            if x != y:
                above[max(x, y)] = min(x, y)
                yield left[a]["h1"], right[b]["h1"]
        i, j = i[later], j[later]


def _blocks_verified(batches: Iterator[pa.RecordBatch], thresholds: Thresholds) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            links = list(_block_links(batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), thresholds))
            if links:
                yield pa.record_batch([pa.array([x[c] for x in links], pa.int64()) for c in range(2)], names=["a", "b"])


def _pair_keys(batches: Iterator[pa.RecordBatch], thresholds: Thresholds) -> Iterator[pa.RecordBatch]:
    """The keys of two segments each, of lines (h1, line)."""
    for batch in batches:
        h1 = batch.column(0).to_numpy()
        for first, last, data, offsets in chunks(batch.column(1), 1 << 17):
            chars, at = _characters(data, offsets)
            for probe, line, key in _keys(Rolling(chars, WORD_BASES[0]), at[:-1], np.diff(at), thresholds, 2):
                yield pa.record_batch([pa.array(h1[first:last][line]), pa.array(np.full(len(line), probe)), pa.array(key.view(np.int64))], names=["h1", "probe", "key"])


def _halved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both halves of each line's regions (own, a, b; null: the whole line), with a hash of the line outside the half.

    A region is one of a line's characters (own), or of a line with one more character, of which this line would be what
    is left when a character of the region is dropped. Equal keys: equal lines but for what is in the region.
    """
    for batch in batches:
        for h1, line, regions in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            chars = np.frombuffer(line.as_py().encode("utf-32-le"), np.uint32)
            n = len(chars)
            rolling = Rolling(chars, WORD_BASES[1])
            if regions.is_valid:
                own, low, high = (regions.values.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            else:
                own, low, high = np.array([True, False]), np.array([0, 0]), np.array([n, n + 1])
            middle = (low + high) // 2
            own, low, high = np.tile(own, 2), np.concatenate([low, middle]), np.concatenate([middle, high])
            some = low < high
            own, low, high = own[some], low[some].astype(np.int64), high[some].astype(np.int64)
            short = (~own).astype(np.int64)
            size = (n + short).astype(np.uint64)
            key = mixed(mixed(rolling.of(np.zeros(len(low), np.int64), low) + low.astype(np.uint64)) + rolling.of(high - short, np.full(len(low), n)))
            key = mixed(mixed(key + size) + high.astype(np.uint64))
            columns = [pa.array(np.full(len(low), h1)), pa.array(own), pa.array(low), pa.array(high), pa.array(key.view(np.int64))]
            yield pa.record_batch(columns, names=["h1", "own", "a", "b", "key"])


def _crowd_links(lines: DataFrame) -> DataFrame:
    """Links among lines (h1, line) one edit apart, enough to connect them all.

    The place of the edit is found by halving: lines that are equal outside a half go on into it, all others are left
    out of it, so a line makes a few rows a level and not one for each of its characters. Where one place is left, lines
    that are equal but for it all link to the least of them, and so does a line that lacks just that character.
    """
    lines = written(lines.select("h1", "line"), "crowd_lines")
    live, links = lines.withColumn("regions", F.lit(None).cast("array<struct<own:boolean,a:long,b:long>>")), []
    while True:
        halves = written(live.mapInArrow(_halved, "h1 long, own boolean, a long, b long, key long"), "halves")
        mine = F.count_if("own")
        sizes = halves.groupBy("key").agg(mine.alias("mine"), F.count("*").alias("all"), F.min(F.when(F.col("own"), F.col("h1"))).alias("least")).where("mine > 0 and all > 1")
        sizes = written(sizes.select("key", "least"), "half_sizes")  # so that a join by a common key can be split
        met = written(halves.join(sizes, "key").select("h1", "own", "a", "b", "least"), "halves_met")
        links.append(met.where("b - a = 1 and h1 <> least").select(F.col("least").alias("a"), F.col("h1").alias("b")).distinct())
        further = met.where("b - a > 1").groupBy("h1").agg(F.collect_list(F.struct("own", "a", "b")).alias("regions"))
        if met.where("b - a > 1").isEmpty():
            break
        live = lines.join(further, "h1").select("h1", "line", "regions")
    found = links[0]
    for more in links[1:]:
        found = found.unionByName(more)
    return found.distinct()


def _pairs(index: DataFrame, probes: DataFrame) -> DataFrame:
    """a, b: lines of which one probes (p, key) what the other has in the index (h1, key)."""
    return probes.join(index, "key").where("p <> h1").select(F.least("p", "h1").alias("a"), F.greatest("p", "h1").alias("b")).distinct()


def _crowded(index: DataFrame, probes: DataFrame, crowd: int) -> DataFrame:
    """Keys that make more than `crowd` pairs a line: of lines in the index (h1, key) and lines that probe (p, key)."""
    stored = written(index.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared_keys")
    asked = probes.join(stored, "key", "left_semi").groupBy("key").agg(F.count("*").alias("n_asked"))
    return stored.join(asked, "key").where(F.col("n") * F.col("n_asked") > crowd * (F.col("n") + F.col("n_asked")))


def _texts_of(lines: DataFrame, texts: DataFrame) -> DataFrame:
    """h1 and line of the wanted lines (h1)."""
    wanted = written(lines.select("h1").distinct(), "lines_wanted")
    picked = texts.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted, "h1", "left_semi")
    return written(written(picked, "lines_met").groupBy("h1").agg(F.min("line").alias("line")), "lines_picked")


def _close(pairs: DataFrame, picked: DataFrame, thresholds: Thresholds) -> DataFrame:
    left, right = picked.toDF("a", "left"), picked.toDF("b", "right")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(lambda it: _verified(it, thresholds), "a long, b long")


def _apart_links(met: DataFrame, groups: DataFrame, picked: DataFrame, thresholds: Thresholds) -> DataFrame:
    """Links between lines in different groups (node, component) that share a key (h1, probe, key), enough to join those groups.

    A key's lines are dealt into blocks of about BLOCK_LINES, those of one group together; every two blocks of a key that
    are not of one and the same group are compared in one row. All lines that meet are compared, but their pairs are
    never rows.
    """
    grouped = met.join(groups.toDF("h1", "component"), "h1", "left").withColumn("component", F.coalesce("component", "h1"))
    grouped = written(grouped, "crowd_groups")
    several = grouped.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("least"), F.max("component").alias("most")).where("least < most")
    several = written(several.select("key", F.ceil(F.col("n") / BLOCK_LINES).alias("n")), "keys_of_several")
    dealt = written(grouped.join(several, "key").withColumn("part", F.pmod(F.xxhash64("component"), F.col("n"))).drop("n"), "crowd_parts")
    parts = written(dealt.groupBy("key", "probe", "part").agg(F.ceil(F.count("*") / BLOCK_LINES).alias("n")), "part_sizes")
    block = F.xxhash64("key", "probe", "part", F.pmod(F.xxhash64("h1", F.lit("block")), F.col("n"))).alias("block")
    placed = written(dealt.join(parts, ["key", "probe", "part"]).select("key", "probe", block, "h1", "component"), "crowd_places")
    ends = written(placed.groupBy("key", "probe", "block").agg(F.min("component").alias("least"), F.max("component").alias("most")), "block_groups")
    x, y = ends.where("not probe").alias("x"), ends.where("probe").alias("y")
    pairs = x.join(y, F.col("x.key") == F.col("y.key")).where("least(x.least, y.least) < greatest(x.most, y.most)")
    pairs = written(pairs.select(F.col("x.block").alias("x"), F.col("y.block").alias("y")), "block_pairs")
    lines = placed.join(picked, "h1").groupBy("block").agg(F.collect_list(F.struct("h1", "component", "line")).alias("lines"))
    lines = written(lines, "line_blocks")
    left, right = lines.toDF("x", "left"), lines.toDF("y", "right")
    return pairs.join(left, "x").join(right, "y").select("left", "right").mapInArrow(lambda it: _blocks_verified(it, thresholds), "a long, b long").distinct()


@tidy
def edit_links(rows: DataFrame, texts: DataFrame, thresholds: Thresholds, crowd: int = CROWD) -> DataFrame:
    """a, b: hashes of distinct lines within the allowed edits, enough of them to connect all such lines.

    rows: h1 with own and probes, one row per distinct line; texts: h1 and line, in any number of copies. Lines of
    crowded segments that are one edit apart are linked by halving (see _crowd_links). Those long enough for more edits
    meet again by two segments; where two are crowded as well, lines that are still in different groups are compared by
    blocks (see _apart_links).
    """
    index = rows.select("h1", F.explode("own").alias("key"))
    probes = rows.select(F.col("h1").alias("p"), F.explode("probes").alias("key"))
    crowded = written(_crowded(index, probes, crowd), "crowded")
    pairs = written(_pairs(index.join(crowded, "key", "left_anti"), probes), "line_pairs")
    both = pairs.select(F.explode(F.array("a", "b")).alias("h1"))
    if crowded.isEmpty():
        return _close(pairs, _texts_of(both, texts), thresholds)
    hot = written(index.unionByName(probes.select(F.col("p").alias("h1"), "key")).join(crowded, "key", "left_semi").select("h1").distinct(), "crowd")
    picked = _texts_of(both.unionByName(hot), texts)
    links = _close(pairs, picked, thresholds)
    crowd_lines = picked.join(hot, "h1", "left_semi")
    links = written(links.unionByName(_crowd_links(crowd_lines)), "line_links_of_one_edit")
    if thresholds[-1][1] == 1:
        return links
    long = crowd_lines.where(F.length("line") >= min(n for n, k in thresholds if k > 1))
    split = written(long.mapInArrow(lambda it: _pair_keys(it, thresholds), "h1 long, probe boolean, key long"), "pair_keys")
    index, probes = split.where("not probe").select("h1", "key"), split.where("probe").select(F.col("h1").alias("p"), "key")
    crowded = written(_crowded(index, probes, crowd), "pairs_crowded")
    pairs = written(_pairs(index.join(crowded, "key", "left_anti"), probes), "split_pairs")
    links = written(links.unionByName(_close(pairs, picked, thresholds)), "line_links")
    if crowded.isEmpty():
        return links
    met = written(split.join(crowded, "key", "left_semi"), "crowd_keys")
    return links.unionByName(_apart_links(met, components(links), picked, thresholds))


@tidy
def removed_lines(docs: DataFrame, thresholds: Thresholds, crowd: int = CROWD) -> DataFrame:
    """doc, found: for each document with lines that have a copy, an array of (no, class, earlier).

    no: the line's number from 0; class: its class of lines; earlier: a smaller doc_id has the class. Otherwise the
    document is the class's first, and of equal classes the smallest `no` stays.
    """
    texts = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    schema = "doc long, no int, h1 long, h2 long, own array<long>, probes array<long>"
    lines = written(texts.mapInArrow(lambda it: _line_rows(it, thresholds), schema), "lines")
    # The keys follow from the line: any copy's will do.
    width = _most_keys(thresholds)
    parts = [F.first(F.get(c, F.lit(i))).alias(f"{c}{i}") for c, n in zip(("own", "probes"), width, strict=True) for i in range(n)]
    once = written(lines.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.count("*").alias("n"), *parts), "lines_once")
    rows = once.where("own0 is not null").select(
        "h1", *(F.filter(F.array(*(f"{c}{i}" for i in range(n))), lambda x: x.isNotNull()).alias(c) for c, n in zip(("own", "probes"), width, strict=True))
    )
    lines_of = texts.select("text").mapInArrow(_line_texts, "h1 long, line string")
    linked = components(edit_links(rows, lines_of, thresholds, crowd))
    member = written(linked.unionByName(linked.select(F.col("component").alias("node"), "component")).distinct(), "line_classes")
    with_first = once.select("h1", "first").join(member, F.col("h1") == F.col("node"))
    class_first = with_first.groupBy("component").agg(F.min("first").alias("class_first"))
    classes = member.join(class_first, "component").select("node", "component", "class_first")
    copies = (
        once.select("h1", "h2", "first", "n")
        .join(classes, F.col("h1") == F.col("node"), "left")
        .where("n > 1 or component is not null")
        .select("h1", "h2", F.coalesce("component", "h1").alias("class"), F.coalesce("class_first", "first").alias("class_first"))
    )
    hits = lines.select("doc", "no", "h1", "h2").join(copies, ["h1", "h2"])
    return hits.groupBy("doc").agg(F.collect_list(F.struct("no", "class", (F.col("class_first") < F.col("doc")).alias("earlier"))).alias("found"))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, n_lines, n_removed = [], [], []
        for text, found in zip(batch.column(batch.schema.get_field_index("text")), batch.column(batch.num_columns - 1), strict=True):
            text = text.as_py()
            lines = [] if text is None else text.split("\n")
            gone = set()
            if found.is_valid and len(found):
                no, group, earlier = (found.values.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                gone.update(no[earlier].tolist())
                own: dict = {}
                for k, g in sorted(set(zip(no[~earlier].tolist(), group[~earlier].tolist(), strict=True))):
                    if own.setdefault(g, k) != k:
                        gone.add(k)
            n_lines.append(len(lines))
            n_removed.append(len(gone))
            texts.append(None if text is None else "\n".join(x for k, x in enumerate(lines) if k not in gone))
        more = [
            pa.array(n_lines, pa.int64()),
            pa.array(n_removed, pa.int64()),
            pa.array([None if t is None else hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()),
            pa.array(texts, pa.string()),
        ]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *more], names=[*batch.schema.names[:-1], *_MORE])


_MORE = {"n_lines": "long", "n_removed": "long", "kept_sha256": "string", "kept_text": "string"}


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, crowd: int = CROWD, longer: Thresholds = LONGER) -> DataFrame:
    """docs with n_lines, n_removed, kept_sha256 and kept_text, which replace columns of that name.

    Lines end at "\\n". Lines that are equal, or of `min_chars` characters or more and one edit (a character added,
    dropped or replaced) apart, form a class, with all that such links reach; `longer` allows more edits to longer
    lines, as (characters of the shorter line, edits) in ascending order. Of each class only the line of the
    smallest doc_id, and there of the smallest number, stays. Blank lines always stay. A null text stays null and has
    no lines, an empty one has one blank line; rows without doc_id are kept whole and are no other's first. doc_id is
    taken to be unique but for rows repeated whole, which all get the same result. Texts and lines of any length are
    read whole. Other columns stay, whatever their names.
    """
    docs = docs.drop(*_MORE)
    doc, found = unused(docs, "doc", "found")
    thresholds = ((min_chars, EDITS), *(x for x in longer if x[0] > min_chars))
    gone = removed_lines(docs, thresholds, crowd).toDF(doc, found)
    joined = docs.join(gone, F.col("doc_id") == F.col(doc), "left").drop(doc)
    return joined.mapInArrow(_kept, extended(docs.schema, **_MORE))
