"""SentencePiece encoding and decoding: the segmentation of highest total score, by a batched Viterbi search in numpy.

Spaces become U+2581 and one stands before the text. No piece has U+2581 behind another character, so the text falls
apart in front of every run of U+2581, and the parts are encoded alone. Many different parts advance together, the
longest first, so that those that have ended drop out behind: at each place the substrings that end there are looked up by hash among the sorted hashes of all pieces, and
the best start is kept as a backpointer. A task keeps the ids of the parts that it has met, up to a bound, since most
parts of a text have stood in the texts before it.

The scores are those of the model file. In a file of merges (BPE) they are minus the merge ranks and no
log-probabilities: the ids are then a Viterbi reading of that vocabulary, which decodes to the same text, and not the
ids that the file's own merges give.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .storage import extended
from .textbuf import Rolling, chunks, mixed, powers_of, ranges

SPACE = 0x2581
#: Stands for U+2581 in a text, which no piece may match, so that texts come back as they were.
_LITERAL = 0x110000
UNKNOWN_PENALTY = 10.0
_BASE = 0xA0761D6478BD642F
#: About so many bytes of text are encoded, and so many ids decoded, at once; longer texts go in slices.
_CHUNK = 1 << 19
_IDS = 1 << 18
_ROWS = 4096
#: Characters of parts, with what fills up the shorter ones, that advance together.
_CELLS = 1 << 18
#: A task keeps the ids of at most so many parts, of at most _KEPT_LENGTH characters.
_KEPT = 1 << 19
_KEPT_LENGTH = 64
_FILTER_BITS = 22


@dataclass
class Vocabulary:
    """Scored pieces (id, text, score), and the ids of the pieces for single bytes."""

    ids: list[int]
    texts: list[str]
    scores: list[float]
    byte_ids: list[int]
    keys: np.ndarray = field(init=False)

    def __post_init__(self):
        points = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in self.texts]
        if any((p[1:] == SPACE)[p[:-1] != SPACE].any() for p in points if len(p) > 1):
            raise ValueError("a piece has U+2581 behind another character")
        if len(self.byte_ids) != 256:
            raise ValueError("the vocabulary lacks pieces for single bytes")
        hashes = np.array([_hash(Rolling(p, _BASE).of(np.array([0]), np.array([len(p)])), len(p))[0] for p in points], np.uint64)
        order = np.argsort(hashes)
        self.keys = hashes[order]
        self.key_ids, self.key_scores = np.array(self.ids, np.int32)[order], np.array(self.scores)[order]
        self.present = np.zeros(1 << _FILTER_BITS, bool)
        self.present[(self.keys >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        self.longest = max(map(len, points))
        self.unknown = min(self.scores) - UNKNOWN_PENALTY
        self.bytes_of = np.array(self.byte_ids, np.int32)
        spelled = {i: t.replace(chr(SPACE), " ").encode() for i, t in zip(self.ids, self.texts, strict=True)} | {i: bytes([b]) for b, i in enumerate(self.byte_ids)}
        parts = [spelled.get(i, b"") for i in range(max(spelled) + 1)]
        self.spelling = np.frombuffer(b"".join(parts), np.uint8)
        self.spelling_at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def _hash(rolled: np.ndarray, length: int) -> np.ndarray:
    return mixed(rolled + np.uint64(length))


def load_vocabulary(path: str) -> Vocabulary:
    """Pieces and scores of a SentencePiece model file (one with pieces for single bytes); read on the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    every = range(model.get_piece_size())
    plain = [i for i in every if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    return Vocabulary(plain, [model.id_to_piece(i) for i in plain], [model.get_score(i) for i in plain], [i for i in every if model.is_byte(i)])


def _best(vocabulary: Vocabulary, parts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ids per part) of parts, a column each, the longest first; an unknown character c is -c - 1."""
    longest, n = parts.shape
    up, down = powers_of(_BASE, longest + 1)
    sums = np.zeros((longest + 1, n), np.uint64)
    np.cumsum((parts.astype(np.uint64) + np.uint64(1)) * up[:longest, None], axis=0, out=sums[1:])
    score = np.full((longest + 1, n), -np.inf)
    score[0] = 0
    back = np.ones((longest + 1, n), np.int8)
    chosen = np.full((longest + 1, n), -1, np.int32)
    shift = np.uint64(64 - _FILTER_BITS)
    for end in range(1, longest + 1):
        m = int(np.searchsorted(-lengths, -end, "right"))  # parts that reach here
        best, size, piece, sum_here = score[end, :m], back[end, :m], chosen[end, :m], sums[end, :m]
        for width in range(min(end, vocabulary.longest), 0, -1):  # of equal totals the longest last piece stays
            h = _hash((sum_here - sums[end - width, :m]) * down[end - width], width)
            rows = np.flatnonzero(vocabulary.present[(h >> shift).astype(np.int64)])
            some = h[rows]
            at = np.searchsorted(vocabulary.keys, some)
            at[at == len(vocabulary.keys)] = 0
            found = vocabulary.keys[at] == some
            rows, at = rows[found], at[found]
            if width == 1:
                single = np.zeros(m, bool)
                single[rows] = True
            total = score[end - width, rows] + vocabulary.key_scores[at]
            better = total > best[rows]
            rows, at = rows[better], at[better]
            best[rows], size[rows], piece[rows] = total[better], width, vocabulary.key_ids[at]
            if width == 1 and not single.all():
                total = score[end - 1, :m] + vocabulary.unknown
                rows = np.flatnonzero(~single & (total > best))
                best[rows], size[rows], piece[rows] = total[rows], 1, -parts[end - 1, rows].astype(np.int64) - 1
    counts, at, steps = np.zeros(n, np.int64), lengths.copy(), []
    live = np.arange(n)
    while len(live):
        steps.append((live, chosen[at[live], live]))
        counts[live] += 1
        at[live] -= back[at[live], live]
        live = live[at[live] > 0]
    last = np.cumsum(counts)
    ids = np.empty(last[-1] if n else 0, np.int32)
    for k, (rows, piece) in enumerate(steps):
        ids[last[rows] - 1 - k] = piece
    return ids, counts


def _as_bytes(vocabulary: Vocabulary, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unknown characters spelled by byte pieces."""
    strange = np.flatnonzero(ids < 0)
    if not len(strange):
        return ids, counts
    points = -ids[strange].astype(np.int64) - 1
    points[points == _LITERAL] = SPACE
    spelled = [chr(p).encode() for p in points.tolist()]
    size = np.ones(len(ids), np.int64)
    size[strange] = [len(s) for s in spelled]
    out = np.repeat(ids, size)
    end = np.cumsum(size)
    where = ranges((end - size)[strange], size[strange])
    out[where] = vocabulary.bytes_of[np.frombuffer(b"".join(spelled), np.uint8)]
    whole = np.concatenate([[0], end])
    last = np.cumsum(counts)
    return out, whole[last] - whole[last - counts]


class Met:
    """The ids of parts met before, by the parts' hashes; when there are too many, those of the last texts alone stay."""

    def __init__(self, most: int = _KEPT):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.keys, self.at, self.counts, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether each key is there, its place)."""
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[place] == keys, place

    def add(self, keys: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        """keys in ascending order, none of which is there; the ids of one stand behind those of the other."""
        if len(self.keys) + len(keys) > self.most:
            self.clear()
        if len(keys) > self.most:
            return
        where = np.searchsorted(self.keys, keys)
        at = len(self.ids) + np.cumsum(counts) - counts
        self.keys, self.at, self.counts = (np.insert(old, where, new) for old, new in ((self.keys, keys), (self.at, at), (self.counts, counts)))
        self.ids = np.concatenate([self.ids, ids])


def encode_buffer(vocabulary: Vocabulary, data: np.ndarray, offsets: np.ndarray, begins: bool = True, met: Met | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ids per text) of a buffer of UTF-8 texts; without `begins` they are slices that begin inside a text."""
    head = (data & 0xC0) != 0x80
    at = np.concatenate([[0], np.cumsum(head)])[offsets]
    sizes = np.diff(at)
    chars = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).copy()
    chars[chars == SPACE] = _LITERAL
    chars[chars == 0x20] = SPACE
    # U+2581 in front of every text that isn't empty.
    filled = np.flatnonzero(sizes > 0)
    if begins:
        chars = np.insert(chars, at[:-1][filled], SPACE)
    new_sizes = sizes + (sizes > 0) * begins
    begin = np.concatenate([[0], np.cumsum(new_sizes)])
    if not len(chars):
        return np.zeros(0, np.int32), np.zeros(len(sizes), np.int64)
    cut = chars == SPACE
    cut[1:] &= chars[:-1] != SPACE
    cut[begin[:-1][filled]] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(chars))
    keys = mixed(Rolling(chars, _BASE).of(starts, ends) + (ends - starts).astype(np.uint64))
    keys, once, which = np.unique(keys, return_index=True, return_inverse=True)
    lengths = (ends - starts)[once]
    found, group_at, group_counts = [], np.zeros(len(once), np.int64), np.zeros(len(once), np.int64)
    total = 0
    old = np.zeros(len(once), bool)
    if met is not None:
        old, place = met.find(keys)
        group_at[old], group_counts[old] = met.at[place[old]], met.counts[place[old]]
        found.append(met.ids)
        total = len(met.ids)
    todo = np.flatnonzero(~old)
    todo = todo[np.argsort(-lengths[todo], kind="stable")]
    while len(todo):
        longest = int(lengths[todo[0]])
        part, todo = todo[: max(1, _CELLS // longest)], todo[max(1, _CELLS // longest) :]
        inside = np.minimum(starts[once[part]] + np.arange(longest)[:, None], len(chars) - 1)  # past a part's end: not read
        ids, counts = _as_bytes(vocabulary, *_best(vocabulary, chars[inside], lengths[part]))
        group_at[part], group_counts[part] = total + np.cumsum(counts) - counts, counts
        total += len(ids)
        found.append(ids)
    pool = np.concatenate(found)
    if met is not None:
        new = np.flatnonzero(~old & (lengths <= _KEPT_LENGTH))
        met.add(keys[new], group_counts[new], pool[ranges(group_at[new], group_counts[new])])
    ids = pool[ranges(group_at[which], group_counts[which])]
    per = np.concatenate([[0], np.cumsum(group_counts[which])])[np.searchsorted(starts, begin)]
    return ids, np.diff(per)


def _slices(data: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """A long text in slices of about `most` bytes, each cut in front of a run of spaces, where the search may be cut."""
    first = 0
    while len(data) - first > most:
        at, cut = first + most, 0
        while not cut and at < len(data):
            part = data[at - 1 : at + most]
            here = np.flatnonzero((part[1:] == 0x20) & (part[:-1] != 0x20))
            cut = at + int(here[0]) if len(here) else 0
            at += most
        if not cut:
            break
        yield data[first:cut]
        first = cut
    yield data[first:]


def encode_text(vocabulary: Vocabulary, data: np.ndarray, most: int = _CHUNK) -> np.ndarray:
    """The ids of one UTF-8 text, however long."""
    found = [encode_buffer(vocabulary, part, np.array([0, len(part)]), begins=not k)[0] for k, part in enumerate(_slices(data, most))]
    return np.concatenate(found)


def decode_buffer(vocabulary: Vocabulary, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts that runs of ids spell; the space in front of each is left out."""
    size = np.diff(vocabulary.spelling_at)[ids]
    spelled = vocabulary.spelling[ranges(vocabulary.spelling_at[ids], size)]
    ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])]
    keep = np.ones(len(spelled), bool)
    first = ends[:-1][np.diff(ends) > 0]
    keep[first[spelled[first] == 0x20]] = False
    return spelled[keep], np.concatenate([[0], np.cumsum(keep)])[ends]


def _spelled(vocabulary: Vocabulary, ids: np.ndarray) -> bytes:
    """The bytes of one long run of ids, in slices."""
    size = np.diff(vocabulary.spelling_at)
    parts = [vocabulary.spelling[ranges(vocabulary.spelling_at[x], size[x])].tobytes() for x in (ids[k : k + _IDS] for k in range(0, len(ids), _IDS))]
    return b"".join(parts).removeprefix(b" ")


def _id_column(vocabulary: Vocabulary, text: pa.Array, first: int, last: int, data: np.ndarray, offsets: np.ndarray, met: Met) -> pa.ListArray:
    if last - first == 1:
        ids, counts = encode_text(vocabulary, data), None
        counts = np.array([len(ids)])
    else:
        ids, counts = encode_buffer(vocabulary, data, offsets, met=met)
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(ids), mask=text.slice(first, last - first).is_null() if text.null_count else None)


def _decoded(vocabulary: Vocabulary, column: pa.ListArray) -> pa.Array:
    counts = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
    null, ends = np.asarray(column.is_null()).tolist(), np.cumsum(counts)
    ids = column.flatten().to_numpy(zero_copy_only=False)
    texts: list[str | None] = []
    first = 0
    while first < len(counts):
        base = ends[first] - counts[first]
        last = max(first + 1, int(np.searchsorted(ends, base + _IDS, "right")))
        part = ids[base : ends[last - 1]]
        if last - first == 1:
            found = [_spelled(vocabulary, part)]
        else:
            data, offsets = decode_buffer(vocabulary, part, counts[first:last])
            raw = data.tobytes()
            found = [raw[a:b] for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)]
        texts += [None if gone else x.decode("utf-8", "replace") for x, gone in zip(found, null[first:last], strict=True)]
        first = last
    return pa.array(texts, pa.string())


def _encode(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, with_text: bool = False) -> Iterator[pa.RecordBatch]:
    met = Met()
    for batch in batches:
        text = batch.column(batch.schema.get_field_index("text"))
        rest = [i for i, name in enumerate(batch.schema.names) if name != "text"]
        names = [*(batch.schema.names[i] for i in rest), "ids", *["decoded"] * with_text]
        for first, last, data, offsets in chunks(text, _CHUNK):
            column = _id_column(vocabulary, text, first, last, data, offsets, met)
            part = batch.slice(first, last - first)
            more = [column, _decoded(vocabulary, column)] if with_text else [column]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in rest), *more], names=names)


def _decode(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, len(batch), _ROWS // 16):  # so that few decoded texts are held at once
            part = batch.slice(first, _ROWS // 16)
            yield pa.RecordBatch.from_arrays([*part.columns, _decoded(vocabulary, part.column(part.schema.get_field_index("ids")))], names=[*part.schema.names, "decoded"])


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """docs with ids (array of piece ids) in place of text; a column named ids is replaced.

    A null text has null ids, an empty one none. Characters without a piece, and U+2581, are spelled by byte pieces.
    Texts of any length are read whole, long ones in slices; rows repeated whole each get the same ids.
    """
    docs = docs.drop("ids")
    return docs.mapInArrow(lambda it: _encode(it, vocabulary), extended(docs.drop("text").schema, ids="array<int>"))


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """encoded with decoded, the text that column ids spells; encode() and decode() give back every text exactly."""
    encoded = encoded.drop("decoded")
    return encoded.mapInArrow(lambda it: _decode(it, vocabulary), extended(encoded.schema, decoded="string"))


def encode_and_decode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """decode(encode(docs)), in one pass: docs with ids and decoded in place of text."""
    docs = docs.drop("ids", "decoded")
    return docs.mapInArrow(lambda it: _encode(it, vocabulary, True), extended(docs.drop("text").schema, ids="array<int>", decoded="string"))
