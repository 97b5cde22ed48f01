"""Shape features of whole texts: shares of character kinds, repetition of words, lengths."""

from __future__ import annotations

import numpy as np

from .textbuf import SPACE, word_hashes, words_of

#: Kinds of bytes whose share of the text is a feature.
KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "blank": b" \t",
    "newline": b"\n",
    "other_letter": bytes(range(128, 256)),
    "stop": b".?",
    "comma": b",;:",
    "bang": b"!",
    "bar": b"|",
    "symbol": b"#$%&*@^~+=<>\\_",
    "bracket": b"()[]{}'\"`-/",
}
FEATURES = [*KINDS, "word_length", "distinct_words", "repeated_neighbours", "words_per_line", "log_words", "largest_symbol"]
_KIND_OF = np.zeros((256, len(KINDS)))
for _k, _bytes in enumerate(KINDS.values()):
    _KIND_OF[list(_bytes), _k] = 1


def _per_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[at[1:]] - sums[at[:-1]]


def text_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, number of words) of each text, a row per text and a column per name in FEATURES."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    row = np.repeat(np.arange(n, dtype=np.int64), size)
    histogram = np.bincount(row * 256 + data, minlength=256 * n).reshape(n, 256)
    shares = histogram @ _KIND_OF / np.maximum(size, 1)[:, None]
    starts, ends, at = words_of(data, offsets)
    words = np.diff(at)
    hashes = word_hashes(data, starts, ends)
    word_row = np.repeat(np.arange(n, dtype=np.int64), words)
    salted = hashes ^ (word_row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first = np.unique(salted, return_index=True)
    distinct = np.bincount(word_row[first], minlength=n)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (word_row[1:] == word_row[:-1])
    inked = size - histogram[:, SPACE].sum(axis=1)
    many = np.maximum(words, 1)
    lines = histogram[:, 10] + 1
    symbols = histogram[:, list(KINDS["symbol"])].max(axis=1, initial=0) / np.maximum(size, 1)
    rest = [inked / many / 10, distinct / many, _per_text(same, at) / many, np.log1p(words / lines), np.log1p(words), symbols]
    return np.column_stack([shares, *rest]), words
