"""Language identification by a bidirectional gated recurrent network over bytes.

A text is cut into sequences of a few whole words, and a sequence's bytes run through one network from each side, so
that its state crosses words; every byte position gets a probability for each language and for none of them, and a
document's probabilities are the mean over all its positions. "None" is learned from sequences whose letters are
shuffled or drawn at random. The network is trained in numpy by backpropagation through time. Sequences that
recur in a chunk of texts are run once and counted as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import extended
from .textbuf import chunks, ranges, word_hashes, words_of

HIDDEN = 8
#: Words of a sequence.
WORDS = 6
#: A longer sequence (in bytes) is cut, at the start of a character.
LONGEST = 64
#: The training sample, both parameters of fit(): about so many documents of each language, and so many sequences spread
#: over each one's whole text.
SAMPLE_DOCS = 400
SAMPLE_SEQUENCES = 12
EPOCHS = 4
BATCH = 256
RATE = 0.01
UNDETERMINED = "und"
#: The share of labelled texts that the calibration of least_score gives up, at most.
GIVEN_UP = 0.01
#: Texts of fewer characters are short to least_score.
SHORT_CHARS = 300
_CHUNK = 1 << 20


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class ByteGRU:
    """Two gated recurrent layers, one from each end, and a softmax at every byte."""

    def __init__(self, n_languages: int, hidden: int = HIDDEN, seed: int = 7):
        r = np.random.default_rng(seed)
        self.hidden = hidden

        def draw(*shape):
            return (r.standard_normal(shape) / np.sqrt(hidden)).astype(np.float32)

        # A side's input table has the update and reset gates' columns, then the candidate's.
        self.weights = {
            name: value
            for side in ("l", "r")
            for name, value in ((f"{side}in", draw(256, 3 * hidden) * 0.3), (f"{side}gates", draw(hidden, 2 * hidden)), (f"{side}cand", draw(hidden, hidden)))
        } | {"out": draw(2 * hidden, n_languages), "bias": np.zeros(n_languages, np.float32)}

    def _run(self, side: str, steps: np.ndarray, trace: list | None) -> np.ndarray:
        """Hidden states; steps and states: time, sequence, ..."""
        w, h = self.weights, self.hidden
        table, gates, cand = w[f"{side}in"], w[f"{side}gates"], w[f"{side}cand"]
        state = np.zeros((steps.shape[1], h), np.float32)
        states = np.empty((*steps.shape, h), np.float32)
        for t, byte in enumerate(steps):
            x = table[byte]
            zr = _sigmoid(x[:, : 2 * h] + state @ gates)
            z, r = zr[:, :h], zr[:, h:]
            new = np.tanh(x[:, 2 * h :] + (r * state) @ cand)
            if trace is not None:
                trace.append((byte, state, z, r, new))
            state = state + z * (new - state)
            states[t] = state
        return states

    def forward(self, words: np.ndarray, traces: tuple[list | None, list | None] = (None, None)) -> tuple[np.ndarray, np.ndarray]:
        """(probabilities, states), at each byte of words of one length (a row each); time comes first."""
        steps = words.T
        states = np.concatenate([self._run("l", steps, traces[0]), self._run("r", steps[::-1], traces[1])[::-1]], axis=2)
        logits = states @ self.weights["out"] + self.weights["bias"]
        e = np.exp(logits - logits.max(axis=2, keepdims=True))
        return e / e.sum(axis=2, keepdims=True), states

    def gradients(self, words: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all positions, and its gradient by each weight."""
        w, h = self.weights, self.hidden
        traces: tuple[list, list] = ([], [])
        probs, states = self.forward(words, traces)
        n = probs.shape[0] * probs.shape[1]
        loss = -np.log(np.maximum(probs[:, np.arange(len(labels)), labels], 1e-12)).mean()
        error = probs.copy()
        error[:, np.arange(len(labels)), labels] -= 1
        error /= n
        grads = {"out": states.reshape(n, -1).T @ error.reshape(n, -1), "bias": error.sum(axis=(0, 1))}
        back = error @ w["out"].T
        for side, trace, part in (("l", traces[0], back[..., :h]), ("r", traces[1], back[::-1, :, h:])):
            table, gates, cand = np.zeros_like(w[f"{side}in"]), np.zeros_like(w[f"{side}gates"]), np.zeros_like(w[f"{side}cand"])
            carry = np.zeros_like(part[0])
            for t in reversed(range(len(trace))):
                byte, before, z, r, new = trace[t]
                d = part[t] + carry
                d_new = d * z * (1 - new * new)
                d_reset = d_new @ w[f"{side}cand"].T
                d_zr = np.concatenate([d * (new - before) * z * (1 - z), d_reset * before * r * (1 - r)], axis=1)
                carry = d * (1 - z) + d_reset * r + d_zr @ w[f"{side}gates"].T
                gates += before.T @ d_zr
                cand += (r * before).T @ d_new
                np.add.at(table, byte, np.concatenate([d_zr, d_new], axis=1))
            grads |= {f"{side}in": table, f"{side}gates": gates, f"{side}cand": cand}
        return float(loss), grads


def train(words: list[bytes], labels: list[int], n_languages: int, epochs: int = EPOCHS, seed: int = 7) -> ByteGRU:
    """Adam on batches of words of one length, in a seeded order."""
    model, r = ByteGRU(n_languages, seed=seed), np.random.default_rng(seed)
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_length.setdefault(len(w), []).append(i)
    batches = []
    for length, rows in sorted(by_length.items()):
        rows = r.permutation(rows)
        matrix = np.frombuffer(b"".join(words[i] for i in rows), np.uint8).reshape(-1, length)
        target = np.array([labels[i] for i in rows])
        batches += [(matrix[k : k + BATCH], target[k : k + BATCH]) for k in range(0, len(rows), BATCH)]
    mean = {k: np.zeros_like(v) for k, v in model.weights.items()}
    square = {k: np.zeros_like(v) for k, v in model.weights.items()}
    step = 0
    for epoch in range(epochs):
        for b in r.permutation(len(batches)):
            step += 1
            _, grads = model.gradients(*batches[b])
            rate = RATE / (1 + epoch) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, g in grads.items():
                mean[k] += 0.1 * (g - mean[k])
                square[k] += 0.001 * (g * g - square[k])
                model.weights[k] -= (rate * mean[k] / (np.sqrt(square[k]) + 1e-8)).astype(np.float32)
    return model


def _sequences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first sequence of each text): WORDS words each with what parts them, cut where they are longer than LONGEST."""
    starts, ends, at = words_of(data, offsets)
    n = np.diff(at)
    heads = ranges(np.zeros(len(n), np.int64), n) % WORDS == 0
    last = np.append(heads[1:], True) if len(heads) else heads
    starts, ends, at = starts[heads], ends[last], np.concatenate([[0], np.cumsum(heads)])[at]
    pieces = -(-(ends - starts) // LONGEST)
    if len(pieces) and pieces.max() > 1:
        first = np.repeat(starts, pieces)
        begin = first + LONGEST * ranges(np.zeros(len(pieces), np.int64), pieces)
        for _ in range(3):  # back to the start of a character, which has up to four bytes
            begin -= (begin > first) & ((data[begin] & 0xC0) == 0x80)
        at = np.concatenate([[0], np.cumsum(pieces)])[at]
        last = np.append(first[1:] != first[:-1], True)
        ends = np.where(last, np.repeat(ends, pieces), np.append(begin[1:], 0))
        starts = begin
    return starts, ends, at


def document_probabilities(model: ByteGRU, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The mean of all positions' probabilities, a row per text (zeros for a text without words)."""
    starts, ends, at = _sequences(data, offsets)
    n_languages = model.weights["out"].shape[1]
    if not len(starts):
        return np.zeros((len(offsets) - 1, n_languages))
    _, first, which = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
    lengths = (ends - starts)[first]
    pooled = np.empty((len(first), n_languages))
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        for k in range(0, len(rows), 2048):
            part = rows[k : k + 2048]
            words = data[starts[first[part]][:, None] + np.arange(length)]
            pooled[part] = model.forward(words)[0].sum(axis=0)
    sums = np.concatenate([np.zeros((1, n_languages)), np.cumsum(pooled[which], axis=0)])
    positions = np.concatenate([[0], np.cumsum(ends - starts)])
    return (sums[at[1:]] - sums[at[:-1]]) / np.maximum(positions[at[1:]] - positions[at[:-1]], 1)[:, None]


def fold(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id), F.lit(folds)).cast("int")


def balanced_sample(rows: DataFrame, label: str, each: int, by: str = "doc_id") -> DataFrame:
    """About `each` rows of every label value, picked by a hash of `by`; the rates come from counts over all rows."""
    counts = {x[0]: x[1] for x in rows.groupBy(label).count().collect()}
    rate = F.lit(0.0)
    for value, n in counts.items():
        rate = F.when(F.col(label) == value, F.lit(min(1.0, each / n))).otherwise(rate)
    return rows.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(by)), F.lit(1 << 30)) < rate * (1 << 30))


def _sampled(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, data, offsets in chunks(batch.column(0), _CHUNK):
            starts, ends, at = _sequences(data, offsets)
            raw = data.tobytes()
            for i in range(last - first):
                k = np.unique(np.linspace(at[i], at[i + 1] - 1, min(most, at[i + 1] - at[i])).astype(int))
                found = [raw[starts[j] : ends[j]] for j in k]
                yield pa.record_batch([pa.array(found, pa.binary()), pa.array([batch.column(1)[first + i].as_py()] * len(found), pa.string())], names=["sequence", "lang"])


def scrambled(text: bytes, r: np.random.Generator, shuffle: bool) -> bytes:
    """The text with its characters other than spaces in another order, or random letters in their place."""
    chars = np.array(list(text.decode("utf-8", "replace")))
    ink = np.flatnonzero(chars != " ")
    chars[ink] = r.permutation(chars[ink]) if shuffle else np.array(list("abcdefghijklmnopqrstuvwxyz"))[r.integers(0, 26, len(ink))]
    return "".join(chars).encode()


def fit(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_sequences: int = SAMPLE_SEQUENCES) -> tuple[ByteGRU | None, list[str]]:
    """(network, languages) from documents with doc_id, text and lang; (None, []) if there are none.

    The network's last output stands for none of the languages.
    About sample_docs documents of a language, sample_sequences sequences each, reach the driver. Languages are numbered
    in text order, so that ties of their probabilities go to the first.
    """
    rows = labelled.where("text is not null and lang is not null and doc_id is not null").select("doc_id", "text", "lang")
    picked = balanced_sample(rows, "lang", sample_docs).select("text", "lang").mapInArrow(lambda it: _sampled(it, sample_sequences), "sequence binary, lang string").toPandas()
    picked = picked.sort_values(["lang", "sequence"])  # rows arrive in any order
    languages = sorted(picked["lang"].unique())
    if not languages:
        return None, []
    codes = {x: i for i, x in enumerate(languages)}
    known, r = [bytes(w) for w in picked["sequence"]], np.random.default_rng(13)
    none = [scrambled(w, r, bool(k % 2)) for k, w in enumerate(known[::2])]
    labels = [codes[x] for x in picked["lang"]] + [len(languages)] * len(none)
    return train(known + none, labels, len(languages) + 1), languages


def _predict(batches: Iterator[pa.RecordBatch], model: ByteGRU | None, languages: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        best, score = [np.zeros(0, int)], [np.zeros(0)]
        for first, last, data, offsets in chunks(batch.column(batch.schema.get_field_index("text")), _CHUNK):
            found = document_probabilities(model, data, offsets)[:, : len(languages)] if model else np.zeros((last - first, 1))
            best.append(found.argmax(axis=1))
            score.append(found.max(axis=1))
        names = pa.array([*languages, UNDETERMINED]).take(pa.array(np.concatenate(best)))
        yield pa.RecordBatch.from_arrays([*batch.columns, names, pa.array(np.minimum(np.concatenate(score), 1.0))], names=[*batch.schema.names, "lang_pred", "score"])


def identify_language(docs: DataFrame, model: ByteGRU | None, languages: list[str]) -> DataFrame:
    """docs with two more columns (which replace any of that name): lang_pred, and score, the mean probability of it over all bytes of the words.

    lang_pred is a learned language; "und" with score 0 for texts that are null or have no letter, and where nothing
    could be learned. Texts of any length are read whole; repeated rows each get the same answer.
    """
    docs = docs.drop("lang_pred", "score")
    schema = extended(docs.schema, lang_pred="string", score="double")
    found = docs.mapInArrow(lambda it: _predict(it, model, languages), schema)
    known = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)) & F.lit(bool(languages))
    return found.withColumns({"lang_pred": F.when(known, F.col("lang_pred")).otherwise(UNDETERMINED), "score": F.when(known, F.col("score")).otherwise(0.0)})


def least_score(known: DataFrame, n_languages: int) -> Column:
    """The score below which a text is in none of the languages, from lang, text, lang_pred and score of all known rows.

    It goes from chance (1 / (n_languages + 1), for none is an answer, too) towards the low quantile of the scores of long texts whose label is met, as
    length / (length + half). `half` is the least that leaves the short texts among them in place, all but GIVEN_UP.
    """
    chance, length = 1 / (n_languages + 1), F.length("text")
    met = known.where("lang = lang_pred").select(length.alias("length"), "score")
    usual = F.percentile_approx("score", GIVEN_UP, 10_000)
    low = met.where(F.col("length") >= SHORT_CHARS).agg(usual).first()[0] or met.agg(usual).first()[0] or chance
    short = met.where((F.col("length") < SHORT_CHARS) & (F.col("score") > chance))
    asked = F.col("length") * (low - F.col("score")) / (F.col("score") - chance)
    half = max(0.0, short.agg(F.percentile_approx(asked, 1 - GIVEN_UP, 10_000)).first()[0] or 0.0)
    return chance + (low - chance) * length / (length + half)
