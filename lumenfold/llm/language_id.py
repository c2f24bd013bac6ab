"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of a whole text (A-Z lower-cased) in both directions; at every byte a softmax
over both states labels the position, and the label probabilities of all positions of a document are
averaged: the largest mean names the language and is the score. Weights are trained in numpy by
backpropagation through time.

So that texts of any length advance together, a text is cut into windows of ``WINDOW`` bytes. A window is read
with ``CONTEXT`` more bytes on both sides, whose labels belong to its neighbours: the states have read
these when they reach the first byte that counts. The unit has one gate, which says how much of the state is
renewed.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import held_out, id_fold, kept, least_ids, slices, strings

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_LETTER = re.compile(r"[^\W\d_]")
WINDOW, CONTEXT = 160, 16
#: Stands for the places before and after a text; such a byte in a text is labelled but leaves the states as they are.
_OUTSIDE = 0


def bytes_of(text: str) -> bytes:
    return text.encode("utf-8", "replace").translate(_LOWER)


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows as columns of a matrix (position, window), the number of own bytes of each, and its text.

    Own bytes stand from ``CONTEXT`` on; outside of the text the matrix is zero.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    count = -(-sizes // WINDOW)
    text = np.repeat(np.arange(len(texts)), count)
    first = WINDOW * (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count))
    # each text with room for the context on both sides
    edge = bytes(CONTEXT)
    flat = np.frombuffer(b"".join([x for t in texts for x in (edge, t, edge)]) + bytes(WINDOW), np.uint8)
    start = (np.cumsum(sizes + 2 * CONTEXT) - sizes - 2 * CONTEXT)[text] + first
    matrix = flat[start[None, :] + np.arange(WINDOW + 2 * CONTEXT)[:, None]]
    own = np.minimum(WINDOW, sizes[text] - first)
    # what follows a short last window belongs to the next text
    short = np.flatnonzero(own < WINDOW)
    matrix[:, short] *= np.arange(WINDOW + 2 * CONTEXT)[:, None] < own[short] + CONTEXT
    return matrix, own, text


@dataclass
class Direction:
    """A recurrent layer whose gate z renews the state: h + z * (tanh(candidate) - h)."""

    table: np.ndarray  # (256, 2 H): a byte's part of gate and candidate, its bias included
    inner: np.ndarray  # (H, 2 H): the state's part

    def run(self, codes: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]]]:
        """States (position, window, H); with ``keep`` what the way back needs."""
        h, n = self.inner.shape[0], codes.shape[1]
        scale = np.repeat(np.array([0.5, 1.0], np.float32), h)  # sigmoid(x) = 0.5 + 0.5 * tanh(x / 2)
        table, inner = self.table * scale, self.inner * scale
        table[_OUTSIDE, :h] = -1e4  # no gate opens: the state is that before a text's first byte
        states, kept_ = np.empty((codes.shape[0], n, h), np.float32), []
        state, both, own = np.zeros((n, h), np.float32), np.empty((n, 2 * h), np.float32), np.empty((n, 2 * h), np.float32)
        for t in range(codes.shape[0]):
            np.take(table, codes[t], axis=0, out=own, mode="clip")
            np.matmul(state, inner, out=both)
            both += own
            np.tanh(both, out=both)
            gate, candidate = both[:, :h], both[:, h:]
            gate *= 0.5
            gate += 0.5
            if keep:
                kept_.append((state.copy(), gate.copy(), candidate.copy()))
            after = states[t]
            np.subtract(candidate, state, out=after)
            after *= gate
            after += state
            state = after
        return states, kept_

    def back(self, codes: np.ndarray, kept_: list[tuple[np.ndarray, ...]], slope: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backpropagation through time: slopes of ``table`` and ``inner`` from those of the states."""
        d_table, d_inner = np.zeros_like(self.table), np.zeros_like(self.inner)
        d_state, all_gates = np.zeros_like(slope[0]), np.empty((codes.shape[0], codes.shape[1], self.table.shape[1]), np.float32)
        for t in range(codes.shape[0] - 1, -1, -1):
            state, gate, candidate = kept_[t]
            d_state = d_state + slope[t]
            d_gates = np.concatenate([d_state * (candidate - state) * gate * (1 - gate), d_state * gate * (1 - candidate**2)], 1)
            d_inner += state.T @ d_gates
            all_gates[t] = d_gates
            d_state = d_state * (1 - gate) + d_gates @ self.inner.T
        flat, places = all_gates.reshape(-1, all_gates.shape[2]), codes.reshape(-1)
        for j in range(flat.shape[1]):
            d_table[:, j] = np.bincount(places, flat[:, j], 256)
        return d_table, d_inner


@dataclass
class LanguageModel:
    key: str
    languages: list[str]
    forward: Direction
    backward: Direction
    layer: np.ndarray  # (2 H, languages)
    bias: np.ndarray

    def label(self, codes: np.ndarray) -> np.ndarray:
        """Label probabilities (position, window, language) of the places between the contexts."""
        inside = slice(CONTEXT, codes.shape[0] - CONTEXT)
        h = self.forward.inner.shape[0]
        # the last bytes of a window are context to the way ahead, the first ones to the way back
        ahead = self.forward.run(codes[: codes.shape[0] - CONTEXT])[0][CONTEXT:]
        behind = self.backward.run(codes[::-1][: codes.shape[0] - CONTEXT])[0][CONTEXT:][::-1]
        logits = ahead.reshape(-1, h) @ self.layer[:h]
        logits += behind.reshape(-1, h) @ self.layer[h:]
        logits += self.bias
        logits -= logits.max(1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(1, keepdims=True)
        return logits.reshape(inside.stop - inside.start, codes.shape[1], -1)

    def means(self, texts: list[str], block: int = 1024) -> np.ndarray:
        """Mean label probabilities over all bytes of each text; zero for an empty one."""
        total = np.zeros((len(texts), len(self.languages)))
        matrix, own, text = windows_of([bytes_of(t) for t in texts])
        for a in range(0, len(own), block):
            n = own[a : a + block]
            height = int(n.max())  # short texts need fewer steps
            codes = matrix[: height + 2 * CONTEXT, a : a + block]
            labels = self.label(codes)
            if n.min() < height:
                labels *= (np.arange(height)[:, None] < n)[:, :, None]
            np.add.at(total, text[a : a + block], labels.sum(0))
        return total / np.maximum(total.sum(1, keepdims=True), 1e-30)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; ``und`` and 0 for a text without a letter."""
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        letters = [bool(_LETTER.search(t)) for t in texts]
        # texts of like length share their blocks
        order = sorted((k for k, some in enumerate(letters) if some), key=lambda k: len(texts[k]))
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        for k, mean in zip(order, self.means([texts[k] for k in order])):
            best = int(mean.argmax())
            names[k], scores[k] = self.languages[best], mean[best]
        return names, np.clip(scores, 0.0, 1.0)


def train(texts: list[str], names: list[str], hidden: int = 10, windows_each: int = 2_400, length: int = 64, epochs: int = 4, batch: int = 96, rate: float = 0.02, seed: int = 3) -> LanguageModel:
    """Fit the network on stretches of ``length`` bytes drawn from the texts, as many of each language; Adam, cross-entropy at every position."""
    languages = sorted(set(names))
    rng = np.random.default_rng(seed)
    many = len(languages)

    def start(*shape: int) -> np.ndarray:
        return rng.normal(0, 0.25, shape).astype(np.float32)

    weights = [start(256, 2 * hidden), start(hidden, 2 * hidden), start(256, 2 * hidden), start(hidden, 2 * hidden), start(2 * hidden, many), np.zeros(many, np.float32)]
    pieces, target = [], []
    for k, name in enumerate(languages if many > 1 else []):
        own = [b for b in (bytes_of(t) for t, x in zip(texts, names) if x == name) if b]
        if not own:
            continue
        sizes = np.array([len(b) for b in own])
        for j in rng.choice(len(own), windows_each, p=sizes / sizes.sum()):
            at = int(rng.integers(0, max(1, len(own[j]) - length + 1)))
            pieces.append(own[j][at : at + length].ljust(length, b"\0"))
            target.append(k)
    codes_all = np.frombuffer(b"".join(pieces), np.uint8).reshape(-1, length)
    target = np.array(target)
    first, second = [np.zeros_like(x) for x in weights], [np.zeros_like(x) for x in weights]
    step, total = 0, max(1, epochs * -(-len(pieces) // batch))
    for _ in range(epochs if len(pieces) else 0):
        order = rng.permutation(len(pieces))
        for a in range(0, len(pieces), batch):
            at = order[a : a + batch]
            codes = codes_all[at].T
            ahead, behind = Direction(weights[0], weights[1]), Direction(weights[2], weights[3])
            states_a, kept_a = ahead.run(codes, True)
            states_b, kept_b = behind.run(codes[::-1], True)
            both = np.concatenate([states_a, states_b[::-1]], 2)
            logits = both @ weights[4] + weights[5]
            p = np.exp(logits - logits.max(2, keepdims=True))
            p /= p.sum(2, keepdims=True)
            p[:, np.arange(len(at)), target[at]] -= 1
            inside = (codes != _OUTSIDE).astype(np.float32)
            p *= (inside / max(1.0, float(inside.sum())))[:, :, None]
            d_both = p @ weights[4].T
            slopes = [*ahead.back(codes, kept_a, d_both[:, :, :hidden]), *behind.back(codes[::-1], kept_b, d_both[::-1, :, hidden:]), np.tensordot(both, p, ([0, 1], [0, 1])), p.sum((0, 1))]
            step += 1
            pace = rate * (1 - 0.9 * step / total)
            for value, slope, m, v in zip(weights, slopes, first, second):
                m += 0.1 * (slope - m)
                v += 0.01 * (slope * slope - v)
                value -= pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    key = f"{zlib.crc32(b''.join(w.tobytes() for w in weights) + ' '.join(languages).encode()):08x}"
    return LanguageModel(key, languages, Direction(weights[0], weights[1]), Direction(weights[2], weights[3]), weights[4], weights[5])


def training_rows(docs: DataFrame, each: int = 250, most: int = 16_000, longest: int = 20_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], list[str]]:
    """At most ``each`` texts of each language, none held out, none over ``longest`` characters.

    Every language that labels a text takes part; with many of them each one has fewer texts, so that ``most``
    texts come in all, but one of each at least. The choice is by the smallest hash of the id, the same in every run. Null texts and
    languages and held-out rows are not read; of rows that repeat an id and a language one teaches.
    """
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & (F.length(text_col) <= longest) & (id_fold(id_col) != 1))
    rows = rows.select(F.col(id_col).alias("__id"), F.col(lang_col).alias("__lang"), F.col(text_col).alias("__text"))
    ids = least_ids(rows, "__id", "__lang", each)
    many = len({lang for _, lang in ids})
    if len(ids) > max(most, many):
        bound, seen, fewer = max(1, most // many), {}, []
        for x in ids:
            seen[x[1]] = seen.get(x[1], 0) + 1
            if seen[x[1]] <= bound:
                fewer.append(x)
        ids = fewer
    if not ids:
        return [], []
    chosen = docs.sparkSession.createDataFrame(ids, rows.select("__id", "__lang").schema)
    found = rows.join(F.broadcast(chosen), ["__id", "__lang"]).groupBy("__id", "__lang").agg(F.min("__text").alias("__text"))
    texts = sorted((r["__lang"], r["__text"]) for r in found.collect())
    return [t for _, t in texts], [lang for lang, _ in texts]


def fit_language_model(docs: DataFrame, each: int = 250, most: int = 16_000, longest: int = 20_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options: object) -> LanguageModel:
    return train(*training_rows(docs, each, most, longest, id_col, text_col, lang_col), **options)


def identify_language(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", chunk: int = 1_000_000) -> DataFrame:
    """One row for each row of ``docs``: ``id_col``, held_out, lang_pred, score.

    A null text or one without a letter is ``und`` with score 0, as is every text if the model has
    learned no language. Null ids stay null and are not held out; repeated rows are judged each; an
    empty table gives no rows. Only the id and the text are read, every byte of it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    some = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    schema = some.select(id_col, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kept(("language", shared.value.key), lambda: shared.value)
        for batch in slices(batches, "__text", chunk):
            names, scores = own.predict(strings(batch, "__text"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[id_col, "lang_pred", "score"])

    return some.mapInArrow(judge, schema).select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")
