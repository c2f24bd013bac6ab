"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (with its ends marked), each n-gram a row of a hashed
embedding table, so a misspelling that was never seen shares most vectors with the word it hides.
The vectors of the words of a passage are averaged and go through a linear layer and a softmax of
two classes. A document's score is that of its most toxic passage: one insult in a very long text counts
as it does in a short one, and a text does not become more toxic by being longer. A word without any n-gram that
training has met says nothing.

Embeddings and layer start at random and are trained together, from the documents' labels alone:
a toxic document pushes up the passages that look worst, a clean one pushes all of its passages down.

Since the layer after the average is linear, a word's share of a logit is one number; scoring
splits a text, looks each word up and averages. Training reads a bounded sample of labelled rows.
"""

from __future__ import annotations

import gc
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import held_out, id_fold, kept, least_ids, slices, strings, tidy

_LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
#: Words that a worker remembers, some 170 bytes each.
_MEMO_WORDS = 120_000


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(_LETTERS).split()


def grams(word: bytes, low: int, high: int, buckets: int) -> list[int]:
    """Hash buckets of the character n-grams of a word with its ends marked."""
    w = f"<{word.decode('utf-8', 'replace')}>"
    crc = zlib.crc32
    return [crc(w[k : k + n].encode()) % buckets for n in range(low, high + 1) for k in range(len(w) - n + 1)] or [crc(w.encode()) % buckets]


@dataclass
class ToxicityModel:
    key: str
    weights: np.ndarray  # of each bucket: the embedding times the difference of the two classes
    bias: float
    low: int = 3
    high: int = 6
    passage: int = 3

    def score(self, texts: list[str]) -> np.ndarray:
        """Probability that the worst passage of each text is toxic; a text without words scores as the bias does."""
        base = 1 / (1 + np.exp(-self.bias))
        if self.key == "none":  # nothing was learned: the base rate
            return np.full(len(texts), base)
        memo, table = kept(("toxicity", self.key), lambda: ({}, self.weights.tolist()))
        if len(memo) > _MEMO_WORDS:
            memo.clear()
        words = [words_of(t) for t in texts]
        low, high, n = self.low, self.high, len(table)
        for w in set(chain.from_iterable(words)).difference(memo):
            at = grams(w, low, high, n)
            memo[w] = sum([table[k] for k in at]) / len(at)
        counts = np.fromiter(map(len, words), np.int64, len(words))
        each = np.fromiter(map(memo.__getitem__, chain.from_iterable(words)), np.float64, int(counts.sum()))
        some = np.flatnonzero(counts)
        out = np.full(len(texts), base)
        if len(some):
            z, _, doc_start = passages(each[:, None], counts[some], self.passage)
            out[some] = 1 / (1 + np.exp(-np.clip(np.maximum.reduceat(z[:, 0], doc_start) + self.bias, -500, 500)))
        return out


def passages(values: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means of runs of ``size`` words that never cross documents, the words of each run, and each document's first run.

    A last run that is shorter is divided by ``size`` all the same, so that a few words do not weigh more than in the middle.
    """
    runs = -(-counts // size)
    first = np.cumsum(runs) - runs
    place = np.arange(runs.sum()) - np.repeat(first, runs)
    begin = np.repeat(np.cumsum(counts) - counts, runs) + size * place
    length = np.diff(np.append(begin, counts.sum()))
    return np.add.reduceat(values, begin, axis=0) / size, length, first


def train(
    texts: list[str], labels: list[int], dim: int = 4, buckets: int = 1 << 17, epochs: int = 12, batch: int = 32, rate: float = 1.0, decay: float = 1e-5, drop: float = 0.2, seed: int = 7, passage: int = 3, low: int = 3, high: int = 6
) -> ToxicityModel:
    """Fit embeddings and softmax together by AdaGrad on the likelihood of the documents' labels."""
    rng = np.random.default_rng(seed)
    vocabulary: dict[bytes, int] = {}
    docs = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(t)], np.int64) for t in texts]
    y = np.array([k for k, x in zip(labels, docs) if len(x)], np.float64)
    docs = [x for x in docs if len(x)]
    if not docs or y.min() == y.max():
        share = float(np.mean(labels)) if labels else 0.0
        share = min(max(share, 1e-3), 1 - 1e-3)
        return ToxicityModel("none", np.zeros(1), float(np.log(share / (1 - share))), low, high, passage)
    bags = [np.array(grams(w, low, high, buckets), np.int32) for w in vocabulary]
    size = np.array([len(x) for x in bags])
    gram = np.concatenate(bags).astype(np.int64)
    del bags, vocabulary
    used, gram = np.unique(gram, return_inverse=True)
    gram_start = np.cumsum(size) - size
    lengths = np.array([len(x) for x in docs])
    table = rng.normal(0, 0.1, (len(used), dim))
    layer = rng.normal(0, 1.0, (dim, 2))
    bias = np.array([1.0, -1.0])
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    squares = [np.full(x.shape, 1e-8) for x in (table, layer, bias)]
    steps = max(epochs * -(-len(docs) // batch), 500)  # a small sample is read more often
    order = np.zeros(0, np.int64)
    for step in range(steps):
        if len(order) < batch:
            order = np.append(order, rng.permutation(len(docs)))
        at, order = order[:batch], order[batch:]
        # a share of the words is left out of each reading, so that no single one is learned by heart
        some = [docs[k][rng.random(lengths[k]) >= drop] if drop else docs[k] for k in at]
        some = [x if len(x) else docs[k][:1] for k, x in zip(at, some)]
        token, n = np.concatenate(some), np.array([len(x) for x in some])
        word, token = np.unique(token, return_inverse=True)
        bag = size[word]
        start = np.cumsum(bag) - bag
        row, place = np.unique(gram[np.repeat(gram_start[word] - start, bag) + np.arange(bag.sum())], return_inverse=True)
        vector = np.add.reduceat(table[row][place], start) / bag[:, None]
        mean, length, doc_start = passages(vector[token], n, passage)
        runs = np.diff(np.append(doc_start, len(length)))
        logits = mean @ layer + bias
        z = logits[:, 1] - logits[:, 0]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        # toxic: the passages share one push, the worst ones most of it, as much as the worst one still lacks
        worst = np.maximum.reduceat(z, doc_start)
        heat = np.exp(z - np.repeat(worst, runs))
        heat /= np.repeat(np.add.reduceat(heat, doc_start), runs)
        lack = 1 / (1 + np.exp(np.clip(worst, -30, 30)))
        toxic = np.repeat(y[at] == 1, runs)
        dz = np.where(toxic, -np.repeat(lack, runs) * heat, p) * np.repeat(weight[at], runs)
        d_logits = np.stack([-dz, dz], 1)
        d_mean = np.repeat(d_logits @ layer.T / passage, length, axis=0)
        d_vector = np.stack([np.bincount(token, d_mean[:, d], len(word)) for d in range(dim)], 1) / bag[:, None]
        d_row = np.repeat(d_vector, bag, 0)
        d_table = np.stack([np.bincount(place, d_row[:, d], len(row)) for d in range(dim)], 1) + decay * table[row]
        pace = rate * (1 - 0.9 * step / steps)
        squares[0][row] += d_table**2
        table[row] -= pace * d_table / np.sqrt(squares[0][row])
        for k, (value, slope) in enumerate(((layer, mean.T @ d_logits), (bias, d_logits.sum(0))), 1):
            squares[k] += slope**2
            value -= 0.3 * pace * slope / np.sqrt(squares[k])
    weights = np.zeros(buckets)
    weights[used] = table @ (layer[:, 1] - layer[:, 0])
    return ToxicityModel(f"{zlib.crc32(weights.tobytes()):08x}", weights, float(bias[1] - bias[0]), low, high, passage)


def training_rows(
    docs: DataFrame, labels: DataFrame, each: int = 900, longest: int = 40_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> tuple[list[str], list[int]]:
    """At most ``each`` labelled texts of either class that are not held out and not longer than ``longest`` characters.

    They are those of the smallest hash of their id among the labelled rows whose text is there, so the choice is the same
    in every run. Labels that contradict each other for one id, null ids, null labels and null texts teach nothing; of
    rows that repeat an id one teaches. Ids alone are shuffled; texts are read where they are.
    """
    said = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).alias("__label"), F.max(label_col).alias("__most"))
    said = said.where("__label = __most").select("__id", F.col("__label").cast("int").alias("__label"))
    texts = docs.where(F.col(text_col).isNotNull() & (F.length(text_col) <= longest) & (id_fold(id_col) != 1)).select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    ids = least_ids(texts.select("__id").join(said, "__id"), "__id", "__label", each)
    if not ids:
        return [], []
    chosen = docs.sparkSession.createDataFrame(ids, texts.select("__id", F.lit(0).alias("__label")).schema)
    found = texts.join(F.broadcast(chosen), "__id").groupBy("__id", "__label").agg(F.min("__text").alias("__text"))
    rows = sorted((r["__label"], r["__text"]) for r in found.collect())
    return [t for _, t in rows], [k for k, _ in rows]


def fit_toxicity(docs: DataFrame, labels: DataFrame, each: int = 900, longest: int = 40_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **options: object) -> ToxicityModel:
    model = train(*training_rows(docs, labels, each, longest, id_col, text_col, label_col), **options)
    gc.collect()
    tidy()  # what training took is not needed again, and a driver that goes on would keep it
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, chunk: int = 1_000_000) -> DataFrame:
    """One row for each row of ``docs``: ``id_col``, held_out, score, predicted.

    Null and empty texts get the score of a passage without words. Null ids stay null and are not
    held out; repeated rows are scored each; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    some = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    schema = some.select(id_col, F.lit(0.0).alias("score")).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text", chunk):
            scores = shared.value.score(strings(batch, "__text"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=[id_col, "score"])

    out = some.mapInArrow(score, schema)
    return out.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.7, chunk: int = 1_000_000) -> DataFrame:
    """The rows of ``docs`` that score less than ``threshold``, with all their columns.

    A null or empty text scores as in :func:`score_toxicity`; repeated rows stay or go together; an empty table
    gives no rows; other columns are carried, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, chunk):
            yield batch.filter(pa.array(shared.value.score(strings(batch, text_col)) < threshold))

    return docs.mapInArrow(keep, docs.schema)
