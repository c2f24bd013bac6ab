"""Benchmark decontamination by an FM-index for each shard of the training data.

A shard is a few megabytes of documents. Its words become numbers; the index holds the stretches
that are made of benchmark words and are no shorter than the shortest window (other words cannot
take part in a match, so they only separate). On them the shard builds a suffix array, keeps its
Burrows-Wheeler transform in a wavelet matrix with block ranks, and samples suffix positions.
Every benchmark window is searched backwards through the ranks, all windows at once; occurrences
are located by walking to the next sampled position, and their word ranges are merged.

The index does not hold the rest of a shard: a match cannot touch it.

No row is shuffled. The benchmark is read in blocks of a bounded number of bytes; a few blocks are
one broadcast and one pass of the same stage, so a benchmark of any size is searched whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import byte_strings, kept, slices

#: Lower-cases A-Z, keeps digits, letters and all non-ASCII bytes; the rest separates words.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_SPANS = "array<struct<first:int,last:int>>"
_SEPARATOR = 1
#: Blocks of the benchmark that one pass searches.
GROUP = 4


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words of UTF-8 bytes."""
    return text.translate(_FOLD).split()


class WaveletMatrix:
    """Rank over a sequence of small numbers: one bit vector for each bit, ranks kept for each 64 bits."""

    def __init__(self, values: np.ndarray, sigma: int):
        self.n = len(values)
        self.bits = max(1, int(sigma - 1).bit_length())
        self.words: list[np.ndarray] = []
        self.blocks: list[np.ndarray] = []
        self.zeros: list[int] = []
        current = values.astype(np.int64)
        for level in range(self.bits - 1, -1, -1):
            bit = (current >> level) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed = np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)]).view(np.uint64)
            self.words.append(packed)
            self.blocks.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]))
            self.zeros.append(int(self.n - bit.sum()))
            current = np.concatenate([current[bit == 0], current[bit == 1]])

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        word, offset = i >> 6, (i & 63).astype(np.uint64)
        low = self.words[level][word] & ((np.uint64(1) << offset) - np.uint64(1))
        return self.blocks[level][word] + np.bitwise_count(low)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before position i."""
        start = np.zeros_like(i)
        for k in range(self.bits):
            one = (symbol >> (self.bits - 1 - k)) & 1
            a, b = self._ones(k, start), self._ones(k, i)
            start = np.where(one == 1, self.zeros[k] + a, start - a)
            i = np.where(one == 1, self.zeros[k] + b, i - b)
        return i - start

    def access(self, i: np.ndarray) -> np.ndarray:
        value = np.zeros_like(i)
        for k in range(self.bits):
            ones = self._ones(k, i)
            bit = ((self.words[k][i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)
            value = value * 2 + bit
            i = np.where(bit == 1, self.zeros[k] + ones, i - ones)
        return value


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes of ``text`` in order, by prefix doubling; only ties are sorted again."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank = np.empty(n, np.int64)
    new = np.concatenate([[True], text[order][1:] != text[order][:-1]])
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    step = 1
    while True:
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, n))
        tied = np.repeat(size > 1, size)
        if not tied.any():
            return order
        at = np.flatnonzero(tied)
        where = order[at]
        beyond = where + step
        second = np.where(beyond < n, rank[np.minimum(beyond, n - 1)], -1)
        head = rank[where]
        sort = np.lexsort((second, head))
        where, head, second = where[sort], head[sort], second[sort]
        order[at] = where
        new[at] = np.concatenate([[True], (head[1:] != head[:-1]) | (second[1:] != second[:-1])])
        rank[where] = np.maximum.accumulate(np.where(new, np.arange(n), 0))[at]
        step *= 2


class FMIndex:
    """Backward search and location over a sequence of numbers from 0 to ``sigma`` - 1; 0 ends it."""

    def __init__(self, text: np.ndarray, sigma: int, sample: int = 16):
        order = suffix_array(text)
        self.n = len(text)
        self.counts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))]).astype(np.int64)
        self.bwt = WaveletMatrix(text[order - 1], sigma)
        self.sampled = order % sample == 0
        self.place = np.cumsum(self.sampled) - 1
        self.positions = order[self.sampled]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) of each pattern; patterns are right-aligned in a matrix."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for back in range(1, patterns.shape[1] + 1):
            live = np.flatnonzero((lengths >= back) & (hi > lo))
            if not len(live):
                break
            symbol = patterns[live, -back]
            lo[live] = self.counts[symbol] + self.bwt.rank(symbol, lo[live])
            hi[live] = self.counts[symbol] + self.bwt.rank(symbol, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: step back until a sampled one."""
        out, steps = np.empty(len(rows), np.int64), 0
        left = np.arange(len(rows))
        while len(left):
            done = self.sampled[rows]
            out[left[done]] = self.positions[self.place[rows[done]]] + steps
            left, rows = left[~done], rows[~done]
            symbol = self.bwt.access(rows)
            rows = self.counts[symbol] + self.bwt.rank(symbol, rows)
            steps += 1
        return out


class Phrases:
    """Distinct windows of a block of benchmark items, as numbers of their words."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            words = [self.vocabulary.setdefault(w, len(self.vocabulary) + 2) for w in words_of(text)]
            for k in range(max(1, len(words) - window + 1) if words else 0):
                found.setdefault(tuple(words[k : k + window]), set()).add(item)
        self.owners = [sorted(x) for x in found.values()]
        self.lengths = np.array([len(x) for x in found], np.int64)
        self.shortest = int(self.lengths.min()) if found else 0
        self.matrix = np.zeros((len(found), window), np.int64)
        for k, x in enumerate(found):
            self.matrix[k, window - len(x) :] = x


def search_shard(texts: list[bytes], phrases: Phrases) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set[str]]]:
    """Word counts, merged hit ranges of words and found items of each text."""
    get = phrases.vocabulary.get
    numbers = [np.fromiter(map(get, words, repeat(_SEPARATOR)), np.int32, len(words)) for words in map(words_of, texts)]
    counts = np.array([len(x) for x in numbers], np.int64)
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set[str]] = [set() for _ in texts]
    starts = np.concatenate([[0], np.cumsum(counts + 1)])  # a separator after each text
    flat = np.full(starts[-1], _SEPARATOR, np.int32)
    for begin, x in zip(starts, numbers):
        flat[begin : begin + len(x)] = x
    if not phrases.owners or not len(flat):
        return counts, spans, items
    edge = np.diff(np.concatenate([[0], (flat != _SEPARATOR).astype(np.int8), [0]]))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    keep = last - first >= phrases.shortest
    first, last = first[keep], last[keep]
    if not len(first):
        return counts, spans, items
    size = last - first + 1  # with the separator behind it
    origin = np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    text = np.concatenate([flat[origin], [0]]).astype(np.int64)
    index = FMIndex(text, len(phrases.vocabulary) + 2)
    lo, hi = index.search(phrases.matrix, phrases.lengths)
    found = np.flatnonzero(hi > lo)
    if not len(found):
        return counts, spans, items
    each = (hi - lo)[found]
    which = np.repeat(found, each)
    rows = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(lo[found], each)
    begin = origin[index.locate(rows)]
    change = np.zeros(len(flat) + 1, np.int64)
    np.add.at(change, begin, 1)
    np.add.at(change, begin + phrases.lengths[which], -1)
    edge = np.diff(np.concatenate([[0], (np.cumsum(change) > 0).astype(np.int8), [0]]))
    for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
        k = int(np.searchsorted(starts, a, side="right")) - 1
        spans[k].append((a - int(starts[k]), b - int(starts[k])))
    doc = np.searchsorted(starts, begin, side="right") - 1
    for k, w in np.unique(np.stack([doc, which]), axis=1).T.tolist():
        items[k].update(phrases.owners[w])
    return counts, spans, items


def merge(old: list[tuple[int, int]], new: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of two lists of ranges; ranges that touch stay one."""
    out: list[list[int]] = []
    for a, b in sorted([*old, *new]):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _blocks(benchmark: DataFrame, item: str, text: str, most: int) -> Iterator[list[tuple[str, bytes]]]:
    block, held = [], 0
    for row in benchmark.select(F.col(item).cast("string"), text).toLocalIterator():
        if row[0] is None or not row[1]:
            continue
        block.append((row[0], row[1].encode()))
        held += len(row[1])
        if held >= most:
            yield block
            block, held = [], 0
    if block:
        yield block


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 13,
    share: int = 20,
    shard_bytes: int = 6_000_000,
    block_bytes: int = 8_000_000,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row for each row of ``docs``: ``id_col``, ``text_col``, n_words, n_hit, item_ids, spans, contaminated.

    The columns to ``carry`` come along; one that has the name of a column of the result is called ``carried_`` and its name.
    ``spans`` are merged ranges of words (first included, last not) inside any occurrence of a
    benchmark window; a window is ``window`` consecutive words, an item of fewer words is one window.
    ``contaminated``: n_hit > 0 and ``share`` * n_hit >= n_words.
    Null or empty texts have no words and no hits; null ids stay null; repeated rows are judged each; an empty table gives no rows;
    items without an id or without words have no window; items that repeat an id are one item; an empty benchmark hits nothing. Other
    columns of either table are not read.
    """
    spark = docs.sparkSession
    extra = [f"__carry{k}" for k in range(len(carry))]
    out = docs.select(
        F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<string>").alias("item_ids"), F.array().cast(_SPANS).alias("spans"), *[F.col(c).alias(x) for c, x in zip(carry, extra)],
    )
    schema = out.schema
    blocks = _blocks(benchmark, item_col, item_text_col, block_bytes)
    # a few blocks share a pass of the documents; each is an index search of its own
    group = list(islice(blocks, GROUP)) or [[]]
    while group:
        phrases = spark.sparkContext.broadcast([Phrases(block, window) for block in group])

        def search(batches: Iterator[pa.RecordBatch], phrases=phrases) -> Iterator[pa.RecordBatch]:
            kept(("decontamination",), dict)
            for batch in slices(batches, "__text", shard_bytes):
                texts = byte_strings(batch, "__text")
                spans = [[(x["first"], x["last"]) for x in old] for old in batch.column("spans").to_pylist()]
                items = [set(old) for old in batch.column("item_ids").to_pylist()]
                for own in phrases.value:
                    counts, new, found = search_shard(texts, own)
                    spans = [merge(old, more) for old, more in zip(spans, new)]
                    items = [more.union(old) for old, more in zip(items, found)]
                kind = batch.schema.field("spans").type
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(map(sorted, items), pa.list_(pa.string())),
                        pa.array([[{"first": a, "last": b} for a, b in x] for x in spans], kind), *batch.columns[5:],
                    ], names=batch.schema.names,
                )

        out = out.mapInArrow(search, schema)
        group = list(islice(blocks, GROUP))
    hits = F.aggregate("spans", F.lit(0).cast("long"), lambda total, x: total + x["last"] - x["first"])
    out = out.withColumn("n_hit", hits).withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))
    own = [id_col, text_col, "n_words", "item_ids", "spans", "n_hit", "contaminated"]
    names = [f"carried_{c}" if c in own else c for c in carry]
    return out.select(F.col("__id").alias(id_col), F.col("__text").alias(text_col), *own[2:5], *[F.col(x).alias(c) for x, c in zip(extra, names)], *own[5:])


def cut_words(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """``text`` without the characters from the first to the last word of each range."""
    if not text or not spans:
        return text
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return "".join([*out, text[at:]])


def remove_spans(found: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of :func:`find_contamination` that are not contaminated, their hit ranges cut out of the text.

    Null texts stay null, repeated rows are cut each, an empty table gives no rows, all columns come along.
    """
    clean = found.where(~F.col("contaminated"))
    schema = clean.schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index(text_col)
            spans = [[(x["first"], x["last"]) for x in row] for row in batch.column("spans").to_pylist()]
            texts = pa.array(map(cut_words, batch.column(k).to_pylist(), spans), pa.string())
            yield batch.set_column(k, batch.schema.field(k), texts)

    return clean.mapInArrow(cut, schema)
