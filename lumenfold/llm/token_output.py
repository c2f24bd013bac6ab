"""Token-id output: Parquet files of list columns in document order, with page indexes.

Texts are dealt by ranges of their id, sorted, encoded and written: a file holds a range of ids, a
row group about ``row_group_bytes`` and a page about ``page_bytes``, so column and offset indexes let a
reader fetch the tokens of a few documents, or metadata without any tokens. Token ids are dictionary
or delta encoded. Everything that the query returns is read back from the files.

Encoding shows the tokenizers library each distinct unit that a worker meets once. A unit is a
line break, or a space and what follows it up to the next space or line break. The pre-tokenizer of a
byte-level model never joins what stands on both sides of a space or line break between two characters
that are not white space, so units can be encoded apart from their text, and many new ones in a row by one
call: the token that begins with a space (or the line break between units without a space) says where the
next one starts. A text with other white space, or with two such characters in a row, goes through the library whole.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.common import kept, shared_path, slices, strings

#: White space that is neither a space nor a line break.
_OTHER_SPACE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_ASCII_SPACE = [c for c in _OTHER_SPACE if c < "\x80"]
_CUT = "\0"
_MEMO_UNITS = 300_000


def simple(text: str) -> bool:
    """Whether the text can be cut into units."""
    if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or _CUT in text:
        return False
    return not any(c in text for c in (_ASCII_SPACE if text.isascii() else _OTHER_SPACE))


def units_of(text: str) -> list[str]:
    return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split(_CUT)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class UnitEncoder:
    """Encodes texts with a byte-level tokenizer, unit by unit, each distinct unit once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # a special token's string in a text is ordinary text
        shown = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(shown.values()) + 1, bool)  # tokens that begin with a space
        self.spaced[[k for x, k in shown.items() if x[0] == "\u0120"]] = True
        self.line = shown["\u010a"]
        self.reset()

    def reset(self) -> None:
        self.units: dict[str, int] = {"": 0}
        self.starts = np.zeros(2, np.int64)
        self.ids = np.zeros(0, np.int32)
        self.seen = np.zeros(1, np.int64)  # how often each unit stood in a text

    def forget(self) -> None:
        """Keep of the units those that were seen more than once, the most common ones and half of what the memo holds at most."""
        often = np.sort(self.seen)[-(_MEMO_UNITS // 2) :]
        keep = np.flatnonzero(self.seen > max(1, int(often[0])))
        keep = np.append(0, keep[keep > 0])
        names = list(self.units)
        size = np.diff(self.starts)[keep]
        ends = np.cumsum(size)
        self.ids = self.ids[np.repeat(self.starts[keep] - ends + size, size) + np.arange(ends[-1])]
        self.starts = np.append(0, ends)
        self.seen = self.seen[keep] // 2
        self.units = {names[k]: j for j, k in enumerate(keep.tolist())}

    def _together(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)

    def _learn(self, new: list[str]) -> None:
        spaced, plain = [u for u in new if u[0] == " "], [u for u in new if u[0] != " " and u != "\n"]
        ids = self._together("".join(spaced)) if spaced else self.ids[:0]
        sizes = np.diff(np.append(np.flatnonzero(self.spaced[ids]), len(ids)))
        if plain:
            more = self._together("\n".join(plain))
            line = more == self.line
            sizes = np.append(sizes, np.diff(np.concatenate([[-1], np.flatnonzero(line), [len(more)]])) - 1)
            ids = np.append(ids, more[~line])
        known = [*spaced, *plain]
        if len(known) < len(new):
            known.append("\n")
            sizes, ids = np.append(sizes, 1), np.append(ids, np.int32(self.line))
        if len(sizes) != len(known):
            raise ValueError("this tokenizer does not cut at spaces and line breaks")
        self.units.update(zip(known, range(len(self.units), len(self.units) + len(known))))
        self.starts = np.append(self.starts, self.starts[-1] + np.cumsum(sizes))
        self.ids = np.append(self.ids, ids)
        self.seen = np.append(self.seen, np.zeros(len(known), np.int64))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.units) > _MEMO_UNITS:
            self.forget()
        split = [units_of(t) if simple(t) else None for t in texts]
        counts = [len(x) if x else 0 for x in split]
        shown = list(chain.from_iterable(x for x in split if x))
        at = np.fromiter(map(self.units.get, shown, repeat(-1)), np.int64, len(shown))
        new = np.flatnonzero(at < 0)
        if len(new):
            words = [shown[k] for k in new.tolist()]
            self._learn(list(dict.fromkeys(words)))
            at[new] = np.fromiter(map(self.units.__getitem__, words), np.int64, len(words))
        self.seen += np.bincount(at, minlength=len(self.seen))
        start = self.starts[at]
        size = self.starts[at + 1] - start
        ends = np.cumsum(size)
        flat = self.ids[np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        edges = np.concatenate([[0], ends])[np.cumsum([0, *counts])].tolist()
        whole = iter([x.ids for x in self.tokenizer.encode_batch_fast([t for t, x in zip(texts, split) if x is None], add_special_tokens=False)])
        return [flat[a:b] if x is not None else np.array(next(whole), np.int32) for x, a, b in zip(split, edges, edges[1:])]


def encoder(path: str) -> UnitEncoder:
    """The encoder of a tokenizer file; a Python worker keeps it from task to task."""
    return kept(("units", path), lambda: UnitEncoder(path))


def _lists(ids: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)]), pa.int32()))


def _plan_bytes(docs: DataFrame) -> int:
    """Size of the input as the planner knows it, from file sizes; 0 if it does not know."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 0,
    files: int | None = None,
    encoding: str = "dictionary",
    row_group_bytes: int = 16 << 20,
    page_bytes: int = 256 << 10,
    file_bytes: int = 256 << 20,
    chunk: int = 1_000_000,
) -> None:
    """Write ``id_col``, first, n_tokens and ids (list of int) to Parquet under ``path`` in ascending order of the id.

    ``first`` counts the ids that stand before a document's in its file.
    Every text (null: empty) ends with ``end_id``. Null ids come first; rows of the same id stay
    together, ordered by their text. ``encoding`` is ``dictionary`` or ``delta``. There are as many files as the
    session has shuffle partitions, or more where one would take over ``file_bytes`` of the input.
    An empty table writes files without rows.
    """
    tokenizer = tokenizer or tokenizer_path()
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"encoding {encoding!r} is neither dictionary nor delta")
    some = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    parts = files or max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), _plan_bytes(docs) // file_bytes + 1)
    dealt = some.repartitionByRange(parts, id_col).sortWithinPartitions(id_col, "__text")
    schema = some.select(id_col, F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("n_tokens"), F.array().cast("array<int>").alias("ids")).schema

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        end, at = np.array([end_id], np.int32), 0  # a task writes one file
        for batch in slices(batches, "__text", chunk):
            ids = [np.concatenate([x, end]) for x in own.encode(strings(batch, "__text"))]
            sizes = np.array([len(x) for x in ids], np.int64)
            first = at + np.cumsum(sizes) - sizes
            at += int(sizes.sum())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(first), pa.array(sizes), _lists(ids)], names=[id_col, "first", "n_tokens", "ids"])

    options = {"parquet.block.size": str(row_group_bytes), "parquet.page.size": str(page_bytes), "parquet.writer.version": "PARQUET_2_0", "compression": "zstd"}
    if encoding == "dictionary":
        options["parquet.dictionary.page.size"] = str(1 << 20)
    else:
        options["parquet.enable.dictionary"] = "false"
    dealt.mapInArrow(encode, schema).write.options(**options).parquet(path)


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """What the files under ``path`` hold: id, start (ids of all documents before), n_tokens, ids_crc32.

    The totals of the files (one row each, partial sums first) are added up on the driver.
    """
    rows = spark.read.parquet(path).select(id_col, "first", "n_tokens", "ids", F.col("_metadata.file_name").alias("__file"))
    totals = rows.groupBy("__file").agg(F.sum("n_tokens").alias("n")).collect()
    begin, at = [], 0
    for r in sorted(totals, key=lambda r: r["__file"]):  # part-00000-..., in the order of the ranges
        begin.append((r["__file"], at))
        at += r["n"]
    starts = spark.createDataFrame(begin, "__file string, __begin long")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            edges = lists.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(edges, edges[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(edges), pa.int64()), pa.array(crc, pa.int64()), batch.column(3)], names=[id_col, "first", "n_tokens", "ids_crc32", "__file"])

    some = rows.select(id_col, "first", "ids", "__file")
    schema = rows.select(id_col, "first", "n_tokens", F.lit(0).cast("long").alias("ids_crc32"), "__file").schema
    joined = some.mapInArrow(digest, schema).join(F.broadcast(starts), "__file")
    return joined.select(id_col, (F.col("__begin") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def select_tokens(spark: SparkSession, path: str, first: int, last: int, id_col: str = "doc_id") -> DataFrame:
    """id, n_tokens and ids of the documents whose id is from ``first`` to ``last``.

    The bounds reach the scan: files, row groups and pages of other ids are not read. Rows of a repeated id all come,
    rows without an id never do.
    """
    return spark.read.parquet(path).where(F.col(id_col).between(first, last)).select(id_col, "n_tokens", "ids")


def token_counts(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """id and n_tokens of all documents; the column of token ids is not read."""
    return spark.read.parquet(path).select(id_col, "n_tokens")


def token_output(docs: DataFrame, id_col: str = "doc_id", **options: object) -> DataFrame:
    """Write ``docs`` to the shared folder and return what the files say: id, start, n_tokens, ids_crc32."""
    path = shared_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, id_col=id_col, **options)
    return read_tokens(docs.sparkSession, path, id_col)
