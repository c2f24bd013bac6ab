"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once with character offsets, and the sorted spans of its
assistant texts are intersected with the sorted token spans by binary search: each token gets the
characters of it that the loss counts. The output keeps the rendered text, the token ids, the
token ends and the masked ranges; the turns and the masked text can be read back from it.

Template, for each turn: ``<|turn|>`` role newline text ``<|end|>`` newline. In roles and texts a
backslash follows the first character of every control string (those of this template and of other
common ones) and every backslash is doubled, so no text can close a turn or open one, and dropping
one backslash of each escape gives the text back.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import kept, shared_path
from lumenfold.llm.token_output import tokenizer_path

OPEN, CLOSE = "<|turn|>", "<|end|>"
#: What texts may not contain as it stands.
CONTROL = ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("(" + "|".join([r"\\", *(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL)]) + ")")


def escape(text: str) -> str:
    r"""Double backslashes; put one behind the first character of each control string."""
    return _CONTROL.sub(r"\1\\", text)


def unescape(text: str) -> str:
    r"""The text that :func:`escape` was given: ``\\`` is a backslash, another backslash is none."""
    return re.sub(r"\\(\\?)", r"\1", text) if "\\" in text else text


def render(turns: list[tuple[str, str]], trained: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The rendered conversation and the spans of the texts of the role that is trained."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape(role).replace(chr(10), chr(92) + 'n')}\n", escape(text)
        out += [head, body, CLOSE, "\n"]
        if role == trained and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(CLOSE) + 1
    return "".join(out), spans


def _role(text: str) -> str:
    if "\\" not in text:
        return text
    return re.sub(r"\\(\\|n|)", lambda m: "\n" if m[1] == "n" else m[1], text)


def parse(rendered: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    out, at = [], 0
    while at < len(rendered):
        line = rendered.index("\n", at)
        end = rendered.index(CLOSE, line)
        out.append((_role(rendered[at + len(OPEN) : line]), unescape(rendered[line + 1 : end])))
        at = end + len(CLOSE) + 1
    return out


def align(starts: np.ndarray, ends: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """token, first and last of each token that shares characters [first, last) with a span.

    Token spans and turn spans are sorted; the tokens of all turn spans are found by binary search at once.
    Tokens that share the bytes of one character share its range.
    """
    spans = np.asarray(spans, np.int64).reshape(-1, 2)
    begin, end = np.searchsorted(ends, spans[:, 0], side="right"), np.searchsorted(starts, spans[:, 1], side="left")
    count = np.maximum(end - begin, 0)
    token = np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())
    first, last = np.maximum(starts[token], np.repeat(spans[:, 0], count)), np.minimum(ends[token], np.repeat(spans[:, 1], count))
    some = first < last
    return token[some], first[some], last[some]


class OffsetEncoder:
    """Token ids of whole texts with the characters that each token covers.

    The tokens of a byte-level model spell a text's bytes one after the other, so offsets are running sums of the tokens'
    lengths; a token that begins or ends inside of a character covers all of it.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # a special token's string in a text is ordinary text
        known = self.tokenizer.get_vocab()
        self.sizes = np.zeros(max(known.values()) + 1, np.int64)
        for piece, k in known.items():
            self.sizes[k] = len(piece)  # one character of the vocabulary stands for a byte

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        out = []
        for text, x in zip(texts, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(x.ids, np.int32)
            ends = np.cumsum(self.sizes[ids])
            data = np.frombuffer(text.encode(), np.uint8)
            if (int(ends[-1]) if len(ends) else 0) != len(data):
                raise ValueError("this tokenizer's tokens do not spell the text's bytes")
            starts = ends - self.sizes[ids]
            if len(data) != len(text):
                character = np.cumsum((data & 0xC0) != 0x80)  # of each byte, counted from 1
                starts, ends = character[starts] - 1, character[ends - 1]
            out.append((ids, starts, ends))
        return out


_MASK = "array<struct<token:int,first:int,last:int>>"


def gathered(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a conversation: its turns in order. A null text or role is empty; a row without an id is a conversation of its own."""
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    alone = F.when(F.col(id_col).isNull(), F.monotonically_increasing_id())
    rows = conversations.select(F.col(id_col).alias("__id"), turn.alias("__turn"), alone.alias("__alone"))
    return rows.groupBy("__id", "__alone").agg(F.sort_array(F.collect_list("__turn")).alias("turns")).select(F.col("__id").alias(id_col), "turns")


def format_chats(
    conversations: DataFrame, tokenizer: str | None = None, id_col: str = "conv_id", trained: str = "assistant", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row a conversation: id, formatted, ids, mask.

    ``formatted`` is the rendered text, ``ids`` its tokens, ``mask`` the tokens under the loss with the
    range of characters that counts. Turns go by ``turn`` (null first), rows of the same turn by role
    and text; null texts and roles are empty; each row with a null id is a conversation of its own; repeated rows
    are repeated turns; an empty table gives no rows. Other columns are not read.
    """
    path = tokenizer or tokenizer_path()
    some = gathered(conversations, id_col, turn_col, role_col, text_col)
    schema = some.select(id_col, F.lit("").alias("formatted"), F.array().cast("array<int>").alias("ids"), F.array().cast(_MASK).alias("mask")).schema

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kept(("chats", path), lambda: OffsetEncoder(path))
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                done = [render([(t["role"], t["text"]) for t in turns], trained) for turns in batch.column(1).to_pylist()]
                coded = own.encode([t for t, _ in done])
                masks = [align(starts, ends, spans) for (_, starts, ends), (_, spans) in zip(coded, done)]
                edges = np.cumsum([0, *(len(m[0]) for m in masks)])
                flat = [pa.array(np.concatenate([m[j] for m in masks]), pa.int32()) for j in range(3)]
                mask = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.StructArray.from_arrays(flat, ["token", "first", "last"]))
                ids = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(x) for x, _, _ in coded)]), pa.int32()), pa.array(np.concatenate([x for x, _, _ in coded]), pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in done], pa.string()), ids, mask], names=[id_col, "formatted", "ids", "mask"])

    return some.mapInArrow(encode, schema)


def masked_text(formatted: str, first: np.ndarray, last: np.ndarray) -> str:
    """All text under the mask, unescaped: the union of the masked ranges (in order), nothing twice, nothing between."""
    if not len(first):
        return ""
    reach = np.maximum.accumulate(last)
    new = np.flatnonzero(np.concatenate([[True], first[1:] > reach[:-1]]))
    ends = np.append(reach[new[1:] - 1], reach[-1])
    return "".join([unescape(formatted[a:b]) for a, b in zip(first[new].tolist(), ends.tolist())])


def read_chats(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """What formatted conversations say: id, turns (role, text), loss_text, formatted_chars.

    Null ids stay null, rows that repeat are read each, an empty table gives no rows; other columns are not read.
    """
    schema = formatted.select(id_col, F.array().cast("array<struct<role:string,text:string>>").alias("turns"), F.lit("").alias("loss_text"), F.lit(0).cast("long").alias("formatted_chars")).schema

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                texts = batch.column(1).to_pylist()
                turns = [[{"role": r, "text": t} for r, t in parse(x)] for x in texts]
                mask = batch.column(2)
                edges, (_, first, last) = mask.offsets.to_numpy().tolist(), (x.to_numpy() for x in mask.values.flatten())
                loss = [masked_text(x, first[a:b], last[a:b]) for x, a, b in zip(texts, edges, edges[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(turns, kind), pa.array(loss, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=[id_col, "turns", "loss_text", "formatted_chars"])

    return formatted.select(id_col, "formatted", "mask").mapInArrow(read, schema)


def chat_format(conversations: DataFrame, id_col: str = "conv_id", **options: object) -> DataFrame:
    """Format, write to the shared folder, and read back: id, turns, loss_text, formatted_chars."""
    spark = conversations.sparkSession
    path = shared_path(spark, "chats")
    format_chats(conversations, id_col=id_col, **options).write.parquet(path)
    return read_chats(spark.read.parquet(path), id_col)
