"""SentencePiece encoding and decoding by a shared-prefix Viterbi.

A text is marked (a space in front, spaces as U+2581) and cut where a mark follows another character;
no piece spans such a place. The distinct marked words of a batch are sorted, which lists the leaves
of their trie in depth-first order; going from one word to the next keeps the forward states of
the common prefix and computes only what is new.

What a forward state holds depends on the model. For a unigram model it is the best total score of a
segmentation of the prefix and its last piece. For a model of merges (BPE) a segmentation is the
encoding exactly if each piece and each pair of neighbours encodes to itself; so a state is the last
piece of the one path that survives, and a transition is open if the pair of pieces is stable. Whether it is
follows from undoing the merges of both pieces next to their border, the latest first: none of the pairs that face
each other on the way may merge before that. Both are one pass over the same lattice, in which only strings that
some piece ends with are looked at. Characters without a piece become byte pieces.

Pieces of several marks are the one case in which scores tie. They score less than all others, so a run of
marks is merged after the word behind it has taken the last one or not: the word goes through the lattice and
the marks that are left through a queue of merges.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lumenfold.llm.common import kept, slices, strings

MARK = "▁"
_UNIT = re.compile(" +[^ ]*")
#: Words and pairs of pieces that a worker remembers; some 200 and 100 bytes each.
_MEMO_WORDS, _MEMO_PAIRS = 120_000, 200_000


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceEncoder:
    """Encodes marked words with the pieces and scores of a SentencePiece model file."""

    def __init__(self, path: str, unigram: bool = False):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.unigram = unigram
        self.vocabulary, self.scores, self.bytes = {}, {}, {}
        self.texts: list[bytes] = []
        for k in range(model.get_piece_size()):
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                self.bytes[int(piece[3:5], 16)] = k
                self.texts.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(k) or model.is_unknown(k):
                self.texts.append(b"")
            else:
                self.vocabulary[piece] = k
                self.scores[k] = model.get_score(k)
                self.texts.append(piece.replace(MARK, " ").encode())
        self.floor = min(self.scores.values()) - 10.0  # of a character without a piece
        self.pieces = {k: p for p, k in self.vocabulary.items()}
        best = sorted(self.scores, key=lambda k: -self.scores[k])
        #: order of merges, the best score first; pieces of one character are there from the start
        self.rank = [-1] * model.get_piece_size()
        for at, k in enumerate(best):
            if len(self.pieces[k]) > 1:
                self.rank[k] = at
        runs = [k for k, p in self.pieces.items() if len(p) > 1 and set(p) == {MARK}]
        self.marks_last = not runs or min(self.rank[k] for k in runs) > max((self.rank[k] for k, p in self.pieces.items() if len(p) > 1 and set(p) != {MARK}), default=-1)
        # all that a piece ends with, and the piece if it is one
        self.tails: dict[str, int] = {p[k:]: -1 for p in self.vocabulary for k in range(1, len(p))}
        self.tails.update(self.vocabulary)
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.stable: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        self.words: dict[str, int] = {}
        self.starts = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.int32)

    def merged(self, word: str) -> list[str]:
        """Merge neighbours, the best score first and the leftmost of equals, until none can be."""
        return self._merge(word)[0]

    def _merge(self, word: str) -> tuple[list[str], tuple[str, str] | None]:
        """The parts that are left, and the last two that were merged."""
        parts: list[str | None] = list(word)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        found = ((self.vocabulary.get(parts[k] + parts[k + 1]), k) for k in range(len(parts) - 1))
        queue = [(-self.scores[p], k, self.pieces[p]) for p, k in found if p is not None]
        heapq.heapify(queue)
        last = None
        while queue:
            _, k, whole = heapq.heappop(queue)
            right = after[k]
            if parts[k] is None or right >= len(parts) or parts[k] + parts[right] != whole:
                continue
            last = parts[k], parts[right]
            parts[k], parts[right] = whole, None
            after[k] = after[right]
            if after[k] < len(parts):
                before[after[k]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b < len(parts):
                    p = self.vocabulary.get(parts[a] + parts[b])
                    if p is not None:
                        heapq.heappush(queue, (-self.scores[p], a, self.pieces[p]))
        return [x for x in parts if x is not None], last

    def _halves(self, piece: int) -> tuple[int, int] | None:
        """The two pieces whose merge makes this one; None if its text does not encode to it."""
        if piece not in self.halves:
            parts, last = self._merge(self.pieces[piece])
            self.halves[piece] = (self.vocabulary[last[0]], self.vocabulary[last[1]]) if last and len(parts) == 1 else None
        return self.halves[piece]

    def merged_alone(self, piece: int) -> bool:
        """Whether the piece's own text encodes to it."""
        return self.rank[piece] < 0 or self._halves(piece) is not None

    def _pair(self, left: int, right: int) -> bool:
        """Whether the texts of two pieces, each of which encodes to itself, encode to these two."""
        pieces, rank, get = self.pieces, self.rank, self.vocabulary.get
        limit = len(rank)
        while True:
            joined = get(pieces[left] + pieces[right])
            if joined is not None and rank[joined] < limit:
                return False
            if rank[left] > rank[right]:  # the left one was merged later: undo that
                limit = rank[left]
                left = self._halves(left)[1]
            elif rank[right] >= 0:  # of equals the left one is merged first, so this border before the right one
                limit = rank[right] + 1
                right = self._halves(right)[0]
            else:
                return True

    def _lookup(self, part: str) -> list[int]:
        found = self.vocabulary.get(part)
        return [found] if found is not None else [self.bytes[b] for c in part for b in c.encode("utf-8", "surrogatepass")]

    def viterbi(self, words: list[str]) -> list[list[int]]:
        """Ids of each of the sorted distinct words; forward states of common prefixes are computed once."""
        tail, stable, many = self.tails.get, self.stable, len(self.texts)
        last: list[int] = [-1]  # of each prefix: the id of its last piece, -1 for a character without one
        size: list[int] = [0]
        score: list[float] = [0.0]
        out, before = [], ""
        for word in words:
            n, most = 0, min(len(word), len(before))
            while n < most and word[n] == before[n]:
                n += 1
            before = word
            del last[n + 1 :], size[n + 1 :], score[n + 1 :]
            for end in range(n + 1, len(word) + 1):
                found, best, length, start = -1, None, 1, end
                while start:
                    start -= 1
                    piece = tail(word[start:end])
                    if piece is None:
                        break
                    if piece < 0:
                        continue
                    if self.unigram:
                        total = score[start] + self.scores[piece]
                        if best is None or total > best:
                            found, best, length = piece, total, end - start
                        continue
                    left = last[start]
                    if left >= 0:
                        key = left * many + piece
                        open_ = stable.get(key)
                        if open_ is None:
                            if len(stable) >= _MEMO_PAIRS:
                                stable.clear()
                            open_ = stable[key] = self.merged_alone(piece) and self._pair(left, piece)
                    else:
                        open_ = self.merged_alone(piece)
                    if open_:  # no other path survives
                        found, length = piece, end - start
                        break
                last.append(found)
                size.append(length)
                if self.unigram:
                    score.append(score[end - 1] + self.floor if best is None else best)
            ids: list[int] = []
            end = len(word)
            while end:
                if last[end] >= 0:
                    ids.append(last[end])
                else:
                    ids += [self.bytes[b] for b in word[end - 1].encode("utf-8", "surrogatepass")[::-1]]
                end -= size[end]
            out.append(ids[::-1])
        return out

    def _learn(self, new: list[str]) -> list[list[int]]:
        """Ids of new words; each is written without its first mark and with spaces for further ones."""
        if self.unigram or not self.marks_last:
            words = [MARK + w.replace(" ", MARK) for w in new]
            if self.unigram:
                order = sorted(range(len(words)), key=words.__getitem__)
                found = dict(zip(order, self.viterbi([words[k] for k in order])))
                return [found[k] for k in range(len(words))]
            return [[k for part in self.merged(w) for k in self._lookup(part)] for w in words]
        ends = sorted({w.lstrip(" ") for w in new})
        known = dict(zip(ends, self.viterbi([MARK + w for w in ends])))
        alone, out = self.vocabulary[MARK], []
        for w in new:
            end = w.lstrip(" ")
            ids = known[end]
            if len(end) < len(w):
                free = len(w) - len(end) + (ids[0] == alone)
                ids = [k for part in self.merged(MARK * free) for k in self._lookup(part)] + (ids[1:] if ids[0] == alone else ids)
            out.append(ids)
        return out

    @staticmethod
    def _words(text: str) -> list[str]:
        """Words without their first mark; further marks of a run are spaces in front."""
        if not text:
            return []
        text = text.replace(MARK, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            return [w[1:] for w in _UNIT.findall(" " + text)]
        return text.split(" ")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts; an empty text has none."""
        if len(self.words) > _MEMO_WORDS:
            self.reset()
        split = [self._words(t) for t in texts]
        new = list(set(chain.from_iterable(split)).difference(self.words))
        if new:
            found = self._learn(new)
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            self.words.update(zip(new, range(len(self.words), len(self.words) + len(new))))
            self.starts = np.append(self.starts, self.starts[-1] + np.cumsum(sizes))
            self.ids = np.append(self.ids, np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum())))
        out = []
        for x in split:
            at = np.fromiter(map(self.words.__getitem__, x), np.int64, len(x))
            start, size = self.starts[at], self.starts[at + 1] - self.starts[at]
            ends = np.cumsum(size)
            out.append(self.ids[np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(x) else 0)])
        return out

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """Text of ids, without the space that marking put in front."""
        texts = self.texts
        out = b"".join([texts[k] for k in (ids.tolist() if isinstance(ids, np.ndarray) else ids)]).decode("utf-8", "replace")
        return out.removeprefix(" ")


    def described(self, ids: list[np.ndarray]) -> list[pa.Array]:
        """Texts, numbers of ids and checksums of lists of ids."""
        return [pa.array(map(self.decode, ids), pa.string()), pa.array(map(len, ids), pa.int64()), pa.array([zlib.crc32(x.astype("<u4")) for x in ids], pa.int64())]


def encoder(path: str, unigram: bool = False) -> PieceEncoder:
    """The encoder of a model file; a Python worker keeps it from task to task."""
    return kept(("pieces", path, str(unigram)), lambda: PieceEncoder(path, unigram))


def lists(ids: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)]), pa.int32()))


def encode_pieces(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text", unigram: bool = False, chunk: int = 1_000_000) -> DataFrame:
    """One row for each row of ``docs``: id, ids (list of int), for whole texts.

    Null and empty texts have no ids. Null ids stay null, repeated rows are encoded each, an empty
    table gives no rows. A literal U+2581 is a space, as in the library. Other columns are not read.
    """
    path = model or model_path()
    some = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    schema = some.select(id_col, F.array().cast("array<int>").alias("ids")).schema

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, unigram)
        for batch in slices(batches, "__text", chunk):
            yield pa.RecordBatch.from_arrays([batch.column(0), lists(own.encode(strings(batch, "__text")))], names=[id_col, "ids"])

    return some.mapInArrow(encode, schema)


def _decoded(rows: DataFrame, id_col: str, more: list[str]) -> StructType:
    columns = [F.lit("").alias("text"), F.lit(0).cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("ids_crc32"), F.array().cast("array<int>").alias("ids")]
    return rows.select(F.col(id_col), *columns[: 3 + len(more)]).schema


def decode_pieces(tokens: DataFrame, model: str | None = None, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row for each row of ``tokens``: id, text, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers).

    With ``with_ids`` the ids come along. A null list is no ids: an empty text. Null ids of rows stay null, repeated
    rows are decoded each, an empty table gives no rows. Other columns are not read, whatever their names.
    """
    path = model or model_path()
    more = ["ids"] if with_ids else []
    schema = _decoded(tokens.select(id_col), id_col, more)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                batch = whole.slice(k, 512)
                ids = [np.array(x or [], np.int32) for x in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), *own.described(ids), *batch.columns[1 : 1 + len(more)]], names=schema.names)

    return tokens.select(id_col, "ids").mapInArrow(decode, schema)


def round_trip(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, chunk: int = 1_000_000) -> DataFrame:
    """What :func:`decode_pieces` makes of :func:`encode_pieces`, both in one pass: no ids travel between two workers.

    The text is decoded from the ids alone. Null and empty texts give an empty text without ids; null ids of rows
    stay null, repeated rows are handled each, an empty table gives no rows. Other columns are not read.
    """
    path = model or model_path()
    some = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    more = ["ids"] if with_ids else []
    schema = _decoded(some, id_col, more)

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in slices(batches, "__text", chunk):
            ids = own.encode(strings(batch, "__text"))
            yield pa.RecordBatch.from_arrays([batch.column(0), *own.described(ids), *([lists(ids)] if with_ids else [])], names=schema.names)

    return some.mapInArrow(both, schema)
