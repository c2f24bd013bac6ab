"""Exact substring dedup by distributed prefix doubling over content-defined positions.

A byte is removed if a string of ``length`` bytes that covers it also starts anywhere else. Doubling
over every byte position would sort 16 bytes a byte several times; here the positions are anchors,
the places where the hash of ``GRAM`` bytes is the least of ``REACH`` neighbours. Which places those are
depends on nearby bytes only, so equal strings have the same anchors but near their ends.

1. Each text's anchors cut it into phrases; a phrase's first rank is its hash. Ranks that stand at one
   position only leave at once (most of them).
2. Position-rank pairs at growing offsets, 1, 2, 4, ... phrases: Spark groups equal pairs, the least
   position of a group is the new rank, positions whose pair is unique leave. A position whose run goes
   ``length`` bytes beyond the next anchor is past the threshold: its run repeats, and so does every string of ``length`` bytes
   that starts between the two anchors. This decides all bytes of repeated passages but those near their ends.
3. What is left open are strings near the ends, which reach beyond the anchors of a repeated run. They are settled in blocks
   of 32 neighbours, of 8 and one by one: if what all strings of a block have in common is unique, none of them repeats;
   if what any of them covers repeats, all do; only blocks between the two are cut into smaller ones. Strings inside of
   repeated runs take part as the other occurrence only, and of each run one position speaks for all.

Positions belong to distinct texts (by md5), so copies of a text are one text to all of this; a text that
occurs twice and has ``length`` bytes goes whole. Ranks are 64 bits: two of n unequal strings are taken for
equal with a chance of about n**2 / 2**65.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import byte_strings, kept, slices, spent, written
from lumenfold.llm.shingles import mix, powers, prefix_hashes

GRAM, REACH, STEPS = 16, 96, (32, 8, 1)
#: Up to so many bytes a side is broadcast after it has been measured; beyond, it is shuffled, but for keys of over ``HOT`` rows.
BROADCAST_BYTES, HOT = 64 << 20, 10_000
_SEED = np.uint64(0xA0761D6478BD642F)


def _hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer(text, np.uint8)
    return prefix_hashes(codes), powers(len(codes))[1]


def anchors_of(texts: list[bytes], length: int, named: bool = False) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Anchor positions of each text and, if asked for, the hashes of its phrases (anchor to the end of the next one's gram).

    A text shorter than ``length`` has none.
    """
    some = [k for k, t in enumerate(texts) if len(t) >= length]
    places, names = [np.zeros(0, np.int64)] * len(texts), [np.zeros(0, np.uint64)] * len(texts)
    if not some:
        return places, names
    prefix, down = _hashes(b"".join(texts[k] for k in some))
    ends = np.cumsum([len(texts[k]) for k in some])
    starts = ends - [len(texts[k]) for k in some]
    n = len(prefix) - GRAM
    gram = mix((prefix[GRAM:] - prefix[:-GRAM]) * down[:n])
    # the high half orders, the low half says where: the least is the leftmost of equals
    gram &= np.uint64(0xFFFFFFFF00000000)
    gram |= np.arange(n, dtype=np.uint64)
    least, width = gram, 1
    while 2 * width <= REACH:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(least) - (REACH - width)], least[REACH - width :]) if width < REACH else least
    least = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    chosen = least[new]  # of all stretches, those across two texts included
    first, last = np.searchsorted(new, starts, side="right") - 1, np.searchsorted(new, ends - GRAM - REACH + 1, side="right")
    for k, a, f, e in zip(some, starts.tolist(), first.tolist(), last.tolist()):
        own = chosen[f:e]
        places[k] = own - a
        if named:
            names[k] = mix((prefix[own[1:] + GRAM] - prefix[own[:-1]]) * down[own[:-1]] + (own[1:] - own[:-1]).astype(np.uint64) * _SEED)
    return places, names


def needed(places: np.ndarray, length: int) -> np.ndarray:
    """For each phrase, how many from it on reach ``length`` bytes beyond its end; 0 if the text ends before."""
    end = np.searchsorted(places, places[1:] + length - GRAM, side="left")
    return np.where(end < len(places), end - np.arange(len(places) - 1), 0)


def open_starts(places: np.ndarray, alive: np.ndarray, size: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of strings that could repeat: first inner anchor, least and largest start.

    Inner anchors are those whose choice depends on the string's bytes only. ``alive``: phrases whose rank repeats. Both
    occurrences of a string that repeats have its inner anchors in common, so all phrases between them repeat.
    """
    reach = length - GRAM - (REACH - 1)  # from a start to the furthest place of an inner anchor
    low = np.maximum(np.concatenate([[0], places[:-1] - REACH + 2]), places - reach).clip(min=0)
    high = np.minimum(places - REACH + 1, size - length)
    dead = np.flatnonzero(~alive)
    next_dead = np.searchsorted(dead, np.arange(len(places)))
    bounded = np.flatnonzero(next_dead < len(dead))
    high[bounded] = np.minimum(high[bounded], places[dead[next_dead[bounded]] + 1] - reach - 1)
    some = low <= high
    return places[some], low[some], high[some]


def start_runs(ranges: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs (first, last) of the starts of strings that one of the (first, last) byte ranges holds."""
    ranges = ranges[ranges[:, 1] - ranges[:, 0] >= length]
    if not len(ranges):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(ranges[:, 0], kind="stable")
    first, last = ranges[order, 0], np.maximum.accumulate(ranges[order, 1] - length)
    new = np.flatnonzero(np.concatenate([[True], first[1:] > last[:-1] + 1]))
    return first[new], np.append(last[new[1:] - 1], last[-1])


def all_in(runs: tuple[np.ndarray, np.ndarray], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether all starts from ``low`` to ``high`` are in one of the runs."""
    k = np.searchsorted(runs[0], low, side="right") - 1
    return (k >= 0) & (runs[1][k] >= high) if len(runs[0]) else np.zeros(len(low), bool)


def any_in(runs: tuple[np.ndarray, np.ndarray], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether any start from ``low`` to ``high`` is in one of the runs."""
    k = np.searchsorted(runs[0], high, side="right") - 1
    return (k >= 0) & (runs[1][k] >= low) if len(runs[0]) else np.zeros(len(low), bool)


def merge_ranges(ranges: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the bytes in any of the ranges."""
    if not len(ranges):
        return []
    ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
    end = np.maximum.accumulate(ranges[:, 1])
    new = np.concatenate([[True], ranges[1:, 0] > end[:-1]])
    at = np.flatnonzero(new)
    return list(zip(ranges[at, 0].tolist(), np.append(end[at[1:] - 1], end[-1]).tolist()))


def _text_key(text_col: str) -> F.Column:
    return F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))


def _limited(df: DataFrame, size: int) -> DataFrame:
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def _repeated(pairs: DataFrame, *keys: str) -> DataFrame:
    """Keys that stand at two positions or more, with the least as their rank and the number of their rows."""
    return pairs.groupBy(*keys).agg(F.min("pid").alias("rank"), F.max("pid").alias("most"), F.count("*").alias("c")).where("rank <> most").drop("most")


def _ranked(rows: DataFrame, same: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Rows with the rank of their key. ``same`` is a written table of :func:`_repeated`; its hot keys are always broadcast."""
    if 64 * same.count() <= BROADCAST_BYTES:
        return rows.join(F.broadcast(same.drop("c")), keys, how)
    hot, cold = same.where(F.col("c") > HOT).drop("c"), same.where(F.col("c") <= HOT).drop("c")
    if how == "inner":
        return rows.join(cold, keys).unionByName(rows.join(F.broadcast(hot), keys))
    named = rows.join(F.broadcast(hot), keys, how)
    rest = named.where("rank is null").drop("rank").join(cold, keys, how)
    return named.where("rank is not null").unionByName(rest)


def _phrases(texts: DataFrame, length: int, chunk: int) -> DataFrame:
    schema = "t binary, need array<int>, rank array<long>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept(("suffix_dedup",), dict)
        for batch in slices(batches, "text", chunk):
            places, names = anchors_of(byte_strings(batch, "text"), length, named=True)
            need = [needed(p, length) if len(p) else p for p in places]
            edges = pa.array(np.cumsum([0, *map(len, names)]), pa.int32())
            lists = [pa.ListArray.from_arrays(edges, pa.array(x)) for x in (np.concatenate(need).astype(np.int32), np.concatenate(names).view(np.int64))]
            keep = pa.array([len(x) > 0 for x in names])
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.binary()), *lists], names=["t", "need", "rank"]).filter(keep)

    return texts.mapInArrow(cut, schema)


def _pairs(state: DataFrame, span: int) -> DataFrame:
    """Position-rank pairs at the next offset: t, i, need, last (the run is past the threshold), a, b."""
    schema = "t binary, i int, need int, last boolean, a long, b long"

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept(("suffix_dedup",), dict)
        for batch in batches:
            row = _row_of(batch.column(1))
            at, need, rank = (batch.column(k).flatten().to_numpy().astype(np.int64) for k in (1, 2, 3))
            order = np.argsort(place := row << 32 | at, kind="stable")  # all texts of a batch at once
            place, row, need, rank = place[order], row[order], need[order], rank[order]
            far = need > 2 * span
            # a run past the threshold goes on while a run of its text that may lean on it is not
            leaning = np.bincount(row, far, batch.num_rows)[row] > 0 if len(row) else far
            for last, of in ((True, (need > span) & ~far), (False, leaning)):
                other = place[of] + (need[of] - span if last else span)
                k = np.searchsorted(place, other).clip(max=len(place) - 1)
                a, b = np.flatnonzero(of), k
                ok = place[b] == other if len(a) else np.zeros(0, bool)
                a, b = a[ok], b[ok]
                if len(a):
                    numbers = [pa.array((place[a] & 0xFFFFFFFF).astype(np.int32)), pa.array(need[a].astype(np.int32)), pa.array(np.full(len(a), last)), pa.array(rank[a]), pa.array(rank[b])]
                    yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.binary()).take(pa.array(row[a])), *numbers], names=["t", "i", "need", "last", "a", "b"])

    return state.mapInArrow(pair, schema)


def _row_of(column: pa.ListArray) -> np.ndarray:
    """For each entry of a column of lists, the row that it belongs to."""
    return np.repeat(np.arange(len(column)), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))


def _alive(phrases: DataFrame, names: DataFrame) -> DataFrame:
    """Phrases whose name repeats: t, i, need, rank (arrays)."""
    rows = phrases.select("t", F.posexplode(F.arrays_zip("need", F.col("rank").alias("name"))).alias("i", "x")).select("t", "i", "x.need", "x.name")
    kept_ = _ranked(rows, names, ["name"])
    return kept_.groupBy("t").agg(F.collect_list(F.struct("i", "need", "rank")).alias("x")).select("t", "x.i", "x.need", "x.rank")


def _between(prefix: np.ndarray, down: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of bytes a to b, of strings whose lengths may differ."""
    return mix((prefix[b] - prefix[a]) * down[a] + (b - a).astype(np.uint64) * _SEED).view(np.int64)


class _Texts:
    """Texts of a batch end to end, with the hashes of any of their strings."""

    def __init__(self, names: pa.Array, texts: list[bytes]):
        self.names = names
        self.size = np.array([len(t) for t in texts], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.prefix, self.down = _hashes(b"".join(texts))

    def blocks(self, row: np.ndarray, edge: np.ndarray, low: np.ndarray, high: np.ndarray, free: np.ndarray, step: int, length: int) -> pa.RecordBatch:
        """Blocks of ``step`` strings of the given texts, of which the last starts at ``edge``: t, edge, low, high, free, inside, whole."""
        begin, size = self.begin[row], self.size[row]
        fits = (edge >= step - 1) & (edge + length <= size)
        between = lambda a, b: _between(self.prefix, self.down, begin + a, begin + b)
        inside = between(edge, np.minimum(edge - step + 1 + length, size))
        whole = pa.array(between((edge - step + 1).clip(min=0), np.minimum(edge + length, size)), mask=~fits)
        numbers = [pa.array(x.astype(np.int32)) for x in (edge, low, high)]
        return pa.RecordBatch.from_arrays([self.names.take(pa.array(row)), *numbers, pa.array(free), pa.array(inside), whole], names=["t", "edge", "low", "high", "free", "inside", "whole"])


_BLOCK = "t binary, edge int, low int, high int, free boolean, inside long, whole long"


def _blocks(texts: DataFrame, length: int, chunk: int) -> DataFrame:
    """Blocks of strings that could repeat. ``texts``: t, text, alive, runs (of structs i, own).

    A block holds strings with the same first inner anchor whose distances to it have the same quotient by the step.
    ``inside`` hashes what all of them have in common, ``whole`` what any of them covers (null if the text ends before).
    ``low`` and ``high`` are the least and largest start in this text. ``free``: some string is not held by a
    repeated run. Blocks that are not are listed only where the run's position is the one that speaks for its rank.
    """
    step = STEPS[0]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept(("suffix_dedup",), dict)
        for batch in slices(batches, "text", chunk):
            data = byte_strings(batch, "text")
            own = _Texts(batch.column(0).cast(pa.binary()), data)
            alive, runs = batch.column(2), batch.column(3)
            alive_row, alive_at = _row_of(alive), alive.flatten().to_numpy()
            run_row, (run_at, run_own) = _row_of(runs), (x.to_numpy(zero_copy_only=False) for x in runs.flatten().flatten())
            alive_edge, run_edge = np.searchsorted(alive_row, np.arange(len(data) + 1)), np.searchsorted(run_row, np.arange(len(data) + 1))
            parts: list[list[np.ndarray]] = [[], [], [], [], []]
            for k, places in enumerate(anchors_of(data, length)[0]):
                if not len(places):
                    continue
                flags = np.zeros(len(places) - 1, bool)
                flags[alive_at[alive_edge[k] : alive_edge[k + 1]]] = True
                anchor, low, high = open_starts(places, flags, len(data[k]), length)
                if not len(anchor):
                    continue
                nearest = (anchor - high) // step
                times = (anchor - low) // step - nearest + 1
                block = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times - nearest, times)
                edge = np.repeat(anchor, times) - step * block
                low, high = np.maximum(np.repeat(low, times), edge - step + 1), np.minimum(np.repeat(high, times), edge)
                at, speak = run_at[run_edge[k] : run_edge[k + 1]], run_own[run_edge[k] : run_edge[k + 1]].astype(bool)
                free = ~all_in(start_runs(covered(places, at, length), length), low, high)
                some = free | any_in(start_runs(covered(places, at[speak], length), length), low, high)
                if some.any():
                    for x, y in zip(parts, (np.full(int(some.sum()), k), edge[some], low[some], high[some], free[some])):
                        x.append(y)
            if parts[0]:
                yield own.blocks(*map(np.concatenate, parts), step, length)

    return texts.mapInArrow(look, _BLOCK)


def _smaller(texts: DataFrame, length: int, before: int, step: int, chunk: int) -> DataFrame:
    """The blocks of ``step`` strings that blocks of ``before`` strings consist of. ``texts``: t, text, x (structs edge, low, high, free)."""
    times = before // step

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept(("suffix_dedup",), dict)
        for batch in slices(batches, "text", chunk):
            own = _Texts(batch.column(0).cast(pa.binary()), byte_strings(batch, "text"))
            row, (edge, low, high, free) = _row_of(batch.column(2)), (x.to_numpy(zero_copy_only=False) for x in batch.column(2).flatten().flatten())
            row, edge, low, high, free = (np.repeat(x, times) for x in (row, edge.astype(np.int64), low.astype(np.int64), high.astype(np.int64), free.astype(bool)))
            edge -= step * np.tile(np.arange(times), len(edge) // times)
            low, high = np.maximum(low, edge - step + 1), np.minimum(high, edge)
            some = low <= high
            if some.any():
                yield own.blocks(row[some], edge[some], low[some], high[some], free[some], step, length)

    return texts.mapInArrow(look, _BLOCK)


def covered(places: np.ndarray, runs: np.ndarray | list[int], length: int) -> np.ndarray:
    """Bytes (first, last) of the runs that begin at the given anchors and reach ``length`` bytes beyond the next one."""
    at = np.sort(np.asarray(runs, np.int64))
    if not len(at):
        return np.zeros((0, 2), np.int64)
    return np.stack([places[at], places[at + needed(places, length)[at]] + GRAM], 1)


def _sized(df: DataFrame, size: F.Column) -> int:
    """Bytes of a table, by the given size of a row."""
    return df.agg(F.sum(size)).collect()[0][0] or 0


def find_repeats(docs: DataFrame, text_col: str = "text", length: int = 400, chunk: int = 400_000) -> DataFrame:
    """What goes of each distinct text: t (its md5), whole (all of it), blocks and runs.

    ``blocks`` are least and largest starts of repeated strings of ``length`` bytes, ``runs`` anchors where a repeated run
    begins; :func:`removed_ranges` turns them into byte ranges. Texts without any are not listed.
    """
    if length < 4 * REACH + GRAM - 3:
        raise ValueError(f"strings of {length} bytes are too short for anchors {REACH} apart")
    texts = docs.select(_text_key(text_col).alias("t"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    long = texts.where(F.octet_length("text") >= length)
    twice = written(long.groupBy("t").agg(F.count("*").alias("n")).where("n > 1").select("t"), "twice")
    held = _limited(twice, 48 * twice.count())
    # one document of each text; texts of which there are several are shuffled once, those of one never
    copies = written(long.join(held, "t", "left_semi").dropDuplicates(["t"]), "copies")
    single = long.join(held, "t", "left_anti")

    def with_text(some: DataFrame, size: F.Column) -> DataFrame:
        """Rows of a written table by t, with their texts: these are read where they are if the table is small."""
        side = _limited(some, _sized(some, size))
        columns = [c for c in some.columns if c != "t"]
        return single.join(side, "t").select("t", "text", *columns).unionByName(copies.join(side, "t").select("t", "text", *columns))

    phrases = written(_phrases(single.unionByName(copies), length, chunk), "phrases")
    position = F.xxhash64("t", "i")
    first = phrases.select("t", F.posexplode("rank").alias("i", "name")).select("name", position.alias("pid"))
    names = written(_repeated(first, "name"), "names")
    state = written(_alive(phrases, names), "alive")
    spent(phrases, names)
    alive = written(state.select("t", F.col("i").alias("alive")), "places")
    runs, span = [], 1
    while not state.isEmpty():
        # last pairs overlap: a and b are the whole run only among runs of equally many phrases
        pairs = written(_pairs(state, span).withColumn("pid", position).withColumn("size", F.when(F.col("last"), F.col("need")).otherwise(0)), "pairs")
        same = written(_repeated(pairs, "size", "a", "b"), "same")
        ranks = written(_ranked(pairs, same, ["size", "a", "b"]).select("t", "i", "need", "last", "rank", "pid"), "ranks")
        runs.append(written(ranks.where("last").select("t", F.struct("i", (F.col("rank") == F.col("pid")).alias("own")).alias("run")), "runs"))
        grouped = ranks.where("not last").groupBy("t").agg(F.collect_list(F.struct("i", "need", "rank")).alias("x"))
        after = written(grouped.select("t", "x.i", "x.need", "x.rank"), "state")
        spent(state, pairs, same, ranks)
        state = after
        span *= 2
    none = docs.sparkSession.createDataFrame([], "t binary, run struct<i: int, own: boolean>")
    for x in runs:
        none = none.unionByName(x)
    found = none.groupBy("t").agg(F.collect_list("run").alias("runs"))
    known = written(alive.join(found, "t", "left"), "known")
    spent(state, alive, *runs)
    blocks = written(_blocks(with_text(known, 32 + 4 * F.size("alive") + 8 * F.coalesce(F.size("runs"), F.lit(0))), length, chunk), "blocks")
    settled = []
    for k, step in enumerate(STEPS):
        rows = blocks.withColumn("pid", F.xxhash64("t", "edge"))
        all_of = written(_repeated(rows.where("whole is not null"), "whole"), "whole")
        marked = written(_ranked(rows, all_of, ["whole"], "left").withColumn("all", F.col("rank").isNotNull()), "marked")
        settled.append(written(marked.where("all and free").select("t", F.struct("low", "high").alias("x")), "settled"))
        spent(blocks, all_of)
        if k + 1 == len(STEPS):
            spent(marked)
            break
        # settled blocks still serve as the other occurrence for those of their kind that are not: one of each content,
        # with every string of it
        kinds = marked.groupBy("inside").agg(F.max(F.col("free") & ~F.col("all")).alias("open"), F.min("pid").alias("rank"), F.max("pid").alias("most"), F.count("*").alias("c"))
        kinds = written(kinds.where("open and rank <> most").select("inside", F.lit(True).alias("rank"), "c"), "kinds")
        some = marked.where(~F.col("all") | (F.col("pid") == F.col("rank"))).drop("rank")
        some = _ranked(some, kinds, ["inside"]).drop("rank")
        low, high = F.when(F.col("all"), F.col("edge") - step + 1).otherwise(F.col("low")), F.when(F.col("all"), F.col("edge")).otherwise(F.col("high"))
        chosen = some.select("t", F.struct("edge", low.alias("low"), high.alias("high"), (F.col("free") & ~F.col("all")).alias("free")).alias("x")).groupBy("t").agg(F.collect_list("x").alias("x"))
        chosen = written(chosen, "chosen")
        spent(marked, kinds)
        blocks = written(_smaller(with_text(chosen, 32 + 16 * F.size("x")), length, step, STEPS[k + 1], chunk), "blocks")
        spent(chosen)
    less = settled[0]
    for x in settled[1:]:
        less = less.unionByName(x)
    less = less.groupBy("t").agg(F.collect_list("x").alias("blocks"))
    parts = known.where("runs is not null").select("t", F.transform("runs", lambda r: r["i"]).alias("runs"))
    parts = written(parts.join(less, "t", "full").join(twice.select("t", F.lit(True).alias("whole")), "t", "full").select("t", F.coalesce("whole", F.lit(False)).alias("whole"), "blocks", "runs"), "repeats")
    spent(known, copies, twice, *settled)
    return parts


def removed_ranges(size: int, places: np.ndarray, whole: bool, blocks: list[dict[str, int]] | None, runs: list[int] | None, length: int) -> list[tuple[int, int]]:
    """Maximal byte ranges that go from a text of ``size`` bytes with anchors at ``places``."""
    if whole:
        return [(0, size)]
    ranges = np.array([(x["low"], x["high"] + length) for x in blocks or []], np.int64).reshape(-1, 2)
    if runs:
        ranges = np.concatenate([ranges, covered(places, runs, length)])
    return merge_ranges(ranges)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, chunk: int = 400_000, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of ``docs``: id, text, kept_text, n_bytes, n_removed, n_spans, kept_sha256, and the columns to ``carry``.

    Texts are UTF-8 bytes, null is empty; matches never cross documents; a byte goes if any string of
    ``length`` bytes over it also starts elsewhere, in the same document or another, judged on the input.
    ``kept_sha256`` is of the bytes left; ``kept_text`` is those as text, without the pieces of characters that
    a cut has split, and null for a null text. Null ids stay null; repeated rows are copies of each other; an
    empty table gives no rows. Only the id, the text and what is carried are read. A ``length`` too short for anchors
    (under 397 bytes) raises ``ValueError``.
    """
    found = find_repeats(docs, text_col, length, chunk)
    size = _sized(found, 32 + 8 * F.coalesce(F.size("blocks"), F.lit(0)) + 4 * F.coalesce(F.size("runs"), F.lit(0)))
    extra = [f"__carry{k}" for k in range(len(carry))]
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text"), _text_key(text_col).alias("t"), *[F.col(c).alias(x) for c, x in zip(carry, extra)])
    joined = rows.join(_limited(found, size), "t", "left").select(id_col, "text", "whole", "blocks", "runs", *extra)
    schema = joined.select(id_col, "text", F.col("text").alias("kept_text"), *(F.lit(0).cast("long").alias(c) for c in ("n_bytes", "n_removed", "n_spans")), F.lit("").alias("kept_sha256"), *extra).schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept(("suffix_dedup",), dict)
        for batch in slices(batches, "text", 2 * chunk):
            texts = byte_strings(batch, "text")
            left, counts, spans = [], [], []
            whole, blocks, runs = (batch.column(k).to_pylist() for k in (2, 3, 4))
            cut_at = [k for k in range(len(texts)) if runs[k] and not whole[k]]
            places = dict(zip(cut_at, anchors_of([texts[k] for k in cut_at], length)[0]))
            for k, text in enumerate(texts):
                ranges = removed_ranges(len(text), places.get(k), whole[k], blocks[k], runs[k], length) if whole[k] or blocks[k] or runs[k] else []
                spans.append(len(ranges))
                counts.append(sum(b - a for a, b in ranges))
                if ranges:
                    edges = [0, *(x for r in ranges for x in r), len(text)]
                    text = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                left.append(text)
            null = batch.column(1).is_null().to_pylist()
            out = [None if no else x.decode("utf-8", "ignore") for no, x in zip(null, left)]
            digest = [hashlib.sha256(x).hexdigest() for x in left]
            numbers = [pa.array(x, pa.int64()) for x in ([len(x) for x in texts], counts, spans)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), *numbers, pa.array(digest, pa.string()), *batch.columns[5:]], names=schema.names)

    out = joined.mapInArrow(cut, schema)
    return out.select(*out.columns[: len(out.columns) - len(carry)], *[F.col(x).alias(c) for c, x in zip(carry, extra)])
