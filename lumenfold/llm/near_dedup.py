"""Near-duplicate classes: bottom-k sketches, inverted lists, union-sketch estimates, exact Jaccard.

A document is the set of its distinct word shingles; one hash function numbers them, and the ``KEEP``
least numbers are its sketch. Documents of equal sets are one node (named by the least id), however many
copies there are. Inverted lists of retained values propose pairs, the union sketch of a pair (the
least ``KEEP`` numbers of both) estimates its similarity, and pairs that pass are compared on full sets.

Lists are kept short by the prefix rule: two sketches that agree on at least a given number of values
agree on one of the rarest values of each, so a node is listed under so many of its rarest values only (by the number of
nodes that retain them), and no pair that the estimate would pass is lost. The estimate's floor is so low that a pair at the
threshold falls below it with a chance of ``MISS``.

Lists of up to ``COMMON`` nodes are paired off. Longer ones (a passage that many documents share) are not: every member
meets one pivot of its list, the member whose retained values are the most common, and lists whose members are then in one
class are done. (Further of ``ROUNDS`` rounds take pivots from classes that had none, as long as they find links.) The members of lists that are still open
then are listed again in the same way by sketches of ``WIDE`` values, of which far fewer need lists: mostly whole sets, whose rarest
quarter is their own. What is open even after that is compared class against class in blocks of bounded size by these
sketches, and each member hands on one candidate of each class at a time.
Links, classes and lists stay in Spark throughout.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import byte_strings, kept, slices, spent, written
from lumenfold.llm.shingles import shingle_sets

KEEP, WIDE, COMMON, BLOCK, CHUNK, ROUNDS, MISS = 64, 512, 32, 4096, 512, 1, 1e-7
#: Up to so many bytes a side is broadcast after its rows have been counted; beyond, it is shuffled in ``SALTS`` shares of a key.
BROADCAST_BYTES, SALTS = 64 << 20, 32


def ordered_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Shingle sets as signed numbers in ascending order."""
    return [np.sort(x.view(np.int64)) for x in shingle_sets(texts, width)]


def digest(numbers: np.ndarray) -> bytes | None:
    return hashlib.blake2b(numbers.tobytes(), digest_size=16).digest() if len(numbers) else None


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two ascending sets."""
    if not len(a) or not len(b):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = overlap(a, b)
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def least_agreement(percent: int, keep: int = KEEP, miss: float = MISS) -> int:
    """The largest number of common values, of ``keep``, that a pair at the threshold falls short of with a chance of ``miss`` at most."""
    p, below = percent / 100, 0.0
    for k in range(keep + 1):
        below += math.comb(keep, k) * p**k * (1 - p) ** (keep - k)
        if below > miss:
            return k
    return keep


def _beside(big: DataFrame, small: DataFrame, key: str, rows: int, row_bytes: int, other: str) -> DataFrame:
    """Inner join with a side of one row a key; keys of ``big`` may be hot.

    The small side is broadcast if it is small; else each key is dealt into ``SALTS`` shares by the column ``other``.
    """
    if rows * row_bytes <= BROADCAST_BYTES:
        return big.join(F.broadcast(small), key)
    salted = big.withColumn("__salt", F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int"))
    return salted.join(small.withColumn("__salt", F.explode(F.array(*map(F.lit, range(SALTS))))), [key, "__salt"]).drop("__salt")


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int, chunk: int) -> DataFrame:
    """id, n (size of the set), s (digest of the set, null if it is empty), sketch."""
    some = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept(("near_dedup",), dict)
        for batch in slices(batches, "text", chunk):
            sets = ordered_sets(byte_strings(batch, "text"), width)
            arrays = [batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array(map(digest, sets), pa.binary()), pa.array([x[:KEEP] for x in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "n", "s", "sketch"])

    return some.mapInArrow(run, "id long, n long, s binary, sketch array<long>")


def components(edges: DataFrame) -> DataFrame:
    """id and label, the least id that can be reached, for each end of an edge (a, b).

    Each round every node takes the least label of its neighbours and then the label of its label, so
    rounds grow with the logarithm of a chain's length.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("label").alias("m"))
        step = labels.join(near, labels["id"] == near["a"]).select("id", "label", F.least("label", "m").alias("m"))
        before, step = labels, written(step, "step")
        above = step.select(F.col("id").alias("m"), F.col("m").alias("top"))
        after = written(step.join(above, "m").select("id", F.col("top").alias("label"), (F.col("top") != F.col("label")).alias("moved")), "labels")
        spent(before, step)
        labels = after.select("id", "label")
        if after.where("moved").isEmpty():
            spent(both)
            return labels


def _size_ok(a: str, b: str, percent: int) -> F.Column:
    return (100 * F.col(a) >= percent * F.col(b)) & (100 * F.col(b) >= percent * F.col(a))


def _texts(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and text of the documents with these distinct ids."""
    ids = written(ids, "ids")
    some = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return some.join(F.broadcast(ids) if 16 * ids.count() <= BROADCAST_BYTES else ids, "id", "left_semi")


def _verified(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, each: int = 64) -> tuple[DataFrame, DataFrame]:
    """The pairs (a, b, with digests sa, sb) whose full sets are similar, and the table of texts that they are read from.

    ``b`` should be the end that many pairs have: its pairs are dealt in groups of about ``each``, which read its text once.
    """
    texts = written(_texts(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), id_col, text_col), "texts")
    hot = written(pairs.groupBy("b").agg(F.ceil(F.count("*") / each).alias("parts")).where("parts > 1"), "hot")
    hot = F.broadcast(hot) if 32 * hot.count() <= BROADCAST_BYTES else hot
    part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("a"), "parts"))
    dealt = pairs.join(hot, "b", "left").select("a", "b", "sa", "sb", part.alias("part"))
    hubs = dealt.select("b", "part", "sb").distinct().select(F.col("b").alias("id"), "b", "part", F.lit(0).alias("kind"), F.col("sb").alias("s"))
    rows = dealt.select(F.col("a").alias("id"), "b", "part", F.lit(1).alias("kind"), F.col("sa").alias("s")).unionByName(hubs)
    rows = rows.join(texts, "id").repartition("b", "part").sortWithinPartitions("b", "part", "kind")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept(("near_dedup",), dict)
        hub, own = None, None
        for batch in slices(batches, "text", 400_000):
            sets = ordered_sets(byte_strings(batch, "text"), width)
            found = []
            for x, (i, b, part, kind, s) in zip(sets, zip(*(batch.column(c).to_pylist() for c in ("id", "b", "part", "kind", "s")))):
                if hub != (b, part):
                    hub, own = (b, part), None
                if digest(x) != s:
                    continue  # an id may stand for several rows; only the one that made the digest counts
                if kind == 0:
                    own = x
                elif own is not None and similar(x, own, percent):
                    found.append((i, b))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])

    return rows.select("id", "b", "part", "kind", "s", "text").mapInArrow(check, "a long, b long").distinct(), texts


def _passing(pairs: DataFrame, nodes: DataFrame, percent: int, hubs: DataFrame | None = None) -> DataFrame:
    """The pairs whose union sketch agrees often enough: a, b, sa, sb. ``hubs``: the ids that stand as b, if they are few."""
    left, right = (nodes.select(F.col("id").alias(x), F.col("s").alias(f"s{x}"), F.col("sketch").alias(f"k{x}")) for x in "ab")
    if hubs is not None:
        right = right.join(hubs.select(F.col("p").alias("b")).distinct(), "b", "left_semi")
        joined = _beside(pairs.join(left, "a"), right, "b", hubs.count(), 8 * KEEP + 64, "a")
    else:
        joined = pairs.join(left, "a").join(right, "b")
    union = F.slice(F.array_sort(F.array_union("ka", "kb")), 1, KEEP)
    agreed = F.size(F.array_intersect(union, F.array_intersect("ka", "kb")))
    return joined.where(agreed * KEEP >= least_agreement(percent) * F.size(union)).select("a", "b", "sa", "sb")


def _listed(nodes: DataFrame, sketch: str, keep: int, percent: int) -> DataFrame:
    """v, c (nodes that retain v), id, n, weight: each node under its rarest values, as many as the prefix rule asks for.

    Values that one node retains are the rarest: they come first and need no list. A sketch that is the whole set
    must agree on ``percent`` of it, a larger set's sketch on as much as the estimate asks for. ``weight`` says how common a
    node's values are.
    """
    values = nodes.select("id", "n", F.explode(sketch).alias("v"))
    counts = written(values.groupBy("v").agg(F.count("*").alias("c")).where("c > 1"), "counts")
    rare, hot = counts.where(F.col("c") <= COMMON), counts.where(F.col("c") > COMMON)
    shared = values.join(F.broadcast(rare) if 32 * rare.count() <= BROADCAST_BYTES else rare, "v").unionByName(_beside(values, hot, "v", hot.count(), 32, "id"))
    listed = shared.groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("c", "v"))).alias("x"))
    estimated = F.ceil(F.least(F.col("n"), F.lit(keep)) * (least_agreement(percent, keep) / keep))
    # the other set may be larger than the sketch even if this one is not
    agreeing = F.when(100 * F.col("n") <= percent * keep, F.ceil(F.col("n") * (percent / 100) - 1e-9)).otherwise(estimated).cast("int")
    free = F.greatest(F.lit(0), F.size("x") - agreeing + 1)
    weight = F.aggregate("x", F.lit(0.0), lambda t, e: t + F.log2(e["c"].cast("double")))
    listed = listed.withColumn("weight", weight).withColumn("x", F.slice("x", 1, free)).select("id", "n", "weight", F.explode("x").alias("e"))
    entries = written(listed.select(F.col("e.v").alias("v"), F.col("e.c").alias("c"), "id", "n", "weight"), "entries")
    spent(counts)
    return entries


def _labelled(entries: DataFrame, classes: DataFrame) -> DataFrame:
    """Entries with the present label of their node."""
    return entries.join(classes, "id", "left").withColumn("label", F.coalesce("label", "id"))


def _open(entries: DataFrame) -> DataFrame:
    """Entries of the lists whose members are in several classes. ``entries`` have labels."""
    lists = written(entries.groupBy("v").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 <> l1").select("v"), "open")
    return _beside(entries, lists, "v", lists.count(), 32, "id")


def _wide(texts: DataFrame, width: int) -> DataFrame:
    """id, s (digest of the set) and the ``WIDE`` least numbers of the set of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept(("near_dedup",), dict)
        for batch in slices(batches, "text", 400_000):
            sets = ordered_sets(byte_strings(batch, "text"), width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(digest, sets), pa.binary()), pa.array([x[:WIDE] for x in sets], pa.list_(pa.int64()))], names=["id", "s", "wide"])

    return texts.select("id", "text").mapInArrow(run, "id long, s binary, wide array<long>")


def numbers(column: pa.ListArray) -> list[np.ndarray]:
    """The lists of a column as views of its numbers."""
    flat, edges = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy().tolist()
    return [flat[a:b] for a, b in zip(edges, edges[1:])]


def _agreement(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """How many values each two lists have in common, and the lists' lengths."""
    size = np.array([len(x) for x in lists])
    of = np.repeat(np.arange(len(lists)), size)
    _, flat, many = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    shared = many[flat] > 1
    of, flat = of[shared], (np.cumsum(many > 1) - 1)[flat[shared]]
    order = np.argsort(flat, kind="stable")
    of, flat = of[order], flat[order]
    agreed = np.zeros((len(lists), len(lists)), np.float32)
    for first in range(0, int(flat[-1]) + 1 if len(flat) else 0, 4096):  # so many values at a time
        a, b = np.searchsorted(flat, [first, first + 4096])
        table = np.zeros((len(lists), 4096), np.float32)
        table[of[a:b], flat[a:b] - first] = 1
        agreed += table @ table.T
    return agreed, size


def _block_pairs(entries: DataFrame, members: DataFrame, percent: int, once: bool) -> DataFrame:
    """Candidates (a, b, sa, sb) among the members of open lists that are in different classes, block against block.

    A block is at most about ``BLOCK`` members, whose sketches a task holds; they are compared ``CHUNK`` against ``CHUNK``.
    ``once``: each member hands on the best of its candidates of each class only; else those that this left out.
    """
    sizes = written(entries.groupBy("v").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")), "sizes")
    own = entries.groupBy("id", "label").agg(F.array_sort(F.collect_set("v")).alias("lists"))
    members = written(own.join(members, "id"), "members")
    placed = _beside(members.withColumn("v", F.explode("lists")), sizes, "v", sizes.count(), 32, "id")
    placed = placed.withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    # a member goes to each pair of blocks that its block is in
    meets = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    meets = meets.select("v", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "part", "id", "label", "n", "s", "wide", "lists")
    meets = meets.repartition("v", "x", "y").sortWithinPartitions("v", "x", "y", "part")
    least = least_agreement(percent, WIDE)

    def candidates(v: int, rows: list[dict], first: int, mixed: bool) -> list[tuple]:
        """Candidates among the first ``first`` rows and the others, or among all of them if there are no others."""
        part, label, n = (np.array([r[c] for r in rows]) for c in ("part", "label", "n"))
        # a pair that meets in several open lists is compared in the first of them only
        met, _ = _agreement([r["lists"][r["lists"] < v] for r in rows])
        want = (100 * n[:, None] >= percent * n[None, :]) & (100 * n[None, :] >= percent * n[:, None]) & (label[:, None] != label[None, :]) & (met == 0)
        if first < len(rows):
            want[:first, :first] = want[first:, first:] = False
        if mixed:
            want &= part[:, None] != part[None, :]
        some = np.flatnonzero(want.any(1))
        if not len(some):
            return []
        rows, label, n, want = [rows[k] for k in some.tolist()], label[some], n[some], want[np.ix_(some, some)]
        agreed, size = _agreement([r["wide"] for r in rows])
        union = size[:, None] + size[None, :] - agreed
        # whole sets are compared as they are; else all that both retain, whether or not the union's sketch
        # does, which is never less than the estimate
        whole = (n[:, None] <= WIDE) & (n[None, :] <= WIDE)
        union = np.where(whole, union, np.minimum(WIDE, union))
        want &= np.where(whole, 100 * agreed >= percent * union, agreed * WIDE >= least * union) & (agreed > 0)
        if once:
            out = set()
            for k in np.flatnonzero(want.any(1)).tolist():
                others = np.flatnonzero(want[k])
                order = others[np.lexsort((others, -agreed[k, others] / union[k, others]))]
                _, best = np.unique(label[order], return_index=True)
                out |= {(min(k, j), max(k, j)) for j in order[best].tolist()}
        else:  # between classes of one member the best candidate was the only one
            _, of_class, members_of = np.unique(label, return_inverse=True, return_counts=True)
            several = members_of[of_class] > 1
            want &= several[:, None] | several[None, :]
            out = np.argwhere(np.triu(want, 1)).tolist()
        return [(rows[k]["id"], rows[j]["id"], rows[k]["s"], rows[j]["s"]) for k, j in out]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept(("near_dedup",), dict)
        key, held = None, []
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())

        def emit() -> Iterator[pa.RecordBatch]:
            chunks = [held[k : k + CHUNK] for k in range(0, len(held), CHUNK)]
            for k, one in enumerate(chunks):
                for other in ([], *chunks[k + 1 :]):
                    out = candidates(key[0], one + other, len(one), key[1] != key[2])
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), kinds)], names=["a", "b", "sa", "sb"])

        for batch in batches:
            plain = [batch.column(c).to_pylist() for c in ("v", "x", "y", "part", "id", "label", "n", "s")]
            for *fields, wide, lists in zip(*plain, numbers(batch.column("wide")), numbers(batch.column("lists"))):
                r = dict(zip(("v", "x", "y", "part", "id", "label", "n", "s"), fields), wide=wide, lists=lists)
                if key != (r["v"], r["x"], r["y"]):
                    yield from emit()
                    key, held = (r["v"], r["x"], r["y"]), []
                held.append(r)
        yield from emit()

    return meets.mapInArrow(compare, "a long, b long, sa binary, sb binary").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75, chunk: int = 400_000) -> DataFrame:
    """One row for each row of ``docs``: id, n_shingles, component_id, kept.

    Sets of distinct ``width``-word shingles (words between ASCII white space, A-Z lower-cased; a text of fewer
    words is one shingle) are linked if 100 * intersection >= ``percent`` * union; ``component_id`` is the
    least id that links reach. Null texts and texts without words have no shingles and are linked with
    nothing. Rows with a null id are linked with nothing: null component, not kept. Rows that repeat an
    id are judged by their own texts, and each is kept if its component is its id. An empty table gives no
    rows. Only the id and the text are read.
    """
    spark = docs.sparkSession
    all_docs = written(sketches(docs, id_col, text_col, width, chunk), "sketches")
    named = all_docs.where("id is not null and s is not null")
    names = written(named.groupBy("s").agg(F.min("id").alias("id")), "names")
    nodes = written(named.join(names, ["s", "id"]).dropDuplicates(["s", "id"]), "nodes")
    spent(names)
    entries = _listed(nodes, "sketch", KEEP, percent)
    classes = spark.createDataFrame([], "id long, label long")

    def link(candidates: DataFrame) -> bool:
        """Compare candidates on full sets and join the classes of those that are similar; whether any is."""
        nonlocal classes
        candidates = written(candidates, "pairs")
        similar_pairs, texts = _verified(candidates, docs, id_col, text_col, width, percent)
        links = written(similar_pairs, "links")
        found = not links.isEmpty()
        if found:
            ends = links.join(classes.withColumnRenamed("id", "a").withColumnRenamed("label", "la"), "a", "left").join(classes.withColumnRenamed("id", "b").withColumnRenamed("label", "lb"), "b", "left")
            upper = components(ends.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")))
            known = classes.join(upper.select(F.col("id").alias("label"), F.col("label").alias("top")), "label", "left").select("id", F.coalesce("top", "label").alias("label"))
            classes = written(known.unionByName(upper.join(classes, "id", "left_anti")), "classes")
        spent(candidates, links, texts)
        return found

    def pair_off(entries: DataFrame) -> None:
        """All pairs of short lists that are in different classes."""
        short = _labelled(entries.where(F.col("c") <= COMMON).select("v", "id", "n"), classes)
        other = short.select("v", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("label").alias("lb"))
        pairs = short.join(other, "v").where((F.col("id") < F.col("b")) & (F.col("label") != F.col("lb")) & _size_ok("n", "nb", percent)).select(F.col("id").alias("a"), "b").distinct()
        link(_passing(pairs, nodes, percent))

    def meet_pivots(entries: DataFrame, rounds: int) -> DataFrame:
        """Rounds of pivots over long lists; entries of the lists that are open after them, with labels."""
        long, had = entries.where(F.col("c") > COMMON).select("v", "id", "n", "weight"), spark.createDataFrame([], "v long, p long")
        for k in range(rounds + 1):
            now = written(_open(_labelled(long, classes)), "long")
            if k == rounds or now.isEmpty():
                break
            gone = had.join(classes, had["p"] == classes["id"], "left").select("v", F.coalesce("label", "p").alias("label")).distinct()
            best = now.join(gone, ["v", "label"], "left_anti").groupBy("v").agg(F.max(F.struct("weight", F.negate("id").alias("minus"), "n", "label")).alias("m"))
            pivots = written(best.select("v", F.negate("m.minus").alias("p"), F.col("m.n").alias("np"), F.col("m.label").alias("lp")), "pivots")
            starred = _beside(now, pivots, "v", pivots.count(), 64, "id").where((F.col("label") != F.col("lp")) & _size_ok("n", "np", percent))
            had = had.unionByName(pivots.select("v", "p"))
            long = now.select("v", "id", "n", "weight")
            if not link(_passing(starred.select(F.col("id").alias("a"), F.col("p").alias("b")).distinct(), nodes, percent, pivots)):
                break
        return now

    pair_off(entries)
    now = meet_pivots(entries, ROUNDS)
    spent(entries)
    if not now.isEmpty():
        # members of lists that are still open: listed again, by the rarest values of wide sketches
        own = nodes.join(now.select("id").distinct(), "id", "left_semi").select("id", "n", "s")
        members = written(own.join(_wide(_texts(docs, own.select("id"), id_col, text_col), width), ["id", "s"]).dropDuplicates(["id"]), "wide")
        entries = _listed(members, "wide", WIDE, percent)
        pair_off(entries)
        now = meet_pivots(entries, 0)
        # what is open even then: class against class, first one candidate of each class, then all
        for once in (True, False):
            if now.isEmpty():
                break
            link(_block_pairs(now, members, percent, once))
            now = written(_open(_labelled(now.drop("label"), classes)), "long")
    # labels of nodes, of their sets, of documents
    final = nodes.select("s", "id").join(classes, "id", "left").select("s", F.coalesce("label", "id").alias("component"))
    out = all_docs.join(final, "s", "left")
    own = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(F.col("id") == own, F.lit(False)).alias("kept"))
