"""Exact top-k search by inner product with multi-resolution segment statistics.

Vectors are quantised to floor(64 * x). A vector is cut into segments; of each segment its mean and
its deviation (norm of what is left without the mean) are kept, for 1, 2, 4, ... segments. For a
query q and a candidate x the inner product is at most

    sum over segments of  m * mean(q) * mean(x) + deviation(q) * deviation(x)

(Cauchy-Schwarz on the parts without means), which is the lower bound of their distance in other
words. Bounds are taken coarse to fine; only pairs whose bound reaches the query's threshold go on
to the next resolution and in the end to the exact integer product. The threshold of a query is its
k-th best exact score among a first block of candidates, and rises as a task meets better ones.

Bounds are cosines: vectors are divided by their norms (in double precision) before they are rounded to single
precision, so an error of rounding is a known share of both norms, whatever the components' signs or sizes.

Queries are a stated set and are taken in groups of a bounded number, each group one broadcast and one scan whose
results are written before the next one starts; the candidates are never shuffled. Each task returns at most k rows for a query.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from lumenfold.llm.common import written



def slack(parts: int) -> float:
    """How far a cosine bound of so many segments may be off, rounding of its parts and of their sum included."""
    return (2 * parts + 16) * 2.0**-23


def quantise(vectors: list[list[float] | None]) -> tuple[list[int], list[np.ndarray]]:
    """Places and floor(64 x) of the vectors that are not null and hold finite components only."""
    at, out = [], []
    for k, v in enumerate(vectors):
        if v is None or any(x is None for x in v):
            continue
        x = np.asarray(v, np.float64)
        if np.isfinite(x).all():
            at.append(k)
            out.append(np.floor(64 * x))
    return at, out


class Statistics:
    """Norms of the rows of a matrix; means and deviations of the segments of the rows divided by them, by number of segments."""

    def __init__(self, matrix: np.ndarray, levels: list[int]):
        self.parts = {}
        with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
            self.norm = np.sqrt((matrix * matrix).sum(1))
            self.inverse = np.where(self.norm > 0, 1 / self.norm, 0.0)
            unit = matrix * self.inverse[:, None]
        self.exact = ~np.isfinite(self.norm)  # too large for bounds: always compared
        unit[self.exact] = 0
        for n in levels:
            edges = np.linspace(0, matrix.shape[1], n + 1).astype(int)
            size = np.diff(edges)
            mean = np.add.reduceat(unit, edges[:-1], axis=1) / size
            rest = unit - np.repeat(mean, size, axis=1)
            deviation = np.sqrt(np.add.reduceat(rest * rest, edges[:-1], axis=1))
            # one product of these two gives m * mean * mean + deviation * deviation
            self.parts[n] = np.concatenate([mean * np.sqrt(size), deviation], axis=1).astype(np.float32)


def levels_of(width: int) -> list[int]:
    """1, 4, 16 segments, as far as a segment has four components or more."""
    return [n for n in (1, 4, 16) if n == 1 or width >= 4 * n]


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer inner products, in the cheapest type that cannot round."""
    bound = queries.shape[1] * float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0))
    if bound < 2**24:
        return (queries.astype(np.float32) @ rows.astype(np.float32).T).astype(np.int64)
    if bound < 2**53:
        return (queries @ rows.T).astype(np.int64)
    exact = np.array([[int(x) for x in q] for q in queries.tolist()], object) @ np.array([[int(x) for x in r] for r in rows.tolist()], object).T
    return exact.astype(np.int64)


class Block:
    """Queries of one width with their statistics and thresholds."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray):
        self.ids, self.matrix = ids, matrix
        self.levels = levels_of(matrix.shape[1])
        self.statistics = Statistics(matrix, self.levels)
        self.threshold = np.full(len(ids), -np.inf)

    def survivors(self, rows: np.ndarray, threshold: np.ndarray) -> np.ndarray:
        """Which (query, candidate) pairs no bound has ruled out, coarse to fine."""
        own = Statistics(rows, self.levels)
        alive = np.ones((len(self.ids), len(rows)), bool)
        # a pair can reach the threshold only if its cosine reaches threshold / norms
        least = np.clip(threshold - 0.5, -1e300, 1e300) * self.statistics.inverse
        for level in self.levels:
            off = slack(level)
            if alive.mean() > 0.05:  # dense: one product for all pairs
                bound = self.statistics.parts[level] @ own.parts[level].T
                bound += np.float32(off)
                alive &= bound >= np.multiply.outer(least, own.inverse)
            else:
                q, at = np.nonzero(alive)
                for k in range(0, len(q), 100_000):
                    qk, ak = q[k : k + 100_000], at[k : k + 100_000]
                    bound = np.einsum("ij,ij->i", self.statistics.parts[level][qk], own.parts[level][ak])
                    alive[qk, ak] = bound + off >= least[qk] * own.inverse[ak]
            alive[self.statistics.exact] = True
            alive[:, own.exact] = True
        return alive

    def search(self, ids: np.ndarray, rows: np.ndarray, best: dict[int, tuple[np.ndarray, np.ndarray]], k: int, threshold: np.ndarray) -> None:
        """Merge the candidates' k best into ``best`` (scores, ids by query); raises ``threshold``."""
        alive = self.survivors(rows, threshold)
        if alive.mean() > 0.02:
            score = products(self.matrix, rows)
            q, at = np.nonzero(alive & (score >= threshold[:, None]))
            score = score[q, at]
        else:
            q, at = np.nonzero(alive)
            pieces = [np.zeros(0, np.int64)]
            for a in np.unique(q):
                pieces.append(products(self.matrix[a : a + 1], rows[at[q == a]])[0])
            score = np.concatenate(pieces)
        vec = ids[at]
        keep = (score >= threshold[q]) & (vec != self.ids[q])
        q, score, vec = q[keep], score[keep], vec[keep]
        edges = np.flatnonzero(np.diff(q, prepend=-1, append=-1))
        for a, b in zip(edges, edges[1:]):
            own, new_score, new_vec = int(q[a]), score[a:b], vec[a:b]
            if own in best:
                new_score, new_vec = np.concatenate([best[own][0], new_score]), np.concatenate([best[own][1], new_vec])
            order = np.lexsort((new_vec, -new_score))[:k]
            best[own] = new_score[order], new_vec[order]
            if len(order) == k:
                threshold[own] = max(threshold[own], new_score[order[-1]])


def _by_width(ids: list[int], vectors: list[np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    out: dict[int, tuple[list[int], list[np.ndarray]]] = {}
    for k, v in zip(ids, vectors):
        if len(v):
            a, b = out.setdefault(len(v), ([], []))
            a.append(k)
            b.append(v)
    return {w: (np.array(a, np.int64), np.stack(b)) for w, (a, b) in out.items()}


def top_k(
    vectors: DataFrame,
    k: int = 20,
    every: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block: int = 4096,
    first: int = 4096,
    chunk: int = 4096,
    group: int = 8,
) -> DataFrame:
    """The ``k`` best candidates of each query: query_id, rank, vec_id, score.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows but those of the
    query's own id. The score is the integer inner product of floor(64 * x); ties go to the smaller id.
    Null vectors, vectors with null or non-finite components, empty vectors and null ids take no part;
    vectors of another width than the query's are not its candidates. A query with fewer than ``k``
    candidates gets them all. Repeated rows: a query id gives one query (any row of it with the
    smallest vector), a candidate's repeated rows count each. A product beyond 64 bits raises.
    Other columns are not read. ``group`` blocks of ``block`` queries are broadcast at a time.
    """
    spark = vectors.sparkSession
    some = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("__id"), F.col(vector_col).alias("__vector"))
    asked = some.where(F.col("__id") % every == 0)
    rows = asked.groupBy("__id").agg(F.min("__vector").alias("__vector")).toLocalIterator()
    head_rows = some.limit(first).collect()
    head_at, head = quantise([r["__vector"] for r in head_rows])
    head_by = _by_width([head_rows[j]["__id"] for j in head_at], head)
    schema = "query_id long, vec_id long, score long"

    def blocks_of(asked_rows: list[Row]) -> dict[int, list[Block]]:
        at, values = quantise([r["__vector"] for r in asked_rows])
        out: dict[int, list[Block]] = {}
        for w, (ids, matrix) in _by_width([asked_rows[j]["__id"] for j in at], values).items():
            for a in range(0, len(ids), block):
                own = Block(ids[a : a + block], matrix[a : a + block])
                if w in head_by:  # a bounded first block gives each query its k-th best so far
                    head_ids, head_matrix = head_by[w]
                    score = products(own.matrix, head_matrix).astype(np.float64)
                    score[own.ids[:, None] == head_ids[None, :]] = -np.inf
                    if score.shape[1] >= k:
                        own.threshold = np.partition(score, -k, axis=1)[:, -k]
                out.setdefault(w, []).append(own)
        return out

    def part(asked_rows: list[Row]) -> tuple[DataFrame, Broadcast]:
        shared = spark.sparkContext.broadcast(blocks_of(asked_rows))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            every_block = [(w, own, {}, own.threshold.copy()) for w, x in shared.value.items() for own in x]
            for batch in batches:
                ids = batch.column(0).to_pylist()
                at, values = quantise(batch.column(1).to_pylist())
                by = _by_width([ids[j] for j in at], values)
                for w, own, best, threshold in every_block:
                    if w in by:
                        own_ids, matrix = by[w]
                        for a in range(0, len(own_ids), chunk):
                            own.search(own_ids[a : a + chunk], matrix[a : a + chunk], best, k, threshold)
            for _, own, best, _ in every_block:
                if best:
                    query = np.repeat(own.ids[list(best)], [len(x[0]) for x in best.values()])
                    vec, score = (np.concatenate([x[j] for x in best.values()]) for j in (1, 0))
                    yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(vec), pa.array(score)], names=["query_id", "vec_id", "score"])

        return ranked(some.mapInArrow(search, schema)), shared

    def ranked(found: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    done: DataFrame | None = None
    while True:
        asked_rows = list(islice(rows, group * block))
        if done is not None and not asked_rows:
            return done
        found, shared = part(asked_rows)
        if done is None and len(asked_rows) < group * block:
            return found  # one group: nothing has to be written in between
        path = written(found, "neighbours")
        shared.destroy()
        done = path if done is None else done.unionByName(path)
