"""URL filter: rules first, then gradient-boosted trees on lexical features.

A rule names a host and a path; it holds for the host, its subdomains and every path that starts
with the rule's; the longest rule that holds decides. URLs that a rule decides are labelled examples:
from a bounded sample of them boosted trees are trained in numpy (logistic loss, second-order
splits over quantile bins). Features: length, host and path length, depth, labels of the host, digit
ratio, entropy, number of parameters and suffix statistics, the share of blocked URLs among all
labelled ones of the same host suffix, kept in a fixed number of hash buckets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values: (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BUCKETS = 1024


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def decide(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that holds, written host + path, and its verdict; null where none holds."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the last that holds stays
        holds = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule, verdict = F.when(holds, name + start).otherwise(rule), F.when(holds, what).otherwise(verdict)
    return rule, verdict


def suffix_bucket(host: Column) -> Column:
    """Bucket of the last two labels of a host."""
    labels = F.split(host, r"\.")
    return F.pmod(F.crc32(F.array_join(F.slice(labels, -F.least(F.size(labels), F.lit(2)), 2), ".")), F.lit(BUCKETS)).cast("int")


FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "parameters", "suffix_share", "suffix_count")


def features(urls: list[str], hosts: list[str], paths: list[str], buckets: np.ndarray, share: np.ndarray, count: np.ndarray) -> np.ndarray:
    out = np.zeros((len(urls), len(FEATURES)))
    for k, (u, h, p) in enumerate(zip(urls, hosts, paths)):
        query = u.partition("?")[2].partition("#")[0]
        codes = np.frombuffer(u.encode("utf-8", "replace"), np.uint8)
        n = max(1, len(codes))
        each = np.bincount(codes, minlength=1)
        each = each[each > 0] / n
        digits = np.count_nonzero((codes >= 48) & (codes <= 57)) / n
        out[k, :8] = len(u), len(h), len(p), p.count("/"), h.count(".") + 1 if h else 0, digits, -(each * np.log2(each)).sum(), query.count("&") + 1 if query else 0
    out[:, 8], out[:, 9] = share[buckets], np.log1p(count[buckets])
    return out


@dataclass
class Trees:
    """Boosted trees: per tree, arrays of feature, threshold, children and leaf value."""

    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for feature, threshold, left, right, value in self.trees:
            node = np.zeros(len(x), np.int64)
            while (inner := feature[node] >= 0).any():
                at = np.flatnonzero(inner)
                n = node[at]
                node[at] = np.where(x[at, feature[n]] <= threshold[n], left[n], right[n])
            out += value[node]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 32, least: int = 5, penalty: float = 1.0) -> Trees:
    """Second-order gradient boosting of the logistic loss; splits are at quantiles of a feature."""
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3) if len(y) else 0.5
    out = Trees(float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return out
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1)
    margin = np.full(len(y), out.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        tree: list[list[float]] = []
        todo = [(np.arange(len(y)), 0, -1, 0)]
        while todo:
            at, level, parent, side = todo.pop()
            me = len(tree)
            tree.append([-1, 0.0, -1, -1, -rate * g[at].sum() / (h[at].sum() + penalty)])
            if parent >= 0:
                tree[parent][2 + side] = me
            best = (1e-6, -1, 0)
            if level < depth and len(at) >= 2 * least:
                total_g, total_h = g[at].sum(), h[at].sum()
                for f in range(x.shape[1]):
                    n = len(cuts[f])
                    if not n:
                        continue
                    b = binned[at, f]
                    left_g, left_h = np.cumsum(np.bincount(b, g[at], n + 1))[:n], np.cumsum(np.bincount(b, h[at], n + 1))[:n]
                    left_n = np.cumsum(np.bincount(b, minlength=n + 1))[:n]
                    gain = left_g**2 / (left_h + penalty) + (total_g - left_g) ** 2 / (total_h - left_h + penalty) - total_g**2 / (total_h + penalty)
                    gain[(left_n < least) | (len(at) - left_n < least)] = -1
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), f, k)
            if best[1] >= 0:
                _, f, k = best
                tree[me][0], tree[me][1] = f, float(cuts[f][k])
                low = binned[at, f] <= k
                todo += [(at[low], level + 1, me, 0), (at[~low], level + 1, me, 1)]
            else:
                margin[at] += tree[me][4]
        columns = list(zip(*tree))
        out.trees.append((np.array(columns[0], np.int64), np.array(columns[1]), np.array(columns[2], np.int64), np.array(columns[3], np.int64), np.where(np.array(columns[0]) < 0, columns[4], 0.0)))
    return out


@dataclass
class UrlModel:
    trees: Trees
    share: np.ndarray
    count: np.ndarray
    threshold: float = 0.5


def prepared(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """id, __url, host, path, rule, __label (the rule's verdict), __bucket."""
    host, path = host_and_path(F.col("__url"))
    some = pages.select(F.col(id_col), F.col(url_col).alias("__url")).select("*", host.alias("host"), path.alias("path"))
    rule, label = decide(F.col("host"), F.col("path"), rules)
    return some.select("*", rule.alias("rule"), label.alias("__label"), suffix_bucket(F.col("host")).alias("__bucket"))


def fit_url_model(rows: DataFrame, sample: int = 20_000, **options: object) -> UrlModel:
    """Train on at most ``sample`` distinct labelled URLs, those of the smallest hash; suffix statistics count all rows.

    A bound on the hash comes from the (approximate) number of distinct URLs, so that hardly more rows than are wanted
    reach the driver. Null URLs carry no label and do not take part.
    """
    labelled = rows.where(F.col("__label").isNotNull())
    share, count = np.full(BUCKETS, 0.5), np.zeros(BUCKETS)
    blocked = F.sum((F.col("__label") == "block").cast("long"))
    for b, n, k in labelled.groupBy("__bucket").agg(F.count("*"), blocked).collect():  # at most BUCKETS rows
        share[b], count[b] = (k + 1) / (n + 2), n
    many = labelled.agg(F.approx_count_distinct("__url")).collect()[0][0]
    part = min(1.0, 1.3 * (sample + 6 * sample**0.5) / max(1, many))
    number = F.pmod(F.xxhash64("__url"), F.lit(1 << 52))
    some = labelled.where(number < F.lit(part * float(1 << 52))).select("__url", "host", "path", "__bucket", "__label").distinct()
    chosen = some.orderBy(F.pmod(F.xxhash64("__url"), F.lit(1 << 52)), "__url").limit(sample).collect()
    x = features([r[0] for r in chosen], [r[1] for r in chosen], [r[2] for r in chosen], np.array([r[3] for r in chosen], np.int64), share, count)
    y = np.array([r[4] == "block" for r in chosen], np.float64)
    return UrlModel(fit_trees(x, y, **options), share, count)


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES, sample: int = 20_000, **options: object) -> DataFrame:
    """One row for each row of ``pages``: id, host, path, rule, verdict, score.

    ``rule`` is the longest rule that holds, or null; ``verdict`` is its verdict, or else that of the
    trees, whose probability of ``block`` is ``score``. A null URL or one without ``://`` has an empty
    host and path and no rule. Without labelled URLs the trees say the base rate. Null ids stay null,
    repeated rows are judged each, an empty table gives no rows; other columns are not read.
    """
    rows = prepared(pages, id_col, url_col, rules)
    shared = pages.sparkSession.sparkContext.broadcast(fit_url_model(rows, sample, **options))
    schema = rows.select(id_col, "host", "path", "rule", "__label", F.lit(0.0).alias("score")).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            host, path = batch.column(2), batch.column(3)
            urls = [u or "" for u in batch.column(1).to_pylist()]
            buckets = batch.column(6).to_numpy(zero_copy_only=False).astype(np.int64)
            x = features(urls, host.to_pylist(), path.to_pylist(), buckets, model.share, model.count)
            p = 1 / (1 + np.exp(-np.clip(model.trees.margin(x), -40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column(0), host, path, batch.column(4), batch.column(5), pa.array(p, pa.float64())], names=[id_col, "host", "path", "rule", "__label", "score"])

    judged = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return rows.mapInArrow(score, schema).select(id_col, "host", "path", "rule", F.coalesce("__label", judged).alias("verdict"), "score")
