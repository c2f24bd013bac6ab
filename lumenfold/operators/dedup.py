"""Duplicates under a stated rule, and keyed joins that say what became of every row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order. Use descending orders for last-wins and latest-wins.

    Two-phase aggregation of the row struct: rows of a hot key are reduced before they are shuffled,
    where a window would bring them all to one task.
    """
    sort = F.struct(*[c.alias(f"_{k}") for k, c in enumerate(order)])
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.min_by(row, sort).alias("__row")).select("__row.*")


def first_wins(df: DataFrame, keys: list[str], seq: list[str]) -> DataFrame:
    return first_by(df, keys, [F.col(c) for c in seq])


def last_by(df: DataFrame, keys: list[str], seq: list[str]) -> DataFrame:
    """The last row of each key; ``seq`` must be a total order."""
    sort = F.struct(*[F.col(c).alias(f"_{k}") for k, c in enumerate(seq)])
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.max_by(row, sort).alias("__row")).select("__row.*")


def last_content_first_place(df: DataFrame, key: Column, seq: str) -> DataFrame:
    """Last row of each lower-cased key, ordered by the first row's place (``place``); ``copies`` counts rows."""
    row = F.struct(*[F.col(c) for c in df.columns])
    out = df.groupBy(F.lower(key).alias("__key")).agg(F.max_by(row, F.col(seq)).alias("__row"), F.min(seq).alias("place"), F.count("*").alias("copies"))
    return out.select("__row.*", "place", "copies")


def union_first_wins(tables: list[DataFrame], keys: list[str], seq: list[str]) -> DataFrame:
    """Union in order of the list; of each key the first row of the earliest table."""
    tagged = [t.withColumn("__table", F.lit(k)) for k, t in enumerate(tables)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return first_wins(out, keys, ["__table", *seq]).drop("__table")


def not_done(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key the ledger does not have: resume once, in bulk."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def split_by_match(df: DataFrame, other: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with a partner, rows without one)."""
    known = other.select(*keys).distinct()
    return df.join(known, keys, "left_semi"), df.join(known, keys, "left_anti")


def upsert(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``changes`` replace those of the same key and add the rest."""
    return table.join(changes.select(*keys), keys, "left_anti").unionByName(changes)


def with_fallback(df: DataFrame, lookups: list[tuple[DataFrame, list[str]]], value: str) -> DataFrame:
    """``value`` from the first lookup (table, keys) that has it, exact key before coarser ones."""
    names = []
    for k, (table, keys) in enumerate(lookups):
        name = f"__{value}_{k}"
        df = df.join(table.select(*keys, F.col(value).alias(name)), keys, "left")
        names.append(name)
    return df.withColumn(value, F.coalesce(*names)).drop(*names)


def best_candidate(df: DataFrame, keys: list[str], candidates: str, target: DataFrame, name: str) -> DataFrame:
    """For each key the first of its ordered candidates (array) that ``target`` has; null if it has none."""
    tried = df.select(*keys, F.posexplode(candidates).alias("__rank", name))
    found = tried.join(target.select(name).distinct(), name, "left_semi")
    best = found.groupBy(*keys).agg(F.min_by(name, "__rank").alias(name))
    return df.join(best, keys, "left")


def unique_match(df: DataFrame, target: DataFrame, key: str, value: str) -> DataFrame:
    """``value`` of the target with the same key, only if exactly one has it; ``matches`` counts."""
    once = target.groupBy(key).agg(F.count("*").alias("matches"), F.min(value).alias("__value"))
    out = df.join(once, key, "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    return out.withColumn(value, F.when(F.col("matches") == 1, F.col("__value"))).drop("__value")


def phantoms(pending: DataFrame, requests: DataFrame, accepted_sizes: DataFrame, file: str, key: str, size: str) -> DataFrame:
    """Pending rows whose key is in no request file of an accepted size."""
    sizes = requests.groupBy(file).agg(F.count("*").alias(size))
    files = sizes.join(accepted_sizes.select(size).distinct(), size, "left_semi").select(file)
    real = requests.join(files, file, "left_semi").select(key).distinct()
    return pending.join(real, key, "left_anti")
