"""Deterministic samples: quotas, rounds over strata, carried overlap, budgets.

A seeded shuffle is the order of md5(seed | key): the same in every engine and at every size. Ranks within a
stratum keep only as many rows as can be chosen, so a window never has to hold more than Spark streams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.operators.prefix import block_window, in_blocks, with_totals_before


def shuffle_key(seed: int, *cols: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str = "round") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def per_stratum(df: DataFrame, stratum: str, n: int, key: str, seed: int, unknown: str | None = None) -> DataFrame:
    """``n`` rows of each stratum."""
    if unknown is not None:
        df = df.where(F.coalesce(F.col(stratum), F.lit(unknown)) != unknown)
    return ranked(df, [stratum], [shuffle_key(seed, key), F.col(key)]).where(F.col("round") <= n)


def round_robin(df: DataFrame, stratum: str, n: int, key: str, seed: int) -> DataFrame:
    """``n`` rows, one of each stratum per round. A stratum never needs more than ``n``."""
    some = ranked(df, [stratum], [shuffle_key(seed, key), F.col(key)]).where(F.col("round") <= n)
    return some.orderBy("round", shuffle_key(seed, stratum), stratum).limit(n)


def flagged_first(df: DataFrame, flag: str, stratum: str, n: int, key: str, seed: int, most: int | None = None) -> DataFrame:
    """Flagged rows first (at most ``most``), then rounds over the strata, ``n`` in all."""
    most = n if most is None else most
    flagged = df.where(F.coalesce(F.col(flag), F.lit(False))).orderBy(shuffle_key(seed, key), key).limit(min(n, most)).select("*", F.lit(0).alias("round"))
    rest = df.join(flagged.select(key), key, "left_anti")
    rest = ranked(rest, [stratum], [shuffle_key(seed, key), F.col(key)]).where(F.col("round") <= n)
    return flagged.unionByName(rest).orderBy((F.col("round") > 0), "round", shuffle_key(seed, stratum), shuffle_key(seed, key), key).limit(n)


def quota(df: DataFrame, stratum: str, quotas: DataFrame, key: str, seed: int, on_shortfall: str = "error") -> DataFrame:
    """Exactly ``quota`` rows of each stratum of ``quotas`` (stratum, quota).

    ``error`` raises in the query if a stratum has too few; ``backfill`` takes as many more from the other rows
    of the named strata; ``report`` returns what there is.
    """
    if on_shortfall not in ("error", "backfill", "report"):
        raise ValueError(on_shortfall)
    ranks = ranked(df.join(F.broadcast(quotas), stratum), [stratum], [shuffle_key(seed, key), F.col(key)])
    taken = ranks.where(F.col("round") <= F.col("quota"))
    have = quotas.join(taken.groupBy(stratum).agg(F.count("*").alias("n")), stratum, "left").select((F.col("quota") - F.coalesce("n", F.lit(0))).alias("gap"))
    if on_shortfall == "report":
        return taken.drop("quota")
    if on_shortfall == "error":
        short = have.agg(F.max("gap").alias("gap"))
        checked = short.select(F.assert_true(F.coalesce(F.col("gap"), F.lit(0)) <= 0, F.lit("a stratum has fewer rows than its quota")).alias("ok"))
        return taken.drop("quota").join(F.broadcast(checked), F.coalesce(F.col("ok").cast("string"), F.lit("ok")) == "ok", "left").drop("ok")
    gap = have.agg(F.sum("gap").cast("long").alias("gap"))
    most = int(quotas.agg(F.sum("quota")).collect()[0][0] or 0)  # no more than that can be missing
    spare = ranks.where((F.col("round") > F.col("quota")) & (F.col("round") <= F.col("quota") + most)).orderBy(shuffle_key(seed + 1, key), key).limit(most)
    spare = spare.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(shuffle_key(seed + 1, key), key)))
    extra = spare.join(F.broadcast(gap)).where(F.col("place") <= F.col("gap")).drop("place", "gap")
    return taken.unionByName(extra).drop("quota")


def interleave(df: DataFrame, group: str, order: str, seed: int) -> DataFrame:
    """Rows in rounds, one of each group a round, so that a group's rows do not meet while others have some.

    ``round`` is the round, ``group_key`` orders the groups in it; :func:`in_rounds` is the whole order.
    """
    out = ranked(df, [group], [F.col(order)])
    return out.withColumn("group_key", shuffle_key(seed, group))


def in_rounds(df: DataFrame, group: str, order: str, seed: int) -> DataFrame:
    """The rows of :func:`interleave` in that order."""
    return interleave(df, group, order, seed).orderBy("round", "group_key", group)


def carried_overlap(pool: DataFrame, previous: DataFrame, stratum: str, key: str, item: str, per_stratum_n: int, overlap: float, seed: int, on_shortfall: str = "report") -> DataFrame:
    """``round(n * overlap)`` (half to even) earlier keys of each stratum in their item order, the rest from keys not seen before.

    Only earlier keys that are still in the pool are carried. A stratum with too few new keys gives what it has (``report``), or takes
    the gap from its own other keys of the pool, seen ones included (``backfill``), or raises in the query (``error``).
    """
    if on_shortfall not in ("error", "backfill", "report"):
        raise ValueError(on_shortfall)
    keep = min(round(per_stratum_n * overlap), per_stratum_n)
    seen = previous.groupBy(stratum, key).agg(F.min(item).alias("first_item"))
    eligible = seen.join(pool.select(key).distinct(), key, "left_semi")
    carried = ranked(eligible, [stratum], [F.col("first_item"), F.col(key)]).where(F.col("round") <= keep).select(stratum, key, F.lit(True).alias("carried"))
    new = F.col("__seen").isNull()
    rest = pool.select(stratum, key).join(carried.select(key), key, "left_anti").join(seen.select(key).distinct().withColumn("__seen", F.lit(True)), key, "left")
    if on_shortfall != "backfill":
        rest = rest.where(new)
    had = carried.groupBy(stratum).agg(F.count("*").alias("had"))
    rest = ranked(rest, [stratum], [F.col("__seen").isNotNull(), shuffle_key(seed, key), F.col(key)])
    rest = rest.join(had, stratum, "left").where(F.col("round") <= per_stratum_n - F.coalesce("had", F.lit(0)))
    out = carried.unionByName(rest.select(stratum, key, F.lit(False).alias("carried")))
    if on_shortfall != "error":
        return out
    counts = pool.select(stratum).distinct().join(out.groupBy(stratum).agg(F.count("*").alias("n")), stratum, "left")
    checked = counts.agg(F.min(F.coalesce("n", F.lit(0))).alias("n")).select(F.assert_true(F.coalesce(F.col("n"), F.lit(per_stratum_n)) >= per_stratum_n, F.lit("a stratum has too few keys")).alias("ok"))
    return out.join(F.broadcast(checked), F.coalesce(F.col("ok").cast("string"), F.lit("ok")) == "ok", "left").drop("ok")


def year_quotas(df: DataFrame, stratum: str, year: str, years: list[int], n: int, key: str) -> DataFrame:
    """``n`` a stratum: an equal quota for each year, the first years one more, then free places by order."""
    base, more = divmod(n, len(years))
    quota_of = F.coalesce(*[F.when(F.col(year) == y, F.lit(base + (k < more))) for k, y in enumerate(years)], F.lit(0))
    strict = ranked(df, [stratum, year], [F.col(key)], "place").withColumn("strict", F.col("place") <= quota_of)
    order = [F.desc("strict"), F.col(key)]
    return ranked(strict, [stratum], order).where(F.col("round") <= n).drop("place")


def deficit_sample(pool: DataFrame, have: DataFrame, stratum: str, key: str, target: int, seed: int, urgent: str | None = None) -> DataFrame:
    """As many rows of each stratum as it lacks to the target, urgent ones first."""
    counts = have.groupBy(stratum).agg(F.count("*").alias("n"))
    order = [*([F.desc(urgent)] if urgent else []), shuffle_key(seed, key), F.col(key)]
    out = ranked(pool, [stratum], order).join(F.broadcast(counts), stratum, "left")
    return out.where(F.col("round") <= F.greatest(F.lit(0), F.lit(target) - F.coalesce("n", F.lit(0)))).drop("n")


def running_total(df: DataFrame, by: list[str], order: list[str], cost: str, limit: float) -> DataFrame:
    """Running spend of each ledger and whether a row is the first beyond the limit.

    The first order column must be a number or a time: a ledger is cut along it, so no task holds a whole one.
    """
    rows = with_totals_before(in_blocks(df, by, order[0]), by, __before=F.col(cost), __known=F.col(cost).isNotNull().cast("long"))
    w = block_window(by, [F.col(c) for c in order])
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spent = F.when(F.col("__known") + F.count(cost).over(so_far) > 0, F.col("__before") + F.coalesce(F.sum(cost).over(so_far), F.lit(0)))
    out = rows.withColumn("spent", spent).withColumn("over", F.col("spent") > limit)
    earlier = F.coalesce(F.lag("over").over(w), F.col("__before") > limit)
    return out.withColumn("stops", F.col("over") & ~earlier).select(*df.columns, "spent", "over", "stops")


def until_quota(df: DataFrame, by: str, order: str, ok: str, target: int, most_failures: int) -> DataFrame:
    """Rows tried in order until a group has ``target`` successes or ``most_failures`` failures before it.

    ``order`` must be a number or a time and differ among the rows of a group.
    """
    won, lost = F.col(ok).cast("long"), (~F.col(ok)).cast("long")
    rows = with_totals_before(in_blocks(df, [by], order), [by], __won=won, __lost=lost)
    w = block_window([by], [F.col(order)]).rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c, before: F.col(before) + F.coalesce(F.sum(c).over(w), F.lit(0))
    out = rows.withColumn("done", so_far(won, "__won")).withColumn("lost", so_far(lost, "__lost"))
    return out.select(*df.columns, "done", "lost").where((F.col("done") < target) & (F.col("lost") < most_failures))


def capped_new(todo: DataFrame, done: DataFrame, keys: list[str], by: list[str], order: list[str], most: int) -> DataFrame:
    """At most ``most`` rows of each group that are not done yet, in natural order: calls make progress."""
    left = todo.join(done.select(*keys).distinct(), keys, "left_anti")
    return ranked(left, by, [F.col(c) for c in order]).where(F.col("round") <= most)


def version_of(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """"version i of n" within a group."""
    w = Window.partitionBy(*by)
    return ranked(df, by, [F.col(c) for c in order], "version").withColumn("versions", F.count("*").over(w))


def best_attempt(df: DataFrame, by: list[str], code: str, priority: list[str], order: str) -> DataFrame:
    """The attempt whose code comes first in a priority list (unknown: 99), then the earliest."""
    rank = F.coalesce(*[F.when(F.col(code) == c, F.lit(k + 1)) for k, c in enumerate(priority)], F.lit(99))
    sort = F.struct(rank.alias("a"), F.col(order).alias("b"))
    row = F.struct(*[F.col(c) for c in df.columns if c not in by])
    return df.groupBy(*by).agg(F.min_by(row, sort).alias("__row"), F.min(rank).alias("priority")).select(*by, "__row.*", "priority")


def in_canonical_order(df: DataFrame, column: str, first: list[str]) -> DataFrame:
    """Known values in their order, then the others sorted."""
    place = F.array_position(F.array(*map(F.lit, first)), F.col(column))
    return df.withColumn("place", F.when(place > 0, place).otherwise(len(first) + 1)).orderBy("place", column)
