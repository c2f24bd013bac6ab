"""Running totals of groups of any size: blocks of a range each, and what stands before a block.

A window over a group is one task. Here a group is cut at quantiles of a sample of its order into blocks, a
window holds one block, and the totals of the blocks before it (one row a block) are added. Rows and totals are two readings of
the cuts, which may be computed twice: they must not depend on the order in which rows arrive, as merged quantile sketches do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCKS = 64
#: Distinct values of a group that are drawn for each block's cut.
DRAWN = 64
_FIRST = Window.unboundedPreceding


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys that may be null; the right side has one row a key."""
    if not keys:
        return left.crossJoin(F.broadcast(right))  # one row
    named = right.select(*[F.col(k).alias(f"__key{j}") for j, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"__key{j}")) for j, k in enumerate(keys)]
    return left.join(named, on, "left").drop(*[f"__key{j}" for j in range(len(keys))])


def in_blocks(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """``df`` with __block: rows of a later block of a group come after those of an earlier one, equal ones share it.

    ``order`` must be a number or a time; nulls are in the first block. Values are drawn by their hash at a rate that follows from
    the group's number of distinct ones, and weigh as their rows do.
    """
    sizes = df.groupBy(*by).agg(F.approx_count_distinct(order).alias("__distinct"))
    number = F.pmod(F.xxhash64(order), F.lit(1 << 40)).cast("double")
    drawn = null_safe_join(df.select(*by, order), sizes, by).where(F.col(order).isNotNull() & (number * F.col("__distinct") <= float(DRAWN * BLOCKS << 40)))
    drawn = drawn.groupBy(*by, order).agg(F.count("*").alias("__m"))
    group = Window.partitionBy(*by)
    before = F.sum("__m").over(group.orderBy(order)) - F.col("__m")
    share = drawn.select(*by, order, F.floor(before * BLOCKS / F.sum("__m").over(group)).alias("__share"))
    cuts = share.groupBy(*by, "__share").agg(F.max(order).alias("__cut")).groupBy(*by).agg(F.array_sort(F.collect_list("__cut")).alias("__cuts"))
    place = F.size(F.filter("__cuts", lambda c: c < F.col(order)))
    return null_safe_join(df, cuts, by).withColumn("__block", F.when(F.col(order).isNull() | F.col("__cuts").isNull(), 0).otherwise(place)).drop("__cuts")


def with_totals_before(df: DataFrame, by: list[str], **sums: Column) -> DataFrame:
    """Rows of :func:`in_blocks` with the sums over all earlier blocks of their group, 0 for the first."""
    totals = df.groupBy(*by, "__block").agg(*[F.sum(c).alias(name) for name, c in sums.items()])
    earlier = Window.partitionBy(*by).orderBy("__block").rowsBetween(_FIRST, -1)
    return null_safe_join(df, totals.select(*by, "__block", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(n) for n in sums]), [*by, "__block"])


def block_window(by: list[str], order: list[Column]) -> Window:
    return Window.partitionBy(*by, "__block").orderBy(*order)
