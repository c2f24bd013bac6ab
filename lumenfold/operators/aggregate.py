"""Item-weighted aggregation of judgements: duplicates of a judge, then judges, then groups.

A judgement table has columns item, provider, judge, the criteria, flags (null: not recorded). Every table
hangs off :func:`item_scores`; a missing value leaves a mean's denominator and is never zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.scoring import WEIGHTS, plain_mean, weighted_mean

#: Up to so many labels of a grid's column axis are broadcast.
BROADCAST_LABELS = 10_000


def per_judge(rows: DataFrame, keys: list[str], criteria: list[str], flags: list[str] = [], carry: list[str] = []) -> DataFrame:  # noqa: B006
    """Duplicate judgements of one judge: criteria averaged, flags ORed (null if none is known), rows counted."""
    return rows.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in criteria], *[F.bool_or(f).alias(f) for f in flags], *[F.min(c).alias(c) for c in carry], F.count("*").alias("n_rows"))


def majority(flag: str) -> list[Column]:
    """Strict majority of the known verdicts, any, share, and how many are unknown."""
    known, yes = F.count(flag), F.count_if(F.col(flag))
    return [F.when(known > 0, yes * 2 > known).alias(f"{flag}_majority"), F.bool_or(flag).alias(f"{flag}_any"), F.avg(F.col(flag).cast("int")).alias(f"{flag}_rate"), F.count_if(F.col(flag).isNull()).alias(f"{flag}_missing")]


def item_scores(rows: DataFrame, item: list[str], provider: str = "provider", judge: str = "judge", criteria: dict[str, float] = WEIGHTS, flags: list[str] = [], carry: list[str] = []) -> DataFrame:  # noqa: B006
    """One row for each (item, provider): unweighted, weighted, each criterion, verdicts, n_judges, n_rows.

    Rows without a judge stay judges of their own; the composites are recomputed from averaged criteria.
    """
    key = F.coalesce(F.nullif(F.trim(F.col(judge)), F.lit("")), F.concat(F.lit("__row_"), F.monotonically_increasing_id()))
    names = list(criteria)
    one = per_judge(rows.withColumn(judge, key), [*item, provider, judge], names, flags, carry)
    cols = {c: F.col(c) for c in names}
    one = one.withColumn("unweighted", plain_mean(cols)).withColumn("weighted", weighted_mean(cols, criteria))
    judges = F.greatest(F.count("unweighted"), F.count("weighted")).alias("n_judges")
    spread = (F.max("unweighted") - F.min("unweighted")).alias("disagreement")
    verdicts = [c for f in flags for c in majority(f)]
    return one.groupBy(*item, provider).agg(F.avg("unweighted").alias("unweighted"), F.avg("weighted").alias("weighted"), spread, *[F.avg(c).alias(c) for c in names], *verdicts, *[F.min(c).alias(c) for c in carry], judges, F.sum("n_rows").alias("n_rows"))


def group_report(scores: DataFrame, by: list[str], flags: list[str] = []) -> DataFrame:  # noqa: B006
    """Item-weighted means of each group: n_items, n_rows, n_scored and the rate of each verdict."""
    rates = [F.avg(F.col(f"{f}_majority").cast("int")).alias(f"{f}_rate") for f in flags] + [F.avg(F.col(f"{f}_any").cast("int")).alias(f"{f}_any_rate") for f in flags]
    return scores.groupBy(*by).agg(F.count("*").alias("n_items"), F.sum("n_rows").alias("n_rows"), F.count("unweighted").alias("n_scored"), F.avg("unweighted").alias("mean_unweighted"), F.avg("weighted").alias("mean_weighted"), *rates)


def report_by_fields(scores: DataFrame, fields: list[str], flags: list[str] = []) -> DataFrame:  # noqa: B006
    """One pass for several groupings: a row for each (field, value)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit("unknown")).alias("value")) for f in fields]))
    return group_report(scores.select("*", pairs.alias("__p")).select("*", "__p.field", "__p.value"), ["field", "value"], flags)


def crosstab(scores: DataFrame, stratum: str, provider: str, providers: list[str], value: str = "unweighted") -> DataFrame:
    """stratum by provider: mean and n of each cell, with the number of provider-items of the row."""
    cell = lambda p: F.col(provider) == p
    cols = [x for p in providers for x in (F.avg(F.when(cell(p), F.col(value))).alias(f"mean_{p}"), F.count(F.when(cell(p), F.col(value))).alias(f"n_{p}"))]
    return scores.groupBy(stratum).agg(*cols, F.count(value).alias("n_provider_items"))


def criterion_means(scores: DataFrame, provider: str = "provider", criteria: list[str] = list(WEIGHTS)) -> DataFrame:  # noqa: B006
    """provider by criterion, long form."""
    rows = scores.select(provider, F.explode(F.array(*[F.struct(F.lit(c).alias("criterion"), F.col(c).alias("score")) for c in criteria])).alias("x"))
    return rows.groupBy(provider, "x.criterion").agg(F.avg("x.score").alias("mean_score"), F.count("x.score").alias("n"))


def hit_rate(rows: DataFrame, by: list[str], read: str, total: str) -> DataFrame:
    """Cached share of the input over rows that recorded it."""
    known = F.col(read).isNotNull()
    return rows.groupBy(*by).agg(F.count_if(known).alias("n_recorded"), F.sum(read).alias("read"), F.sum(F.when(known, F.col(total))).alias("total"), F.try_divide(F.sum(read), F.sum(F.when(known, F.col(total)))).alias("hit_rate"))


def mixed_provenance(rows: DataFrame, by: str, fields: list[str]) -> DataFrame:
    """Groups that mix values of a field; null counts as a value."""
    shown = [F.count_distinct(F.coalesce(F.col(f).cast("string"), F.lit("(none)"))).alias(f"n_{f}") for f in fields]
    out = rows.groupBy(by).agg(*shown)
    return out.withColumn("mixed", F.greatest(*[F.col(f"n_{f}") for f in fields], F.lit(0)) > 1)


def quota_status(counts: DataFrame, by: str, kinds: list[str], kind: str, target: int) -> DataFrame:
    """Counts by kind in each group and what is missing to the target."""
    cols = [F.count_if(F.col(kind) == k).alias(f"n_{k}") for k in kinds]
    out = counts.groupBy(by).agg(*cols, F.count("*").alias("n"), F.array_sort(F.collect_set(kind)).alias("kinds"))
    return out.withColumn("deficit", F.greatest(F.lit(0), F.lit(target) - F.col(f"n_{kinds[0]}")))


def full_grid(cells: DataFrame, row: str, column: str) -> DataFrame:
    """Every value of ``row`` with every value of ``column``, empty cells null.

    Both sides are distinct labels of a report; the product has one row for each cell of the table. Up to
    ``BROADCAST_LABELS`` columns are broadcast after they have been counted; beyond, the product is not.
    """
    labels = cells.select(column).distinct()
    if labels.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS:
        labels = F.broadcast(labels)
    grid = cells.select(row).distinct().crossJoin(labels)
    return grid.join(cells, [row, column], "left")


def first_metrics_mean(rows: DataFrame, item: list[str], by: list[str], seq: list[str], metrics: list[str]) -> DataFrame:
    """Metrics of the first row of an item, then means over items, rounded to 4."""
    sort = F.struct(*[F.col(c).alias(f"_{k}") for k, c in enumerate(seq)])
    first = rows.groupBy(*by, *item).agg(*[F.min_by(m, sort).alias(m) for m in metrics])
    return first.groupBy(*by).agg(*[F.round(F.avg(m), 4).alias(m) for m in metrics], F.count("*").alias("n_items"))


def density_report(pairs: DataFrame, by: str, band: str, length: str) -> DataFrame:
    """Shares of high, moderate and low among the known, of shorter, same and longer among all."""
    known = F.count_if(F.col(band) != "unknown")
    bands = [F.try_divide(F.count_if(F.col(band) == b), known).alias(f"share_{b}") for b in ("high", "moderate", "low")]
    lengths = [(F.count_if(F.col(length) == v) / F.count("*")).alias(f"share_{v}") for v in ("shorter", "same", "longer")]
    return pairs.groupBy(by).agg(F.count("*").alias("n"), known.alias("n_known"), *bands, *lengths)
