"""Report tables over judgements, human reviews and slots: reliability, comparison, significance, agreement, audits.

All of them are small results of aggregations; what is unknown stays null and is counted, never read as zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.scoring import alpha_verdict, category, correlation_verdict
from lumenfold.operators.aggregate import full_grid
from lumenfold.operators.dedup import last_by
from lumenfold.operators.statistics import benjamini_hochberg, bland_altman, bootstrap_ci, cohen_kappa, correlation, krippendorff_alpha, rank_correlation, wilcoxon


def one_rating(rows: DataFrame, keys: list[str], judge: str, value: str) -> DataFrame:
    """One rating of a judge for each unit: duplicates are averaged, as two observations; nulls are none."""
    return rows.where(F.col(value).isNotNull()).groupBy(*keys, judge).agg(F.avg(value).alias(value))


def reliability(rows: DataFrame, by: list[str], unit: list[str], judge: str, value: str) -> DataFrame:
    """For each group: n_judges, n_comparable, available, alpha, mean, variance, verdict.

    Alpha is that of one rating a judge and unit; mean and population variance are those of all ratings. A group is available
    with two judges or more, of which two have rated one unit at least; else its figures are null.
    """
    alpha = krippendorff_alpha(one_rating(rows, [*by, *unit], judge, value), by, unit, value).select(*by, "n_units", F.col("alpha").alias("__alpha"))
    named = F.nullif(F.trim(F.col(judge)), F.lit(""))
    raw = rows.groupBy(*by).agg(F.count_distinct(named).alias("n_judges"), F.avg(value).alias("mean"), F.var_pop(value).alias("variance"))
    out = raw.join(alpha, by, "left").withColumn("n_comparable", F.coalesce("n_units", F.lit(0))).withColumn("available", (F.col("n_judges") >= 2) & (F.col("n_comparable") > 0))
    known = lambda c: F.when(F.col("available"), F.col(c))
    figures = [known("__alpha").alias("alpha"), known("mean").alias("mean"), known("variance").alias("variance")]
    return out.select(*by, "n_judges", "n_comparable", "available", *figures, alpha_verdict(known("__alpha"), F.col("n_comparable")).alias("verdict"))


def per_criterion(rows: DataFrame, keys: list[str], criteria: list[str]) -> DataFrame:
    """Judgements in long form: keys, criterion, score (nulls stay)."""
    return rows.select(*keys, *[F.col(c).cast("double") for c in criteria]).unpivot(keys, criteria, "criterion", "score")


def cost_index(slots: DataFrame, keys: list[str], seq: list[str], prices: DataFrame, provider: str = "provider") -> DataFrame:
    """keys, cost in USD of the last successful slot of each key whose tokens are known.

    ``slots``: keys, status, tokens_in, tokens_out; ``prices``: provider, pin, pout (USD a million tokens). A provider
    without a price has no cost.
    """
    done = slots.where("status = 'success' and tokens_in is not null and tokens_out is not null").join(F.broadcast(prices), provider)
    cost = ((F.col("tokens_in") * F.col("pin") + F.col("tokens_out") * F.col("pout")) / 1_000_000).alias("cost")
    return last_by(done.select(*keys, *[c for c in seq if c not in keys], cost), keys, seq).select(*keys, "cost")


def provider_comparison(scores: DataFrame, costs: DataFrame, keys: list[str], provider: str = "provider", resamples: int | None = None) -> DataFrame:
    """One row for each provider: items, mean qualities, cost mean, total and number, cost of a quality point, disagreement, place.

    ``costs`` (keys, cost) is joined from the left: an item without one has a quality all the same. With
    ``resamples`` the unweighted mean has a bootstrap interval.
    """
    one = scores.join(costs, keys, "left")
    out = one.groupBy(provider).agg(
        F.count("unweighted").alias("n_items"), F.avg("unweighted").alias("mean_unweighted"), F.avg("weighted").alias("mean_weighted"),
        F.avg("cost").alias("mean_usd"), F.sum("cost").alias("total_usd"), F.count("cost").alias("n_priced"), F.avg("disagreement").alias("mean_disagreement"),
    )
    out = out.withColumn("cost_per_point", F.try_divide("mean_usd", "mean_unweighted"))
    if resamples:
        out = out.join(bootstrap_ci(scores, [provider], "unweighted", resamples).select(provider, "low", "high"), provider, "left")
    return placed(out, "mean_unweighted")


def placed(report: DataFrame, value: str) -> DataFrame:
    """``place`` in descending order of a value, ties sharing one and nulls last, and ``top``: whether it shares the first.

    Ranked by a window over the report, one row for each provider or label, so that each value is computed once: a mean that
    is computed twice may differ from itself in its last bit.
    """
    out = report.withColumn("place", F.rank().over(Window.orderBy(F.col(value).desc_nulls_last())).cast("long"))
    return out.withColumn("top", (F.col("place") == 1) & F.col(value).isNotNull())


def pairwise_significance(scores: DataFrame, item: list[str], provider: str, value: str, least: int = 10) -> DataFrame:
    """Each pair of providers over the items that both have: n_shared, n, W+, W-, mean difference, p, p_adjusted, underpowered.

    The scores of an item meet as one array, as long as there are providers. Means are those of all shared items, zero differences
    included; signed ranks leave these out. Differences are equal if nine digits are. Pairs without a difference have no test and are not in the family.
    """
    lists = scores.where(F.col(value).isNotNull()).groupBy(*item).agg(F.array_sort(F.collect_list(F.struct(F.col(provider).alias("p"), F.col(value).alias("v")))).alias("x"))
    others = lambda a, i: F.transform(F.slice("x", i + 2, F.greatest(F.lit(0), F.size("x"))), lambda b: F.struct(a["p"].alias("provider_a"), b["p"].alias("provider_b"), F.round(a["v"] - b["v"], 9).alias("d")))
    diffs = lists.select(F.explode(F.flatten(F.transform("x", others))).alias("d")).select("d.*")
    pair = ["provider_a", "provider_b"]
    shared = diffs.groupBy(*pair).agg(F.count("*").alias("n_shared"), F.avg("d").alias("mean_diff"))
    tests = benjamini_hochberg(wilcoxon(diffs, pair, "d").drop("mean_diff"), [], "p").withColumnRenamed("q", "p_adjusted")
    return shared.join(tests, pair, "left").withColumn("underpowered", F.col("n_shared") < least).withColumn("available", F.col("p").isNotNull()).drop("ties")


def subscription_efficiency(report: DataFrame, price: float = 20.0, items: int = 500, provider: str = "provider", quality: str = "mean_unweighted") -> DataFrame:
    """Quality for the price of one summary of a subscription, the best first."""
    cost = price / items
    out = report.select(provider, F.col(quality).alias("mean_quality"), F.lit(cost).alias("cost_per_summary"), F.round(F.col(quality) / cost, 3).alias("efficiency"))
    return out.orderBy(F.desc_nulls_last("efficiency"), provider)


def agreement(pairs: DataFrame, by: list[str], human: str, jury: str) -> DataFrame:
    """How a human series and the jury's agree in each group: n, pearson, spearman, bias, sd, limits, kappas, verdict.

    Kappas are those of whole scores from 1 to 5. The verdict is on ranks, or on r if ranks say nothing.
    """
    some = pairs.where(F.col(human).isNotNull() & F.col(jury).isNotNull())
    r = correlation(some, by, human, jury).withColumnRenamed("r", "pearson")
    rho = rank_correlation(some, by, human, jury).select(*by, F.col("rho").alias("spearman"))
    limits = bland_altman(some, by, human, jury).drop("n")
    classes = some.select(*by, category(F.col(human)).alias("a"), category(F.col(jury)).alias("b"))
    plain = cohen_kappa(classes, "a", "b", by=by).select(*by, "agreement", "kappa", "undefined")
    quadratic = cohen_kappa(classes, "a", "b", "quadratic", by=by).select(*by, F.col("kappa").alias("kappa_quadratic"))
    out = r
    for x in (rho, limits, plain, quadratic):
        out = out.join(x, by, "left")
    return out.withColumn("verdict", correlation_verdict(F.coalesce("spearman", "pearson"), F.col("n")))


def human_means(reviews: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One human value for each item: the mean over whoever has reviewed it."""
    return reviews.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.avg(value).alias(value))


def covariate_report(scores: DataFrame, pairs: DataFrame, provider: str, stratum: str, flag: str, human: str = "human", jury: str = "jury", least: int = 5) -> DataFrame:
    """Every (stratum, provider) cell: items, flag rates of the reported items, missing, quality, kappas and their warnings.

    ``scores`` have one row an item with ``unweighted`` and the verdicts of ``flag``; ``pairs`` human and jury scores.
    """
    known = F.col(f"{flag}_majority").isNotNull()
    cells = scores.groupBy(stratum, provider).agg(
        F.count("*").alias("n_items"),
        F.avg(F.col(f"{flag}_majority").cast("int")).alias("rate"),
        F.avg(F.when(known, F.col(f"{flag}_any").cast("int"))).alias("any_rate"),
        F.count_if(~known).alias("n_missing"),
        F.avg("unweighted").alias("mean_quality"),
    )
    grid = full_grid(cells, stratum, provider)
    classes = pairs.select(stratum, provider, category(F.col(human)).alias("a"), category(F.col(jury)).alias("b"))
    quadratic = cohen_kappa(classes, "a", "b", "quadratic", by=[stratum, provider])
    kappas = quadratic.select(stratum, provider, F.col("n").alias("kappa_n"), F.col("kappa").alias("kappa_quadratic"), "agreement", F.col("undefined").alias("kappa_undefined"))
    out = grid.join(kappas, [stratum, provider], "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_items", "n_missing", "kappa_n")]
    return out.select(stratum, provider, *counts, "rate", "any_rate", "mean_quality", "kappa_quadratic", "agreement", "kappa_undefined", (F.coalesce("kappa_n", F.lit(0)) < least).alias("kappa_underpowered"))


def status_counts(slots: DataFrame, by: list[str], status: str = "status") -> DataFrame:
    """Slots of each status; a slot without one has not been started."""
    return slots.groupBy(*by, F.coalesce(F.col(status), F.lit("not_started")).alias("status")).agg(F.count("*").alias("n"))


def progress(rows: DataFrame, by: list[str], mock: Column, flagged: Column) -> DataFrame:
    """Judgements that are no mocks, and how many of them are flagged."""
    real = ~F.coalesce(mock, F.lit(False))
    return rows.groupBy(*by).agg(F.count_if(real).alias("n_judged"), F.count_if(real & F.coalesce(flagged, F.lit(False))).alias("n_flagged"), F.count_if(~real).alias("n_mock"))


def leaderboard(comparison: DataFrame, reliable: DataFrame, human: DataFrame, provider: str = "provider") -> DataFrame:
    """The comparison with each provider's reliability and agreement with humans; a provider without these stays."""
    alpha = reliable.select(provider, "alpha", F.col("verdict").alias("alpha_verdict"))
    agreed = human.select(provider, F.col("n").alias("n_human"), F.col("spearman").alias("human_spearman"))
    return comparison.join(alpha, provider, "left").join(agreed, provider, "left").withColumn("n_human", F.coalesce("n_human", F.lit(0)))


def audit(rows: DataFrame, key: str, stored: Column, recomputed: Column, tolerance: float = 1e-6, examples: int = 3) -> DataFrame:
    """One row: n, n_match, n_mismatch, n_missing and the least ``examples`` keys that differ.

    Two nulls agree, a null and a number differ; ``n_missing`` counts rows without a stored value. Examples are
    the least keys of all tasks, a bounded number of each.
    """
    same = F.coalesce(F.abs(stored - recomputed) <= tolerance, stored.isNull() & recomputed.isNull())
    checked = rows.select(F.col(key), same.alias("same"), stored.isNull().alias("missing"))
    counts = checked.agg(F.count("*").alias("n"), F.count_if("same").alias("n_match"), F.count_if(~F.col("same")).alias("n_mismatch"), F.count_if("missing").alias("n_missing"))
    first = checked.where(~F.col("same")).orderBy(key).limit(examples).agg(F.array_sort(F.collect_list(key)).alias("examples"))
    return counts.crossJoin(first)  # one row each
