"""Statistics as relational plans: sums and ranks in Spark, p-values from published formulas."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from lumenfold.operators.prefix import block_window, in_blocks, null_safe_join, with_totals_before


def krippendorff_alpha(rows: DataFrame, by: list[str], unit: list[str], value: str) -> DataFrame:
    """Interval alpha of each group: 1 - observed / expected disagreement over units with two ratings or more.

    Linear form: ordered pairs of a unit of m ratings have squared differences that sum to 2 m S2 - 2 S1**2.
    Null if no unit can be paired; 1 if nothing differs.
    """
    units = rows.where(F.col(value).isNotNull()).groupBy(*by, *unit).agg(F.count("*").alias("m"), F.sum(value).alias("s1"), F.sum(F.col(value) * F.col(value)).alias("s2")).where("m > 1")
    total = units.groupBy(*by).agg(F.count("*").alias("n_units"), F.sum("m").alias("n"), F.sum("s1").alias("t1"), F.sum("s2").alias("t2"), F.sum((2 * F.col("m") * F.col("s2") - 2 * F.col("s1") * F.col("s1")) / (F.col("m") - 1)).alias("within"))
    observed = F.col("within") / F.col("n")
    expected = (2 * F.col("n") * F.col("t2") - 2 * F.col("t1") * F.col("t1")) / (F.col("n") * (F.col("n") - 1))
    return total.select(*by, "n_units", F.col("n").alias("n_ratings"), F.when(expected == 0, 1.0).otherwise(1 - observed / expected).alias("alpha"))


def pairwise_difference(rows: DataFrame, item: list[str], judge: str, value: str) -> DataFrame:
    """For each pair of judges: items both rated, mean and largest absolute difference.

    The ratings of an item meet as one array (as many as there are judges), so no rows are self-joined.
    """
    lists = rows.where(F.col(value).isNotNull()).groupBy(*item).agg(F.array_sort(F.collect_list(F.struct(judge, value))).alias("x"))
    pairs = F.flatten(F.transform("x", lambda a, i: F.transform(F.slice("x", i + 2, F.greatest(F.lit(0), F.size("x"))), lambda b: F.struct(a[judge].alias("judge_a"), b[judge].alias("judge_b"), F.abs(a[value] - b[value]).alias("d")))))
    flat = lists.select(F.explode(pairs).alias("p")).select("p.*").where("judge_a <> judge_b")
    return flat.groupBy("judge_a", "judge_b").agg(F.count("*").alias("n"), F.avg("d").alias("mean_abs_diff"), F.max("d").alias("max_abs_diff"))


def cohen_kappa(rows: DataFrame, a: str, b: str, weights: str | None = None, by: list[str] = []) -> DataFrame:  # noqa: B006
    """n, agreement, kappa (plain, linear or quadratic) and whether it is undefined (then 1.0), for each group.

    The contingency table is aggregated first. Expected disagreement follows from sums over each side's own counts (of squares,
    of equal labels, or of labels on either side of each cut), so labels never meet labels.
    """
    keys = [*by, "__all"]
    known = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("__all", F.lit(0))
    cells = known.groupBy(*keys, F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).agg(F.count("*").alias("n"))
    x, y, n = F.col("a"), F.col("b"), F.col("n")
    weight = {None: (x != y).cast("double"), "linear": F.abs(x - y), "quadratic": (x - y) * (x - y)}[weights]
    total = cells.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(weight * n).alias("observed"), F.sum(F.when(x == y, n).otherwise(0)).alias("same"), F.sum(x * n).alias("sa"), F.sum(y * n).alias("sb"), F.sum((x * x + y * y) * n).alias("squares"))
    if weights == "quadratic":
        total = total.withColumn("expected", n * F.col("squares") - 2 * F.col("sa") * F.col("sb"))
    else:
        sides = F.explode(F.array(F.struct(x.alias("label"), n.alias("ra"), F.lit(0).cast("long").alias("cb")), F.struct(y.alias("label"), F.lit(0).cast("long").alias("ra"), n.alias("cb"))))
        marginal = cells.select(*keys, sides.alias("m")).groupBy(*keys, "m.label").agg(F.sum("m.ra").alias("ra"), F.sum("m.cb").alias("cb"))
        if weights is None:
            part = total.join(marginal.groupBy(*keys).agg(F.sum(F.col("ra") * F.col("cb")).alias("equal")), keys)
            total = part.withColumn("expected", (n * n - F.col("equal")).cast("double"))
        else:
            order = Window.partitionBy(*keys).orderBy("label")
            so_far = lambda c: F.sum(c).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
            cuts = marginal.select(*keys, (F.lead("label").over(order) - F.col("label")).alias("gap"), so_far("ra").alias("fa"), so_far("cb").alias("fb")).where("gap is not null")
            cuts = cuts.join(total.select(*keys, "n"), keys).groupBy(*keys).agg(F.sum(F.col("gap") * (F.col("fa") * (n - F.col("fb")) + F.col("fb") * (n - F.col("fa")))).alias("expected"))
            total = total.join(cuts, keys, "left").withColumn("expected", F.coalesce("expected", F.lit(0.0)))
    kappa = F.when(F.col("expected") == 0, 1.0).otherwise(1 - F.col("observed") * n / F.col("expected"))
    return total.select(*by, "n", (F.col("same") / n).alias("agreement"), kappa.alias("kappa"), (F.col("expected") == 0).alias("undefined"))


def _pearson(x: Column, y: Column) -> Column:
    return F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y)))


def correlation(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Pearson's r of complete pairs; null for fewer than two or a constant side."""
    pairs = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    r = F.when((F.count("*") > 1) & (F.min(x) != F.max(x)) & (F.min(y) != F.max(y)), _pearson(F.col(x), F.col(y)))
    return pairs.groupBy(*by).agg(F.count("*").alias("n"), r.alias("r"))


def _ranks(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Each distinct value of a group with its rank: counts of them are ranked, not rows, in blocks of a range of values each."""
    counts = in_blocks(df.groupBy(*by, value).agg(F.count("*").alias("__m")), by, value)
    counts = with_totals_before(counts, by, __before=F.col("__m"))
    within = block_window(by, [F.col(value)]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.select(*by, value, (F.col("__before") + F.sum("__m").over(within) - (F.col("__m") - 1) / 2).alias(name))


def average_rank(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Ranks from 1, ties averaged; ``value`` is a number. Distinct values are ranked and joined back."""
    return null_safe_join(df, _ranks(df, by, value, name), [*by, value]).select(*df.columns, name)


def rank_correlation(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Spearman's rho: Pearson's r of average ranks."""
    pairs = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y)
    ranked = null_safe_join(pairs, _ranks(pairs, by, x, "__rx"), [*by, x])
    ranked = null_safe_join(ranked, _ranks(pairs, by, y, "__ry"), [*by, y])
    return correlation(ranked, by, "__rx", "__ry").withColumnRenamed("r", "rho")


def bland_altman(rows: DataFrame, by: list[str], primary: str, reference: str) -> DataFrame:
    d = F.col(primary) - F.col(reference)
    out = rows.where(d.isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(d).alias("bias"), F.coalesce(F.when(F.count("*") > 1, F.stddev_samp(d)), F.lit(0.0)).alias("sd"))
    return out.withColumn("low", F.col("bias") - 1.96 * F.col("sd")).withColumn("high", F.col("bias") + 1.96 * F.col("sd"))


def friedman(rows: DataFrame, block: list[str], treatment: str, value: str, treatments: list[str]) -> DataFrame:
    """Tie-aware statistic over complete blocks, its df, p and mean ranks (struct of the treatments)."""
    k = len(treatments)
    cols = [F.max(F.when(F.col(treatment) == t, F.col(value))).alias(f"v{j}") for j, t in enumerate(treatments)]
    wide = rows.groupBy(*block).agg(*cols)
    wide = wide.where(" and ".join(f"v{j} is not null" for j in range(k)))
    less = lambda j: sum(((F.col(f"v{i}") < F.col(f"v{j}")).cast("double") for i in range(k)), F.lit(0.0))
    same = lambda j: sum(((F.col(f"v{i}") == F.col(f"v{j}")).cast("double") for i in range(k)), F.lit(0.0))
    ranked = wide.select(*[(less(j) + (same(j) + 1) / 2).alias(f"r{j}") for j in range(k)], sum((same(j) * same(j) - 1 for j in range(k)), F.lit(0.0)).alias("tie"))
    sums = ranked.agg(F.count("*").alias("n"), F.sum("tie").alias("ties"), *[F.sum(f"r{j}").alias(f"s{j}") for j in range(k)])
    n = F.col("n")
    squares = sum((F.col(f"s{j}") * F.col(f"s{j}") for j in range(k)), F.lit(0.0))
    raw = 12.0 / (k * (k + 1)) * squares / n - 3 * n * (k + 1)
    fix = 1 - F.col("ties") / (n * k * (k * k - 1))
    statistic = F.when((n >= 2) & (fix > 0), raw / fix).otherwise(0.0)
    out = sums.select("n", statistic.alias("statistic"), F.lit(k - 1).alias("df"), *[(F.col(f"s{j}") / n).alias(f"rank_{t}") for j, t in enumerate(treatments)])
    return out.withColumn("p", chi2_sf(F.col("statistic"), F.lit(k - 1)))


def _gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function, by series or continued fraction."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - total * scale)
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


@F.pandas_udf(DoubleType())
def chi2_sf(x: pd.Series, df: pd.Series) -> pd.Series:
    """Chance that chi-square exceeds x (a few report rows; no SQL form)."""
    return pd.Series([None if math.isnan(a) else _gamma_q(k / 2, a / 2) for a, k in zip(x, df)])


def _beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / max(1e-300, 1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


@F.pandas_udf(DoubleType())
def correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of a correlation by the t distribution with n - 2 degrees of freedom."""
    return pd.Series([None if a is None or math.isnan(a) or k < 3 else _beta((k - 2) / 2, 0.5, max(0.0, 1 - a * a)) for a, k in zip(r, n)])


def signed_rank_p(w_plus: float, w_minus: float, n: int, ties: float, tied: bool) -> float:
    """Two-sided p: exact for up to 50 differences without ties, else normal with continuity correction."""
    if n == 0:
        return 1.0
    w = min(w_plus, w_minus)
    if n <= 50 and not tied:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for k in range(1, n + 1):
            ways[k:] += ways[: len(ways) - k].copy()
        return float(min(1.0, 2 * ways[: int(w) + 1].sum() / 2.0**n))
    mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    if var <= 0:
        return 1.0
    z = max(0.0, abs(w - mean) - 0.5) / math.sqrt(var)
    return math.erfc(z / math.sqrt(2))


@F.pandas_udf(DoubleType())
def signed_rank_p_value(w_plus: pd.Series, w_minus: pd.Series, n: pd.Series, ties: pd.Series) -> pd.Series:
    return pd.Series([signed_rank_p(a, b, int(k), t, t > 0) for a, b, k, t in zip(w_plus, w_minus, n, ties)])


def wilcoxon(rows: DataFrame, by: list[str], diff: str) -> DataFrame:
    """Signed ranks of the non-zero differences: n, W+, W-, mean of those differences, p."""
    some = rows.where(F.col(diff).isNotNull() & (F.col(diff) != 0)).select(*by, diff, F.abs(diff).alias("__size"))
    ranked = average_rank(some, by, "__size", "__rank")
    tied = some.groupBy(*by, "__size").agg(F.count("*").alias("m")).groupBy(*by).agg(F.sum(F.col("m") * F.col("m") * F.col("m") - F.col("m")).cast("double").alias("ties"))
    plus = F.sum(F.when(F.col(diff) > 0, F.col("__rank")).otherwise(0.0))
    minus = F.sum(F.when(F.col(diff) < 0, F.col("__rank")).otherwise(0.0))
    out = ranked.groupBy(*by).agg(F.count("*").alias("n"), plus.alias("w_plus"), minus.alias("w_minus"), F.avg(diff).alias("mean_diff"))
    out = out.join(tied, by) if by else out.crossJoin(tied)
    return out.withColumn("p", signed_rank_p_value("w_plus", "w_minus", "n", "ties"))


def benjamini_hochberg(df: DataFrame, by: list[str], p: str, digits: int = 4) -> DataFrame:
    """q-values of each family of tests (rows of a report), rounded."""
    family = Window.partitionBy(*by)
    up = family.orderBy(F.col(p))
    raw = F.col(p) * F.count(p).over(family) / F.rank().over(up)
    # of equal p the largest rank counts, and q never falls as p grows
    back = family.orderBy(F.desc(p)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.col(p) * F.count(p).over(family) / F.count(p).over(up.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn("__raw", F.least(raw, last)).withColumn("q", F.round(F.least(F.lit(1.0), F.min("__raw").over(back)), digits)).drop("__raw")


def bootstrap_ci(rows: DataFrame, by: list[str], value: str, resamples: int = 2000, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """Percentile interval of the mean of each group; null bounds for fewer than two values.

    A group's distinct values and their counts are what a resample needs (a multinomial draw over them), so
    rows are aggregated before they meet; a task holds a group's distinct values and a bounded number of draws.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__m"))
    known = [StructField(c, counts.schema[c].dataType) for c in by]
    schema = StructType([*known, StructField("n", LongType()), *[StructField(c, DoubleType()) for c in ("mean", "low", "high")]])

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__v")
        v, m = pdf["__v"].to_numpy(), pdf["__m"].to_numpy()
        n, mean = int(m.sum()), float((v * m).sum() / m.sum())
        low = high = None
        if n > 1:
            rng, step = np.random.default_rng(seed), max(1, 2_000_000 // len(v))  # so many draws at a time
            means = np.concatenate([rng.multinomial(n, m / n, min(step, resamples - k)) @ v / n for k in range(0, resamples, step)])
            low, high = np.quantile(means, [alpha / 2, 1 - alpha / 2]).tolist()
        return pd.DataFrame([[*[pdf[c].iloc[0] for c in by], n, mean, low, high]], columns=[*by, "n", "mean", "low", "high"])

    return counts.groupBy(*by).applyInPandas(draw, schema)


def tfidf_cosine(pairs: DataFrame, key: str, left: str, right: str, stop_words: list[str] = []) -> DataFrame:  # noqa: B006
    """Cosine of smooth TF-IDF vectors (L2) of the two token arrays of each row; the corpus is both sides.

    Terms are counted by hash aggregation; a frequent term is one row of ``df``, broadcast only if Spark's own
    threshold allows it.
    """
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col(left).alias("words")), F.struct(F.lit(1).alias("side"), F.col(right).alias("words")))
    flat = pairs.select(key, F.explode(sides).alias("s")).select(key, "s.side", F.explode("s.words").alias("term"))
    if stop_words:
        flat = flat.where(~F.col("term").isin(stop_words))
    tf = flat.groupBy(key, "side", "term").agg(F.count("*").alias("tf"))
    total = pairs.agg((F.count("*") * 2).alias("n"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    weighted = tf.join(df, "term").join(F.broadcast(total)).select(key, "side", "term", (F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("w"))
    by_term = weighted.groupBy(key, "term").agg(F.sum(F.when(F.col("side") == 0, F.col("w"))).alias("a"), F.sum(F.when(F.col("side") == 1, F.col("w"))).alias("b"))
    sums = by_term.groupBy(key).agg(F.sum(F.col("a") * F.col("b")).alias("dot"), F.sum(F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("b") * F.col("b")).alias("bb"))
    cosine = F.coalesce(F.try_divide(F.col("dot"), F.sqrt(F.col("aa") * F.col("bb"))), F.lit(0.0))
    return pairs.select(key).join(sums.select(key, cosine.alias("cosine")), key, "left").select(key, F.coalesce("cosine", F.lit(0.0)).alias("cosine"))
