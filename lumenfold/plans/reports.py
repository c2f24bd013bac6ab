"""Report tables on the driver's tables, with SQL for DuckDB written from the rules they follow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions import scoring as s
from lumenfold.operators import aggregate as a
from lumenfold.operators import reports as r
from lumenfold.plans.adapters import CRITERIA, JUDGEMENTS_SQL, REVIEWS_SQL, SCORES_SQL, items, judgements, reviews, table
from lumenfold.plans.registry import query, rounded

_PRICES = "(VALUES ('A', 5.0, 30.0), ('N', 5.0, 25.0)) v(provider, pin, pout)"
_COST_SQL = f"costs AS (SELECT item, provider, arg_max((tokens_in * pin + tokens_out * pout) / 1000000, l_orderkey * 1000000 + l_linenumber * 100000 + l_suppkey) AS cost FROM judgements JOIN {_PRICES} USING (provider) WHERE input_source = 'F' GROUP BY ALL)"
_ALPHA = "CASE WHEN 2 * n * t2 - 2 * t1 * t1 = 0 THEN 1 ELSE 1 - (within / n) / ((2 * n * t2 - 2 * t1 * t1) / (n * (n - 1))) END"
_VERDICT = "CASE WHEN alpha IS NULL THEN 'unavailable' WHEN n_comparable < 30 THEN 'underpowered' WHEN alpha >= 0.8 THEN 'strong' WHEN alpha >= 0.667 THEN 'acceptable' WHEN alpha >= 0 THEN 'weak' ELSE 'systematic disagreement' END"


def _alpha_sql(by: str, unit: str, judge: str, value: str, source: str) -> str:
    """Alpha of one averaged rating a judge, with mean and population variance of all ratings."""
    return f"""rated AS (SELECT {by}, {unit}, {judge}, avg({value}) AS s FROM {source} WHERE {value} IS NOT NULL GROUP BY ALL),
un AS (SELECT {by}, count(*) AS m, sum(s) AS s1, sum(s * s) AS s2 FROM rated GROUP BY {by}, {unit} HAVING count(*) > 1),
al AS (SELECT {by}, n_units, {_ALPHA} AS alpha FROM (SELECT {by}, count(*) AS n_units, sum(m) AS n, sum(s1) AS t1, sum(s2) AS t2, sum((2 * m * s2 - 2 * s1 * s1) / (m - 1)) AS within FROM un GROUP BY {by})),
raw AS (SELECT {by}, count(DISTINCT {judge}) AS n_judges, avg({value}) AS mean, var_pop({value}) AS variance FROM {source} GROUP BY {by}),
rel AS (SELECT {by}, n_judges, coalesce(n_units, 0)::BIGINT AS n_comparable, n_judges >= 2 AND coalesce(n_units, 0) > 0 AS available, CASE WHEN n_judges >= 2 THEN alpha END AS alpha, mean, variance FROM raw LEFT JOIN al USING ({by}))"""


_REL = "n_judges, n_comparable, available, round(alpha, 6) AS alpha, round(CASE WHEN available THEN mean END, 6) AS mean, round(CASE WHEN available THEN variance END, 6) AS variance"


@query(f"""WITH {JUDGEMENTS_SQL}, long AS ({' UNION ALL '.join(f"SELECT item, provider, judge, '{c}' AS criterion, {c} AS score FROM judgements" for c in CRITERIA)}),
{_alpha_sql('criterion', 'item, provider', 'judge', 'score', 'long')} SELECT criterion, {_REL}, {_VERDICT} AS verdict FROM rel""")
def reliability_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = r.per_criterion(judgements(spark, sf_dir), ["item", "provider", "judge"], CRITERIA)
    return rounded(r.reliability(long, ["criterion"], ["item", "provider"], "judge", "score"))


@query(f"WITH {REVIEWS_SQL}, {_alpha_sql('provider', 'item', 'reviewer', 'human', 'reviews')} SELECT provider, {_REL}, {_VERDICT} AS verdict FROM rel")
def inter_reviewer_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(r.reliability(reviews(spark, sf_dir), ["provider"], ["item"], "reviewer", "human"))


def _slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("input_source") == "F", "success").otherwise("failed").alias("status")
    return judgements(spark, sf_dir).select("item", "provider", status, "tokens_in", "tokens_out", "l_orderkey", "l_linenumber", "l_suppkey")


def _costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = spark.createDataFrame([("A", 5.0, 30.0), ("N", 5.0, 25.0)], "provider string, pin double, pout double")
    return r.cost_index(_slots(spark, sf_dir), ["item", "provider"], ["l_orderkey", "l_linenumber", "l_suppkey"], prices)


@query(f"WITH {JUDGEMENTS_SQL}, {_COST_SQL} SELECT item, provider, round(cost, 6) AS cost FROM costs")
def cost_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_costs(spark, sf_dir))


_COMPARISON = f"""{SCORES_SQL}, {_COST_SQL}, cmp AS (SELECT provider, count(unweighted) AS n_items, avg(unweighted) AS mean_unweighted, avg(weighted) AS mean_weighted, avg(cost) AS mean_usd, sum(cost) AS total_usd, count(cost) AS n_priced, avg(disagreement) AS mean_disagreement
FROM items LEFT JOIN costs USING (item, provider) GROUP BY provider)"""
_COMPARED = "provider, n_items, round(mean_unweighted, 6) AS mean_unweighted, round(mean_weighted, 6) AS mean_weighted, round(mean_usd, 6) AS mean_usd, round(total_usd, 6) AS total_usd, n_priced, round(mean_disagreement, 6) AS mean_disagreement, round(mean_usd / mean_unweighted, 6) AS cost_per_point, rank() OVER (ORDER BY mean_unweighted DESC NULLS LAST) AS place, rank() OVER (ORDER BY mean_unweighted DESC NULLS LAST) = 1 AS top"


def _comparison(spark: SparkSession, sf_dir: str, resamples: int | None = None) -> DataFrame:
    return r.provider_comparison(items(spark, sf_dir), _costs(spark, sf_dir), ["item", "provider"], resamples=resamples)


@query(f"WITH {_COMPARISON} SELECT {_COMPARED} FROM cmp")
def provider_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_comparison(spark, sf_dir))


@query(f"WITH {SCORES_SQL} SELECT provider, round(avg(unweighted), 6) AS mean_quality, 0.04::DOUBLE AS cost_per_summary, round(avg(unweighted) / 0.04, 3) AS efficiency FROM items GROUP BY provider")
def subscription_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(r.subscription_efficiency(a.group_report(items(spark, sf_dir), ["provider"])))


_PAIRS = f"""WITH {SCORES_SQL}, i AS (SELECT item, provider, round(unweighted, 9) AS v FROM items WHERE unweighted IS NOT NULL),
p AS (SELECT x.provider AS provider_a, y.provider AS provider_b, round(x.v - y.v, 9) AS d FROM i x JOIN i y ON x.item = y.item AND x.provider < y.provider),
k AS (SELECT *, rank() OVER (PARTITION BY provider_a, provider_b ORDER BY abs(d)) + (count(*) OVER (PARTITION BY provider_a, provider_b, abs(d)) - 1) / 2 AS r FROM p WHERE d <> 0),
w AS (SELECT provider_a, provider_b, count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS w_minus FROM k GROUP BY ALL),
h AS (SELECT provider_a, provider_b, count(*) AS n_shared, avg(d) AS mean_diff FROM p GROUP BY ALL)
SELECT provider_a, provider_b, n_shared, round(mean_diff, 6) AS mean_diff, n, w_plus, w_minus, n_shared < 10 AS underpowered, n IS NOT NULL AS available FROM h LEFT JOIN w USING (provider_a, provider_b)"""


def _pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = items(spark, sf_dir).select("item", "provider", F.round("unweighted", 9).alias("v"))
    return r.pairwise_significance(scores, ["item"], "provider", "v")


@query(_PAIRS)
def pairwise_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_pairwise(spark, sf_dir).drop("p", "p_adjusted"))


@query()
def pairwise_significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_pairwise(spark, sf_dir))


_HUMAN_SQL = f"""{SCORES_SQL}, {REVIEWS_SQL}, hm AS (SELECT item, provider, avg(human) AS human FROM reviews WHERE human IS NOT NULL GROUP BY ALL),
pr AS (SELECT item, provider, round(human, 9) AS human, round(unweighted, 9) AS jury, greatest(1, least(5, round_even(round(human, 9), 0)::INT)) AS a, greatest(1, least(5, round_even(round(unweighted, 9), 0)::INT)) AS b FROM hm JOIN items USING (item, provider) WHERE unweighted IS NOT NULL)"""
_KAPPA = "CASE WHEN {0} = 0 THEN 1 ELSE 1 - {1} * n / {0} END"
_SUMS = """sm AS (SELECT {by}, count(*) AS n, avg((a = b)::INT) AS agreement, sum((a <> b)::INT) AS o1, sum((a - b) * (a - b)) AS o2, count(*) * sum(a * a + b * b) - 2 * sum(a) * sum(b) AS e2 FROM pr GROUP BY {by}),
ca AS (SELECT {by}, a AS label, count(*) AS ra FROM pr GROUP BY ALL), cb AS (SELECT {by}, b AS label, count(*) AS cb FROM pr GROUP BY ALL), eq AS (SELECT {by}, sum(ra * cb) AS same FROM ca JOIN cb USING ({by}, label) GROUP BY {by})"""


def _human_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = r.human_means(reviews(spark, sf_dir), ["item", "provider"], "human").withColumn("human", F.round("human", 9))
    return means.join(items(spark, sf_dir).select("item", "provider", F.round("unweighted", 9).alias("jury")), ["item", "provider"])


@query(f"""WITH {_HUMAN_SQL}, {_SUMS.format(by='provider')},
rk AS (SELECT provider, rank() OVER (PARTITION BY provider ORDER BY round(human, 9)) + (count(*) OVER (PARTITION BY provider, round(human, 9)) - 1) / 2 AS rx, rank() OVER (PARTITION BY provider ORDER BY round(jury, 9)) + (count(*) OVER (PARTITION BY provider, round(jury, 9)) - 1) / 2 AS ry FROM pr),
rh AS (SELECT provider, corr(rx, ry) AS rho FROM rk GROUP BY provider), co AS (SELECT provider, corr(human, jury) AS r, avg(human - jury) AS bias, stddev_samp(human - jury) AS sd FROM pr GROUP BY provider)
SELECT provider, n, round(r, 6) AS pearson, round(rho, 6) AS spearman, round(bias, 6) AS bias, round(sd, 6) AS sd, round(bias - 1.96 * sd, 6) AS low, round(bias + 1.96 * sd, 6) AS high, round(agreement, 6) AS agreement,
round({_KAPPA.format('(n * n - coalesce(same, 0))', 'o1')}, 6) AS kappa, n * n - coalesce(same, 0) = 0 AS undefined, round({_KAPPA.format('e2', 'o2')}, 6) AS kappa_quadratic,
CASE WHEN n < 30 THEN 'underpowered' WHEN rho < 0 THEN 'negative' WHEN rho >= 0.7 THEN 'strong' WHEN rho >= 0.4 THEN 'moderate' ELSE 'weak' END AS verdict
FROM sm LEFT JOIN eq USING (provider) JOIN rh USING (provider) JOIN co USING (provider)""")
def human_vs_jury(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(r.agreement(_human_pairs(spark, sf_dir), ["provider"], "human", "jury"))


@query(f"""WITH {_HUMAN_SQL}, prb AS (SELECT p_brand, pr.* FROM pr JOIN part ON item = p_partkey), {_SUMS.format(by='p_brand, provider').replace('FROM pr ', 'FROM prb ')},
ce AS (SELECT p_brand, provider, count(*) AS n_items, avg(h_majority::INT) AS rate, avg(h_any::INT) FILTER (h_majority IS NOT NULL) AS any_rate, count_if(h_majority IS NULL) AS n_missing, avg(unweighted) AS mean_quality FROM items JOIN part ON item = p_partkey GROUP BY ALL),
gr AS (SELECT DISTINCT x.p_brand, y.provider FROM ce x, ce y)
SELECT p_brand, provider, coalesce(n_items, 0) AS n_items, coalesce(n_missing, 0)::BIGINT AS n_missing, coalesce(n, 0) AS kappa_n, round(rate, 6) AS rate, round(any_rate, 6) AS any_rate, round(mean_quality, 6) AS mean_quality, round({_KAPPA.format('e2', 'o2')}, 6) AS kappa_quadratic, round(agreement, 6) AS agreement, e2 = 0 AS kappa_undefined, coalesce(n, 0) < 5 AS kappa_underpowered
FROM gr LEFT JOIN ce USING (p_brand, provider) LEFT JOIN sm USING (p_brand, provider)""")
def covariate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), "p_brand")
    return rounded(r.covariate_report(items(spark, sf_dir).join(part, "item"), _human_pairs(spark, sf_dir).join(part, "item"), "provider", "p_brand", "hallucinated"))


@query("SELECT o_orderpriority AS provider, coalesce(nullif(o_orderstatus, 'P'), 'not_started') AS status, count(*) AS n FROM orders GROUP BY ALL")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("provider"), F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("status"))
    return r.status_counts(slots, ["provider"])


@query(f"WITH {JUDGEMENTS_SQL} SELECT provider, count_if(l_linenumber <> 7) AS n_judged, count_if(l_linenumber <> 7 AND coalesce(hallucinated, false)) AS n_flagged, count_if(l_linenumber = 7) AS n_mock FROM judgements GROUP BY provider")
def judging_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.progress(judgements(spark, sf_dir), ["provider"], F.col("l_linenumber") == 7, F.col("hallucinated"))


@query(f"""WITH {_COMPARISON}, {REVIEWS_SQL}, {_alpha_sql('provider', 'item', 'reviewer', 'human', 'reviews')}, hm AS (SELECT item, provider, round(avg(human), 9) AS human FROM reviews WHERE human IS NOT NULL GROUP BY ALL),
pr AS (SELECT provider, human, round(unweighted, 9) AS jury FROM hm JOIN items USING (item, provider) WHERE unweighted IS NOT NULL),
rk AS (SELECT provider, rank() OVER (PARTITION BY provider ORDER BY human) + (count(*) OVER (PARTITION BY provider, human) - 1) / 2 AS rx, rank() OVER (PARTITION BY provider ORDER BY jury) + (count(*) OVER (PARTITION BY provider, jury) - 1) / 2 AS ry FROM pr),
rh AS (SELECT provider, count(*) AS n_human, corr(rx, ry) AS rho FROM rk GROUP BY provider)
SELECT {_COMPARED}, round(alpha, 6) AS alpha, {_VERDICT} AS alpha_verdict, coalesce(n_human, 0) AS n_human, round(rho, 6) AS human_spearman FROM cmp LEFT JOIN rel USING (provider) LEFT JOIN rh USING (provider)""")
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _human_pairs(spark, sf_dir)
    reliable = r.reliability(reviews(spark, sf_dir), ["provider"], ["item"], "reviewer", "human")
    return rounded(r.leaderboard(_comparison(spark, sf_dir), reliable, r.agreement(pairs, ["provider"], "human", "jury")))


@query(f"""WITH {SCORES_SQL}, au AS (SELECT l_orderkey, CASE WHEN l_suppkey % 50 = 0 THEN NULL WHEN l_orderkey % 1000 = 1 THEN 9.0 ELSE u END AS stored, u FROM (SELECT *, CASE WHEN {' + '.join(f'({c} IS NOT NULL)::INT' for c in CRITERIA)} > 0 THEN ({' + '.join(f'coalesce({c}, 0)' for c in CRITERIA)})::DOUBLE / ({' + '.join(f'({c} IS NOT NULL)::INT' for c in CRITERIA)}) END AS u FROM judgements)),
ck AS (SELECT l_orderkey, coalesce(abs(stored - u) <= 1e-6, stored IS NULL AND u IS NULL) AS same, stored IS NULL AS missing FROM au)
SELECT count(*) AS n, count_if(same) AS n_match, count_if(NOT same) AS n_mismatch, count_if(missing) AS n_missing, (SELECT string_agg(l_orderkey::VARCHAR, ',' ORDER BY l_orderkey) FROM (SELECT l_orderkey FROM ck WHERE NOT same ORDER BY l_orderkey LIMIT 3)) AS examples FROM ck""")
def score_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judgements(spark, sf_dir).withColumn("u", s.plain_mean({c: F.col(c) for c in CRITERIA}))
    stored = F.when(F.col("l_suppkey") % 50 == 0, None).when(F.col("l_orderkey") % 1000 == 1, 9.0).otherwise(F.col("u"))
    out = r.audit(rows, "l_orderkey", stored, F.col("u"))
    return out.withColumn("examples", F.array_join(F.transform("examples", lambda x: x.cast("string")), ","))
