"""The driver's tables seen as judgements, attempts and text pairs; expressions that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions.scoring import WEIGHTS
from lumenfold.operators.aggregate import item_scores

CRITERIA = list(WEIGHTS)

_CRITERIA = [f"CASE WHEN (l_orderkey + {k}) % 11 = 0 THEN NULL ELSE CAST(1 + (CAST(l_quantity AS BIGINT) + {k} * l_linenumber) % 5 AS DOUBLE) END AS {c}" for k, c in enumerate(WEIGHTS)]
JUDGEMENTS = [
    "l_partkey AS item", "l_returnflag AS provider", "concat('j', CAST(l_suppkey % 3 AS STRING)) AS judge", *_CRITERIA,
    "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE CAST(l_quantity AS BIGINT) % 4 = 0 END AS hallucinated",
    "CAST(l_quantity AS BIGINT) * 100 AS tokens_in", "CAST(l_linenumber AS BIGINT) * 50 AS tokens_out",
    "CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE CAST(l_quantity AS BIGINT) * 10 END AS cache_read",
    "l_linestatus AS input_source", "CASE WHEN l_suppkey % 3 = 1 THEN l_linestatus ELSE NULL END AS prompt_shape", "l_orderkey", "l_linenumber", "l_suppkey",
]
JUDGEMENTS_SQL = f"judgements AS (SELECT {', '.join(JUDGEMENTS)} FROM lineitem)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*JUDGEMENTS)


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's turn and the answer that follows: conv_id, turn, reference, candidate."""
    rows = table(spark, sf_dir, "conversations")
    asked = rows.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("reference"))
    said = rows.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("candidate"))
    return asked.join(said, ["conv_id", "turn"])


PAIRS_SQL = "pairs AS (SELECT u.conv_id, u.turn, u.text AS reference, a.text AS candidate FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"

W_SQL = " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE {c} * {w} END" for c, w in WEIGHTS.items())
WB_SQL = " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE {w} END" for c, w in WEIGHTS.items())
U_SQL = " + ".join(f"coalesce({c}, 0)" for c in CRITERIA)
UB_SQL = " + ".join(f"({c} IS NOT NULL)::INT" for c in CRITERIA)
SCORES_SQL = f"""{JUDGEMENTS_SQL},
one AS (SELECT item, provider, judge, {', '.join(f'avg({c}) AS {c}' for c in CRITERIA)}, bool_or(hallucinated) AS h, count(*) AS n_rows FROM judgements GROUP BY ALL),
scored AS (SELECT *, CASE WHEN {UB_SQL} > 0 THEN ({U_SQL})::DOUBLE / ({UB_SQL}) END AS u, CASE WHEN {WB_SQL} > 0 THEN ({W_SQL})::DOUBLE / ({WB_SQL}) END AS w FROM one),
items AS (SELECT item, provider, avg(u) AS unweighted, avg(w) AS weighted, max(u) - min(u) AS disagreement, {', '.join(f'avg({c}) AS {c}' for c in CRITERIA)},
  CASE WHEN count(h) > 0 THEN count_if(h) * 2 > count(h) END AS h_majority, bool_or(h) AS h_any, avg(h::INT) AS h_rate, count_if(h IS NULL) AS h_missing,
  greatest(count(u), count(w)) AS n_judges, sum(n_rows)::BIGINT AS n_rows FROM scored GROUP BY ALL)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The judgements' item scores: one row for each (item, provider)."""
    return item_scores(judgements(spark, sf_dir), ["item"], flags=["hallucinated"])


_REVIEWS = ["l_partkey AS item", "l_returnflag AS provider", "concat('r', CAST(l_linenumber % 3 AS STRING)) AS reviewer", "CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE CAST(1 + (CAST(l_quantity AS BIGINT) * 3 + l_linenumber) % 5 AS DOUBLE) END AS human"]
REVIEWS_SQL = f"reviews AS (SELECT {', '.join(_REVIEWS)} FROM lineitem)"


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line items seen as human reviews: item, provider, reviewer, human."""
    return table(spark, sf_dir, "lineitem").selectExpr(*_REVIEWS)
