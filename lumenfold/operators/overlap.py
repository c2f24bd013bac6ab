"""N-gram overlap of text pairs by hash aggregation: linear in the texts, whatever their length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.text import ngrams


def rouge_table(pairs: DataFrame, keys: list[str], reference: str, candidate: str, sizes: list[int]) -> DataFrame:
    """ROUGE-N recall of token arrays: clipped matches over n-grams of the reference, 0 without any.

    N-grams of both sides are counted in one aggregation; a key's counts are then summed up. One row a key, with
    ``rouge_<n>`` for each size, and ``coverage``, the share of the candidate's tokens that the reference has.
    """
    grams = [F.struct(F.lit(n).alias("n"), F.lit(side).alias("side"), ngrams(F.col(c), n).alias("grams")) for n in sizes for side, c in enumerate((reference, candidate))]
    flat = pairs.select(*keys, F.explode(F.array(*grams)).alias("x")).select(*keys, "x.n", "x.side", F.explode("x.grams").alias("gram"))
    counts = flat.groupBy(*keys, "n", "gram").agg(F.count_if(F.col("side") == 0).alias("r"), F.count_if(F.col("side") == 1).alias("c"))
    sums = [F.try_divide(F.sum(F.when(F.col("n") == n, F.least("r", "c"))), F.sum(F.when(F.col("n") == n, F.col("r")))).alias(f"rouge_{n}") for n in sizes]
    first = F.col("n") == min(sizes)
    covered = F.try_divide(F.sum(F.when(first & (F.col("r") > 0), F.col("c"))), F.sum(F.when(first, F.col("c")))).alias("coverage")
    scores = counts.groupBy(*keys).agg(*sums, covered)
    return pairs.select(*keys).join(scores, keys, "left").select(*keys, *[F.coalesce(f"rouge_{n}", F.lit(0.0)).alias(f"rouge_{n}") for n in sizes], F.coalesce("coverage", F.lit(0.0)).alias("coverage"))
