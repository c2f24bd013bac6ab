"""The append-only ledger as a stream: each result is merged once, late duplicates change nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def follow(spark: SparkSession, folder: str, schema: StructType | str, files_per_batch: int = 1000) -> DataFrame:
    """JSON lines that are appended to a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)


def merge_once(stream: DataFrame, ledger: str, keys: list[str], checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda x: x) -> StreamingQuery:
    """Append rows whose key the ledger does not have yet, whatever is delivered twice or late.

    State is the ledger itself, not memory: each batch anti-joins it, and a batch that is replayed after a failure
    finds its own rows there.
    """

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = prepare(batch).dropDuplicates(keys)
        known = spark.read.schema(rows.schema).parquet(ledger)
        rows.join(known.select(*keys).distinct(), keys, "left_anti").write.mode("append").parquet(ledger)

    stream.sparkSession.createDataFrame([], prepare(stream.sparkSession.createDataFrame([], stream.schema)).schema).write.mode("append").parquet(ledger)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def poll_once(jobs: DataFrame, marker: str, key: str, merge: Callable[[DataFrame], None]) -> int:
    """Merge the finished jobs that no marker names yet, then mark them; how many there were.

    A poll that fails before it has marked its jobs does them again: ``merge`` must bear that, as :func:`merge_once` does.
    """
    spark = jobs.sparkSession
    spark.createDataFrame([], jobs.select(key).schema).write.mode("append").parquet(marker)
    done = spark.read.schema(jobs.select(key).schema).parquet(marker)
    new = jobs.join(done.distinct(), key, "left_anti")
    keys = [r[0] for r in new.select(key).distinct().collect()]  # jobs of one poll, a few each
    if keys:
        some = jobs.where(jobs[key].isin(keys))
        merge(some)
        spark.createDataFrame([(k,) for k in keys], jobs.select(key).schema).write.mode("append").parquet(marker)
    return len(keys)


def running_counts(stream: DataFrame, time: str, late: str, window: str, by: str) -> DataFrame:
    """Events of each window and kind; events later than ``late`` are dropped with their window's state."""
    from pyspark.sql import functions as F

    return stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")
