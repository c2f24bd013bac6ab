"""What the training-data operators share: tables, shared storage and text kernels."""

from __future__ import annotations

import ctypes
import gc
import os
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Present in glibc only.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None
_BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2_000
#: What a Python worker keeps from task to task, one entry at a time: the operator that runs.
_KEPT: dict[tuple[str, ...], object] = {}


def kept(key: tuple[str, ...], make: Callable[[], Any]) -> Any:
    """What ``make`` gives, made once a worker; what operators before this one have kept is dropped."""
    if key not in _KEPT:
        _KEPT.clear()
        gc.collect()
        tidy()
        _KEPT[key] = make()
    return _KEPT[key]


def small_batches(spark: SparkSession) -> None:
    """Texts are long: an Arrow batch of ``BATCH_ROWS`` rows is some megabytes already, in the JVM and in the Python worker."""
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, BATCH_ROWS)


def tidy() -> None:
    """Give back what allocators of a Python worker have kept; called at the end of a task."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver's, for queries and stages."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh folder that the driver and every executor can reach.

    The cluster names the parent in ``spark.checkpoint.dir``; only where that is unset and all runs on
    one machine (tests, a laptop) is a local folder chosen.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
    return f"{root.rstrip('/')}/lumenfold-{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    before = spark.conf.get(_BATCH)
    small_batches(spark)
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    return spark.read.schema(df.schema).parquet(path)


def spent(*tables: DataFrame) -> None:
    """Delete the files of tables that :func:`written` made and nothing reads again, and let go of old shuffles."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if tables:  # shuffle files go when the plans that made them are collected
        gc.collect()
        tables[0].sparkSession._jvm.java.lang.System.gc()


def least_ids(rows: DataFrame, id_col: str, class_col: str, each: int) -> list[tuple[Any, Any]]:
    """For each class at most ``each`` distinct ids, those of the least hash: (id, class) in order.

    Only ids and classes are shuffled, and about as many ids as are wanted reach the driver: a bound on the
    hash is computed from the counts, six deviations above what would do.
    """
    ids = rows.select(id_col, class_col).distinct()
    share = F.lit(0.0)
    for r in ids.groupBy(class_col).count().collect():
        part = min(1.0, (each + 6 * each**0.5 + 50) / r["count"])
        share = F.when(F.col(class_col) == r[class_col], F.lit(part)).otherwise(share)
    number = F.xxhash64(F.col(id_col))
    found: dict[Any, list[tuple[Any, Any]]] = {}
    for r in ids.where(F.pmod(number, F.lit(1 << 52)) < share * float(1 << 52)).select(id_col, class_col, F.pmod(number, F.lit(1 << 52)).alias("__n")).orderBy("__n", id_col).collect():
        found.setdefault(r[class_col], []).append((r[id_col], r[class_col]))
    return [x for name in sorted(found) for x in found[name][:each]]


def id_fold(column: Column | str) -> Column:
    """crc32 of an id written as text, modulo 3: remainder 1 is held out."""
    return F.pmod(F.crc32(F.col(column).cast("string") if isinstance(column, str) else column.cast("string")), F.lit(3))


def held_out(column: Column | str) -> Column:
    return F.coalesce(id_fold(column) == 1, F.lit(False))


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``limit`` bytes of ``text`` (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), np.int64)
        group = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)
    tidy()


def strings(batch: pa.RecordBatch, name: str) -> list[str]:
    """Texts of a column, null as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def byte_strings(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """UTF-8 bytes of a column, null as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]
