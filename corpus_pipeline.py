"""Raw documents to token ids: five operators, each on what the one before has kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. Each stage's rows are written to the shared folder and read again by the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import decontamination, near_dedup, piece_encoding, suffix_dedup, toxicity
from lumenfold.llm.common import read_table, small_batches, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
_OTHERS = ("lang", "source", "n_chars")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject; it learns from the labels of these documents.

    A null or empty text has no passage that could be rejected and stays; rows that repeat are judged each; a document without an id
    teaches nothing and is judged like any other; an empty table gives no rows.
    """
    docs = docs.select(*COLUMNS)
    return toxicity.drop_toxic(docs, toxicity.fit_toxicity(docs, read_table(spark, sf_dir, "labels")))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least id.

    Rows without an id are in no group and stay, as do documents without words. Rows that repeat an id share its fate; of those that stay
    each different text is kept once, with the least of its other columns. An empty table gives no rows.
    """
    small_batches(spark)
    docs = docs.select(*COLUMNS)
    judged = written(near_dedup.near_duplicates(docs), "classes").where("doc_id is not null")
    gone = written(judged.where("not kept").select("doc_id").distinct(), "gone")
    again = written(judged.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated")
    small = lambda ids: F.broadcast(ids) if 16 * ids.count() <= near_dedup.BROADCAST_BYTES else ids
    kept = docs.join(small(gone), "doc_id", "left_anti")
    if again.isEmpty():
        return kept.select(*COLUMNS)
    # ids on several rows are rare: only their rows are dealt by id
    once = kept.join(small(again), "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(*_OTHERS)).alias("x")).select("doc_id", "text", "x.*")
    return kept.join(small(again), "doc_id", "left_anti").select(*COLUMNS).unionByName(once.select(*COLUMNS))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of strings of 400 bytes that occur elsewhere too.

    A null text stays null; copies lose all of their text, so a text that is left stands once. An empty table gives no rows.
    """
    small_batches(spark)
    out = suffix_dedup.remove_repeats(docs, carry=_OTHERS)
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated, without the stretches that benchmark windows cover.

    A document without words is not contaminated; null texts stay null; rows that repeat are judged each; an empty table gives no rows.
    """
    found = decontamination.find_contamination(docs, read_table(spark, sf_dir, "benchmark"), carry=_OTHERS)
    out = decontamination.remove_spans(found)
    return out.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document and the text that they decode to; null and empty texts have none; an empty table gives no rows."""
    small_batches(spark)
    return piece_encoding.round_trip(docs, with_ids=True).select("doc_id", "n_tokens", "ids", "text")


STAGES = [
    ("toxicity", without_toxic),
    ("near_dedup", without_near_duplicates),
    ("suffix_dedup", without_repeats),
    ("decontamination", without_benchmark),
    ("piece_encoding", to_pieces),
]

#: SQL cannot express trained scores, sketches or an encoder; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
