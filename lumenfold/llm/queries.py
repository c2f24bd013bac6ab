"""Thin queries over the operators of this subpackage, for the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import chat_format, decontamination, language_id, near_dedup, oracle, piece_encoding, suffix_dedup, token_output, toxicity, url_filter, vector_search
from lumenfold.llm.common import read_table


def _sha256(text) -> F.Column:
    return F.sha2(text.cast("binary"), 256)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    items = F.array_sort("item_ids")
    return found.select("doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), _sha256(F.concat_ws(",", items)).alias("items_sha256"), "contaminated")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(read_table(spark, sf_dir, "pages"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return language_id.identify_language(docs, language_id.fit_language_model(docs))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    kept = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    back = chat_format.chat_format(kept.unionByName(own))
    lines = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), _sha256(lines).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), _sha256(F.col("loss_text")).alias("loss_sha256"), "formatted_chars")


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_output(read_table(spark, sf_dir, "documents"))


def op8_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    back = piece_encoding.round_trip(docs)
    return back.select("doc_id", "n_tokens", "ids_crc32", F.length("text").cast("long").alias("n_chars"), _sha256(F.col("text")).alias("text_sha256"))


def op9_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.top_k(read_table(spark, sf_dir, "embeddings"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, read_table(spark, sf_dir, "labels")))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_url_filter": op3_url_filter,
    "op4_language_id": op4_language_id,
    "op5_near_dedup": op5_near_dedup,
    "op6_chat_format": op6_chat_format,
    "op7_token_output": op7_token_output,
    "op8_piece_encoding": op8_piece_encoding,
    "op9_vector_search": op9_vector_search,
    "op10_toxicity": op10_toxicity,
}

ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": oracle.DECONTAMINATION,
    "op5_near_dedup": oracle.NEAR_DEDUP,
    "op6_chat_format": oracle.CHAT_FORMAT,
    "op9_vector_search": oracle.VECTOR_SEARCH,
}
