"""Append-only JSON ledgers: tolerant scans with reject tables, and sinks that never lose a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """line, file, object (Variant; null if the line is no JSON object) of every non-blank line."""
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"))
    parsed = lines.where(F.trim("line") != "").withColumn("object", F.try_parse_json("line"))
    return parsed.withColumn("object", F.when(F.schema_of_variant("object").startswith("OBJECT"), F.col("object")))


def scan(spark: SparkSession, path: str, fields: dict[str, str]) -> DataFrame:
    """Objects with typed fields; a field that does not fit its type is null, the row stays."""
    rows = scan_lines(spark, path).where("object is not null")
    return rows.select("file", *[F.try_variant_get("object", f"$.{name}", kind).alias(name) for name, kind in fields.items()])


def rejects(spark: SparkSession, path: str, stage: str) -> DataFrame:
    """Lines that are no JSON object, with the stage that met them."""
    return scan_lines(spark, path).where("object is null").select("file", "line", F.lit(stage).alias("stage"))


def scan_facts(spark: SparkSession, path: str, rehearsal: str | None, fields: dict[str, str], is_mock: Column) -> DataFrame:
    """Facts without mock rows, or with the rehearsal sibling beside them."""
    rows = scan(spark, path, fields)
    if rehearsal is None:
        return rows.where(~is_mock)
    return rows.unionByName(scan(spark, rehearsal, fields), allowMissingColumns=True)


def scan_texts(spark: SparkSession, folder: str) -> DataFrame:
    """One-row text caches; the slug falls back to the file's stem."""
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")
    rows = spark.read.schema("doi string, slug string, text string, word_count long, char_count long").json(folder)
    return rows.select("doi", F.coalesce(F.nullif("slug", F.lit("")), stem).alias("slug"), "text", "word_count", "char_count")


def scan_keys(spark: SparkSession, folder: str) -> DataFrame:
    """reviewer_id, item_id, key of JSON files that map the items of one reviewer each, named by its folder or file."""
    rows = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").schema("items map<string, string>").json(folder)
    return rows.select(F.regexp_extract("_metadata.file_path", r"(human\d+)", 1).alias("reviewer_id"), F.explode("items").alias("item_id", "key"))


def scan_first_lines(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """file and the pattern's match in the first line that is not blank, lower-cased; files without one are left out."""
    files = spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.regexp_extract("value", r"\A\s*([^\n\r]*)", 1).alias("line"))
    return files.select("file", F.lower(F.nullif(F.regexp_extract("line", pattern, 0), F.lit(""))).alias("found")).where("found is not null")


def scan_counts(texts: DataFrame) -> DataFrame:
    """slug, word_count and char_count of :func:`scan_texts`; counts that a file does not state are taken from its text."""
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"\S+")).cast("long")
    return texts.select("slug", F.coalesce("word_count", words).alias("word_count"), F.coalesce("char_count", F.length(F.coalesce("text", F.lit(""))).cast("long")).alias("char_count"))


def scan_scoresheets(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    """CSV scoresheets as strings; the reviewer is the folder's or file's name."""
    schema = StructType.fromDDL(", ".join(f"`{c}` string" for c in columns))
    rows = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(folder)
    return rows.withColumn("reviewer_id", F.regexp_extract("_metadata.file_path", r"(human\d+)", 1))


def scan_blocks(spark: SparkSession, folder: str, separator: str = r"\n-{3,}\n") -> DataFrame:
    """Text files of ``key: value`` blocks: file, place, fields (map), body."""
    files = spark.read.text(folder, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    parts = files.select("file", F.posexplode(F.split("value", separator)).alias("place", "block"))
    line = r"(?m)^[ \t]*([A-Za-z_ ]+):[ \t]*([^\n]*)$"
    parts = parts.withColumn("__k", F.transform(F.regexp_extract_all("block", F.lit(line), F.lit(1)), lambda k: F.lower(F.trim(k))))
    parts = parts.withColumn("__v", F.transform(F.regexp_extract_all("block", F.lit(line), F.lit(2)), F.trim))
    # of a key that comes twice the first counts
    names = F.array_distinct("__k")
    values = F.transform(names, lambda k: F.element_at("__v", F.array_position("__k", k).cast("int")))
    body = F.trim(F.regexp_replace("block", r"(?m)^[ \t]*[A-Za-z_ ]+:[^\n]*\n?", ""))
    return parts.select("file", "place", F.map_from_arrays(names, values).alias("fields"), body.alias("body"))


def vendor_results(lines: DataFrame, vendor: str) -> DataFrame:
    """custom_id, text, tokens_in, tokens_out, cache_read, cache_written, status, provider of a batch result line (column ``object``).

    ``tokens_in`` is all input: a vendor that counts cached tokens apart has them added. Text is that of all text blocks in
    order; a line without any has failed, as has one whose vendor says so.
    """
    paths = {
        "openai": ("$.custom_id", "$.response.body.choices[0].message.content", "$.response.body.usage.prompt_tokens", "$.response.body.usage.completion_tokens", "$.response.body.usage.prompt_tokens_details.cached_tokens", None),
        "anthropic": ("$.custom_id", "$.result.message.content", "$.result.message.usage.input_tokens", "$.result.message.usage.output_tokens", "$.result.message.usage.cache_read_input_tokens", "$.result.message.usage.cache_creation_input_tokens"),
        "gemini": ("$.key", "$.response.candidates[0].content.parts", "$.response.usageMetadata.promptTokenCount", "$.response.usageMetadata.candidatesTokenCount", "$.response.usageMetadata.cachedContentTokenCount", None),
    }[vendor]
    custom_id, content, tokens_in, tokens_out, read, written = (F.lit(None) if p is None else F.try_variant_get("object", p, "string" if k < 1 else "variant" if k == 1 and vendor != "openai" else "string" if k == 1 else "bigint") for k, p in enumerate(paths))
    if vendor == "openai":
        text = F.nullif(content, F.lit(""))
    else:
        blocks = F.from_json(F.to_json(content), "array<struct<type: string, text: string>>")
        said = F.filter(blocks, lambda b: b["text"].isNotNull() & F.coalesce(b["type"] == "text", F.lit(vendor == "gemini")))
        text = F.nullif(F.array_join(F.transform(said, lambda b: b["text"]), ""), F.lit(""))
    if vendor == "anthropic":
        tokens_in = F.when(tokens_in.isNotNull(), tokens_in + F.coalesce(read, F.lit(0)) + F.coalesce(written, F.lit(0)))
        text = F.when(F.try_variant_get("object", "$.result.type", "string") == "succeeded", text)
    ok = F.when(text.isNotNull(), "success").otherwise("failed")
    counts = [c.cast("long").alias(n) for c, n in ((tokens_in, "tokens_in"), (tokens_out, "tokens_out"), (read, "cache_read"), (written, "cache_written"))]
    return lines.where("object is not null").select(custom_id.alias("custom_id"), text.alias("text"), *counts, ok.alias("status"), F.lit(vendor).alias("provider"))


def append(rows: DataFrame, path: str, rehearsal: str, is_mock: Column) -> None:
    """Append rows as JSON lines; mock rows go to the sibling folder."""
    rows.where(~F.coalesce(is_mock, F.lit(False))).write.mode("append").json(path)
    rows.where(F.coalesce(is_mock, F.lit(False))).write.mode("append").json(rehearsal)


def log_errors(rows: DataFrame, path: str, stage: str, key: str, message: str, **more: Column) -> None:
    """Append error events: time, stage, key, message and what else is given."""
    event = [F.current_timestamp().alias("at"), F.lit(stage).alias("stage"), F.col(key).cast("string").alias("key"), F.col(message).alias("message")]
    rows.select(*event, *[c.alias(n) for n, c in more.items()]).write.mode("append").json(path)


def write_report(tables: dict[str, DataFrame], folder: str, stamp: str) -> list[str]:
    """Report tables of a few rows as JSON and CSV under names that end in a time, so that no run overwrites another's."""
    paths = []
    for name, rows in tables.items():
        path = f"{folder}/{name}_{stamp}"
        rows.coalesce(1).write.mode("errorifexists").json(f"{path}.json")
        rows.coalesce(1).write.mode("errorifexists").option("header", True).csv(f"{path}.csv")
        paths += [f"{path}.json", f"{path}.csv"]
    return paths


def write_packets(rows: DataFrame, folder: str, reviewer: str = "reviewer_id") -> None:
    """One folder for each reviewer with the rows that they are to judge."""
    rows.write.mode("overwrite").partitionBy(reviewer).json(folder)


def replace(rows: DataFrame, path: str) -> None:
    """Write beside the target, then swap by two renames; the target may be read from.

    The rows are whole before anything is renamed, and the old ones stay beside the target (``.old``) until the new ones are
    in place. Between the renames a reader finds no target: folders have no atomic exchange.
    """
    spark = rows.sparkSession
    staging, old = f"{path}.staging", f"{path}.old"
    rows.write.mode("overwrite").parquet(staging)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target):
        fs.delete(jvm.org.apache.hadoop.fs.Path(old), True)
        fs.rename(target, jvm.org.apache.hadoop.fs.Path(old))
    fs.rename(jvm.org.apache.hadoop.fs.Path(staging), target)
    fs.delete(jvm.org.apache.hadoop.fs.Path(old), True)


def write_csv(rows: DataFrame, path: str) -> None:
    """One CSV file with a header: report tables of a few rows."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_requests(rows: DataFrame, path: str, key: str, body: list[str]) -> None:
    """Request lines: the id and a body object."""
    rows.select(F.to_json(F.struct(F.col(key).alias("custom_id"), F.struct(*body).alias("body"))).alias("value")).write.mode("overwrite").text(path)
