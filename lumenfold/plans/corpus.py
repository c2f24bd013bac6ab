"""Joins of papers, texts, slots and files on the driver's tables, with SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.operators import corpus as c
from lumenfold.plans.adapters import table
from lumenfold.plans.registry import query

_LABEL = "coalesce(nullif({0}, ''), nullif({1}, ''), 'unknown')"


def _papers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    papers = table(spark, sf_dir, "pages").selectExpr("page_id AS doi", "page_id AS seq", "CASE WHEN page_id % 3 = 0 THEN '' ELSE concat('d', CAST(page_id % 7 AS STRING)) END AS design", "CAST(NULL AS STRING) AS species")
    manifest = table(spark, sf_dir, "documents").selectExpr("doc_id AS doi", "source AS design", "CASE WHEN doc_id % 4 = 1 THEN NULL ELSE lang END AS species")
    texts = table(spark, sf_dir, "documents").selectExpr("doc_id AS doi", "CASE WHEN doc_id % 5 = 2 THEN NULL ELSE text END AS reference")
    slots = table(spark, sf_dir, "conversations").selectExpr("conv_id AS doi", "concat(role, CAST(turn AS STRING)) AS provider", "CASE WHEN turn % 4 = 3 THEN 'failed' WHEN turn % 4 = 2 THEN NULL ELSE 'success' END AS status", "CASE WHEN turn = 1 THEN '' ELSE text END AS summary")
    return papers, manifest, texts, slots


def _instances_sql(limit: str, status: str) -> str:
    return f"""WITH u AS (SELECT page_id AS doi, CASE WHEN page_id % 3 = 0 THEN '' ELSE 'd' || page_id % 7 END AS design, d.source, CASE WHEN doc_id % 4 = 1 THEN NULL ELSE lang END AS lang, text FROM pages JOIN documents d ON doc_id = page_id WHERE doc_id % 5 <> 2 AND text IS NOT NULL ORDER BY page_id {limit})
SELECT doi, {_LABEL.format('design', 'source')} AS design, {_LABEL.format('NULL', 'lang')} AS species, role || turn AS provider, md5(u.text) AS reference, md5(v.text) AS summary FROM u JOIN conversations v ON conv_id = doi WHERE ({status}) AND turn <> 1 AND v.text <> ''"""


def _instances(spark: SparkSession, sf_dir: str, **options: object) -> DataFrame:
    out = c.evaluation_instances(*_papers(spark, sf_dir), "doi", "seq", ["design", "species"], **options)
    return out.withColumn("reference", F.md5("reference")).withColumn("summary", F.md5("summary"))


@query(_instances_sql("LIMIT 40", "turn % 4 NOT IN (2, 3)"))
def evaluation_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _instances(spark, sf_dir, limit=40)


@query(_instances_sql("", "turn % 4 <> 3"))
def rubric_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _instances(spark, sf_dir, lenient=True)


@query("""SELECT doc_id, md5(CASE WHEN doc_id % 3 = 0 AND trim(text, ' ') <> '' THEN trim(text, ' ') WHEN doc_id % 3 = 1 THEN lang ELSE source END) AS digest FROM documents WHERE doc_id % 3 <> 0 OR trim(text, ' ') <> ''""")
def reference_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 3
    best = c.reference_text(F.when(k == 0, F.col("text")).otherwise("  "), F.when(k == 1, F.col("lang")), F.when(k != 0, F.col("source")))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(best).alias("digest")).where("digest is not null")


@query("SELECT l_suppkey AS reviewer, l_partkey AS item_id, l_orderkey, l_linenumber, s_name AS who, true AS known FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey < 20 UNION ALL SELECT l_suppkey, l_partkey, l_orderkey, l_linenumber, NULL, false FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 20)")
def unblinded_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheet = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS reviewer", "l_partkey AS item_id", "l_orderkey", "l_linenumber")
    keys = table(spark, sf_dir, "supplier").where("s_nationkey < 20").selectExpr("s_suppkey AS reviewer", "s_name AS who")
    found, lost = c.unblinded(sheet, keys, ["reviewer"])
    return found.withColumn("known", F.lit(True)).unionByName(lost.selectExpr("*", "CAST(NULL AS STRING) AS who", "false AS known"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN coalesce(n.n_name, 'unknown') ELSE p_brand END AS journal FROM part LEFT JOIN nation n ON n_nationkey = p_partkey")
def row_journals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "CASE WHEN p_size % 4 = 0 THEN '' ELSE p_brand END AS journal")
    return c.with_journal(rows, table(spark, sf_dir, "nation").selectExpr("CAST(n_nationkey AS LONG) AS p_partkey", "n_name AS journal"), "p_partkey")


@query("""WITH f AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN NULL WHEN 1 THEN ' ' || page_id || 'A' ELSE page_id::VARCHAR END AS k FROM pages)
SELECT page_id, lower(trim(k)) AS doc_id, CASE WHEN k IS NULL THEN 'unresolved' WHEN lower(trim(k)) IN (SELECT doc_id::VARCHAR FROM labels) THEN 'claimed' ELSE 'not_in_manifest' END AS status FROM f""")
def file_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "pages").selectExpr("page_id", "CASE page_id % 4 WHEN 0 THEN array() WHEN 1 THEN array(concat(' ', page_id, 'A'), 'x') ELSE array(CAST(page_id AS STRING)) END AS c")
    return c.file_claims(files, "page_id", "c", table(spark, sf_dir, "labels"), "doc_id")


_NEW = "CASE WHEN p_size % 9 = 0 THEN NULL WHEN p_size % 9 = 1 THEN p_name || '-' || p_partkey ELSE p_name || '-' || p_partkey // 2 END"


@query(f"""WITH f AS (SELECT p_name || '-' || p_partkey AS old, {_NEW} AS new FROM part), w AS (SELECT new, count(*) AS n FROM f GROUP BY new)
SELECT old, new, CASE WHEN new IS NULL THEN 'missing' WHEN old = new THEN 'unchanged' WHEN n > 1 THEN 'collision' ELSE 'rename' END AS status FROM f LEFT JOIN w USING (new)""")
def rename_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.rename_plan(table(spark, sf_dir, "part").selectExpr("p_name || '-' || p_partkey AS old", f"{_NEW.replace('//', 'DIV')} AS new"), "old", "new")


@query("""WITH l AS (SELECT user_id, arg_max(event_type, event_id) AS reason FROM events WHERE value < 20 GROUP BY user_id)
SELECT c_custkey, c_mktsegment, coalesce(reason, 'never_tried') AS reason FROM customer LEFT JOIN l ON user_id = c_custkey WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def missing_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    have = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    tried = table(spark, sf_dir, "events").where("value < 20").selectExpr("user_id AS c_custkey", "event_id", "event_type AS reason")
    return c.missing_report(manifest, have, tried, "c_custkey", ["event_id"], "reason")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 3) THEN NULL ELSE o_orderstatus END AS o_orderstatus FROM orders")
def slot_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "lineitem").where("l_linenumber = 3").select(F.col("l_orderkey").alias("o_orderkey"))
    return c.reset_slots(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), ids, "o_orderkey", "o_orderstatus", of="P")


@query("SELECT p_brand, max(p_name || '_' || p_partkey) AS stem, arg_max(p_partkey, p_name || '_' || p_partkey) AS path FROM part GROUP BY p_brand")
def latest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.latest_file(table(spark, sf_dir, "part").selectExpr("p_brand", "p_name || '_' || p_partkey AS stem", "p_partkey AS path"), "p_brand", "stem", "path")


@query("""WITH l AS (SELECT user_id, arg_max(event_type, event_id) AS v FROM events WHERE event_type <> 'click' GROUP BY user_id)
SELECT c_custkey AS user_id, coalesce(v, c_mktsegment) AS event_type, v IS NOT NULL AS observed FROM customer LEFT JOIN l ON user_id = c_custkey""")
def observed_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").selectExpr("user_id", "event_id", "nullif(event_type, 'click') AS event_type")
    configured = table(spark, sf_dir, "customer").selectExpr("c_custkey AS user_id", "c_mktsegment AS event_type")
    return c.observed_version(rows, configured, "user_id", "event_type", ["event_id"])


@query("""WITH x AS (SELECT conv_id, turn, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z]+'))) AS key FROM conversations WHERE turn < 5), k AS (SELECT conv_id, key, count(*) AS n_pages, min(turn) AS first_page FROM x GROUP BY ALL)
SELECT conv_id, key, n_pages, first_page, row_number() OVER (PARTITION BY conv_id ORDER BY n_pages DESC, first_page, key)::INT AS place FROM k""")
def page_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)).alias("keys"))
    return c.key_frequency(pages, "conv_id", "turn", "keys").select("conv_id", "key", "n_pages", "first_page", "place")


@query("WITH k AS (SELECT source, lang, min(doc_id) AS f FROM documents GROUP BY ALL) SELECT source, string_agg(lang, ',' ORDER BY f) AS langs FROM k GROUP BY source")
def order_of_first_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.by_first_item(table(spark, sf_dir, "documents"), "source", "lang", "doc_id").select("source", F.array_join("keys", ",").alias("langs"))


@query("SELECT conv_id, turn FROM conversations WHERE conv_id IN (SELECT doc_id FROM labels WHERE toxic = 1 OR quality = 0)")
def sampled_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = table(spark, sf_dir, "labels").where("toxic = 1 or quality = 0").select(F.col("doc_id").alias("conv_id"))
    return c.units_of_sample(table(spark, sf_dir, "conversations").select("conv_id", "turn"), sample, "conv_id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT page_id FROM pages)")
def unresolved_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.unresolved_jobs(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id")), "doc_id")


@query("SELECT (max(substring(c_name, 10)::BIGINT) + 1)::INT AS next_number FROM customer")
def next_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.next_number(table(spark, sf_dir, "customer"), "c_name", r"#0*(\d+)$")


@query("""SELECT o_custkey, n_rows, round(total_cost, 4) AS total_cost, coalesce(c_mktsegment, 'unknown') AS journal FROM (SELECT o_custkey, count(*) AS n_rows, sum(o_totalprice) AS total_cost FROM orders WHERE o_custkey IN (SELECT user_id FROM events WHERE event_type = 'error') GROUP BY o_custkey) LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 6 <> 0""")
def revealed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("user_id").alias("o_custkey"))
    journals = table(spark, sf_dir, "customer").where("c_custkey % 6 <> 0").selectExpr("c_custkey AS o_custkey", "c_mktsegment AS journal")
    return c.revealed(table(spark, sf_dir, "orders"), wanted, journals, "o_custkey", "o_totalprice").withColumn("total_cost", F.round("total_cost", 4))


@query("SELECT lang, CASE WHEN n_chars = 0 THEN 'no_text' WHEN n_chars < 300 THEN 'skipped' ELSE 'extracted' END AS outcome, count(*) AS n FROM documents GROUP BY ALL")
def outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    return c.outcome_counts(table(spark, sf_dir, "documents"), F.when(n == 0, "no_text").when(n < 300, "skipped").otherwise("extracted"), ["lang"])


@query("SELECT DISTINCT lower(trim(k)) AS k FROM (SELECT ' ' || c_mktsegment || ' ' AS k FROM customer UNION ALL SELECT p_name FROM part UNION ALL SELECT '  ') WHERE trim(k) <> ''")
def known_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "customer").selectExpr("' ' || c_mktsegment || ' ' AS k")
    return c.key_set(first, table(spark, sf_dir, "part").selectExpr("p_name AS k"), spark.sql("SELECT '  ' AS k"), key="k")


_RECORD = """concat('{"DOI": "', {doi}, '", "title": [', {title}, '], "published": {"date-parts": [[', p_size + 1980, ', 3]]}, "author": [{"given": "', p_name, '", "family": "', p_brand, '"}, {"family": "', p_type, '"}]', {abstract}, '}')"""


@query("""SELECT p_partkey, CASE WHEN p_size % 8 <> 0 THEN '10.1/' || p_partkey END AS doi, CASE WHEN p_size % 8 <> 0 THEN CASE WHEN p_size % 5 = 0 THEN 'No title available' ELSE p_name END END AS title, CASE WHEN p_size % 8 <> 0 THEN p_size + 1980 END AS year,
CASE WHEN p_size % 8 <> 0 THEN p_brand || ' ' || substring(p_name, 1, 1) || '|' || p_type END AS authors, CASE WHEN p_size % 8 <> 0 THEN CASE WHEN p_size % 3 = 0 THEN '' ELSE p_type END END AS abstract FROM part""")
def manifest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = _RECORD.replace("{doi}", "CASE WHEN p_size % 8 = 0 THEN '  ' ELSE concat(' 10.1/', p_partkey) END").replace("{title}", "CASE WHEN p_size % 5 = 0 THEN '' ELSE concat('\"', p_name, '\", \"x\"') END")
    record = record.replace("{abstract}", "CASE WHEN p_size % 3 = 0 THEN '' ELSE concat(', \"abstract\": \"', p_type, '\"') END")
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{record} AS j", "p_brand").select("p_partkey", c.manifest_row(F.col("j"), F.col("p_brand")).alias("m"))
    return rows.select("p_partkey", "m.doi", "m.title", "m.year", F.array_join("m.authors", "|").alias("authors"), "m.abstract").withColumn("authors", F.when(F.col("doi").isNotNull(), F.col("authors")))


@query("""SELECT p_partkey, 'Background: ' || p_name || CASE WHEN p_size % 2 = 0 THEN ' Methods: ' || p_type || ' ' || p_brand ELSE '' END AS summary_text,
'Background' || chr(10) || p_name || chr(10) || chr(10) || 'Methods' || chr(10) || CASE WHEN p_size % 2 = 0 THEN '- ' || p_type || chr(10) || '- ' || p_brand ELSE 'Not reported' END || chr(10) || chr(10) || 'Results' || chr(10) || 'Not reported' || chr(10) || chr(10) || 'Limitations' || chr(10) || 'Not reported' || chr(10) || chr(10) || 'Conclusions' || chr(10) || 'Not reported' AS shown FROM part""")
def repaired_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    methods = F.when(F.col("p_size") % 2 == 0, F.array(F.concat(F.lit(" "), F.col("p_type")), F.lit(""), F.col("p_brand")))
    whole = c.repaired_summary({"objective": F.col("p_name"), "key_methods": methods, "headline": F.lit("")})
    return table(spark, sf_dir, "part").select("p_partkey", whole.alias("s")).select("p_partkey", "s.summary_text", c.readable_summary(F.col("s")).alias("shown"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang WHEN doc_id % 3 = 1 THEN source ELSE 'unknown' END AS value, CASE WHEN doc_id % 4 = 0 THEN lang || ', ' || source WHEN doc_id % 4 = 1 THEN source ELSE 'unknown' END AS list, CASE WHEN doc_id % 2 = 0 THEN n_chars::DOUBLE END AS unweighted, doc_id::DOUBLE AS weighted FROM documents")
def row_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, m = F.col("doc_id") % 3, F.col("doc_id") % 4
    value = c.strata_value(F.when(k == 0, F.col("lang")).otherwise(""), F.when(k == 1, F.col("source")))
    listed = c.strata_list(F.when(m == 0, F.array("lang", "source")).otherwise(F.array().cast("array<string>")), F.when(m == 1, F.array("source")))
    scores = c.score_fields(F.when(F.col("doc_id") % 2 == 0, F.lit("x")), F.when(F.col("doc_id") % 2 == 0, F.col("n_chars")), F.col("doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id", value.alias("value"), listed.alias("list"), *scores)


@query("SELECT o_orderkey, o_orderstatus = 'F' AND o_orderkey % 3 <> 0 AS done, o_orderstatus = 'F' AS rehearsed FROM orders")
def slots_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, mock = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "P", "pending"), F.when(F.col("o_orderkey") % 3 == 0, True)
    return table(spark, sf_dir, "orders").select("o_orderkey", c.slot_done(status, mock).alias("done"), c.slot_done(status, mock, rehearsal=True).alias("rehearsed"))
