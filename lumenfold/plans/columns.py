"""Column functions on the driver's tables, several of one kind in a query, with SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions import guards as g
from lumenfold.functions import scoring as s
from lumenfold.functions import text as t
from lumenfold.operators import corpus as c
from lumenfold.operators import dedup as d
from lumenfold.operators import sampling as q
from lumenfold.plans.adapters import table
from lumenfold.plans.registry import query, rounded


@query("SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), '^ +| +$', '', 'g'), ' ')) AS collapsed, md5(regexp_replace(text || chr(10) || chr(10) || chr(10) || chr(10) || lang, '\\n{3,}', chr(10) || chr(10), 'g')) AS lines, md5(trim(replace(replace('MARK 1' || text || 'MARK 22', 'MARK 22', ''), 'MARK 1', ''), ' ')) AS clean FROM documents WHERE text NOT LIKE '%' || chr(10) || chr(10) || '%' AND text NOT LIKE '%MARK%' AND text = trim(text, ' ')".replace("\\t", "\t").replace("\\f", "\f").replace("\\r", "\r").replace("\\x0B", "\x0b"))
def cleaned_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").where("text not like '%\\n\\n%' and text not like '%MARK%' and text = trim(text)")
    four = F.concat(F.col("text"), F.lit("\n\n\n\n"), F.col("lang"))
    noisy = F.concat(F.lit("MARK 1"), F.col("text"), F.lit("MARK 22"))
    return rows.select("doc_id", F.md5(t.collapse_space(F.col("text"))).alias("collapsed"), F.md5(t.collapse_newlines(four)).alias("lines"), F.md5(t.drop_noise(noisy, [r"MARK \d+$", "MARK 1"])).alias("clean"))


_PART = "coalesce(nullif(regexp_replace(substring(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, {1}), '_+$', ''), ''), 'untitled')"


@query(f"""WITH p AS (SELECT p_partkey, {_PART.format('p_brand', 40)} AS j, {_PART.format("repeat(p_name || ' ', p_size)", 180)} AS t, '10_1_' || p_partkey AS d FROM part)
SELECT p_partkey, j || '__' || regexp_replace(substring(t, 1, greatest(20, 180 - length(j) - length(d) - 8)::BIGINT), '_+$', '') || '__' || d || '.pdf' AS file, length(d) > 0 AS named FROM p""")
def paper_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.expr("repeat(concat(p_name, ' '), p_size)")
    name = t.paper_filename(F.col("p_brand"), title, F.concat(F.lit("10.1/"), F.col("p_partkey")))
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("file"), (F.length(t.doi_slug(F.concat(F.lit("10.1/"), F.col("p_partkey")))) > 0).alias("named"))


@query("SELECT p_partkey, p_name || '__' || p_partkey AS base, p_partkey::VARCHAR AS slug, p_name AS paper, 'judge' || p_size AS summarizer FROM part")
def stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = F.when(F.col("p_size") % 3 == 0, "_20240102T030405Z").when(F.col("p_size") % 3 == 1, F.concat(F.lit("_run"), F.col("p_size"))).otherwise("")
    base = F.concat_ws("__", "p_name", F.col("p_partkey").cast("string"))
    named = s.custom_id(F.concat(F.col("p_name"), F.lit("__judge"), F.col("p_size")))
    return table(spark, sf_dir, "part").select("p_partkey", t.base_stem(F.concat(base, suffix)).alias("base"), t.slug_of_stem(base).alias("slug"), named["slug"].alias("paper"), named["summarizer"].alias("summarizer"))


@query("""SELECT c_custkey, round((1.5 * a + b + 1.2 * c + 0.8 * d) / 13.5 * 9 + 1, 2) AS composite, greatest(CASE WHEN a = 3 THEN c::INT ELSE a::INT END, c::INT) AS claims, a < 3 OR b = 2 OR c > 1 AS review, CASE WHEN a = 0 THEN NULL ELSE b > 0 END AS flagged, CASE WHEN a = 0 THEN 'x' ELSE c_mktsegment END AS first, CASE WHEN b = 2 THEN 0.0 ELSE d / 4 END AS cost, least(5.0, greatest(1.0, d * 2)) AS legacy
FROM (SELECT c_custkey, c_mktsegment, c_custkey % 4 AS a, c_nationkey % 3 AS b, c_custkey % 3 AS c, (c_nationkey % 4)::DOUBLE AS d FROM customer)""")
def judged_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, x, y = F.col("c_custkey") % 4, F.col("c_nationkey") % 3, (F.col("c_custkey") % 3).cast("int"), (F.col("c_nationkey") % 4).cast("double")
    claims = F.transform(F.sequence(F.lit(1), x + 1), lambda k: F.struct(F.when(k == 2, "major").otherwise("minor").alias("severity")))
    claims = F.slice(claims, F.lit(1), x)  # none, one minor, one minor and one major
    stated = F.when(a == 3, "many").otherwise(a.cast("string"))
    fields = {
        "composite": s.composite(a, b, x, y),
        "claims": s.claim_count(stated, claims),
        "review": s.needs_review(a, F.when(b == 2, 99).otherwise(5), claims),
        "flagged": s.flag(F.when(a != 0, b)),
        "first": s.first_present(F.when(a == 0, "").otherwise(F.col("c_mktsegment")), F.lit(None).cast("string"), F.lit("x")),
        "cost": s.batch_cost(F.when(b == 2, "failed").otherwise("success"), y / 4),
        "legacy": s.clamp_or_low(F.when(y == 0, "none").otherwise((y * 2).cast("string")), 1.0, 5.0),
    }
    return rounded(table(spark, sf_dir, "customer").select("c_custkey", *[v.alias(k) for k, v in fields.items()]))


_V = "CASE WHEN {0} IS NULL THEN 'unavailable' WHEN n < 30 THEN 'underpowered' {1} END"


@query(f"""WITH x AS (SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN NULL ELSE (p_size - 10) / 40.0 END::DOUBLE AS v, p_partkey % 60 AS n, p_size * 40 AS raw, p_size * 25 + p_partkey % 4000 AS clean FROM part)
SELECT p_partkey, {_V.format('v', "WHEN v >= 0.8 THEN 'strong' WHEN v >= 0.667 THEN 'acceptable' WHEN v >= 0 THEN 'weak' ELSE 'systematic disagreement'")} AS alpha, {_V.format('v', "WHEN v < 0 THEN 'negative' WHEN v >= 0.7 THEN 'strong' WHEN v >= 0.4 THEN 'moderate' ELSE 'weak'")} AS correlation,
CASE WHEN p_partkey % 7 = 0 OR raw < 500 OR clean < 1500 OR clean / raw < 0.3 THEN 'FAIL' WHEN clean / raw < 0.5 OR clean < 3000 THEN 'WARN' ELSE 'PASS' END AS extraction FROM x""")
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, n = F.when(F.col("p_size") % 10 != 0, (F.col("p_size") - 10) / 40.0), F.col("p_partkey") % 60
    status = s.extraction_status(F.col("p_size") * 40, F.col("p_size") * 25 + F.col("p_partkey") % 4000, F.col("p_partkey") % 7 != 0)
    return table(spark, sf_dir, "part").select("p_partkey", s.alpha_verdict(v, n).alias("alpha"), s.correlation_verdict(v, n).alias("correlation"), status.alias("extraction"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'excluded' WHEN p_size % 3 = 1 THEN 'secondary' ELSE 'primary' END AS kind, CASE WHEN p_size % 3 = 0 THEN 'x' END AS words FROM part")
def article_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("p_size") % 3 == 0, "A Case Report and Systematic Review of ").when(F.col("p_size") % 3 == 1, "a Scoping Review of ").otherwise("")
    kind = s.article_type(F.concat(said, F.col("p_name")))
    return table(spark, sf_dir, "part").select("p_partkey", kind.alias("kind"), F.when(kind == "excluded", "x").alias("words"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_quantity <= 5 THEN l_quantity END AS value, l_quantity > 5 AS invalid, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_linenumber IN (2, 3) END AS said FROM lineitem""")
def sheet_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = s.cell_score(F.concat(F.lit(" "), F.col("l_quantity").cast("string"), F.lit(" ")))
    said = s.cell_bool(F.element_at(F.array(*map(F.lit, ["", " Yes", "TRUE", "no", "false", "n", "0"])), F.col("l_linenumber")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cell["value"].alias("value"), cell["invalid"].alias("invalid"), said.alias("said"))


@query("""WITH f AS (SELECT page_id AS k, 0 AS t FROM pages UNION ALL SELECT conv_id, 1 FROM conversations WHERE conv_id NOT IN (SELECT page_id FROM pages) AND conv_id IN (SELECT doc_id FROM documents) GROUP BY conv_id)
SELECT k, t FROM f""")
def manual_after_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "pages").selectExpr("page_id AS k")
    manual = table(spark, sf_dir, "conversations").selectExpr("conv_id AS k").distinct()
    files = table(spark, sf_dir, "documents").selectExpr("doc_id AS k")
    valid, _ = d.split_by_match(manual, files, ["k"])
    return first.withColumn("t", F.lit(0)).unionByName(d.not_done(valid, first, ["k"]).withColumn("t", F.lit(1)))


@query("SELECT doc_id AS k, true AS paired FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, false FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def paired_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, lost = d.split_by_match(table(spark, sf_dir, "documents").selectExpr("doc_id AS k"), table(spark, sf_dir, "labels").selectExpr("doc_id AS k"), ["k"])
    return found.withColumn("paired", F.lit(True)).unionByName(lost.withColumn("paired", F.lit(False)))


@query("SELECT r_name AS name, CASE r_name WHEN 'EUROPE' THEN 1 WHEN 'ASIA' THEN 2 ELSE 3 END::BIGINT AS place FROM region")
def canonical_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.in_canonical_order(table(spark, sf_dir, "region").select(F.col("r_name").alias("name")), "name", ["EUROPE", "ASIA"])


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o_orderkey % 7 + 1 = l_linenumber AND o_orderstatus <> 'P')")
def unjudged_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several key columns, and with mock rows of the ledger left aside."""
    ledger = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").selectExpr("o_orderkey AS l_orderkey", "CAST(o_orderkey % 7 + 1 AS INT) AS l_linenumber")
    return d.not_done(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), ledger, ["l_orderkey", "l_linenumber"])


@query("""WITH x AS (SELECT lower(p_name) AS k, min(p_partkey) AS place, arg_max(p_brand, p_partkey) AS brand, count(*) AS copies FROM part WHERE p_size % 6 <> 0 GROUP BY 1)
SELECT k, place, brand, copies, (SELECT count(*) FROM part WHERE p_size % 6 <> 0) - (SELECT count(*) FROM x) AS n_duplicates, (SELECT count(*) FROM part WHERE p_size % 6 = 0) AS n_unreadable FROM x""")
def manifest_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a key count as unreadable; the counts say whether a rewrite would be safe."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 6 != 0, F.col("p_name")).alias("name"), F.col("p_brand").alias("brand"))
    kept = d.last_content_first_place(rows.where("name is not null"), F.col("name"), "p_partkey")
    counts = rows.agg((F.count("name") - F.count_distinct(F.lower("name"))).alias("n_duplicates"), F.count_if(F.col("name").isNull()).alias("n_unreadable"))
    return kept.crossJoin(F.broadcast(counts)).select(F.lower("name").alias("k"), "place", "brand", "copies", "n_duplicates", "n_unreadable")  # one row of counts


@query("SELECT p_brand, min(p_partkey) AS p_partkey FROM part JOIN nation ON n_nationkey = p_size % 40 GROUP BY p_brand")
def known_journals_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS journal")
    rows = table(spark, sf_dir, "part").selectExpr("p_brand", "p_partkey", "p_size % 40 AS journal")
    return d.first_wins(c.units_of_sample(rows, known, "journal"), ["p_brand"], ["p_partkey"]).select("p_brand", "p_partkey")


@query("SELECT o_orderpriority, count(*) AS n, round(avg(w), 6) AS mean_tokens, min(w) AS least, max(w) AS most, round(sum((w * 5.0 + 500 * 30.0) / 1000000 * 0.5), 6) AS usd FROM (SELECT o_orderpriority, floor(floor(o_totalprice) * 1.33)::BIGINT AS w FROM orders) GROUP BY 1")
def cost_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", F.floor(F.floor("o_totalprice") * 1.33).cast("long").alias("w"))
    usd = s.token_cost(F.col("w"), F.lit(500), F.lit(5.0), F.lit(30.0), F.lit(True))
    return rounded(rows.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.avg("w").alias("mean_tokens"), F.min("w").alias("least"), F.max("w").alias("most"), F.sum(usd).alias("usd")))


@query("SELECT lang, doc_id, r AS round FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY quality = 0 DESC, md5('4|' || doc_id::VARCHAR), doc_id)::INT AS r FROM documents JOIN labels USING (doc_id)) WHERE r <= 30")
def urgent_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("lang", "doc_id", (F.col("quality") == 0).alias("urgent"))
    return q.deficit_sample(pool, pool.limit(0), "lang", "doc_id", 30, 4, urgent="urgent").drop("urgent")


@query("""WITH t AS (SELECT 'j__' || doc_id AS stem, lang || doc_id AS text FROM documents WHERE doc_id % 3 <> 0), r AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'j__' || page_id ELSE 'x' || page_id END AS name, CASE WHEN page_id % 4 = 1 THEN 'j__' || (page_id + 1) ELSE 'y' || page_id END AS slug, (page_id + 2)::VARCHAR AS suffix FROM pages)
SELECT page_id, coalesce(a.text, b.text, c.text) AS text FROM r LEFT JOIN t a ON a.stem = name LEFT JOIN t b ON b.stem = slug LEFT JOIN t c ON c.stem = 'j__' || suffix""")
def cached_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").where("doc_id % 3 <> 0").selectExpr("concat('j__', doc_id) AS stem", "concat(lang, doc_id) AS text")
    records = table(spark, sf_dir, "pages").selectExpr("page_id", "CASE WHEN page_id % 4 = 0 THEN concat('j__', page_id) ELSE concat('x', page_id) END AS name", "CASE WHEN page_id % 4 = 1 THEN concat('j__', page_id + 1) ELSE concat('y', page_id) END AS slug", "CAST(page_id + 2 AS STRING) AS suffix")
    return c.cached_text(records, texts, "name", "slug", "suffix").select("page_id", "text")


@query("""SELECT c_custkey AS scenario, t.task, t.category, n.r_name AS category_name FROM customer LEFT JOIN (SELECT s_nationkey AS scenario, min(s_suppkey) AS task, min(s_suppkey) % 7 AS category FROM supplier GROUP BY 1) t ON t.scenario = c_custkey LEFT JOIN region n ON n.r_regionkey = t.category""")
def scenario_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    scenarios = table(spark, sf_dir, "customer").selectExpr("c_custkey AS scenario")
    tasks = table(spark, sf_dir, "supplier").selectExpr("CAST(s_nationkey AS LONG) AS scenario", "s_suppkey AS task", "s_suppkey % 7 AS category")
    return c.tasks_of(scenarios, tasks, table(spark, sf_dir, "region").selectExpr("CAST(r_regionkey AS LONG) AS category", "r_name AS category_name"))


@query("""SELECT event_id, event_type = 'click' AND event_id % 4 >= 2 AND event_id % 3 = 0 AS open, event_id % 5 = 0 OR event_type = 'error' AND event_id % 2 = 0 OR event_type = 'purchase' AS wall, event_id % 6 > 2 AND event_id % 9 <> 0 AS fresh FROM events""")
def attempt_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, kind = F.col("event_id"), F.col("event_type")
    may = g.open_access(kind == "click", F.when(k % 4 != 0, k % 4), k % 3 == 0, least=2, prefer_direct=True)
    wall = g.blocked(F.when(k % 5 == 0, 403).otherwise(200), F.when((kind == "error") & (k % 2 == 0), "HTTP_403"), F.when(kind == "purchase", "Just a Moment..."), F.lit(None).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", may.alias("open"), wall.alias("wall"), g.fresh(F.when(k % 9 != 0, k % 6), F.lit(3)).alias("fresh"))


@query("SELECT conv_id, turn, md5('Judge.' || chr(10) || 'Reference: ' || text || chr(10) || 'Candidate: ' || role || chr(10) || 'End') AS whole, md5('Judge.' || chr(10) || 'Reference: ') AS rubric, md5(text || chr(10) || 'Candidate: ') AS reference, md5(role || chr(10) || 'End') AS candidate FROM conversations")
def prompt_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = g.prompt_segments("Judge.\nReference: {REFERENCE_TEXT}\nCandidate: {CANDIDATE_SUMMARY}\nEnd", F.col("text"), F.col("role"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", parts.alias("p"))
    return rows.select("conv_id", "turn", F.md5(F.concat("p.rubric", "p.reference", "p.candidate")).alias("whole"), *[F.md5(f"p.{n}").alias(n) for n in ("rubric", "reference", "candidate")])
