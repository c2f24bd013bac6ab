"""One query for each operator of the engine on the driver's tables, with SQL for DuckDB where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions import scoring as s
from lumenfold.functions import text as t
from lumenfold.operators import aggregate as a
from lumenfold.operators import dedup as d
from lumenfold.operators import reports as r
from lumenfold.operators import sampling as q
from lumenfold.operators import statistics as st
from lumenfold.operators.overlap import rouge_table
from lumenfold.plans.adapters import CRITERIA, JUDGEMENTS_SQL, PAIRS_SQL, SCORES_SQL, UB_SQL, U_SQL, WB_SQL, W_SQL, items, judgements, table, turn_pairs
from lumenfold.plans.registry import ORACLE_SQL, QUERIES, query, rounded

__all__ = ["ORACLE_SQL", "QUERIES"]

# Scores ------------------------------------------------------------------------------------------

@query(f"WITH {SCORES_SQL} SELECT provider, count(*) AS n_items, sum(n_rows)::BIGINT AS n_rows, count(unweighted) AS n_scored, round(avg(unweighted), 6) AS mean_unweighted, round(avg(weighted), 6) AS mean_weighted, round(avg(h_majority::INT), 6) AS hallucinated_rate, round(avg(h_any::INT), 6) AS hallucinated_any_rate FROM items GROUP BY provider")
def provider_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(a.group_report(items(spark, sf_dir), ["provider"], ["hallucinated"]))


@query(f"WITH {SCORES_SQL} SELECT item, provider, round(unweighted, 6) AS unweighted, round(weighted, 6) AS weighted, round(disagreement, 6) AS disagreement, {', '.join(f'round({c}, 6) AS {c}' for c in CRITERIA)}, h_majority AS hallucinated_majority, h_any AS hallucinated_any, round(h_rate, 6) AS hallucinated_rate, h_missing AS hallucinated_missing, n_judges, n_rows FROM items")
def item_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(items(spark, sf_dir))


@query(f"""WITH {SCORES_SQL}, f AS (SELECT 'p_brand' AS field, p_brand AS value, items.* FROM items JOIN part ON item = p_partkey UNION ALL SELECT 'p_type', p_type, items.* FROM items JOIN part ON item = p_partkey)
SELECT field, value, count(*) AS n_items, sum(n_rows)::BIGINT AS n_rows, count(unweighted) AS n_scored, round(avg(unweighted), 6) AS mean_unweighted, round(avg(weighted), 6) AS mean_weighted FROM f GROUP BY ALL""")
def report_by_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), "p_brand", "p_type")
    return rounded(a.report_by_fields(items(spark, sf_dir).join(part, "item"), ["p_brand", "p_type"]))


@query(f"""WITH {SCORES_SQL} SELECT p_brand, {', '.join(f"round(avg(unweighted) FILTER (provider = '{p}'), 6) AS mean_{p}, count(unweighted) FILTER (provider = '{p}') AS n_{p}" for p in 'ANR')}, count(unweighted) AS n_provider_items FROM items JOIN part ON item = p_partkey GROUP BY p_brand""")
def stratum_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), "p_brand")
    return rounded(a.crosstab(items(spark, sf_dir).join(part, "item"), "p_brand", "provider", ["A", "N", "R"]))


@query(f"WITH {SCORES_SQL}, c AS (UNPIVOT (SELECT provider, {', '.join(CRITERIA)} FROM items) ON {', '.join(CRITERIA)} INTO NAME criterion VALUE score) SELECT provider, criterion, round(avg(score), 6) AS mean_score, count(score) AS n FROM c GROUP BY ALL")
def criterion_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(a.criterion_means(items(spark, sf_dir)))


@query(f"WITH {JUDGEMENTS_SQL}, m AS (SELECT p_brand, provider, avg(faithfulness) AS score, count(*) AS n FROM judgements JOIN part ON item = p_partkey GROUP BY ALL), g AS (SELECT DISTINCT x.p_brand, y.provider FROM m x, m y) SELECT g.p_brand, g.provider, round(score, 6) AS score, n FROM g LEFT JOIN m USING (p_brand, provider)")
def covariate_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), "p_brand")
    cells = judgements(spark, sf_dir).join(part, "item").groupBy("p_brand", "provider").agg(F.avg("faithfulness").alias("score"), F.count("*").alias("n"))
    return rounded(a.full_grid(cells, "p_brand", "provider"))


@query(f"WITH {JUDGEMENTS_SQL} SELECT judge, count_if(cache_read IS NOT NULL) AS n_recorded, sum(cache_read)::BIGINT AS read, (sum(tokens_in) FILTER (cache_read IS NOT NULL))::BIGINT AS total, round(sum(cache_read) / sum(tokens_in) FILTER (cache_read IS NOT NULL), 6) AS hit_rate FROM judgements GROUP BY judge")
def cache_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(a.hit_rate(judgements(spark, sf_dir), ["judge"], "cache_read", "tokens_in"))


@query(f"WITH {JUDGEMENTS_SQL} SELECT judge, count(DISTINCT coalesce(prompt_shape, '(none)')) AS n_prompt_shape, count(DISTINCT coalesce(input_source, '(none)')) AS n_input_source, greatest(count(DISTINCT coalesce(prompt_shape, '(none)')), count(DISTINCT coalesce(input_source, '(none)'))) > 1 AS mixed FROM judgements GROUP BY judge")
def mixed_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.mixed_provenance(judgements(spark, sf_dir), "judge", ["prompt_shape", "input_source"])


@query("""WITH k AS (SELECT lang, CASE WHEN n_chars >= 1500 THEN 'primary' WHEN n_chars >= 300 THEN 'secondary' ELSE 'missing' END AS kind FROM documents)
SELECT lang, count_if(kind = 'primary') AS n_primary, count_if(kind = 'secondary') AS n_secondary, count_if(kind = 'missing') AS n_missing, count(*) AS n, greatest(0, 200 - count_if(kind = 'primary')) AS deficit FROM k GROUP BY lang""")
def corpus_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("n_chars") >= 1500, "primary").when(F.col("n_chars") >= 300, "secondary").otherwise("missing")
    return a.quota_status(table(spark, sf_dir, "documents").withColumn("kind", kind), "lang", ["primary", "secondary", "missing"], "kind", 200).drop("kinds")


@query(f"WITH {JUDGEMENTS_SQL}, f AS (SELECT provider, item, arg_min(tokens_in, l_orderkey * 1000000 + l_linenumber * 100000 + l_suppkey) AS tokens_in, arg_min(tokens_out, l_orderkey * 1000000 + l_linenumber * 100000 + l_suppkey) AS tokens_out FROM judgements GROUP BY ALL) SELECT provider, round(avg(tokens_in), 4) AS tokens_in, round(avg(tokens_out), 4) AS tokens_out, count(*) AS n_items FROM f GROUP BY provider")
def first_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.first_metrics_mean(judgements(spark, sf_dir), ["item"], ["provider"], ["l_orderkey", "l_linenumber", "l_suppkey"], ["tokens_in", "tokens_out"])


_PRICE = " ".join(f"WHEN '{p}' THEN {{{k}}}" for k, p in enumerate("ANR"))


@query(f"""WITH {JUDGEMENTS_SQL} SELECT provider, count(*) AS n, round(sum((greatest(0, tokens_in - coalesce(cache_read, 0)) * pin + coalesce(cache_read, 0) * pin * share + tokens_out * pout) / 1000000 * CASE WHEN input_source = 'O' THEN 0.5 ELSE 1 END), 6) AS usd
FROM judgements JOIN (VALUES ('A', 5.0, 30.0, 0.5), ('N', 5.0, 25.0, 0.1), ('R', 4.0, 18.0, 0.1)) p(provider, pin, pout, share) USING (provider) GROUP BY provider""")
def token_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = spark.createDataFrame([(p, *x[:3]) for p, x in zip("ANR", s.PRICES.values())], "provider string, pin double, pout double, share double")
    rows = judgements(spark, sf_dir).join(F.broadcast(prices), "provider")
    plain = F.greatest(F.lit(0), F.col("tokens_in") - F.coalesce("cache_read", F.lit(0)))
    cached = F.coalesce("cache_read", F.lit(0)) * F.col("pin") * F.col("share") / 1_000_000 * F.when(F.col("input_source") == "O", 0.5).otherwise(1.0)
    cost = s.token_cost(plain, F.col("tokens_out"), F.col("pin"), F.col("pout"), F.col("input_source") == "O") + cached
    return rounded(rows.groupBy("provider").agg(F.count("*").alias("n"), F.sum(cost).alias("usd")))


@query(f"WITH {JUDGEMENTS_SQL} SELECT l_orderkey, l_linenumber, l_suppkey, item, round(CASE WHEN {WB_SQL} > 0 THEN ({W_SQL})::DOUBLE / ({WB_SQL}) END, 6) AS jury, list_filter([{', '.join(f'CASE WHEN {c} IS NULL THEN {chr(39)}{c}{chr(39)} END' for c in CRITERIA)}], lambda x: x IS NOT NULL)::VARCHAR AS absent FROM judgements")
def jury_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = {c: F.col(c) for c in CRITERIA}
    absent = F.concat(F.lit("["), F.array_join(s.missing(cols), ", "), F.lit("]"))
    return rounded(judgements(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_suppkey", "item", s.weighted_mean(cols).alias("jury"), absent.alias("absent")))


@query("""SELECT c_custkey, greatest(1.0, least(5.0, c_acctbal / 2000)) AS clamped, CASE WHEN c_acctbal <= 0 THEN 99 ELSE round_even((least(5.0, c_acctbal / 2000) - 1) / 4 * 9 + 1, 0)::INT END AS quality,
greatest(1, least(5, round_even(c_acctbal / 2000, 0)::INT)) AS category, CASE WHEN c_acctbal / 10000 >= 0.85 THEN 'high' WHEN c_acctbal / 10000 < 0.5 THEN 'low' ELSE 'moderate' END AS band FROM customer""")
def score_ladders(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("c_acctbal") / 2000
    quality = s.quality_score(F.when(F.col("c_acctbal") <= 0, 0.0).otherwise(F.least(F.lit(5.0), x)))
    return table(spark, sf_dir, "customer").select("c_custkey", s.clamp(x, 1.0, 5.0).alias("clamped"), quality.alias("quality"), s.category(x).alias("category"), s.density_band(F.col("c_acctbal") / 10000).alias("band"))


# Duplicates and joins -----------------------------------------------------------------------------


@query("SELECT event_id, ts, user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.last_by(table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value"), ["user_id", "event_type"], ["ts", "event_id"])


@query("""WITH u AS (SELECT c_nationkey AS nation, c_name AS name, 0 AS tab, c_custkey AS seq FROM customer UNION ALL SELECT s_nationkey, s_name, 1, s_suppkey FROM supplier)
SELECT nation, name, seq FROM (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY tab, seq) AS r FROM u) WHERE r = 1""")
def manifest_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_name").alias("name"), F.col("c_custkey").alias("seq"))
    second = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("seq"))
    return d.union_first_wins([first, second], ["nation"], ["seq"])


@query("SELECT source, arg_max(doc_id, doc_id) AS doc_id, arg_max(n_chars, doc_id) AS n_chars, min(doc_id) AS place, count(*) AS copies FROM documents GROUP BY lower(source), source")
def last_content_first_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.last_content_first_place(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), F.col("source"), "doc_id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def ledger_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.not_done(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("SELECT doc_id, quality, toxic FROM labels WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, 9, 9 FROM documents WHERE doc_id % 3 = 0")
def slot_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = table(spark, sf_dir, "documents").where("doc_id % 3 = 0").select("doc_id", F.lit(9).alias("quality"), F.lit(9).alias("toxic"))
    return d.upsert(table(spark, sf_dir, "labels"), changes, ["doc_id"])


@query("SELECT s_suppkey, s_name, coalesce(m.n, 0) AS matches, CASE WHEN m.n = 1 THEN m.k END AS c_custkey FROM supplier LEFT JOIN (SELECT c_nationkey % 100 AS g, count(*) AS n, min(c_custkey) AS k FROM customer GROUP BY 1) m ON s_nationkey = m.g")
def unique_title_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.col("s_nationkey").alias("g"))
    target = table(spark, sf_dir, "customer").select((F.col("c_nationkey") % 100).alias("g"), "c_custkey")
    return d.unique_match(rows, target, "g", "c_custkey").drop("g")


@query("""WITH f AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) % 2 = 0)
SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey IN (SELECT l_suppkey FROM f))""")
def phantom_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    pending = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_orderkey")
    requests = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_orderkey").alias("o_orderkey"))
    sizes = requests.groupBy("l_suppkey").agg(F.count("*").alias("n")).where("n % 2 = 0").select("n").distinct()
    return d.phantoms(pending, requests, sizes, "l_suppkey", "o_orderkey", "n")


@query("SELECT d.doc_id, coalesce(l.quality, g.quality) AS quality FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN (SELECT lang, min(quality) AS quality FROM documents JOIN labels USING (doc_id) GROUP BY lang) g ON g.lang = d.lang")
def fallback_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels")
    coarse = docs.join(labels, "doc_id").groupBy("lang").agg(F.min("quality").alias("quality"))
    return d.with_fallback(docs, [(labels, ["doc_id"]), (coarse, ["lang"])], "quality").select("doc_id", "quality")


@query("SELECT page_id, CASE WHEN page_id * 7 IN (SELECT doc_id FROM labels) THEN page_id * 7 WHEN page_id * 3 IN (SELECT doc_id FROM labels) THEN page_id * 3 WHEN page_id IN (SELECT doc_id FROM labels) THEN page_id END AS doc_id FROM pages")
def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", F.array(F.col("page_id") * 7, F.col("page_id") * 3, F.col("page_id")).alias("c"))
    return d.best_candidate(rows, ["page_id"], "c", table(spark, sf_dir, "labels").select("doc_id"), "doc_id").select("page_id", "doc_id")


@query("SELECT c_nationkey AS journal, count(*) AS n_errors, count(DISTINCT user_id) AS n_items FROM events JOIN customer ON user_id = c_custkey WHERE event_type = 'error' GROUP BY 1")
def error_block_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = table(spark, sf_dir, "events").where("event_type = 'error'").select("user_id")
    journal = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("journal"))
    return errors.join(journal, "user_id").groupBy("journal").agg(F.count("*").alias("n_errors"), F.count_distinct("user_id").alias("n_items"))


@query("SELECT DISTINCT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND event_type = 'purchase'")
def touched_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("ts >= timestamp'2024-01-10' and event_type = 'purchase'").select("user_id").distinct()


@query("SELECT event_type, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS total, count(*) AS n FROM events GROUP BY 1")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(value).alias("total"), F.count("*").alias("n"))


# Text ----------------------------------------------------------------------------------------------

_TOK = "list_transform(regexp_extract_all({}, '[A-Za-z0-9]+'), lambda x: lower(x))"
_GRAMS = "CASE WHEN len({0}) >= {1} THEN list_transform(range(1, len({0}) - {1} + 2), lambda i: array_to_string({0}[i:i + {1} - 1], ' ')) ELSE [] END"
_ROUGE = "CASE WHEN len({r}) = 0 THEN 0 ELSE list_sum(list_transform(list_distinct({r}), lambda g: least(len(list_filter({r}, lambda y: y = g)), len(list_filter({c}, lambda y: y = g))))) / len({r}) END"


@query(f"""WITH {PAIRS_SQL}, k AS (SELECT conv_id, turn, {_TOK.format('reference')} AS r, {_TOK.format('candidate')} AS c FROM pairs),
g AS (SELECT *, {_GRAMS.format('r', 2)} AS r2, {_GRAMS.format('c', 2)} AS c2 FROM k)
SELECT conv_id, turn, round({_ROUGE.format(r='r', c='c')}, 6) AS rouge_1, round({_ROUGE.format(r='r2', c='c2')}, 6) AS rouge_2, round(CASE WHEN len(r) > 0 THEN len(c) / len(r) ELSE 0 END, 6) AS compression,
round(CASE WHEN len(c) > 0 THEN len(list_filter(c, lambda x: list_contains(r, x))) / len(c) ELSE 0 END, 6) AS coverage FROM g""")
def automatic_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, c = F.col("reference"), F.col("candidate")
    pairs = turn_pairs(spark, sf_dir).select("conv_id", "turn", t.tokens(r).alias("r"), t.tokens(c).alias("c"), t.compression_ratio(r, c).alias("compression"))
    scores = rouge_table(pairs, ["conv_id", "turn"], "r", "c", [1, 2])
    return rounded(scores.join(pairs.select("conv_id", "turn", "compression"), ["conv_id", "turn"]))


@query()
def rouge_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(turn_pairs(spark, sf_dir).select("conv_id", "turn", t.rouge_l_recall(t.tokens(F.col("reference")), t.tokens(F.col("candidate"))).alias("rouge_l")))


_SECTION_SQL = " + ".join("regexp_matches(regexp_replace(html, '[^\\x00-\\x7F]', ' ', 'g'), '" + p.replace("(?i)", "", 1) + "', 'i')::INT" for p in t.SUMMARY_SECTIONS.values())


@query(f"SELECT page_id, {_SECTION_SQL} AS n_sections, round(({_SECTION_SQL}) / 6, 6) AS ratio FROM pages")
def section_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = F.regexp_replace("html", r"[^\x00-\x7F]", " ")  # engines differ on word boundaries beyond ASCII
    return rounded(table(spark, sf_dir, "pages").select("page_id", t.section_count(plain).alias("n_sections"), t.section_ratio(plain).alias("ratio")))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+'))::INT AS words, floor(len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')) * 1.33)::BIGINT AS tokens FROM documents")
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", t.word_count(F.col("text")).alias("words"), t.prompt_tokens(F.col("text")).alias("tokens"))


@query(f"""WITH {PAIRS_SQL}, k AS (SELECT conv_id, turn, round(CASE WHEN len(regexp_extract_all(reference, '[A-Za-z][A-Za-z''-]*')) > 0 THEN len(regexp_extract_all(candidate, '[A-Za-z][A-Za-z''-]*')) / len(regexp_extract_all(reference, '[A-Za-z][A-Za-z''-]*')) END, 3) AS ratio FROM pairs)
SELECT conv_id, turn, ratio, CASE WHEN ratio IS NULL THEN 'unknown' WHEN abs(ratio - 1.0) <= 0.02 THEN 'same' WHEN ratio < 1 THEN 'shorter' ELSE 'longer' END AS label FROM k""")
def word_count_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_pairs(spark, sf_dir).select("conv_id", "turn", t.length_comparison(F.col("reference"), F.col("candidate")).alias("x")).select("conv_id", "turn", "x.*")


@query(r"""SELECT page_id, coalesce(nullif(regexp_replace(substring(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(url, '<[^>]+>', '', 'g'), '[^\x00-\x7F]', '', 'g')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 40), '_+$', ''), ''), 'untitled') AS part,
regexp_replace(translate(url, '/:.', '___'), '^_+|_+$', '', 'g') AS slug FROM pages""")
def slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", t.filename_part(F.col("url"), 40).alias("part"), t.doi_slug(F.col("url")).alias("slug"))


@query(r"SELECT page_id, length(x) AS n, md5(x) AS digest FROM (SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') AS x FROM pages)")
def strip_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", t.strip_tags(F.col("html")).alias("x")).select("page_id", F.length("x").cast("long").alias("n"), F.md5("x").alias("digest"))


@query("SELECT page_id, '10.' || (1000 + page_id) || '/ab.' || page_id AS first, (1 + (page_id % 2 = 0)::INT)::INT AS n FROM pages")
def doi_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("see (10."), F.col("page_id") + 1000, F.lit("/Ab."), F.col("page_id"), F.lit("). also 10."), F.when(F.col("page_id") % 2 == 0, F.lit("99999/x")).otherwise(F.concat(F.col("page_id") + 1000, F.lit("/aB."), F.col("page_id"))), F.lit(" end"))
    found = t.dois(text)
    return table(spark, sf_dir, "pages").select("page_id", F.get(found, F.lit(0)).alias("first"), F.size(found).alias("n"))


@query(r"SELECT doc_id, md5(rtrim(text, E' \n') || E'\nreferences\nagain') AS last_cut, md5(rtrim(text, E' \n')) AS first_cut FROM documents")
def references_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.rtrim(F.regexp_replace("text", r"\s+\z", "")), F.lit("\nreferences\nagain\n\n  Works cited \n1. x"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(t.cut_at_last_heading(text)).alias("last_cut"), F.md5(t.cut_at_first_heading(text)).alias("first_cut"))


@query("""WITH h AS (SELECT doc_id, text, substring(text, 1, 500) AS head, instr(reverse(substring(text, 1, 500)), '.') AS back FROM documents)
SELECT doc_id, md5(CASE WHEN length(text) <= 500 THEN text WHEN back > 0 AND 501 - back > 250 THEN substring(text, 1, (501 - back)::BIGINT) ELSE head END) AS cut FROM h""")
def truncate_at_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(t.truncate_at_sentence(F.col("text"), 500)).alias("cut"))


@query()
def rubric_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_pairs(spark, sf_dir).select("conv_id", "turn", t.rubric_scores(F.col("candidate"), F.col("reference")).alias("x")).select("conv_id", "turn", "x.*")


_HAS = lambda words: "(" + " OR ".join(f"contains(lower(html), '{w}')" for w in words) + ")"


@query(f"SELECT page_id, array_to_string(list_filter([{', '.join(f'CASE WHEN {_HAS(w)} THEN {chr(39)}{k}{chr(39)} END' for k, w in s.SPECIES.items())}], lambda x: x IS NOT NULL), ',') AS species, CASE {' '.join(f'WHEN {_HAS(w)} THEN {chr(39)}{k}{chr(39)}' for k, w in s.DESIGNS.items())} END AS design, CASE {' '.join(f'WHEN {_HAS(w)} THEN {chr(39)}{k}{chr(39)}' for k, w in s.TOPICS.items())} END AS topic FROM pages")
def covariate_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(s.all_labels(x, s.SPECIES), ",").alias("species"), s.first_label(x, s.DESIGNS).alias("design"), s.first_label(x, s.TOPICS).alias("topic"))


_TITLE = "CASE p_partkey % 5 WHEN 0 THEN 'Erratum: ' || p_name WHEN 1 THEN ' ' WHEN 2 THEN 'An Editorial on ' || p_name ELSE p_name END"


@query(f"SELECT p_partkey, CASE WHEN trim({_TITLE}) = '' THEN 'no_title' WHEN p_partkey % 5 IN (0, 2) THEN 'title_pattern' WHEN p_size % 2 = 0 AND p_size % 3 = 0 THEN 'no_authors_and_abstract' END AS reason FROM part")
def title_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_TITLE} AS title", "CASE WHEN p_size % 2 = 0 THEN array() ELSE array('x') END AS authors", "CASE WHEN p_size % 3 = 0 THEN NULL ELSE 'x' END AS abstract")
    return rows.select("p_partkey", s.rejection(F.col("title"), F.col("authors"), F.col("abstract")).alias("reason"))


@query("SELECT doc_id, CASE WHEN lang = 'de' THEN 'corrupt' WHEN n_chars // 1000 < 3 THEN 'too_few_pages' WHEN doc_id % 7 < 3 THEN 'too_few_sections' WHEN n_chars = 0 THEN 'empty_text' WHEN n_chars // 5 < 3000 THEN 'too_few_words' END AS error_type FROM documents")
def validation_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").select("doc_id", s.text_gate(F.col("lang") != "de", F.floor(n / 1000), F.col("doc_id") % 7, F.floor(n / 5)).alias("error_type"))


@query("SELECT source, sha256(string_agg(sha256(text), '|' ORDER BY sha256(text))) AS digest FROM documents GROUP BY source")
def combined_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = table(spark, sf_dir, "documents").select("source", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    return one.groupBy("source").agg(F.sha2(F.concat_ws("|", F.array_sort(F.collect_list("h"))).cast("binary"), 256).alias("digest"))


@query("SELECT doc_id, CAST('0x' || substring(sha256(text), 1, 8) AS BIGINT) AS number FROM documents")
def stable_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", t.stable_int(F.col("text")).alias("number"))


# Samples -------------------------------------------------------------------------------------------

_MD5 = "md5('{0}|' || {1}::VARCHAR)"


@query(f"SELECT doc_id, lang, r AS round FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_MD5.format(7, 'doc_id')}, doc_id)::INT AS r FROM documents) WHERE r <= 20")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.per_stratum(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", 20, "doc_id", 7)


@query(f"SELECT doc_id, source, r AS round FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {_MD5.format(3, 'doc_id')}, doc_id)::INT AS r FROM documents) ORDER BY r, {_MD5.format(3, 'source')}, source LIMIT 55")
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.round_robin(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", 55, "doc_id", 3)


@query(f"""WITH f AS (SELECT doc_id, lang, quality = 0 AS flag, 0 AS round FROM documents JOIN labels USING (doc_id) WHERE quality = 0 ORDER BY {_MD5.format(5, 'doc_id')}, doc_id LIMIT 10),
r AS (SELECT doc_id, lang, quality = 0 AS flag, row_number() OVER (PARTITION BY lang ORDER BY {_MD5.format(5, 'doc_id')}, doc_id)::INT AS round FROM documents JOIN labels USING (doc_id) WHERE doc_id NOT IN (SELECT doc_id FROM f))
SELECT * FROM (SELECT * FROM f UNION ALL SELECT * FROM r) ORDER BY round > 0, round, {_MD5.format(5, 'lang')}, {_MD5.format(5, 'doc_id')}, doc_id LIMIT 40""")
def flagged_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang", (F.col("quality") == 0).alias("flag"))
    return q.flagged_first(rows, "flag", "lang", 40, "doc_id", 5, most=10)


def _quotas(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("en", 50), ("de", 30), ("fr", 20)], "lang string, quota int")


@query(f"SELECT doc_id, lang, r AS round FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_MD5.format(11, 'doc_id')}, doc_id)::INT AS r FROM documents) JOIN (VALUES ('en', 50), ('de', 30), ('fr', 20)) v(lang, q) USING (lang) WHERE r <= q")
def quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.quota(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", _quotas(spark), "doc_id", 11)


@query(f"""WITH r AS (SELECT doc_id, lang, quota, row_number() OVER (PARTITION BY lang ORDER BY {_MD5.format(11, 'doc_id')}, doc_id)::INT AS round FROM documents JOIN (VALUES ('en', 50), ('de', 300), ('fr', 20)) v(lang, quota) USING (lang)),
k AS (SELECT doc_id, lang, round FROM r WHERE round <= quota), g AS (SELECT 370 - count(*) AS gap FROM k),
x AS (SELECT doc_id, lang, round, row_number() OVER (ORDER BY {_MD5.format(12, 'doc_id')}, doc_id) AS place FROM r WHERE round > quota AND round <= quota + 370)
SELECT * FROM k UNION ALL SELECT doc_id, lang, round FROM x, g WHERE place <= gap""")
def quota_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotas = spark.createDataFrame([("en", 50), ("de", 300), ("fr", 20)], "lang string, quota int")
    return q.quota(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", quotas, "doc_id", 11, "backfill")


@query(f"SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS round, {_MD5.format(2, 'conv_id')} AS group_key FROM conversations")
def interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.interleave(table(spark, sf_dir, "conversations").select("conv_id", "turn"), "conv_id", "turn", 2)


@query(f"""WITH pool AS (SELECT lang, doc_id FROM documents WHERE doc_id % 20 <> 0), seen AS (SELECT lang, doc_id, doc_id AS first_item FROM documents WHERE doc_id % 10 = 0),
c AS (SELECT lang, doc_id, true AS carried FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY first_item, doc_id) AS r FROM seen WHERE doc_id IN (SELECT doc_id FROM pool)) WHERE r <= 2),
f AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY {_MD5.format(9, 'doc_id')}, doc_id) AS r FROM pool WHERE doc_id NOT IN (SELECT doc_id FROM seen))
SELECT lang, doc_id, carried FROM c UNION ALL SELECT f.lang, doc_id, false FROM f LEFT JOIN (SELECT lang, count(*) AS had FROM c GROUP BY lang) h USING (lang) WHERE r <= 5 - coalesce(had, 0)""")
def carried_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("lang", "doc_id")
    previous = docs.where("doc_id % 10 = 0").withColumn("item_id", F.col("doc_id"))
    return q.carried_overlap(docs.where("doc_id % 20 <> 0"), previous, "lang", "doc_id", "item_id", 5, 0.5, 9)


@query("""WITH p AS (SELECT o_orderkey, o_orderpriority, year(o_orderdate)::INT AS y, row_number() OVER (PARTITION BY o_orderpriority, year(o_orderdate) ORDER BY o_orderkey) AS place FROM orders),
s AS (SELECT *, place <= CASE y WHEN 1995 THEN 4 WHEN 1996 THEN 3 WHEN 1997 THEN 3 ELSE 0 END AS strict FROM p)
SELECT o_orderkey, o_orderpriority, y, strict, r AS round FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY strict DESC, o_orderkey)::INT AS r FROM s) WHERE r <= 10""")
def year_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.year("o_orderdate").alias("y"))
    return q.year_quotas(rows, "o_orderpriority", "y", [1995, 1996, 1997], 10, "o_orderkey")


@query(f"""WITH h AS (SELECT lang, count(*) AS n FROM documents WHERE doc_id % 4 = 0 GROUP BY lang)
SELECT doc_id, lang, r AS round FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_MD5.format(4, 'doc_id')}, doc_id)::INT AS r FROM documents WHERE doc_id % 4 <> 0) LEFT JOIN h USING (lang) WHERE r <= greatest(0, 60 - coalesce(n, 0))""")
def deficit_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return q.deficit_sample(docs.where("doc_id % 4 <> 0"), docs.where("doc_id % 4 = 0"), "lang", "doc_id", 60, 4)


@query("""WITH r AS (SELECT event_id, event_type, round(sum(floor(value)) OVER (PARTITION BY event_type ORDER BY event_id), 6) AS spent FROM events), o AS (SELECT *, spent > 5000 AS over FROM r)
SELECT event_id, event_type, spent, over, over AND NOT coalesce(lag(over) OVER (PARTITION BY event_type ORDER BY event_id), false) AS stops FROM o""")
def budget_running_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", F.floor("value").cast("double").alias("cost"))
    return rounded(q.running_total(rows, ["event_type"], ["event_id"], "cost", 5000.0).drop("cost"))


@query("""WITH r AS (SELECT event_id, event_type, value > 5 AS ok, coalesce(sum((value > 5)::INT) OVER w, 0)::BIGINT AS done, coalesce(sum((value <= 5)::INT) OVER w, 0)::BIGINT AS lost FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT * FROM r WHERE done < 50 AND lost < 300""")
def until_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", (F.col("value") > 5).alias("ok"))
    return q.until_quota(rows, "event_type", "event_id", "ok", 50, 300)


@query("SELECT doc_id, lang, r AS round FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id)::INT AS r FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) WHERE r <= 15")
def batch_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.capped_new(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), ["doc_id"], ["lang"], ["doc_id"], 15)


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS version, count(*) OVER (PARTITION BY conv_id) AS versions FROM conversations")
def summary_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.version_of(table(spark, sf_dir, "conversations").select("conv_id", "turn"), ["conv_id"], ["turn"])


@query("""SELECT user_id, event_id, event_type, p AS priority FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY p, event_id) AS r FROM (SELECT *, CASE event_type WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 ELSE 99 END AS p FROM events)) WHERE r = 1""")
def best_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.best_attempt(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_type", ["error", "purchase"], "event_id")


# Statistics ----------------------------------------------------------------------------------------


@query(f"""WITH {JUDGEMENTS_SQL}, o AS (SELECT provider, item, judge, avg(faithfulness) AS f FROM judgements WHERE faithfulness IS NOT NULL GROUP BY ALL), u AS (SELECT provider, item, count(*) AS m, sum(f) AS s1, sum(f * f) AS s2 FROM o GROUP BY ALL HAVING count(*) > 1),
x AS (SELECT provider, count(*) AS n_units, sum(m) AS n, sum(s1) AS t1, sum(s2) AS t2, sum((2 * m * s2 - 2 * s1 * s1) / (m - 1)) AS within FROM u GROUP BY provider)
SELECT provider, n_units, n::BIGINT AS n_ratings, round(CASE WHEN 2 * n * t2 - 2 * t1 * t1 = 0 THEN 1 ELSE 1 - (within / n) / ((2 * n * t2 - 2 * t1 * t1) / (n * (n - 1))) END, 6) AS alpha FROM x""")
def krippendorff_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = r.one_rating(judgements(spark, sf_dir), ["provider", "item"], "judge", "faithfulness")
    return rounded(st.krippendorff_alpha(one, ["provider"], ["item"], "faithfulness"))


@query(f"""WITH {JUDGEMENTS_SQL}, o AS (SELECT item, provider, judge, arg_max(faithfulness, l_orderkey * 1000000 + l_linenumber * 100000 + l_suppkey) AS f FROM judgements WHERE faithfulness IS NOT NULL GROUP BY ALL)
SELECT a.judge AS judge_a, b.judge AS judge_b, count(*) AS n, round(avg(abs(a.f - b.f)), 6) AS mean_abs_diff, max(abs(a.f - b.f)) AS max_abs_diff FROM o a JOIN o b ON a.item = b.item AND a.provider = b.provider AND a.judge < b.judge WHERE a.f IS NOT NULL AND b.f IS NOT NULL GROUP BY 1, 2""")
def pairwise_abs_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = judgements(spark, sf_dir).where("faithfulness is not null").select("item", "provider", "judge", F.col("faithfulness").alias("f"), "l_orderkey", "l_linenumber", "l_suppkey")
    one = d.last_by(rated, ["item", "provider", "judge"], ["l_orderkey", "l_linenumber", "l_suppkey"])
    return rounded(st.pairwise_difference(one, ["item", "provider"], "judge", "f"))


def _kappa_sql(weight: str) -> str:
    return f"""WITH r AS (SELECT quality::DOUBLE AS a, toxic::DOUBLE AS b FROM labels), c AS (SELECT a, b, count(*) AS n FROM r GROUP BY ALL), t AS (SELECT sum(n) AS n, sum({weight} * n) AS o, sum((a = b)::INT * n) AS same FROM c),
e AS (SELECT sum({weight} * ra * cb) AS e FROM (SELECT a, count(*) AS ra FROM r GROUP BY a), (SELECT b, count(*) AS cb FROM r GROUP BY b))
SELECT n::BIGINT AS n, round(same / n, 6) AS agreement, round(CASE WHEN e = 0 THEN 1 ELSE 1 - o * n / e END, 6) AS kappa, e = 0 AS undefined FROM t, e"""


@query(_kappa_sql("(a <> b)::INT"))
def cohen_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(st.cohen_kappa(table(spark, sf_dir, "labels"), "quality", "toxic"))


@query(_kappa_sql("(a - b) * (a - b)"))
def cohen_kappa_quadratic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(st.cohen_kappa(table(spark, sf_dir, "labels"), "quality", "toxic", "quadratic"))


@query("SELECT l_returnflag, count(*) AS n, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY 1")
def pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(st.correlation(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice"))


@query("""WITH k AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS rx, rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2 AS ry FROM lineitem)
SELECT l_returnflag, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM k GROUP BY 1""")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(st.rank_correlation(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice"))


@query("WITH d AS (SELECT l_returnflag, l_quantity - l_linenumber AS x FROM lineitem) SELECT l_returnflag, count(*) AS n, round(avg(x), 6) AS bias, round(stddev_samp(x), 6) AS sd, round(avg(x) - 1.96 * stddev_samp(x), 6) AS low, round(avg(x) + 1.96 * stddev_samp(x), 6) AS high FROM d GROUP BY 1")
def bland_altman(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", F.col("l_linenumber").cast("double").alias("line"))
    return rounded(st.bland_altman(rows, ["l_returnflag"], "l_quantity", "line"))


@query(f"""WITH {SCORES_SQL}, i AS (SELECT item, provider, round(unweighted, 9) AS f FROM items), b AS (SELECT item FROM i GROUP BY item HAVING count(f) = 3),
k AS (SELECT item, provider, rank() OVER (PARTITION BY item ORDER BY f) + (count(*) OVER (PARTITION BY item, f) - 1) / 2 AS r, count(*) OVER (PARTITION BY item, f) AS m FROM i JOIN b USING (item)),
s AS (SELECT count(DISTINCT item) AS n, sum(m * m - 1) AS ties, sum(r) FILTER (provider = 'A') AS sa, sum(r) FILTER (provider = 'N') AS sn, sum(r) FILTER (provider = 'R') AS sr FROM k),
z AS (SELECT *, (12.0 / 12 * (sa * sa + sn * sn + sr * sr) / n - 3 * n * 4) / (1 - ties / (n * 24)) AS x FROM s)
SELECT n, round(x, 6) AS statistic, 2 AS df, round(sa / n, 6) AS "rank_A", round(sn / n, 6) AS "rank_N", round(sr / n, 6) AS "rank_R", round(exp(-x / 2), 6) AS p FROM z""")
def friedman(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = items(spark, sf_dir).select("item", "provider", F.round("unweighted", 9).alias("f"))  # ties are ties in any order of summation
    return rounded(st.friedman(one, ["item"], "provider", "f", ["A", "N", "R"]))


_WILCOXON = f"""WITH {SCORES_SQL}, i AS (SELECT p_brand, item, round(max(unweighted) FILTER (provider = 'A') - max(unweighted) FILTER (provider = 'R'), 9) AS d FROM items JOIN part ON item = p_partkey GROUP BY ALL),
k AS (SELECT p_brand, d, rank() OVER (PARTITION BY p_brand ORDER BY abs(d)) + (count(*) OVER (PARTITION BY p_brand, abs(d)) - 1) / 2 AS r FROM i WHERE d <> 0)
SELECT p_brand, count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS w_minus, round(avg(d), 6) AS mean_diff FROM k GROUP BY p_brand"""


def _wilcoxon(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda p: F.max(F.when(F.col("provider") == p, F.col("unweighted")))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), "p_brand")
    one = items(spark, sf_dir).join(part, "item").groupBy("p_brand", "item").agg(F.round(pick("A") - pick("R"), 9).alias("d"))
    return st.wilcoxon(one, ["p_brand"], "d")


@query(_WILCOXON)
def wilcoxon_w(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_wilcoxon(spark, sf_dir).drop("p", "ties"))


@query()
def wilcoxon_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.benjamini_hochberg(_wilcoxon(spark, sf_dir).select("p_brand", "n", "p"), [], "p")


@query("""WITH p AS (SELECT p_brand, p_partkey, (p_size * 7 % 50 + 1) / 51.0 AS p FROM part), r AS (SELECT *, p * count(*) OVER (PARTITION BY p_brand) / count(*) OVER (PARTITION BY p_brand ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS raw FROM p)
SELECT p_brand, p_partkey, round(p, 6) AS p, round(least(1.0, min(raw) OVER (PARTITION BY p_brand ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 4) AS q FROM r""")
def bh_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_brand", "p_partkey", ((F.col("p_size") * 7 % 50 + 1) / 51.0).alias("p"))
    return rounded(st.benjamini_hochberg(rows, ["p_brand"], "p"))


_TFIDF = f"""WITH {PAIRS_SQL}, k AS (SELECT conv_id * 1000 + turn AS id, {_TOK.format('reference')} AS l, {_TOK.format('candidate')} AS r FROM pairs),
f AS (SELECT id, 0 AS side, unnest(l) AS term FROM k UNION ALL SELECT id, 1, unnest(r) FROM k), tf AS (SELECT id, side, term, count(*) AS tf FROM f GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT id, side, term, tf * (ln((1 + (SELECT count(*) * 2 FROM k)) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term)),
b AS (SELECT id, term, sum(w) FILTER (side = 0) AS a, sum(w) FILTER (side = 1) AS b FROM w GROUP BY ALL),
c AS (SELECT id, coalesce(sum(a * b) / sqrt(sum(a * a) * sum(b * b)), 0) AS cosine FROM b GROUP BY id)
SELECT k.id, round(coalesce(cosine, 0), 6) AS cosine FROM k LEFT JOIN c USING (id)"""


def _cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turn_pairs(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), t.tokens(F.col("reference")).alias("l"), t.tokens(F.col("candidate")).alias("r"))
    return st.tfidf_cosine(rows, "id", "l", "r")


@query(_TFIDF)
def tfidf_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_cosines(spark, sf_dir))


@query()
def density_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = turn_pairs(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), t.length_comparison(F.col("reference"), F.col("candidate"))["label"].alias("length"))
    rows = pairs.join(_cosines(spark, sf_dir), "id").select((F.col("id") % 3).alias("provider"), s.density_band(F.col("cosine")).alias("band"), "length")
    return rounded(a.density_report(rows, "provider", "band", "length"))


@query()
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(st.bootstrap_ci(items(spark, sf_dir), ["provider"], "unweighted"))


from lumenfold.plans import columns, corpus, reports  # noqa: E402, F401  these register their queries
