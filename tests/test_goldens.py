"""Published and hand-checked values, edge cases and properties."""

import math

import pytest
from pyspark.sql import functions as F

from lumenfold.functions import scoring as s
from lumenfold.functions import text as t
from lumenfold.operators import aggregate as a
from lumenfold.operators import dedup as d
from lumenfold.operators import sampling as q
from lumenfold.operators import statistics as st
from lumenfold.operators.overlap import rouge_table
from lumenfold.sources import ledger
from lumenfold.streaming import ledger as stream


def units(spark, rows):
    return spark.createDataFrame([(u, float(x)) for u, r in enumerate(rows) for x in r], "u int, x double")


def alpha(spark, rows):
    got = st.krippendorff_alpha(units(spark, rows), [], ["u"], "x").collect()
    return got[0].alpha if got and got[0].n_units else None


def test_alpha(spark):
    assert alpha(spark, [[1, 2]]) == 0.0
    assert alpha(spark, [[3, 3], [5, 5], [4, 4]]) == 1.0
    assert abs(alpha(spark, [[4, 5], [4, 4], [3, 4]]) - 0.16667) < 1e-5
    assert alpha(spark, [[1, 5], [5, 1], [1, 5], [5, 1]]) < 0
    assert alpha(spark, [[1], [2]]) is None


def test_kappa(spark):
    shift = spark.createDataFrame([(k % 3, (k + 1) % 3) for k in range(9)], "a int, b int")
    assert st.cohen_kappa(shift, "a", "b").collect()[0].kappa == -0.5
    flat = st.cohen_kappa(spark.createDataFrame([(3, 3)] * 3, "a int, b int"), "a", "b").collect()[0]
    assert (flat.kappa, flat.undefined) == (1.0, True)


def test_friedman_and_wilcoxon(spark):
    rows = spark.createDataFrame([(i, p, float(v)) for i in range(6) for p, v in zip("xyz", (5, 4, 3))], "i int, p string, v double")
    got = st.friedman(rows, ["i"], "p", "v", ["x", "y", "z"]).collect()[0]
    assert (round(got.statistic, 9), got.df) == (12.0, 2) and abs(got.p - math.exp(-6)) < 1e-12
    ones = st.wilcoxon(spark.createDataFrame([(1.0,)] * 10, "x double"), [], "x").collect()[0]
    assert ones.w_minus == 0 and ones.p < 0.05 and ones.n == 10
    none = st.wilcoxon(spark.createDataFrame([(0.0,)] * 3, "x double"), [], "x").collect()[0]
    assert (none.n, none.w_minus, none.mean_diff) == (0, None, None)


def test_p_values():
    assert abs(st._gamma_q(1, 2) - math.exp(-2)) < 1e-14
    assert abs(st._gamma_q(0.5, 1.92072941) - 0.05) < 1e-6
    assert abs(st._beta(2, 3, 0.4) - 0.5248) < 1e-12
    assert st.signed_rank_p(15, 0, 5, 0, False) == 0.0625


def test_correlation_edges(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 2.0)], "x double, y double")
    assert st.correlation(rows, [], "x", "y").collect()[0].r is None
    line = spark.createDataFrame([(float(k), 2.0 * k) for k in range(5)], "x double, y double")
    assert abs(st.rank_correlation(line, [], "x", "y").collect()[0].rho - 1) < 1e-12


def test_bootstrap(spark):
    rows = spark.createDataFrame([("a", float(k % 5)) for k in range(200)] + [("b", 3.0)], "g string, x double")
    once, again = (sorted(st.bootstrap_ci(rows, ["g"], "x").collect()) for _ in range(2))
    assert once == again and once[0].low < 2.0 < once[0].high and once[1].low is None


def test_jury_scores(spark):
    rows = spark.createDataFrame([(4.0, 4.0, 3.0, 4.0, 5.0), (None, None, None, None, None), (1.0, 4.0, 4.0, 4.0, 4.0)], ", ".join(f"{c} double" for c in s.WEIGHTS))
    cols = {c: F.col(c) for c in s.WEIGHTS}
    got = rows.select(s.plain_mean(cols).alias("u"), F.round(s.weighted_mean(cols), 2).alias("w"), s.quality_score(s.plain_mean(cols)).alias("q"), s.missing(cols).alias("m")).collect()
    assert (got[0].u, got[0].w, got[0].q, got[0].m) == (4.0, 4.02, 8, [])
    assert (got[1].u, got[1].w, got[1].q, got[1].m) == (None, None, 99, list(s.WEIGHTS))
    assert got[2].w == 3.22


def test_items_weigh_the_same(spark):
    rows = [("X", "p", f"j{k}", 5.0, None) for k in range(3)] + [("Y", "p", "j0", 2.0, True), ("Y", "p", "j0", 2.0, False), ("Y", "p", " ", 2.0, False), ("Y", "p", None, 2.0, None)]
    table = spark.createDataFrame([(*r[:4], *[r[3]] * 4, r[4]) for r in rows], "item string, provider string, judge string, " + ", ".join(f"{c} double" for c in s.WEIGHTS) + ", h boolean")
    scores = a.item_scores(table, ["item"], flags=["h"])
    got = {r.item: r for r in scores.collect()}
    assert (got["Y"].n_judges, got["Y"].n_rows, got["Y"].h_majority, got["Y"].h_any, got["Y"].h_missing) == (3, 4, False, True, 1)
    assert got["X"].h_majority is None
    assert a.group_report(scores, ["provider"], ["h"]).collect()[0].mean_unweighted == 3.5


def test_replies():
    good = '{"criteria_scores": {"faithfulness": {"score": 4, "reasoning": "x"}, "safety": 9}}'
    assert s.parse_reply(good) == {"method": "json", "scores": {"faithfulness": 4.0, "safety": 5.0}}
    assert s.parse_reply("Here: " + good + " done")["method"] == "json_block"
    assert s.parse_reply("{'clarity': 3,}")["method"] == "json_repaired"
    assert s.parse_reply("Clarity: 4 and clinical usefulness = 2")["scores"] == {"clarity": 4.0, "clinical_usefulness": 2.0}
    assert s.parse_reply(None) == {"method": "sentinel", "scores": {}} and s.parse_reply("[1]")["method"] == "sentinel"


def test_reply_with_an_apostrophe():
    said = "{'clarity': {'score': 4, 'why': 'it doesn't wander'},}"
    assert s.parse_reply(said) == {"method": "regex", "scores": {}} or s.parse_reply(said)["scores"] == {"clarity": 4.0}
    assert s.parse_reply("{'clarity': 3, 'note': \"the judge's view\"}") == {"method": "json_repaired", "scores": {"clarity": 3.0}}


def test_text(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).collect()[0].x
    assert one(t.tokens(F.lit("A b-C9 é"))) == ["a", "b", "c9"]
    assert one(t.ngrams(t.tokens(F.lit("a")), 2)) == []
    pairs = spark.createDataFrame([(1, ["a", "a", "b"], ["a", "b", "b"]), (2, [], ["a"])], "k int, r array<string>, c array<string>")
    assert [(r.k, r.rouge_1, r.rouge_2) for r in rouge_table(pairs, ["k"], "r", "c", [1, 2]).orderBy("k").collect()] == [(1, pytest.approx(2 / 3), 0.5), (2, 0.0, 0.0)]
    assert one(t.rouge_l_recall(t.tokens(F.lit("a b c d")), t.tokens(F.lit("x a c d")))) == 0.75
    assert one(t.cut_at_last_heading(F.lit("x\nReferences\ny\nREFERENCES\nz"))) == "x\nReferences\ny"
    assert one(t.cut_at_first_heading(F.lit("x\nReferences\ny\nREFERENCES\nz"))) == "x"
    assert one(t.cut_at_last_heading(F.lit("x\norcid REFERENCES y\n1. a"))) == "x"
    assert one(t.truncate_at_sentence(F.lit("aaaa. bbbbbb"), 8)) == "aaaa."
    assert one(t.filename_part(F.lit("<b>Ünï</b> &  Co!"), 20)) == "n_co" and one(t.filename_part(F.lit("é"), 5)) == "untitled"
    assert one(t.dois(F.lit("10.1000/AB, (10.1000/ab) 10.12/x"))) == ["10.1000/ab"]
    assert one(t.title_key(F.lit(" <i>A</i> &amp; B "))) == "a & b"
    assert one(t.pdf_link(F.lit('<a href="/x.pdf">p</a>'))) == "/x.pdf"
    assert one(t.number_set(F.lit("5.2% of 7 and 7"))) == ["5.2", "7"] or one(t.number_set(F.lit("5.2% of 7 and 7"))) == ["5.2%", "7"]
    assert one(t.length_comparison(F.lit("a b"), F.lit("")))["label"] == "shorter" and one(t.length_comparison(F.lit(""), F.lit("a")))["label"] == "unknown"
    assert one(s.cell_score(F.lit("7"))) == (None, True) and one(s.cell_bool(F.lit(" Yes "))) is True


def test_quota_raises(spark):
    docs = spark.createDataFrame([(k, "en") for k in range(3)], "doc_id int, lang string")
    want = spark.createDataFrame([("en", 5)], "lang string, quota int")
    assert q.quota(docs, "lang", want, "doc_id", 1, "report").count() == 3
    with pytest.raises(Exception, match="fewer rows"):
        q.quota(docs, "lang", want, "doc_id", 1).collect()
    assert q.quota(docs, "lang", spark.createDataFrame([("en", 2)], "lang string, quota int"), "doc_id", 1).count() == 2


def test_dedup_is_idempotent(spark):
    rows = spark.createDataFrame([(k % 3, k, "v") for k in range(10)], "k int, seq int, v string")
    once = d.last_by(rows, ["k"], ["seq"])
    assert sorted(once.collect()) == sorted(d.last_by(once, ["k"], ["seq"]).collect()) and {r.seq for r in once.collect()} == {7, 8, 9}


def test_ledger_scan(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\n[1]\n{"a": "z"}\nnot json\n"s"\n{"a": 2, "v": "m-DRYRUN"}\n')
    path = str(tmp_path / "l.jsonl")
    assert sorted(str(r.a) for r in ledger.scan(spark, path, {"a": "int"}).collect()) == ["1", "2", "None"]
    assert ledger.rejects(spark, path, "x").count() == 3
    mock = s.mock_row(F.col("v"), F.lit(None).cast("string"))
    assert ledger.scan_facts(spark, path, None, {"a": "int", "v": "string"}, mock).count() == 2


def test_blocks_and_vendors(spark, tmp_path):
    (tmp_path / "a.txt").write_text("DOI: 10.1/x\nTitle:  T\nbody text\n---\nProvider: p\nmore")
    rows = ledger.scan_blocks(spark, str(tmp_path)).orderBy("place").collect()
    assert rows[0].fields == {"doi": "10.1/x", "title": "T"} and rows[0].body == "body text" and rows[1].fields == {"provider": "p"}
    (tmp_path / "r.jsonl").write_text('{"custom_id": "s__p", "response": {"body": {"choices": [{"message": {"content": "hi"}}], "usage": {"prompt_tokens": 3, "completion_tokens": 1}}}}\n{"custom_id": "f"}\n')
    got = ledger.vendor_results(ledger.scan_lines(spark, str(tmp_path / "r.jsonl")), "openai").orderBy("custom_id").collect()
    assert [(r.custom_id, r.text, r.tokens_in, r.status) for r in got] == [("f", None, None, "failed"), ("s__p", "hi", 3, "success")]


def test_vendors_count_all_input(spark, tmp_path):
    lines = [
        '{"custom_id": "a__x", "result": {"type": "succeeded", "message": {"content": [{"type": "text", "text": "one "}, {"type": "tool_use"}, {"type": "text", "text": "two"}], "usage": {"input_tokens": 10, "output_tokens": 3, "cache_read_input_tokens": 70, "cache_creation_input_tokens": 20}}}}',
        '{"custom_id": "b__x", "result": {"type": "errored", "message": {"content": [{"type": "text", "text": "lost"}]}}}',
    ]
    (tmp_path / "r.jsonl").write_text("\n".join(lines))
    got = ledger.vendor_results(ledger.scan_lines(spark, str(tmp_path / "r.jsonl")), "anthropic").orderBy("custom_id").collect()
    assert [(r.text, r.tokens_in, r.tokens_out, r.cache_read, r.cache_written, r.status) for r in got] == [("one two", 100, 3, 70, 20, "success"), (None, None, None, None, None, "failed")]
    (tmp_path / "g.jsonl").write_text('{"key": "k", "response": {"candidates": [{"content": {"parts": [{"text": "a"}, {"text": "b"}]}}], "usageMetadata": {"promptTokenCount": 5, "candidatesTokenCount": 2}}}')
    got = ledger.vendor_results(ledger.scan_lines(spark, str(tmp_path / "g.jsonl")), "gemini").collect()[0]
    assert (got.custom_id, got.text, got.tokens_in, got.tokens_out, got.status) == ("k", "ab", 5, 2, "success")


def test_replace_reads_its_own_target(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    ledger.replace(spark.read.parquet(path).union(spark.range(3, 5)), path)
    assert spark.read.parquet(path).count() == 5


def test_stream_merges_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"k": 1, "v": "a"}\n{"k": 1, "v": "a"}\n')
    rows = lambda: stream.follow(spark, str(tmp_path / "in"), "k int, v string")
    for text in ("", '{"k": 1, "v": "late"}\n{"k": 2, "v": "b"}\n'):
        if text:
            (tmp_path / "in" / "b.json").write_text(text)
        stream.merge_once(rows(), str(tmp_path / "ledger"), ["k"], str(tmp_path / "check")).awaitTermination()
    assert sorted((r.k, r.v) for r in spark.read.parquet(str(tmp_path / "ledger")).collect()) == [(1, "a"), (2, "b")]


def test_small_sources_and_sinks(spark, tmp_path):
    from pyspark.sql import functions as F

    (tmp_path / "keys" / "human2").mkdir(parents=True)
    (tmp_path / "keys" / "human2" / "key.json").write_text('{"items": {"item_1": "a", "item_2": "b"}}')
    assert sorted(map(tuple, ledger.scan_keys(spark, str(tmp_path / "keys")).collect())) == [("human2", "item_1", "a"), ("human2", "item_2", "b")]
    (tmp_path / "texts").mkdir()
    (tmp_path / "texts" / "a.txt").write_text("\n \n10.1234/AbC title\n10.9/x")
    (tmp_path / "texts" / "b.txt").write_text("nothing\n10.1234/late")
    assert [tuple(r) for r in ledger.scan_first_lines(spark, str(tmp_path / "texts"), r"10\.\d{4,9}/\S+").collect()] == [("a.txt", "10.1234/abc")]
    (tmp_path / "cache").mkdir()
    (tmp_path / "cache" / "s.json").write_text('{"doi": "1", "slug": "", "text": "one two", "word_count": 9}')
    assert [tuple(r) for r in ledger.scan_counts(ledger.scan_texts(spark, str(tmp_path / "cache"))).collect()] == [("s", 9, 7)]

    errors = spark.createDataFrame([(1, "no file")], "k int, m string")
    for stage in ("read", "join"):
        ledger.log_errors(errors, str(tmp_path / "errors"), stage, "k", "m", attempt=F.lit(2))
    assert sorted((r.stage, r.key, r.message, r.attempt) for r in spark.read.json(str(tmp_path / "errors")).collect()) == [("join", "1", "no file", 2), ("read", "1", "no file", 2)]
    assert len(ledger.write_report({"t": errors}, str(tmp_path / "r"), "20240101T000000Z")) == 2
    with pytest.raises(Exception, match="already exists"):
        ledger.write_report({"t": errors}, str(tmp_path / "r"), "20240101T000000Z")
    ledger.write_packets(spark.createDataFrame([("human1", 1), ("human2", 2)], "reviewer_id string, item int"), str(tmp_path / "p"))
    assert {x.name for x in (tmp_path / "p").iterdir() if x.is_dir()} == {"reviewer_id=human1", "reviewer_id=human2"}
    ledger.append(spark.createDataFrame([(1, False), (2, True), (3, None)], "k int, mock boolean"), str(tmp_path / "facts"), str(tmp_path / "mock"), F.col("mock"))
    assert sorted(r.k for r in spark.read.json(str(tmp_path / "facts")).collect()) == [1, 3] and [r.k for r in spark.read.json(str(tmp_path / "mock")).collect()] == [2]
    ledger.write_requests(spark.createDataFrame([("a", 1, "x")], "id string, n int, t string"), str(tmp_path / "q"), "id", ["n", "t"])
    assert spark.read.text(str(tmp_path / "q")).collect()[0][0] == '{"custom_id":"a","body":{"n":1,"t":"x"}}'
    (tmp_path / "sheets" / "human3").mkdir(parents=True)
    (tmp_path / "sheets" / "human3" / "s.csv").write_text("item_id,score\ni1,4\ni2,\n")
    assert [(r.item_id, r.score, r.reviewer_id) for r in ledger.scan_scoresheets(spark, str(tmp_path / "sheets"), ["item_id", "score"]).orderBy("item_id").collect()] == [("i1", "4", "human3"), ("i2", None, "human3")]


def test_jobs_are_merged_once(spark, tmp_path):
    from lumenfold.streaming.ledger import poll_once

    merged = []
    jobs = spark.createDataFrame([("a", 1), ("b", 2)], "job string, n int")
    poll = lambda rows: poll_once(rows, str(tmp_path / "marks"), "job", lambda x: merged.append(sorted(r.job for r in x.collect())))
    assert poll(jobs) == 2 and poll(jobs) == 0
    assert poll(jobs.union(spark.createDataFrame([("c", 3)], jobs.schema))) == 1 and merged == [["a", "b"], ["c"]]
