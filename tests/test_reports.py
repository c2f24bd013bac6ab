"""Report and corpus operators on small tables, against values worked out by hand."""

import pytest

from lumenfold.operators import corpus as c
from lumenfold.operators import reports as r
from lumenfold.operators import sampling as q
from lumenfold.operators import statistics as st


def test_duplicates_are_averaged_before_alpha(spark):
    rows = [("x", 1, "a", 1.0), ("x", 1, "a", 3.0), ("x", 1, "b", 2.0), ("x", 2, "a", 4.0), ("x", 2, "b", 4.0), ("y", 1, "a", 5.0), ("z", 1, "a", 1.0), ("z", 2, "b", 1.0)]
    got = {x.g: x for x in r.reliability(spark.createDataFrame(rows, "g string, u int, j string, v double"), ["g"], ["u"], "j", "v").collect()}
    assert (got["x"].alpha, got["x"].n_comparable, got["x"].n_judges) == (1.0, 2, 2)  # 2 and 2, 4 and 4
    assert got["x"].variance == pytest.approx(1.36) and got["x"].verdict == "underpowered"
    assert not got["y"].available and got["y"].mean is None  # one judge
    assert got["z"].n_judges == 2 and not got["z"].available and got["z"].verdict == "unavailable"  # no shared unit


def test_kappas_by_group(spark):
    rows = [("p", 1, 2), ("p", 2, 2), ("p", 3, 1), ("p", 1, 1), ("q", 4, 4), ("q", 4, 4), ("q", None, 4)]
    table = spark.createDataFrame(rows, "g string, a int, b int")

    def brute(pairs, weight):
        n = len(pairs)
        o = sum(weight(a, b) for a, b in pairs) / n
        e = sum(weight(a, b) for a, _ in pairs for _, b in pairs) / n**2
        return 1.0 if e == 0 else 1 - o / e

    pairs = [x[1:] for x in rows if x[0] == "p"]
    for name, weight in ((None, lambda a, b: a != b), ("linear", lambda a, b: abs(a - b)), ("quadratic", lambda a, b: (a - b) ** 2)):
        got = {x.g: x for x in st.cohen_kappa(table, "a", "b", name, by=["g"]).collect()}
        assert got["p"].kappa == pytest.approx(brute(pairs, weight)) and got["p"].n == 4
        assert got["q"].kappa == 1.0 and got["q"].undefined and got["q"].n == 2
        assert st.cohen_kappa(table.where("g = 'p'"), "a", "b", name).collect()[0].kappa == pytest.approx(brute(pairs, weight))


def test_pairs_without_a_difference_are_not_tested(spark):
    rows = [(k, p, v) for k in range(12) for p, v in (("a", 1.0 + k), ("b", 1.0 + k), ("c", 2.0 * k))] + [(99, "a", None)]
    got = {(x.provider_a, x.provider_b): x for x in r.pairwise_significance(spark.createDataFrame(rows, "i int, p string, v double"), ["i"], "p", "v").collect()}
    assert got["a", "b"].n_shared == 12 and not got["a", "b"].available and got["a", "b"].p_adjusted is None and got["a", "b"].mean_diff == 0
    assert got["a", "c"].available and not got["a", "c"].underpowered and got["a", "c"].n == 11 and got["a", "c"].p_adjusted == round(got["a", "c"].p, 4)


def test_places_share_ties(spark):
    got = {x.p: (x.place, x.top) for x in r.placed(spark.createDataFrame([("a", 3.0), ("b", 3.0), ("c", 1.0), ("d", None)], "p string, v double"), "v").collect()}
    assert got == {"a": (1, True), "b": (1, True), "c": (3, False), "d": (4, False)}


def test_places_read_each_value_once(spark):
    import random

    from pyspark.sql import functions as F

    noisy = F.udf(lambda k: k + random.random() * 1e-9, "double").asNondeterministic()  # as sums of doubles in another order
    report = spark.range(12).select("id", noisy("id").alias("v"))
    assert {x.id: (x.place, x.top) for x in r.placed(report, "v").collect()} == {k: (12 - k, k == 11) for k in range(12)}


def test_leaderboard_has_the_places_of_its_means(spark):
    import random

    from pyspark.sql import functions as F

    noisy = F.udf(lambda k: k + random.random() * 1e-9, "double").asNondeterministic()
    compared = r.placed(spark.range(12).select(F.col("id").alias("provider"), noisy("id").alias("v")), "v")
    reliable = spark.createDataFrame([(3, 0.5, "weak")], "provider long, alpha double, verdict string")
    human = spark.createDataFrame([(4, 7, 0.5)], "provider long, n long, spearman double")
    got = {x.provider: (x.place, x.top, x.alpha, x.n_human) for x in r.leaderboard(compared, reliable, human).collect()}
    assert got == {k: (12 - k, k == 11, 0.5 if k == 3 else None, 7 if k == 4 else 0) for k in range(12)}


def test_limit_counts_papers_with_a_text(spark):
    papers = spark.createDataFrame([(1, 1, "x"), (2, 2, ""), (3, 3, None), (None, 0, "x")], "doi int, seq int, label string")
    manifest = spark.createDataFrame([(2, "m")], "doi int, label string")
    texts = spark.createDataFrame([(1, None), (2, "two"), (3, "three")], "doi int, reference string")
    slots = spark.createDataFrame([(2, "a", "failed", "s"), (2, "b", "success", ""), (3, "a", "success", "s"), (3, "b", None, "s")], "doi int, provider string, status string, summary string")
    made = lambda **o: sorted((x.doi, x.label, x.provider) for x in c.evaluation_instances(papers, manifest, texts, slots, "doi", "seq", ["label"], **o).collect())
    assert made() == [(3, "unknown", "a")] and made(limit=1) == []  # paper 2 counts though none of its slots is usable
    assert made(lenient=True) == [(3, "unknown", "a"), (3, "unknown", "b")]


def test_carried_keys_are_those_still_there(spark):
    pool = spark.createDataFrame([("j", k) for k in range(2, 9)], "s string, k int")
    previous = spark.createDataFrame([("j", k, k) for k in range(5)], "s string, k int, i int")
    made = lambda n, **o: sorted((x.k, x.carried) for x in q.carried_overlap(pool, previous, "s", "k", "i", n, 0.5, 1, **o).collect())
    got = made(5)
    assert [k for k, old in got if old] == [2, 3] and len(got) == 5  # half of 5 is 2: to even; 0 and 1 are gone
    assert len(made(9)) == 7 and made(9, on_shortfall="backfill") == got[:0] + made(9, on_shortfall="backfill")
    with pytest.raises(Exception, match="too few"):
        made(9, on_shortfall="error")
    with pytest.raises(ValueError):
        made(9, on_shortfall="other")


def test_guard_and_repair(spark):
    c.refuse_if_any(spark.range(0), "open jobs")
    with pytest.raises(RuntimeError, match="open jobs"):
        c.refuse_if_any(spark.range(1), "open jobs")
    from pyspark.sql import functions as F

    row = spark.range(1).select(c.repaired_summary({"headline": F.lit("H"), "key_findings": F.array(*map(F.lit, "abcdefg"))}).alias("s")).select("s.*", c.readable_summary(F.col("s")).alias("shown")).collect()[0]
    assert row.summary_text == "Results: a b c d e f g" and row.objective == "Not reported" and row.limitations == []
    assert "Results\n- a\n- b\n- c\n- d\n- e\n\nLimitations\nNot reported" in row.shown


def test_blocks_do_not_depend_on_the_order_of_rows(spark):
    from pyspark.sql import functions as F

    from lumenfold.operators import prefix

    rows = spark.range(100_000).select((F.col("id") % 2).alias("g"), (F.xxhash64("id") / 1e12).alias("v"))
    one = prefix.in_blocks(rows.repartition(3, "v"), ["g"], "v")
    two = prefix.in_blocks(rows.repartition(8, "v").sortWithinPartitions("v"), ["g"], "v")
    blocks = lambda df: {(x.g, x["__block"]): (x.n, x.low) for x in df.groupBy("g", F.col("__block")).agg(F.count("*").alias("n"), F.min("v").alias("low")).collect()}
    got = blocks(one)
    assert got == blocks(two) and len(got) >= prefix.BLOCKS
    assert max(n for n, _ in got.values()) < 3 * 50_000 / prefix.BLOCKS


def test_running_totals_across_blocks(spark, monkeypatch):
    from lumenfold.operators import prefix

    monkeypatch.setattr(prefix, "BLOCKS", 7)
    rows = [(g, k, float(k % 5)) for g in ("a", None) for k in range(300)] + [("b", 1, None)]
    got = sorted(((x.g or "", x.k, x.spent, x.over, x.stops) for x in q.running_total(spark.createDataFrame(rows, "g string, k int, v double"), ["g"], ["k"], "v", 100.0).collect()), key=str)
    want = []
    for g in ("a", None):
        total = 0.0
        for k in range(300):
            before, total = total, total + k % 5
            want.append((g or "", k, total, total > 100, total > 100 >= before))
    assert [x for x in got if x[0] != "b"] == sorted(want, key=str) and [x for x in got if x[0] == "b"][0][2] is None


def test_ranks_across_blocks(spark, monkeypatch):
    from lumenfold.operators import prefix

    monkeypatch.setattr(prefix, "BLOCKS", 5)
    rows = [(k % 3 or None, float(k * 37 % 50)) for k in range(200)]
    got = sorted(((x.g or 0, x.v, x.r) for x in st.average_rank(spark.createDataFrame(rows, "g int, v double"), ["g"], "v", "r").collect()))
    want = []
    for g, v in rows:
        own = [y for h, y in rows if h == g]
        want.append((g or 0, v, sum(y < v for y in own) + (sum(y == v for y in own) + 1) / 2))
    assert got == sorted(want)


def test_settings_and_guards(tmp_path):
    from lumenfold.functions import guards as g

    assert g.first_setting({"A": " ", "B": "x"}, ["A", "B"], "z") == "x" and g.first_setting({}, ["A"], "z") == "z"
    assert g.prices_of((1.0, 2.0), (3.0, 4.0), "premium") == (3.0, 4.0) and g.prices_of((1.0,), (1.0,), "regular") == (1.0,)
    with pytest.raises(ValueError, match="premium"):
        g.prices_of((1.0,), (1.0,), "premium")
    good = {"version": "v", "score_range": {"min": 1, "max": 5}, "dimensions": {"a": {"description": "d", "anchors": dict.fromkeys(range(1, 6), "x")}}}
    g.checked_rubric(good, "v", ("a",))
    for bad in ({"version": "w"}, {"score_range": {"min": 0, "max": 5}}, {"dimensions": {"b": {}}}, {"dimensions": {"a": {"description": "d", "anchors": {1: "x"}}}}):
        with pytest.raises(ValueError):
            g.checked_rubric(good | bad, "v", ("a",))
    g.authorised(1.0, "judging")
    g.authorised(0.0, "judging", rehearsal=True)
    with pytest.raises(RuntimeError):
        g.authorised(0.0, "judging")
    assert g.same_file(None, "x") and g.same_file(f"{tmp_path}/a/../b", f"{tmp_path}/b") and not g.same_file("a", "b")
    with pytest.raises(ValueError):
        g.prompt_segments("{CANDIDATE_SUMMARY}{REFERENCE_TEXT}", None, None)
