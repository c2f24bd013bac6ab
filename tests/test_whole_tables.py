"""Registered queries over whole tables, whatever part of them their SQL reads."""

import pytest
from oracle import compare

from lumenfold.operators import aggregate as a
from lumenfold.operators import dedup as d
from lumenfold.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


def whole(spark, name, part):
    """What differs from the query's SQL without its filter."""
    return compare(QUERIES[name](spark, SF), ORACLE_SQL[name].replace(part, ""), SF)


def test_covariate_grid(spark):
    assert whole(spark, "covariate_grid", " WHERE item % 40 < 3") == ""


@pytest.mark.parametrize("bound", [10_000, 20_000])
def test_grid_of_many_labels(spark, bound, monkeypatch):
    monkeypatch.setattr(a, "BROADCAST_LABELS", bound, raising=False)
    cells = spark.range(10_050).selectExpr("'x' AS r", "id AS c", "id AS n").union(spark.sql("SELECT 'y', 7L, 1L"))
    got = {(r.r, r.c): r.n for r in a.full_grid(cells, "r", "c").collect()}
    assert got == {("x", k): k for k in range(10_050)} | {("y", k): 1 if k == 7 else None for k in range(10_050)}


def test_jury_scores(spark):
    assert whole(spark, "jury_scores", " WHERE item % 5 = 0") == ""


def test_bh_adjust(spark):
    assert whole(spark, "bh_adjust", " WHERE p_partkey < 400") == ""


def test_fallback_lookup(spark, tmp_path):
    docs = [(1, "de"), (2, "de"), (150, "de"), (200, "fr"), (201, "fr"), (202, "fr"), (300, "en")]
    spark.createDataFrame(docs, "doc_id long, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (150, 0, 0), (200, 1, 0), (201, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r.quality for r in QUERIES["fallback_lookup"](spark, str(tmp_path)).collect()}
    assert got == {1: 1, 2: 0, 150: 0, 200: 1, 201: 1, 202: 1, 300: None}
    assert whole(spark, "fallback_lookup", " WHERE doc_id < 100") == ""


def test_manifest_first_wins(spark):
    assert whole(spark, "manifest_first_wins", " WHERE c_nationkey % 2 = 0") == ""


def test_unique_title_match(spark):
    assert whole(spark, "unique_title_match", " WHERE c_acctbal > 9800") == ""


def test_missing_keys_and_single_matches(spark):
    """What the filters had shaped: keys of one table only, keys that match once, often or not at all."""
    first, second = spark.createDataFrame([(0, "a", 2), (0, "b", 1)], "k int, name string, seq int"), spark.createDataFrame([(0, "c", 0), (1, "d", 5)], "k int, name string, seq int")
    assert sorted((r.k, r.name) for r in d.union_first_wins([first, second], ["k"], ["seq"]).collect()) == [(0, "b"), (1, "d")]
    rows, target = spark.createDataFrame([(0,), (1,), (2,)], "k int"), spark.createDataFrame([(0, 7), (1, 8), (1, 9)], "k int, v int")
    assert sorted((r.k, r.matches, r.v) for r in d.unique_match(rows, target, "k", "v").collect()) == [(0, 1, 7), (1, 2, None), (2, 0, None)]
