import numpy as np
import sentencepiece
from test_decontamination import brute
from test_dedup import brute_classes, brute_repeats

import corpus_pipeline as p
from lumenfold.llm import decontamination, piece_encoding, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    # an id on two rows, a null id and a null text beside the table's own
    extra = spark.createDataFrame([(None, "one two three", "en", "x", 13), (900_001, None, "en", "x", 0), (900_002, "four five six seven", "en", "x", 19), (900_002, "four five six seven", "en", "x", 19)], docs.schema)
    docs = docs.unionByName(extra)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    first = p.STAGES[0][1](spark, docs, SF)
    model = toxicity.fit_toxicity(docs, labels)
    rows = [tuple(r) for r in docs.collect()]
    keep = model.score([r[1] or "" for r in rows]) < 0.7
    want = sorted((r for r, k in zip(rows, keep) if k), key=str)
    assert sorted(map(tuple, first.collect()), key=str) == want and first.columns == list(p.COLUMNS)
    assert len(want) < len(rows)

    second = p.STAGES[1][1](spark, first, SF)
    kept = {i for i, _, _, k in brute_classes([r[:2] for r in want]) if k}
    want = sorted({r for r in want if r[0] in kept or r[0] is None}, key=str)
    assert sorted(map(tuple, second.collect()), key=str) == want and second.columns == list(p.COLUMNS)

    third = p.STAGES[2][1](spark, second, SF)
    got = sorted(map(tuple, third.collect()), key=str)
    repeats = {r[0]: x for r, x in zip(want, brute_repeats([(r[1] or "").encode() for r in want]))}
    assert third.columns == list(p.COLUMNS) and len(got) == len(want)
    for doc, text, _, _, n in got:
        size, gone, _, _ = repeats[doc]
        assert (text is None and n is None) or (n == len(text) and size - gone - 8 <= len(text.encode()) <= size - gone)

    fourth = p.STAGES[3][1](spark, third, SF)
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()
    hits = brute([(r[0], r[1]) for r in got], items)
    left = {r.doc_id: r for r in fourth.collect()}
    assert set(left) == {r[0] for r in got if not hits[r[0]][4]} and fourth.columns == list(p.COLUMNS)
    for doc, r in left.items():
        n_words, n_hit = hits[doc][:2]
        assert len(decontamination.words_of((r.text or "").encode())) == n_words - n_hit or n_hit == 0

    last = {r.doc_id: r for r in p.STAGES[4][1](spark, fourth, SF).collect()}
    lib = sentencepiece.SentencePieceProcessor(model_file=piece_encoding.model_path())
    assert set(last) == set(left)
    for doc, r in last.items():
        assert r.ids == lib.encode(left[doc].text or "") and r.text == (left[doc].text or "") and r.n_tokens == len(r.ids)


def test_run_joins_the_stages(spark):
    out = p.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids", "text"]
    rows = out.collect()
    assert 0 < len(rows) < 200 and len({r.doc_id for r in rows}) == len(rows)
    assert np.all([r.n_tokens == len(r.ids) for r in rows])


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in p.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
