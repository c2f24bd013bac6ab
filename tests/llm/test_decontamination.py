import hashlib
import random
import re

import pytest

from lumenfold.llm import decontamination as d
from lumenfold.llm.queries import op1_decontamination

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=13):
    windows = {}
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + window]), set()).add(str(item))
    sizes = {len(x) for x in windows}
    out = {}
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    found |= windows[x]
                    hit |= set(range(k, k + n))
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()
    want = brute(docs, items)
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in op1_decontamination(spark, SF).collect()}
    assert got == want
    assert any(x[4] for x in want.values())


def test_edge_cases_and_blocks(spark):
    phrase = " ".join(f"w{k}" for k in range(20))
    docs = [(1, None), (2, ""), (3, "!!!"), (4, phrase), (4, phrase), (None, phrase.upper() + " x"), (5, "alpha beta"), (6, ("Alpha, BETA; " * 400)), (7, "w1 " * 30)]
    items = [(1, phrase), (2, None), (3, "..."), (4, "alpha beta"), (4, "alpha beta"), (5, phrase), (None, "x")]
    left = spark.createDataFrame([(*x, 1, "z") for x in docs], "doc_id long, text string, n_words int, spans string")
    right = spark.createDataFrame([(*x, "q") for x in items], "item_id long, text string, contaminated string")
    whole = d.find_contamination(left, right)
    blocks = d.find_contamination(left, right, block_bytes=1, shard_bytes=8)
    rows = sorted(map(str, whole.collect()))
    assert rows == sorted(map(str, blocks.collect())) and len(rows) == len(docs)
    want = brute(docs, [x for x in items if x[0] is not None])
    for r in whole.collect():
        assert (r.n_words, r.n_hit, r.contaminated) == (want[r.doc_id][0], want[r.doc_id][1], want[r.doc_id][4])
    assert d.find_contamination(left.limit(0), right).count() == 0
    assert all(r.n_hit == 0 for r in d.find_contamination(left, right.limit(0)).collect())
    kept = {r.doc_id: r.text for r in d.remove_spans(whole).collect()}
    assert set(kept) == {1, 2, 3, 7}
    assert d.cut_words("a, b! c d.", [(1, 3)]) == "a,  d."


@pytest.mark.parametrize("n", [1, 2, 50, 400])
def test_index(n):
    import numpy as np

    rng = np.random.default_rng(n)
    text = np.append(rng.integers(1, 4, n), 0)
    order = d.suffix_array(text)
    assert order.tolist() == sorted(range(n + 1), key=lambda k: text[k:].tolist())
    index = d.FMIndex(text, 4, sample=5)
    for length in (1, 2, 5):
        pattern = rng.integers(1, 4, (1, length))
        lo, hi = index.search(pattern, np.array([length]))
        found = sorted(index.locate(np.arange(lo[0], hi[0])).tolist())
        assert found == [k for k in range(n) if text[k : k + length].tolist() == pattern[0].tolist()]


def test_carried_columns_with_clashing_names_and_many_blocks(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(300)]
    items = [(str(k), " ".join(rng.choices(words, k=rng.randint(3, 30)))) for k in range(30)]
    docs = [(k, " ".join([*rng.choices(words, k=20), items[k % 30][1], *rng.choices(words, k=20)]), "s", 5, k) for k in range(40)]
    table = spark.createDataFrame(docs, "doc_id long, text string, spans string, n_words int, other int")
    bench = spark.createDataFrame(items, "item_id string, text string")
    whole = d.find_contamination(table, bench, carry=("spans", "n_words", "other")).collect()
    assert all(r.carried_spans == "s" and r.carried_n_words == 5 and r.other == r.doc_id for r in whole)
    parts = d.find_contamination(table, bench, block_bytes=200).collect()  # more blocks than a pass takes
    one = lambda rows: sorted((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids), r.contaminated) for r in rows)
    assert one(parts) == one(whole) and sum(r.n_hit > 0 for r in whole) == 40
