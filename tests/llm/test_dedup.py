import hashlib
import random

import numpy as np
import pytest

from lumenfold.llm import near_dedup as n
from lumenfold.llm import suffix_dedup as s
from lumenfold.llm.queries import op2_suffix_dedup, op5_near_dedup

SF = "/root/testdata/sf0.01"


def brute_repeats(texts, length=400):
    seen = {}
    for k, t in enumerate(texts):
        for i in range(len(t) - length + 1):
            key = hash(t[i : i + length])
            seen[key] = -1 if key in seen else (k, i)
    out = []
    for k, t in enumerate(texts):
        mask = np.zeros(len(t) + 1, np.int32)
        for i in range(len(t) - length + 1):
            if seen[hash(t[i : i + length])] == -1:
                mask[i] += 1
                mask[min(i + length, len(t))] -= 1
        gone = np.cumsum(mask)[: len(t)] > 0
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1))
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def test_suffix_query_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in rows], brute_repeats([(r.text or "").encode() for r in rows])))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op2_suffix_dedup(spark, SF).collect()}
    assert got == want
    assert any(0 < x[1] < x[0] for x in want.values())


@pytest.mark.parametrize("broadcast", [True, False])
def test_suffix_edge_cases(spark, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(s, "BROADCAST_BYTES", -1)
        monkeypatch.setattr(s, "HOT", 2)
    rng = random.Random(8)
    noise = lambda k: "".join(rng.choices("abcdefgh é", k=k))
    shared = noise(900)
    texts = [None, "", "short", "a" * 1500, "ab" * 700, noise(3000), shared, shared, noise(300) + shared[100:700] + noise(300), noise(50) + shared[:399].encode()[:399].decode("utf-8", "ignore")]
    texts += [noise(500) + shared[250:660], shared[500:] + shared[:450], noise(100) + texts[5][1000:1380] + noise(20) + texts[5][1000:1500], ("line of text\n" * 80), noise(60_000)]
    for _ in range(12):  # windows that reach little beyond a repeat, at every offset
        a = rng.randrange(400)
        texts.append(noise(rng.randrange(40)) + shared[a : a + rng.randrange(360, 480)] + noise(rng.randrange(40)))
    rows = [(k if k != 2 else None, t, "x", 3) for k, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "doc_id long, text string, t string, n_bytes int")
    got = s.remove_repeats(table).collect()
    want = brute_repeats([(t or "").encode() for t in texts])
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(want)
    assert {r.kept_text for r in got if r.text is None} == {None}
    assert s.remove_repeats(table.limit(0)).count() == 0
    with pytest.raises(ValueError):
        s.find_repeats(table, length=100)


def test_suffix_runs_of_unequal_length(spark):
    """A header and a footer in common around rows that repeat n or n + 1 times: ends agree, lengths do not."""
    rng = random.Random(5)
    noise = lambda k: "".join(rng.choices("abcdefgh é", k=k))
    texts = []
    for n in range(5, 25):
        header, row, footer = noise(150), noise(20), noise(150)
        texts += [noise(200) + header + row * k + footer + noise(200) for k in (n, n + 1)]
    table = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in s.remove_repeats(table).collect()}
    assert got == dict(enumerate(brute_repeats([t.encode() for t in texts])))


def shingles(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\x0b", " ")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", words) if w]
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute_classes(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    by = {}
    for k, (i, x) in enumerate(sets):
        if i is not None:
            for g in x:
                by.setdefault(g, []).append(k)
    parent = list(range(len(sets)))

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    done = set()
    for members in by.values():
        for p, a in enumerate(members):
            for b in members[p + 1 :]:
                if top(a) != top(b) and (a, b) not in done:
                    done.add((a, b))
                    x, y = sets[a][1], sets[b][1]
                    if 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)) and 100 * len(x & y) >= 75 * len(x | y):
                        parent[top(b)] = top(a)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[top(k)] = min(least.get(top(k), i), i)
    return [(i, len(x), least.get(top(k)), i is not None and least[top(k)] == i) for k, (i, x) in enumerate(sets)]


def test_near_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in op5_near_dedup(spark, SF).collect()]
    assert sorted(got) == sorted(brute_classes(rows))
    assert any(not r[3] for r in got)


@pytest.mark.parametrize("broadcast, rounds, wide", [(True, 4, 512), (False, 1, 512), (True, 0, 40)])
def test_near_edge_cases(spark, broadcast, rounds, wide, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(n, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(n, "ROUNDS", rounds)
    monkeypatch.setattr(n, "WIDE", wide)
    monkeypatch.setattr(n, "COMMON", 4)
    monkeypatch.setattr(n, "BLOCK", 5)
    monkeypatch.setattr(n, "CHUNK", 2)
    rng = random.Random(3)
    words = [f"w{k}" for k in range(4000)]
    passage = rng.choices(words, k=80)
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "One  TWO"), (None, "one two"), (6, "one two three four"), (4, "another text altogether it is"), (7, "a b c d e"), (8, "a b c d e")]
    at = 100
    for size in (0, 5, 12, 30):  # documents that are mostly a passage which all share
        for _ in range(12):
            rows.append((at, " ".join([*passage, *rng.choices(words, k=size)])))
            at += 1
    base = rng.choices(words, k=120)
    for _ in range(40):  # a large group of near copies
        copy = list(base)
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(120)] = rng.choice(words)
        rows.append((at, " ".join(copy)))
        at += 1
    chain = rng.choices(words, k=60)
    for _ in range(10):  # a chain: neighbours are similar, ends are not
        chain = chain[4:] + rng.choices(words, k=4)
        rows.append((at, " ".join(chain)))
        at += 1
    rows.append((at, "x " * 50_000))
    rng.shuffle(rows)
    table = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, n int, s string")
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in n.near_duplicates(table).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(brute_classes(rows), key=key)
    if broadcast:
        assert n.near_duplicates(table.limit(0)).count() == 0
