import math

import numpy as np

from lumenfold.llm import url_filter as u
from lumenfold.llm import vector_search as v
from lumenfold.llm.queries import op3_url_filter, op9_vector_search

SF = "/root/testdata/sf0.01"


def brute(rows, k=20, every=20):
    usable = [(i, [math.floor(64 * float(np.float32(x))) for x in e]) for i, e in rows if i is not None and e and all(x is not None and math.isfinite(x) for x in e)]
    out = {}
    for q, a in usable:
        if q % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in usable if i != q and len(a) == len(b))
            out[q] = [(i, -s) for s, i in scores[:k]]
    return {(q, r + 1, *x) for q, best in out.items() for r, x in enumerate(best)}


def test_search_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert {tuple(r) for r in op9_vector_search(spark, SF).select("query_id", "rank", "vec_id", "score").collect()} == brute(rows)


def test_search_edge_cases(spark):
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(size=8).tolist()) for k in range(60)]
    rows += [(100 + k, rows[0][1]) for k in range(30)]  # ties
    rows += [(200, None), (201, [None] * 8), (220, [float("nan")] * 8), (221, [float("inf")] * 8), (240, []), (None, rows[1][1]), (260, [1.0, 2.0]), (261, [3.0, 1.0]), (280, [1e7] * 8)]
    table = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<float>, score int")
    for options in ({}, {"block": 2, "first": 30, "chunk": 7}, {"block": 1, "group": 2, "first": 0}):
        got = {tuple(r) for r in v.top_k(table.repartition(3), **options).collect()}
        assert got == brute(rows)
    assert v.top_k(table.limit(0)).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(1)
    a, b = np.floor(rng.normal(size=(20, 64)) * 20), np.floor(rng.normal(size=(30, 64)) * 20)
    for n in v.levels_of(64):
        x, y = v.Statistics(a, [n]), v.Statistics(b, [n])
        bound = (x.parts[n] @ y.parts[n].T + v.slack(n)) * np.outer(x.norm, y.norm)
        assert (bound >= a @ b.T).all()


def test_no_neighbour_is_ruled_out_where_segments_cancel():
    rng = np.random.default_rng(3)
    for _ in range(200):
        size = 10 ** rng.uniform(4, 7)
        q, x = (np.round(np.repeat(rng.choice([-1, 1], 16), 4) * size + rng.normal(size=64) * size / 100) for _ in range(2))
        block = v.Block(np.array([0]), q[None])
        assert block.survivors(x[None], v.products(q[None], x[None])[0].astype(float)).all()


def test_bounds_of_very_large_components():
    for size in (1e20, 1e30, 1e200):
        q, x = np.full((1, 8), size), np.full((2, 8), size)
        x[1] = -size
        assert v.Block(np.array([0]), q).survivors(x, np.array([1.0]))[0, 0]


def rule_of(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    end = min([k for k in map(rest.find, "/?#") if k >= 0] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    path = path[: min([k for k in map(path.find, "?#") if k >= 0] or [len(path)])]
    held = [(len(h + p), h + p, w) for w, h, p in u.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(held, default=(0, None, None))
    return host, path, best[1], best[2]


def test_url_query_against_brute_force(spark):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = op3_url_filter(spark, SF).collect()
    assert len(rows) == len(urls) and {r.verdict for r in rows} == {"allow", "block"}
    for r in rows:
        host, path, rule, verdict = rule_of(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and (verdict is None or r.verdict == verdict)


def test_url_edge_cases(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.COM/en/x?q#f", "http://example.com", "http://example.com?/en/", "x://www.example.com/en/", "x://notexample.com/en/", "a://b://c.net/fr/", "http://ÉX.com/é", "http://net/es/?a=1&b=2", "http://h/" + "p/" * 50_000, "http://a.com/\n/x"]
    table = spark.createDataFrame([(k % 9, x, "h") for k, x in enumerate(urls)], "page_id long, url string, host string")
    got = u.filter_urls(table).collect()
    assert sorted((r.host, r.path, str(r.rule)) for r in got) == sorted((a, b, str(c)) for a, b, c, _ in map(rule_of, urls))
    assert u.filter_urls(table.limit(0)).count() == 0


def test_trees_learn():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(800, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.5)).astype(float)
    model = u.fit_trees(x[:600], y[:600])
    assert ((model.margin(x[600:]) > 0) == y[600:]).mean() > 0.9
    assert u.fit_trees(x, np.zeros(800)).trees == [] and u.fit_trees(x[:0], y[:0]).trees == []
