"""Top-k search, fingerprints, components and URL filters against plain versions."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cairn.llm import graph, knn, simhash, urlfilter


def best(vectors, k, every):
    out = []
    for i, q in vectors:
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in vectors if j != i)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("hot", [False, True])
def test_top_k(spark, hot):
    draw = random.Random(3)
    centre = [[draw.randint(-50, 50) for _ in range(6)] for _ in range(5)]
    rows = [(i, [c + draw.randint(-4, 4) for c in centre[i % 5]]) for i in range(300)]
    if hot:  # a third of all rows are one vector; many ties
        rows = [(i, centre[0] if i % 3 == 0 else v) for i, v in rows]
    df = spark.createDataFrame(rows, "vec_id long, vec array<long>")
    got = knn.top_k(df, F.col("vec_id") % 10 == 0, k=5, n_pivots=12)
    assert sorted(map(tuple, got.collect())) == best(rows, 5, 10)


def test_top_k_blocks_and_groups(spark, monkeypatch):
    monkeypatch.setattr(knn, "GROUP", 4)
    monkeypatch.setattr(knn, "BLOCK", 40)
    draw = random.Random(4)
    rows = [(i, [draw.randint(-9, 9) for _ in range(4)]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, vec array<long>")
    assert sorted(map(tuple, knn.top_k(df, F.col("vec_id") % 5 == 0, k=3, n_pivots=16).collect())) == best(rows, 3, 5)


def test_top_k_odd_vectors(spark):
    rows = [(0, [0.5, 1.0], 7), (1, None, 7), (2, [float("nan"), 1.0], 7), (3, [None, 1.0], 7), (4, [float("inf"), 0.0], 7), (5, [0.25, -0.001], 7), (None, [1.0, 1.0], 7)]
    df = spark.createDataFrame(rows, "vec_id long, e array<float>, score int").withColumn("vec", knn.floored("e"))
    got = knn.top_k(df, F.col("vec_id") % 50 == 0, k=5).collect()
    assert [tuple(r) for r in got] == [(0, 1, 5, 128 * 64 + 256 * -1)]  # fewer than k; floor(-0.256) = -1
    assert knn.top_k(df.limit(0), F.col("vec_id") == 0, k=5).count() == 0
    assert knn.top_k(df.where("vec_id is null"), F.col("vec_id") == 0, k=5).count() == 0


def test_ragged_and_empty_vectors(spark):
    rows = [(0, [], 1), (1, [1, 2], 1), (2, [3, 4], 1), (50, [1, 1], 1), (100, [5], 1), (3, [9, 9, 9], 1), (4, [1, 2], 1)]
    df = spark.createDataFrame(rows, "vec_id long, vec array<long>, cell int").withColumns({"grp": F.lit("x"), "entry": F.lit("y"), "id": F.lit("z")})
    got = sorted(map(tuple, knn.top_k(df, F.col("vec_id") % 50 == 0, k=2).collect()))
    assert got == [(50, 1, 2, 7), (50, 2, 1, 3)]  # 4 ties with 1
    assert knn.top_k(df.where("vec_id in (0)"), F.col("vec_id") == 0, k=2).count() == 0
    assert knn.top_k(df, F.col("vec_id") == 77, k=2).count() == 0


def test_pruning(spark, monkeypatch):
    """Of clustered vectors, a row goes to few groups of queries, and the result is exact all the same."""
    monkeypatch.setattr(knn, "GROUP", 8)
    draw = np.random.default_rng(5)
    centre = draw.integers(-400, 400, (12, 8))
    rows = [(i, [int(x) for x in centre[i % 12] + draw.integers(-9, 10, 8)]) for i in range(720)]
    df = spark.createDataFrame(rows, "vec_id long, vec array<long>")
    is_query = F.col("vec_id") % 7 == 0
    data, queries, _, size = knn.prepared(df, is_query, 5)
    join = knn.Join(data, queries, size, 5, 40)
    groups = join._grouped().select("grp").distinct().count()
    assert groups > 8 and join.sent().count() < 0.5 * groups * data.count()
    assert sorted(map(tuple, knn.top_k(df, is_query, 5, n_pivots=40).collect())) == best(rows, 5, 7)


def test_components(spark):
    draw = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, j) for j in range(101, 160)] + [(draw.randint(200, 400), draw.randint(200, 400)) for _ in range(150)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def print_of(text, k=3):
    words = text.encode().lower().split()
    grams = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_fingerprints_and_components(spark):
    draw = random.Random(2)
    words = [f"w{i}é" for i in range(50)]
    base = [" ".join(draw.choices(words, k=60)) for _ in range(25)]
    rows = [(i, draw.choice(base), "x") for i in range(60)]
    rows += [(100 + i, t.replace(t.split()[30], "changed", 1), "x") for i, t in enumerate(base)]
    rows += [(200, None, "x"), (201, "", "x"), (202, " \t\n", "x"), (203, "One Word", "x"), (204, "one\vword", "x"), (205, "z " * 30000, "x"), (None, base[0], "x"), (60, rows[0][1], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash.simhash_components(docs).collect()
    prints = {i: print_of(t or "") for i, t, _ in rows if i is not None}
    for r in got:
        if r.doc_id is not None:
            assert r.fp[0] % 2**64 == prints[r.doc_id]
    component = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 3 and component[b] > component[a]:
                    component[b] = component[a]
                    changed = True
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == component
    assert len(got) == len(rows)
    assert simhash.simhash_components(docs.limit(0)).count() == 0


def test_trie_join_of_full_buckets(spark):
    draw = random.Random(8)
    centre = draw.getrandbits(64)
    prints = {centre} | {centre ^ sum(1 << b for b in draw.sample(range(64), n)) for n in (1, 2, 3, 4, 5, 6, 20) for _ in range(40)}
    prints = sorted(prints)
    df = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)], "rep long, fp long")
    want = list(range(len(prints)))
    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((want[a], want[b]))
                want = [x if w == y else w for w in want]
    for bucket_rows in (5, 100_000):  # dealt anew again and again, and not at all
        found = {r.node: r.component for r in graph.components(simhash.near_links(df, 3, bucket_rows)).collect()}
        assert [found.get(i, i) for i in range(len(prints))] == want


def test_deduplicated(spark):
    draw = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(draw.choices(words, k=200)) for _ in range(12)]
    near = [" ".join(t.split()[:100] + ["new"] + t.split()[101:]) for t in texts]
    rows = [(i, t) for i, t in enumerate(texts)] + [(50 + i, t) for i, t in enumerate(near)] + [(0, texts[0]), (0, texts[0]), (99, texts[3])]
    kept = simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == list(range(12))


def test_url_filter(spark):
    link = lambda to: f"<HTML><head><LINK href='{to}' rel=\"canonical\"></head>"
    refresh = lambda to: f'<meta http-equiv="Refresh" content="0; URL={to}">'
    rows = [
        (1, "http://A.example.org/x#top", link("http://blocked.net/es/1")),  # an alias of a blocked page
        (2, "http://b.example.org/y", refresh("/x2")), (3, "http://b.example.org/x2", link("//c.example.org/z")), (4, "https://c.example.org/z?", None),
        (5, "http://d.example.org/", link("http://blocked.net/fr/2")), (6, "http://e.org/", link("http://d.example.org/")), (7, "http://fine.com/", link("http://e.org/")),  # an allowed one among them
        (8, None, ""), (9, "no host", "<link rel=canonical href=http://blocked.net/es/1>"), (10, "http://www.example.com/en/q", None), (11, "http://x.example.com/en/q", None), (12, "http://example.com/de/", None), (13, "http://com", None),
    ]
    rules = [urlfilter.Rule("allow", "com"), urlfilter.Rule("block", "example.com", "/en/"), urlfilter.Rule("allow", "www.example.com", "/en/"), urlfilter.Rule("block", "net", "/es/"), urlfilter.Rule("block", "net", "/fr/")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.verdict, r.rule) for r in urlfilter.judge(pages, rules).collect()}
    assert got[1] == ("block", None) and got[2][0] == got[3][0] == "allow"
    assert got[5] == got[6] == ("allow", None) and got[7] == ("allow", "com/")
    assert got[8] == got[9] == ("allow", None)
    assert got[10] == ("allow", "www.example.com/en/") and got[11] == ("block", "example.com/en/") and got[12] == ("allow", "com/") and got[13] == ("allow", None)
    table = spark.createDataFrame([(r.verdict, r.host, r.path) for r in rules] + [("block", "com", "/")], "verdict string, host string, path string")
    assert {r.page_id: (r.verdict, r.rule) for r in urlfilter.judge(pages, table).collect()} == got
    more = spark.createDataFrame([("http://c.example.org/z?", "http://blocked.net/es/9")], "a string, b string")
    got = {r.page_id: r.verdict for r in urlfilter.judge(pages, rules, more).collect()}
    assert got[2] == "allow" and got[4] == "block"
    assert urlfilter.judge(pages.limit(0), rules).count() == 0
    row = urlfilter.judge(spark.createDataFrame([("x", "http://H.com/p?q#f", "")], "verdict string, url string, html string"), rules).first()
    assert (row.host, row.path, row.verdict) == ("h.com", "/p", "allow")


def test_url_filter_columns(spark):
    pages = spark.createDataFrame([(1, "http://blocked.net/es/x", None), (1, "http://blocked.net/es/x", None), (2, "", "")], "page_id long, url string, html string")
    pages = pages.withColumns({c: F.lit("kept") for c in ("_node", "node_of", "_match", "match_of", "_carried", "carried_of", "address_of", "component", "node")})
    got = urlfilter.judge(pages, [urlfilter.Rule("block", "net", "/es/")]).collect()
    assert [(r.verdict, r.node_of, r._node, r.component) for r in sorted(got, key=lambda r: r.page_id)] == [("block", "kept", "kept", "kept")] * 2 + [("allow", "kept", "kept", "kept")]


def test_majority_of_long_texts():
    h = np.random.default_rng(0).integers(0, 2**63, 200_000, dtype=np.int64).view(np.uint64)
    want = sum(1 << b for b in range(64) if int(((h >> np.uint64(b)) & np.uint64(1)).sum()) * 2 > len(h))
    assert simhash.majority_bits(h, block=1000) == want


def test_large_components_and_hot_cells(spark, monkeypatch):
    """Components whose squares don't fit a long, and all queries in one cell, solved in parts of a bounded size."""
    rows = [(0, [2e7, 1.0], 1), (50, [1.0, 1e30], 1), (1, [1.0, 0.5], 1), (2, [-1e30, 2.0], 1), (3, [0.25, 0.25], 1)]
    df = spark.createDataFrame(rows, "vec_id long, e array<double>, x int").withColumn("vec", knn.floored("e"))
    got = {(r.query_id, r.vec_id): r.score for r in knn.top_k(df, F.col("vec_id") % 50 == 0, k=5).collect()}
    assert got[0, 1] == 256 * 256 * 2 * 10**7 + 256 * 128 and got[0, 50] == 2**63 - 1 and got[50, 3] > 0 and len(got) == 8
    monkeypatch.setattr(knn, "GROUP", 8)
    monkeypatch.setattr(knn, "BLOCK", 30)
    draw, seen = random.Random(6), []
    rows = [(i, [1000 + draw.randint(-3, 3) for _ in range(3)]) for i in range(200)]
    solved = knn._solved
    monkeypatch.setattr(knn, "_solved", lambda data, asks, *a: (seen.extend(r.n for x in (data, asks) for r in x.groupBy("grp", "block", "part").agg(F.count("*").alias("n")).collect()), solved(data, asks, *a))[1])
    df = spark.createDataFrame(rows, "vec_id long, vec array<long>")
    assert sorted(map(tuple, knn.top_k(df, F.col("vec_id") % 2 == 0, k=3, n_pivots=1).collect())) == best(rows, 3, 2)
    assert max(seen) < 60  # twice a block, as blocks are cut by a hash
