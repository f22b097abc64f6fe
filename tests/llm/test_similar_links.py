"""Near duplicates are those of shared distinct shingles, not of fingerprints alone."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cairn.llm import simhash


def kept(spark, rows):
    return sorted(r.doc_id for r in simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_repeated_lines_do_not_decide(spark):
    draw = random.Random(3)
    text = lambda n: " ".join(f"w{draw.randrange(5000)}" for _ in range(n))
    line, other, long = text(10), text(10), text(200)
    rows = [(1, text(100) + f" {line}" * 20), (2, text(100) + f" {line}" * 20), (3, long), (4, long + f" {other}" * 100)]
    assert kept(spark, rows) == [1, 2, 3]


def test_links_are_checked(spark):
    """Pairs of equal fingerprints, by a budget of all bits: only the similarity parts them, and no star hides a link."""
    draw = random.Random(4)
    words = lambda n: [f"w{draw.randrange(5000)}" for _ in range(n)]
    base = [words(60) for _ in range(8)]
    texts = [b[: len(b) - k] for b in base for k in (0, 5, 10)] + [words(60) for _ in range(5)]
    draw.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(90, ""), (91, None), (92, "one two"), (93, "two one")]
    sets = {i: {tuple((t or "").split()[k : k + 5]) for k in range(max(1, len((t or "").split()) - 4))} for i, t in rows}
    want = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    want[a] = want[b] = min(want[a], want[b])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.simhash_components(docs, shingle=5, words=4, budget=256, bands=1, band_bits=0, similarity=0.8).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert simhash.deduplicated(docs.limit(0)).count() == 0


def test_hot_buckets_are_cut(spark):
    """Blocks stay small, and rows of different labels of a hot bucket still meet."""
    rows = [(1, i, 7 if i < 30 else i) for i in range(45)] + [(2, 100 + i, i) for i in range(3)] + [(3, 200 + i, 5) for i in range(20)]
    rows = spark.createDataFrame(rows, "bucket long, set long, label long")
    hot = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 10")
    label = {r.set: (r.bucket, r.label) for r in rows.collect()}
    for cut in (simhash._in_blocks, simhash._meeting):
        buckets = {}
        for r in cut(rows, hot, 10).collect():
            buckets.setdefault(r.bucket, []).append(r.set)
        assert max(map(len, buckets.values())) <= 22
    met = {(a, b) for b_ in buckets.values() for a in b_ for b in b_ if a < b}
    want = {(a, b) for a in label for b in label if a < b and label[a][0] == label[b][0] and label[a][1] != label[b][1]}
    assert want <= met
    assert not any(s >= 200 for b in buckets.values() for s in b)


def test_recall_at_the_threshold(spark):
    """Pairs just at 0.8 are found but for a few in a hundred, pairs just below it never are."""
    draw, rows, over, under = random.Random(8), [], [], []
    for i in range(240):
        words = [f"w{draw.randrange(9000)}" for _ in range(draw.randint(150, 260))]
        n, other = len(words) - 4, list(words)
        # a word changed takes five shingles of each text: n - 5c of n + 5c are shared
        c = int(n / 45) if i % 2 else int(n / 45) + 1
        for k in range(c):
            other[(2 * k + 1) * len(words) // (2 * c)] = f"x{i}-{k}"
        a, b = ({tuple(t[j : j + 5]) for j in range(len(t) - 4)} for t in (words, other))
        (over if len(a & b) >= 0.8 * len(a | b) else under).append(1000 + i)
        rows += [(i, " ".join(words)), (1000 + i, " ".join(other))]
    left = set(kept(spark, rows))
    assert len(over) > 100 and len(under) > 100 and set(range(240)) <= left
    assert len(left & set(over)) <= 0.05 * len(over) and set(under) <= left


def test_rows_that_share_an_id(spark):
    """Are apart where their texts are; rows without an id come after others; other columns pass through."""
    draw = random.Random(9)
    text = lambda: " ".join(f"w{draw.randrange(5000)}" for _ in range(80))
    a, b, c = text(), text(), text()
    rows = [(5, a, "x"), (5, b, "x"), (5, a, "x"), (7, b + " end", "x"), (None, c, "x"), (None, a, "x"), (None, c, "x"), (8, None, "x"), (9, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id_of string").withColumns({n: F.lit("y") for n in ("_id", "_hash", "hash_of", "_n", "rep", "fp", "k")})
    got = simhash.deduplicated(docs).collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in got) == sorted([(5, a), (5, b), (-1, c), (8, "")])
    assert {(r.id_of, r._id, r._hash, r.hash_of, r._n, r.rep, r.fp, r.k) for r in got} == {("x", *"yyyyyyy")}


def test_no_pairs_are_written(spark):
    """A group of near copies that are close by fingerprint, of which few pairs are similar: links are fewer than rows."""
    draw = np.random.default_rng(2)
    base = np.arange(400)
    rows = [np.unique(np.where(draw.random(400) < share, draw.integers(1000, 10**6, 400), base)) for share in draw.choice([0.02, 0.08, 0.14], 300)]
    sets = simhash.Sets(pa.array([r.tolist() for r in rows], pa.list_(pa.int64())))
    label = np.arange(300)
    prints = np.zeros((300, 5), np.uint64)
    prints[:, 0], prints[:, 4] = draw.integers(0, 8, 300), label  # equal fingerprints, told apart by a fifth word
    got = simhash.similar_pairs(prints, label, sets, 4, 256, 0.8)
    want = list(range(300))
    for i in range(300):
        for j in range(i):
            n = len(np.intersect1d(rows[i], rows[j]))
            if n >= 0.8 * (len(rows[i]) + len(rows[j]) - n):
                x, y = sorted((want[i], want[j]))
                want = [x if w == y else w for w in want]
    assert len(got) == 300 - len(set(want)) and 1 < len(set(want)) < 250
    for a, b in got:
        assert want[a] == want[b]


def test_clusters_that_are_cut(spark, monkeypatch):
    """Clusters and buckets of many rows, cut into small blocks, give the same groups."""
    draw = random.Random(4)
    words = lambda n: [f"w{draw.randrange(5000)}" for _ in range(n)]
    base = [words(60) for _ in range(4)]
    texts = [" ".join(b[: len(b) - k]) for b in base for k in (0, 3, 6, 9, 12, 15)] + [" ".join(words(60)) for _ in range(6)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = simhash.similar_links
    how = dict(shingle=5, words=4, budget=256, bands=1, band_bits=0, similarity=0.8)
    want = {r.doc_id: r.component_id for r in simhash.simhash_components(docs, **how).collect()}
    monkeypatch.setattr(simhash, "similar_links", lambda *a: whole(*a, bucket_rows=8, cluster_rows=6))
    assert {r.doc_id: r.component_id for r in simhash.simhash_components(docs, **how).collect()} == want and len(set(want.values())) < 15


def test_rows_alike_in_id_and_text(spark):
    """Of rows that share id and text, the same one stays whatever the order of rows."""
    rows = [(1, "same text", "de", "b"), (1, "same text", "de", "a"), (1, "same text", None, "c"), (2, "other", "x", "y")]
    for some in (rows, rows[::-1]):
        docs = spark.createDataFrame(some, "doc_id long, text string, lang string, source string")
        assert sorted((r.doc_id, r.lang, r.source) for r in simhash.deduplicated(docs).collect()) == [(1, "de", "a"), (2, "x", "y")]


def similar(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def test_small_sets_are_met_exactly(spark):
    """Components of small_links are those of all pairs of at most nine shingles that share 0.8."""
    draw, sets = random.Random(3), []
    for _ in range(40):
        base = draw.sample(range(1000), draw.randint(1, 9))
        for _ in range(8):
            some = set(base)
            for _ in range(draw.randint(0, 2)):
                some -= {draw.choice(base)} if draw.random() < 0.6 else set()
                some |= {draw.randrange(1000, 1004)} if len(some) < 9 and draw.random() < 0.6 else set()
            sets.append(frozenset(some or base[:1]))
    rows = [(i, sorted(x)) for i, x in enumerate(sets)]
    links = [(r.a, r.b) for r in simhash.small_links(spark.createDataFrame(rows, "rep long, shingles array<long>")).collect()]
    assert all(similar(sets[a], sets[b]) for a, b in links) and len(links) < 10 * len(sets)

    def classes(pairs):
        label = list(range(len(sets)))
        for a, b in pairs:
            x, y = sorted((label[a], label[b]))
            label = [x if w == y else w for w in label]
        return label

    want = classes([(a, b) for a in range(len(sets)) for b in range(a) if similar(sets[a], sets[b])])
    assert classes(links) == want and 40 < len(set(want)) < 250
    assert simhash.small_links(spark.createDataFrame([], "rep long, shingles array<long>")).count() == 0


def test_recall_of_short_texts(spark):
    """All pairs of texts of 8 to 13 words are found, whose fingerprints alone would miss one in ten."""
    draw, rows, close = random.Random(11), [], []
    for i in range(300):
        n = draw.randint(8, 12 if i % 3 else 13)
        words = [f"w{draw.randrange(9000)}" for _ in range(n)]
        other = words + ["end"] if i % 3 else ["x", *words[1:]]
        a, b = ({tuple(t[j : j + 5]) for j in range(len(t) - 4)} for t in (words, other))
        close += [1000 + i] if similar(a, b) else []
        rows += [(i, " ".join(words)), (1000 + i, " ".join(other))]
    left = set(kept(spark, rows))
    assert len(close) > 180 and left.isdisjoint(close) and left == {i for i, _ in rows} - set(close)
