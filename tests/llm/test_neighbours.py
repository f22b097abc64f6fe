"""Multiprobe hashing: chances and their order, recall and exact distances against brute force, odd vectors."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import lsh


def brute(rows, k, every):
    """Each query's rows (distance, id), nearest first."""
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    out = {}
    for i, q in rows:
        if i % every == 0:
            d = np.sqrt(((x - np.array(q)) ** 2).sum(axis=1))
            out[i] = sorted((float(a), int(b)) for a, b in zip(d, ids) if b != i)[:k]
    return out


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    return {q: sorted(rows) for q, rows in out.items()}


def checked(got, rows, k, every):
    """Ranks, order and distances are right whatever was found; returns the share of true neighbours."""
    at, want, hits = dict(rows), brute(rows, k, every), 0
    assert set(got) <= set(want)
    for q, some in got.items():
        assert [r for r, _, _ in some] == list(range(1, len(some) + 1))
        assert [(s, v) for _, s, v in some] == sorted((s, v) for _, s, v in some) and len({v for *_, v in some}) == len(some)
        for _, score, v in some:
            assert v != q and score == pytest.approx(math.dist(at[v], at[q]), rel=1e-12, abs=1e-12)
        hits += len({v for *_, v in some} & {v for _, v in want[q]})
    return hits / sum(map(len, want.values()))


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, vec array<double>")


def test_chances():
    z = np.linspace(-6, 6, 101)
    assert np.abs(lsh.below(z) - [0.5 * (1 + math.erf(x / math.sqrt(2))) for x in z]).max() < 2e-7
    place, radius = np.array([0.3, 5.9, -2.5]), 0.8
    share = lambda k, slot: lsh.below(np.array([(slot + 1 - place[k]) / radius]))[0] - lsh.below(np.array([(slot - place[k]) / radius]))[0]
    every = {s: math.prod(share(k, x) for k, x in enumerate(s)) for s in itertools.product(range(-5, 6), range(1, 12), range(-8, 4))}
    got = [tuple(map(int, s)) for s in lsh.probes(place, radius, 0.8, 4096)]
    order = sorted(every.values(), reverse=True)
    assert [every[s] for s in got] == pytest.approx(order[: len(got)])
    assert sum(order[: len(got) - 1]) < 0.8 <= sum(order[: len(got)]) and len(set(got)) == len(got) and got[0] == (0, 5, -3)
    assert lsh.probes(place, radius, 0.8, 10) is None and lsh.probes(place, 1e9, 0.8, 4096) is None


def test_chances_come_true():
    """Of vectors at one distance of a query, as many are in the buckets visited as were to be."""
    draw = np.random.default_rng(4)
    q = draw.normal(size=(1, 12))
    step = draw.normal(size=(20_000, 12))
    x = q + 1.5 * step / np.linalg.norm(step, axis=1, keepdims=True)
    shares = []
    for seed in range(30):
        hashes = lsh.Hashes.new(12, 1, 4, 2.0)
        hashes.directions = np.random.default_rng(seed).normal(size=(12, 1, 4))
        visited = hashes.keys(lsh.probes(hashes.places(q)[0, 0], 1.5 / 2.0, 0.7, 4096), 0)
        shares.append(np.isin(hashes.keys(np.floor(hashes.places(x)[:, 0]), 0), visited).mean())
    assert 0.64 < np.mean(shares) < 0.76


@pytest.mark.parametrize("hot", [False, True])
def test_recall_and_pruning(spark, monkeypatch, hot):
    monkeypatch.setattr(lsh, "SAMPLE", 400 * 16)
    draw = np.random.default_rng(6)
    centre = draw.normal(size=(40, 16)) * 4
    rows = [(i, (centre[i % 40] + draw.normal(size=16) * 0.3).tolist()) for i in range(3000)]
    if hot:
        rows = [(i, rows[0][1] if i % 3 == 0 else v) for i, v in rows]
    df = frame(spark, rows)
    is_query = F.col("vec_id") % 50 == 0
    assert checked(found(lsh.nearest(df, is_query, 10)), rows, 10, 50) >= 0.95
    data, queries, _, size = lsh.prepared(df, is_query, 10)
    index = lsh.Index(data, size, 10, lsh.TABLES, lsh.CHANCE, None)
    visits = index.visits(queries)
    assert visits.where("key is null").count() == 0
    met = visits.join(index.rows(), "key").count() / (lsh.TABLES * data.count() * queries.count())
    assert met < 0.2  # most rows are never compared


def test_cut_buckets(spark, monkeypatch):
    monkeypatch.setattr(lsh, "ROWS", 20)
    monkeypatch.setattr(lsh, "ASKS", 3)
    draw = np.random.default_rng(7)
    rows = [(i, draw.normal(size=5).tolist()) for i in range(400)]
    got = found(lsh.nearest(frame(spark, rows), F.col("vec_id") % 10 == 0, 5, chance=0.999))
    assert checked(got, rows, 5, 10) >= 0.97


def test_all_rows_where_buckets_are_too_many(spark, monkeypatch):
    monkeypatch.setattr(lsh, "ROWS", 50)
    draw = np.random.default_rng(8)
    rows = [(i, draw.normal(size=4).tolist()) for i in range(200)] + [(200, [1e6, 1e6, 0.0, 0.0]), (210, [-3e9, 0.0, 0.0, 5.0])]
    got = found(lsh.nearest(frame(spark, rows), F.col("vec_id") % 10 == 0, 5))
    want = brute(rows, 5, 10)
    assert all([v for *_, v in got[q]] == [v for _, v in want[q]] for q in (200, 210))
    monkeypatch.setattr(lsh, "PROBES", 2)  # all queries see all rows: exact
    assert checked(found(lsh.nearest(frame(spark, rows), F.col("vec_id") % 10 == 0, 5)), rows, 5, 10) == 1.0


def test_odd_vectors(spark):
    rows = [(0, [0.5, 1.0], 7), (1, None, 7), (2, [float("nan"), 1.0], 7), (3, [None, 1.0], 7), (4, [float("inf"), 0.0], 7), (5, [0.25, 1.0], 7), (None, [1.0, 1.0], 7), (6, [0.0, 0.0], 7), (7, [], 7), (8, [1.0], 7), (100, [0.5, 1.0], 7), (0, [0.5, 1.0], 7), (9, [0.75, 1.0], 7)]
    df = spark.createDataFrame(rows, "vec_id long, e array<float>, score int").withColumn("vec", lsh.finite("e")).withColumns({c: F.lit("x") for c in ("entry", "key", "raw", "id", "part")})
    got = sorted(map(tuple, lsh.nearest(df, F.col("vec_id") % 100 == 0, 10).collect()))
    assert got == [(0, 1, 100, 0.0), (0, 2, 5, 0.25), (0, 3, 9, 0.25), (100, 1, 0, 0.0), (100, 2, 5, 0.25), (100, 3, 9, 0.25)]  # ties: smaller ids
    assert lsh.nearest(df.limit(0), F.col("vec_id") == 0, 5).count() == 0
    assert lsh.nearest(df, F.col("vec_id") == 77, 5).count() == 0
    assert lsh.nearest(df.where("vec_id = 0"), F.col("vec_id") == 0, 5).count() == 0
    far = frame(spark, [(0, [1e200, 1.0]), (1, [-1e200, 1.0]), (2, [1.0, 1.0])])
    assert {r.query_id for r in lsh.nearest(far, F.col("vec_id") == 0, 2).collect()} <= {0}


def test_bytes():
    x = np.array([[0.5, 1e300], [0.1, 0.2], [1.0, -2.0]])
    raw = lsh.packed(x).to_pylist()
    assert list(map(len, raw)) == [16, 16, 8] and (lsh.unpacked(raw, 2) == x).all()
