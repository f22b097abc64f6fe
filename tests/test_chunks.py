"""Shapes in chunks against whole ones; collections written piece by piece."""

import json
import math
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cairn.functions import geometry
from cairn.operators import chunks, recorder
from cairn.sources import geojson

VERTEX = "shape string, seq long, lng double, lat double, accuracy double, time long, altitude double, altitude_accuracy double"


def vertices(spark):
    draw, rows = random.Random(4), []
    for shape, n in (("a", 5000), ("b", 1), ("c", 64), ("d", 65), (None, 3)):
        rows += [(shape, 7 * i - 50, 18 + draw.random(), 59 + draw.random(), 1.0, i, None if i % 3 else 4.5, None) for i in range(n)]
    draw.shuffle(rows)
    return spark.createDataFrame(rows, VERTEX)


def joined(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r.chunk):
        out.setdefault(r["shape"], []).extend(tuple(v) for v in r.vertices)
    return out


@pytest.mark.parametrize("size, span", [(64, 100), (1024, 10**6), (1, 64)])
def test_chunks_are_the_shape(spark, size, span):
    v = vertices(spark)
    whole = recorder.build_shapes(v, "shape")
    cut = chunks.chunked(v, "shape", size=size, span=span)
    rows = cut.collect()
    assert max(len(r.vertices) for r in rows) <= size and len(rows) == sum(-(-n // size) for n in (5000, 1, 64, 65, 3))
    plain = lambda f: {r["shape"]: [tuple(x) for x in r.c] for r in whole.select("shape", f(F.col("coordinates")).alias("c")).collect() if r.c}
    assert joined(cut) == plain(lambda c: c)
    assert joined(chunks.undone(cut, "shape")) == plain(geometry.without_last)
    assert joined(chunks.closed(cut, "shape")) == plain(geometry.closed)
    kept = {r["shape"] for r in chunks.complete(cut, F.lit("area"), "shape").collect()}
    assert kept == {"a", "c", "d", None} and chunks.chunked(v.limit(0), "shape").count() == 0


def test_measures(spark):
    v = vertices(spark)
    got = {r["shape"]: r for r in chunks.measured(chunks.chunked(v, "shape", size=50), "shape").collect()}
    for shape, points in joined(chunks.chunked(v, "shape", size=10**6)).items():
        far = lambda a, b: 2 * chunks.RADIUS * math.asin(math.sqrt(math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2))
        r = got[shape]
        assert r.n_vertices == len(points) and tuple(r.extent) == (min(p[0] for p in points), min(p[1] for p in points), max(p[0] for p in points), max(p[1] for p in points))
        assert r.length_m == pytest.approx(sum(map(far, points, points[1:])), rel=1e-9)


def test_chunks_as_geojson(spark, tmp_path):
    """Pieces of a feature make one document, which reads back as the whole shape does."""
    v = vertices(spark).where("shape is not null").withColumn("sheet", F.when(F.col("shape") == "c", 2).otherwise(1))
    cut = chunks.chunked(v, "sheet", "shape", size=40).withColumns({"category": F.when(F.col("shape") == "d", "area").otherwise("line"), "properties": F.lit('{"k":"v"}')})
    path = str(tmp_path / "out")
    geojson.write_collections(chunks.pieces(cut, "shape", "sheet"), path, "sheet", F.col("starts"), "test")
    files = list(Path(path).glob("sheet=*/*.txt"))
    assert len(files) == 2
    document = json.loads(next(f for f in files if "sheet=1" in str(f)).read_text())
    assert [f["id"] for f in document["features"]] == ["a", "b", "d"] and document["properties"]["app"] == "test"
    points = joined(chunks.chunked(v, "shape", size=10**6))
    for f in document["features"]:
        want = [list(p[:2]) + ([p[4]] if p[4] is not None else []) for p in points[f["id"]]]
        want = [[p[:2] for p in want] + [want[0][:2]]] if f["id"] == "d" else want
        assert f["geometry"]["coordinates"] == want and f["properties"] == {"k": "v"}
    back = geojson.read_features(spark, f"{path}/sheet=*")
    assert sorted((r.id, r.ordinal) for r in back.collect()) == [("a", 0), ("b", 1), ("c", 0), ("d", 2)]


def test_collections_are_not_gathered(spark, tmp_path):
    """A collection is lines of one file, each a feature; no plan gathers one."""
    rows = [(f"{i:03}", i, "point" if i % 2 else "area", '{"n":%d}' % i, '{"type":"Point","coordinates":[1.0,2.0]}', "x" if i < 70 else "y") for i in range(100)]
    df = spark.createDataFrame(rows, "id string, ordinal long, category string, properties string, geometry string, by string")
    geojson.write_geojson(df, str(tmp_path / "g"), "by")
    for by, n in (("x", 70), ("y", 30)):
        (file,) = Path(tmp_path, "g", f"by={by}").glob("*.txt")
        lines = file.read_text().splitlines()
        assert len(lines) == n
        found = json.loads("\n".join(lines))["features"]
        assert [f["id"] for f in found] == [r[0] for r in sorted(rows, key=lambda r: (r[2] == "area", r[1])) if r[5] == by]
