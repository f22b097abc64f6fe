"""Documents that many tasks read together give the features, in the order, that one does."""

import json
import random

import pytest

from cairn.sources import geojson, large_geojson


def document(n, seed):
    draw = random.Random(seed)
    odd = ['{"', "}]", "a\\\"}{", "é}", "", 'x"y', "[[{", "\\\\", "}\n{"]
    features = [{"type": "Feature", "id": f"{seed}-{i}", "properties": {"name": draw.choice(odd), "deep": {"a": [{"b": draw.choice(odd)}, {}]}, "long": "z" * draw.choice([0, 5, 3000])}, "geometry": {"type": "Point", "coordinates": [i, 0.5]}} for i in range(n)]
    head = {"type": "FeatureCollection", "properties": {"nested": {"type": "no feature", "t": "}{"}, "list": [{"x": 1}]}, "links": [{"rel": "self"}], "features": features, "after": [{"type": "other"}]}
    return json.dumps(head, indent=draw.choice([None, 1]), ensure_ascii=draw.random() < 0.5)


@pytest.mark.parametrize("block", ["2k", "64k", "128m"])
def test_same_features(spark, tmp_path, block):
    for seed, n in enumerate([400, 1, 0, 60]):
        (tmp_path / f"{seed}.json").write_text(document(n, seed))
    (tmp_path / "5.json").write_text(document(3, 5) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        found = large_geojson.read_large_features(spark, str(tmp_path))
        rows = lambda df: sorted((r.file.rpartition("/")[2], r.ordinal, r.id, r.geometry_type, json.dumps(json.loads(r.properties)), json.dumps(json.loads(r.geometry))) for r in df.collect())
        got, want = rows(found), rows(geojson.read_features(spark, str(tmp_path)).where("ordinal is not null"))
        assert got == want and len(got) == 464
        if block == "2k":
            pieces = spark.read.option("lineSep", "}").text(str(tmp_path))
            assert pieces.select("_metadata.file_path", "_metadata.file_block_start").distinct().count() > 100
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_effects():
    assert large_geojson.effect('{"a":{', False) == (False, 1) and large_geojson.effect('x{[', True) == (True, 0)
    assert large_geojson.effect('say \\" {" ,[', True) == (False, 0) and large_geojson.effect('["', False) == (True, 1)
    assert large_geojson.opening('],"f":[{"a":{', False, 2, 2) == 7 and large_geojson.opening('"{', False, 2, 2) is None
