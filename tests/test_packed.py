"""Many collections in few files: the same features, in the same order, as a file a collection gives."""

import json
from pathlib import Path

import pytest

from cairn.sources import geojson, large_geojson

NAMES = ["a}b", 'x"y\\', "", "é/=% {", None, *map(str, range(40))]


def features(spark):
    rows = [(f"{n}-{i}", i, ["area", "point", "line"][i % 3], '{\r\n"t": "}{\\n%d"}' % i, '{"type":"Point","coordinates":[1.0,2.0]}', n) for n in NAMES for i in range(7)]
    return spark.createDataFrame(rows, "id string, ordinal long, category string, properties string, geometry string, by string")


def wanted():
    order = [1, 4, 2, 5, 0, 3, 6]  # points, lines, areas
    return sorted((str(n), place, f"{n}-{i}", f"}}{{\n{i}") for n in NAMES for place, i in enumerate(order))


def test_packed_collections(spark, tmp_path):
    path = str(tmp_path / "p")
    geojson.write_geojson(features(spark), path, "by", app="te}st", packed=True)
    files = list(Path(path).glob("*.txt"))
    assert len(files) <= 2  # shuffle partitions, not collections
    documents = [json.loads(line) for f in files for line in f.read_bytes().decode().split("\n") if line.strip()]
    assert sorted(str(d["properties"]["name"]) for d in documents) == sorted(map(str, NAMES)) and documents[0]["properties"]["app"] == "te}st"
    back = geojson.read_features(spark, path, packed=True).collect()
    assert sorted((str(r.name), r.ordinal, r.id, json.loads(r.properties)["t"]) for r in back) == wanted()
    assert {r.collection_type for r in back} == {"FeatureCollection"} and {r.geometry_type for r in back} == {"Point"}


@pytest.mark.parametrize("block", ["1k", "128m"])
def test_packed_collections_by_blocks(spark, tmp_path, block):
    """Blocks begin within features, and collections go on for several blocks."""
    path = str(tmp_path / "p")
    more = features(spark).where("by <> '7'").unionByName(spark.createDataFrame([(f"7-{i}", i, "point", '{"t": "}{\\n%d"}' % i, '{"type":"Point","coordinates":[1.0,2.0]}', "7") for i in range(100)], features(spark).schema))
    more = more.unionByName(features(spark).where("by is null"))
    geojson.write_geojson(more, path, "by", app="te}st", packed=True)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        back = large_geojson.read_large_features(spark, path, packed=True).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = sorted([w for w in wanted() if w[0] != "7"] + [("7", i, f"7-{i}", f"}}{{\n{i}") for i in range(100)])
    assert sorted((str(r.name), r.ordinal, r.id, json.loads(r.properties)["t"]) for r in back) == want


@pytest.mark.parametrize("name", ["read_features", "export_order", "read_large_features"])
def test_query_writes_few_files(spark, sf_dir, monkeypatch, name):
    from cairn.plans import more_queries

    paths = []
    path_of = more_queries.scratch_path
    monkeypatch.setattr(more_queries, "scratch_path", lambda s: paths.append(path_of(s)) or paths[-1])
    assert getattr(more_queries, name)(spark, sf_dir).count() > 10
    assert all(len(list(Path(p).rglob("*.txt"))) <= 2 for p in paths) and paths


def test_effects_of_both_states():
    for piece in ['{"a":{', "x{[", 'say \\" {" ,[', '["', "", '"]"', '\\\\" {["', ']]"{"']:
        changes, *deeper = large_geojson.effects(piece)
        for inside in (False, True):
            assert large_geojson.effect(piece, inside) == (inside != changes, deeper[inside])
    assert large_geojson.opening('x\\"{" ,{"a{":[{', True, 2, 2) == 7 and large_geojson.opening("x{[", True, 2, 2) is None
