"""Edge values and hand-made rows."""

import math
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cairn.functions import geometry, gps, text
from cairn.operators import contours, objects, recorder, reviews, spatial, workspaces


def test_quality(spark):
    rows = [(0.0, "excellent"), (3.0, "excellent"), (3.0001, "good"), (10.0, "good"), (10.0001, "warn"), (50.0, "warn"), (50.0001, "bad"), (math.nan, "bad"), (None, "bad")]
    df = spark.createDataFrame(rows, "a double, want string")
    assert df.where(gps.gps_quality(F.col("a")) != F.col("want")).count() == 0
    assert df.limit(1).select(gps.gps_label(F.col("a"))).first()[0] == "★ GPS ± 0 m · Utmärkt"


def test_point_gate(spark):
    df = spark.createDataFrame([("gps", 50.0), ("gps", 50.1), ("gps", None), ("manual", 99.0)], "source string, accuracy double")
    assert sorted(r.accuracy or -1 for r in objects.accept_points(df).collect()) == [-1, 50.0, 99.0]


def test_defaults(spark):
    schema = "id string, observation_id string, category string, object_type string, type string, version int"
    rows = [("a", None, "point", "stone", None, 0), (None, "b", "point", None, "pit", 3), (None, None, "line", "", "", None), ("d", "e", "point", "path", None, 1)]
    got = {(r.id, r.observation_id): r for r in objects.normalize_objects(spark.createDataFrame(rows, schema)).collect()}
    assert got["a", "a"].object_type == "boulder" and got["a", "a"].version == 1 and got["a", "a"].contributor_id == "legacy-local"
    assert got["b", "b"].object_type == "pit" and got["b", "b"].version == 3
    assert got["d", "e"].object_type == "boulder"  # a line's type is none of a point
    (made,) = [r for r in got.values() if r.object_type == "path"]
    assert made.id == made.observation_id and len(made.id) == 64


def test_workspaces(spark):
    schema = "name string, scale int, contour_interval double, size_km int, symbol_display_mode string, center struct<lat:double,lng:double>, standard string"
    rows = [("x" * 61, 5000, 1.0, 3, "paper", None, None), (" ok ", 7500, 2.5, 2, None, (60.0, 18.0), "ISOM 2017-2 v6"), ("  ", None, None, None, "", (1.0, None), "ISOM 2017-2 v6")]
    got = [r.problems for r in workspaces.validate_workspaces(spark.createDataFrame(rows, schema)).collect()]
    assert got[1] == [] and len(got[0]) == 7 and got[2] == ["name missing", "scale", "contour interval", "size", "center"]


@pytest.mark.parametrize("lat", [0.0, 60.0, 89.9])
def test_bounds(spark, lat):
    b = spark.createDataFrame([(lat,)], "lat double").select(geometry.bounds(F.col("lat"), F.lit(18.0), F.lit(10.0)).alias("b")).first().b
    assert math.isclose(b.north - b.south, 10 / 111.32) and math.isclose(b.east - b.west, 10 / (111.32 * math.cos(math.radians(lat))))


def test_boxes_meet_equals_brute_force(spark):
    import random

    draw = random.Random(5)
    box = lambda: (x := draw.uniform(10, 12), y := draw.uniform(50, 52), x + draw.choice([0, 0.01, 0.4, 30]), y + draw.choice([0, 0.02, 0.5, 9]))
    a, b = ([(i, box()) for i in range(60)] for _ in range(2))
    shape = "id int, box struct<west:double,south:double,east:double,north:double>"
    left = spark.createDataFrame(a, shape)
    right = spark.createDataFrame(b, shape).select(F.col("id").alias("other"), F.col("box").alias("other_box"))
    got = sorted((r.id, r.other) for r in spatial.boxes_meet(left, right, "box", "other_box").collect())
    want = sorted((i, j) for i, p in a for j, q in b if p[0] <= q[2] and q[0] <= p[2] and p[1] <= q[3] and q[1] <= p[3])
    assert got == want


REVIEWS = "id string, source_id string, status string, reviewed_at timestamp, isom_symbol string, road_type string, ordinal int"


def test_carry_over(spark):
    prev = spark.createDataFrame([("p1", "w1", "locally-approved", None, "503", "road", 1), ("p2", "w1", None, None, "503", "road", 2), ("p3", None, "locally-rejected", None, None, None, 3), ("p4", "w2", "locally-approved", None, "504", "x", 4), ("p5", "gone", "locally-approved", None, "504", "x", 5)], REVIEWS)
    new = spark.createDataFrame([("n1", "w1", None, None, "506", "path", 1), ("n2", None, None, None, "506", "path", 2), ("n3", "w2", None, None, "506", "path", 3)], REVIEWS)
    got = {r.id: (r.status, r.isom_symbol) for r in reviews.carry_over_road_reviews(new, prev).collect()}
    assert got == {"n1": (None, "506"), "n2": ("locally-rejected", None), "n3": ("locally-approved", "504")}
    assert {r.id: r.status for r in reviews.carry_over_road_reviews(new, prev, strict_keys=True).collect()}["n2"] is None


def test_replay(spark):
    shape = "id string, status string, reviewed_at timestamp, isom_symbol string, road_type string, automatic_isom_symbol string, automatic_road_type string"
    roads = spark.createDataFrame([(f, None, None, "506", "path", a, None) for f, a in (("a", "505"), ("b", "505"), ("c", None), ("d", "505"), ("e", "505"), ("f", "505"))], shape)
    log = [("a", "change", "503"), ("a", "approved", None), ("b", "change", "503"), ("b", "reset", None), ("c", "change", "503"), ("c", "reset", None), ("d", "change", "999"), ("e", "reset", None), ("x", "approved", None)]
    events = spark.createDataFrame([(i, f, a, s) for i, (f, a, s) in enumerate(log)], "event_id long, feature_id string, action string, symbol string").withColumn("ts", F.timestamp_seconds("event_id"))
    got = {r.id: (r.status, r.isom_symbol, r.reviewed_at is None) for r in reviews.apply_reviews(roads, events).collect()}
    assert got["a"] == ("locally-approved", "503", False)
    assert got["b"] == ("automatic-unverified", "505", True)
    assert got["c"] == ("automatic-unverified", "503", True)
    assert got["d"] == (None, "506", True) and got["f"] == (None, "506", True)
    assert got["e"] == ("automatic-unverified", "505", True)


def run(*events):
    state, out = recorder.new_state(), []
    for i, e in enumerate(events):
        e = {"ts": i, "seq": i, "category": None, "object_type": None, "mode": None, "lng": 1.0, "lat": 2.0, "accuracy": 5.0, "altitude": None, "altitude_accuracy": None} | e
        made = recorder.step(state, e)
        if made:
            out.append(made)
    return state, out


FIX, LINE, POINT, FINISH = {"kind": "fix"}, {"kind": "action", "category": "line"}, {"kind": "action", "category": "point"}, {"kind": "finish"}
MANUAL, TAP = {"kind": "set_mode", "mode": "manual"}, {"kind": "tap"}


def test_recorder():
    _, out = run(FIX, LINE, FIX, FINISH, FIX, FINISH)
    assert len(out) == 1 and len(out[0]["coordinates"]) == 2  # the failed finish leaves it open
    state, out = run(FIX, LINE, {"kind": "undo"}, {"kind": "action", "category": "area"}, POINT)
    assert state["category"] == "line" and [o["category"] for o in out] == ["point"]  # a point during a GPS line
    assert not run(FIX, {"kind": "fix", "accuracy": 51.0}, POINT)[1]  # the last fix is bad
    assert run({"kind": "fix", "accuracy": 51.0}, LINE)[0]["category"] is None
    state, _ = run(FIX, LINE, MANUAL)
    assert state["category"] == "line" and state["mode"] == "gps"
    state, _ = run(FIX, LINE, {"kind": "set_mode", "mode": "gps"})
    assert state["category"] is None  # the GPS button during a GPS recording discards it
    _, out = run(MANUAL, LINE, TAP, TAP, LINE)
    assert out[0]["source"] == "manual" and out[0]["coordinates"][0]["accuracy"] == 0.0
    _, out = run(MANUAL, LINE, TAP, TAP, POINT, TAP)
    assert [o["category"] for o in out] == ["point"]  # arming a point loses the open line
    assert not run(MANUAL, POINT, FINISH)[1]
    assert run(FIX, LINE, {"kind": "stop_gps"})[0]["last"] is not None and run(FIX, {"kind": "stop_gps"})[0]["last"] is None
    _, out = run({"kind": "set_type", "category": "line", "object_type": "stream"}, FIX, LINE, {"kind": "set_type", "category": "line", "object_type": "wall"}, FIX, FIX, FINISH)
    assert out[0]["object_type"] == "stream"


def test_contour_lines_keep_all_segments(spark):
    n = 24
    z = [(x, y, 100 - ((x - 11.3) ** 2 + (y - 12.7) ** 2) / 4 + 6 * math.sin(x) * math.cos(y)) for x in range(n) for y in range(n)]
    grid = spark.createDataFrame(z, "x bigint, y bigint, z double")
    segments = contours.contour_segments(grid, 5.0)
    flat = {(r.x, r.y): r.z for r in grid.collect()}
    rows = segments.collect()
    for r in rows[:300]:  # ends lie on cell edges and interpolate to the level
        for e, x, y in ((r.e1, r.x1, r.y1), (r.e2, r.x2, r.y2)):
            kind, ex, ey = e.split(":")
            a, b = flat[int(ex), int(ey)], flat[int(ex) + (kind == "h"), int(ey) + (kind == "v")]
            t = (x - int(ex)) + (y - int(ey))
            assert math.isclose(a + t * (b - a), 5.0 * r.k, abs_tol=1e-6)
    assert_lines(spark, rows, segments, (4, 7, 64))


def plain_lines(rows):
    """Chains of all segments of a level, in one place; rings and open lines begin and run as contour_lines says."""
    found = []
    for k in {r.k for r in rows}:
        for c in contours.chains([(r.e1, (r.e1, r.x1, r.y1), r.e2, (r.e2, r.x2, r.y2)) for r in rows if r.k == k]):
            c = [p for _, p in c]
            if c[0][0] == c[-1][0]:
                body = c[:-1]
                at = min(range(len(body)), key=lambda i: body[i][0])
                body = body[at:] + body[:at]
                c = [*body, body[0]] if body[1][0] <= body[-1][0] else [body[0], *body[:0:-1], body[0]]
            elif c[-1][0] < c[0][0]:
                c = c[::-1]
            found.append((k, [p[1:] for p in c]))
    return sorted(found)


def assert_lines(spark, rows, segments, tiles):
    want = plain_lines(rows)
    for tile in tiles:
        lines = contours.contour_lines(segments, 5.0, tile=tile).collect()
        assert sorted((int(r.elevation / 5), [(p.x, p.y) for p in r.coordinates]) for r in lines) == want
        assert all(r.index_contour == (r.elevation % 25 == 0) and r.closed == (r.coordinates[0] == r.coordinates[-1]) for r in lines)


def test_contour_lines_across_the_origin(spark):
    flat = [(x, y, float(y)) for x in range(-9, 10) for y in range(-6, 7)]
    (line,) = [r for r in contours.contour_lines(contours.contour_segments(spark.createDataFrame(flat, "x bigint, y bigint, z double"), 5.0), 5.0, tile=4).collect() if r.elevation == 0]
    assert len(line.coordinates) == 19
    hill = [(x, y, 60 - (x * x + y * y) / 4 + 6 * math.sin(3 * x) * math.cos(2 * y)) for x in range(-13, 12) for y in range(-11, 14) if (x, y) != (5, 5)]
    segments = contours.contour_segments(spark.createDataFrame(hill, "x bigint, y bigint, z double"), 5.0)
    assert_lines(spark, segments.collect(), segments, (3, 8))


def test_contour_lines_of_the_given_orders(spark, sf_dir):
    """The registered query against plain chains, on its whole table."""
    from cairn.plans.fixtures import derived
    from cairn.plans.more_queries import contour_lines

    rows = contours.contour_segments(derived(spark, sf_dir, "elevation"), 100.0).collect()
    got = sorted((r.elevation, r.closed, r.n_points, r.x, r.y) for r in contour_lines(spark, sf_dir).collect())
    assert got == sorted((k * 100.0, c[0] == c[-1], len(c), round(c[0][0], 6), round(c[0][1], 6)) for k, c in plain_lines(rows))


def test_places_at_the_poles(spark):
    """Boxes that run around the earth, and points far out."""
    rows = [(1, 90.0, 18.0, 10.0), (2, 89.9, 18.0, 5.0), (3, 60.0, 18.0, 2.0), (4, -90.0, 0.0, 10.0)]
    w = spark.createDataFrame(rows, "workspace_id int, lat double, lng double, size double").select("workspace_id", geometry.bounds(F.col("lat"), F.col("lng"), F.col("size")).alias("bbox"))
    points = [(i, lng, lat) for i, (lng, lat) in enumerate([(18.0, 90.0), (-170.0, 89.96), (18.0, 60.0), (18.0, 60.5), (0.0, -89.99), (5e6, 89.97), (math.nan, 60.0), (None, 60.0)])]
    p = spark.createDataFrame(points, "id int, lng double, lat double")
    boxes = {r.workspace_id: r.bbox for r in w.collect()}
    want = sorted((i, k) for i, lng, lat in points for k, b in boxes.items() if lng is not None and b.west <= lng <= b.east and b.south <= lat <= b.north)
    assert sorted((r.id, r.workspace_id) for r in spatial.objects_in_workspaces(p, w).collect()) == want and len(want) > 4
    box = F.struct(F.col("lng").alias("west"), F.col("lat").alias("south"), F.col("lng").alias("east"), F.col("lat").alias("north"))
    assert sorted((r.id, r.workspace_id) for r in spatial.features_in_workspaces(p.withColumn("extent", box), w).collect()) == want


def test_where_the_map_opens(spark):
    moves = spark.createDataFrame([(1, 1, 0, 1.0, 2.0, 7), (1, 2, 0, 3.0, None, 8), (2, 1, 0, 5.0, 6.0, 9), (3, 1, 0, 5.0, 6.0, 7)], "user_id int, ts int, seq int, lat double, lng double, workspace_id int")
    w = spark.createDataFrame([(7, (50.0, 10.0)), (8, None)], "id int, center struct<lat:double,lng:double>")
    asked = spark.createDataFrame([(2, 40.0, 20.0), (3, 40.0, 20.0), (4, 41.0, 21.0), (5, 41.0, None)], "user_id int, lat double, lng double")
    got = {r.user_id: (r.open_lat, r.open_lng) for r in workspaces.latest_center(moves, w, asked).collect()}
    assert got == {1: workspaces.HOME, 2: (40.0, 20.0), 3: (50.0, 10.0), 4: (41.0, 21.0), 5: workspaces.HOME}


def test_layers(spark, tmp_path):
    """Versions hold what changed; readers of some workspaces see those; replacing by nothing empties."""
    from cairn.sources import layers

    path = str(tmp_path)
    ids = lambda *k: spark.createDataFrame([(i,) for i in k], "workspace_id int")
    rows = lambda text, *k: ids(*k).withColumn("t", F.lit(text))
    assert layers.read_layer(spark, path, "roads") is None
    layers.write_layer(rows("a", 1, 2, 3, 9), path, "roads", ids(1, 2, 3, 4))
    layers.write_layer(rows("b", 2).withColumn("more", F.lit(5)), path, "roads", ids(2, 3))
    read = lambda *k: sorted((r.workspace_id, r.t) for r in layers.read_layer(spark, path, "roads", *k).collect())
    assert read() == [(1, "a"), (2, "b")] and read([2, 3]) == [(2, "b")] and read([77]) == []
    layers.drop_layer(spark, path, "roads", ids(1))
    assert read() == [(2, "b")]
    written = [{r.workspace_id for r in spark.read.parquet(str(f)).collect()} for f in Path(path, "roads/data").glob("v=*")]
    assert sorted(map(sorted, written)) == [[], [1, 2, 3], [2]]  # each replacement wrote the rows of its own workspaces only


def test_two_writers_of_a_layer(spark, tmp_path, monkeypatch):
    """Each counts whole: one that finds its number taken goes on from the other's state; a claim left behind is taken over."""
    from cairn.sources import layers

    path, ids = str(tmp_path), lambda *k: spark.createDataFrame([(i,) for i in k], "workspace_id int")
    layers.write_layer(ids(1, 2).withColumn("t", F.lit("old")), path, "roads", ids(1, 2))
    renamed, others = layers._renamed, [("b", 2), ("c", 3)]

    def late(*a):
        if others:  # another writer is done just before
            t, k = others.pop()
            layers.write_layer(ids(k).withColumn("t", F.lit(t)), path, "roads", ids(k))
        return renamed(*a)

    monkeypatch.setattr(layers, "_renamed", late)
    layers.write_layer(ids(1).withColumn("t", F.lit("a")), path, "roads", ids(1))
    read = lambda: sorted((r.workspace_id, r.t) for r in layers.read_layer(spark, path, "roads").collect())
    assert read() == [(1, "a"), (2, "b"), (3, "c")]
    newest = layers._manifest(spark, path, "roads")[1]
    Path(path, f"roads/manifest/v={newest + 1}.claimed").touch()
    with pytest.raises(RuntimeError):
        layers.write_layer(ids(1).withColumn("t", F.lit("d")), path, "roads", ids(1), tries=1)
    monkeypatch.setattr(layers, "STALE", -1)
    layers.write_layer(ids(1).withColumn("t", F.lit("d")), path, "roads", ids(1), tries=1)
    assert read() == [(1, "d"), (2, "b"), (3, "c")]


def test_texts(spark):
    row = spark.range(1).select(
        text.escape_html(F.lit("<a href='x'>&\"")).alias("html"), text.escape_html(F.lit(None)).alias("none"),
        text.symbol_scale(F.lit("print"), F.lit(0), F.lit(16)).alias("one"), text.symbol_scale(F.lit("print"), F.lit(10000), F.lit(30)).alias("most"), text.symbol_scale(F.lit("digital"), F.lit(1), F.lit(1)).alias("flat"),
        text.road_summary(F.lit(3), F.lit(2), F.lit(1)).alias("roads"), text.building_summary(F.lit(3), F.lit(1), F.lit(1), F.lit(1)).alias("buildings"), text.contour_label(F.lit(0), F.lit(5.0)).alias("contours"),
    ).first()
    assert row.html == "&lt;a href=&#39;x&#39;&gt;&amp;&quot;" and row.none == "" and row.one == 1.0 and row.most == 5.0 and row.flat == 1.0
    assert row.roads == "3 · 2 granskade · 1 ogranskade" and row.buildings == "3 · 1 godkända · 1 avvisade · 1 ogranskade" and row.contours == "Inte importerade"


def test_empty_tables(spark, sf_dir):
    from cairn.plans.fixtures import derived

    o = derived(spark, sf_dir, "objects").limit(0)
    assert objects.normalize_objects(o).count() == 0 and objects.catalog_lookup(o).count() == 0
    assert contours.contour_lines(contours.contour_segments(derived(spark, sf_dir, "elevation").limit(0), 5.0), 5.0).count() == 0


def test_recordings_against_a_replay(spark, sf_dir):
    """The registered query against a loop over all events of each device."""
    from cairn.plans.queries import recorder_events, recordings

    want, states = [], {}
    for e in sorted((r.asDict() for r in recorder_events(spark, sf_dir).collect()), key=lambda e: (e["ts"], e["seq"])):
        made = recorder.step(states.setdefault(e["device_id"], recorder.new_state()), e)
        if made:
            want.append((e["device_id"], made["ordinal"], made["category"], made["object_type"], made["source"], made["created_at"], len(made["coordinates"])))
    assert want and sorted(map(str, map(tuple, recordings(spark, sf_dir).collect()))) == sorted(map(str, want))


def test_stream_of_recordings(spark, tmp_path):
    """Events in any batches give the rows of the batch recorder; late ones are dropped and counted; abandoned lines go."""
    from cairn.streaming import fixes as streams

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    minute = 60_000
    at = lambda device, ts, kind, category=None: (device, ts, ts, kind, category, None, "gps", 1.0 + ts / 1e6, 2.0, 5.0, None, None)
    batches = [
        [at(1, 1000, "fix"), at(1, 2000, "action", "line"), at(1, 4000, "fix"), at(2, 1500, "fix"), at(2, 1600, "action", "line")],
        [at(1, 3000, "fix"), at(1, 3500, "undo"), at(1, 5000, "fix"), at(1, 6000, "finish"), at(2, 1700, "fix"), at(3, 20 * minute, "fix")],  # before what the first batch had
        [at(1, 6500, "fix"), at(3, 40 * minute, "fix")],  # late: 6500 is long past
        [at(2, 41 * minute, "fix"), at(2, 41 * minute + 1, "fix"), at(2, 42 * minute, "finish"), at(3, 80 * minute, "fix")],  # after device 2's line was given up
        [at(3, 100 * minute, "fix")],
    ]
    folder, out = tmp_path / "in", []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, recorder.EVENT).coalesce(1).write.parquet(f"{folder}/{i}")
    stream = spark.readStream.schema(recorder.EVENT).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))
    query = streams.stream_recordings(stream, "1 minute", "30 minutes").writeStream.foreachBatch(lambda rows, _: out.extend(rows.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r.device_id, r.created_at, [v.time for v in r.coordinates]) for r in out] == [(1, 6000, [4000, 5000])]
    assert [tuple(r) for r in streams.late_events(spark, str(tmp_path / "c")).collect()] == [(1, 1)]
