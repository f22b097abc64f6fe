"""Contour layers against a plain version: resampling, crossings, boxes, lines."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cairn.operators import contour_layers, contours
from cairn.sources.layers import read_layer

FRAME = contour_layers.Frame(10.0, 50.0, 70_000.0, 110_000.0, 3.0)


def ground(n=24, m=30):
    return {(x, y): 100.01 + 9 * math.sin(x / 4) + 7 * math.cos(y / 5 + x / 9) for x in range(-3, n) for y in range(-5, m) if (x, y) != (7, 8)}


def resampled(z, a, b):
    """Metre by tenth of a metre: sizes are whole tenths."""
    sums = defaultdict(lambda: [0.0, 0.0])
    for (x, y), v in z.items():
        for i in range(math.floor(x * a / b), math.ceil((x + 1) * a / b)):
            for j in range(math.floor(y * a / b), math.ceil((y + 1) * a / b)):
                area = (min((x + 1) * a, (i + 1) * b) - max(x * a, i * b)) * (min((y + 1) * a, (j + 1) * b) - max(y * a, j * b))
                if area > 0:
                    sums[i, j][0] += v * area
                    sums[i, j][1] += area
    return {k: s / w for k, (s, w) in sums.items()}


@pytest.mark.parametrize("to", [2, 5, 10, 3, 1.5])
def test_resample(spark, to):
    z = ground()
    df = spark.createDataFrame([(x, y, v) for (x, y), v in z.items()] + [(90, 90, float("nan")), (91, 90, float("inf")), (92, 90, None)], "x long, y long, z double")
    got = {(r.x, r.y): r.z for r in contours.resample(df, 3, to).collect()}
    want = resampled(z, 3, to)
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-12) for k in want)
    if to == 3:
        assert got == pytest.approx(z)


def pieces(z, step, box):
    """Of each level the segments within a box (u0, v0, u1, v1), as pairs of points."""
    out = defaultdict(list)
    for (x, y), sw in z.items():
        if not {(x + 1, y), (x + 1, y + 1), (x, y + 1)} <= z.keys():
            continue
        se, ne, nw = z[x + 1, y], z[x + 1, y + 1], z[x, y + 1]
        for k in range(math.floor(min(sw, se, ne, nw) / step) + 1, math.floor(max(sw, se, ne, nw) / step) + 1):
            level = k * step
            sides = [((x, y), sw, (x + 1, y), se), ((x + 1, y), se, (x + 1, y + 1), ne), ((x, y + 1), nw, (x + 1, y + 1), ne), ((x, y), sw, (x, y + 1), nw)]  # bottom, right, top, left
            hit = [None if (a >= level) == (b >= level) else tuple(p + (level - a) / (b - a) * (q - p) for p, q in zip(s, t)) for s, a, t, b in sides]
            some = [h for h in hit if h]
            if len(some) == 2:
                found = [tuple(some)]
            else:
                bottom, right, top, left = hit
                apart = (sw >= level) == ((sw + se + ne + nw) / 4 >= level)  # what's in at the south-west is joined through the middle
                found = [(bottom, right), (top, left)] if apart else [(left, bottom), (right, top)]
            for p, q in found:
                t0, t1 = 0.0, 1.0
                for i in (0, 1):
                    d = q[i] - p[i]
                    if d == 0:
                        t1 = t1 if box[i] <= p[i] <= box[i + 2] else -1
                    else:
                        a, b = sorted(((box[i] - p[i]) / d, (box[i + 2] - p[i]) / d))
                        t0, t1 = max(t0, a), min(t1, b)
                if t0 < t1:
                    out[k].append(tuple(tuple(a + t * (b - a) for a, b in zip(p, q)) for t in (t0, t1)))
    return out


def strung(segments):
    """Lines of segments that share ends, each as a sorted pair of its own sorted segments: no order, no direction."""
    at, up = defaultdict(list), list(range(len(segments)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    near = lambda p: (round(p[0], 7), round(p[1], 7))
    for i, (p, q) in enumerate(segments):
        at[near(p)].append(i)
        at[near(q)].append(i)
    for some in at.values():
        for i in some[1:]:
            up[find(i)] = find(some[0])
    lines = defaultdict(list)
    for i, (p, q) in enumerate(segments):
        lines[find(i)].append(tuple(sorted((near(p), near(q)))))
    return sorted(tuple(sorted(s)) for s in lines.values())


SHEETS = [(1, 5.3, 4.1, 50.2, 61.7, 2.5, "detailed"), (2, 20.9, 11.3, 66.6, 80.2, 2.5, "detailed"), (3, 1.1, 2.2, 70.0, 90.9, 5.0, "normal"), (4, -4.4, -8.8, 60.3, 80.1, 0.0, "soft"), (5, 9000.5, 9000.5, 9100.5, 9100.5, 5.0, "normal"), (6, 8.8, 9.9, 40.3, 50.1, 5.0, "odd")]


def sheets(spark):
    rows = [(i, (10 + w / 70_000, 50 + s / 110_000, 10 + e / 70_000, 50 + n / 110_000), 1, step or None, g) for i, w, s, e, n, step, g in SHEETS] + [(7, None, 1, 5.0, "soft")]
    return spark.createDataFrame(rows, "workspace_id int, bbox struct<west:double,south:double,east:double,north:double>, size_km int, contour_interval double, generalization string")


@pytest.mark.parametrize("tile", [256, 5])
def test_lines(spark, tile, tmp_path):
    z = ground()
    df = spark.createDataFrame([(x, y, v) for (x, y), v in z.items()], "x long, y long, z double")
    lines = contour_layers.workspace_contours(df, sheets(spark), FRAME, F.col("generalization"), tile=tile)
    got = defaultdict(list)
    for r in lines.collect():
        got[r.workspace_id].append(r)
    for i, w, s, e, n, step, g in SHEETS[:4]:
        size, step = contours.DETAIL[g], step or 2.5
        want = pieces(resampled(z, 3, size), step, tuple(m / size - 0.5 for m in (w, s, e, n)))
        back = defaultdict(list)
        for r in got[i]:
            points = [((p.lng - 10) * 70_000 / size - 0.5, (p.lat - 50) * 110_000 / size - 0.5) for p in r.coordinates]
            back[round(r.elevation / step)].append(list(zip(points, points[1:])))
            assert r.interval == step and r.index_contour == (round(r.elevation / step) % 5 == 0) and r.closed == (points[0] == points[-1])
        assert back.keys() == want.keys() and want
        for k in want:
            assert strung([x for line in back[k] for x in line]) == strung(want[k])
            assert len(back[k]) == len(strung(want[k]))
        assert [r.ordinal for r in sorted(got[i], key=lambda r: r.ordinal)] == list(range(len(got[i])))
    assert set(got) == {1, 2, 3, 4}
    path = str(tmp_path)
    told = {r.workspace_id: r for r in contour_layers.replace_contours(lines, sheets(spark), path).collect()}
    assert {i: r.n_lines for i, r in told.items()} == {i: len(got.get(i, ())) for i in range(1, 8)}
    assert all(r.valid and not r.interval_mismatch for i, r in told.items() if i != 4) and told[4].valid
    contour_layers.replace_contours(lines.limit(0), sheets(spark).where("workspace_id = 1"), path)
    assert {r.workspace_id for r in read_layer(spark, path, contour_layers.LAYER).collect()} == {2, 3, 4}


def test_tiles_are_done_once(spark):
    """Cells over which several workspaces of one detail lie are resampled and kept once, and only tiles that are needed."""
    df = spark.createDataFrame([(x, y, v) for (x, y), v in ground().items()], "x long, y long, z double")
    asked = contour_layers.requested_tiles(contours.contour_requests(sheets(spark), F.col("generalization")), FRAME, 8)
    tiles = asked.select("resolution_m", "tx", "ty").distinct()
    cells = contour_layers.tile_cells(df, tiles, FRAME, 8)
    assert cells.count() == cells.select("resolution_m", "x", "y").distinct().count() > 500
    assert cells.join(tiles, ["resolution_m", "tx", "ty"], "left_anti").count() == 0
    shared = asked.groupBy("resolution_m", "tx", "ty").agg(F.countDistinct("workspace_id").alias("n")).where("n > 1").count()
    assert shared > 0


def test_odd_elevation_and_sizes(spark):
    z = [(x, y, 5.0 + x) for x in range(4) for y in range(4)]
    df = spark.createDataFrame([*z[:-1], (3, 3, float("inf"))], "x long, y long, z double")
    assert contours.contour_segments(df, 1.0).where("x = 2 and y = 2").count() == 0
    assert contours.contour_segments(df, 1.0).count() == 8
    sized = sheets(spark).withColumn("size_km", F.expr("case workspace_id when 1 then 0 when 2 then null when 3 then -2 else 1 end"))
    assert {r.workspace_id for r in contours.split_tiles(contours.contour_requests(sized)).collect()} == {4, 5, 6, 7}
    assert contour_layers.workspace_contours(df.limit(0), sheets(spark), FRAME, "soft").count() == 0
    assert contour_layers.workspace_contours(df, sheets(spark).limit(0), FRAME, "soft").count() == 0


def test_requests_meet_what_is_near_them(spark):
    """Each crossing meets all boxes that its cell lies in, once each, and of small boxes in a large tile few others."""
    draw = random.Random(4)
    boxes = [(i, (w := draw.uniform(-3, 60)), (s := draw.uniform(-3, 60)), w + draw.choice([0.3, 2, 5, 80]), s + draw.choice([0.3, 3, 40])) for i in range(60)]
    asked = spark.createDataFrame(boxes, "workspace_id long, west double, south double, east double, north double")
    asked = asked.select("workspace_id", F.struct("west", "south", "east", "north").alias("box"), F.explode(F.sequence(F.floor(F.col("west") / 32), F.floor(F.col("east") / 32))).alias("tx"), "south", "north")
    asked = asked.withColumn("ty", F.explode(F.sequence(F.floor(F.col("south") / 32), F.floor(F.col("north") / 32)))).drop("south", "north")
    cells = spark.range(-5, 70).selectExpr("id x").crossJoin(spark.range(-5, 70).selectExpr("id y")).selectExpr("x", "y", "floor(x / 32) tx", "floor(y / 32) ty")
    got = [(r.workspace_id, r.x, r.y) for r in contour_layers.near(cells, asked, ["tx", "ty"], 32).select("workspace_id", "x", "y").collect()]
    inside = {(i, x, y) for i, w, s, e, n in boxes for x in range(-5, 70) for y in range(-5, 70) if x + 1 > w and x < e and y + 1 > s and y < n}
    assert len(set(got)) == len(got) and inside <= set(got)
    small = {i for i, w, s, e, n in boxes if max(e - w, n - s) <= 3}
    plain = cells.join(asked, ["tx", "ty"]).where(F.col("workspace_id").isin(list(small))).count()
    assert len([g for g in got if g[0] in small]) < plain / 20
