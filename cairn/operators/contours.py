"""Contours: checks and summaries of files, and lines from elevation grids by marching squares.

Grid nodes are whole numbers x, y with elevation z; a level is k times the interval, with k a whole number, so that no
level drifts. A corner is inside if z >= level; a saddle is split by the mean of its corners. End points of segments are
named by the grid edge that they lie on, so segments join exactly, within and between tiles.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.scratch import written

# Metres of detail by level.
DETAIL = {"detailed": 2, "normal": 5, "soft": 10}
INDEX = 5  # every fifth level is an index contour


def _or(*values: Column) -> Column:
    """The first number that is neither missing nor 0."""
    return F.coalesce(*[F.nullif(v, F.lit(0).cast("double")) for v in values])


def validate_contours(features: DataFrame, workspaces: DataFrame | None = None) -> DataFrame:
    """One row a file: valid, n_features, expected and actual interval, interval_mismatch.

    features: file, ordinal (null: no feature), collection_type, features_missing, geometry_type, interval (the
    feature's), collection_interval; workspace_id where workspaces (workspace_id, contour_interval) are given.  An empty
    collection is valid.
    """
    by = ["file", *(["workspace_id"] if workspaces is not None else [])]
    is_line = F.coalesce(F.col("geometry_type") == "LineString", F.col("ordinal").isNull())
    files = features.groupBy(*by).agg(
        F.bool_and(F.coalesce(F.col("collection_type") == "FeatureCollection", F.lit(False)) & ~F.col("features_missing") & is_line).alias("valid"),
        F.count("ordinal").alias("n_features"),
        F.max("collection_interval").alias("_collection"),
        F.min_by("interval", "ordinal").alias("_first"),
    )
    own = F.lit(None).cast("double")
    if workspaces is not None:
        files = files.join(workspaces.select("workspace_id", F.col("contour_interval").alias("_own")), "workspace_id", "left")
        own = F.col("_own")
    expected = _or(own, F.col("_collection"), F.lit(5.0))
    actual = _or(F.col("_collection"), F.col("_first"), F.col("expected"))
    found = files.withColumn("expected", expected).withColumn("actual", actual)
    return found.withColumn("interval_mismatch", F.col("valid") & (F.col("actual") != F.col("expected"))).drop("_collection", "_first", "_own")


def contour_summary(lines: DataFrame, workspaces: DataFrame) -> DataFrame:
    """For each workspace: n_lines and the interval of the workspace, else of its lines' collection, else 5."""
    counts = lines.groupBy("workspace_id").agg(F.count("*").alias("n_lines"), F.max("interval").alias("_interval"))
    joined = workspaces.select("workspace_id", "contour_interval").join(counts, "workspace_id", "left")
    return joined.select("workspace_id", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), _or(F.col("contour_interval"), F.col("_interval"), F.lit(5.0)).alias("interval"))


def contour_requests(workspaces: DataFrame, generalization: str | Column = "soft") -> DataFrame:
    """Jobs: workspace_id, bbox, size_km, interval (the workspace's, else 2.5), generalization, resolution_m."""
    level = F.lit(generalization) if isinstance(generalization, str) else generalization
    metres = F.try_element_at(F.create_map(*[F.lit(x) for kv in DETAIL.items() for x in kv]), level)
    return workspaces.select("workspace_id", "bbox", "size_km", _or(F.col("contour_interval"), F.lit(2.5)).alias("interval"), level.alias("generalization"), metres.alias("resolution_m"))


def split_tiles(requests: DataFrame, tile_m: int = 1000) -> DataFrame:
    """Each request's square in tiles of tile_m metres: tile_x, tile_y from the south-west, and the tile's bbox.

    A request without a size, or of none, has no tiles.
    """
    n = F.ceil(F.col("size_km") * 1000 / tile_m)
    upto = lambda: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    tiles = requests.where("size_km > 0").withColumn("tile_x", upto()).withColumn("tile_y", upto())
    share = tile_m / 1000 / F.col("size_km")
    b = F.col("bbox")
    at = lambda lo, hi, i: lo + (hi - lo) * F.least(i * share, F.lit(1.0))
    box = F.struct(at(b["west"], b["east"], F.col("tile_x")).alias("west"), at(b["south"], b["north"], F.col("tile_y")).alias("south"), at(b["west"], b["east"], F.col("tile_x") + 1).alias("east"), at(b["south"], b["north"], F.col("tile_y") + 1).alias("north"))
    return tiles.withColumn("tile_bbox", box)


def resample_grid(grid: DataFrame, factor: int, *by: str) -> DataFrame:
    """Means over squares of factor x factor nodes."""
    return grid.groupBy(*by, F.floor(F.col("x") / factor).alias("x"), F.floor(F.col("y") / factor).alias("y")).agg(F.avg("z").alias("z"))


def shares(cell: Column, from_m: float, to_m: Column) -> Column:
    """The cells of another size that a cell overlaps along one axis: structs of cell and metres of overlap."""
    low, high = cell * F.lit(float(from_m)), (cell + 1) * F.lit(float(from_m))
    to = to_m.cast("double")
    over = lambda i: F.least(high, (i + 1) * to) - F.greatest(low, i * to)
    each = F.transform(F.sequence(F.floor(low / to), F.ceil(high / to) - 1), lambda i: F.struct(i.alias("cell"), over(i).alias("metres")))
    return F.filter(each, lambda s: s["metres"] > 0)


def overlaps(grid: DataFrame, from_m: float, to_m: Column) -> DataFrame:
    """Each cell (x, y, z) of from_m metres with the cells of to_m metres that it overlaps, as x and y, and the overlap's
    area. Cells without a finite z have none."""
    finite = F.col("z").isNotNull() & ~F.isnan("z") & (F.abs("z") < float("inf"))
    cut = grid.where(finite).withColumn("_i", F.explode(shares(F.col("x"), from_m, to_m))).withColumn("_j", F.explode(shares(F.col("y"), from_m, to_m)))
    return cut.withColumns({"x": F.col("_i.cell"), "y": F.col("_j.cell"), "area": F.col("_i.metres") * F.col("_j.metres")}).drop("_i", "_j")


def weighted_mean() -> Column:
    """Of what overlaps() makes, a cell's mean over the area that is known."""
    return F.sum(F.col("z") * F.col("area")) / F.sum("area")


def resample(grid: DataFrame, from_m: float, to_m: float, *by: str) -> DataFrame:
    """Elevation of cells of from_m metres on cells of to_m metres, of any ratio: means weighted by overlapping areas."""
    return overlaps(grid, from_m, F.lit(to_m)).groupBy(*by, "x", "y").agg(weighted_mean().alias("z"))


#: Sides of a cell: bottom, right, top, left.
_B, _R, _T, _L = range(4)
#: Sides that a level crosses, by which corners are inside (1: south-west, 2: south-east, 4: north-east, 8:
#: north-west). Cases 5 and 10 are saddles, here for a mean outside; a mean inside swaps them.
_CASES = {
    1: [(_L, _B)], 2: [(_B, _R)], 3: [(_L, _R)], 4: [(_R, _T)], 5: [(_L, _B), (_R, _T)], 6: [(_B, _T)], 7: [(_L, _T)],
    8: [(_T, _L)], 9: [(_T, _B)], 10: [(_B, _R), (_T, _L)], 11: [(_T, _R)], 12: [(_R, _L)], 13: [(_R, _B)], 14: [(_B, _L)],
}


def corners(nodes: DataFrame, *by: str) -> DataFrame:
    """Nodes (x, y, z) to cells with all four corners: by, x, y (the south-west one), sw, se, ne, nw.

    Each node goes to the four cells that it's a corner of: one shuffle, by cell, with partial sums instead of three
    joins.  Nodes without a finite z are none.
    """
    corner = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (0, 1) for dy in (0, 1)]))
    finite = F.col("z").isNotNull() & ~F.isnan("z") & (F.abs("z") < float("inf"))
    rows = nodes.where(finite).select(*by, "x", "y", "z", corner.alias("c")).select(*by, (F.col("x") - F.col("c.dx")).alias("x"), (F.col("y") - F.col("c.dy")).alias("y"), "z", "c")
    pick = lambda dx, dy: F.max(F.when((F.col("c.dx") == dx) & (F.col("c.dy") == dy), F.col("z")))
    return rows.groupBy(*by, "x", "y").agg(pick(0, 0).alias("sw"), pick(1, 0).alias("se"), pick(1, 1).alias("ne"), pick(0, 1).alias("nw")).dropna(subset=["sw", "se", "ne", "nw"])


def contour_segments(grid: DataFrame, interval: float, *by: str) -> DataFrame:
    """Segments of all levels: by, x, y (the cell's south-west node), k, and ends x1, y1, e1, x2, y2, e2.

    e1, e2 name the grid edges that the ends lie on, as 'h:x:y' (from node x, y to the east) or 'v:x:y' (to the north).
    Cells without all four corners have none.
    """
    return crossings(corners(grid, *by), interval, *by)


def crossed_levels(cells: DataFrame, interval: float | Column) -> DataFrame:
    """Cells with their corners by level that crosses them: k, level, and segments, an array of the sides a and b that each
    goes from and to.  Rows are made one by one, of a cell alone; the interval may be a column."""
    interval = interval if isinstance(interval, Column) else F.lit(float(interval))
    low, high = F.least("sw", "se", "ne", "nw"), F.greatest("sw", "se", "ne", "nw")
    first, last = F.floor(low / interval) + 1, F.floor(high / interval)  # low < level <= high
    levels = cells.where(first <= last).withColumn("k", F.explode(F.sequence(first, last))).withColumn("level", F.col("k") * interval)
    inside = sum(((F.col(c) >= F.col("level")).cast("int") * w for c, w in (("sw", 1), ("se", 2), ("ne", 4), ("nw", 8))), F.lit(0))
    mean_in = (F.col("sw") + F.col("se") + F.col("ne") + F.col("nw")) / 4 >= F.col("level")
    case = F.when((inside == 5) & mean_in, 10).when((inside == 10) & mean_in, 5).otherwise(inside)
    pairs = F.create_map(*[x for k, segments in _CASES.items() for x in (F.lit(k), F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in segments]))])
    return levels.withColumn("segments", pairs[case]).where("segments is not null")


def crossings(cells: DataFrame, interval: float | Column, *by: str) -> DataFrame:
    """contour_segments of cells with their corners; the interval may be a column of them."""
    cut = crossed_levels(cells, interval).withColumn("s", F.explode("segments"))
    between = lambda a, b: (F.col("level") - F.col(a)) / (F.col(b) - F.col(a))
    x, y = F.col("x"), F.col("y")

    def end(side: Column, i: int) -> list[Column]:
        px = F.when(side == _B, x + between("sw", "se")).when(side == _T, x + between("nw", "ne")).when(side == _L, x).otherwise(x + 1)
        py = F.when(side == _L, y + between("sw", "nw")).when(side == _R, y + between("se", "ne")).when(side == _B, y).otherwise(y + 1)
        name = F.concat_ws(":", F.when(side.isin(_B, _T), "h").otherwise("v"), (x + (side == _R).cast("int")).cast("string"), (y + (side == _T).cast("int")).cast("string"))
        return [px.cast("double").alias(f"x{i}"), py.cast("double").alias(f"y{i}"), name.alias(f"e{i}")]

    return cut.select(*by, "x", "y", "k", *end(F.col("s.a"), 1), *end(F.col("s.b"), 2))


def chains(segments: list[tuple]) -> list[list[tuple]]:
    """Segments (edge, point, edge, point) to chains of (edge, point); an edge ends two segments at most. A closed chain
    begins and ends at its smallest edge; an open one at the smaller of its ends."""
    at: dict = defaultdict(list)
    for i, (a, _, b, _) in enumerate(segments):
        at[a].append(i)
        at[b].append(i)
    used, found = set(), []

    def walk(start):
        chain, edge = [], start
        while True:
            i = next((i for i in at[edge] if i not in used), None)
            if i is None:
                return chain
            used.add(i)
            a, pa, b, pb = segments[i]
            if a != edge:
                a, pa, b, pb = b, pb, a, pa
            chain += ([] if chain else [(a, pa)]) + [(b, pb)]
            edge = b

    for edge in sorted(e for e in at if len(at[e]) == 1):
        chain = walk(edge)
        if chain:
            found.append(chain)
    for edge in sorted(at):
        chain = walk(edge)
        if chain:
            found.append(chain)
    return found


_POINT = "struct<e:string,x:double,y:double>"


def _ranked(following: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ways and the one that follows each (-1: none), the last way of each one's line and the steps up to it; rings are
    opened before their smallest way.  Pointers double, so passes are as many as the logarithm of the longest line."""
    n = len(following)
    to, least = following.copy(), np.arange(n)
    for _ in range(n.bit_length()):
        on = np.flatnonzero(to >= 0)
        if not len(on):
            break
        least[on], to[on] = np.minimum(least[on], least[to[on]]), to[to[on]]
    first = (to >= 0) & (least == np.arange(n))  # what has no end after as many steps as there are ways is a ring
    goes = following >= 0
    goes[goes] = ~first[following[goes]]
    last, steps = np.where(goes, following, np.arange(n)), goes.astype(np.int64)
    while True:
        ahead = last[last]
        if (ahead == last).all():
            return last, steps
        last, steps = ahead, steps + steps[last]


def _linked(rows: pa.Table, group: np.ndarray, by: list[str]) -> pa.RecordBatch:
    """The chains of segments (e1, x1, y1, e2, x2, y2) of many groups at once: by, k, closed, c.

    A segment has two ways, 2i from its first end to its second and 2i + 1 back; a way is followed by the other segment's
    that begins at the edge where it ends.  Of a chain's two directions the one with the larger last way is kept.
    """
    n = len(group)
    ends = pa.chunked_array([rows["e1"].combine_chunks(), rows["e2"].combine_chunks()]).combine_chunks().dictionary_encode()
    code = ends.indices.to_numpy(zero_copy_only=False).astype(np.int64).reshape(2, n).T.ravel()  # by way: the edge where it begins
    at = np.repeat(group, 2) * len(ends.dictionary) + code
    order = np.argsort(at, kind="stable")
    same = np.flatnonzero(at[order[1:]] == at[order[:-1]])
    other = np.full(2 * n, -1)
    other[order[same]], other[order[same + 1]] = order[same + 1], order[same]
    last, steps = _ranked(other[np.arange(2 * n) ^ 1])
    ways = np.flatnonzero(last > last[np.arange(2 * n) ^ 1])
    ways = ways[np.lexsort((-steps[ways], last[ways]))]
    begins = np.flatnonzero(np.r_[True, last[ways[1:]] != last[ways[:-1]]])
    size = np.diff(np.r_[begins, len(ways)])
    # a chain's points: where its first way begins, and where each one ends
    points = np.insert(ways ^ 1, begins, ways[begins])
    first = begins + np.arange(len(begins))
    x, y = (np.stack([rows[f"{c}{i}"].to_numpy() for i in (1, 2)], axis=1).ravel()[points] for c in "xy")
    c = pa.StructArray.from_arrays([pa.DictionaryArray.from_arrays(pa.array(code[points]), ends.dictionary).cast(pa.string()), pa.array(x), pa.array(y)], names=list("exy"))
    lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(points)].astype(np.int32)), c)
    kept = rows.select([*by, "k"]).take(pa.array(ways[begins] // 2))
    closed = pa.array(at[points[first]] == at[points[first + size]])
    return pa.RecordBatch.from_arrays([*(col.combine_chunks() for col in kept.columns), closed, lists], names=[*by, "k", "closed", "c"])


def linked(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.RecordBatch]:
    """Chains of segments that come sorted by their groups (by, k, tx, ty): of all groups that a batch ends at once.

    What is held is a batch and the group that it leaves open.
    """
    keys = [*by, "k", "tx", "ty"]
    held: list[pa.RecordBatch] = []

    def numbered(rows) -> np.ndarray:
        codes = []
        for name in keys:
            col = rows[name] if isinstance(rows, pa.RecordBatch) else rows[name].combine_chunks()
            codes.append(col.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False))
        return np.cumsum(np.r_[False, np.any([c[1:] != c[:-1] for c in codes], axis=0)]).astype(np.int64)

    def done() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        return _linked(rows, numbered(rows), by)

    for batch in batches:
        if not batch.num_rows:
            continue
        if held and any(held[-1][c][-1] != batch[c][0] for c in keys):
            yield done()
            held.clear()
        at = int(np.searchsorted(group := numbered(batch), group[-1]))
        if at:
            held.append(batch.slice(0, at))
            yield done()
            held[:] = [batch.slice(at)]
        else:
            held.append(batch)
    if held:
        yield done()


def _in_tiles(segments: DataFrame, by: list[str], tile: int) -> DataFrame:
    """Chains of segments within tiles: by, k, closed, c (array of e, x, y)."""
    ends = [F.col(f"{c}{i}") if c == "e" else F.col(f"{c}{i}").cast("double").alias(f"{c}{i}") for i in (1, 2) for c in "exy"]
    parts = segments.select(*by, "k", F.floor(F.col("x") / tile).alias("tx"), F.floor(F.col("y") / tile).alias("ty"), *ends)
    kind, keys = dict(segments.dtypes), [*by, "k", "tx", "ty"]
    schema = ", ".join([f"`{c}` {kind[c]}" for c in by] + [f"k {kind['k']}, closed boolean, c array<{_POINT}>"])
    return parts.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lambda batches: linked(batches, by), schema)


def _doubled(steps: DataFrame) -> DataFrame:
    """Of directed chains (id, to: the next one, null at an end; least, n), with n = 1 at first: least over all that follow,
    itself included, and n, their number (of a ring: any number beyond its size).

    Pointers double: each pass looks twice as far and is a written table, so it takes as many as the logarithm of the
    longest line.  It ends when nothing changes: then every line is at its end, or is a ring and has been around.
    """
    now, before = written(steps), None
    while True:
        mark = now.agg(F.count("to").alias("open"), F.sum(F.xxhash64("id", "least").cast("decimal(38,0)")).alias("least")).first()
        if not mark.open or mark == before:
            return now
        before = mark
        ahead = now.select(F.col("id").alias("to"), F.col("to").alias("_to"), F.col("least").alias("_least"), F.col("n").alias("_n"))
        now = written(now.join(ahead, "to", "left").select("id", F.col("_to").alias("to"), F.least("least", "_least").alias("least"), (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n")))


def across_seams(ends: DataFrame, by: list[str]) -> DataFrame:
    """Where open chains (chain, by, k, a, b: the edges that they begin and end at) come in their lines: chain, line,
    place (from 0), flip (whether it runs against the line).

    A chain is walked in two directions, 2 chain and 2 chain + 1.  The next one begins at the edge where it ends; rings are
    opened before their smallest chain.  Of a line's two directions the one counts whose first chain is the smaller.
    """
    way = lambda flip, enter, leave: ends.select(*by, "k", (F.col("chain") * 2 + flip).alias("id"), F.col(enter).alias("enter"), F.col(leave).alias("leave"))
    ways = way(0, "a", "b").unionByName(way(1, "b", "a"))
    following = ways.select(*by, "k", F.col("enter").alias("leave"), F.col("id").alias("to"))
    met = ways.join(following, [*by, "k", "leave"], "left")
    other = F.floor(F.col("to") / 2) != F.floor(F.col("id") / 2)
    steps = met.groupBy("id").agg(F.max(F.when(other, F.col("to"))).alias("to"))
    chain = F.floor(F.col("id") / 2)
    seen = _doubled(steps.select("id", "to", chain.alias("least"), F.lit(1).cast("long").alias("n")))
    rings = seen.where("to is not null").select(F.col("id"), (F.floor(F.col("id") / 2) == F.col("least")).alias("first"))
    firsts = written(rings.where("first").select(F.col("id").alias("to")))
    cut = steps.join(firsts, "to", "left_anti").unionByName(steps.join(firsts, "to", "left_semi").select("id", F.lit(None).cast("long").alias("to")))
    # counted to their ends, with the last one as the line's name
    placed = _doubled(cut.select("id", "to", F.when(F.col("to").isNull(), F.col("id")).alias("least"), F.lit(1).cast("long").alias("n")))
    # the two directions of a line end at its two outer chains: the one that ends at the larger end is kept
    back = placed.select((F.col("id").bitwiseXOR(F.lit(1))).alias("id"), F.col("least").alias("_least"))
    kept = placed.join(back, "id").where((F.col("least") > F.col("_least")) | ((F.col("least") == F.col("_least")) & (F.col("id") % 2 == 0)))
    return kept.select(F.floor(F.col("id") / 2).alias("chain"), F.col("least").alias("line"), (-F.col("n")).alias("place"), (F.col("id") % 2 == 1).alias("flip"))


def contour_lines(segments: DataFrame, interval: float | Column, *by: str, tile: int = 256) -> DataFrame:
    """Lines (interval: a number, or a column of by): by, elevation, interval, index_contour, closed, coordinates (array of struct x, y).

    Segments are chained within tiles of `tile` cells, by level.  Chains that are open there are numbered, and their ends
    alone are joined at the seams between tiles; their points are put together once, by line.  So no task holds more than
    a tile or a line, wherever the grid's origin is.  A closed line begins and ends at its smallest edge (by name) and goes
    on to the smaller of the two edges next to it; an open one begins at the smaller of its ends: lines don't depend on
    tiles.
    """
    keys = list(by)
    interval = interval if isinstance(interval, Column) else F.lit(float(interval))
    parts = written(_in_tiles(segments, keys, tile).withColumn("chain", F.monotonically_increasing_id()))
    open_ = parts.where("not closed")
    places = across_seams(open_.select(*keys, "k", "chain", F.col("c")[0]["e"].alias("a"), F.element_at("c", -1)["e"].alias("b")), keys)
    turned = open_.join(places, "chain").withColumn("c", F.when(F.col("flip"), F.reverse("c")).otherwise(F.col("c")))
    lines = turned.groupBy(*keys, "k", "line").agg(F.array_sort(F.collect_list(F.struct("place", "c"))).alias("cs"))
    joint = F.flatten(F.transform("cs", lambda s, i: F.when(i == 0, s["c"]).otherwise(F.slice(s["c"], F.lit(2), F.size(s["c"])))))
    whole = parts.where("closed").select(*keys, "k", "c").unionByName(lines.select(*keys, "k", joint.alias("c")))
    edges = F.transform("c", lambda p: p["e"])
    whole = whole.withColumn("closed", F.col("c")[0]["e"] == F.element_at("c", -1)["e"])
    at = F.array_position(edges, F.array_min(edges)).cast("int")
    ring = F.concat(F.slice("c", at, F.size("c") - at), F.slice("c", F.lit(1), at))
    whole = whole.withColumn("c", F.when(F.col("closed"), ring).otherwise(F.col("c")))
    second = F.when(F.col("closed"), F.try_element_at("c", F.lit(-2))["e"] < F.col("c")[1]["e"]).otherwise(F.element_at("c", -1)["e"] < F.col("c")[0]["e"])
    whole = whole.withColumn("c", F.when(second, F.reverse("c")).otherwise(F.col("c")))
    return whole.select(*keys, (F.col("k") * interval).alias("elevation"), interval.alias("interval"), (F.col("k") % INDEX == 0).alias("index_contour"), "closed", F.transform("c", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("coordinates"))
