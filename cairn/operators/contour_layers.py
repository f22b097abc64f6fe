"""From elevation and workspaces to stored contour layers.

Elevation is cells of one size in a frame of metres that is laid over degrees.  Workspaces ask for a detail and an interval;
what they ask for is dealt to square tiles of cells of that detail, and a tile that several workspaces lie over is resampled
and crossed once.  A tile has the cells of its squares' corners too, one more row and column at its north and east, so tiles
are done by themselves.  The crossings go to the workspaces over the tile, are clipped to their boxes, joined to lines, and
replace the workspaces' layers.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.contours import contour_lines, contour_requests, contour_summary, corners, crossings, overlaps, validate_contours, weighted_mean
from cairn.scratch import written
from cairn.sources.layers import read_layer, write_layer

#: The layer's name, and cells of a tile's side.
LAYER, TILE = "contours", 256


@dataclass(frozen=True)
class Frame:
    """Where metres 0, 0 lie, how many metres a degree has there, and the size of elevation's cells."""

    west: float
    south: float
    metres_east: float
    metres_north: float
    cell_m: float

    def east_m(self, lng: Column) -> Column:
        return (lng - F.lit(self.west)) * F.lit(self.metres_east)

    def north_m(self, lat: Column) -> Column:
        return (lat - F.lit(self.south)) * F.lit(self.metres_north)

    def lng(self, east_m: Column) -> Column:
        return F.lit(self.west) + east_m / F.lit(self.metres_east)

    def lat(self, north_m: Column) -> Column:
        return F.lit(self.south) + north_m / F.lit(self.metres_north)


def requested_tiles(requests: DataFrame, frame: Frame, tile: int = TILE) -> DataFrame:
    """Each request (see contour_requests) by tile: workspace_id, resolution_m, interval, box, tx, ty.

    A cell's elevation holds at its middle, so box is in numbers of middles: 0 is half a cell from the frame's edge.  A request
    without a box, detail or interval has no tiles.
    """
    b, r = F.col("bbox"), F.col("resolution_m")
    at = {"west": frame.east_m(b["west"]), "south": frame.north_m(b["south"]), "east": frame.east_m(b["east"]), "north": frame.north_m(b["north"])}
    box = F.struct(*[(m / r - 0.5).alias(side) for side, m in at.items()])
    boxed = requests.where("bbox is not null and resolution_m > 0 and interval > 0").select("workspace_id", "resolution_m", "interval", box.alias("box"))
    boxed = boxed.where("box.west < box.east and box.south < box.north")
    span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / tile), F.floor(F.col(hi) / tile)))
    return boxed.withColumn("tx", span("box.west", "box.east")).withColumn("ty", span("box.south", "box.north"))


def tile_cells(elevation: DataFrame, tiles: DataFrame, frame: Frame, tile: int = TILE) -> DataFrame:
    """Squares between the middles of resampled cells, with their corners: resolution_m, tx, ty, x, y, sw, se, ne, nw.

    tiles: resolution_m, tx, ty, each once.  Elevation (x, y, z) that no tile needs is left out before anything is shuffled
    by cell; a resampled cell at a tile's south or west edge is also one of the tile before, as its halo.
    """
    levels = [r[0] for r in tiles.select("resolution_m").distinct().collect()]  # the details that there are: three
    kinds = F.array(*[F.lit(x) for x in levels]) if levels else F.array().cast("array<int>")
    parts = overlaps(elevation.withColumn("resolution_m", F.explode(kinds)), frame.cell_m, F.col("resolution_m"))
    here = lambda c: F.floor(F.col(c) / tile)
    both = lambda c: F.when(F.pmod(F.col(c), F.lit(tile)) == 0, F.array(here(c), here(c) - 1)).otherwise(F.array(here(c)))
    dealt = parts.withColumn("tx", F.explode(both("x"))).withColumn("ty", F.explode(both("y")))
    kept = dealt.join(tiles, ["resolution_m", "tx", "ty"], "left_semi")
    by = ["resolution_m", "tx", "ty"]
    cells = corners(kept.groupBy(*by, "x", "y").agg(weighted_mean().alias("z")), *by)
    return cells.where((F.floor(F.col("x") / tile) == F.col("tx")) & (F.floor(F.col("y") / tile) == F.col("ty")))


def clipped(segments: DataFrame, box: Column) -> DataFrame:
    """Segments (x1, y1, e1 to x2, y2, e2) cut at the edges of a box; what only touches it goes. A cut end's name is its own."""
    x1, y1, dx, dy = F.col("x1"), F.col("y1"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    # for each edge: how fast the segment leaves across it, and how much room there is
    edges = [(-dx, x1 - box["west"]), (dx, box["east"] - x1), (-dy, y1 - box["south"]), (dy, box["north"] - y1)]
    outside = reduce(lambda a, b: a | b, [(p == 0) & (q < 0) for p, q in edges])
    enters = F.greatest(F.lit(0.0), *[F.when(p < 0, q / p) for p, q in edges])
    leaves = F.least(F.lit(1.0), *[F.when(p > 0, q / p) for p, q in edges])
    rows = segments.withColumns({"_from": enters, "_to": leaves, "_out": outside}).where(~F.col("_out") & (F.col("_from") < F.col("_to")))
    first, last = F.col("_from") > 0, F.col("_to") < 1
    cut = lambda i: F.concat_ws(":", F.lit("b"), "e1", "e2", F.lit(i))
    return rows.withColumns({
        "x1": F.when(first, x1 + F.col("_from") * dx).otherwise(x1), "y1": F.when(first, y1 + F.col("_from") * dy).otherwise(y1),
        "x2": F.when(last, x1 + F.col("_to") * dx).otherwise(F.col("x2")), "y2": F.when(last, y1 + F.col("_to") * dy).otherwise(F.col("y2")),
        "e1": F.when(first, cut("1")).otherwise(F.col("e1")), "e2": F.when(last, cut("2")).otherwise(F.col("e2")),
    }).drop("_from", "_to", "_out")


def near(crossed: DataFrame, asked: DataFrame, by: list[str], tile: int = TILE) -> DataFrame:
    """Crossings (by, x, y) with the requests (by, tx, ty, box) whose boxes they may lie in.

    A request is dealt to squares about as large as its box, of two to four at most along a side, within its tile; a crossing
    looks in its square of each size that its tile has.  So small boxes don't meet all that their tile holds.
    """
    side = F.greatest(F.col("box.east") - F.col("box.west"), F.col("box.north") - F.col("box.south"), F.lit(1.0))
    sized = asked.withColumn("_size", F.least(F.pow(F.lit(2.0), F.ceil(F.log2(side))), F.lit(float(tile))).cast("long"))
    square = lambda v: F.floor(v / F.col("_size"))
    within = lambda lo, hi, t: F.explode(F.sequence(square(F.greatest(F.floor(F.col(lo)), F.col(t) * tile)), square(F.least(F.floor(F.col(hi)), (F.col(t) + 1) * tile - 1))))
    dealt = sized.withColumn("_sx", within("box.west", "box.east", "tx")).withColumn("_sy", within("box.south", "box.north", "ty"))
    sizes = sized.groupBy(*by).agg(F.collect_set("_size").alias("_sizes"))
    looking = crossed.join(sizes, by).withColumn("_size", F.explode("_sizes")).withColumns({"_sx": square(F.col("x")), "_sy": square(F.col("y"))})
    return looking.join(dealt, [*by, "_size", "_sx", "_sy"]).drop("_sizes", "_size", "_sx", "_sy")


def workspace_segments(elevation: DataFrame, requests: DataFrame, frame: Frame, tile: int = TILE) -> DataFrame:
    """The contours' segments within each workspace's box: workspace_id, resolution_m, interval, x, y, k and ends as of
    contour_segments, in numbers of cells' middles."""
    asked = written(requested_tiles(requests, frame, tile))
    cells = tile_cells(elevation, asked.select("resolution_m", "tx", "ty").distinct(), frame, tile)
    by = ["resolution_m", "tx", "ty", "interval"]
    crossed = crossings(cells.join(asked.select(*by).distinct(), by[:3]), F.col("interval"), *by)
    return clipped(near(crossed, asked, by, tile), F.col("box")).select("workspace_id", "resolution_m", "interval", "x", "y", "k", "x1", "y1", "e1", "x2", "y2", "e2")


def workspace_contours(elevation: DataFrame, workspaces: DataFrame, frame: Frame, generalization: str | Column = "soft", tile: int = TILE) -> DataFrame:
    """Contour lines of each workspace (workspace_id, bbox, size_km, contour_interval), clipped to its box, in degrees.

    Columns workspace_id, ordinal (from 0, by elevation and then by coordinates), elevation, interval, index_contour, closed,
    coordinates (array of struct lng, lat) and geometry_type.  elevation: x, y, z, of cells of the frame's size.
    """
    requests = contour_requests(workspaces, generalization)
    segments = workspace_segments(elevation, requests, frame, tile).withColumnRenamed("interval", "step")
    lines = contour_lines(segments, F.col("step"), "workspace_id", "resolution_m", "step", tile=tile)
    metres = lambda u: (u + 0.5) * F.col("resolution_m")
    degrees = F.transform("coordinates", lambda p: F.struct(frame.lng(metres(p["x"])).alias("lng"), frame.lat(metres(p["y"])).alias("lat")))
    order = Window.partitionBy("workspace_id").orderBy("elevation", "coordinates")
    found = lines.withColumn("coordinates", degrees).withColumn("ordinal", F.row_number().over(order) - 1)
    return found.select("workspace_id", "ordinal", "elevation", "interval", "index_contour", "closed", "coordinates", F.lit("LineString").alias("geometry_type"))


def replace_contours(lines: DataFrame, workspaces: DataFrame, path: str) -> DataFrame:
    """Stores lines as the contour layer of the workspaces, in place of what they had, and says what is stored then.

    A row a workspace: workspace_id, valid and interval_mismatch (see validate_contours), n_lines and interval (see
    contour_summary).  A workspace without lines has an empty layer, which is valid.
    """
    write_layer(lines, path, LAYER, workspaces)
    stored = read_layer(workspaces.sparkSession, path, LAYER)
    of = workspaces.select("workspace_id", "contour_interval")
    features = of.select("workspace_id").join(stored, "workspace_id", "left").select(F.col("workspace_id").alias("file"), "workspace_id", "ordinal", F.lit("FeatureCollection").alias("collection_type"), F.lit(False).alias("features_missing"), "geometry_type", "interval", F.col("interval").alias("collection_interval"))
    checked = validate_contours(features, of).select("workspace_id", "valid", "interval_mismatch")
    return contour_summary(stored, of).join(checked, "workspace_id")
