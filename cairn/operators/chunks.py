"""Shapes in chunks: rows (by, chunk, vertices), so that a track of any length is never one array.

A shape's vertices are numbered without a sort of the shape: they are cut into slices of seq, whose counts are added up, and
numbered within them.  All else works on chunks: their ends meet by windows over rows that are one a chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.geometry import extent, flat_positions, positions

#: Vertices of a chunk, and numbers of seq that a slice spans.
SIZE, SPAN = 1024, 100_000
#: Metres of the earth's mean radius.
RADIUS = 6_371_008.8
_FIELDS = ("lng", "lat", "accuracy", "time", "altitude", "altitude_accuracy")


def chunked(vertices: DataFrame, *by: str, size: int = SIZE, span: int = SPAN) -> DataFrame:
    """Vertices (by, seq and the rest) to chunks in order of seq: by, chunk (from 0) and vertices, of which all but the last
    have `size`. Of one seq, vertices go by their values. A shape without vertices has no chunk; null keys are a shape."""
    rows = vertices.select(*by, F.floor(F.coalesce("seq", F.lit(-1)) / span).alias("_slice"), F.struct("seq", *_FIELDS).alias("_v"))
    counts = rows.groupBy(F.struct(*by).alias("_shape"), F.col("_slice").alias("_of")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_shape").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_shape", "_of", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inner = Window.partitionBy(*by, "_slice").orderBy("_v")
    numbered = rows.withColumn("_nth", F.row_number().over(inner) - 1)
    placed = numbered.join(counts, F.struct(*by).eqNullSafe(F.col("_shape")) & (F.col("_slice") == F.col("_of"))).withColumn("_at", F.col("_before") + F.col("_nth"))
    item = F.struct("_at", F.struct(*[F.col(f"_v.{f}") for f in _FIELDS]).alias("v"))
    cut = placed.groupBy(*by, F.floor(F.col("_at") / size).alias("chunk")).agg(F.array_sort(F.collect_list(item)).alias("_items"))
    return cut.select(*by, "chunk", F.transform("_items", lambda i: i["v"]).alias("vertices"))


def _whole(*by: str) -> Window:
    return Window.partitionBy(*by).orderBy("chunk")


def undone(chunks: DataFrame, *by: str) -> DataFrame:
    """Shapes without their last vertex; one that has no other has no chunk then."""
    is_last = F.lead("chunk").over(_whole(*by)).isNull()
    left = F.when(F.col("last"), F.slice("vertices", F.lit(1), F.size("vertices") - 1)).otherwise(F.col("vertices"))
    return chunks.withColumn("last", is_last).withColumn("vertices", left).drop("last").where(F.size("vertices") > 0)


def closed(chunks: DataFrame, *by: str) -> DataFrame:
    """Shapes with their first vertex again at the end, always."""
    first = F.first(F.col("vertices")[0]).over(_whole(*by))
    is_last = F.lead("chunk").over(_whole(*by)).isNull()
    named = chunks.withColumns({"first": first, "last": is_last})
    return named.withColumn("vertices", F.when(F.col("last"), F.array_append("vertices", F.col("first"))).otherwise(F.col("vertices"))).drop("first", "last")


def metres(a: Column, b: Column) -> Column:
    """The great-circle distance of two vertices."""
    up, on = (F.pow(F.sin(F.radians(b[c] - a[c]) / 2), 2) for c in ("lat", "lng"))
    return 2 * RADIUS * F.asin(F.sqrt(up + F.cos(F.radians(a["lat"])) * F.cos(F.radians(b["lat"])) * on))


def measured(chunks: DataFrame, *by: str) -> DataFrame:
    """Of each shape: by, n_vertices, extent and length_m, along its vertices in order."""
    v = F.col("vertices")
    steps = F.transform(F.slice(v, F.lit(2), F.size(v)), lambda b, i: metres(F.get(v, i), b))
    inner = F.aggregate(steps, F.lit(0.0), lambda s, x: s + x)
    on = F.coalesce(metres(F.element_at(v, -1), F.lead(v[0]).over(_whole(*by))), F.lit(0.0))
    each = chunks.select(*by, F.size(v).alias("n"), extent(v).alias("e"), inner.alias("inner"), on.alias("on"))
    box = F.struct(F.min("e.west").alias("west"), F.min("e.south").alias("south"), F.max("e.east").alias("east"), F.max("e.north").alias("north"))
    return each.groupBy(*by).agg(F.sum("n").alias("n_vertices"), box.alias("extent"), F.sum(F.col("inner") + F.col("on")).alias("length_m"))


def complete(chunks: DataFrame, category: Column, *by: str) -> DataFrame:
    """Chunks of areas of three vertices or more, and of lines of two or more."""
    n = F.sum(F.size("vertices")).over(Window.partitionBy(*by))
    return chunks.withColumn("_n", n).where(F.col("_n") >= F.when(category == "area", 3).otherwise(2)).drop("_n")


def pieces(chunks: DataFrame, id: str, *by: str) -> DataFrame:
    """Chunks as pieces of GeoJSON features (see write_collections): by, place, value, starts.

    Columns of chunks: by, an id that names a shape within, category, properties (JSON), chunk, vertices.  Lines have an
    altitude at vertices that have one; areas are rings, which are closed here.  A feature's text is its pieces' in a row.
    """
    shape = Window.partitionBy(*by, id).orderBy("chunk")
    area = F.col("category") == "area"
    ends = chunks.withColumns({"_first": F.first(F.col("vertices")[0]).over(shape), "_last": F.lead("chunk").over(shape).isNull()})
    coords = F.when(area, flat_positions(F.col("vertices"))).otherwise(positions(F.col("vertices")))
    text = F.to_json(coords)
    inner = F.substring(text, F.lit(2), F.length(text) - 2)
    named = F.to_json(F.array(F.col(id)))
    head = F.concat(F.lit('{"type":"Feature","id":'), F.substring(named, F.lit(2), F.length(named) - 2), F.lit(',"properties":'), F.col("properties"), F.lit(',"geometry":{"type":"'), F.when(area, "Polygon").otherwise("LineString"), F.lit('","coordinates":['), F.when(area, "[").otherwise(""))
    back = F.to_json(F.array(F.col("_first")["lng"], F.col("_first")["lat"]))
    tail = F.concat(F.when(area, F.concat(F.lit(","), back, F.lit("]"))).otherwise(""), F.lit("]}}"))
    value = F.concat(F.when(F.col("chunk") == 0, head).otherwise(","), inner, F.when(F.col("_last"), tail).otherwise(""))
    return ends.select(*by, F.struct(F.when(area, 3).otherwise(2).alias("rank"), F.col(id).alias("id"), "chunk").alias("place"), value.alias("value"), (F.col("chunk") == 0).alias("starts"))
