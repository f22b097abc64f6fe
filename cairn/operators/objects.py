"""Field objects: clean-up, gates, catalogue, counts and edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.catalog import catalog, default_type, resolved_alias, truthy
from cairn.functions.gps import LIMIT
from cairn.operators import scan


def _catalogued(objects: DataFrame, how: str) -> DataFrame:
    known = catalog(objects.sparkSession).select("category", "object_type")
    return objects.join(F.broadcast(known), ["category", "object_type"], how)


def normalize_objects(objects: DataFrame) -> DataFrame:
    """Types by alias and catalogue, and identity fields, with defaults.

    Reads category, object_type and, where there are such columns, type, id, observation_id, contributor_id,
    sync_status, version, file, ordinal.  Empty strings and version 0 count as missing.  symbol stays as read, so it can
    disagree with a type that fell back to the category's default.  A missing id is a hash of the row, so that re-runs
    and retries agree.
    """
    has = set(objects.columns)
    column = lambda name: truthy(F.col(name).cast("string")) if name in has else F.lit(None).cast("string")
    known = catalog(objects.sparkSession).select(F.col("category").alias("_c"), F.col("object_type").alias("_t"))
    row = F.sha2(F.to_json(F.struct(*objects.columns)), 256)
    named = objects.withColumns({"_row": row, "_type": resolved_alias(F.coalesce(column("object_type"), column("type")))})
    joined = named.join(F.broadcast(known), (F.col("category") == F.col("_c")) & (F.col("_type") == F.col("_t")), "left")
    typed = joined.withColumn("object_type", F.coalesce("_t", default_type(F.col("category")))).drop("_c", "_t", "_type")
    observation = F.coalesce(column("observation_id"), column("id"), F.col("_row"))
    return typed.withColumns({
        "observation_id": observation,
        "id": F.coalesce(column("id"), observation),
        "contributor_id": F.coalesce(column("contributor_id"), F.lit("legacy-local")),
        "sync_status": F.coalesce(column("sync_status"), F.lit("local")),
        "version": F.coalesce(F.nullif(F.col("version"), F.lit(0)), F.lit(1)).cast("int") if "version" in has else F.lit(1),
    }).drop("_row")


def accept_points(points: DataFrame) -> DataFrame:
    """Drops GPS points of an accuracy over 50 m; manual points and unknown accuracies pass."""
    return points.where(~F.coalesce((F.col("source") == "gps") & (F.col("accuracy") > LIMIT), F.lit(False)))


def accept_fixes(fixes: DataFrame) -> DataFrame:
    """Fixes that may become vertices: of an accuracy of 50 m or better."""
    return fixes.where((F.col("accuracy") <= LIMIT) & ~F.isnan("accuracy"))


def complete_shapes(shapes: DataFrame) -> DataFrame:
    """Areas of three vertices or more, lines of two or more."""
    return shapes.where(F.size("coordinates") >= F.when(F.col("category") == "area", 3).otherwise(2))


def catalog_lookup(objects: DataFrame) -> DataFrame:
    """Adds catalog_symbol and label; an unknown type has symbol '' and its id as label."""
    joined = objects.join(F.broadcast(catalog(objects.sparkSession)), ["category", "object_type"], "left")
    return joined.withColumns({"catalog_symbol": F.coalesce("catalog_symbol", F.lit("")), "label": F.coalesce("label", "object_type")})


def unknown_types(objects: DataFrame) -> DataFrame:
    """Objects whose type isn't in the catalogue of their category."""
    return _catalogued(objects, "left_anti")


def known_types(objects: DataFrame) -> DataFrame:
    return _catalogued(objects, "left_semi")


def delete_objects(objects: DataFrame, deletions: DataFrame) -> DataFrame:
    """Objects without those whose id is in deletions."""
    return objects.join(deletions.select("id").distinct(), "id", "left_anti")


def all_objects(points: DataFrame, lines: DataFrame, areas: DataFrame) -> DataFrame:
    """Points, lines and areas in one table, repeats kept; columns that one lacks are null there."""
    return points.unionByName(lines, allowMissingColumns=True).unionByName(areas, allowMissingColumns=True)


def object_counts(objects: DataFrame, *by: str) -> DataFrame:
    """The number of objects, by columns."""
    return objects.groupBy(*by).agg(F.count("*").alias("n_objects"))


def current_objects(objects: DataFrame, edits: DataFrame) -> DataFrame:
    """Objects after a log of edits (id, ts, seq, action move, move_vertex or delete; index, lng, lat).

    A moved point takes the last position and the source manual-adjustment; a moved vertex takes lng and lat only, the
    last of each index counts; a deleted object is gone whatever came after.  Versions are never raised.  objects has
    id, category, source and coordinates: an array of vertices, one of them for a point.
    """
    order = F.struct("ts", "seq")
    moved = edits.where("action = 'move'").groupBy("id").agg(F.max_by(F.struct("lng", "lat"), order).alias("_to"))
    vertices = edits.where("action = 'move_vertex'").groupBy("id", "index").agg(F.max_by(F.struct("lng", "lat"), order).alias("to"))
    by_index = vertices.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("index", "to"))).alias("_vertices"))
    kept = objects.join(edits.where("action = 'delete'").select("id").distinct(), "id", "left_anti")
    joined = kept.join(moved, "id", "left").join(by_index, "id", "left")
    is_point = (F.col("category") == "point") & F.col("_to").isNotNull()

    def at(v, i):
        to = F.when(is_point, F.col("_to")).otherwise(F.try_element_at("_vertices", i))
        return F.when(to.isNull(), v).otherwise(v.withField("lng", to["lng"]).withField("lat", to["lat"]))

    return joined.withColumns({"coordinates": F.transform("coordinates", at), "source": F.when(is_point, "manual-adjustment").otherwise(F.col("source"))}).drop("_to", "_vertices")


def vertex_samples(objects: DataFrame) -> DataFrame:
    """A row for each vertex: id, ordinal (from 0), accuracy, time, altitude, altitude_accuracy."""
    rows = objects.select("id", F.posexplode("coordinates").alias("ordinal", "v"))
    return rows.select("id", "ordinal", "v.accuracy", "v.time", "v.altitude", "v.altitude_accuracy")


def gps_gaps(fixes: DataFrame, seconds: int = 15, slice_seconds: int = scan.SLICE) -> DataFrame:
    """Adds gap_s (seconds since the device's fix before), lost (over `seconds`) and run (from 0, one more after each loss).

    Histories are cut into slices, each of which hands on the time of its last fix and its number of losses.
    """
    micros = F.unix_micros(F.col("received_at").cast("timestamp"))
    inner = Window.partitionBy("device_id", "slice").orderBy("received_at", "seq")
    rows = fixes.withColumn("slice", scan.slice_of(fixes, "received_at", slice_seconds)).withColumn("_at", micros)
    rows = rows.withColumn("_gap", F.col("_at") - F.lag("_at").over(inner)).withColumn("_nth", F.row_number().over(inner))
    lost = lambda gap: F.coalesce(gap > seconds * 1_000_000, F.lit(False))
    each = rows.groupBy("device_id", "slice").agg(F.min("_at").alias("_from"), F.max("_at").alias("_to"), F.count_if(lost(F.col("_gap"))).alias("_n"))
    device = Window.partitionBy("device_id").orderBy("slice")
    each = each.withColumn("_since", F.col("_from") - F.lag("_to").over(device))
    total = F.col("_n") + lost(F.col("_since")).cast("long")
    carry = each.select(F.col("device_id").alias("_device"), F.col("slice").alias("_slice"), "_since", F.coalesce(F.sum(total).over(scan.before("device_id")), F.lit(0)).alias("_runs"))
    both = rows.join(carry, F.col("device_id").eqNullSafe(F.col("_device")) & (F.col("slice") == F.col("_slice")))
    gap = F.when(F.col("_nth") == 1, F.col("_since")).otherwise(F.col("_gap"))
    marked = both.withColumn("gap_s", gap / 1e6).withColumn("lost", lost(gap))
    run = F.col("_runs") + F.sum(F.col("lost").cast("long")).over(inner.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("run", run).select(*fixes.columns, "gap_s", "lost", "run")
