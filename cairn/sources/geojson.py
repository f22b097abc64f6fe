"""GeoJSON in and out. Geometries stay JSON text, as their nesting differs by type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions.geometry import closed, flat_positions, positions, samples
from cairn.functions.text import iso_utc

_FEATURE = "struct<type:string,id:string,properties:string,geometry:string>"
_COLLECTION = f"type string, properties string, features array<{_FEATURE}>"
_NESTING = {"Point": "array<double>", "LineString": "array<array<double>>", "Polygon": "array<array<array<double>>>"}


def read_features(spark: SparkSession, path: str, lines: bool = False, packed: bool = False) -> DataFrame:
    """One row a feature: file, ordinal, id, properties and geometry (JSON), geometry_type, collection_type,
    collection_properties.

    Collections are one JSON document a file; an empty one gives one row without a feature (ordinal null), one whose
    features are missing too (features_missing is true).  With lines, each line is a feature, which Spark can split.  With
    packed, each line is a collection, which Spark can split too; name is then one more column, of the collection's name.
    """
    if lines:
        rows = spark.read.schema("type string, id string, properties string, geometry string").json(path)
        found = rows.select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("ordinal"), "id", "properties", "geometry", F.lit(None).cast("string").alias("collection_type"), F.lit(None).cast("string").alias("collection_properties"), F.lit(False).alias("features_missing"))
    else:
        rows = spark.read.schema(_COLLECTION).json(path, lineSep="\n") if packed else spark.read.schema(_COLLECTION).json(path, multiLine=True)
        name = [F.get_json_object("properties", "$.name").alias("name")] if packed else []
        opened = rows.select(*name, F.input_file_name().alias("file"), F.col("type").alias("collection_type"), F.col("properties").alias("collection_properties"), F.col("features").isNull().alias("features_missing"), F.posexplode_outer("features").alias("ordinal", "f"))
        found = opened.select("file", F.col("ordinal").cast("long").alias("ordinal"), "f.id", "f.properties", "f.geometry", "collection_type", "collection_properties", "features_missing", *(["name"] if packed else []))
    return found.withColumn("geometry_type", F.get_json_object("geometry", "$.type"))


def coordinates(geometry: Column, kind: str) -> Column:
    """The coordinates of a Point, LineString or Polygon, as nested arrays; null for other types."""
    read = F.from_json(geometry, f"type string, coordinates {_NESTING[kind]}")
    return F.when(read["type"] == kind, read["coordinates"])


def read_workspaces(spark: SparkSession, path: str) -> DataFrame:
    """Workspaces of JSON arrays; a missing or empty symbol mode is print."""
    schema = "id string, name string, scale int, contourInterval double, symbolDisplayMode string, sizeKm int, center struct<lat:double,lng:double>, createdAt timestamp, updatedAt timestamp, standard string"
    rows = spark.read.schema(schema).json(path, multiLine=True)
    return rows.select("id", "name", "scale", F.col("contourInterval").alias("contour_interval"), F.coalesce(F.nullif("symbolDisplayMode", F.lit("")), F.lit("print")).alias("symbol_display_mode"), F.col("sizeKm").alias("size_km"), "center", F.col("createdAt").alias("created_at"), F.col("updatedAt").alias("updated_at"), "standard")


def read_field_store(spark: SparkSession, path: str, live_path: str | None = None, lines: bool = False) -> DataFrame:
    """Stored objects of contributors' documents (contributorId, observations, tracks, areas), before normalisation.

    A contributor's global document counts as a whole, or else the live one; missing arrays are empty.  Columns:
    contributor, category, ordinal, and an object's fields; coordinates stay JSON text.  A document is a file, or a line.
    """
    item = "struct<id:string,observationId:string,contributorId:string,syncStatus:string,version:int,objectType:string,type:string,symbol:string,coordinates:string,accuracy:double,source:string,quality:string,createdAt:string>"
    schema = f"contributorId string, observations array<{item}>, tracks array<{item}>, areas array<{item}>"
    docs = spark.read.schema(schema).json(path, multiLine=not lines)
    if live_path is not None:
        live = spark.read.schema(schema).json(live_path, multiLine=not lines)
        docs = docs.unionByName(live.join(docs.select("contributorId"), "contributorId", "left_anti"))
    parts = [docs.select(F.col("contributorId").alias("contributor"), F.lit(c).alias("category"), F.posexplode(array).alias("ordinal", "o")) for c, array in (("point", "observations"), ("line", "tracks"), ("area", "areas"))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    names = {"id": "id", "observationId": "observation_id", "contributorId": "contributor_id", "syncStatus": "sync_status", "version": "version", "objectType": "object_type", "type": "type", "symbol": "symbol", "coordinates": "coordinates", "accuracy": "accuracy", "source": "source", "quality": "quality", "createdAt": "created_at"}
    return rows.select("contributor", "category", "ordinal", *[F.col(f"o.{a}").alias(b) for a, b in names.items()])


def export_features(objects: DataFrame, keep_columns: tuple[str, ...] = ("workspace_id",)) -> DataFrame:
    """Each object as a GeoJSON feature: id, category, ordinal, geometry and properties (both JSON text), and those of
    keep_columns that objects has.

    objects: id, category, object_type, symbol, source, quality, created_at (timestamp), coordinates (vertices) and for
    points observation_id, contributor_id, sync_status, version, accuracy.  A point keeps all its fields; lines keep
    samples and are 3D at vertices with an altitude; areas are closed rings in 2D.  Explicit nulls stay.
    """
    keep = {"ignoreNullFields": "false"}
    c, made = F.col("coordinates"), iso_utc(F.col("created_at"))
    shape = lambda kind, coords: F.to_json(F.struct(F.lit(kind).alias("type"), coords.alias("coordinates")))
    geometry = F.when(F.col("category") == "point", shape("Point", flat_positions(c)[0])).when(F.col("category") == "line", shape("LineString", positions(c))).otherwise(shape("Polygon", F.array(closed(flat_positions(c)))))
    shared = [F.col("object_type").alias("objectType"), F.col("symbol")]
    rest = [F.col("source"), F.col("quality"), made.alias("createdAt")]
    point = F.to_json(F.struct(F.col("id"), F.col("observation_id").alias("observationId"), F.col("contributor_id").alias("contributorId"), F.col("sync_status").alias("syncStatus"), F.col("version"), *shared, F.col("accuracy"), *rest), keep)
    line = F.to_json(F.struct(*shared, F.lit("line").alias("category"), *rest, samples(c).alias("samples")), keep)
    area = F.to_json(F.struct(*shared, F.lit("area").alias("category"), *rest), keep)
    ordinal = [F.col("ordinal")] if "ordinal" in objects.columns else [F.lit(None).cast("long").alias("ordinal")]
    return objects.select("id", "category", *ordinal, geometry.alias("geometry"), F.when(F.col("category") == "point", point).when(F.col("category") == "line", line).otherwise(area).alias("properties"), *[c for c in keep_columns if c in objects.columns])


def feature_text(id: Column, properties: Column, geometry: Column) -> Column:
    return F.concat(F.lit('{"type":"Feature","id":'), F.to_json(F.array(id)).substr(F.lit(2), F.length(F.to_json(F.array(id))) - 2), F.lit(',"properties":'), properties, F.lit(',"geometry":'), geometry, F.lit("}"))


def write_geojson(features: DataFrame, path: str, by: str | None = None, app: str = "field-map", packed: bool = False) -> None:
    """Features as lines of JSON; or with `by`, one FeatureCollection a value of that column, points first, then lines and
    areas, in stored order: in a folder <by>=<value> of its own, or packed, a line of a file of many (see write_collections)."""
    text = features.withColumn("value", feature_text(F.col("id"), F.col("properties"), F.col("geometry")))
    if by is None:
        text.select("value").write.text(path)
        return
    rank = F.array_position(F.array(F.lit("point"), F.lit("line"), F.lit("area")), F.col("category"))
    placed = text.withColumn("place", F.struct(rank.alias("rank"), F.coalesce("ordinal", F.lit(0)).alias("ordinal"), F.col("id").alias("id"), F.col("value").alias("value")))
    write_collections(placed, path, by, F.lit(True), app, packed)


def write_collections(pieces: DataFrame, path: str, by: str, starts: Column, app: str, packed: bool = False) -> None:
    """One document a value of `by`, of pieces of text (value) in the order of place; starts: whether a piece begins a feature.

    A document's pieces are lines of one file, which a task writes as they come, sorted: header and first feature, the
    others, the last one and the footer.  So no task holds a collection, and a file is there once its task has committed.
    Values of by without a piece have no document.

    A file a document is too many files where documents are many and small.  Packed, a task writes all of its documents to
    one file, each a line, of pieces with a space after each; a document's name, in its properties, is its value of by.
    """
    head = '{"type":"FeatureCollection","properties":{"app":"%s","version":6,"standard":"ISOM 2017-2 v6"' % app
    order = Window.partitionBy(by).orderBy("place")
    placed = pieces.withColumn("starts", starts).withColumns({"nth": F.row_number().over(order), "more": F.lead("starts").over(order).isNotNull()})
    name = F.to_json(F.array(F.col(by).cast("string")))
    named = F.concat(F.lit(head + ',"name":'), name.substr(F.lit(2), F.length(name) - 2))
    # no brace in the header but its own: readers that cut at closing braces find it whole
    start = F.replace(named, F.lit("}"), F.lit("\\u007d")) if packed else F.lit(head)
    before = F.when(F.col("nth") == 1, F.concat(start, F.lit('},"features":['))).when(F.col("starts"), ",").otherwise("")
    value = F.translate("value", "\r\n", "  ") if packed else F.col("value")
    lines = placed.select(by, F.concat(before, value, F.when(F.col("more"), "").otherwise("]}\n" if packed else "]}")).alias("value"))
    if packed:
        lines.select("value").write.option("maxRecordsPerFile", 0).option("lineSep", " ").text(path)
    else:
        lines.write.partitionBy(by).option("maxRecordsPerFile", 0).text(path)
