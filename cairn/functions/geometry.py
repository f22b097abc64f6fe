"""Coordinate arrays. A vertex is a struct of lng, lat, accuracy, time, altitude and altitude_accuracy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VERTEX = "struct<lng:double,lat:double,accuracy:double,time:bigint,altitude:double,altitude_accuracy:double>"
BBOX = "struct<west:double,south:double,east:double,north:double>"
#: Kilometres a degree of latitude.
KM = 111.32


def swapped(pairs: Column) -> Column:
    """[lng, lat] to [lat, lng] and back, for each pair."""
    return F.transform(pairs, lambda p: F.array(p[1], p[0]))


def positions(vertices: Column) -> Column:
    """[lng, lat], or [lng, lat, altitude] where a vertex has one."""
    return F.transform(vertices, lambda v: F.when(v["altitude"].isNull(), F.array(v["lng"], v["lat"])).otherwise(F.array(v["lng"], v["lat"], v["altitude"])))


def flat_positions(vertices: Column) -> Column:
    return F.transform(vertices, lambda v: F.array(v["lng"], v["lat"]))


def closed(ring: Column) -> Column:
    """The first vertex again at the end, always."""
    return F.concat(ring, F.slice(ring, 1, 1))


def without_last(vertices: Column) -> Column:
    """Undo: the last vertex dropped; nothing happens to an empty array."""
    return F.slice(vertices, F.lit(1), F.greatest(F.size(vertices) - 1, F.lit(0)))


def samples(vertices: Column) -> Column:
    return F.transform(vertices, lambda v: F.struct(v["accuracy"].alias("accuracy"), v["time"].alias("time"), v["altitude"].alias("altitude"), v["altitude_accuracy"].alias("altitudeAccuracy")))


def bounds(lat: Column, lng: Column, size_km: Column) -> Column:
    """The square of size_km around a centre, as a struct west, south, east, north."""
    half_lat = size_km / 2 / KM
    half_lng = size_km / 2 / (KM * F.cos(lat * F.pi() / 180))
    return F.struct((lng - half_lng).alias("west"), (lat - half_lat).alias("south"), (lng + half_lng).alias("east"), (lat + half_lat).alias("north"))


def extent(vertices: Column) -> Column:
    lng, lat = F.transform(vertices, lambda v: v["lng"]), F.transform(vertices, lambda v: v["lat"])
    return F.struct(F.array_min(lng).alias("west"), F.array_min(lat).alias("south"), F.array_max(lng).alias("east"), F.array_max(lat).alias("north"))


def meets(a: Column, b: Column) -> Column:
    """Whether two boxes share a point, edges included."""
    return (a["west"] <= b["east"]) & (b["west"] <= a["east"]) & (a["south"] <= b["north"]) & (b["south"] <= a["north"])


def holds(box: Column, lng: Column, lat: Column) -> Column:
    return lng.between(box["west"], box["east"]) & lat.between(box["south"], box["north"])
