"""Texts and numbers as the map shows them. All words that functions here put into labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ENTITIES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&#39;"), ('"', "&quot;")]


def escape_html(s: Column) -> Column:
    """Escapes & < > ' "; null is empty."""
    found = F.coalesce(s.cast("string"), F.lit(""))
    for a, b in _ENTITIES:
        found = F.replace(found, F.lit(a), F.lit(b))
    return found


def thousands(x: Column) -> Column:
    """Groups of three digits, parted by no-break spaces."""
    return F.replace(F.format_number(x, 0), F.lit(","), F.lit(" "))


def plain_number(x: Column) -> Column:
    """5.0 as 5, 2.5 as 2.5."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def metres(x: Column) -> Column:
    """Whole metres, halves up."""
    return F.floor(x + 0.5).cast("long")


def coordinate_label(lat: Column, lng: Column) -> Column:
    return F.format_string("%.5f, %.5f", lat, lng)


def workspace_label(scale: Column, interval: Column, size_km: Column, mode: Column) -> Column:
    shown = F.when(F.coalesce(F.nullif(mode, F.lit("")), F.lit("print")) == "print", "Utskriftsläge").otherwise("Digitalt läge")
    size = plain_number(size_km)
    return F.concat(F.lit("1:"), thousands(scale), F.lit(" · "), plain_number(interval), F.lit(" m · "), size, F.lit(" × "), size, F.lit(" km · "), shown)


def area_label(size_km: Column, lat: Column, lng: Column) -> Column:
    size = plain_number(size_km)
    return F.concat(size, F.lit(" × "), size, F.lit(" km · "), coordinate_label(lat, lng))


def building_summary(total: Column, approved: Column, rejected: Column, unverified: Column) -> Column:
    return F.concat_ws(" · ", total.cast("string"), F.concat(approved.cast("string"), F.lit(" godkända")), F.concat(rejected.cast("string"), F.lit(" avvisade")), F.concat(unverified.cast("string"), F.lit(" ogranskade")))


def road_summary(total: Column, reviewed: Column, unverified: Column) -> Column:
    return F.concat_ws(" · ", total.cast("string"), F.concat(reviewed.cast("string"), F.lit(" granskade")), F.concat(unverified.cast("string"), F.lit(" ogranskade")))


def contour_label(lines: Column, interval: Column) -> Column:
    return F.when(lines > 0, F.concat(lines.cast("string"), F.lit(" linjer · "), plain_number(interval), F.lit(" m"))).otherwise("Inte importerade")


def symbol_scale(mode: Column, scale: Column, zoom: Column) -> Column:
    """1 unless mode is print; else 2^(zoom-16) times the map scale over 10000, between 0.55 and 5."""
    size = F.pow(F.lit(2.0), zoom - 16) * F.coalesce(F.nullif(scale, F.lit(0)), F.lit(10000)) / 10000
    return F.when(mode == "print", F.greatest(F.lit(0.55), F.least(F.lit(5.0), size))).otherwise(1.0)


def iso_utc(ts: Column) -> Column:
    """ISO-8601 in UTC with milliseconds, which are cut, not rounded (the session's time zone is UTC)."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def from_iso(text: Column) -> Column:
    """Null where the text is no time."""
    return F.try_to_timestamp(text)


def from_millis(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def to_millis(ts: Column) -> Column:
    """Milliseconds since the epoch, cut."""
    return F.unix_millis(ts)
