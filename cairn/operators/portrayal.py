"""How features are drawn: colour, stroke, dash and fill by type, symbol and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.catalog import APPROVED, REJECTED, UNVERIFIED, truthy
from cairn.functions.text import plain_number, symbol_scale

_S = "struct<colour:string,weight:double,dash:array<double>,fixed_dash:boolean,fill:string,fill_opacity:double,opacity:double>"


def _style(colour, weight, dash=(), fill=None, fill_opacity=None, opacity=1.0, fixed=False) -> Column:
    as_double = lambda x: x.cast("double") if isinstance(x, Column) else F.lit(x).cast("double")
    return F.struct(F.lit(colour).alias("colour"), as_double(weight).alias("weight"), (F.array(*[as_double(d) for d in dash]) if dash else F.array().cast("array<double>")).alias("dash"), F.lit(fixed).alias("fixed_dash"), F.lit(fill).cast("string").alias("fill"), as_double(fill_opacity).alias("fill_opacity"), as_double(opacity).alias("opacity")).cast(_S)


def _first(cases: list[tuple[Column | None, Column]]) -> Column:
    *some, (_, last) = cases
    found = last
    for when, style in reversed(some):
        found = F.when(when, style).otherwise(found)
    return found


# Styles as multiples of the symbol scale (buildings and areas: of the scale, 1 at least); first match wins.
def _building(status: Column) -> Column:
    return _first([
        (status == REJECTED, _style("#a13d38", 1.5, (4, 3), "#fff", 0.08)),
        (status == APPROVED, _style("#111", 1, (), "#111", 0.92)),
        (None, _style("#171b19", 1, (), "#171b19", 0.62)),
    ])


def _road(symbol: Column, status: Column) -> Column:
    seen = F.when(status == UNVERIFIED, 0.7).otherwise(1.0)
    return _first([
        (status == REJECTED, _style("#a13d38", 2, (4, 4), opacity=0.8)),
        (symbol == "502", _style("#111", 8, opacity=seen)),
        (symbol == "503", _style("#111", 3.5, opacity=seen)),
        (symbol == "504", _style("#111", 3, (12, 4), opacity=seen)),
        (symbol == "505", _style("#111", 2.5, (9, 5), opacity=seen)),
        (symbol == "507", _style("#111", 1.8, (2, 4, 2, 8), opacity=seen)),
        (None, _style("#111", 1.8, (5, 4), opacity=seen)),
    ])


def _road_fill(status: Column) -> Column:
    return _style("#b89b72", 5.2, opacity=F.when(status == UNVERIFIED, 0.75).otherwise(1.0))


def _contour(index: Column) -> Column:
    return _style("#9a5b35", F.when(F.coalesce(index, F.lit(False)), 2.2).otherwise(1.25), opacity=0.9)


def _line(t: Column) -> Column:
    return _first([
        (t == "stream", _style("#168cab", 4)),
        (t == "ditch", _style("#8d5b36", 3, (8, 5))),
        (t == "cliff", _style("#181b19", 5)),
        (t == "fence", _style("#181b19", 3, (3, 5))),
        (t == "wide_path", _style("#181b19", 5, (9, 5))),
        (t == "faint_path", _style("#181b19", 3, (3, 7))),
        (t.contains("path"), _style("#181b19", 3, (9, 5))),
        (t == "paved_road", _style("#181b19", 7)),
        (t == "gravel_road", _style("#181b19", 5, (12, 4))),
        (None, _style("#181b19", 5)),
    ])


def _area(t: Column) -> Column:
    return _first([
        (t == "building", _style("#181b19", 1, (), "#181b19", 0.82)),
        (t == "lake", _style("#168cab", 1, (), "#7bcfe1", 0.55)),
        (t.contains("marsh"), _style("#168cab", 1, (5, 4), "#bce2df", 0.5, fixed=True)),
        (t.isin("field", "open_land"), _style("#d2a82f", 1, (), "#ffe270", 0.55)),
        (t == "forbidden", _style("#9b3d83", 1, (), "#d995ca", 0.45)),
        (t == "very_dense", _style("#1d874e", 1, (), "#228847", 0.52)),
        (None, _style("#1d874e", 1, (), "#60aa63", 0.52)),
    ])


def portrayal(features: DataFrame, zoom: Column) -> DataFrame:
    """Adds colour, weight, dash (lengths with spaces between, null if none), fill, fill_opacity, opacity.

    features: layer (building, road, road_fill, contour, line, area), and as the layer needs object_type, isom_symbol,
    status, index_contour; symbol_display_mode and scale of the workspace.
    """
    status = F.coalesce(truthy(F.col("status")), F.lit(UNVERIFIED))
    symbol, t, layer = F.coalesce(truthy(F.col("isom_symbol")), F.lit("506")), F.coalesce("object_type", F.lit("")), F.col("layer")
    s = symbol_scale(F.col("symbol_display_mode"), F.col("scale"), zoom)
    styles = {"building": _building(status), "road": _road(symbol, status), "road_fill": _road_fill(status), "contour": _contour(F.col("index_contour")), "line": _line(t), "area": _area(t)}
    style = F.lit(None).cast(_S)
    for name, of in styles.items():
        style = F.when(layer == name, of).otherwise(style)
    found = features.withColumns({"_style": style, "_scale": F.when(layer.isin("building", "area"), F.greatest(F.lit(1.0), s)).otherwise(s)})
    factor = F.when(F.col("_style.fixed_dash"), 1.0).otherwise(F.col("_scale"))
    dash = F.array_join(F.transform("_style.dash", lambda d: plain_number(F.round(d * factor, 6))), " ")
    return found.withColumns({"colour": F.col("_style.colour"), "weight": F.col("_style.weight") * F.col("_scale"), "dash": F.nullif(dash, F.lit("")), "fill": F.col("_style.fill"), "fill_opacity": F.col("_style.fill_opacity"), "opacity": F.col("_style.opacity")}).drop("_style", "_scale")
