"""Segmented prefix scans: what a device's history hands on, without a sort of the whole history.

A history is cut into slices of time.  Partial sums reduce each slice to what it hands on; these few rows are scanned in
order; and each slice is filled in by itself from what it is handed.  So rows are dealt out by device and slice, and a device
that sends a third of all events is as many tasks as it has slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a slice: a day, of which a device that sends a fix a second has 86,400 rows.
SLICE = 86_400
#: The slice of rows without a time, which come first.
_FIRST = -(1 << 62)


def slice_of(rows: DataFrame, time: str, seconds: int) -> Column:
    """The number of a row's slice. Times are timestamps, or numbers of milliseconds."""
    kind = rows.schema[time].dataType.typeName()
    ms = F.unix_millis(F.col(time).cast("timestamp")) if kind.startswith("timestamp") else F.col(time)
    return F.coalesce(F.floor(ms / (1000 * seconds)).cast("long"), F.lit(_FIRST))


def before(device: str, at: str = "slice") -> Window:
    """All slices of a device before one: a window over rows that are one a slice."""
    return Window.partitionBy(device).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)


def handed(rows: DataFrame, device: str, taken: dict[str, Column], passed: dict[str, Column]) -> DataFrame:
    """A row for each slice (device, slice) with what the slices before it hand on.

    taken: aggregates of a slice's rows; passed: of these, over the slices `before` one.
    """
    each = rows.groupBy(device, "slice").agg(*[c.alias(n) for n, c in taken.items()])
    return each.select(device, "slice", *[c.over(before(device)).alias(n) for n, c in passed.items()])
