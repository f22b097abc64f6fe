"""Recordings from GPS fixes and user actions.

Set forms for what windows can say (as-of fixes, begin-to-end intervals), and the exact recorder: one step function that
the batch and the stream share.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.geometry import VERTEX
from cairn.functions.gps import LIMIT
from cairn.operators import scan

#: What a recording's object looks like.
OBJECT = f"device_id bigint, ordinal bigint, category string, object_type string, source string, quality string, created_at bigint, accuracy double, coordinates array<{VERTEX}>"
#: Input of the exact recorder: kind is fix or an action; times are epoch milliseconds.
EVENT = "device_id bigint, ts bigint, seq bigint, kind string, category string, object_type string, mode string, lng double, lat double, accuracy double, altitude double, altitude_accuracy double"
LEAST = {"line": 2, "area": 3}


_FIX = "struct<lng:double,lat:double,accuracy:double>"


def fix_at_action(actions: DataFrame, fixes: DataFrame, seconds: int = scan.SLICE) -> DataFrame:
    """Each action with its device's fix before it, of any accuracy, but not from before a stop of the GPS.

    actions: device_id, ts, seq, action; fixes: device_id, received_at, seq, lng, lat, accuracy.  Adds fix (a struct, or
    null).  At the same time and seq a fix goes first.  Histories are cut into slices of `seconds`, each of which hands on
    its last fix or stop; rows of a slice are sorted by themselves.  Times are timestamps, or numbers of milliseconds.
    """
    known = F.struct(F.struct("lng", "lat", "accuracy").alias("fix"))
    stop = F.when(F.col("action") == "stop_gps", F.struct(F.lit(None).cast(_FIX).alias("fix")))
    a = actions.select(F.struct(*actions.columns).alias("a"), "device_id", F.col("ts").alias("t"), "seq", F.lit(1).alias("later"), stop.alias("state"), scan.slice_of(actions, "ts", seconds).alias("slice"))
    f = fixes.select(F.lit(None).cast(a.schema["a"].dataType).alias("a"), "device_id", F.col("received_at").alias("t"), "seq", F.lit(0).alias("later"), known.alias("state"), scan.slice_of(fixes, "received_at", seconds).alias("slice"))
    rows = a.unionByName(f)
    place = F.when(F.col("state").isNotNull(), F.struct(F.col("t").isNotNull(), "t", F.col("seq").isNotNull(), "seq", "later"))
    carry = scan.handed(rows, "device_id", {"state": F.max_by("state", place)}, {"state": F.last("state", ignorenulls=True)})
    first = carry.select(F.lit(None).cast(a.schema["a"].dataType).alias("a"), "device_id", F.lit(None).cast(a.schema["t"].dataType).alias("t"), F.lit(None).cast(rows.schema["seq"].dataType).alias("seq"), F.lit(-1).alias("later"), "state", "slice")
    order = Window.partitionBy("device_id", "slice").orderBy(F.col("later") >= 0, "t", "seq", "later").rowsBetween(Window.unboundedPreceding, 0)
    filled = rows.unionByName(first).withColumn("state", F.last("state", ignorenulls=True).over(order))
    return filled.where("later = 1").select("a.*", F.col("state.fix").alias("fix"))


def fixes_in_recording(actions: DataFrame, fixes: DataFrame, seconds: int = scan.SLICE) -> DataFrame:
    """Good fixes between a begin and the next end or begin of the device, with the recording's number (from 1).

    The simple form, in which every finish succeeds.  The fix that is current at the begin isn't part of it.  Histories are
    cut into slices of `seconds`, each of which hands on its number of begins and whether a recording is open.
    """
    begin = (F.col("action") == "begin").alias("begin")
    marks = actions.where("action in ('begin', 'finish', 'cancel')").select("device_id", F.col("ts").alias("t"), "seq", F.lit(0).alias("is_fix"), begin, F.lit(None).cast(_FIX).alias("fix"), scan.slice_of(actions, "ts", seconds).alias("slice"))
    f = fixes.select("device_id", F.col("received_at").alias("t"), "seq", F.lit(1).alias("is_fix"), F.lit(None).cast("boolean").alias("begin"), F.struct("lng", "lat", "accuracy").alias("fix"), scan.slice_of(fixes, "received_at", seconds).alias("slice"))
    rows = marks.unionByName(f).withColumn("n", F.col("begin").cast("long"))
    place = F.when(F.col("begin").isNotNull(), F.struct(F.col("t").isNotNull(), "t", F.col("seq").isNotNull(), "seq"))
    carry = scan.handed(rows, "device_id", {"begin": F.max_by("begin", place), "n": F.sum("n")}, {"begin": F.last("begin", ignorenulls=True), "n": F.sum("n")})
    nothing = {c: F.lit(None).cast(rows.schema[c].dataType) for c in ("t", "seq", "fix")}
    first = carry.withColumns(nothing | {"is_fix": F.lit(-1)})
    order = Window.partitionBy("device_id", "slice").orderBy(F.col("is_fix") >= 0, "t", "seq", "is_fix").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.unionByName(first).withColumns({"recording": F.sum("n").over(order), "open": F.last("begin", ignorenulls=True).over(order)})
    good = (F.col("fix.accuracy") <= LIMIT) & ~F.isnan("fix.accuracy")
    return placed.where(F.col("is_fix") == 1).where("open").where(good).select("device_id", "recording", F.col("t").alias("received_at"), "seq", "fix.lng", "fix.lat", "fix.accuracy")


def build_shapes(vertices: DataFrame, *by: str) -> DataFrame:
    """Vertices (seq, lng, lat and the rest) to one row a shape, with coordinates in order of seq."""
    item = F.struct("seq", F.struct("lng", "lat", "accuracy", "time", "altitude", "altitude_accuracy").alias("v"))
    shapes = vertices.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("items"))
    return shapes.withColumn("coordinates", F.transform("items", lambda i: i["v"])).drop("items")


def new_state() -> dict:
    return {"mode": "gps", "category": None, "object_type": None, "source": None, "vertices": [], "last": None, "types": {}, "n": 0}


def step(state: dict, e: dict) -> dict | None:
    """One event of one device: changes the state, returns an object if one is finished.

    Pressing finish with a point armed emits nothing.  A finish with too few vertices leaves the recording open.
    """
    kind, open_ = e["kind"], state["category"]

    def close() -> None:
        state.update(category=None, object_type=None, source=None, vertices=[])

    def made(category: str, object_type: str, source: str, vertices: list, accuracy: float | None) -> dict:
        state["n"] += 1
        return {"ordinal": state["n"], "category": category, "object_type": object_type, "source": source, "quality": "unverified", "created_at": e["ts"], "accuracy": accuracy, "coordinates": vertices}

    def vertex(accuracy: float, source: dict, altitude=None, altitude_accuracy=None) -> dict:
        return {"lng": source["lng"], "lat": source["lat"], "accuracy": accuracy, "time": e["ts"], "altitude": altitude, "altitude_accuracy": altitude_accuracy}

    def finish() -> dict | None:
        if open_ not in LEAST or len(state["vertices"]) < LEAST[open_]:
            return None
        found = made(open_, state["object_type"], state["source"], state["vertices"], None)
        close()
        return found

    good = lambda fix: fix is not None and not fix["accuracy"] > LIMIT
    if kind == "fix":
        state["last"] = {k: e[k] for k in ("lng", "lat", "accuracy", "altitude", "altitude_accuracy")}
        if open_ in LEAST and state["source"] == "gps" and e["accuracy"] is not None and e["accuracy"] <= LIMIT:
            state["vertices"].append(vertex(e["accuracy"], e, e["altitude"], e["altitude_accuracy"]))
    elif kind == "tap":
        if open_ == "point":
            found = made("point", state["object_type"], "manual", [vertex(0.0, e)], 0.0)
            close()
            return found
        if open_ in LEAST and state["mode"] == "manual" and state["source"] == "manual":
            state["vertices"].append(vertex(0.0, e))
    elif kind == "action":
        category = e["category"]
        chosen = state["types"].get(category)
        if category == "point":
            if state["mode"] == "gps":
                last = state["last"]
                if good(last):
                    return made("point", chosen, "gps", [vertex(last["accuracy"], last, last["altitude"], last["altitude_accuracy"])], last["accuracy"])
            else:
                close()
                state.update(category="point", object_type=chosen, source="manual")
        elif open_ == category:
            return finish()
        elif open_ is None and not (state["mode"] == "gps" and not good(state["last"])):
            state.update(category=category, object_type=chosen, source=state["mode"], vertices=[])
    elif kind == "finish":
        return finish()
    elif kind == "undo":
        if state["vertices"]:
            state["vertices"].pop()
    elif kind == "cancel":
        close()
    elif kind == "set_mode":
        if not (open_ is not None and state["source"] == "gps" and e["mode"] != "gps"):
            close()
            state["mode"] = e["mode"]
    elif kind == "stop_gps":
        if not (open_ is not None and state["source"] == "gps"):
            state["last"] = None
    elif kind == "set_type":
        if open_ is None:
            state["types"][e["category"]] = e["object_type"]
    return None


def _clean(row: dict) -> dict:
    """Missing numbers as None; a NaN accuracy stays, as it's worse than any limit."""
    return {k: (None if v is None or v is pd.NaT or (isinstance(v, float) and v != v and k != "accuracy") else v) for k, v in row.items()}


def recordings(events: DataFrame) -> DataFrame:
    """Finished objects of all devices, by the exact recorder. events: as EVENT, any order.

    Devices are dealt out and sorted, and the state of one is carried through its rows batch by batch, so a long history
    is never held whole.  Types must be chosen by set_type or are null.
    """
    names = [f.split()[0] for f in OBJECT.split(", ")[:8]] + ["coordinates"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        device, state = None, new_state()
        for batch in batches:
            found = []
            for row in batch.to_dict("records"):
                if row["device_id"] != device:
                    device, state = row["device_id"], new_state()
                made = step(state, _clean(row))
                if made:
                    found.append({"device_id": device, **made})
            yield pd.DataFrame(found, columns=names)

    columns = [f.split()[0] for f in EVENT.split(", ")]
    rows = events.select(*columns).where("device_id is not null").repartition("device_id").sortWithinPartitions("device_id", "ts", "seq")
    return rows.mapInPandas(run, OBJECT)
