"""Reviews of features that were extracted automatically: defaults, replay, carry-over, counts.

Features: id, source_id, status, reviewed_at, name and, for roads, isom_symbol, road_type, their automatic_ versions and
classification_confidence. A workspace_id, where there is one, is part of all keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.catalog import APPROVED, CONFIDENCE, EDITED, REJECTED, ROAD_TYPES, UNVERIFIED, lookup, truthy


def status_of(status: Column) -> Column:
    return F.coalesce(truthy(status), F.lit(UNVERIFIED))


def feature_defaults(features: DataFrame, kind: str) -> DataFrame:
    """Status and display columns of buildings or roads, with their defaults.

    Adds display_name and, for roads, display_symbol and confidence_label.
    """
    found = features.withColumn("status", status_of(F.col("status")))
    if kind == "building":
        return found.withColumn("display_name", F.coalesce(truthy(F.col("name")), F.lit("Byggnad")))
    label = lookup({k: v[1] for k, v in ROAD_TYPES.items()}, F.col("isom_symbol"))
    return found.withColumns({
        "display_symbol": F.coalesce(truthy(F.col("isom_symbol")), F.lit("506")),
        "display_name": F.coalesce(truthy(F.col("name")), label, F.lit("Väg eller stig")),
        "confidence_label": F.coalesce(lookup(CONFIDENCE, F.col("classification_confidence")), F.lit("okänd")),
    })


def road_fill_features(roads: DataFrame) -> DataFrame:
    """Wide roads, which are drawn with a fill, unless rejected. No default symbol applies here."""
    return roads.where((F.col("isom_symbol") == "502") & (status_of(F.col("status")) != REJECTED))


def _keys(df: DataFrame) -> list[str]:
    return ["workspace_id"] if "workspace_id" in df.columns else []


def replay_reviews(events: DataFrame, kind: str = "road") -> DataFrame:
    """What a log of actions (feature_id, ts, event_id, action, symbol) does to each feature, as one row.

    last_action, last_ts: of the last effective event (a road's change to no road symbol is none); symbol_any: the last change's symbol; has_reset, and symbol_since:
    the last change's after the last reset.  Aggregates with partial sums only: no history is sorted or gathered.
    """
    order = F.struct("ts", "event_id")
    if kind == "road":
        changed = F.col("action") == "change"
        effective = events.where(~F.coalesce(changed, F.lit(False)) | F.col("symbol").isin(*ROAD_TYPES))
        change_order = F.when(changed, order)
        reset_order = F.when(~F.coalesce(F.col("action").isin("approved", "rejected", "change"), F.lit(False)), order)
    else:
        effective, change_order, reset_order = events, F.lit(None).cast("struct<ts:timestamp,event_id:bigint>"), F.when(F.col("action") == "reset", order)
    by = [*_keys(events), "feature_id"]
    found = effective.groupBy(*by).agg(
        F.max_by("action", order).alias("last_action"),
        F.max("ts").alias("last_ts"),
        F.max(reset_order).alias("reset_at"),
        F.max(change_order).alias("change_at"),
        F.max_by("symbol", change_order).alias("symbol_any"),
    )
    since = F.when(F.col("reset_at").isNull() | (F.col("change_at") > F.col("reset_at")), F.col("symbol_any"))
    return found.withColumn("symbol_since", since).withColumn("has_reset", F.col("reset_at").isNotNull()).drop("reset_at", "change_at")


def apply_reviews(features: DataFrame, events: DataFrame, kind: str = "road", few: bool = False) -> DataFrame:
    """Features after the actions of a log; those of unknown features do nothing, other features stay as stored.

    Status and reviewed_at come from the last effective event; reviewed_at is null after a reset. A reset takes a road's
    symbol and type back to the automatic ones where there are any, each column for itself; else it leaves them.  few: so few
    features have actions that these can be sent to all executors.
    """
    after = replay_reviews(events, kind)
    keys = _keys(events)
    on = (F.col("id").cast("string") == F.col("_id"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    renamed = after.withColumnsRenamed({k: f"_{k}" for k in keys}).withColumn("_id", F.col("feature_id").cast("string")).drop("feature_id")
    joined = features.join(F.broadcast(renamed) if few else renamed, on, "left")
    seen, action = F.col("_id").isNotNull(), F.col("last_action")
    known = F.when(action == "approved", APPROVED).when(action == "rejected", REJECTED)
    if kind == "road":
        status, is_reset = known.when(action == "change", EDITED).otherwise(UNVERIFIED), ~F.coalesce(action.isin("approved", "rejected", "change"), F.lit(False))
    else:  # any other action leaves a time but no verdict
        status, is_reset = known.otherwise(UNVERIFIED), F.coalesce(action == "reset", F.lit(False))
    out = {"status": F.when(seen, status).otherwise(F.col("status")), "reviewed_at": F.when(seen & is_reset, F.lit(None)).when(seen, F.col("last_ts")).otherwise(F.col("reviewed_at"))}
    if kind == "road":
        types = {k: v[0] for k, v in ROAD_TYPES.items()}
        for name, convert in (("isom_symbol", lambda s: s), ("road_type", lambda s: lookup(types, s))):
            automatic = truthy(F.col(f"automatic_{name}"))
            with_automatic = F.coalesce(convert(F.col("symbol_since")), F.when(F.col("has_reset"), automatic), F.col(name))
            without = F.coalesce(convert(F.col("symbol_any")), F.col(name))
            out[name] = F.when(~seen, F.col(name)).when(automatic.isNotNull(), with_automatic).otherwise(without)
    return joined.withColumns(out).drop("_id", *[f"_{k}" for k in keys], "last_action", "last_ts", "symbol_any", "symbol_since", "has_reset")


def latest_reviews(previous: DataFrame, values: list[str]) -> DataFrame:
    """Of each source_id (null is one too), the values of its last row by ordinal, ties by id."""
    order = F.struct("ordinal", F.col("id").cast("string"))
    return previous.groupBy(*_keys(previous), "source_id").agg(F.max_by(F.struct(*values), order).alias("review"))


def _carried(following: DataFrame, previous: DataFrame, values: list[str], strict_keys: bool) -> DataFrame:
    """Joins each feature's last review. Null source ids, which all match each other, are one row a workspace: a table of
    its own, so that the large join has no hot key."""
    keys = _keys(following)
    prev = previous.withColumn("status", status_of(F.col("status")))
    last = latest_reviews(prev, ["status", *values]).where(F.col("review.status") != UNVERIFIED)
    named = following.where("source_id is not null").join(last.where("source_id is not null"), [*keys, "source_id"], "left")
    nameless, others = following.where("source_id is null"), last.where("source_id is null").drop("source_id")
    if strict_keys:
        empty = nameless.withColumn("review", F.lit(None).cast(last.schema["review"].dataType))
    elif keys:
        empty = nameless.join(others, keys, "left")
    else:  # one row at most: the group of the null key
        empty = nameless.join(F.broadcast(others), F.lit(True), "left")
    whole = named.unionByName(empty)
    reviewed = F.col("review").isNotNull()
    return whole.withColumns({"status": F.when(reviewed, F.col("review.status")).otherwise(F.col("status")), **{v: F.when(reviewed, F.col(f"review.{v}")).otherwise(F.col(v)) for v in values}}).drop("review")


def carry_over_building_reviews(following: DataFrame, previous: DataFrame, strict_keys: bool = False) -> DataFrame:
    """A new extract with the reviews of the previous one, matched by source_id.

    The last previous row of a source_id counts, also if it's unverified: then nothing is carried.  Rows without a
    source_id match each other unless strict_keys.  A carried null reviewed_at replaces the new value.  previous has an
    ordinal.
    """
    return _carried(following, previous, ["reviewed_at"], strict_keys)


def carry_over_road_reviews(following: DataFrame, previous: DataFrame, strict_keys: bool = False) -> DataFrame:
    """As for buildings; symbol and type are carried too, for every reviewed status. automatic_ columns stay the new ones."""
    return _carried(following, previous, ["reviewed_at", "isom_symbol", "road_type"], strict_keys)


def building_review_counts(buildings: DataFrame, *by: str) -> DataFrame:
    """total, approved, rejected, unverified (everything else)."""
    s = status_of(F.col("status"))
    counts = buildings.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(s == APPROVED).alias("approved"), F.count_if(s == REJECTED).alias("rejected"))
    return counts.withColumn("unverified", F.col("total") - F.col("approved") - F.col("rejected"))


def road_review_counts(roads: DataFrame, *by: str) -> DataFrame:
    """total, rejected, unverified, reviewed (everything else, edited ones included)."""
    s = status_of(F.col("status"))
    counts = roads.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(s == REJECTED).alias("rejected"), F.count_if(s == UNVERIFIED).alias("unverified"))
    return counts.withColumn("reviewed", F.col("total") - F.col("rejected") - F.col("unverified"))
