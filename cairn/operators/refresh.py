"""The refresh of an automatic layer: a new extract takes over the reviews of the stored one, and replaces it.

The stored layer lies in buckets of (workspace_id, source_id), the key that reviews are carried over by.  Its rows are never
dealt out anew: actions come to them (broadcast while they are few enough), their last reviews are taken within buckets, only
the extract is dealt out to them, and the result is written in the same buckets.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import reviews

#: What buckets are by, and how many there are by default: so many tasks take part.
KEYS, BUCKETS = ["workspace_id", "source_id"], 200
#: Features with actions that are sent to all executors at most; with more, stored rows are dealt out by id once.
MOST_ACTED = 200_000


def store(rows: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Writes a layer's rows to a new folder, in buckets. Rows that are partitioned so already are not shuffled."""
    name = f"layer_{uuid.uuid4().hex}"
    rows.write.bucketBy(buckets, *KEYS).sortBy(*KEYS).option("path", f"{path}/buckets={buckets}").saveAsTable(name)
    rows.sparkSession.sql(f"drop table {name}")  # of the catalog only: files of a table with a path stay


def stored(spark: SparkSession, path: str, buckets: int = BUCKETS) -> DataFrame:
    """A layer that store() wrote, which Spark knows to be in buckets."""
    name, folder = f"layer_{uuid.uuid4().hex}", f"{path}/buckets={buckets}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(folder).schema)
    spark.sql(f"create table {name} ({columns}) using parquet clustered by ({', '.join(KEYS)}) sorted by ({', '.join(KEYS)}) into {buckets} buckets location '{folder}'")
    return spark.table(name)


def acted(features: DataFrame, events: DataFrame, kind: str) -> DataFrame:
    """apply_reviews, by broadcast where few features have actions, so that features stay where they are."""
    few = events.select(*[c for c in ("workspace_id", "feature_id") if c in events.columns]).distinct().count() <= MOST_ACTED
    return reviews.apply_reviews(features, events, kind, few=few)


def refreshed(previous: DataFrame, events: DataFrame, extract: DataFrame, kind: str = "road", strict_keys: bool = False) -> DataFrame:
    """The rows of extract with the reviews of previous, after the actions of events.

    previous: stored rows, with workspace_id, source_id, id, ordinal, status, reviewed_at and for roads isom_symbol, road_type
    and both automatic_ columns; events: workspace_id, feature_id, ts, event_id, action, symbol; extract: as previous, its
    order optional (else it's that of a hash of the id).  Features that the extract hasn't are gone, with their reviews.  A null status stays null, which counts as
    unverified.
    """
    carry = reviews.carry_over_road_reviews if kind == "road" else reviews.carry_over_building_reviews
    return carry(extract, acted(previous, events, kind), strict_keys)


def refresh(spark: SparkSession, path: str, events: DataFrame, extract: DataFrame, to: str, kind: str = "road", buckets: int = BUCKETS) -> DataFrame:
    """Refreshes the layer stored at path for the workspaces that extract has rows of, into the folder `to`; other workspaces
    keep theirs, with the actions of events.  Returns the counts of reviews of each workspace (see road_review_counts)."""
    previous = stored(spark, path, buckets)
    of = extract.select("workspace_id").where("workspace_id is not null").distinct()
    of = F.broadcast(of) if of.count() <= MOST_ACTED else of
    fresh = refreshed(previous, events, extract, kind)
    fresh = fresh if "ordinal" in extract.columns else fresh.withColumn("ordinal", F.xxhash64("id"))
    kept = acted(previous, events, kind).join(of, "workspace_id", "left_anti")
    whole = fresh.select(previous.columns).unionByName(kept.select(previous.columns))
    store(whole, to, buckets)
    counts = reviews.road_review_counts if kind == "road" else reviews.building_review_counts
    return counts(stored(spark, to, buckets), "workspace_id")
