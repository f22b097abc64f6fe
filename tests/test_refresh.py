"""The refresh of a stored layer: its plan, what it keeps, and odd rows."""

import re

from pyspark.sql import functions as F

from cairn.operators import refresh

ROW = "workspace_id int, id string, ordinal long, source_id string, status string, reviewed_at timestamp, isom_symbol string, road_type string, automatic_isom_symbol string, automatic_road_type string"
EVENT = "workspace_id int, feature_id string, ts timestamp, event_id long, action string, symbol string"


def row(w, i, s, status=None, symbol="503", ordinal=0):
    return (w, i, ordinal, s, status, None, symbol, "road", "503", "road")


def layer(spark):
    rows = [row(1, "a", "way/1", "locally-approved"), row(1, "b", "way/2", "locally-edited", "505"), row(2, "a", "way/1", "locally-rejected"), row(1, "c", None, "locally-approved", ordinal=5), row(1, "d", None, None, ordinal=4), row(3, "z", "way/9", "locally-approved"), row(1, "gone", "way/7", "locally-approved")]
    return spark.createDataFrame(rows, ROW)


def events(spark):
    t = F.timestamp_seconds("s")
    rows = [(1, "b", 5, 1, "reset", None), (2, "a", 6, 2, "approved", None), (3, "z", 7, 3, "rejected", None), (9, "a", 8, 4, "rejected", None)]
    return spark.createDataFrame(rows, "workspace_id int, feature_id string, s long, event_id long, action string, symbol string").withColumn("ts", t).select("workspace_id", "feature_id", "ts", "event_id", "action", "symbol")


def test_refresh(spark, tmp_path):
    before, after = str(tmp_path / "before"), str(tmp_path / "after")
    refresh.store(layer(spark), before, buckets=4)
    extract = spark.createDataFrame([row(1, "A", "way/1"), row(1, "B", "way/2"), row(1, "N", None), row(2, "A", "way/1"), row(2, "new", "way/5"), row(None, "x", "way/1")], ROW).drop("ordinal")
    counts = {r.workspace_id: r.asDict() for r in refresh.refresh(spark, before, events(spark), extract.where("workspace_id is not null"), after, buckets=4).collect()}
    got = {(r.workspace_id, r.id): (r.status, r.isom_symbol) for r in refresh.stored(spark, after, 4).collect()}
    assert got[1, "A"] == ("locally-approved", "503") and got[2, "A"] == ("locally-approved", "503")  # its own workspace's, after the action
    assert got[1, "B"][0] is None and got[1, "B"][1] == "503"  # reset: nothing to carry over
    assert got[1, "N"][0] == "locally-approved" and got[2, "new"][0] is None
    assert got[3, "z"][0] == "locally-rejected" and (1, "gone") not in got and len(got) == 6
    assert counts[1] == {"workspace_id": 1, "total": 3, "rejected": 0, "unverified": 1, "reviewed": 2} and counts[3]["rejected"] == 1
    again = refresh.refresh(spark, after, events(spark).limit(0), extract.where("workspace_id is not null"), str(tmp_path / "again"), buckets=4)
    assert {r.workspace_id: r.asDict() for r in again.collect()} == counts  # carrying over is idempotent


def test_stored_rows_stay_where_they_are(spark, tmp_path, monkeypatch):
    """One exchange of the extract, none of the stored layer's rows before they are one a source; with many actions stored rows do move, and results agree."""
    path = str(tmp_path / "l")
    refresh.store(layer(spark), path, buckets=4)
    extract = layer(spark).drop("ordinal").withColumn("status", F.lit(None).cast("string"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = refresh.refreshed(refresh.stored(spark, path, 4), events(spark), extract)
        plan = found.where("source_id is not null")._jdf.queryExecution().executedPlan().toString().split("\n")
        dealt = [i for i, x in enumerate(plan) if re.search(r"Exchange hashpartitioning\(workspace_id#\d+, source_id#\d+, 4\)", x)]
        scans = [i for i, x in enumerate(plan) if "FileScan parquet" in x]
        assert len(dealt) == 1 and scans and any("Bucketed: true" in plan[i] for i in scans)
        deep = lambda i: re.search(r"[^\s:|+\-*()\d]", plan[i]).start()
        for i in scans:  # what stands above a scan of stored rows
            above, at = [], deep(i)
            for j in range(i - 1, -1, -1):
                if deep(j) < at:
                    above, at = [*above, plan[j]], deep(j)
            one_a_source = next(k for k, x in enumerate(above) if "functions=[max_by(" in x)
            assert not any("Exchange hashpartitioning" in x for x in above[:one_a_source]), "\n".join(above)
        want = sorted(map(str, found.collect()))
        monkeypatch.setattr(refresh, "MOST_ACTED", 0)
        assert sorted(map(str, refresh.refreshed(refresh.stored(spark, path, 4), events(spark), extract).collect())) == want
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
