"""Scans of histories in slices give what a walk over each history does, and no history is dealt out whole."""

import random
import re

import pytest
from pyspark.sql import functions as F

from cairn.operators import objects, recorder


def history(n=600):
    """Fixes and actions in random order; a third of all rows are one device's; some times are shared."""
    draw, fixes, actions = random.Random(5), [], []
    for seq in range(n):
        device = 1 if seq % 3 == 0 else draw.choice([2, 3, 4, None])
        t = draw.randrange(0, 5 * 86_400_000, 20_000)
        if draw.random() < 0.7:
            fixes.append((device, t, seq, float(seq), 59.0, draw.choice([1.0, 30.0, 80.0, float("nan"), None])))
        else:
            actions.append((device, t, seq, draw.choice(["begin", "finish", "cancel", "point", "stop_gps", "undo"])))
    return fixes, actions


def walked(fixes, actions):
    """fix at each action, recording of each good fix, by one walk a device."""
    rows = sorted([(t, s, 0, d, f) for d, t, s, *f in fixes] + [(t, s, 1, d, a) for d, t, s, a in actions], key=lambda r: r[:3])
    last, at, n, open_, inside = {}, {}, {}, {}, {}
    for t, s, later, d, what in rows:
        if later:
            at[s] = last.get(d)
            if what == "stop_gps":
                last[d] = at[s] = None
            n[d] = n.get(d, 0) + (what == "begin")
            open_[d] = what == "begin" if what in ("begin", "finish", "cancel") else open_.get(d)
        else:
            last[d] = what[0]
            if open_.get(d) and what[2] is not None and what[2] <= 50:
                inside[s] = n[d]
    return at, inside


@pytest.mark.parametrize("seconds", [86_400, 3_600, 10**9])
def test_scans(spark, seconds):
    fixes, actions = history()
    f = spark.createDataFrame(fixes, "device_id long, received_at long, seq long, lng double, lat double, accuracy double")
    a = spark.createDataFrame(actions, "device_id long, ts long, seq long, action string").withColumn("slice", F.lit("own"))
    at, inside = walked(fixes, actions)
    got = recorder.fix_at_action(a, f, seconds)
    assert {(r.seq, r.fix and r.fix.lng, r.slice) for r in got.collect()} == {(s, x, "own") for s, x in at.items()}
    assert {r.seq: r.recording for r in recorder.fixes_in_recording(a.drop("slice"), f, seconds).collect()} == inside and len(inside) > 40


@pytest.mark.parametrize("seconds", [86_400, 60, 10**9])
def test_gaps(spark, seconds):
    fixes, _ = history()
    rows = [(d, t, s) for d, t, s, *_ in fixes]
    df = spark.createDataFrame(rows, "device_id long, ms long, seq long").select("device_id", F.timestamp_millis("ms").alias("received_at"), "seq")
    want, last, runs = {}, {}, {}
    for t, s, d in sorted((t, s, d) for d, t, s in rows):
        gap = None if d not in last else (t - last[d]) / 1000
        runs[d] = runs.get(d, 0) + (gap is not None and gap > 25_000)
        want[s], last[d] = (gap, gap is not None and gap > 25_000, runs[d]), t
    assert {r.seq: (r.gap_s, r.lost, r.run) for r in objects.gps_gaps(df, 25_000, seconds).collect()} == want
    assert max(runs.values()) > 1


def test_empty_and_untimed(spark):
    f = spark.createDataFrame([(1, None, 1, 7.0, 1.0, 2.0), (1, 5, 2, 8.0, 1.0, 2.0)], "device_id long, received_at long, seq long, lng double, lat double, accuracy double")
    a = spark.createDataFrame([(1, 4, 3, "point"), (1, 6, 4, "point")], "device_id long, ts long, seq long, action string")
    assert {(r.seq, r.fix.lng) for r in recorder.fix_at_action(a, f).collect()} == {(3, 7.0), (4, 8.0)}  # no time: before all
    assert recorder.fix_at_action(a.limit(0), f).count() == recorder.fixes_in_recording(a.limit(0), f).count() == 0
    assert [r.fix for r in recorder.fix_at_action(a, f.limit(0)).collect()] == [None, None]


def test_histories_are_not_dealt_out_whole(spark):
    """Rows go by device and slice; what goes by device alone is one row a slice."""
    fixes, actions = history(60)
    f = spark.createDataFrame(fixes, "device_id long, received_at long, seq long, lng double, lat double, accuracy double")
    a = spark.createDataFrame(actions, "device_id long, ts long, seq long, action string")
    times = f.withColumn("received_at", F.timestamp_millis("received_at"))
    for df in (recorder.fix_at_action(a, f), recorder.fixes_in_recording(a, f), objects.gps_gaps(times)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        lines = plan.split("== Initial Plan ==")[-1].split("\n")
        alone = [i for i, x in enumerate(lines) if re.search(r"Exchange hashpartitioning\(device_id#\d+L, \d+\)", x)]
        assert alone and any("slice#" in x for x in lines if "Exchange hashpartitioning" in x)
        for i in alone:  # what is below has been aggregated by device and slice
            assert "Aggregate" in lines[i + 1] + lines[i + 2], "\n".join(lines[i : i + 3])
