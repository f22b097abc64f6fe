"""Streams with late rows, restarts and long histories; the recorder against a replay of its own."""

import random
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cairn.operators import recorder
from cairn.streaming import fixes as streams
from cairn.streaming import sinks

MINUTE = 60_000


@pytest.fixture(scope="module", autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def replayed(events):
    """Finished objects of all devices, from the table of the recorder's rules: (device, time, category, type, source, vertices)."""
    out, by = [], defaultdict(list)
    for e in sorted(events, key=lambda e: (e["ts"], e["seq"])):
        by[e["device_id"]].append(e)
    for device, own in by.items():
        mode, last, types, shape = "gps", None, {}, None  # shape: [category, type, source, vertices]
        worse = lambda f: f is None or (f["accuracy"] is not None and f["accuracy"] > 50)
        for e in own:
            kind, category = e["kind"], e["category"]
            if kind == "fix":
                last = e
                if shape and shape[0] != "point" and shape[2] == "gps" and e["accuracy"] is not None and e["accuracy"] <= 50:
                    shape[3].append((e["lng"], e["lat"], e["ts"]))
            elif kind == "tap" and shape and shape[0] == "point":
                out.append((device, e["ts"], "point", shape[1], "manual", ((e["lng"], e["lat"], e["ts"]),)))
                shape = None
            elif kind == "tap" and shape and mode == "manual" and shape[2] == "manual":
                shape[3].append((e["lng"], e["lat"], e["ts"]))
            elif kind == "action" and category == "point" and mode == "gps" and not worse(last):
                out.append((device, e["ts"], "point", types.get("point"), "gps", ((last["lng"], last["lat"], e["ts"]),)))
            elif kind == "action" and category == "point" and mode == "manual":
                shape = ["point", types.get("point"), "manual", []]
            elif kind == "action" and category in ("line", "area") and not shape and not (mode == "gps" and worse(last)):
                shape = [category, types.get(category), mode, []]
            elif kind == "finish" or kind == "action" and shape and category == shape[0] and category != "point":
                if shape and shape[0] != "point" and len(shape[3]) >= (2 if shape[0] == "line" else 3):
                    out.append((device, e["ts"], *shape[:3], tuple(shape[3])))
                    shape = None
            elif kind == "undo" and shape:
                shape[3][-1:] = []
            elif kind == "cancel":
                shape = None
            elif kind == "set_mode" and not (shape and shape[2] == "gps" and e["mode"] != "gps"):
                shape, mode = None, e["mode"]
            elif kind == "stop_gps" and not (shape and shape[2] == "gps"):
                last = None
            elif kind == "set_type" and not shape:
                types[category] = e["object_type"]
    return sorted(map(str, out))


def told(rows):
    return sorted(str((r.device_id, r.created_at, r.category, r.object_type, r.source, tuple((v.lng, v.lat, v.time) for v in r.coordinates))) for r in rows)


def history(n, devices, seed, step=20_000):
    draw = random.Random(seed)
    kinds = ["fix"] * 8 + ["tap"] * 3 + ["action"] * 4 + ["finish", "finish", "undo", "cancel", "set_mode", "stop_gps", "set_type"]
    return [(draw.choice(devices), 10**9 + i // 2 * step, i, draw.choice(kinds), draw.choice(["point", "line", "area"]), draw.choice(["pit", "path", "lake", None]), draw.choice(["gps", "gps", "manual"]), draw.random(), draw.random(), draw.choice([1.0, 40.0, 60.0]), None, None) for i in range(n)]


def as_events(rows):
    names = [f.split()[0] for f in recorder.EVENT.split(", ")]
    return [dict(zip(names, r)) for r in rows]


def test_batch_against_the_rules(spark, sf_dir):
    from cairn.plans.queries import recorder_events

    rows = history(4000, [1, 2, 3], 1)
    got = recorder.recordings(spark.createDataFrame(rows, recorder.EVENT)).collect()
    assert told(got) == replayed(as_events(rows)) and len(got) > 100
    table = recorder_events(spark, sf_dir)
    assert told(recorder.recordings(table).collect()) == replayed([r.asDict() for r in table.collect()])


@pytest.mark.parametrize("splits", [1, 7])
def test_stream_against_the_rules(spark, tmp_path, splits):
    """However events are split into batches, also all at once."""
    rows = history(1500, [1, 2], 2)
    parts = [rows[i * len(rows) // splits : (i + 1) * len(rows) // splits] for i in range(splits)]
    for p in parts:
        random.Random(3).shuffle(p)
    end = (9, rows[-1][1] + 60 * MINUTE, 10**6, "cancel", None, None, None, None, None, None, None, None)
    for i, p in enumerate([*parts, [end]]):
        spark.createDataFrame(p, recorder.EVENT).repartition(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(recorder.EVENT).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    out = []
    query = streams.stream_recordings(stream, "1 minute", "900 hours").writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    assert told(out) == replayed(as_events(rows)) and out
    left = spark.read.format("statestore").option("stateVarName", "pending").load(f"{tmp_path}/c")
    assert [r[0] for r in left.select("key.device_id").collect()] == [9]


def test_a_bucket_is_all_that_is_held():
    """A timer reads its own bucket's events and no other's."""

    class Map(dict):
        containsKey, getValue, updateValue, removeKey = dict.__contains__, dict.__getitem__, dict.__setitem__, dict.pop  # noqa: N815

    class Value:
        def __init__(self):
            self.v = None

        exists, get = lambda self: self.v is not None, lambda self: self.v
        update = lambda self, v: setattr(self, "v", v)

    r = streams.Recorder(10**12, MINUTE)
    r.pending, r.chunks, r.waiting = Map(), Map(), Value()
    r.pending |= {(b, c): (f'[{{"ts": {b * MINUTE + c}, "seq": {c}}}]',) for b in range(5) for c in range(3)}
    r.chunks |= {(b,): (3,) for b in range(5)}
    r.waiting.update((5, None))
    assert [e["seq"] for e in r._taken(0)] == [0, 1, 2] and len(r.pending) == 12 and r.waiting.get() == (4, 0)
    assert r._taken(77) == [] and [e["ts"] // MINUTE for e in r._taken(3)] == [3, 3, 3]
    with pytest.raises(RuntimeError):
        r._taken(1)


def fix_rows(*rows):
    return [(d, m * MINUTE, s, float(s), 2.0, 5.0) for d, m, s in rows]


FIX = "device_id long, ms long, seq long, lng double, lat double, accuracy double"


def run(spark, folder, batches, made, mode, name):
    """Runs a stream over batches; the first half, then a restart for the rest."""
    for i, rows in enumerate(batches):
        if i == len(batches) // 2:
            _through(spark, folder, made, mode, name)
        spark.createDataFrame(rows, FIX).coalesce(1).write.parquet(f"{folder}/in/{i}")
    _through(spark, folder, made, mode, name)


def _through(spark, folder, made, mode, name):
    stream = spark.readStream.schema(FIX).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in").withColumn("received_at", F.timestamp_millis("ms"))
    made(stream).writeStream.queryName(name).outputMode(mode).foreachBatch(sinks.into(f"{folder}/out")).option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start().awaitTermination()


#: The third batch has two late rows: minutes 1 and 2, when the watermark has passed 29.
BATCHES = [fix_rows((1, 0, 1), (1, 1, 2), (2, 3, 3)), fix_rows((1, 30, 4), (2, 30, 5)), fix_rows((1, 1, 6), (2, 2, 7), (1, 31, 8)), fix_rows((3, 300, 9))]


def test_windows_in_append_and_update_mode(spark, tmp_path):
    counter = sinks.LateCounter()
    spark.streams.addListener(counter)
    try:
        for mode in ("append", "update"):
            folder = str(tmp_path / mode)
            run(spark, folder, BATCHES, lambda s: streams.stream_fix_quality(s, "10 minutes", "1 minute"), mode, f"q_{mode}")
            rows = sinks.appended(spark, folder + "/out") if mode == "append" else sinks.updated(spark, folder + "/out", "window_start", "quality")
            got = {int(r.window_start.timestamp()) // 60: r.n for r in rows.collect()}
            assert got == ({0: 3, 30: 3} if mode == "append" else {0: 3, 30: 3, 300: 1})
        deadline = time.time() + 20
        while len(counter.dropped) < 2 and time.time() < deadline:
            time.sleep(0.5)
        assert counter.dropped == {"q_append": 2, "q_update": 2} or all(v >= 1 for v in counter.dropped.values())  # rows of one window are added up before
    finally:
        spark.streams.removeListener(counter)


def test_runs_in_append_mode(spark, tmp_path):
    run(spark, str(tmp_path), BATCHES, lambda s: streams.stream_gps_runs(s, "90 seconds", "1 minute"), "append", "runs")
    got = sorted((r.device_id, int(r.run_start.timestamp()) // 60, r.n) for r in sinks.appended(spark, f"{tmp_path}/out").collect())
    assert got == [(1, 0, 2), (1, 30, 2), (2, 3, 1), (2, 30, 1)]


def test_last_positions_are_forgotten(spark, tmp_path):
    """In update mode, through a restart: rows are those of the latest fixes; devices that are silent leave the state."""
    run(spark, str(tmp_path), BATCHES + [fix_rows((1, 301, 10))], lambda s: streams.stream_last_position(s, "2 hours"), "update", "last")
    got = {r.device_id: r.lng for r in sinks.updated(spark, f"{tmp_path}/out", "device_id").collect()}
    assert got == {1: 10.0, 2: 5.0, 3: 9.0}
    state = spark.read.format("statestore").option("stateVarName", "last").load(f"{tmp_path}/c")
    assert {r[0] for r in state.select("key.device_id").collect()} == {1, 3}


def test_a_repeated_batch_counts_once(spark, tmp_path):
    keep = sinks.into(str(tmp_path))
    for n in (1, 2):
        keep(spark.range(n).withColumnRenamed("id", "k"), 0)
    keep(spark.range(1).withColumnRenamed("id", "k"), 1)
    assert sinks.appended(spark, str(tmp_path)).count() == 3 and sinks.updated(spark, str(tmp_path), "k").count() == 2


def test_calls_of_the_state_do_not_grow_with_buckets(spark, monkeypatch):
    """Few events in many buckets are one span, which one timer takes; a span of many is cut, and none holds more than MOST."""

    class Map(dict):
        calls = 0

        def containsKey(self, k):  # noqa: N802
            return k in self

        def getValue(self, k):  # noqa: N802
            return self[k]

        def updateValue(self, k, v):  # noqa: N802
            Map.calls += 1
            self[k] = v

        removeKey = dict.pop  # noqa: N815

    class Value:
        v = None
        exists, get = lambda self: bool(self.v), lambda self: self.v
        update = put = lambda self, v: setattr(self, "v", v)
        clear = lambda self: setattr(self, "v", None)
        appendList = lambda self, v: setattr(self, "v", [*(self.v or ()), *v])  # noqa: E731, N815

    class Handle:
        def __init__(self):
            self.timers = []
            self.registerTimer = self.timers.append

    class At:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms

    def table(rows):
        import pandas as pd

        return pd.DataFrame([{**e, "received_at": None} for e in as_events(rows)])

    for most, step in ((1000, 20_000), (20, 1_000)):
        monkeypatch.setattr(streams, "MOST", most)
        Map.calls = 0
        r = streams.Recorder(10**12, MINUTE)
        r.handle, r.pending, r.chunks = Handle(), Map(), Map()
        r.rest, r.vertices, r.spans, r.waiting, r.late = Value(), Value(), Value(), Value(), Value()
        rows = history(600, [1], 5, step)
        shuffled = random.Random(6).sample(rows, len(rows))
        got, key = [], (1,)
        for part in (shuffled[:300], shuffled[300:]):
            list(r.handleInputRows(key, iter([table(part)]), At(0)))
        assert all(n <= most or first == last for first, last, n in r._known()[0])
        if most == 1000:
            assert Map.calls <= 8 and len(r.handle.timers) <= 2
        # a watermark in the middle, and one at the end
        for now in (rows[300][1], rows[-1][1] + 5 * MINUTE):
            for df in r.handleExpiredTimer(key, At(now), At(min(r.handle.timers))):
                got += df.to_dict("records")
            assert r.waiting.get()[0] == len(r._known()[0])
        assert not r.pending and not r.chunks
        want = recorder.new_state()
        made = [m for e in as_events(rows) if (m := recorder.step(want, recorder._clean(e)))]
        assert [(m["created_at"], m["category"], m["coordinates"]) for m in made] == [(g["created_at"], g["category"], g["coordinates"]) for g in got] and made
