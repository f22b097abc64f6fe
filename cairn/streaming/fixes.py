"""Streams of GPS fixes and user actions. The same functions run over batch tables, but for stream_recordings."""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ListState, StatefulProcessor, StatefulProcessorHandle

from cairn.functions.gps import gps_quality
from cairn.operators.recorder import OBJECT, _clean, new_state, step


def stream_fix_quality(fixes: DataFrame, window: str = "10 minutes", lateness: str = "1 minute") -> DataFrame:
    """Fixes by class and tumbling window of received_at: window_start, quality, n. Later fixes than lateness are dropped."""
    marked = fixes.withWatermark("received_at", lateness).withColumn("quality", gps_quality(F.col("accuracy")))
    return marked.groupBy(F.window("received_at", window).alias("w"), "quality").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "quality", "n")


class LastPosition(StatefulProcessor):
    """Each device's latest fix, until no fix has come for ttl_ms of event time."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms bigint, seq bigint, lng double, lat double, accuracy double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        old = tuple(self.last.get()) if self.last.exists() else None
        last = old
        for some in rows:
            some = some.sort_values(["ms", "seq"]).iloc[-1]
            new = (int(some["ms"]), int(some["seq"]), *(None if pd.isna(some[c]) else float(some[c]) for c in ("lng", "lat", "accuracy")))
            last = new if last is None or new[:2] > last[:2] else last
        if last != old:
            if old is not None:
                self.handle.deleteTimer(old[0] + self.ttl_ms)
            self.handle.registerTimer(last[0] + self.ttl_ms)
            self.last.update(last)
            yield pd.DataFrame([(key[0], last[0], *last[2:])], columns=["device_id", "ms", "lng", "lat", "accuracy"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.last.clear()
        yield pd.DataFrame([], columns=["device_id", "ms", "lng", "lat", "accuracy"])

    def close(self) -> None:
        pass


def _ms(spark: SparkSession, interval: str) -> int:
    return int(spark.sql(f"select unix_millis(timestamp_millis(0) + interval {interval})").first()[0])


def stream_last_position(fixes: DataFrame, ttl: str | None = None, lateness: str = "1 minute") -> DataFrame:
    """The latest fix of each device, of any accuracy: device_id, received_at, lng, lat, accuracy; for update mode, without a
    ttl also for complete mode.

    With a ttl, a device of which no fix has come for so long (of event time, behind the watermark) is forgotten: the state
    holds those only that still send.  If it comes back, so does its row.  Needs the RocksDB state store then.
    """
    if ttl is None:
        last = fixes.groupBy("device_id").agg(F.max_by(F.struct("received_at", "lng", "lat", "accuracy"), F.struct("received_at", "seq")).alias("f"))
        return last.select("device_id", "f.*")
    timed = fixes.select("device_id", "received_at", F.unix_millis("received_at").alias("ms"), "seq", "lng", "lat", "accuracy").withWatermark("received_at", lateness)
    schema = "device_id bigint, ms bigint, lng double, lat double, accuracy double"
    found = timed.groupBy("device_id").transformWithStateInPandas(statefulProcessor=LastPosition(_ms(fixes.sparkSession, ttl)), outputStructType=schema, outputMode="Update", timeMode="EventTime")
    return found.select("device_id", F.timestamp_millis("ms").alias("received_at"), "lng", "lat", "accuracy")


def stream_gps_runs(fixes: DataFrame, silence: str = "15 seconds", lateness: str = "1 minute") -> DataFrame:
    """Runs of fixes of a device that a silence ends: device_id, run_start, run_end (with the silence), n."""
    runs = fixes.withWatermark("received_at", lateness).groupBy("device_id", F.session_window("received_at", silence).alias("w"))
    return runs.agg(F.count("*").alias("n")).select("device_id", F.col("w.start").alias("run_start"), F.col("w.end").alias("run_end"), "n")


#: Events of a device that wait together, unless a single bucket has more.
MOST = 1000


class Vertices:
    """The open recording's vertices: those of earlier batches stay in the state, new ones are appended to it.

    Undo leaves a mark (null) there instead of taking the list apart; the list is read when a recording is finished.
    """

    def __init__(self, stored: ListState, n: int):
        self.stored, self.n, self.new = stored, n, []

    def __len__(self) -> int:
        return self.n

    def append(self, vertex: dict) -> None:
        self.n += 1
        self.new.append(vertex)

    def pop(self) -> None:
        self.n -= 1
        if self.new and self.new[-1] is not None:
            self.new.pop()
        else:
            self.new.append(None)

    def __iter__(self) -> Iterator[dict]:
        found = []
        for v in [*(json.loads(v[0]) for v in (self.stored.get() if self.stored.exists() else ())), *self.new]:
            found.pop() if v is None else found.append(v)
        return iter(found)


class Recorder(StatefulProcessor):
    """Carries each device's recorder from batch to batch, and its events until the watermark has passed them.

    Events wait in spans of buckets of event time: a span holds MOST events at most, or is a single bucket.  A device has one
    timer, at the end of its first bucket that waits; when it comes, all buckets that the watermark has passed are taken, a
    span at a time, and of a span that it stands in the rest is put back.  So neither a batch nor a timer ever holds more than
    one span of a device, however long the history that waits, and a device with few events costs as few calls of the state.
    State: rest (the recorder but for its vertices, as one value), vertices (appended to), pending (events by first bucket of
    a span and chunk), chunks (their number by span), spans (first and last bucket and number of events of each, in order, and
    the timer), waiting (the number of spans, and the last one done), and late, the number of events that came too late.
    """

    def __init__(self, ttl_ms: int, bucket_ms: int):
        self.ttl_ms, self.bucket_ms = ttl_ms, bucket_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rest = handle.getValueState("rest", "json string")
        self.vertices = handle.getListState("vertices", "json string")
        self.pending = handle.getMapState("pending", "bucket bigint, chunk bigint", "json string")
        self.chunks = handle.getMapState("chunks", "bucket bigint", "n bigint")
        self.spans = handle.getValueState("spans", "json string")
        self.waiting = handle.getValueState("waiting", "n bigint, done bigint")
        self.late = handle.getValueState("late", "n bigint")

    def _bucket(self, event: dict) -> int:
        return int(event["ts"]) // self.bucket_ms

    def _known(self) -> tuple[list[list[int]], int | None]:
        return tuple(json.loads(self.spans.get()[0])) if self.spans.exists() else ([], None)

    def _keep(self, spans: list[list[int]], timer: int | None, passed: int) -> None:
        """Stores the spans, and asks to be called when the first bucket that waits has ended."""
        if spans:
            end = (spans[0][0] + 1) * self.bucket_ms
            if timer is None or end < timer or timer <= passed:
                self.handle.registerTimer(end)
                timer = end
        self.spans.update((json.dumps((spans, timer)),))

    def _cut(self, events: list[dict]) -> Iterator[list[dict]]:
        """Events in order of time, in parts of MOST events at most or of one bucket."""
        part: list[dict] = []
        for _, some in groupby(events, self._bucket):
            some = list(some)
            if part and len(part) + len(some) > MOST:
                yield part
                part = []
            part += some
        if part:
            yield part

    def _new(self, events: list[dict]) -> list[list[int]]:
        """Writes events in order of time as spans of their own."""
        made = []
        for part in self._cut(events):
            first = self._bucket(part[0])
            self.pending.updateValue((first, 0), (json.dumps(part, default=_plain),))
            self.chunks.updateValue((first,), (1,))
            made.append([first, self._bucket(part[-1]), len(part)])
        return made

    def _add(self, spans: list[list[int]], events: list[dict]) -> None:
        """Puts events, in order of time, into the spans that hold their buckets, and into new ones between those."""
        at = 0
        while at < len(events):
            bucket = self._bucket(events[at])
            i = bisect_right(spans, bucket, key=lambda s: s[0]) - 1
            within = i >= 0 and bucket <= spans[i][1]
            beyond = spans[i][1] + 1 if within else spans[i + 1][0] if i + 1 < len(spans) else float("inf")
            upto = bisect_left(events, beyond, lo=at, key=self._bucket)
            if not within:
                spans[i + 1 : i + 1] = self._new(events[at:upto])
            else:
                first, last, n = spans[i]
                chunk = self.chunks.getValue((first,))[0]
                self.pending.updateValue((first, chunk), (json.dumps(events[at:upto], default=_plain),))
                self.chunks.updateValue((first,), (chunk + 1,))
                spans[i][2] = n + upto - at
                if spans[i][2] > MOST and first < last:
                    spans[i : i + 1] = self._new(self._read(first))
            at = upto

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """Puts events into their spans and asks to be called at a bucket's end; some rows at a time.  Late ones are counted."""
        passed, late = timerValues.getCurrentWatermarkInMs(), 0
        spans, timer = self._known()
        for some in rows:
            events = [_clean(r) for r in some.drop(columns="received_at").to_dict("records")]
            fresh = sorted((e for e in events if e["ts"] > passed or not passed), key=lambda e: e["ts"])
            late += len(events) - len(fresh)
            self._add(spans, fresh)
        self.waiting.update((len(spans), self.waiting.get()[1] if self.waiting.exists() else None))
        self._keep(spans, timer, passed)
        if late:
            self.late.update(((self.late.get()[0] if self.late.exists() else 0) + late,))
        yield pd.DataFrame([], columns=_NAMES)

    def _read(self, bucket: int) -> list[dict]:
        """The events of a span, in order; it's gone then."""
        found = []
        for chunk in range(self.chunks.getValue((bucket,))[0]):
            found += json.loads(self.pending.getValue((bucket, chunk))[0])
            self.pending.removeKey((bucket, chunk))
        self.chunks.removeKey((bucket,))
        return sorted(found, key=lambda e: (e["ts"], e["seq"]))

    def _taken(self, bucket: int) -> list[dict]:
        """The events of a span that is done, in order."""
        if not self.chunks.containsKey((bucket,)):
            return []
        n, done = self.waiting.get()
        if done is not None and bucket <= done:
            raise RuntimeError(f"bucket {bucket} came after {done}")  # spans are taken in order of time
        found = self._read(bucket)
        self.waiting.update((n - 1, bucket))
        return found

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """Takes the events of all buckets that have ended; drops a recording that nothing was added to for long."""
        passed = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        ended = passed // self.bucket_ms  # the first bucket that hasn't
        spans, timer = self._known()
        state = json.loads(self.rest.get()[0]) if self.rest.exists() else {**new_state(), "n_vertices": 0, "at": None}
        kept = state["vertices"] = Vertices(self.vertices, state.pop("n_vertices"))
        at = state.pop("at")
        abandoned = lambda until: at is not None and state["category"] is not None and until - at > self.ttl_ms

        def stored() -> Vertices:
            """Vertices are brought to the state span by span, so that those of a long recording are never held."""
            vertices = state["vertices"]
            if vertices is kept:
                if kept.new:
                    self.vertices.appendList([(json.dumps(v),) for v in kept.new])
            elif len(vertices):
                self.vertices.put([(json.dumps(v),) for v in vertices])
            else:
                self.vertices.clear()
            state["vertices"] = Vertices(self.vertices, len(vertices))
            return state["vertices"]

        while spans and spans[0][0] < ended:
            first, last, _ = spans.pop(0)
            ready, found = self._taken(first), []
            if last >= ended:
                cut = bisect_left(ready, ended, key=self._bucket)
                spans[:0] = self._new(ready[cut:])
                self.waiting.update((len(spans), first))
                ready = ready[:cut]
            for e in ready:
                if abandoned(e["ts"]):
                    state.update(category=None, object_type=None, source=None, vertices=[])
                at = e["ts"]
                made = step(state, e)
                if made:
                    found.append({"device_id": key[0], **made, "coordinates": list(made["coordinates"])})
            kept = stored()
            if found:
                yield pd.DataFrame(found, columns=_NAMES)
        if not spans and abandoned(passed):
            state.update(category=None, object_type=None, source=None, vertices=[])
        n = len(stored())
        self.rest.update((json.dumps({**{k: v for k, v in state.items() if k != "vertices"}, "n_vertices": n, "at": at}),))
        self._keep(spans, timer, passed)
        if state["category"] is not None and not spans:  # at a bucket's end, so that all events before are known by then
            self.handle.registerTimer(-(-(at + self.ttl_ms + 1) // self.bucket_ms) * self.bucket_ms)
        yield pd.DataFrame([], columns=_NAMES)

    def close(self) -> None:
        pass


_NAMES = [f.split()[0] for f in OBJECT.split(", ")[:8]] + ["coordinates"]


def _plain(x: object) -> object:
    """Numbers of numpy as Python's."""
    return x.item() if hasattr(x, "item") else str(x)


def stream_recordings(events: DataFrame, lateness: str = "1 minute", ttl: str = "12 hours", bucket: str = "1 minute") -> DataFrame:
    """Finished objects of a stream of fixes and actions (as the recorder's EVENT), by the exact recorder.

    Events count in the order of (ts, seq), whatever batches they come in: they wait until the watermark, `lateness` behind
    the latest event of all devices, has passed the end of their bucket of event time; a bucket, or MOST events, is all of a
    device's events that is ever held at once.  Later ones are dropped, and late_events counts them.  A recording to which nothing is added for
    `ttl` is dropped.  Needs the RocksDB state store.
    """
    length, width = (_ms(events.sparkSession, x) for x in (ttl, bucket))
    timed = events.withColumn("received_at", F.timestamp_millis("ts")).withWatermark("received_at", lateness)
    return timed.groupBy("device_id").transformWithStateInPandas(statefulProcessor=Recorder(length, width), outputStructType=OBJECT, outputMode="Append", timeMode="EventTime")


def late_events(spark: SparkSession, checkpoint: str) -> DataFrame:
    """How many events stream_recordings dropped as late: device_id, n; read from the query's checkpoint."""
    state = spark.read.format("statestore").option("stateVarName", "late").load(checkpoint)
    return state.select("key.device_id", F.col("value.n").alias("n"))
