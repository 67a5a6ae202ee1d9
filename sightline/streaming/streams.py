"""Structured Streaming forms of the keyed operators."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans import views as v
from ..plans.registry import query
from ..sources.shared import exists, shared_folder
from . import kernels

#: Buckets of a sink that append_batches() keeps; a batch reads those of its keys.
SINK_BUCKETS = 64


def events_stream(spark: SparkSession, d: str, parts: int = 5) -> DataFrame:
    """The events as a stream of ``parts`` files in order of their ids, one a
    micro-batch, so state is restored and rows expire on the way."""
    e, at = v.table(spark, d, "events"), shared_folder(spark, "events")
    low, high = e.agg(F.min("event_id"), F.max("event_id")).collect()[0]
    if low is not None:
        step = (high - low) // parts + 1
        for k in range(parts):  # one after another, as the source takes files by their times
            e.where(F.col("event_id").between(low + k * step, low + (k + 1) * step - 1)).coalesce(1).write.mode("append").parquet(at)
    else:
        e.write.parquet(at)
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(at)


def run_once(spark: SparkSession, stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Drain what is there into a table of files, and that table."""
    at = shared_folder(spark, f"stream-{name}")
    stream.writeStream.format("parquet").outputMode(mode).option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def suppress_repeats(stream: DataFrame, same: float = 20.0, cross: float = 1.5, late: str = "1 hour") -> DataFrame:
    """decision of every event (id, camera, plate, ts, t) in arrival order; a plate's
    state goes once the watermark has passed its windows."""

    def one(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        cams, times, last_cam, last_t = state.get if state.exists else ([], [], None, None)
        s = kernels.Suppressor(same, cross, dict(zip(cams, times, strict=True)), None if last_cam is None else (last_cam, last_t))
        for g in [pd.concat(frames).sort_values("id")]:
            yield pd.DataFrame({"id": g.id, "decision": [s.decide(str(c), t) for c, t in zip(g.camera, g.t, strict=True)]})
        s.expire(s.last[1])
        state.update((list(s.by_camera), list(s.by_camera.values()), *s.last))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, int((s.last[1] + max(same, cross)) * 1000)))

    schema = "cams array<string>, times array<double>, last_cam string, last_t double"
    return stream.withWatermark("ts", late).groupBy("plate").applyInPandasWithState(one, "id long, decision string", schema, "append", GroupStateTimeout.EventTimeTimeout)


def visit_stream(stream: DataFrame, **settings) -> DataFrame:
    """visit of every plate of (camera_id, ts, plates), with the batch kernel. A camera's
    state is its next number and the visits that have not cooled down; a camera's number
    goes on for good, so there is a row of state for each camera there is."""

    def one(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ledger = kernels.Visits(**settings)
        if state.exists:
            ledger.next_visit, opened = state.get
            ledger.open = json.loads(opened)
        rows = []
        for r in pd.concat(frames).sort_values("ts").itertuples(index=False):
            rows += [(r.camera_id, r.ts, p, n) for p, n in zip(r.plates, ledger.observe(r.ts, list(r.plates)), strict=True)]
        state.update((ledger.next_visit, json.dumps(ledger.open)))
        if rows:
            yield pd.DataFrame(rows, columns=["camera_id", "ts", "plate", "visit"])

    return stream.groupBy("camera_id").applyInPandasWithState(one, "camera_id long, ts double, plate string, visit long", "next_visit long, opened string", "append", GroupStateTimeout.NoTimeout)


def in_order(stream: DataFrame, late: str = "1 hour", idle: str = "1 day") -> DataFrame:
    """id and run of the rows (key, id, ts, epoch, seq) that are newer than all before
    them of their producer's run, in order of arrival. Another epoch begins a run, for
    which nothing has come before; a null epoch says nothing. A key's state goes when it
    has been idle for so long."""
    hold = int(pd.Timedelta(idle).total_seconds() * 1000)

    def one(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        epoch, run, last = state.get if state.exists else (None, 0, None)
        g, kept = pd.concat(frames).sort_values("id"), []
        for i, e, seq in zip(g.id, g.epoch, g.seq, strict=True):
            if isinstance(e, str) and e != epoch:
                run, last, epoch = run + (epoch is not None), None if epoch is not None else last, e
            if last is None or seq > last:
                last = int(seq)
                kept.append((i, run))
        state.update((epoch, run, last))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), int(g.ts.max().timestamp() * 1000)) + hold)
        if kept:
            yield pd.DataFrame(kept, columns=["id", "run"])

    return stream.withWatermark("ts", late).groupBy("key").applyInPandasWithState(one, "id long, run int", "epoch string, run int, last long", "append", GroupStateTimeout.EventTimeTimeout)


def fusion_stream(stream: DataFrame, layout: list[str], late: str = "1 hour", hold: str = "1 hour", **settings) -> DataFrame:
    """text, confidence and phase of a track after ``frames`` readings (track_id, ts, t,
    text, confidence, quality), once a batch; when the watermark is ``hold`` past its last
    reading the track's last word is given again as ``final`` and its state goes."""
    wait = int(pd.Timedelta(hold).total_seconds() * 1000)
    columns = ["track_id", "frames", "text", "confidence", "phase"]

    def one(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        e = kernels.Evidence(layout, **settings)
        if state.exists:
            slots, e.last, e.frames, e.independent = state.get
            e.slots = json.loads(slots)
        if state.hasTimedOut:
            state.remove()
            text, confidence, phase = e.decide()
            yield pd.DataFrame([(key[0], e.frames, text, confidence, "final" if phase == "locked" else "lost")], columns=columns)
            return
        g = pd.concat(frames).sort_values(["t", "text", "confidence", "quality"])
        for r in g.itertuples(index=False):
            e.add(r.t, r.text, r.confidence, r.quality)
        state.update((json.dumps(e.slots), e.last, e.frames, e.independent))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), int(g.ts.max().timestamp() * 1000)) + wait)
        yield pd.DataFrame([(key[0], e.frames, *e.decide())], columns=columns)

    schema = "slots string, last double, frames int, independent int"
    return stream.withWatermark("ts", late).groupBy("track_id").applyInPandasWithState(one, "track_id long, frames int, text string, confidence double, phase string", schema, "append", GroupStateTimeout.EventTimeTimeout)


def append_batches(stream: DataFrame, path: str, key: str, checkpoint: str) -> None:
    """Append each micro-batch's rows whose key is not there yet; a batch that is
    run again appends nothing. The sink is dealt into buckets by the key, and a batch
    reads those that its keys fall into."""
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        new = batch.dropDuplicates([key]).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(SINK_BUCKETS)).cast("int")).persist()
        buckets = [r[0] for r in new.select("bucket").distinct().collect()]  # at most SINK_BUCKETS
        if buckets and exists(spark, path):
            there = spark.read.schema(new.schema).parquet(path).where(F.col("bucket").isin(buckets)).select(key)
            fresh = new.join(there, key, "left_anti")
        else:
            fresh = new
        fresh.write.mode("append").partitionBy("bucket").parquet(path)
        new.unpersist()

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _named(df: DataFrame) -> DataFrame:
    k = F.regexp_extract("props", r'"k": *(\d+)', 1).cast("int")
    return df.select(F.col("event_id").alias("id"), F.col("user_id").alias("camera_id"), F.col("user_id").cast("string").alias("camera"), (k % 5).cast("string").alias("plate"), F.col("ts").cast("timestamp").alias("ts"), (v.micros(F.col("ts")) / 1e6).alias("t"))


@query("stream_latest", "SELECT user_id AS camera_id, max(event_id) AS id FROM events GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Latest wins per camera; the same plan runs on a stream as an update."""
    at = shared_folder(spark, "stream-latest")
    latest = _named(events_stream(spark, d)).groupBy("camera_id").agg(F.max("id").alias("id"))
    last = lambda batch, n: batch.write.mode("overwrite").parquet(f"{at}/out")
    latest.writeStream.outputMode("complete").foreachBatch(last).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/out")


@query("stream_in_order", """WITH e AS (SELECT event_id AS id, user_id, event_id - CASE WHEN event_id % 10 = 9 THEN 400 ELSE 0 END AS seq, CASE WHEN event_id % 7 > 0 THEN 'e' || (event_id // 3300) END AS epoch FROM events),
    f AS (SELECT *, last_value(epoch IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS now FROM e), g AS (SELECT *, lag(now) OVER (PARTITION BY user_id ORDER BY id) AS old FROM f),
    r AS (SELECT id, user_id, seq, sum(CASE WHEN old IS NOT NULL AND now <> old THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY id)::INTEGER AS run FROM g)
    SELECT id, run FROM r QUALIFY seq > coalesce(max(seq) OVER (PARTITION BY user_id, run ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1000)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Rows not older than what has come before of their producer's run."""
    k = F.col("event_id")
    rows = events_stream(spark, d).select(F.col("user_id").alias("key"), k.alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.when(k % 7 > 0, F.concat(F.lit("e"), F.floor(k / 3300))).alias("epoch"), (k - F.when(k % 10 == 9, 400).otherwise(0)).alias("seq"))
    return run_once(spark, in_order(rows, idle="60 days"), "in-order")


def _stream_readings(df: DataFrame) -> DataFrame:
    """Readings of (id, camera_id, t, ts, plate number): each camera is a track."""
    k = F.col("id")
    return df.select(F.col("camera_id").alias("track_id"), "ts", "t", v.plate_of((F.col("camera_id") + F.when(k % 6 == 0, 1).otherwise(0)).cast("int") % 100).alias("text"), (0.6 + k % 40 / 100).alias("confidence"), (0.3 + k % 70 / 100).alias("quality"))


@query("stream_fused_tracks")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The last word of the stream on each camera's track, of all that it has said."""
    from ..operators.fusion import LAYOUT

    said = run_once(spark, fusion_stream(_stream_readings(_named(events_stream(spark, d))), LAYOUT, hold="60 days"), "fusion")
    return said.groupBy("track_id").agg(F.max("frames").alias("frames"), F.max_by("text", "frames").alias("text"), F.max_by("confidence", "frames").alias("confidence"), F.max_by("phase", "frames").alias("phase"))


@query("stream_suppress_repeats", v.sql("""e AS (SELECT id, camera_id, t, CAST(k % 5 AS VARCHAR) AS plate FROM sightings);
    SELECT id, CASE WHEN t - lag(t) OVER w <= 7200 THEN 'same_camera_window' WHEN t - lag(t) OVER g <= 900 AND lag(camera_id) OVER g <> camera_id THEN 'overlapping_camera_window' ELSE 'new' END AS decision
    FROM e WINDOW w AS (PARTITION BY camera_id, plate ORDER BY id), g AS (PARTITION BY plate ORDER BY id)""", "sightings"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return run_once(spark, suppress_repeats(_named(events_stream(spark, d)), 7200.0, 900.0), "suppress")


@query("stream_visits")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = _named(events_stream(spark, d))
    plates_ = F.when(F.col("id") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array("plate"))
    stream = s.select("camera_id", F.col("t").alias("ts"), plates_.alias("plates"))
    return run_once(spark, visit_stream(stream, absence_seconds=3600.0, cooldown=14400.0), "visits")


@query("stream_append_once", "SELECT DISTINCT user_id AS camera_id FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    at = shared_folder(spark, "stream-append")
    append_batches(_named(events_stream(spark, d)).select("camera_id"), f"{at}/out", "camera_id", f"{at}/checkpoint")
    return spark.read.parquet(f"{at}/out").select("camera_id")
