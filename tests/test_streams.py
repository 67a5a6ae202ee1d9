"""Streams over several micro-batches: restored state, expiry, restarts."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sightline.operators import fusion
from sightline.plans import views as v
from sightline.plans.catalog import QUERIES
from sightline.sources import files
from sightline.sources.shared import shared_folder
from sightline.streaming import kernels, streams

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def rows(df):
    return Counter(map(tuple, df.select(*sorted(df.columns)).collect()))


def test_visits_are_the_batch_form(spark):
    assert rows(QUERIES["stream_visits"](spark, SF)) == rows(QUERIES["visits"](spark, SF))


def test_fusion_is_the_batch_form(spark):
    got = {r.track_id: (r.text, r.confidence, r.phase) for r in QUERIES["stream_fused_tracks"](spark, SF).collect()}
    batch = streams._stream_readings(streams._named(v.table(spark, SF, "events"))).withColumnRenamed("ts", "at").withColumn("ts", F.col("t"))
    assert got == {r.track_id: (r.text, r.confidence, r.phase) for r in fusion.fuse_tracks(batch).collect()}


def feed(spark, at, name, data, schema):
    spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(f"{at}/{name}")


def test_fusion_ends_when_a_track_goes(spark):
    import datetime as dt

    at, schema = shared_folder(spark, "fusion-test"), "track_id long, ts timestamp, t double, text string, confidence double, quality double"
    row = lambda track, s, text: (track, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s), float(s), text, 0.9, 0.8)
    for batch in ([row(1, s, "12ب34567") for s in range(3)], [row(2, 4000, "98س76511")], [row(3, 9000, "98س76511")], [row(3, 9100, "98س76511")], [row(2, 9200, "98س76511")]):
        feed(spark, at, "in", batch, schema)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    said = streams.run_once(spark, streams.fusion_stream(stream, fusion.LAYOUT, late="1 second", hold="1 hour"), "fusion-test").collect()
    assert [(r.frames, r.text) for r in said if r.track_id == 1 and r.phase == "final"] == [(3, "12ب34567")]
    assert [r.frames for r in said if r.track_id == 2] == [1, 1, 1] and sum(r.phase == "lost" for r in said if r.track_id == 2) == 1  # its state had gone before it came again


def test_repeats_are_forgotten(spark):
    """Over several batches a plate's state expires with the watermark."""
    import datetime as dt

    at, schema = shared_folder(spark, "repeat-test"), "id long, camera string, plate string, ts timestamp, t double"
    row = lambda i, s, plate="p": (i, "a", plate, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s), 1704067200.0 + s)
    for batch in ([row(1, 0), row(2, 10)], [row(3, 25)], [row(4, 500, "q")], [row(5, 900)], [row(6, 905)]):
        feed(spark, at, "in", batch, schema)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    got = {r.id: r.decision for r in streams.run_once(spark, streams.suppress_repeats(stream, late="5 seconds"), "repeat-test").collect()}
    same = "same_camera_window"
    assert got == {1: "new", 2: same, 3: same, 4: "new", 5: "new", 6: same}


def test_a_restarted_stream_goes_on(spark):
    at, schema = shared_folder(spark, "restart-test"), "key long, id long, ts timestamp, epoch string, seq long"
    import datetime as dt

    row = lambda i, epoch, seq: (1, i, dt.datetime(2024, 1, 1, 0, i), epoch, seq)

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
        streams.in_order(stream).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        return sorted((r.id, r.run) for r in spark.read.schema("id long, run int").parquet(f"{at}/out").collect())

    feed(spark, at, "in", [row(1, None, 5), row(2, "a", 4), row(3, "a", 6)], schema)
    assert run() == [(1, 0), (3, 0)]
    feed(spark, at, "in", [row(4, None, 6), row(5, "b", 1), row(6, None, 1), row(7, "b", 2)], schema)
    assert run() == [(1, 0), (3, 0), (5, 1), (7, 1)]  # another epoch begins anew
    feed(spark, at, "in", [row(8, "b", 2), row(9, "a", 0)], schema)
    assert run() == [(1, 0), (3, 0), (5, 1), (7, 1), (9, 2)]


def test_append_batches_again(spark):
    at = shared_folder(spark, "append-test")
    for k in range(3):
        feed(spark, at, "in", [(i,) for i in range(10 * k, 10 * k + 15)], "key long")
    stream = spark.readStream.schema("key long").option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    for n in range(2):  # the second time with a checkpoint that knows nothing
        streams.append_batches(stream, f"{at}/out", "key", f"{at}/checkpoint-{n}")
        assert sorted(r.key for r in spark.read.parquet(f"{at}/out").collect()) == list(range(35))


def test_publications(spark):
    at, df = shared_folder(spark, "publish-test"), spark.range(9)
    files.publish(df, f"{at}/a")
    with pytest.raises(Exception):
        files.publish(df, f"{at}/a")  # never over another one
    path, there = files.publish_addressed(df, at)
    assert not there and files.publish_addressed(df.orderBy(F.desc("id")), at) == (path, True)
    assert files.publish_addressed(spark.range(8), at)[0] != path
    ran = []
    with pytest.raises(RuntimeError):
        files.once(spark, f"{at}/m", lambda: (_ for _ in ()).throw(RuntimeError()))
    assert files.once(spark, f"{at}/m", lambda: ran.append(1)) and not files.once(spark, f"{at}/m", lambda: ran.append(2)) and ran == [1]


def test_manifests(spark, tmp_path):
    (tmp_path / "m.csv").write_text("\ufeffid,media_path,readable,expected_plate,slices,media_kind,frame_index,more\n\na,b,yes,p,x|Y | x,image,0,z\n,b,no,p,,image,0,z\n")
    good, bad = files.read_golden(spark, str(tmp_path / "m.csv"))
    assert [(r.id, r.slices, r.readable) for r in good.collect()] == [("a", ["x", "y"], True)]
    assert [(r.line, r.reason) for r in bad.collect()] == [(4, "missing:id")]
    with pytest.raises(ValueError):
        files.read_manifest(spark, str(tmp_path / "m.csv"), files.CROPS, [])


def test_supppressor_state_is_plain():
    s = kernels.Suppressor()
    s.decide("a", 1.0)
    s.expire(100.0)
    assert s.by_camera == {} and s.last == ("a", 1.0)
