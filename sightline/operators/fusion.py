"""Fusion of a track's readings over time, its calibration, and event accuracy."""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import plates
from ..functions.numbers import rate, rate_or_null
from ..plans import views as v
from ..plans.registry import query
from ..streaming.kernels import Agreement, Evidence, least_evidence
from .joins import eligible, expected_events, grid, predicted_events
from .matching import match_events

D, L = plates.ASCII_DIGITS, plates.LETTERS + plates.LATIN_LETTERS
LAYOUT = [D, D, L, D, D, D, D, D]
GRID = {"gap_seconds": [0.08, 1.5], "min_confidence": [0.55, 0.70, 0.85], "min_margin": [0.1, 0.3], "min_support": [1, 2, 3]}
#: Parameters of Evidence that it holds against the least of a track's places.
THRESHOLDS = ("min_confidence", "min_margin", "min_support")
#: The calibration gate.
GATE_EXACT, GATE_PRECISION, GATE_FALSE = 0.99, 0.995, 0.001


def _decide(readings: list[dict], **settings) -> tuple[str, float, str]:
    e = Evidence(LAYOUT, **settings)
    for r in readings:
        e.add(r["ts"], r["text"], r["confidence"], r["quality"])
    return e.decide()


def _sequences(obs: DataFrame) -> DataFrame:
    """One row a track with its readings in order; tracks are short and many, so
    rows go to Python in batches, not a group at a time."""
    return obs.groupBy("track_id").agg(F.sort_array(F.collect_list(F.struct("ts", "text", "confidence", "quality"))).alias("readings"))


def fuse_tracks(obs: DataFrame, **settings) -> DataFrame:
    """text, confidence and phase of each track of (track_id, ts, text, confidence,
    quality)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_decide(r, **settings) for r in b.column(1).to_pylist()]
            columns = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.string(), pa.float64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["track_id", "text", "confidence", "phase"])

    return _sequences(obs).mapInArrow(each, "track_id long, text string, confidence double, phase string")


def _whole_tracks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows, which come in order of their first column, in batches that no value of
    it spans."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not len(b):
            continue
        tracks = b.column(0).to_numpy()
        if held and held[-1].column(0)[0].as_py() == tracks[-1]:
            held.append(b)
            continue
        cut = int(np.searchsorted(tracks, tracks[-1]))
        if held or cut:
            yield pa.concat_batches([*held, b.slice(0, cut)])
        held = [b.slice(cut)]
    if held:
        yield pa.concat_batches(held)


def replay(obs: DataFrame, expected: DataFrame, parameters: dict[str, list]) -> DataFrame:
    """(ordinal, split, readable, taken, hit, tracks): how many tracks of every
    configuration came out so. Configurations that differ in thresholds only read the
    evidence once, which gives how many values of each threshold a track reaches; the
    grid then goes to the counts of tracks that reach as many, not to the tracks."""
    configs = [Evidence(LAYOUT, **c) for c in grid(parameters)]
    worth = list(dict.fromkeys((c.gap_seconds, c.correlated) for c in configs))
    steps = [sorted({getattr(c, t) for c in configs}) for t in THRESHOLDS]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _whole_tracks(batches):
            tracks, ts, confidence, quality = (b.column(k).to_numpy() for k in (0, 1, 3, 4))
            starts, text = np.flatnonzero(np.diff(tracks, prepend=tracks[0] - 1)), b.column(2).dictionary_encode()
            for run, (said, *least) in enumerate(least_evidence(LAYOUT, starts, ts, text.dictionary.to_pylist(), text.indices.to_numpy(), confidence, quality, worth)):
                reached = [(x[:, None] >= np.array(s)).sum(1) for x, s in zip(least, steps, strict=True)]
                columns = [pa.array(tracks[starts]), pa.array(np.full(len(starts), run, np.int32)), pa.array(said, pa.string()), *[pa.array(r.astype(np.int32)) for r in reached]]
                yield pa.RecordBatch.from_arrays(columns, names=["track_id", "run", "text", *THRESHOLDS])

    # A reading without time comes first, and those without a track are nobody's.
    rows = obs.where("track_id IS NOT NULL").select("track_id", F.coalesce("ts", F.lit(float("-inf"))).alias("ts"), "text", "confidence", "quality")
    rows = rows.repartition("track_id").sortWithinPartitions("track_id", "ts", "text", "confidence", "quality")
    found = rows.mapInArrow(each, f"track_id long, run int, text string, {', '.join(f'{t} int' for t in THRESHOLDS)}")
    cells = found.join(expected, "track_id").groupBy("run", "split", (F.col("expected") != "").alias("readable"), (F.col("expected") == F.col("text")).alias("same"), *THRESHOLDS).agg(F.count("*").alias("tracks"))
    needed = [(k, worth.index((c.gap_seconds, c.correlated)), *[s.index(getattr(c, t)) for t, s in zip(THRESHOLDS, steps, strict=True)]) for k, c in enumerate(configs)]
    grid_rows = obs.sparkSession.createDataFrame(needed, f"ordinal int, run int, {', '.join(f'least_{t} int' for t in THRESHOLDS)}")
    taken = functools.reduce(operator.and_, [F.col(t) > F.col(f"least_{t}") for t in THRESHOLDS])
    return cells.join(F.broadcast(grid_rows), "run").select("ordinal", "split", "readable", taken.alias("taken"), (F.col("readable") & taken & F.col("same")).alias("hit"), "tracks")


def config_metrics(rows: DataFrame) -> DataFrame:
    """Per configuration and split: accuracy over readable tracks, precision over
    what was taken, false accepts over the others."""
    n = lambda c: F.sum(F.when(c, F.col("tracks")).otherwise(0))
    readable, taken, hit = F.col("readable"), F.col("taken"), F.col("hit")
    return rows.groupBy("ordinal", "split").agg(
        F.sum("tracks").alias("tracks"),
        rate(n(hit), n(readable)).alias("accuracy"),
        rate(n(taken), F.sum("tracks")).alias("coverage"),
        rate(n(hit), n(taken)).alias("precision"),
        n(~readable & taken).alias("false_accepts"),
    )


def calibrate(metrics: DataFrame) -> DataFrame:
    """The best configuration on the training split, with its holdout figures and
    the reasons against it. The metrics are taken once for both splits: used twice,
    they would be replayed twice."""
    of = lambda split, *cs: F.max(F.when(F.col("split") == split, F.struct(*cs))).alias(split)
    both = metrics.groupBy("ordinal").agg(of("train", "accuracy", "precision", -F.col("false_accepts"), -F.col("ordinal")), of("holdout", "ordinal", "accuracy", "precision", "false_accepts", "tracks"))
    h = both.where("train IS NOT NULL").agg(F.max_by("holdout", "train").alias("h")).where("h IS NOT NULL").select("h.*")
    reasons = F.array_compact(F.array(F.when(F.col("accuracy") < GATE_EXACT, "exact"), F.when(F.col("precision") < GATE_PRECISION, "precision"), F.when(rate(F.col("false_accepts"), F.col("tracks")) > GATE_FALSE, "false-accepts")))
    return h.select("ordinal", "accuracy", "precision", F.array_join(reasons, ",").alias("reasons"))


def event_accuracy(expected: DataFrame, predicted: DataFrame, matches: DataFrame) -> DataFrame:
    """Per category of samples: matched, missed, false positives, duplicates; the
    precision only where every sample's labels are exhaustive. Columns sample,
    category, scope, plate."""
    e = expected.groupBy("sample", "category", "scope").agg(F.count("*").alias("n_expected"))
    p = predicted.groupBy("sample").agg(F.count("*").alias("n_predicted"))
    m = matches.groupBy("sample").agg(F.count("*").alias("n_matched"))
    counts = predicted.groupBy("sample", "plate").agg(F.count("*").alias("np")).join(expected.groupBy("sample", "plate").agg(F.count("*").alias("ne")), ["sample", "plate"], "left")
    over = F.greatest(F.lit(0), F.col("np") - F.greatest(F.lit(1), F.coalesce("ne", F.lit(0))))
    dup = counts.groupBy("sample").agg(F.sum(over).alias("n_duplicate"))
    rows = e.join(p, "sample", "left").join(m, "sample", "left").join(dup, "sample", "left").fillna(0)
    total = rows.groupBy("category").agg(*[F.sum(c).alias(c) for c in ("n_expected", "n_predicted", "n_matched", "n_duplicate")], F.bool_and(F.col("scope") == "exhaustive").alias("complete"))
    return total.select(
        "category",
        F.col("n_matched").alias("matched"),
        (F.col("n_expected") - F.col("n_matched")).alias("missed"),
        F.when(F.col("complete"), F.col("n_predicted") - F.col("n_matched")).alias("false_positives"),
        F.col("n_duplicate").alias("duplicates"),
        rate_or_null(F.col("n_matched"), F.col("n_expected")).alias("recall"),
        F.when(F.col("complete"), rate_or_null(F.col("n_matched"), F.col("n_predicted"))).alias("precision"),
    )


def manifest_violations(samples: DataFrame, categories: list[str]) -> DataFrame:
    """Every broken rule of an accuracy manifest (sample_id, enabled, category, scope,
    plate, n_events, start_ms, end_ms), one row each: all of them, not the first."""
    s = samples.where("enabled")
    whole = lambda c: F.coalesce(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf")), F.lit(True))
    finite = whole("start_ms") & whole("end_ms")
    bad = F.array_compact(
        F.array(
            F.when(~plates.is_identifier(F.col("sample_id")), "invalid-sample-id"),
            F.when(~F.col("category").isin(*categories), "unknown-category"),
            F.when(~F.col("scope").isin("exhaustive", "known_positives"), "unknown-scope"),
            F.when(F.col("plate").isNotNull() == (F.col("n_events") > 0), "one-of-label-or-events"),
            F.when((F.col("n_events") == 0) & F.col("plate").isNull() & (F.col("scope") != "exhaustive"), "negative-must-be-exhaustive"),
            F.when(~finite, "window-not-finite").when(F.col("start_ms") > F.col("end_ms"), "window-reversed"),
        )
    )
    rows = s.select("sample_id", F.explode(bad).alias("violation"))
    twice = s.groupBy("sample_id").count().where("count > 1").select("sample_id", F.lit("duplicate-sample-id").alias("violation"))
    absent = samples.sparkSession.createDataFrame([(c,) for c in categories], "category string").join(s.select("category"), "category", "left_anti")
    return rows.unionByName(twice).unionByName(absent.select(F.col("category").alias("sample_id"), F.lit("category-not-covered").alias("violation")))


def strict_evidence(samples: DataFrame, media: DataFrame) -> DataFrame:
    """violation of every enabled sample (sample_id, enabled, media_path, fingerprint)
    whose medium (path, sha256) is not there or is not the one that was labelled."""
    j = samples.where("enabled").join(media.select(F.col("path").alias("media_path"), F.lower("sha256").alias("_sha")), "media_path", "left")
    violation = F.when(~F.coalesce(plates.is_digest(F.col("fingerprint")), F.lit(False)), "invalid-fingerprint").when(F.col("_sha").isNull(), "media-missing").when(F.col("_sha") != F.lower("fingerprint"), "fingerprint-mismatch")
    return j.select("sample_id", violation.alias("violation")).where("violation IS NOT NULL")


def ab_gate(a: DataFrame, b: DataFrame, metrics: list[str], key: str = "category") -> DataFrame:
    """Whether b is nowhere worse than a: null where a metric is missing on either
    side."""
    j = a.select(key, *[F.col(m).alias(f"a_{m}") for m in metrics]).join(b.select(key, *metrics), key, "full")
    missing = F.lit(False)
    worse = F.lit(False)
    for m in metrics:
        missing = missing | F.col(m).isNull() | F.col(f"a_{m}").isNull()
        worse = worse | F.coalesce(F.col(m) < F.col(f"a_{m}"), F.lit(False))
    return j.agg(F.when(F.bool_or(missing), F.lit(None).cast("boolean")).otherwise(~F.bool_or(worse)).alias("not_worse"))


def engines_agree(readings: DataFrame, window: float = 1.5) -> DataFrame:
    """Verdicts per camera of (camera_id, ts, engine, text) from two engines."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        a, out = Agreement(window), []
        for r in g.sort_values(["ts", "engine", "text"]).itertuples(index=False):
            out += a.add(r.ts, r.engine, r.text)
        out += a.flush()
        return pd.DataFrame([(g.camera_id.iloc[0], t, x) for t, x in out], columns=["camera_id", "ts", "verdict"])

    return readings.groupBy("camera_id").applyInPandas(one, "camera_id long, ts double, verdict string")


def detect(frames: DataFrame, detector, schema: str) -> DataFrame:
    """Rows of an external detector: ``detector`` turns a pandas batch of frames into
    none or more detections."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield detector(b)

    return frames.mapInPandas(each, schema)


def unreadable(rows: DataFrame) -> DataFrame:
    """Tracks long enough to be called unreadable: three readings, five if one was
    plausible, over 0.8 s."""
    least = F.when(F.max(plates.plausible(F.col("text"))), 5).otherwise(3)
    return rows.groupBy("track_id").agg(((F.count("*") >= least) & (F.max("ts") - F.min("ts") >= 0.8)).alias("ready"))


def collect_trigger(rows: DataFrame) -> DataFrame:
    """Why a track's candidates are read now, after evidence skewed by more than
    350 ms is left out."""
    near = rows.where(F.abs(F.col("skew_ms")) <= 350)
    a = near.groupBy("track_id").agg(F.count("*").alias("n"), F.max("quality").alias("q"), (F.max("seq") - F.min("seq")).alias("age"))
    return a.select("track_id", F.when(F.col("n") >= 2, "enough").when(F.col("q") >= 0.82, "clear").when(F.col("age") >= 8, "old").otherwise("wait").alias("trigger"))


def _obs(spark: SparkSession, d: str) -> DataFrame:
    o = v.observations(spark, d)
    return o.select("track_id", F.col("seq").cast("double").alias("ts"), "text", (F.col("confidence_pct") / 100).alias("confidence"), (F.col("quality_pct") / 100).alias("quality"))


@query("fused_tracks")
def _(spark: SparkSession, d: str) -> DataFrame:
    return fuse_tracks(_obs(spark, d))


@query("calibration")
def _(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    expected = v.table(spark, d, "orders").select(k.alias("track_id"), F.when(k % 4 == 0, "holdout").otherwise("train").alias("split"), F.when(k % 10 == 0, "").otherwise(v.plate_of((k % 100).cast("int"))).alias("expected"))
    return calibrate(config_metrics(replay(_obs(spark, d), expected, GRID)))


@query("event_accuracy")
def _(spark: SparkSession, d: str) -> DataFrame:
    e, p = expected_events(spark, d), predicted_events(spark, d)
    pairs = eligible(e, p, ["sample"]).select("sample", "e.e", "p.p", F.lit(0.0).alias("distance"))
    e = e.withColumn("category", F.col("sample") % 8).withColumn("scope", F.when(F.col("sample") % 3 == 0, "known_positives").otherwise("exhaustive")).withColumn("plate", F.col("e") % 9)
    return event_accuracy(e, p.withColumn("plate", F.col("p") % 9), match_events(pairs, "sample"))


_SAMPLES = "s AS (SELECT CASE WHEN o_orderkey % 97 = 0 THEN ' x' ELSE 's' || (o_orderkey % 900) END AS sample_id, o_orderkey % 3 <> 0 AS enabled, 'c' || (o_orderkey % 9) AS category, CASE WHEN o_orderkey % 2 = 0 THEN 'exhaustive' WHEN o_orderkey % 31 = 0 THEN 'other' ELSE 'known_positives' END AS scope, CASE WHEN o_orderkey % 5 < 3 THEN 'p' END AS plate, o_orderkey % 4 AS n, o_custkey AS a, o_orderkey AS z FROM orders), e AS (SELECT * FROM s WHERE enabled)"


@query("manifest_violations", f"""WITH {_SAMPLES}, r AS (SELECT sample_id, unnest([CASE WHEN sample_id = ' x' THEN 'invalid-sample-id' END, CASE WHEN category = 'c8' THEN 'unknown-category' END, CASE WHEN scope = 'other' THEN 'unknown-scope' END,
    CASE WHEN (plate IS NOT NULL) = (n > 0) THEN 'one-of-label-or-events' END, CASE WHEN n = 0 AND plate IS NULL AND scope <> 'exhaustive' THEN 'negative-must-be-exhaustive' END, CASE WHEN z % 83 = 0 THEN 'window-not-finite' WHEN a > z THEN 'window-reversed' END]) AS violation FROM e)
    SELECT sample_id, violation FROM r WHERE violation IS NOT NULL UNION ALL SELECT sample_id, 'duplicate-sample-id' FROM e GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT c, 'category-not-covered' FROM (SELECT unnest(['c0', 'c1', 'c2', 'c3', 'c4', 'c5', 'c6', 'c7', 'zz']) AS c) WHERE c NOT IN (SELECT category FROM e)""".replace("category = 'c8'", "category NOT IN ('c0', 'c1', 'c2', 'c3', 'c4', 'c5', 'c6', 'c7', 'zz')"))
def _(spark: SparkSession, d: str) -> DataFrame:
    o, k = v.table(spark, d, "orders"), F.col("o_orderkey")
    s = o.select(
        F.when(k % 97 == 0, " x").otherwise(F.concat(F.lit("s"), k % 900)).alias("sample_id"),
        (k % 3 != 0).alias("enabled"),
        F.concat(F.lit("c"), k % 9).alias("category"),
        F.when(k % 2 == 0, "exhaustive").when(k % 31 == 0, "other").otherwise("known_positives").alias("scope"),
        F.when(k % 5 < 3, "p").alias("plate"),
        (k % 4).alias("n_events"),
        F.when(k % 83 == 0, float("nan")).otherwise(F.col("o_custkey").cast("double")).alias("start_ms"),
        k.cast("double").alias("end_ms"),
    )
    return manifest_violations(s, [*[f"c{i}" for i in range(8)], "zz"])


@query("ab_gate", "WITH a AS (SELECT l_returnflag AS category, count(*) AS n FROM lineitem WHERE l_linenumber < 4 GROUP BY 1), b AS (SELECT l_returnflag AS category, count(*) AS n FROM lineitem GROUP BY 1) SELECT CASE WHEN bool_or(a.n IS NULL OR b.n IS NULL) THEN NULL ELSE NOT bool_or(b.n < a.n) END AS not_worse FROM a FULL JOIN b USING (category)")
def _(spark: SparkSession, d: str) -> DataFrame:
    li = v.table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "category")
    n = lambda x: x.groupBy("category").agg(F.count("*").alias("n"))
    return ab_gate(n(li.where("l_linenumber < 4")), n(li), ["n"])


@query("engines_agree")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = v.sightings(spark, d)
    return engines_agree(s.select("camera_id", F.col("t").alias("ts"), F.concat(F.lit("e"), F.col("id") % 2).alias("engine"), (F.col("k") % 3).cast("string").alias("text")), 7200.0)


@query("unreadable_tracks", v.sql(f"SELECT camera_id AS track_id, count(*) >= CASE WHEN max(regexp_matches(plate_norm, '{plates.PLATE}')::INT) = 1 THEN 5 ELSE 3 END AND max(t) - min(t) >= 0.8 AS ready FROM sightings GROUP BY 1", "sightings"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return unreadable(v.sightings(spark, d).select(F.col("camera_id").alias("track_id"), F.col("plate_norm").alias("text"), F.col("t").alias("ts")))


@query("collect_triggers", v.sql("a AS (SELECT camera_id AS track_id, count(*) AS n, max(confidence) AS q, max(id) - min(id) AS age FROM sightings WHERE k * 10 <= 350 GROUP BY 1); SELECT track_id, CASE WHEN n >= 2 THEN 'enough' WHEN q >= 0.82 THEN 'clear' WHEN age >= 8 THEN 'old' ELSE 'wait' END AS trigger FROM a", "sightings"))
def _(spark: SparkSession, d: str) -> DataFrame:
    s = v.sightings(spark, d)
    return collect_trigger(s.select(F.col("camera_id").alias("track_id"), F.col("id").alias("seq"), F.col("confidence").alias("quality"), (F.col("k") * 10).alias("skew_ms")))


@query("detected_boxes", "WITH n AS (SELECT event_id AS id, unnest(range(0, event_id % 3)) AS n FROM events) SELECT id, CAST(n AS INTEGER) AS n, (id % 50 + 10 * n)::DOUBLE AS x1, 0.9::DOUBLE - 0.1::DOUBLE * n AS score FROM n")
def _(spark: SparkSession, d: str) -> DataFrame:
    """A stand-in for a detector: none to two boxes a frame."""

    def detector(frames: pd.DataFrame) -> pd.DataFrame:
        rows = [(i, n, float(i % 50 + 10 * n), 0.9 - 0.1 * n) for i in frames.id for n in range(i % 3)]
        return pd.DataFrame(rows, columns=["id", "n", "x1", "score"]).astype({"id": "int64", "n": "int32", "x1": "float64", "score": "float64"})

    return detect(v.table(spark, d, "events").select(F.col("event_id").alias("id")), detector, "id long, n int, x1 double, score double")


@query("strict_evidence", """WITH s AS (SELECT 's' || o_orderkey AS sample_id, 'm' || (o_orderkey % 500) AS media_path, CASE WHEN o_orderkey % 17 = 0 THEN 'x' WHEN o_orderkey % 13 = 0 THEN sha256('other') ELSE upper(sha256('m' || (o_orderkey % 500))) END AS fingerprint FROM orders WHERE o_orderkey % 4 <> 0)
    SELECT sample_id, CASE WHEN length(fingerprint) < 64 THEN 'invalid-fingerprint' WHEN CAST(substr(media_path, 2) AS INTEGER) % 9 = 0 THEN 'media-missing' WHEN lower(fingerprint) <> sha256(media_path) THEN 'fingerprint-mismatch' END AS violation FROM s WHERE violation IS NOT NULL""")
def _(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    path = F.concat(F.lit("m"), k % 500)
    s = v.table(spark, d, "orders").select(F.concat(F.lit("s"), k).alias("sample_id"), (k % 4 != 0).alias("enabled"), path.alias("media_path"), F.when(k % 17 == 0, "x").when(k % 13 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.upper(F.sha2(path, 256))).alias("fingerprint"))
    media = spark.range(500).where("id % 9 <> 0").select(F.concat(F.lit("m"), "id").alias("path"))
    return strict_evidence(s, media.select("path", F.sha2("path", 256).alias("sha256")))
