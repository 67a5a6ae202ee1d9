"""One-to-one matching and other operators whose rows depend on one another; each
group is a sample, a frame or a camera's frame sequence."""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from ..functions import plates
from ..plans import views as v
from ..plans.registry import query
from ..streaming import association, kernels
from .joins import eligible, expected_events, predicted_events


def _matched(pairs: DataFrame, by: str, value: str, kernel) -> DataFrame:
    """(by, e, p) that ``kernel`` makes of each group's list of (e, p, value). Groups are
    samples, of which there are many small ones, so they go to Python as rows of a
    batch."""
    lists = pairs.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("e", "p", F.col(value).cast("double").alias("v")))).alias("l"))
    schema = pairs.select(by, "e", "p").schema

    def each(batches):
        for b in batches:
            out = [(key, e, p) for key, edges in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for e, p in kernel([(x["e"], x["p"], x["v"]) for x in edges])]
            columns = list(zip(*out, strict=True)) or [()] * 3
            kinds = (b.schema.field(0).type, b.schema.field(1).type.value_type.field("e").type, b.schema.field(1).type.value_type.field("p").type)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=schema.fieldNames())

    return lists.mapInArrow(each, schema)


def match_events(pairs: DataFrame, by: str) -> DataFrame:
    """One-to-one matches, as many as possible, from eligible pairs (e, p, distance)."""

    def one(edges):
        es, ps = sorted({e for e, _, _ in edges}), sorted({p for _, p, _ in edges})
        at, number = {p: k for k, p in enumerate(ps)}, {e: k for k, e in enumerate(es)}
        options: list[list[int]] = [[] for _ in es]
        for e, p, _ in sorted(edges, key=lambda x: (x[2], x[1])):
            options[number[e]].append(at[p])
        return [(es[a], ps[b]) for a, b in kernels.max_matching(options).items()]

    return _matched(pairs, by, "distance", one)


def assign(pairs: DataFrame, by: str, missing: float) -> DataFrame:
    """The assignment of least total cost from (e, p, cost); a pair that is not
    there is forbidden, an e left out costs ``missing``."""

    def one(edges):
        es, ps = sorted({e for e, _, _ in edges}), sorted({p for _, p, _ in edges})
        at, cost = {p: k for k, p in enumerate(ps)}, {e: [float("inf")] * len(ps) for e in es}
        for e, p, c in edges:
            cost[e][at[p]] = min(cost[e][at[p]], c)
        return [(es[a], ps[b]) for a, b in kernels.min_cost_pairs([cost[e] for e in es], missing)]

    return _matched(pairs, by, "cost", one)


def suppress(boxes: DataFrame, by: str, threshold: float = 0.38) -> DataFrame:
    """Boxes (id, x1, y1, x2, y2, score) kept in each frame."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("id").reset_index(drop=True)
        return g.iloc[kernels.suppress(list(g[["x1", "y1", "x2", "y2"]].itertuples(index=False, name=None)), g.score.tolist(), threshold)]

    return boxes.groupBy(by).applyInPandas(one, boxes.schema)


def diverse_frames(frames: DataFrame, by: str, capacity: int = 5, gap: int = 1) -> DataFrame:
    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["seq", "score"])
        kept = kernels.diverse(list(g[["seq", "score"]].itertuples(index=False, name=None)), capacity, gap)
        return pd.DataFrame({by: g[by].iloc[0], "seq": kept})

    return frames.groupBy(by).applyInPandas(one, frames.select(by, "seq").schema)


def _frames(g: pd.DataFrame, order: str):
    """Bounds of the stretches of equal ``order`` in a sorted group."""
    cuts = np.flatnonzero(np.diff(g[order].to_numpy())) + 1
    return zip([0, *cuts.tolist()], [*cuts.tolist(), len(g)])


def track(detections: DataFrame, by: str) -> DataFrame:
    """track of every detection (by, seq, id, x1, y1, x2, y2)."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["seq", "id"], ignore_index=True)
        tracker, seq, boxes = kernels.Tracker(), g.seq.to_numpy(), [tuple(b) for b in g[["x1", "y1", "x2", "y2"]].to_numpy().tolist()]
        ids = [i for a, z in _frames(g, "seq") for i in tracker.update(int(seq[a]), boxes[a:z])]
        return g[[by, "seq", "id"]].assign(track=ids)

    s = detections.select(by, "seq", "id").schema
    return detections.groupBy(by).applyInPandas(one, s.add("track", "long"))


def associate(detections: DataFrame, by: str) -> DataFrame:
    """track of every detection (by, ts, id, x1, y1, x2, y2, score, identity) by two
    passes over surely and less surely detected boxes."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["ts", "id"], ignore_index=True)
        boxes = g[["x1", "y1", "x2", "y2"]].to_numpy().tolist()
        rows = [association.Detection(tuple(b), s, i) for b, s, i in zip(boxes, g.score, g.identity, strict=True)]
        tracker, ts = association.TwoPass(), g.ts.to_numpy()
        ids = [i for a, z in _frames(g, "ts") for i in tracker.observe(float(ts[a]), rows[a:z])]
        return g[[by, "id"]].assign(track=ids)

    return detections.groupBy(by).applyInPandas(one, detections.select(by, "id").schema.add("track", "long"))


def static_regions(readings: DataFrame, by: str) -> DataFrame:
    """shown of every reading (by, ts, id, region, motion, strong)."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["ts", "id"], ignore_index=True)
        regions, ts, rows = association.StaticRegions(), g.ts.to_numpy(), list(zip(g.region, g.motion, g.strong, strict=True))
        return g[[by, "id"]].assign(shown=[x for a, z in _frames(g, "ts") for x in regions.observe(float(ts[a]), rows[a:z])])

    return readings.groupBy(by).applyInPandas(one, readings.select(by, "id").schema.add("shown", "boolean"))


def merge_assisted(rows: DataFrame, by: str) -> DataFrame:
    """The rows that are shown of each frame (by, engine ``primary`` or ``shadow``, id,
    x1, y1, x2, y2, strict). Frames are many and hold a few boxes, so they go to Python
    as rows of a batch, not a group at a time."""
    box = F.struct("id", "x1", "y1", "x2", "y2", "strict")
    of = lambda e: F.array_sort(F.collect_list(F.when(F.col("engine") == e, box)))
    frames = rows.groupBy(by).agg(of("primary").alias("p"), of("shadow").alias("s"))
    schema = rows.select(by, "engine", "id").schema

    def each(batches):
        for b in batches:
            out = []
            for key, p, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                at = lambda r: (r["x1"], r["y1"], r["x2"], r["y2"])
                shown = association.assisted([(at(r), r["strict"]) for r in p], [at(r) for r in s])
                out += [(key, e, (p if e == "primary" else s)[k]["id"]) for e, k in shown]
            columns = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (b.schema.field(0).type, pa.string(), pa.int64()), strict=True)], names=schema.fieldNames())

    return frames.mapInArrow(each, schema)


def served(requests: DataFrame, by: str, capacity: int = 64, max_age: float = 1.0, every: int = 3) -> DataFrame:
    """What a latest-only queue serves of requests (by, id, t, key, priority): each is
    put in, and after every ``every`` of them one is taken. ``said`` is what became of the
    request, ``taken`` the id of the one that is served then."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g, queue, rows = g.sort_values("id"), kernels.LatestQueue(capacity, max_age), []
        for n, r in enumerate(g.itertuples(index=False), 1):
            said = queue.put(r.key, r.id, r.priority, r.t)
            found = queue.take(r.t) if n % every == 0 else None
            rows.append((getattr(r, by), r.id, said, None if found is None else found[1]))
        return pd.DataFrame(rows, columns=[by, "id", "said", "taken"]).astype({"taken": "Int64"})

    return requests.groupBy(by).applyInPandas(one, requests.select(by, "id").schema.add("said", "string").add("taken", "long"))


@F.pandas_udf(ArrayType(StructType().add("plate", "string").add("penalty", "double")))
def alignments(keys: pd.Series) -> pd.Series:
    """Plates that a noisy key may stand for, best first."""
    letters = plates.LETTERS + plates.LATIN_LETTERS
    return keys.map(lambda t: [{"plate": p, "penalty": c} for p, c in association.template_alignments(t or "", letters)])


def visits(observations: DataFrame, by: str, **settings) -> DataFrame:
    """visit of every plate of (by, ts, plates); observations without plates count
    as absences."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        ledger, rows = kernels.Visits(**settings), []
        for r in g.sort_values("ts").itertuples(index=False):
            rows += [(getattr(r, by), r.ts, p, n) for p, n in zip(r.plates, ledger.observe(r.ts, list(r.plates)), strict=True)]
        return pd.DataFrame(rows, columns=[by, "ts", "plate", "visit"])

    return observations.groupBy(by).applyInPandas(one, observations.select(by, "ts").schema.add("plate", "string").add("visit", "long"))


def tracked_visits(readings: DataFrame, by: str, **settings) -> DataFrame:
    """visit of every reading (by, ts, id, track, plate, strict, x1, y1, x2, y2) whose
    plate may be corrected while the visit lasts; a reading without a track is a frame
    in which nothing was seen."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["ts", "id"], ignore_index=True)
        ledger, ts, out = kernels.TrackedVisits(**settings), g.ts.to_numpy(), []
        boxes = g[["x1", "y1", "x2", "y2"]].to_numpy().tolist()
        rows = [None if pd.isna(t) else kernels.Sighting(int(t), p or "", bool(s), tuple(b)) for t, p, s, b in zip(g.track, g.plate, g.strict, boxes, strict=True)]
        for a, z in _frames(g, "ts"):
            found = iter(ledger.watch(float(ts[a]), [r for r in rows[a:z] if r]))
            out += [next(found) if r else None for r in rows[a:z]]
        return g[[by, "id"]].assign(visit=pd.array(out, dtype="Int64"))

    return readings.groupBy(by).applyInPandas(one, readings.select(by, "id").schema.add("visit", "long"))


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching blocks' share of two texts."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def ctc(rows: DataFrame, alphabet: str, slots: list[str], width: int = 16) -> DataFrame:
    """id, the greedy text of ``steps`` (arrays of probabilities, blank first), the best
    text of a beam search over the layout ``slots`` and its probability, and the best
    alignment of the greedy text with the layout."""
    kinds = "greedy string, best string, p double, placed string"

    @F.pandas_udf(f"struct<{', '.join(k.replace(' ', ': ') for k in kinds.split(', '))}>")
    def read(steps: pd.Series) -> pd.DataFrame:
        out = []
        for s in steps:
            s = [list(x) for x in s]
            greedy, found = kernels.ctc_greedy(s, alphabet), kernels.ctc_beam(s, alphabet, slots, width)
            out.append((greedy, *(found[0] if found else (None, 0.0)), "".join(c or "_" for c in kernels.align_slots(greedy, tuple(slots))[1])))
        return pd.DataFrame(out, columns=["greedy", "best", "p", "placed"])

    return rows.select("id", read("steps").alias("r")).select("id", "r.*")


def _steps(spark: SparkSession, d: str) -> DataFrame:
    """id and six steps of four probabilities each."""
    n = lambda k, c: (F.col("event_id") * (k + 3) * (c + 5) % 17 + 1).cast("double")
    total = lambda k: sum((n(k, c) for c in range(4)), F.lit(0.0))
    steps = F.array(*[F.array(*[n(k, c) / total(k) for c in range(4)]) for k in range(6)])
    return v.table(spark, d, "events").select(F.col("event_id").alias("id"), steps.alias("steps"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    found = eligible(expected_events(spark, d), predicted_events(spark, d), ["sample"])
    middle = (F.col("e.start_ms") + F.col("e.end_ms")) / 2
    return found.select("sample", "e.e", "p.p", F.coalesce(F.abs(F.col("p.ts_ms") - middle), F.lit(0.0)).alias("distance"))


def _detections(spark: SparkSession, d: str) -> DataFrame:
    s = v.sightings(spark, d)
    x = (F.col("id") % 300 * 3 + F.col("camera_id") % 7).cast("double")
    return s.select("camera_id", F.floor(F.col("id") / 40).alias("seq"), "id", x.alias("x1"), F.col("k").cast("double").alias("y1"), (x + 60).alias("x2"), (F.col("k") + 20.0).alias("y2"), F.col("confidence").alias("score"))


@query("event_matching")
def _(spark: SparkSession, d: str) -> DataFrame:
    return match_events(_pairs(spark, d), "sample")


@query("least_cost_assignment")
def _(spark: SparkSession, d: str) -> DataFrame:
    return assign(_pairs(spark, d).withColumn("cost", F.col("distance") / 20), "sample", 1.0)


@query("non_maximum_suppression")
def _(spark: SparkSession, d: str) -> DataFrame:
    return suppress(_detections(spark, d), "seq")


@query("diverse_frames")
def _(spark: SparkSession, d: str) -> DataFrame:
    return diverse_frames(_detections(spark, d).select("camera_id", F.col("id").alias("seq"), "score"), "camera_id", 5, 100)


@query("tracks")
def _(spark: SparkSession, d: str) -> DataFrame:
    return track(_detections(spark, d), "camera_id")


@query("visits")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = v.sightings(spark, d).withColumn("plate", (F.col("k") % 5).cast("string"))
    plates_ = F.when(F.col("id") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array("plate"))
    return visits(s.select("camera_id", F.col("t").alias("ts"), plates_.alias("plates")), "camera_id", absence_seconds=3600.0, cooldown=14400.0)


@query("plate_similarity")
def _(spark: SparkSession, d: str) -> DataFrame:
    f = v.feedback(spark, d)
    return f.select("id", similarity("observed_norm", "corrected_norm").alias("ratio"))


@query("two_pass_tracks")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Frames of a camera hold several boxes; their times are shared."""
    s = v.sightings(spark, d)
    lane = F.col("id") % 3 * 200
    x = (F.floor(F.col("id") / 30) % 40 * 12 + lane).cast("double")
    ts = F.floor(F.col("id") / 30) * 0.2
    return associate(s.select("camera_id", ts.alias("ts"), "id", x.alias("x1"), (F.col("k") / 10).alias("y1"), (x + 60).alias("x2"), (F.col("k") / 10 + 20).alias("y2"), F.col("confidence").alias("score"), F.when(F.col("id") % 2 == 0, F.col("plate")).otherwise("").alias("identity")), "camera_id")


@query("static_regions")
def _(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id")
    s = v.sightings(spark, d)
    return static_regions(s.select("camera_id", F.floor(k / 20).cast("double").alias("ts"), "id", F.concat(F.lit("r"), F.col("k") % 3).alias("region"), (k % 40 / 1000).alias("motion"), (k % 17 == 0).alias("strong")), "camera_id")


@query("merge_assisted")
def _(spark: SparkSession, d: str) -> DataFrame:
    li = v.table(spark, d, "lineitem")
    x, y = (F.col("l_partkey") % 50).cast("double"), (F.col("l_suppkey") % 10).cast("double")
    return merge_assisted(li.select(F.col("l_orderkey").alias("frame"), F.when(F.col("l_linenumber") % 2 == 0, "primary").otherwise("shadow").alias("engine"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("id"), x.alias("x1"), y.alias("y1"), (x + 20).alias("x2"), (y + 10).alias("y2"), (F.col("l_partkey") % 3 == 0).alias("strict")), "frame")


@query("template_alignments")
def _(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id")
    noisy = F.when(k % 4 == 0, F.concat(F.lit("I"), "plate")).when(k % 4 == 1, F.concat(F.substring("plate", 1, 3), F.lit("x"), F.substring("plate", 4, 3), F.lit("SO"))).when(k % 4 == 2, F.concat("plate", F.lit("12"))).otherwise(F.substring("plate", 1, 6))
    return v.sightings(spark, d).select("id", F.posexplode(alignments(noisy)).alias("rank", "a")).select("id", "rank", "a.plate", F.round("a.penalty", 6).alias("penalty"))


@query("ctc_readings")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Greedy and layout-bound readings of rows of probabilities over blank, 1, 2 and a."""
    return ctc(_steps(spark, d), "12a", ["12", "a", "12"])


@query("latest_queue")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = v.sightings(spark, d)
    return served(s.select("camera_id", "id", "t", F.concat(F.lit("k"), F.col("k") % 9).alias("key"), (F.col("id") % 5).cast("double").alias("priority")), "camera_id", 4, 200_000.0)


@query("tracked_visits")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth reading is off by one place, every seventh unreadable, every eleventh
    row a frame without a vehicle."""
    s, k = v.sightings(spark, d), F.col("id")
    true = v.plate_of((F.col("camera_id") + F.floor(k / 200)).cast("int") % 100)
    plate = F.when(k % 7 == 0, "").when(k % 5 == 0, F.concat(F.substring(true, 1, 7), F.lit("0"))).otherwise(true)
    x = (k % 40).cast("double")
    rows = s.select("camera_id", F.floor(k / 2).cast("double").alias("ts"), "id", F.when(k % 11 > 0, F.floor(k / 60)).alias("track"), plate.alias("plate"), (k % 3 == 0).alias("strict"), x.alias("x1"), F.lit(0.0).alias("y1"), (x + 60).alias("x2"), F.lit(20.0).alias("y2"))
    return tracked_visits(rows, "camera_id", absence_seconds=200.0, cooldown=100.0)
