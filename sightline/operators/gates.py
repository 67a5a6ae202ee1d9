"""Rules over rows: confidence gates, regions, crop scores, read scheduling, retry
lineage, backpressure, metric integrity and the gate of trained candidates."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numbers, plates
from ..plans import views as v
from ..plans.registry import query

#: Bounds of the retry queue between which intake keeps its state.
HIGH_COUNT, LOW_COUNT = 32, 16
HIGH_BYTES, LOW_BYTES = 64 << 20, 32 << 20
#: Scheduling of reads of a track.
READS = {"max_attempts": 8, "min_width": 24, "min_height": 8, "min_quality": 0.20, "max_audits": 1, "audit_quality": 0.15, "audit_area": 0.35, "quality_gain": 0.08, "area_gain": 0.25, "gap": 0.08, "refresh": 1.2}
#: Names of colours and of vehicle types.
COLOURS = {"white": "سفید", "black": "مشکی", "gray": "خاکستری", "silver": "نقره‌ای", "red": "قرمز", "blue": "آبی", "green": "سبز", "yellow": "زرد", "brown": "قهوه‌ای", "other": "سایر"}
MOTORCYCLE, BUS, PICKUP, HEAVY, CAR, UNKNOWN = "موتورسیکلت", "اتوبوس/کامیون", "وانت/کامیونت", "خودروی سنگین", "سواری", "نامشخص"
MAX_RESULT_BYTES = 1 << 20


def pending_payload(outbox: DataFrame, by: str) -> DataFrame:
    """Pending entries of each ``by`` and the bytes of their pictures (frame, crop)."""
    size = F.octet_length("frame") + F.coalesce(F.octet_length("crop"), F.lit(0))
    return outbox.where("status = 'pending'").groupBy(by).agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes"))


def camera_gate(results: DataFrame) -> DataFrame:
    """Results after their camera's confidence gate: a recognised plate below
    ``min_confidence`` becomes a suggestion for review, or goes if it is none. Columns
    plate, plate_norm, confidence, ocr_confidence, valid, auto_confirmed,
    min_confidence."""
    recognised = F.coalesce("valid", F.lit(False)) | F.coalesce("auto_confirmed", F.lit(False))
    below = recognised & (F.coalesce("confidence", F.lit(0.0)) < F.col("min_confidence"))
    key = plates.normalize_plate(F.coalesce(numbers.nz(F.col("plate_norm")), F.col("plate")))
    gated = results.withColumn("_below", below).withColumn("_key", key).where(~F.col("_below") | F.col("_key").rlike(plates.PLATE))
    change = lambda to, column: F.when(F.col("_below"), to).otherwise(column)
    return gated.select(
        *[c for c in results.columns if c not in ("plate_norm", "valid", "auto_confirmed", "min_confidence")],
        change(F.lit(""), F.col("plate_norm")).alias("plate_norm"),
        change(F.lit(False), F.col("valid")).alias("valid"),
        change(F.lit(False), F.col("auto_confirmed")).alias("auto_confirmed"),
        F.col("_below").alias("needs_review"),
        F.when(F.col("_below"), F.col("_key")).alias("raw_guess_norm"),
        F.when(F.col("_below"), F.coalesce("ocr_confidence", "confidence", F.lit(0.0))).alias("raw_guess_confidence"),
        F.when(F.col("_below"), "below-camera-confidence").alias("blocked"),
    )


def region(width: Column, height: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """struct(x1, y1, x2, y2) in pixels of a region given in per cent of a frame: at
    least one pixel, inside the frame."""
    x1 = F.greatest(F.lit(0), F.least(width - 1, F.floor(width * x / 100)))
    y1 = F.greatest(F.lit(0), F.least(height - 1, F.floor(height * y / 100)))
    x2, y2 = F.greatest(x1 + 1, F.least(width, F.floor(width * (x + w) / 100))), F.greatest(y1 + 1, F.least(height, F.floor(height * (y + h) / 100)))
    return F.struct(*[c.cast("long").alias(n) for c, n in ((x1, "x1"), (y1, "y1"), (x2, "x2"), (y2, "y2"))])


def moved(box: Column, by: Column) -> Column:
    """A box found in a region, in the frame's coordinates."""
    return F.struct((box["x1"] + by["x1"]).alias("x1"), (box["y1"] + by["y1"]).alias("y1"), (box["x2"] + by["x1"]).alias("x2"), (box["y2"] + by["y1"]).alias("y2"))


def masked_share(box: Column, mask: Column) -> Column:
    """The share of a box's pixels in ``mask``, an array of disjoint boxes."""
    side = lambda a, b: F.greatest(F.lit(0.0), F.least(a[f"{b}2"], box[f"{b}2"]) - F.greatest(a[f"{b}1"], box[f"{b}1"]))
    area = (box["x2"] - box["x1"]) * (box["y2"] - box["y1"])
    return F.when(area > 0, F.aggregate(F.transform(mask, lambda m: side(m, "x") * side(m, "y")), F.lit(0.0), lambda a, x: a + x) / area).otherwise(0.0)


def outside_mask(rows: DataFrame, most: float = 0.22) -> DataFrame:
    """Rows whose box lies less than ``most`` in their ``mask``, with that share."""
    return rows.withColumn("overlap", F.bround(masked_share(F.col("box"), F.col("mask")), 5)).where(F.col("overlap") < most)


def event_status(rows: DataFrame) -> DataFrame:
    """plate, status of results (plate_norm, raw_guess_norm, plate, valid,
    auto_confirmed, unreadable_final, needs_review)."""
    key = F.coalesce(*[numbers.nz(plates.normalize_plate(F.col(c))) for c in ("plate_norm", "raw_guess_norm", "plate")], F.lit(""))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    out = rows.withColumn("_key", key).withColumn("_known", F.col("_key").rlike(plates.PLATE) & (yes("valid") | yes("auto_confirmed")) & ~yes("unreadable_final"))
    status = F.when(F.col("_known") & yes("auto_confirmed"), "auto-confirmed").when(F.col("_known"), "confirmed-ai").when(yes("needs_review"), "suggested").otherwise("unreadable")
    return out.withColumn("event_plate", F.when(F.col("_known"), F.col("_key")).otherwise("")).withColumn("status", status).drop("_key", "_known")


def image_score(brightness: Column, contrast: Column, blur: Column, glare: Column, dark: Column) -> Column:
    """The archive's crop score from a grey picture's mean, deviation, variance of the
    Laplacian and shares of glaring and dark pixels."""
    light = F.greatest(F.lit(0.0), 1 - F.abs(brightness - 135.0) / 145.0)
    sharp = F.least(F.lit(1.0), F.log1p(F.greatest(F.lit(0.0), blur)) / math.log1p(850.0))
    exposed = F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), glare * 2.7 + dark * 1.8))
    return F.bround(numbers.unit(0.27 * light + 0.24 * F.least(F.lit(1.0), contrast / 58.0) + 0.34 * sharp + 0.15 * exposed), 4)


def crop_score(sharpness: Column, mean: Column, clipped: Column, deviation: Column, gx: Column, gy: Column, area_share: Column, detector: Column) -> Column:
    """The temporal engine's crop score: ``sharpness`` is the variance of the
    Laplacian, gx and gy the mean gradients."""
    sharp = numbers.unit(sharpness / (sharpness + 140.0))
    exposure = numbers.unit(F.greatest(F.lit(0.0), 1 - F.abs(mean - 132.0) / 132.0) * (1 - F.least(F.lit(0.85), clipped)))
    contrast = numbers.unit(deviation / (deviation + 38.0))
    steady = numbers.unit(0.70 * sharp + 0.30 * (1 - F.abs(gx - gy) / F.greatest(F.lit(1e-6), gx + gy)))
    return numbers.unit(0.30 * sharp + 0.15 * exposure + 0.12 * contrast + 0.12 * numbers.unit(area_share / 0.03) + 0.18 * numbers.unit(detector) + 0.13 * steady)


def colour_key(h: Column, s: Column, v_: Column) -> Column:
    """The colour of median hue, saturation and value."""
    return (
        F.when(v_ < 58, "black")
        .when((s < 28) & (v_ > 188), "white")
        .when((s < 34) & (v_ > 125), "silver")
        .when(s < 42, "gray")
        .when((h < 10) | (h >= 170), "red")
        .when(h < 24, F.when(v_ < 145, "brown").otherwise("yellow"))
        .when(h < 38, "yellow")
        .when(h < 86, "green")
        .when(h < 140, "blue")
        .otherwise("other")
    )


def colour(h: Column, s: Column, v_: Column) -> Column:
    """struct(label, confidence)."""
    key = colour_key(h, s, v_)
    sure = F.least(F.lit(0.92), F.greatest(F.lit(0.35), s / 255 * 0.45 + F.abs(v_ - 128) / 255 * 0.15 + 0.42))
    label = F.element_at(F.create_map(*[F.lit(x) for pair in COLOURS.items() for x in pair]), key)
    return F.struct(label.alias("label"), F.bround(F.when(key.isin("white", "black", "gray", "silver"), 0.72).otherwise(sure), 3).alias("confidence"))


def vehicle_type(width: Column, height: Column, area_share: Column, plate_aspect: Column) -> Column:
    """struct(label, confidence) from a vehicle's box, its share of the frame and its
    plate's aspect."""
    aspect = width / F.greatest(height, F.lit(1))
    kind = lambda label, p: F.struct(F.lit(label).alias("label"), F.lit(p).alias("confidence"))
    return (
        F.when((aspect < 0.85) & (area_share < 0.12), kind(MOTORCYCLE, 0.48))
        .when((height > width * 0.95) & (area_share > 0.20), kind(BUS, 0.50))
        .when((aspect > 2.25) & (area_share > 0.17), kind(PICKUP, 0.47))
        .when((plate_aspect > 4.8) & (area_share > 0.22), kind(HEAVY, 0.44))
        .otherwise(kind(CAR, 0.58))
    )


def backpressure(rows: DataFrame, by: str, order: str) -> DataFrame:
    """``paused`` after each row (count, bytes, unspooled): on at the upper bounds or
    while a write is not yet durable, off below the lower ones, else as before."""
    on = F.col("unspooled") | (F.col("count") >= HIGH_COUNT) | (F.col("bytes") >= HIGH_BYTES)
    off = (F.col("count") <= LOW_COUNT) & (F.col("bytes") <= LOW_BYTES)
    said = F.when(on, True).when(off, False)
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("paused", F.coalesce(F.last(said, ignorenulls=True).over(w), F.lit(False)))


def read_decision(rows: DataFrame) -> DataFrame:
    """``read`` and ``reason`` for a crop of a track in a state: the first rule that
    holds. Columns closed, phase, in_flight, attempts, width, height, quality, area,
    audits, near_exit, last_quality, last_area, since (seconds since the last read),
    conflict, unresolved."""
    c = F.col
    held = c("phase") == "soft_locked"
    due = F.coalesce(c("since") >= READS["gap"], F.lit(False))
    larger = lambda gain: (c("last_area") > 0) & (c("area") >= F.ceil(c("last_area") * (1 + gain)))
    rules = [
        (c("closed"), False, "track_closed"),
        (c("phase") == "finalized", False, "recognition_finalized"),
        (c("in_flight"), False, "ocr_in_flight"),
        (c("attempts") >= READS["max_attempts"], False, "attempt_budget_exhausted"),
        (F.coalesce(c("width") < READS["min_width"], F.lit(False)), False, "plate_width_below_floor"),
        (F.coalesce(c("height") < READS["min_height"], F.lit(False)), False, "plate_height_below_floor"),
        (c("quality") < READS["min_quality"], False, "quality_below_floor"),
        (held & (c("audits") >= READS["max_audits"]), False, "soft_lock_audit_complete"),
        (held & c("near_exit"), True, "soft_lock_exit_audit"),
        (held & (c("quality") >= c("last_quality") + READS["audit_quality"]), True, "soft_lock_quality_audit"),
        (held & larger(READS["audit_area"]), True, "soft_lock_area_audit"),
        (held, False, "soft_lock_hold"),
        (c("attempts") == 0, True, "first_usable_crop"),
        (c("near_exit"), True, "pre_exit_final_read"),
        (c("quality") >= c("last_quality") + READS["quality_gain"], True, "quality_improved"),
        (larger(READS["area_gain"]), True, "plate_area_grew"),
        ((c("phase") == "provisional") & due, True, "provisional_confirmation_due"),
        (c("conflict") & due, True, "conflicting_evidence"),
        ((c("unresolved") > 0) & due, True, "unresolved_slots"),
        (F.coalesce(c("since") >= READS["refresh"], F.lit(False)), True, "periodic_refresh"),
    ]
    said = F.coalesce(*[F.when(rule, F.struct(F.lit(read).alias("read"), F.lit(reason).alias("reason"))) for rule, read, reason in rules], F.struct(F.lit(False).alias("read"), F.lit("no_material_gain").alias("reason")))
    return rows.withColumn("_said", said).withColumn("read", F.col("_said.read")).withColumn("reason", F.col("_said.reason")).drop("_said")


def retry_lineage(writes: DataFrame, gap: float = 1.5) -> DataFrame:
    """``root`` of every queued write: the first one of the chain it belongs to. A
    write follows the one before it of the same detector and track if it comes within
    ``gap`` and their plates can be of one visit. Columns id, t, camera_id,
    generation, revision, track, key, strict, stable, provisional."""
    w = Window.partitionBy("camera_id", "generation", "revision", "track").orderBy("t", "id")
    old, key = F.lag("key").over(w), F.col("key")
    one = (F.coalesce(old, F.lit("")) == "") | (key == "") | (old == key) | ~F.col("stable")
    grown = ~F.lag("strict").over(w) & (plates.can_migrate(old, key) | (F.col("strict") & F.lag("provisional").over(w)))
    follows = (F.col("t") - F.lag("t").over(w)).between(0.0, gap) & (one | grown)
    first = writes.withColumn("_first", F.when(F.coalesce(follows, F.lit(False)), F.lit(None)).otherwise(F.col("id")))
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return first.withColumn("root", F.last("_first", ignorenulls=True).over(so_far)).drop("_first")


def dataset_fingerprint(samples: DataFrame, by: str) -> DataFrame:
    """The upper-case SHA-256 of the canonical JSON of each ``by``'s samples
    (feedback_id, sha256, plate, group_id, split) in order of feedback_id: sorted keys,
    no spaces, characters beyond ASCII as they are. Null text is empty."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    row = F.struct(F.coalesce("feedback_id", F.lit(0)).cast("long").alias("feedback_id"), text("group_id").alias("group_id"), text("plate").alias("plate"), F.upper(text("sha256")).alias("sha256"), F.lower(text("split")).alias("split"))
    return samples.groupBy(by).agg(F.upper(F.sha2(F.to_json(F.array_sort(F.collect_list(row))), 256)).alias("fingerprint"))


def _cleaned(text: str | None, allowed: tuple[str, ...]) -> tuple[str | None, str | None]:
    def refuse(name: str):
        raise ValueError(f"non-finite number {name}")

    try:
        value = json.loads(text or "", parse_constant=refuse, parse_float=lambda x: float(x) if math.isfinite(float(x)) else refuse(x))
    except ValueError as e:
        return None, "non-finite" if "non-finite" in str(e) else "not-json"
    if not isinstance(value, dict):
        return None, "not-an-object"
    out = json.dumps({k: value[k] for k in value if k in allowed}, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    return (out, None) if len(out.encode()) <= MAX_RESULT_BYTES else (None, "too-large")


def sanitize_json(c: Column, allowed: list[str]) -> Column:
    """struct(json, error) of JSON text: an object's allowed fields in canonical form
    (sorted keys at every depth), or why there is none. Nested values of any shape have
    no built-in canonical form, so this is a vectorised function."""
    names = tuple(allowed)

    @F.pandas_udf("struct<json:string,error:string>")
    def clean(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_cleaned(t, names) for t in s], columns=["json", "error"])

    return clean(c)


def _listed(*rules: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(True)), F.lit(name)) for rule, name in rules]))


def metric_integrity(metrics: DataFrame, slices: list[str]) -> DataFrame:
    """``reasons`` why a row of passage metrics cannot be right: counts that do not add
    up. Scalars passages, readable, negative, exact, missed, wrong, false_accept,
    duplicate, unique_plates, cameras, sessions; maps of counts plate_counts,
    {readable,negative}_{camera,session}_counts and {,readable_,negative_,exact_,
    false_accept_,duplicate_}slice_counts. A null is a broken rule."""
    c = F.col
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0).cast("long"), lambda a, x: a + x)
    keys = lambda a, b: F.size(F.array_union(F.map_keys(a), F.map_keys(b)))
    at = lambda m, s: F.coalesce(F.try_element_at(c(m), F.lit(s)), F.lit(0))
    maps = ["slice_counts", "readable_slice_counts", "negative_slice_counts", "exact_slice_counts", "false_accept_slice_counts", "duplicate_slice_counts"]
    wanted = F.array_sort(F.array(*map(F.lit, slices)))
    rules = [
        (c("passages") != c("readable") + c("negative"), "inconsistent-passage-counts"),
        (c("exact") + c("missed") + c("wrong") != c("readable"), "inconsistent-readable-outcomes"),
        (c("false_accept") > c("negative"), "inconsistent-false-accept-count"),
        (c("duplicate") > c("passages"), "inconsistent-duplicate-count"),
        ((c("unique_plates") != F.size("plate_counts")) | (total(c("plate_counts")) != c("readable")), "inconsistent-plate-counts"),
    ]
    for one, many in (("camera", "cameras"), ("session", "sessions")):
        a, b = c(f"readable_{one}_counts"), c(f"negative_{one}_counts")
        rules.append(((total(a) != c("readable")) | (total(b) != c("negative")) | (c(many) != keys(a, b)), f"inconsistent-{one}-counts"))
    other = F.lit(False)
    for m in maps:
        other = other | (F.array_sort(F.map_keys(c(m))) != wanted)
    each = []
    for s in slices:
        n, r, g = at("slice_counts", s), at("readable_slice_counts", s), at("negative_slice_counts", s)
        each.append(((n != r + g) | (n > c("passages")), f"inconsistent-slice-count:{s}"))
        each.append((at("exact_slice_counts", s) > F.least(r, c("exact")), f"inconsistent-exact-slice:{s}"))
        each.append((at("false_accept_slice_counts", s) > F.least(g, c("false_accept")), f"inconsistent-false-accept-slice:{s}"))
        each.append((at("duplicate_slice_counts", s) > F.least(n, c("duplicate")), f"inconsistent-duplicate-slice:{s}"))
    reasons = F.concat(_listed(*rules), F.when(other, F.array(F.lit("inconsistent-slice-keys"))).otherwise(_listed(*each)))
    return metrics.withColumn("reasons", reasons)


def candidate_gate(candidates: DataFrame) -> DataFrame:
    """``reasons`` against a trained candidate, sorted, and ``promote`` where there is
    none. Columns validation_samples, baseline_accuracy, candidate_accuracy,
    baseline_error, candidate_error, regressions, baseline_sha256, initialization,
    rights_verified, golden_ready, golden_reasons (array, of the decision on the golden
    set). What is missing counts against the candidate."""
    c = F.col
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    accuracy, error = [c("baseline_accuracy"), c("candidate_accuracy")], [c("baseline_error"), c("candidate_error")]
    bad = F.lit(False)
    for x in accuracy:
        bad = bad | ~finite(x) | ~x.between(0.0, 1.0)
    for x in error:
        bad = bad | ~finite(x) | (x < 0)
    reasons = _listed(
        (bad, "validation-metrics-invalid"),
        (c("validation_samples") < 12, "validation-too-small"),
        (c("candidate_accuracy") < F.greatest(F.lit(0.70), c("baseline_accuracy")), "validation-exact-regression"),
        (c("candidate_error") > c("baseline_error") + 1e-9, "validation-character-regression"),
        (c("regressions") > 0, "validation-sample-regression"),
        (F.trim("baseline_sha256") == "", "baseline-identity-missing"),
        (~c("initialization").isin("active-checkpoint", "active-model-distillation"), "untrusted-initialization"),
        (~c("rights_verified"), "training-rights-unverified"),
        (~c("golden_ready"), "golden-not-ready"),
    )
    golden = F.transform(F.coalesce("golden_reasons", F.array().cast("array<string>")), lambda x: F.concat(F.lit("golden:"), x))
    out = candidates.withColumn("reasons", F.array_sort(F.array_distinct(F.concat(reasons, golden))))
    return out.withColumn("promote", F.size("reasons") == 0)


def _s(spark: SparkSession, d: str) -> DataFrame:
    return v.sightings(spark, d)


@query("pending_payload", "SELECT user_id AS camera_id, count(*) AS n, sum(strlen(props) + coalesce(CASE WHEN event_id % 2 = 0 THEN strlen(event_type) END, 0))::BIGINT AS bytes FROM events WHERE event_id % 3 = 0 GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    e, k = v.table(spark, d, "events"), F.col("event_id")
    return pending_payload(e.select(F.col("user_id").alias("camera_id"), F.when(k % 3 == 0, "pending").otherwise("failed").alias("status"), F.col("props").alias("frame"), F.when(k % 2 == 0, F.col("event_type")).alias("crop")), "camera_id")


_GATED = "x AS (SELECT id, CASE WHEN id % 13 = 0 THEN 'x' ELSE plate END AS plate, CASE WHEN id % 13 = 0 THEN '' ELSE plate_norm END AS plate_norm, confidence, id % 4 = 0 AS valid, id % 5 = 0 AS auto, (camera_id % 5) / 5 AS least FROM sightings), b AS (SELECT *, (valid OR auto) AND confidence < least AS below FROM x)"


@query("camera_gate", v.sql(f"""{_GATED}; SELECT id, plate, confidence, confidence / 2 AS ocr_confidence, CASE WHEN below THEN '' ELSE plate_norm END AS plate_norm, valid AND NOT below AS valid, auto AND NOT below AS auto_confirmed, below AS needs_review,
    CASE WHEN below THEN plate END AS raw_guess_norm, CASE WHEN below THEN confidence / 2 END AS raw_guess_confidence, CASE WHEN below THEN 'below-camera-confidence' END AS blocked FROM b WHERE NOT below OR plate <> 'x'""", "sightings"))
def _(spark: SparkSession, d: str) -> DataFrame:
    odd = F.col("id") % 13 == 0
    s = _s(spark, d).select("id", F.when(odd, "x").otherwise(F.col("plate")).alias("plate"), F.when(odd, "").otherwise(F.col("plate_norm")).alias("plate_norm"), "confidence", (F.col("confidence") / 2).alias("ocr_confidence"), (F.col("id") % 4 == 0).alias("valid"), (F.col("id") % 5 == 0).alias("auto_confirmed"), (F.col("camera_id") % 5 / 5).alias("min_confidence"))
    return camera_gate(s)


@query("region_boxes", """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_partkey % 120 AS x, l_suppkey % 90 AS y, 5 + l_partkey % 60 AS w, 5 + l_suppkey % 70 AS h FROM lineitem),
    p AS (SELECT *, greatest(0, least(639, floor(640 * x / 100)))::BIGINT AS x1, greatest(0, least(359, floor(360 * y / 100)))::BIGINT AS y1 FROM r)
    SELECT l_orderkey, l_linenumber, l_partkey, x1, y1, greatest(x1 + 1, least(640, floor(640 * (x + w) / 100)))::BIGINT AS x2, greatest(y1 + 1, least(360, floor(360 * (y + h) / 100)))::BIGINT AS y2, x1 + 3 AS box_x1, y1 + 13 AS box_y2 FROM p""")
def _(spark: SparkSession, d: str) -> DataFrame:
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    li = v.table(spark, d, "lineitem").withColumn("r", region(F.lit(640), F.lit(360), p % 120, s % 90, 5 + p % 60, 5 + s % 70))
    box = F.struct(*[F.lit(x).cast("long").alias(n) for x, n in ((3, "x1"), (4, "y1"), (33, "x2"), (13, "y2"))])
    out = li.withColumn("b", moved(box, F.col("r")))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "r.x1", "r.y1", "r.x2", "r.y2", F.col("b.x1").alias("box_x1"), F.col("b.y2").alias("box_y2"))


@query("outside_mask", """WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, (l_partkey % 60)::DOUBLE AS x, (l_suppkey % 10)::DOUBLE AS y FROM lineitem),
    o AS (SELECT *, (greatest(0, least(40, x + 20) - greatest(10, x)) * greatest(0, least(8, y + 10) - greatest(0, y)) + greatest(0, least(70, x + 20) - greatest(60, x)) * greatest(0, least(30, y + 10) - greatest(0, y))) / 200 AS share FROM b)
    SELECT l_orderkey, l_linenumber, l_partkey, round_even(share, 5) AS overlap FROM o WHERE round_even(share, 5) < 0.22""")
def _(spark: SparkSession, d: str) -> DataFrame:
    x, y = (F.col("l_partkey") % 60).cast("double"), (F.col("l_suppkey") % 10).cast("double")
    box = lambda a, b, c, e: F.struct(*[(z if isinstance(z, Column) else F.lit(z)).alias(n) for z, n in ((a, "x1"), (b, "y1"), (c, "x2"), (e, "y2"))])
    rows = v.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", box(x, y, x + 20, y + 10).alias("box"), F.array(box(10.0, 0.0, 40.0, 8.0), box(60.0, 0.0, 70.0, 30.0)).alias("mask"))
    return outside_mask(rows).drop("box", "mask")


@query("event_status", v.sql("""x AS (SELECT id, CASE WHEN plate_norm <> '' THEN plate_norm ELSE raw_guess_norm END AS key, id % 3 = 0 AS valid, id % 4 = 0 AS auto, id % 10 = 0 AS final, id % 2 = 0 AS review FROM sightings), k AS (SELECT *, (valid OR auto) AND NOT final AS known FROM x);
    SELECT id, CASE WHEN known THEN key ELSE '' END AS event_plate, CASE WHEN known AND auto THEN 'auto-confirmed' WHEN known THEN 'confirmed-ai' WHEN review THEN 'suggested' ELSE 'unreadable' END AS status FROM k""", "sightings"))
def _(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id")
    s = _s(spark, d).select("id", "plate_norm", "raw_guess_norm", "plate", (k % 3 == 0).alias("valid"), (k % 4 == 0).alias("auto_confirmed"), (k % 10 == 0).alias("unreadable_final"), (k % 2 == 0).alias("needs_review"))
    return event_status(s).select("id", "event_plate", "status")


_F = "f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity * 5 AS a, l_discount * 600 AS b, l_extendedprice / 50 AS c, l_tax AS g, l_discount / 2 AS k FROM lineitem)"


@query("crop_scores", f"""WITH {_F}, p AS (SELECT *, greatest(0, 1 - abs(a - 135) / 145) AS light, least(1, ln(1 + c) / ln(851)) AS sharp1, greatest(0, 1 - least(1, g * 2.7 + k * 1.8)) AS exposed, c / (c + 140) AS sharp2, greatest(0, 1 - abs(a - 132) / 132) * (1 - least(0.85, k)) AS exposure, b / (b + 38) AS contrast FROM f)
    SELECT l_orderkey, l_linenumber, l_partkey, round_even(greatest(0, least(1, 0.27 * light + 0.24 * least(1, b / 58) + 0.34 * sharp1 + 0.15 * exposed)), 4) AS v1,
    round(0.30 * sharp2 + 0.15 * exposure + 0.12 * contrast + 0.12 * least(1, g / 0.03) + 0.18 * k + 0.13 * (0.7 * sharp2 + 0.3 * (1 - abs(a - b) / greatest(1e-6, a + b))), 6) AS v2, round(0.6 * k + 0.25 * g + 0.15 * least(1, g / 0.018), 5) AS capture, least(7, greatest(2, l_linenumber)) AS bounded FROM p""")
def _(spark: SparkSession, d: str) -> DataFrame:
    a, b, c, g, k = F.col("l_quantity") * 5, F.col("l_discount") * 600, F.col("l_extendedprice") / 50, F.col("l_tax"), F.col("l_discount") / 2
    li = v.table(spark, d, "lineitem")
    v1, v2 = image_score(a, b, c, g, k), crop_score(c, a, k, b, a, b, g, k)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", v1.alias("v1"), F.round(v2, 6).alias("v2"), F.round(numbers.capture_score(k, g, g), 5).alias("capture"), numbers.bounded(F.col("l_linenumber"), 2, 7).alias("bounded"))


_COLOUR_SQL = " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in COLOURS.items())


@query("vehicle_looks", f"""WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, (l_partkey % 180)::DOUBLE AS h, (l_suppkey * 7 % 256)::DOUBLE AS s, (l_partkey * 3 % 256)::DOUBLE AS v, (20 + l_partkey % 90)::DOUBLE AS w, (20 + l_suppkey % 80)::DOUBLE AS t, l_discount * 3 AS share, 2 + l_tax * 50 AS pa FROM lineitem),
    k AS (SELECT *, CASE WHEN v < 58 THEN 'black' WHEN s < 28 AND v > 188 THEN 'white' WHEN s < 34 AND v > 125 THEN 'silver' WHEN s < 42 THEN 'gray' WHEN h < 10 OR h >= 170 THEN 'red' WHEN h < 24 THEN CASE WHEN v < 145 THEN 'brown' ELSE 'yellow' END WHEN h < 38 THEN 'yellow' WHEN h < 86 THEN 'green' WHEN h < 140 THEN 'blue' ELSE 'other' END AS key FROM f)
    SELECT l_orderkey, l_linenumber, l_partkey, CASE key {_COLOUR_SQL} END AS colour, round_even(CASE WHEN key IN ('white', 'black', 'gray', 'silver') THEN 0.72 ELSE least(0.92, greatest(0.35, s / 255 * 0.45 + abs(v - 128) / 255 * 0.15 + 0.42)) END, 3) AS sure,
    CASE WHEN w / t < 0.85 AND share < 0.12 THEN '{MOTORCYCLE}' WHEN t > w * 0.95 AND share > 0.2 THEN '{BUS}' WHEN w / t > 2.25 AND share > 0.17 THEN '{PICKUP}' WHEN pa > 4.8 AND share > 0.22 THEN '{HEAVY}' ELSE '{CAR}' END AS type FROM k""")
def _(spark: SparkSession, d: str) -> DataFrame:
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    look = colour((p % 180).cast("double"), (s * 7 % 256).cast("double"), (p * 3 % 256).cast("double"))
    kind = vehicle_type((20 + p % 90).cast("double"), (20 + s % 80).cast("double"), F.col("l_discount") * 3, 2 + F.col("l_tax") * 50)
    li = v.table(spark, d, "lineitem").withColumn("c", look).withColumn("t", kind)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", F.col("c.label").alias("colour"), F.col("c.confidence").alias("sure"), F.col("t.label").alias("type"))


@query("backpressure", f"""WITH x AS (SELECT event_id AS id, user_id AS camera_id, event_id * 7 % 50 AS n, (event_id * 13 % 80) * 1048576 AS b, event_id % 41 = 0 AS u FROM events),
    e AS (SELECT *, CASE WHEN u OR n >= {HIGH_COUNT} OR b >= {HIGH_BYTES} THEN true WHEN n <= {LOW_COUNT} AND b <= {LOW_BYTES} THEN false END AS said FROM x)
    SELECT id, coalesce(last_value(said IGNORE NULLS) OVER (PARTITION BY camera_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS paused FROM e""")
def _(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    rows = v.table(spark, d, "events").select(k.alias("id"), F.col("user_id").alias("camera_id"), (k * 7 % 50).alias("count"), (k * 13 % 80 * 1048576).alias("bytes"), (k % 41 == 0).alias("unspooled"))
    return backpressure(rows, "camera_id", "id").select("id", "paused")


_READ_SQL = """WITH s AS (SELECT event_id AS id, event_id % 37 = 0 AS closed, ['provisional', 'soft_locked', 'reading', 'finalized', 'reading'][event_id % 5 + 1] AS phase, event_id % 17 = 0 AS fly, event_id % 10 - 1 AS n0, event_id % 60 AS w, event_id * 3 % 40 AS h, (event_id * 7 % 100) / 100 AS q,
    event_id * 11 % 900 AS area, event_id % 3 % 2 AS audits, event_id % 6 = 0 AS ex, (event_id * 3 % 100) / 100 AS lq, event_id * 5 % 800 AS la, CASE WHEN event_id % 8 > 0 THEN (event_id % 30) / 20 END AS since, event_id % 4 = 1 AS con, event_id % 3 AS unres FROM events), x AS (SELECT *, greatest(0, n0) AS n FROM s),
    r AS (SELECT id, CASE WHEN closed THEN 'track_closed' WHEN phase = 'finalized' THEN 'recognition_finalized' WHEN fly THEN 'ocr_in_flight' WHEN n >= 8 THEN 'attempt_budget_exhausted' WHEN w < 24 THEN 'plate_width_below_floor' WHEN h < 8 THEN 'plate_height_below_floor' WHEN q < 0.2 THEN 'quality_below_floor'
    WHEN phase = 'soft_locked' THEN CASE WHEN audits >= 1 THEN 'soft_lock_audit_complete' WHEN ex THEN 'soft_lock_exit_audit' WHEN q >= lq + 0.15 THEN 'soft_lock_quality_audit' WHEN la > 0 AND area >= ceil(la * 1.35) THEN 'soft_lock_area_audit' ELSE 'soft_lock_hold' END
    WHEN n = 0 THEN 'first_usable_crop' WHEN ex THEN 'pre_exit_final_read' WHEN q >= lq + 0.08 THEN 'quality_improved' WHEN la > 0 AND area >= ceil(la * 1.25) THEN 'plate_area_grew' WHEN phase = 'provisional' AND since >= 0.08 THEN 'provisional_confirmation_due' WHEN con AND since >= 0.08 THEN 'conflicting_evidence' WHEN unres > 0 AND since >= 0.08 THEN 'unresolved_slots' WHEN since >= 1.2 THEN 'periodic_refresh' ELSE 'no_material_gain' END AS reason FROM x)
    SELECT id, reason, reason IN ('soft_lock_exit_audit', 'soft_lock_quality_audit', 'soft_lock_area_audit', 'first_usable_crop', 'pre_exit_final_read', 'quality_improved', 'plate_area_grew', 'provisional_confirmation_due', 'conflicting_evidence', 'unresolved_slots', 'periodic_refresh') AS read FROM r"""


@query("read_decision", _READ_SQL)
def _(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    phase = F.element_at(F.array(*map(F.lit, ("provisional", "soft_locked", "reading", "finalized", "reading"))), (k % 5 + 1).cast("int"))
    rows = v.table(spark, d, "events").select(
        k.alias("id"), (k % 37 == 0).alias("closed"), phase.alias("phase"), (k % 17 == 0).alias("in_flight"), F.greatest(F.lit(0), k % 10 - 1).alias("attempts"), (k % 60).alias("width"), (k * 3 % 40).alias("height"), (k * 7 % 100 / 100).alias("quality"), (k * 11 % 900).alias("area"),
        (k % 3 % 2).alias("audits"), (k % 6 == 0).alias("near_exit"), (k * 3 % 100 / 100).alias("last_quality"), (k * 5 % 800).alias("last_area"), F.when(k % 8 > 0, k % 30 / 20).alias("since"), (k % 4 == 1).alias("conflict"), (k % 3).alias("unresolved"),
    )
    return read_decision(rows).select("id", "reason", "read")


_LINEAGE = f"""x AS (SELECT id, t / 3600 AS t, camera_id, id % 2 AS generation, 'r' || (id % 3) AS revision, k % 4 AS track, translate(CASE WHEN id % 6 = 0 THEN '' WHEN id % 6 = 1 THEN substr(plate, 1, 7) || '0' ELSE plate END, '{plates.LETTERS}', 'abcdefghijklmnopqrstuvwx') AS key, id % 4 = 0 AS strict, id % 5 > 0 AS stable, id % 3 = 0 AS prov FROM sightings),
    p AS (SELECT *, lag(t) OVER w AS pt, lag(key) OVER w AS pk, lag(strict) OVER w AS ps, lag(prov) OVER w AS pp FROM x WINDOW w AS (PARTITION BY camera_id, generation, revision, track ORDER BY t, id)),
    f AS (SELECT *, CASE WHEN t - pt BETWEEN 0 AND 1.5 AND (coalesce(pk, '') = '' OR key = '' OR pk = key OR NOT stable OR (NOT ps AND ((length(pk) = 8 AND length(key) = 8 AND hamming(CASE WHEN length(pk) = 8 THEN pk ELSE '00000000' END, CASE WHEN length(key) = 8 THEN key ELSE '00000000' END) <= 1) OR (strict AND pp)))) THEN NULL ELSE id END AS first FROM p)"""


@query("retry_lineage", v.sql(f"{_LINEAGE}; SELECT id, last_value(first IGNORE NULLS) OVER (PARTITION BY camera_id, generation, revision, track ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS root FROM f", "sightings"))
def _(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id")
    key = F.when(k % 6 == 0, "").when(k % 6 == 1, F.concat(F.substring("plate", 1, 7), F.lit("0"))).otherwise(F.col("plate"))
    s = _s(spark, d).select("id", (F.col("t") / 3600).alias("t"), "camera_id", (k % 2).alias("generation"), F.concat(F.lit("r"), k % 3).alias("revision"), (F.col("k") % 4).alias("track"), key.alias("key"), (k % 4 == 0).alias("strict"), (k % 5 > 0).alias("stable"), (k % 3 == 0).alias("provisional"))
    return retry_lineage(s).select("id", "root")


@query("dataset_fingerprint", v.sql("""x AS (SELECT camera_id, id, 'g' || (id % 3) AS g, plate, upper(sha256(CAST(id AS VARCHAR))) AS h, CASE WHEN id % 5 = 0 THEN 'val' ELSE 'train' END AS split FROM sightings);
    SELECT camera_id, upper(sha256('[' || string_agg('{"feedback_id":' || id || ',"group_id":"' || g || '","plate":"' || plate || '","sha256":"' || h || '","split":"' || split || '"}', ',' ORDER BY id) || ']')) AS fingerprint FROM x GROUP BY 1""", "sightings"))
def _(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id")
    return dataset_fingerprint(_s(spark, d).select("camera_id", k.alias("feedback_id"), F.concat(F.lit("g"), k % 3).alias("group_id"), "plate", F.sha2(k.cast("string"), 256).alias("sha256"), F.when(k % 5 == 0, "VAL").otherwise("Train").alias("split")), "camera_id")


@query("sanitized_results", """WITH x AS (SELECT event_id AS id, regexp_extract(props, '"k": *(\\d+)', 1) AS k FROM events)
    SELECT id, CASE WHEN id % 7 IN (0, 1, 2) THEN NULL ELSE '{"a":[1,{"b":null,"z":"ü"}],"k":' || k || '}' END AS json, CASE id % 7 WHEN 0 THEN 'non-finite' WHEN 1 THEN 'not-json' WHEN 2 THEN 'not-an-object' END AS error FROM x""")
def _(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("event_id"), F.regexp_extract("props", r'"k": *(\d+)', 1)
    good = F.concat(F.lit('{"secret": 1, "k": '), n, F.lit(', "a": [1, {"z": "ü", "b": null}]}'))
    text = F.when(k % 7 == 0, '{"k": NaN}').when(k % 7 == 1, '{"k": ').when(k % 7 == 2, "[1]").otherwise(good)
    return v.table(spark, d, "events").select(k.alias("id"), sanitize_json(text, ["k", "a"]).alias("r")).select("id", "r.json", "r.error")


_INTEGRITY = """b AS (SELECT month(o_orderdate) AS m, o_custkey % 5 AS cam, o_custkey % 3 AS ses, o_orderkey % 3 <> 0 AS readable, o_orderkey % 100 AS plate, o_orderkey % 2 = 0 AS day, o_orderkey % 7 = 0 AS miss, o_orderkey % 11 = 0 AS fa FROM orders),
    g AS (SELECT m, count(*) AS passages, count(*) FILTER (readable) AS readable, count(*) FILTER (NOT readable) AS negative, count(*) FILTER (readable AND NOT miss) AS exact, count(*) FILTER (readable AND miss) AS missed, count(*) FILTER (NOT readable AND fa) AS fa,
      count(DISTINCT plate) FILTER (readable) AS plates, count(DISTINCT cam) AS cams, count(DISTINCT ses) AS sess, count(*) FILTER (day) AS d, count(*) FILTER (NOT day) AS n, count(*) FILTER (day AND readable AND NOT miss) AS de, count(*) FILTER (day AND readable) AS dr FROM b GROUP BY 1)"""


@query("metric_integrity", f"""WITH {_INTEGRITY} SELECT m, concat_ws(',', CASE WHEN m % 6 = 1 THEN 'inconsistent-passage-counts' END, CASE WHEN m % 6 = 2 THEN 'inconsistent-readable-outcomes' END, CASE WHEN m % 6 = 3 THEN 'inconsistent-false-accept-count' END, CASE WHEN m % 6 = 4 THEN 'inconsistent-duplicate-count' END,
    CASE WHEN m % 6 = 5 THEN 'inconsistent-plate-counts' END, CASE WHEN m % 4 = 0 THEN 'inconsistent-camera-counts' END, CASE WHEN m = 7 THEN 'inconsistent-slice-keys' WHEN m = 9 THEN 'inconsistent-slice-count:day,inconsistent-exact-slice:day' END) AS reasons FROM g""")
def _(spark: SparkSession, d: str) -> DataFrame:
    k, cust = F.col("o_orderkey"), F.col("o_custkey")
    o = v.table(spark, d, "orders").select(F.month("o_orderdate").alias("m"), F.concat(F.lit("c"), cust % 5).alias("camera"), F.concat(F.lit("s"), cust % 3).alias("session"), (k % 3 != 0).alias("readable"), (k % 100).cast("string").alias("plate"), F.when(k % 2 == 0, "day").otherwise("night").alias("slice"), (k % 7 == 0).alias("miss"), (k % 11 == 0).alias("fa"))
    r, m = F.col("readable"), F.col("m")
    hit, wrong = r & ~F.col("miss"), ~r & F.col("fa")

    def counts(key: str, when: Column) -> DataFrame:
        each = o.where(when).groupBy("m", key).agg(F.count("*").alias("n"))
        return each.groupBy("m").agg(F.map_from_entries(F.collect_list(F.struct(key, "n"))).alias("x"))

    def slices(when: Column) -> Column:
        return F.map_from_arrays(F.array(F.lit("day"), F.lit("night")), F.array(*[F.count_if(when & (F.col("slice") == s)) for s in ("day", "night")]))

    nothing = F.lit(False)
    g = o.groupBy("m").agg(
        F.count("*").alias("passages"), F.count_if(r).alias("readable"), F.count_if(~r).alias("negative"), F.count_if(hit).alias("exact"), F.count_if(r & F.col("miss")).alias("missed"), F.count_if(wrong).alias("false_accept"),
        F.countDistinct(F.when(r, F.col("plate"))).alias("unique_plates"), F.countDistinct("camera").alias("cameras"), F.countDistinct("session").alias("sessions"),
        slices(F.lit(True)).alias("slice_counts"), slices(r).alias("readable_slice_counts"), slices(~r).alias("negative_slice_counts"), slices(hit).alias("exact_slice_counts"), slices(wrong).alias("false_accept_slice_counts"), slices(nothing).alias("duplicate_slice_counts"),
    )
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    for name, key, when in (("plate_counts", "plate", r), ("readable_camera_counts", "camera", r), ("negative_camera_counts", "camera", ~r), ("readable_session_counts", "session", r), ("negative_session_counts", "session", ~r)):
        g = g.join(counts(key, when).withColumnRenamed("x", name), "m", "left").withColumn(name, F.coalesce(name, none))
    plus = lambda name, rule, n: F.when(rule, F.col(name) + n).otherwise(F.col(name))
    swapped = F.map_from_arrays(F.array(F.lit("day"), F.lit("night")), F.array(F.col("passages") + 1, F.element_at("exact_slice_counts", "night")))
    g = g.withColumn("wrong", F.lit(0).cast("long")).withColumn("duplicate", F.when(m % 6 == 4, F.col("passages") + 1).otherwise(0))
    g = g.withColumn("false_accept", F.when(m % 6 == 3, F.col("negative") + 1).otherwise(F.col("false_accept"))).withColumn("missed", plus("missed", m % 6 == 2, 1)).withColumn("unique_plates", plus("unique_plates", m % 6 == 5, 1)).withColumn("cameras", plus("cameras", m % 4 == 0, 1))
    g = g.withColumn("exact_slice_counts", F.when(m == 9, swapped).otherwise(F.col("exact_slice_counts"))).withColumn("slice_counts", F.when(m == 9, F.map_from_arrays(F.array(F.lit("day"), F.lit("night")), F.array(F.element_at("slice_counts", "day") + 1, F.element_at("slice_counts", "night")))).when(m == 7, none).otherwise(F.col("slice_counts")))
    g = g.withColumn("passages", plus("passages", m % 6 == 1, 1))
    return metric_integrity(g, ["day", "night"]).select(F.col("m").cast("long").alias("m"), F.array_join("reasons", ",").alias("reasons"))


_CANDIDATES = "x AS (SELECT event_id AS id, event_id % 30 AS n, (event_id * 3 % 100) / 100 AS ba, (event_id * 7 % 100) / 100 AS ca, (event_id % 9) / 3 AS be, (event_id % 11) / 3 AS ce, event_id % 13 % 2 AS reg, event_id % 5 = 0 AS blank, event_id % 4 AS init, event_id % 3 > 0 AS rights, event_id % 2 = 0 AS ready, event_id % 6 = 0 AS gold FROM events)"


@query("candidate_gate", f"""WITH {_CANDIDATES}, r AS (SELECT id, list_sort(list_filter([CASE WHEN id % 19 = 0 THEN 'validation-metrics-invalid' END, CASE WHEN n < 12 THEN 'validation-too-small' END, CASE WHEN ca < greatest(0.7, ba) THEN 'validation-exact-regression' END, CASE WHEN id % 19 = 0 OR ce > be + 1e-9 THEN 'validation-character-regression' END,
    CASE WHEN reg > 0 THEN 'validation-sample-regression' END, CASE WHEN blank THEN 'baseline-identity-missing' END, CASE WHEN init = 3 THEN 'untrusted-initialization' END, CASE WHEN NOT rights THEN 'training-rights-unverified' END, CASE WHEN NOT ready THEN 'golden-not-ready' END, CASE WHEN gold THEN 'golden:slice' END], lambda z: z IS NOT NULL)) AS l FROM x)
    SELECT id, len(l) = 0 AS promote, array_to_string(l, ',') AS reasons FROM r""")
def _(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    x = v.table(spark, d, "events").select(
        k.alias("id"), (k % 30).alias("validation_samples"), (k * 3 % 100 / 100).alias("baseline_accuracy"), (k * 7 % 100 / 100).alias("candidate_accuracy"), (k % 9 / 3).alias("baseline_error"), F.when(k % 19 == 0, float("nan")).otherwise(k % 11 / 3).alias("candidate_error"), (k % 13 % 2).alias("regressions"),
        F.when(k % 5 == 0, " ").otherwise("AB").alias("baseline_sha256"), F.when(k % 4 == 3, "scratch").otherwise("active-checkpoint").alias("initialization"), (k % 3 > 0).alias("rights_verified"), (k % 2 == 0).alias("golden_ready"), F.when(k % 6 == 0, F.array(F.lit("slice"))).alias("golden_reasons"),
    )
    return candidate_gate(x).select("id", "promote", F.array_join("reasons", ",").alias("reasons"))
