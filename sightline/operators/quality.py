"""Quality metrics: feedback, slices, passages, calibration, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import plates
from ..functions.numbers import nz, rate, rate_or_null, wilson
from ..plans import views as v
from ..plans.registry import query

UNKNOWN = "unknown"
#: Floors and tolerances of the promotion gate.
MIN_ACCURACY, MIN_GAIN, MAX_FALSE_ACCEPT, MAX_LATENCY_RATIO = 0.90, 0.01, 0.005, 1.75
MIN_SLICE_ACCURACY, MAX_SLICE_LOSS = 0.70, 0.01
#: The claim gate.
CLAIM_ACCURACY, CLAIM_RATE, CLAIM_READABLE, CLAIM_NEGATIVE = 0.99, 0.005, 400, 800


def feedback_summary(feedback: DataFrame) -> DataFrame:
    """Overall and per model revision (else engine, else unknown): reviewed,
    guessed, exact, wrong, misses; accuracy and miss rate over all reviewed rows,
    precision over guesses, mean edits over guesses and over all rows."""
    seen, right = plates.normalize_plate(F.col("observed_norm")), plates.normalize_plate(F.col("corrected_norm"))
    rows = feedback.select(seen.alias("o"), right.alias("c"), F.coalesce(nz(F.trim("observed_model_revision")), nz(F.trim("observed_engine")), F.lit(UNKNOWN)).alias("model_revision"))
    rows = rows.where(plates.plausible(F.col("c"))).select(
        "model_revision",
        F.when(F.col("o") == "", F.length("c")).otherwise(F.levenshtein("o", "c")).alias("d"),
        plates.plausible(F.col("o")).alias("guess"),
        ((F.col("o") == F.col("c")) & (F.col("o") != "")).alias("same"),
    )
    out = rows.groupingSets([["model_revision"], []], "model_revision").agg(
        F.grouping("model_revision").cast("int").alias("overall"),
        F.count("*").alias("reviewed"),
        F.count_if("guess").alias("guessed"),
        F.count_if(F.col("guess") & F.col("same")).alias("exact"),
        F.coalesce(F.sum(F.when(F.col("guess"), F.col("d"))), F.lit(0)).alias("edits_guessed"),
        F.sum("d").alias("edits"),
    )
    n, g, e = F.col("reviewed"), F.col("guessed"), F.col("exact")
    return out.select(
        F.coalesce("model_revision", F.lit("*")).alias("model_revision"),
        "reviewed",
        "guessed",
        "exact",
        (g - e).alias("wrong"),
        (n - g).alias("miss_count"),
        rate(e, n).alias("exact_accuracy"),
        rate(g, n).alias("coverage"),
        rate(e, g).alias("accepted_precision"),
        rate(n - g, n).alias("miss_rate"),
        rate(F.col("edits_guessed"), g).alias("mean_character_error"),
        rate(F.col("edits"), n).alias("mean_character_error_end_to_end"),
    )


def score_predictions(rows: DataFrame) -> DataFrame:
    """Totals (slice ``*``) and per slice; a row counts in each of its slices, and
    only there more than once. Columns expected_plate, predicted_plate, slices,
    latency_ms."""
    e, p = plates.normalize_plate(F.col("expected_plate")), plates.normalize_plate(F.col("predicted_plate"))
    labels = F.when(F.size("slices") > 0, F.col("slices")).otherwise(F.array(F.lit("all")))
    base = rows.select(labels.alias("labels"), "latency_ms", e.alias("e"), p.alias("p"))
    base = base.withColumn("readable", plates.plausible(F.col("e"))).withColumn("taken", plates.plausible(F.col("p")))
    base = base.select("labels", "latency_ms", "readable", "taken", (F.col("e") == F.col("p")).alias("same"), F.levenshtein("p", "e").alias("d"))
    each = base.select(F.explode(F.concat(F.array(F.lit("*")), "labels")).alias("slice"), "latency_ms", "readable", "taken", "same", "d")
    return each.groupBy("slice").agg(
        F.count("*").alias("samples"),
        F.count_if("readable").alias("readable"),
        F.count_if(F.col("readable") & F.col("same")).alias("exact"),
        F.count_if(~F.col("readable") & F.col("taken")).alias("false_accepts"),
        F.count_if(~F.col("readable") & ~F.col("taken")).alias("rejections"),
        F.avg(F.greatest(F.lit(0.0), F.coalesce("latency_ms", F.lit(0.0)))).alias("mean_latency_ms"),
        F.coalesce(F.avg(F.when(F.col("readable"), F.col("d"))), F.lit(0.0)).alias("mean_character_error"),
    )


def _reasons(*pairs: tuple[str | Column, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(r) if isinstance(r, str) else r) for r, c in pairs]))


def promotion(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """promote and reasons from two results of score_predictions."""
    b = baseline.select("slice", *[F.col(c).alias(f"b_{c}") for c in baseline.columns if c != "slice"])
    both = b.join(candidate, "slice", "left")
    accuracy = lambda p: rate(F.col(f"{p}exact"), F.col(f"{p}readable"))
    false_rate = lambda p: rate(F.col(f"{p}false_accepts"), F.col(f"{p}samples") - F.col(f"{p}readable"))
    total = F.col("slice") == "*"
    found = F.when(
        total,
        _reasons(
            ("dataset-mismatch", F.coalesce((F.col("samples") != F.col("b_samples")) | (F.col("samples") == 0), F.lit(True))),
            ("candidate-accuracy-floor", accuracy("") < MIN_ACCURACY),
            ("exact-accuracy-gain", accuracy("") < accuracy("b_") + MIN_GAIN),
            ("false-accept-regression", false_rate("") > F.least(false_rate("b_"), F.lit(MAX_FALSE_ACCEPT))),
            ("latency-regression", F.col("mean_latency_ms") > F.greatest(F.lit(1.0), F.col("b_mean_latency_ms")) * MAX_LATENCY_RATIO),
            ("character-error-regression", F.col("mean_character_error") > F.col("b_mean_character_error") + 1e-9),
        ),
    ).otherwise(
        _reasons(
            (F.concat(F.lit("missing-slice:"), "slice"), F.col("samples").isNull()),
            (F.concat(F.lit("candidate-slice-floor:"), "slice"), (F.col("readable") > 0) & (accuracy("") < MIN_SLICE_ACCURACY)),
            (F.concat(F.lit("slice-regression:"), "slice"), accuracy("") + MAX_SLICE_LOSS < accuracy("b_")),
        )
    )
    reasons = both.select(F.explode_outer(found).alias("reason")).agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
    return reasons.select((F.size("reasons") == 0).alias("promote"), F.array_join("reasons", ",").alias("reasons"))


def passage_rows(passages: DataFrame) -> DataFrame:
    """Every row with its ``errors``; the first row of an id or digest counts, and
    rows are judged in the order of ``o_orderkey``. Nothing is dropped."""
    pid, dig = F.col("passage_id"), F.col("evidence_digest")
    w = lambda c: Window.partitionBy(c).orderBy("o_orderkey")
    rows = passages.withColumn("_pid", F.row_number().over(w("passage_id"))).withColumn("_id_ok", plates.is_identifier(pid) & (F.col("_pid") == 1))
    rows = rows.withColumn("_dig", F.sum(F.col("_id_ok").cast("int")).over(w("evidence_digest").rowsBetween(Window.unboundedPreceding, -1)))
    e = plates.normalize_plate(F.col("expected_plate"))
    day_night = F.size(F.array_intersect("slices", F.array(F.lit("day"), F.lit("night"))))
    early = (
        F.when(~plates.is_identifier(pid), "invalid-passage-id")
        .when(F.col("_pid") > 1, "duplicate-passage-id")
        .when(~plates.is_digest(dig), "invalid-evidence-digest")
        .when(F.coalesce("_dig", F.lit(0)) > 0, "duplicate-evidence-digest")
    )
    late = _reasons(
        ("missing-passage-provenance", ~plates.is_identifier(F.col("camera_id")) | ~plates.is_identifier(F.col("session_id"))),
        ("invalid-slices", (day_night != 1) | (F.size(F.array_distinct("slices")) != F.size("slices"))),
        ("readable-must-be-boolean", F.col("readable").isNull()),
        ("invalid-expected-label", F.col("readable") & ~plates.plausible(e)),
        ("negative-must-have-empty-label", ~F.col("readable") & (F.trim("expected_plate") != "")),
    )
    return rows.withColumn("errors", F.when(early.isNotNull(), F.array(early)).otherwise(late)).drop("_pid", "_id_ok", "_dig")


def score_passages(passages: DataFrame) -> DataFrame:
    """Totals and per slice, camera, session over the rows without errors."""
    good = passage_rows(passages).where(F.size("errors") == 0)
    first, n = F.get("accepted_events", F.lit(0)), F.size("accepted_events")
    keys = F.concat(F.array(F.struct(F.lit("all").alias("kind"), F.lit("*").alias("name"))), F.transform("slices", lambda s: F.struct(F.lit("slice").alias("kind"), s.alias("name"))), F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}_id").alias("name")) for k in ("camera", "session")]))
    hit = F.col("readable") & (n == 1) & (first == plates.normalize_plate(F.col("expected_plate")))
    rows = good.select(F.explode(keys).alias("key"), "readable", hit.alias("hit"), n.alias("n"), "expected_plate")
    return rows.groupBy("key.kind", "key.name").agg(
        F.count("*").alias("passages"),
        F.count_if("readable").alias("readable"),
        F.count_if(~F.col("readable")).alias("negatives"),
        F.count_if("hit").alias("exact"),
        F.count_if(F.col("readable") & (F.col("n") == 0)).alias("missed"),
        F.count_if(F.col("readable") & (F.col("n") > 0) & ~F.col("hit")).alias("wrong"),
        F.count_if(~F.col("readable") & (F.col("n") > 0)).alias("false_accepts"),
        F.count_if(F.col("n") > 1).alias("duplicates"),
        F.countDistinct(F.when(F.col("readable"), F.col("expected_plate"))).alias("plates"),
    )


def claim(scores: DataFrame) -> DataFrame:
    """Whether the totals support the accuracy claim at 95 % confidence."""
    t = scores.where("kind = 'all'")
    exact, false_, dup = (wilson(F.col(a), F.col(b)) for a, b in (("exact", "readable"), ("false_accepts", "negatives"), ("duplicates", "passages")))
    reasons = _reasons(
        ("too-few-readable", F.col("readable") < CLAIM_READABLE),
        ("too-few-negative", F.col("negatives") < CLAIM_NEGATIVE),
        ("exact-lower-bound", exact["lower"] < CLAIM_ACCURACY),
        ("false-accept-upper-bound", false_["upper"] > CLAIM_RATE),
        ("duplicate-upper-bound", dup["upper"] > CLAIM_RATE),
    )
    return t.select((F.size(reasons) == 0).alias("supported"), F.array_join(reasons, ",").alias("reasons"), F.round(exact["lower"], 6).alias("exact_lower"), F.round(false_["upper"], 6).alias("false_accept_upper"))


def confidence_bins(rows: DataFrame, n_bins: int = 10) -> DataFrame:
    """bin, n, accuracy, mean confidence and weighted gap of (confidence, right);
    bins are half open, the last one closed at 1."""
    b = F.least(F.floor(F.col("confidence") * n_bins), F.lit(n_bins - 1)).cast("int")
    each = rows.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(F.col("right").cast("int")).alias("accuracy"), F.avg("confidence").alias("mean_confidence"))
    return each.withColumn("gap", F.abs(F.col("accuracy") - F.col("mean_confidence")))


def calibration_error(rows: DataFrame, n_bins: int = 10) -> DataFrame:
    bins = confidence_bins(rows, n_bins).agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"))
    brier = rows.agg(F.avg(F.pow(F.col("confidence") - F.col("right").cast("int"), 2)).alias("brier"))
    return bins.select(F.round("ece", 6).alias("ece"), F.lit(1).alias("_k")).join(brier.select(F.round("brier", 6).alias("brier"), F.lit(1).alias("_k")), "_k").drop("_k")


def threshold_sweep(rows: DataFrame, thresholds: list[float]) -> DataFrame:
    """Coverage, accuracy of what is taken, and wrong accepts over all rows; the
    thresholds are a short list inside the row, not a second table."""
    each = rows.select(F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"), "confidence", "right")
    taken = F.col("confidence") >= F.col("threshold")
    return each.groupBy("threshold").agg(
        F.avg(taken.cast("int")).alias("coverage"),
        rate_or_null(F.count_if(taken & F.col("right")), F.count_if(taken)).alias("selective_accuracy"),
        F.avg((taken & ~F.col("right")).cast("int")).alias("wrong_accept_rate"),
    )


def best_config(metrics: DataFrame) -> DataFrame:
    """The best row by accuracy, then coverage, then fewest false accepts; the first
    of equal ones."""
    rank = F.struct("accuracy", "coverage", -F.col("false_accepts"), -F.col("ordinal"))
    return metrics.agg(F.max_by(F.struct(*metrics.columns), rank).alias("best")).select("best.*")


def confusions(feedback: DataFrame, min_count: int = 2, min_share: float = 0.75) -> DataFrame:
    """(position, wrong, right) corrections seen often enough and mostly alike."""
    o, c = plates.normalize_plate(F.col("observed_norm")), plates.normalize_plate(F.col("corrected_norm"))
    rows = feedback.select(o.alias("o"), c.alias("c")).where(F.length("o") == F.length("c"))
    pairs = F.arrays_zip(F.split("o", "").alias("wrong"), F.split("c", "").alias("right"))
    rows = rows.select(F.posexplode(pairs).alias("position", "p")).select("position", "p.wrong", "p.right")
    counts = rows.groupBy("position", "wrong", "right").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("position", "wrong"))
    return counts.withColumn("share", F.col("n") / total).where((F.col("wrong") != F.col("right")) & (F.col("n") >= min_count) & (F.col("share") >= min_share))


def position_accuracy(rows: DataFrame) -> DataFrame:
    """Share of right characters at each of the eight places."""
    pairs = F.arrays_zip(F.split("predicted", "").alias("p"), F.split("expected", "").alias("e"))
    each = rows.select(F.posexplode(pairs).alias("position", "x")).where("position < 8")
    return each.groupBy("position").agg(F.count("*").alias("n"), F.count_if(F.col("x.p") == F.col("x.e")).alias("right"))


def learned_corrections(events: DataFrame, feedback: DataFrame) -> DataFrame:
    """Each plate with its latest confirmed correction, if there is one."""
    w = Window.partitionBy("observed_norm").orderBy(F.desc("id"))
    last = feedback.where("observed_norm <> ''").withColumn("_n", F.row_number().over(w)).where("_n = 1").select(F.col("observed_norm").alias("plate_norm"), "corrected_norm")
    return events.join(last, "plate_norm", "left").withColumn("learned", F.coalesce("corrected_norm", "plate_norm"))


def predictions(spark: SparkSession, d: str, shift: int = 0) -> DataFrame:
    """Passages as (expected, predicted, slices, latency); ``shift`` makes some wrong."""
    p = v.passages(spark, d)
    guess = F.get("accepted_events", F.lit(0))
    wrong = (F.col("o_orderkey") % 11 == 0) if shift else F.lit(False)
    return p.select("expected_plate", F.when(wrong, "").otherwise(F.coalesce(guess, F.lit(""))).alias("predicted_plate"), "slices", (F.col("o_orderkey") % 50 + shift).cast("double").alias("latency_ms"))


def _confident(spark: SparkSession, d: str) -> DataFrame:
    return v.observations(spark, d).select((F.col("confidence_pct") / 100).alias("confidence"), (F.col("text") == v.plate_of((F.col("track_id") % 100).cast("int"))).alias("right"))


def _ascii(c: str) -> str:
    """One byte a letter, for engines whose edit distance counts bytes."""
    return f"translate({c}, '{plates.LETTERS}', 'abcdefghijklmnopqrstuvwx')"


_TRACK_PLATE = v.plate_sql("(track_id % 100)")
_PLATE = plates.PLATE
_FEEDBACK = f"""rows AS (SELECT coalesce(nullif(trim(observed_model_revision), ''), nullif(trim(observed_engine), ''), 'unknown') AS model_revision,
    CASE WHEN observed_norm = '' THEN length(corrected_norm) ELSE levenshtein({_ascii('observed_norm')}, {_ascii('corrected_norm')}) END AS d, regexp_matches(observed_norm, '{_PLATE}') AS guess,
    observed_norm = corrected_norm AND observed_norm <> '' AS same FROM feedback),
    agg AS (SELECT coalesce(model_revision, '*') AS model_revision, count(*) AS n, count(*) FILTER (guess) AS g, count(*) FILTER (guess AND same) AS e, coalesce(sum(d) FILTER (guess), 0) AS dg, sum(d) AS d
    FROM rows GROUP BY GROUPING SETS ((model_revision), ()));"""


@query("feedback_summary", v.sql(f"""{_FEEDBACK} SELECT model_revision, n AS reviewed, g AS guessed, e AS exact, g - e AS wrong, n - g AS miss_count, e / greatest(1, n) AS exact_accuracy, g / greatest(1, n) AS coverage,
    e / greatest(1, g) AS accepted_precision, (n - g) / greatest(1, n) AS miss_rate, dg / greatest(1, g) AS mean_character_error, d / greatest(1, n) AS mean_character_error_end_to_end FROM agg""", "feedback"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return feedback_summary(v.feedback(spark, d))


def _scores_sql(shift: int) -> str:
    guess = "coalesce(accepted_events[1], '')"
    guess = f"CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE {guess} END" if shift else guess
    return f"""SELECT unnest(list_concat(['*'], slices)) AS slice, (o_orderkey % 50 + {shift})::DOUBLE AS l, expected_plate AS e, {guess} AS p, regexp_matches(expected_plate, '{_PLATE}') AS r FROM passages"""


_SCORE_COLUMNS = f"""slice, count(*) AS samples, count(*) FILTER (r) AS readable, count(*) FILTER (r AND e = p) AS exact, count(*) FILTER (NOT r AND regexp_matches(p, '{_PLATE}')) AS false_accepts,
    count(*) FILTER (NOT r AND NOT regexp_matches(p, '{_PLATE}')) AS rejections, avg(l) AS mean_latency_ms, coalesce(avg(levenshtein({_ascii('p')}, {_ascii('e')})) FILTER (r), 0.0) AS mean_character_error"""


@query("prediction_slices", v.sql(f"x AS ({_scores_sql(0)}); SELECT {_SCORE_COLUMNS} FROM x GROUP BY slice", "passages"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return score_predictions(predictions(spark, d))


@query("promotion_gate", v.sql(f"""x AS ({_scores_sql(0)}), y AS ({_scores_sql(3)}), b AS (SELECT {_SCORE_COLUMNS} FROM x GROUP BY slice), c AS (SELECT {_SCORE_COLUMNS} FROM y GROUP BY slice),
    j AS (SELECT b.slice, c.samples, b.samples AS bs, c.readable AS r, c.exact / greatest(1, c.readable) AS ca, b.exact / greatest(1, b.readable) AS ba, c.false_accepts / greatest(1, c.samples - c.readable) AS cf,
        b.false_accepts / greatest(1, b.samples - b.readable) AS bf, c.mean_latency_ms AS cl, b.mean_latency_ms AS bl, c.mean_character_error AS ce, b.mean_character_error AS be FROM b LEFT JOIN c USING (slice)),
    z AS (SELECT unnest(CASE WHEN slice = '*' THEN [CASE WHEN coalesce(samples <> bs OR samples = 0, true) THEN 'dataset-mismatch' END, CASE WHEN ca < 0.9 THEN 'candidate-accuracy-floor' END, CASE WHEN ca < ba + 0.01 THEN 'exact-accuracy-gain' END,
        CASE WHEN cf > least(bf, 0.005) THEN 'false-accept-regression' END, CASE WHEN cl > greatest(1.0, bl) * 1.75 THEN 'latency-regression' END, CASE WHEN ce > be + 1e-9 THEN 'character-error-regression' END]
        ELSE [CASE WHEN samples IS NULL THEN 'missing-slice:' || slice END, CASE WHEN r > 0 AND ca < 0.7 THEN 'candidate-slice-floor:' || slice END, CASE WHEN ca + 0.01 < ba THEN 'slice-regression:' || slice END] END) AS reason FROM j);
    SELECT count(reason) = 0 AS promote, coalesce(string_agg(DISTINCT reason, ',' ORDER BY reason), '') AS reasons FROM z""", "passages"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return promotion(score_predictions(predictions(spark, d)), score_predictions(predictions(spark, d, 3)))


_PASSAGES = """good AS (SELECT *, len(accepted_events) AS n, readable AND len(accepted_events) = 1 AND accepted_events[1] = expected_plate AS hit FROM passages),
    keys AS (SELECT unnest(list_concat([{'kind': 'all', 'name': '*'}, {'kind': 'camera', 'name': camera_id}, {'kind': 'session', 'name': session_id}], list_transform(slices, lambda s: {'kind': 'slice', 'name': s}))) AS key, readable, hit, n, expected_plate FROM good),
    scores AS (SELECT key.kind AS kind, key.name AS name, count(*) AS passages, count(*) FILTER (readable) AS readable, count(*) FILTER (NOT readable) AS negatives, count(*) FILTER (hit) AS exact,
        count(*) FILTER (readable AND n = 0) AS missed, count(*) FILTER (readable AND n > 0 AND NOT hit) AS wrong, count(*) FILTER (NOT readable AND n > 0) AS false_accepts, count(*) FILTER (n > 1) AS duplicates,
        count(DISTINCT CASE WHEN readable THEN expected_plate END) AS plates FROM keys GROUP BY ALL);"""


@query("passage_scores", v.sql(f"{_PASSAGES} SELECT * FROM scores", "passages"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return score_passages(v.passages(spark, d))


@query("passage_validation", v.sql("""twice AS (SELECT *, 0 AS copy FROM passages WHERE o_orderkey < 200 UNION ALL SELECT *, 1 FROM passages WHERE o_orderkey < 200 AND o_orderkey % 7 = 0);
    SELECT o_orderkey, CASE WHEN copy = 1 THEN 'duplicate-passage-id' ELSE '' END AS errors FROM twice""", "passages"))
def _(spark: SparkSession, d: str) -> DataFrame:
    p = v.passages(spark, d).where("o_orderkey < 200")
    return passage_rows(p.union(p.where("o_orderkey % 7 = 0"))).select("o_orderkey", F.array_join("errors", ",").alias("errors"))


_WILSON = "(({h} / {n} + {z} * {z} / (2 * {n})) {s} {z} * sqrt({h} / {n} * (1 - {h} / {n}) / {n} + {z} * {z} / (4 * {n} * {n}))) / (1 + {z} * {z} / {n})"
_LOW = _WILSON.format(h="exact", n="readable", z="1.959963984540054", s="-")
_HIGH = _WILSON.format(h="false_accepts", n="negatives", z="1.959963984540054", s="+")
_DUP = _WILSON.format(h="duplicates", n="passages", z="1.959963984540054", s="+")


@query("claim_gate", v.sql(f"""{_PASSAGES[:-1]}, b AS (SELECT *, {_LOW} AS low, {_HIGH} AS high, {_DUP} AS dup FROM scores WHERE kind = 'all'),
    r AS (SELECT *, list_filter([CASE WHEN readable < 400 THEN 'too-few-readable' END, CASE WHEN negatives < 800 THEN 'too-few-negative' END, CASE WHEN low < 0.99 THEN 'exact-lower-bound' END,
        CASE WHEN high > 0.005 THEN 'false-accept-upper-bound' END, CASE WHEN dup > 0.005 THEN 'duplicate-upper-bound' END], lambda x: x IS NOT NULL) AS why FROM b);
    SELECT len(why) = 0 AS supported, array_to_string(why, ',') AS reasons, round(low, 6) AS exact_lower, round(high, 6) AS false_accept_upper FROM r""", "passages"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return claim(score_passages(v.passages(spark, d)))


_CONF = f"c AS (SELECT confidence_pct / 100 AS confidence, text = {_TRACK_PLATE} AS good FROM observations)"
_BINS = f"{_CONF}, bins AS (SELECT CAST(least(floor(confidence * 10), 9) AS INTEGER) AS bin, count(*) AS n, avg(good::INT) AS accuracy, avg(confidence) AS mean_confidence FROM c GROUP BY 1)"


@query("confidence_bins", v.sql(f"{_BINS}; SELECT bin, n, round(accuracy, 6) AS accuracy, round(mean_confidence, 6) AS mean_confidence FROM bins", "observations"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return confidence_bins(_confident(spark, d)).select("bin", "n", F.round("accuracy", 6).alias("accuracy"), F.round("mean_confidence", 6).alias("mean_confidence"))


@query("calibration_error", v.sql(f"{_BINS}; SELECT round(sum(n * abs(accuracy - mean_confidence)) / sum(n), 6) AS ece, (SELECT round(avg(pow(confidence - good::INT, 2)), 6) FROM c) AS brier FROM bins", "observations"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return calibration_error(_confident(spark, d))


@query("threshold_sweep", v.sql(f"{_CONF}; SELECT threshold, avg((confidence >= threshold)::INT) AS coverage, count(*) FILTER (confidence >= threshold AND good) / nullif(count(*) FILTER (confidence >= threshold), 0) AS selective_accuracy, avg((confidence >= threshold AND NOT good)::INT) AS wrong_accept_rate FROM c, (SELECT unnest([0.5::DOUBLE, 0.7, 0.8, 0.9, 0.97]) AS threshold) GROUP BY 1", "observations"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return threshold_sweep(_confident(spark, d), [0.5, 0.7, 0.8, 0.9, 0.97])


@query("best_config", v.sql("m AS (SELECT CAST(floor(confidence_pct / 5) AS INTEGER) AS ordinal, count(*) FILTER (quality_pct > 75) AS accuracy, 1 AS coverage, count(*) FILTER (quality_pct < 70) AS false_accepts FROM observations GROUP BY 1); SELECT * FROM m ORDER BY accuracy DESC, coverage DESC, false_accepts, ordinal LIMIT 1", "observations"))
def _(spark: SparkSession, d: str) -> DataFrame:
    m = v.observations(spark, d).groupBy(F.floor(F.col("confidence_pct") / 5).cast("int").alias("ordinal")).agg(F.count_if(F.col("quality_pct") > 75).alias("accuracy"), F.lit(1).alias("coverage"), F.count_if(F.col("quality_pct") < 70).alias("false_accepts"))
    return best_config(m)


_CHARS = "p AS (SELECT unnest(range(1, length(observed_norm) + 1)) AS i, observed_norm AS o, corrected_norm AS c FROM feedback WHERE length(observed_norm) = length(corrected_norm))"


@query("confusions", v.sql(f"{_CHARS}, q AS (SELECT i - 1 AS position, o[i] AS wrong, c[i] AS fixed, count(*) AS n FROM p GROUP BY ALL), r AS (SELECT *, n / sum(n) OVER (PARTITION BY position, wrong) AS share FROM q); SELECT CAST(position AS INTEGER) AS position, wrong, fixed, n, share FROM r WHERE wrong <> fixed AND n >= 2 AND share >= 0.2", "feedback"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return confusions(v.feedback(spark, d), min_share=0.2).withColumnRenamed("right", "fixed")


@query("position_accuracy", v.sql(f"{_CHARS}; SELECT CAST(i - 1 AS INTEGER) AS position, count(*) AS n, count(*) FILTER (o[i] = c[i]) AS right FROM p WHERE i <= 8 GROUP BY 1", "feedback"))
def _(spark: SparkSession, d: str) -> DataFrame:
    f = v.feedback(spark, d).where(F.length("observed_norm") == F.length("corrected_norm"))
    return position_accuracy(f.select(F.col("observed_norm").alias("predicted"), F.col("corrected_norm").alias("expected")))


@query("learned_corrections", v.sql("l AS (SELECT observed_norm, arg_max(corrected_norm, id) AS c FROM feedback WHERE observed_norm <> '' GROUP BY 1); SELECT id, coalesce(c, plate_norm) AS learned FROM sightings LEFT JOIN l ON plate_norm = observed_norm", "sightings", "feedback"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return learned_corrections(v.sightings(spark, d), v.feedback(spark, d)).select("id", "learned")


def golden_violations(rows: DataFrame) -> DataFrame:
    """Every broken rule of a golden manifest (id, readable, expected_plate, slices,
    media_kind, frame_index), one row each."""
    day_night = F.size(F.array_intersect("slices", F.array(F.lit("day"), F.lit("night"))))
    plate_ok = plates.plausible(F.col("expected_plate"))
    bad = _reasons(
        ("invalid-id", ~plates.is_identifier(F.col("id"))),
        ("repeated-id", F.count("*").over(Window.partitionBy("id")) > 1),
        ("readable-without-plate", F.col("readable") & ~plate_ok),
        ("negative-with-plate", ~F.col("readable") & (F.trim("expected_plate") != "")),
        ("one-of-day-night", day_night != 1),
        ("frame-of-image", (F.col("media_kind") == "image") & F.col("frame_index").isNotNull()),
        ("video-without-frame", (F.col("media_kind") == "video") & F.coalesce(F.col("frame_index") < 0, F.lit(True))),
    )
    return rows.select("id", bad.alias("violations")).select("id", F.explode("violations").alias("violation"))


def margin_gate(slots: DataFrame, least: float = 0.56, margin: float = 0.12) -> DataFrame:
    """Tracks whose every place is sure: columns track_id, place, p of each character."""
    w = Window.partitionBy("track_id", "place").orderBy(F.desc("p"))
    top = slots.withColumn("rank", F.row_number().over(w)).where("rank <= 2").groupBy("track_id", "place").agg(F.max("p").alias("p"), (F.max("p") - F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("p"))), F.lit(0.0))).alias("margin"))
    return top.groupBy("track_id").agg(F.bool_and((F.col("p") >= least) & (F.col("margin") >= margin)).alias("accepted"))


@query("golden_violations", v.sql("""g AS (SELECT 'g' || (o_orderkey % 1400) AS id, readable, CASE WHEN o_orderkey % 41 = 0 THEN 'x' ELSE expected_plate END AS plate, CASE WHEN o_orderkey % 43 = 0 THEN ['w1'] ELSE slices END AS slices, CASE WHEN o_orderkey % 2 = 0 THEN 'image' ELSE 'video' END AS kind, CASE WHEN o_orderkey % 5 = 0 THEN 3 WHEN o_orderkey % 2 = 1 THEN o_orderkey % 9 - 1 END AS frame FROM passages),
    r AS (SELECT id, unnest([CASE WHEN count(*) OVER (PARTITION BY id) > 1 THEN 'repeated-id' END, CASE WHEN readable AND plate = 'x' THEN 'readable-without-plate' END, CASE WHEN NOT readable AND plate <> '' THEN 'negative-with-plate' END, CASE WHEN len(list_intersect(slices, ['day', 'night'])) <> 1 THEN 'one-of-day-night' END,
        CASE WHEN kind = 'image' AND frame IS NOT NULL THEN 'frame-of-image' END, CASE WHEN kind = 'video' AND coalesce(frame < 0, true) THEN 'video-without-frame' END]) AS violation FROM g); SELECT id, violation FROM r WHERE violation IS NOT NULL""", "passages"))
def _(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    g = v.passages(spark, d).select(
        F.concat(F.lit("g"), k % 1400).alias("id"),
        "readable",
        F.when(k % 41 == 0, "x").otherwise(F.col("expected_plate")).alias("expected_plate"),
        F.when(k % 43 == 0, F.array(F.lit("w1"))).otherwise(F.col("slices")).alias("slices"),
        F.when(k % 2 == 0, "image").otherwise("video").alias("media_kind"),
        F.when(k % 5 == 0, 3).when(k % 2 == 1, k % 9 - 1).alias("frame_index"),
    )
    return golden_violations(g)


@query("margin_gate", v.sql("r AS (SELECT track_id, seq, confidence_pct / 100 AS p, row_number() OVER (PARTITION BY track_id, seq ORDER BY confidence_pct DESC) AS rank FROM observations), t AS (SELECT track_id, seq, max(p) AS p, max(p) - coalesce(max(CASE WHEN rank = 2 THEN p END), 0) AS m FROM r WHERE rank <= 2 GROUP BY ALL); SELECT track_id, bool_and(p >= 0.9 AND m >= 0.5) AS accepted FROM t GROUP BY 1", "observations"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return margin_gate(v.observations(spark, d).select("track_id", F.col("seq").alias("place"), (F.col("confidence_pct") / 100).alias("p")), 0.9, 0.5)
