"""Rollups of telemetry and storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import non_negative, severity
from ..plans import views as v
from ..plans.registry import query

LEVELS = ("normal", "elevated", "high", "critical")


def p95(c: str) -> Column:
    """Nearest rank."""
    return F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {c})")


def jain(x: Column) -> Column:
    return F.coalesce(F.pow(F.sum(x), 2) / F.nullif(F.count(x) * F.sum(x * x), F.lit(0)), F.lit(1.0))


def capacity(rows: DataFrame) -> DataFrame:
    """Sums of counters, rates, and the distinct errors of (decoded, seconds, error)."""
    d, s = F.sum(non_negative(F.col("decoded"))), F.sum(non_negative(F.col("seconds")))
    return rows.agg(d.alias("decoded"), s.alias("seconds"), F.when(s > 0, d / s).otherwise(0.0).alias("fps"), F.array_join(F.array_sort(F.collect_set(F.nullif("error", F.lit("")))), ",").alias("errors"))


def scenario(jobs: DataFrame, by: list[str]) -> DataFrame:
    """Per scenario, from its cameras' totals: jobs, latency, fairness, spread, starved."""
    cams = jobs.groupBy(*by, "camera").agg(F.count_if("done").alias("done"), F.count("*").alias("all"))
    fair = cams.groupBy(*by).agg(F.sum("all").alias("jobs"), jain(F.col("done")).alias("fairness"), (F.max("done") - F.min("done")).alias("spread"), F.count_if(F.col("done") == 0).alias("starved"))
    lat = jobs.where("done").groupBy(*by).agg(F.avg("latency").alias("mean_latency"), p95("latency").alias("p95_latency"))
    return fair.join(lat, by, "left")


def scaling(runs: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Each run's change against the smallest one of its group."""
    first = F.first(value).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return runs.withColumn("delta", F.col(value) - first)


def evict(files: DataFrame, needed: Column | int, group: str | None = None) -> DataFrame:
    """Oldest unprotected files until ``needed`` bytes are free, the one that crosses
    included. Running sums per group where one is named; else over day partitions,
    so that no task sees all files."""
    free = files.where(~F.col("protected"))
    if group:
        w = Window.partitionBy(group).orderBy("mtime", "path").rowsBetween(Window.unboundedPreceding, -1)
        return free.withColumn("before", F.coalesce(F.sum("size").over(w), F.lit(0))).where(F.col("before") < needed)
    day = F.floor(F.col("mtime") / 86400)
    days = free.groupBy(day.alias("_day")).agg(F.sum("size").alias("_size"))
    days = days.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a day
    w = Window.partitionBy("_day").orderBy("mtime", "path").rowsBetween(Window.unboundedPreceding, -1)
    out = free.withColumn("_day", day).join(days, "_day").withColumn("before", F.col("_before") + F.coalesce(F.sum("size").over(w), F.lit(0)))
    return out.where(F.col("before") < needed).drop("_day", "_size", "_before")


def ema(rows: DataFrame, key: str, order: str, value: str, alpha: float) -> DataFrame:
    """The exponential mean of each key's values in order, starting at 0."""
    seq = F.array_sort(F.collect_list(F.struct(order, value)))
    return rows.groupBy(key).agg(F.aggregate(seq, F.lit(0.0), lambda a, x: alpha * x[value] + (1 - alpha) * a).alias("ema"))


def pressure() -> Column:
    """The strongest of the severities of cpu, detector, ocr, queue and stale drops,
    half of active cameras', and their weighted sum."""
    cpu = severity(F.col("cpu"), 65.0, 80.0, 92.0)
    detector, ocr = (severity(F.col(c), t, t * 1.75, t * 2.75) for c, t in (("detector_ms", 90.0), ("ocr_ms", 120.0)))
    queue, active = severity(F.col("queue_ratio"), 0.25, 0.55, 0.82), severity(F.col("active").cast("double"), 8.0, 16.0, 32.0)
    return F.greatest(cpu, detector, ocr, queue, F.greatest(F.lit(0.0), F.col("stale_rate")) / 0.05, 0.5 * active, 0.30 * cpu + 0.22 * detector + 0.18 * ocr + 0.15 * queue + 0.15 * active)


def level(p: Column) -> Column:
    return F.when(p >= 2.7, 3).when(p >= 1.75, 2).when(p >= 1.0, 1).otherwise(0)


def load_level(rows: DataFrame, key: str, order: str, alpha: float = 0.28, recoveries: int = 3) -> DataFrame:
    """The level after each key's last reading: up at once, down by one after
    ``recoveries`` readings below it in a row."""
    seq = F.array_sort(F.collect_list(F.struct(order, "pressure")))
    zero = F.struct(F.lit(0.0).alias("ema"), F.lit(0).alias("level"), F.lit(0).alias("calm"))

    def step(a: Column, x: Column) -> Column:
        e = alpha * x["pressure"] + (1 - alpha) * a["ema"]
        want = F.greatest(level(x["pressure"]), level(e))
        calm = F.when(want < a["level"], a["calm"] + 1).otherwise(0)
        down = calm >= recoveries
        now = F.when(want > a["level"], want).when(down, a["level"] - 1).otherwise(a["level"])
        return F.struct(e.alias("ema"), now.alias("level"), F.when(down, 0).otherwise(calm).alias("calm"))

    last = rows.groupBy(key).agg(F.aggregate(seq, zero, step).alias("s"))
    return last.select(key, F.round("s.ema", 6).alias("ema"), F.col("s.level").alias("level"))


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    li = v.table(spark, d, "lineitem")
    return li.select(F.col("l_returnflag").alias("scenario"), (F.col("l_suppkey") % 16).alias("camera"), (F.col("l_discount") < 0.07).alias("done"), F.col("l_quantity").alias("latency"))


@query("capacity_totals", "SELECT sum(CAST(l_quantity AS DOUBLE)) AS decoded, sum(CAST(l_linenumber AS DOUBLE)) AS seconds, sum(l_quantity) / sum(l_linenumber) AS fps, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS errors FROM lineitem")
def _(spark: SparkSession, d: str) -> DataFrame:
    return capacity(v.table(spark, d, "lineitem").select(F.col("l_quantity").cast("string").alias("decoded"), F.col("l_linenumber").cast("string").alias("seconds"), F.col("l_returnflag").alias("error")))


@query("scenario_rollup", """WITH j AS (SELECT l_returnflag AS scenario, l_suppkey % 16 AS camera, l_discount < 0.07 AS done, l_quantity AS latency FROM lineitem),
    c AS (SELECT scenario, camera, count(*) FILTER (done) AS done, count(*) AS n FROM j GROUP BY ALL)
    SELECT scenario, sum(n)::BIGINT AS jobs, coalesce(pow(sum(done), 2) / nullif(count(done) * sum(done * done), 0), 1.0) AS fairness, max(done) - min(done) AS spread, count(*) FILTER (done = 0) AS starved,
    (SELECT avg(latency) FROM j WHERE done AND j.scenario = c.scenario) AS mean_latency, (SELECT quantile_disc(latency, 0.95) FROM j WHERE done AND j.scenario = c.scenario) AS p95_latency FROM c GROUP BY scenario""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return scenario(_jobs(spark, d), ["scenario"])


@query("scaling_delta", "WITH r AS (SELECT l_returnflag AS active, l_linenumber AS cameras, count(*) AS n FROM lineitem GROUP BY ALL) SELECT active, cameras, n, n - first(n) OVER (PARTITION BY active ORDER BY cameras) AS delta FROM r")
def _(spark: SparkSession, d: str) -> DataFrame:
    r = v.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("active"), F.col("l_linenumber").alias("cameras")).agg(F.count("*").alias("n"))
    return scaling(r, "active", "cameras", "n")


def _files(spark: SparkSession, d: str) -> DataFrame:
    o = v.table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("path"), (v.micros(F.col("o_orderdate")) / 1e6).alias("mtime"), F.floor("o_totalprice").alias("size"), (F.col("o_orderkey") % 10 == 0).alias("protected"))


_FILES = "f AS (SELECT o_orderkey AS path, epoch_us(o_orderdate) / 1e6 AS mtime, CAST(floor(o_totalprice) AS BIGINT) AS size, o_orderkey % 10 = 0 AS protected FROM orders)"


@query("evict_oldest", f"WITH {_FILES}, r AS (SELECT path, size, coalesce(sum(size) OVER (ORDER BY mtime, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM f WHERE NOT protected) SELECT * FROM r WHERE before < 50000000")
def _(spark: SparkSession, d: str) -> DataFrame:
    return evict(_files(spark, d), 50_000_000).select("path", "size", "before")


@query("oldest_files", f"WITH {_FILES} SELECT path, size FROM f ORDER BY mtime, path LIMIT 200")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).orderBy("mtime", "path").limit(200).select("path", "size")


@query("storage_totals", f"WITH {_FILES} SELECT sum(size)::BIGINT AS bytes, sum(size) > 100000000 AS over_limit, count(*) FILTER (protected) AS protected FROM f")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).agg(F.sum("size").alias("bytes"), (F.sum("size") > 100_000_000).alias("over_limit"), F.count_if("protected").alias("protected"))


@query("latency_ema", "WITH RECURSIVE r AS (SELECT l_orderkey AS track, l_quantity AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) AS n FROM lineitem), e AS (SELECT track, n, 0.2 * q AS ema FROM r WHERE n = 1 UNION ALL SELECT r.track, r.n, 0.2 * r.q + 0.8 * e.ema FROM e JOIN r ON r.track = e.track AND r.n = e.n + 1) SELECT track, round(arg_max(ema, n), 6) AS ema FROM e GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    li = v.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("track"), F.struct("l_linenumber", "l_quantity").alias("n"), F.col("l_quantity").alias("q"))
    return ema(li, "track", "n", "q", 0.2).select("track", F.round("ema", 6).alias("ema"))


def _severity_sql(x: str, elevated: float, high: float, critical: float) -> str:
    return f"CASE WHEN {x} >= {critical} THEN 2.7 + ({x} - {critical}) / {critical} WHEN {x} >= {high} THEN 1.75 + 0.95 * ({x} - {high}) / {critical - high} WHEN {x} >= {elevated} THEN 1 + 0.75 * ({x} - {elevated}) / {high - elevated} ELSE greatest(0, {x} / {elevated}) END"


_LEVEL = "CASE WHEN {0} >= 2.7 THEN 3 WHEN {0} >= 1.75 THEN 2 WHEN {0} >= 1.0 THEN 1 ELSE 0 END"
_LEVELS_SQL = f"""WITH RECURSIVE {v.sql("SELECT 1", "sightings")[len("WITH ") : -len(" SELECT 1")]}, m AS (SELECT camera_id, id, {_severity_sql("confidence_pct::DOUBLE", 65.0, 80.0, 92.0)} AS cpu, {_severity_sql("(k * 3.0::DOUBLE)", 90.0, 157.5, 247.5)} AS det, {_severity_sql("(k * 2.0::DOUBLE)", 120.0, 210.0, 330.0)} AS ocr, {_severity_sql("(confidence * 0.5)", 0.25, 0.55, 0.82)} AS q, {_severity_sql("((id % 20)::DOUBLE)", 8.0, 16.0, 32.0)} AS act FROM sightings),
    p AS (SELECT camera_id, row_number() OVER (PARTITION BY camera_id ORDER BY id) AS i, greatest(cpu, det, ocr, q, 0.5 * act, 0.30 * cpu + 0.22 * det + 0.18 * ocr + 0.15 * q + 0.15 * act) AS pressure FROM m),
    f AS (SELECT camera_id, 0::BIGINT AS i, 0::DOUBLE AS ema, 0 AS level, 0 AS calm FROM p WHERE i = 1
    UNION ALL SELECT camera_id, i, e, CASE WHEN want > level THEN want WHEN c >= 3 THEN level - 1 ELSE level END, CASE WHEN c >= 3 THEN 0 ELSE c END FROM (SELECT *, CASE WHEN want < level THEN calm + 1 ELSE 0 END AS c FROM (SELECT *, greatest({_LEVEL.format("pressure")}, {_LEVEL.format("e")}) AS want FROM (SELECT p.camera_id, p.i, p.pressure, f.level, f.calm, 0.28 * p.pressure + 0.72 * f.ema AS e FROM f JOIN p ON p.camera_id = f.camera_id AND p.i = f.i + 1))))
    SELECT camera_id, round(arg_max(ema, i), 6) AS ema, arg_max(level, i) AS level FROM f GROUP BY 1"""


def snapshot(tracks: DataFrame, readings: DataFrame, alpha: float = 0.2) -> DataFrame:
    """One row a camera: readings, their mean and exponential mean in milliseconds,
    tracks in each phase and attempts, whether it is active. ``tracks``: camera_id,
    phase, attempts; ``readings``: camera_id, at, seconds."""
    phase = lambda p: F.count_if(F.col("phase") == p)
    t = tracks.groupBy("camera_id").agg(F.count("*").alias("tracks"), phase("provisional").alias("provisional"), phase("soft_locked").alias("locked"), phase("finalized").alias("finalized"), F.sum("attempts").alias("attempts"), F.bool_or(~F.col("phase").isin("idle", "done")).alias("active"))
    r = readings.groupBy("camera_id").agg(F.count("*").alias("readings"), (F.avg("seconds") * 1000).alias("mean_ms"))
    e = ema(readings, "camera_id", "at", "seconds", alpha).select("camera_id", (F.col("ema") * 1000).alias("ema_ms"))
    return r.join(e, "camera_id", "full").join(t, "camera_id", "full").fillna(0).withColumn("active", F.coalesce("active", F.lit(False)))


@query("telemetry_snapshot", v.sql("""t AS (SELECT camera_id, count(*) AS tracks, count(*) FILTER (id % 5 = 1) AS provisional, count(*) FILTER (id % 5 = 2) AS locked, count(*) FILTER (id % 5 = 3) AS finalized, sum(id % 4)::BIGINT AS attempts, bool_or(id % 5 IN (1, 2, 3)) AS active FROM sightings WHERE id % 3 = 0 GROUP BY 1),
    n AS (SELECT camera_id, k / 1000 AS s, row_number() OVER w AS i, count(*) OVER (PARTITION BY camera_id) AS n FROM sightings WINDOW w AS (PARTITION BY camera_id ORDER BY id)), r AS (SELECT camera_id, count(*) AS readings, avg(s) * 1000 AS mean_ms, sum(0.2 * pow(0.8, n - i) * s) * 1000 AS ema_ms FROM n GROUP BY 1);
    SELECT camera_id, readings, round(mean_ms, 6) AS mean_ms, round(ema_ms, 6) AS ema_ms, coalesce(tracks, 0) AS tracks, coalesce(provisional, 0) AS provisional, coalesce(locked, 0) AS locked, coalesce(finalized, 0) AS finalized, coalesce(attempts, 0) AS attempts, coalesce(active, false) AS active FROM r LEFT JOIN t USING (camera_id)""", "sightings"))
def _(spark: SparkSession, d: str) -> DataFrame:
    s, k = v.sightings(spark, d), F.col("id")
    phase = F.element_at(F.array(*map(F.lit, ("idle", "provisional", "soft_locked", "finalized", "done"))), (k % 5 + 1).cast("int"))
    out = snapshot(s.where(k % 3 == 0).select("camera_id", phase.alias("phase"), (k % 4).alias("attempts")), s.select("camera_id", k.alias("at"), (F.col("k") / 1000).alias("seconds")))
    return out.withColumn("mean_ms", F.round("mean_ms", 6)).withColumn("ema_ms", F.round("ema_ms", 6))


@query("load_levels", _LEVELS_SQL)
def _(spark: SparkSession, d: str) -> DataFrame:
    e = v.sightings(spark, d)
    r = e.select("camera_id", "id", F.col("confidence_pct").cast("double").alias("cpu"), (F.col("k") * 3.0).alias("detector_ms"), (F.col("k") * 2.0).alias("ocr_ms"), (F.col("confidence") * 0.5).alias("queue_ratio"), (F.col("id") % 20).alias("active"), F.lit(0.0).alias("stale_rate"))
    return load_level(r.withColumn("pressure", pressure()), "camera_id", "id")
