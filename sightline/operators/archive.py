"""The sightings archive: search, pages, facets, dashboard, polling, retention."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, plates
from ..functions.numbers import nz
from ..plans import views as v
from ..plans.registry import query

PAGE_SIZES = (25, 50, 100)
#: Dimension tables up to so many rows are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 100_000


@dataclass
class Filters:
    """A search; absent fields add no condition."""

    plate: str | None = None
    city: str | None = None
    region: str | None = None
    status: str | None = None
    camera_id: int | None = None
    start: dt.datetime | None = None  # UTC, half open
    end: dt.datetime | None = None
    time_from: str | None = None  # HH:mm:ss at offset_minutes
    time_to: str | None = None
    offset_minutes: int = 210


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if its size has been checked to be small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def enrich(events: DataFrame, watch: DataFrame, cams: DataFrame) -> DataFrame:
    """Left joins to the watchlist by plate and to the cameras by id."""
    w = watch.select("plate_norm", F.col("status").alias("watch_status"))
    c = cams.select(F.col("id").alias("camera_id"), F.col("name").alias("camera_name"), F.col("city").alias("camera_city"))
    return events.join(small(w), "plate_norm", "left").join(small(c), "camera_id", "left")


def conditions(f: Filters) -> list[Column]:
    out: list[Column] = []
    if f.plate:
        key = plates.normalize_plate(F.lit(f.plate))
        # contains, not LIKE: % and _ are ordinary characters; nothing left of the text means nothing matches.
        out.append((key != "") & F.contains(F.coalesce(nz(F.col("plate_norm")), F.col("raw_guess_norm"), F.lit("")), key))
    if f.city:
        out.append(F.instr(F.coalesce(nz(F.col("city")), nz(F.col("camera_city")), F.lit("")), f.city) > 0)
    if f.region:
        digits = F.regexp_replace(plates.ascii_digits(F.lit(f.region)), r"\s", "")
        out.append(digits.rlike(r"^\d{1,2}$") & (F.right(F.col("plate_norm"), F.lit(2)) == F.lpad(digits, 2, "0")))
    if f.status:
        out.append(F.coalesce("watch_status", F.lit("unknown")) == f.status)
    if f.camera_id is not None:
        out.append(F.col("camera_id") == f.camera_id)
    if f.start and f.end and f.start >= f.end:
        return [F.lit(False)]  # an impossible range fails closed
    if f.start:
        out.append(F.col("created_at") >= F.lit(f.start).cast("timestamp_ntz"))
    if f.end:
        out.append(F.col("created_at") < F.lit(f.end).cast("timestamp_ntz"))
    if f.time_from or f.time_to:
        at = dates.time_of_day(F.col("created_at"), f.offset_minutes)
        out += [at >= f.time_from] if f.time_from else []
        out += [at < f.time_to] if f.time_to else []
    return out


def search(enriched: DataFrame, f: Filters) -> DataFrame:
    found = conditions(f)
    return enriched.where(reduce(Column.__and__, found)) if found else enriched


def page(found: DataFrame, size: int, number: int, at: str = "created_at") -> DataFrame:
    """One page, newest first; sizes outside the list become the smallest one."""
    size = size if size in PAGE_SIZES else PAGE_SIZES[0]
    return found.orderBy(F.desc(at), F.desc("id")).offset(max(0, number - 1) * size).limit(size)


def page_clamped(found: DataFrame, size: int, number: int) -> tuple[DataFrame, int, int]:
    """The page, its number after clamping to the last one, and the count."""
    total = found.count()
    size = size if size in PAGE_SIZES else PAGE_SIZES[0]
    number = max(1, min(number, -(-total // size) or 1))
    return page(found, size, number), number, total


def keyset_page(events: DataFrame, before: int | None, size: int) -> DataFrame:
    return (events if before is None else events.where(F.col("id") < before)).orderBy(F.desc("id")).limit(size)


def snapshot_page(events: DataFrame, snapshot: int, after: int, camera_id: int | None = None) -> DataFrame:
    """Rows frozen at a highest id, above a lower one."""
    out = events.where((F.col("id") <= snapshot) & (F.col("id") > after))
    return out if camera_id is None else out.where(F.col("camera_id") == camera_id)


def facet(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.trim(F.col(column)).alias(column)).where(F.col(column).isNotNull() & (F.col(column) != "")).distinct()


def changed_since(events: DataFrame, last_id: int, last_update: dt.datetime) -> DataFrame:
    return events.where((F.col("id") > last_id) | (F.col("created_at") > F.lit(last_update).cast("timestamp_ntz")))


def retain(events: DataFrame, feedback: DataFrame, cutoff: dt.datetime) -> DataFrame:
    """Rows newer than the cutoff, and older ones with feedback."""
    new = events.where(F.col("created_at") >= F.lit(cutoff).cast("timestamp_ntz"))
    old = events.where(F.col("created_at") < F.lit(cutoff).cast("timestamp_ntz"))
    return new.unionByName(old.join(feedback.select(F.col("event_id").alias("id")), "id", "left_semi"))


def _enriched(spark: SparkSession, d: str) -> DataFrame:
    return enrich(v.sightings(spark, d), v.watchlist(spark, d), v.cameras(spark, d))


_SEARCHED = """enriched AS (SELECT s.*, w.status AS watch_status, c.name AS camera_name, c.city AS camera_city FROM sightings s
    LEFT JOIN watchlist w ON s.plate_norm = w.plate_norm LEFT JOIN cameras c ON s.camera_id = c.id);"""
_OUT = "id, camera_id, plate_norm, camera_name, watch_status, confidence_pct"
_COLS = ["id", "camera_id", "plate_norm", "camera_name", "watch_status", "confidence_pct"]
_ALL = ("sightings", "watchlist", "cameras")
_KEY = "coalesce(nullif(plate_norm, ''), raw_guess_norm, '')"
_DAY = dt.datetime(2024, 1, 10)


@query("search_by_plate", v.sql(f"{_SEARCHED} SELECT {_OUT} FROM enriched WHERE instr({_KEY}, '13') > 0 ORDER BY created_at DESC, id DESC LIMIT 50", *_ALL))
def _(spark: SparkSession, d: str) -> DataFrame:
    return page(search(_enriched(spark, d), Filters(plate="13")), 50, 1).select(*_COLS)


@query("search_literal_percent", v.sql(f"{_SEARCHED} SELECT {_OUT} FROM enriched WHERE false", *_ALL))
def _(spark: SparkSession, d: str) -> DataFrame:
    return search(_enriched(spark, d), Filters(plate="%")).select(*_COLS)


@query("search_city_fallback", v.sql(f"{_SEARCHED} SELECT {_OUT} FROM enriched WHERE instr(coalesce(nullif(city, ''), nullif(camera_city, ''), ''), 'A') > 0", *_ALL))
def _(spark: SparkSession, d: str) -> DataFrame:
    return search(_enriched(spark, d), Filters(city="A")).select(*_COLS)


@query("search_region_digits", v.sql(f"{_SEARCHED} SELECT {_OUT} FROM enriched WHERE right(plate_norm, 2) = '24'", *_ALL))
def _(spark: SparkSession, d: str) -> DataFrame:
    return search(_enriched(spark, d), Filters(region="۲۴")).select(*_COLS)


@query("search_region_invalid", v.sql(f"{_SEARCHED} SELECT {_OUT} FROM enriched WHERE false", *_ALL))
def _(spark: SparkSession, d: str) -> DataFrame:
    return search(_enriched(spark, d), Filters(region="x1")).select(*_COLS)


@query("search_unknown_status", v.sql(f"{_SEARCHED} SELECT {_OUT} FROM enriched WHERE coalesce(watch_status, 'unknown') = 'unknown'", *_ALL))
def _(spark: SparkSession, d: str) -> DataFrame:
    return search(_enriched(spark, d), Filters(status="unknown")).select(*_COLS)


@query("search_time_range", v.sql(f"{_SEARCHED} SELECT {_OUT} FROM enriched WHERE created_at >= TIMESTAMP '2024-01-10' AND created_at < TIMESTAMP '2024-01-12' AND camera_id = 3", *_ALL))
def _(spark: SparkSession, d: str) -> DataFrame:
    return search(_enriched(spark, d), Filters(start=_DAY, end=_DAY + dt.timedelta(days=2), camera_id=3)).select(*_COLS)


@query("search_time_of_day", v.sql(f"{_SEARCHED} SELECT {_OUT} FROM enriched WHERE strftime(created_at + INTERVAL 210 MINUTE, '%H:%M:%S') >= '22:30:00' AND strftime(created_at + INTERVAL 210 MINUTE, '%H:%M:%S') < '24:00:00'", *_ALL))
def _(spark: SparkSession, d: str) -> DataFrame:
    return search(_enriched(spark, d), Filters(time_from="22:30:00", time_to="24:00:00")).select(*_COLS)


@query("page_offset", v.sql("SELECT id, camera_id FROM sightings ORDER BY created_at DESC, id DESC LIMIT 25 OFFSET 50", "sightings"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return page(v.sightings(spark, d), 7, 3).select("id", "camera_id")


@query("page_keyset", v.sql("SELECT id, camera_id FROM sightings WHERE id < 700 ORDER BY id DESC LIMIT 40", "sightings"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return keyset_page(v.sightings(spark, d), 700, 40).select("id", "camera_id")


@query("page_snapshot", v.sql("SELECT id, camera_id FROM sightings WHERE id <= 800 AND id > 200 AND camera_id = 2 ORDER BY created_at DESC, id DESC LIMIT 25", "sightings"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return page(snapshot_page(v.sightings(spark, d), 800, 200, 2), 25, 1).select("id", "camera_id")


@query("page_count", v.sql("SELECT count(*) AS total FROM sightings WHERE id <= 800 AND id > 200", "sightings"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_page(v.sightings(spark, d), 800, 200).agg(F.count("*").alias("total"))


@query("poll_changes", v.sql("SELECT count(*) AS changed, coalesce(max(id), 0) AS high_id FROM sightings WHERE id > 900 OR created_at > TIMESTAMP '2024-01-30'", "sightings"))
def _(spark: SparkSession, d: str) -> DataFrame:
    new = changed_since(v.sightings(spark, d), 900, dt.datetime(2024, 1, 30))
    return new.agg(F.count("*").alias("changed"), F.coalesce(F.max("id"), F.lit(0)).alias("high_id"))


@query("newest_100", v.sql("SELECT id FROM sightings ORDER BY id DESC LIMIT 100", "sightings"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return keyset_page(v.sightings(spark, d), None, 100).select("id")


@query("cameras_enabled_ordered", v.sql("SELECT id, name, sort_order FROM cameras WHERE enabled ORDER BY sort_order, id", "cameras"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return v.cameras(spark, d).where("enabled").orderBy("sort_order", "id").select("id", "name", "sort_order")


@query("event_detail", v.sql(f"{_SEARCHED} SELECT {_OUT} FROM enriched WHERE id = 77", *_ALL))
def _(spark: SparkSession, d: str) -> DataFrame:
    return _enriched(spark, d).where("id = 77").limit(1).select(*_COLS)


@query("plate_exists", v.sql("SELECT count(*) > 0 AS found FROM sightings WHERE plate_norm IN ('10ا10010', '11ب13717') OR raw_guess_norm IN ('10ا10010', '11ب13717')", "sightings"))
def _(spark: SparkSession, d: str) -> DataFrame:
    keys = ("10ا10010", "11ب13717")
    return v.sightings(spark, d).where(F.col("plate_norm").isin(*keys) | F.col("raw_guess_norm").isin(*keys)).limit(1).agg((F.count("*") > 0).alias("found"))


@query("audit_search", "SELECT c_custkey, c_name FROM customer WHERE (c_name ILIKE '%1_2%' OR c_mktsegment ILIKE '%build%') AND c_nationkey = 3 ORDER BY c_custkey DESC LIMIT 1000")
def _(spark: SparkSession, d: str) -> DataFrame:
    hit = F.col("c_name").ilike("%1_2%") | F.col("c_mktsegment").ilike("%build%")
    return v.table(spark, d, "customer").where(hit & (F.col("c_nationkey") == 3)).orderBy(F.desc("c_custkey")).limit(1000).select("c_custkey", "c_name")


@query(
    "dashboard_counts",
    v.sql(
        """SELECT count(*) AS total, count(*) FILTER (created_at >= TIMESTAMP '2024-01-09 20:30:00' AND created_at < TIMESTAMP '2024-01-10 20:30:00') AS today,
        count(*) FILTER (confidence_pct < 70 AND created_at >= TIMESTAMP '2024-01-09 20:30:00' AND created_at < TIMESTAMP '2024-01-10 20:30:00') AS low_today,
        count(DISTINCT nullif(plate_norm, '')) AS plates, coalesce(max(id), 0) AS high_id FROM sightings""",
        "sightings",
    ),
)
def _(spark: SparkSession, d: str) -> DataFrame:
    start, end = dates.local_day_bounds(dt.date(2024, 1, 10))
    s = v.sightings(spark, d)
    today = (F.col("created_at") >= start.cast("timestamp_ntz")) & (F.col("created_at") < end.cast("timestamp_ntz"))
    return s.agg(
        F.count("*").alias("total"),
        F.count_if(today).alias("today"),
        F.count_if(today & (F.col("confidence_pct") < 70)).alias("low_today"),
        F.countDistinct(nz(F.col("plate_norm"))).alias("plates"),
        F.coalesce(F.max("id"), F.lit(0)).alias("high_id"),
    )


@query("facet_city", v.sql("SELECT DISTINCT city FROM (SELECT trim(city) AS city FROM sightings UNION SELECT trim(city) FROM cameras) WHERE city <> '' ORDER BY 1", "sightings", "cameras"))
def _(spark: SparkSession, d: str) -> DataFrame:
    both = v.sightings(spark, d).select("city").union(v.cameras(spark, d).select("city"))
    return facet(both, "city").orderBy("city")


@query("facet_vehicle_type", v.sql("SELECT DISTINCT vehicle_type FROM sightings WHERE vehicle_type <> '' ORDER BY 1", "sightings"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return facet(v.sightings(spark, d), "vehicle_type").orderBy("vehicle_type")


@query("review_status_counts", v.sql("SELECT review_status, count(*) AS n FROM sightings GROUP BY 1", "sightings"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return v.sightings(spark, d).groupBy("review_status").agg(F.count("*").alias("n"))


@query("retention_keep", v.sql("SELECT id FROM sightings s WHERE created_at >= TIMESTAMP '2024-01-20' OR EXISTS (SELECT 1 FROM feedback f WHERE f.event_id = s.id)", "sightings", "feedback"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return retain(v.sightings(spark, d), v.feedback(spark, d), dt.datetime(2024, 1, 20)).select("id")


@query("retention_delete", v.sql("SELECT id FROM sightings s WHERE created_at < TIMESTAMP '2024-01-20' AND NOT EXISTS (SELECT 1 FROM feedback f WHERE f.event_id = s.id)", "sightings", "feedback"))
def _(spark: SparkSession, d: str) -> DataFrame:
    s = v.sightings(spark, d)
    return s.where(F.col("created_at") < F.lit(dt.datetime(2024, 1, 20)).cast("timestamp_ntz")).join(v.feedback(spark, d).select(F.col("event_id").alias("id")), "id", "left_anti").select("id")


@query(
    "backfill_city_region",
    v.sql(
        """SELECT s.id, coalesce(nullif(trim(s.city), ''), c.city, '') AS city, CASE WHEN length(s.plate_norm) = 8 AND regexp_matches(right(s.plate_norm, 2), '^[0-9][0-9]$') THEN right(s.plate_norm, 2) ELSE '' END AS plate_region
        FROM sightings s LEFT JOIN cameras c ON s.camera_id = c.id""",
        "sightings",
        "cameras",
    ),
)
def _(spark: SparkSession, d: str) -> DataFrame:
    c = v.cameras(spark, d).select(F.col("id").alias("camera_id"), F.col("city").alias("camera_city"))
    tail = F.right(F.col("plate_norm"), F.lit(2))
    region = F.when((F.length("plate_norm") == 8) & tail.rlike("^[0-9][0-9]$"), tail).otherwise("")
    return v.sightings(spark, d).join(small(c), "camera_id", "left").select("id", F.coalesce(nz(F.trim("city")), "camera_city", F.lit("")).alias("city"), region.alias("plate_region"))


@query("toggle_enabled", v.sql("SELECT id, CASE WHEN id = 5 THEN NOT enabled ELSE enabled END AS enabled, CASE WHEN id = 5 AND NOT enabled THEN 'on' WHEN id = 5 THEN 'off' ELSE 'same' END AS change FROM cameras", "cameras"))
def _(spark: SparkSession, d: str) -> DataFrame:
    this = F.col("id") == 5
    change = F.when(this & ~F.col("enabled"), "on").when(this, "off").otherwise("same")
    return v.cameras(spark, d).select("id", F.when(this, ~F.col("enabled")).otherwise(F.col("enabled")).alias("enabled"), change.alias("change"))


@query("jalali_days", v.sql("SELECT id, strftime(created_at + INTERVAL 210 MINUTE, '%Y-%m-%d') AS local_day, CAST(1402 AS INTEGER) AS year, CAST(CASE WHEN created_at + INTERVAL 210 MINUTE < TIMESTAMP '2024-01-21' THEN 10 ELSE 11 END AS INTEGER) AS month, CAST(CASE WHEN created_at + INTERVAL 210 MINUTE < TIMESTAMP '2024-01-21' THEN date_diff('day', DATE '2023-12-21', CAST(created_at + INTERVAL 210 MINUTE AS DATE)) ELSE date_diff('day', DATE '2024-01-20', CAST(created_at + INTERVAL 210 MINUTE AS DATE)) END AS INTEGER) AS day FROM sightings", "sightings"))
def _(spark: SparkSession, d: str) -> DataFrame:
    day = dates.local(F.col("created_at")).cast("date")
    j = dates.to_jalali(day)
    return v.sightings(spark, d).select("id", F.date_format(day, "yyyy-MM-dd").alias("local_day"), j["year"].alias("year"), j["month"].alias("month"), (j["day"]).alias("day"))
