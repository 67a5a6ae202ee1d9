"""Domain views over the driver's tables.

Every column is arithmetic that Spark and other SQL engines evaluate alike; each
view has its SQL beside it, to be put before a query by ``sql``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.plates import LETTERS


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def plate_of(k: Column) -> Column:
    """The valid plate numbered k."""
    letter = F.substring(F.lit(LETTERS), (k % 24 + 1).cast("int"), F.lit(1))
    return F.concat((10 + k % 90).cast("string"), letter, (100 + (k * 37) % 900).cast("string"), (10 + (k * 7) % 90).cast("string"))


def plate_sql(k: str) -> str:
    return f"(CAST(10 + {k} % 90 AS VARCHAR) || substr('{LETTERS}', CAST({k} % 24 AS INTEGER) + 1, 1) || CAST(100 + ({k} * 37) % 900 AS VARCHAR) || CAST(10 + ({k} * 7) % 90 AS VARCHAR))"


def micros(ts: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts)


def sightings(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    k = F.regexp_extract("props", r'"k": *(\d+)', 1).cast("int")
    e = e.withColumn("k", k).withColumn("plate", plate_of(F.col("k")))
    blank = F.col("event_id") % 11 == 0
    return e.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("camera_id"),
        F.col("ts").alias("created_at"),
        (micros(F.col("ts")) / 1e6).alias("t"),
        F.col("event_type").alias("vehicle_type"),
        "k",
        F.when(blank, "").otherwise(F.col("plate")).alias("plate_norm"),
        F.when(blank, F.col("plate")).otherwise("").alias("raw_guess_norm"),
        F.col("plate"),
        (F.col("event_id") * 37 % 100).cast("int").alias("confidence_pct"),
        (F.col("event_id") * 37 % 100 / 100).alias("confidence"),
        F.when(F.col("event_id") % 5 == 0, "").otherwise(F.concat(F.lit("city"), F.col("event_id") % 7)).alias("city"),
        F.element_at(F.array(*map(F.lit, ("confirmed-ai", "auto-confirmed", "suggested", "unreadable"))), (F.col("event_id") % 4 + 1).cast("int")).alias("review_status"),
        "value",
    )


def cameras(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.col("n_name").alias("city"),
        (F.col("c_custkey") % 5 != 0).alias("enabled"),
        (F.col("c_custkey") * 7 % 13).cast("int").alias("sort_order"),
        (F.col("c_custkey") % 4 * 15.0).alias("duplicate_seconds"),
    )


def watchlist(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").withColumn("k", F.col("c_custkey") % 100)
    status = F.when(F.col("c_mktsegment") == "BUILDING", "blocked").when(F.col("c_mktsegment") == "MACHINERY", "wanted").otherwise("allowed")
    one = c.where("k % 3 <> 0").groupBy("k").agg(F.min("c_custkey").alias("id"), F.min_by(status, "c_custkey").alias("status"))
    return one.select("id", plate_of(F.col("k")).alias("plate_norm"), "status")


def feedback(spark: SparkSession, d: str) -> DataFrame:
    s = sightings(spark, d).where("vehicle_type = 'error'")
    right = F.when(F.col("id") % 3 == 0, plate_of(F.col("k") + 1)).otherwise(plate_of(F.col("k")))
    revision = F.when(F.col("id") % 4 == 3, "").otherwise(F.concat(F.lit("r"), F.col("id") % 4))
    engine = F.when(F.col("id") % 8 == 7, "").otherwise(F.concat(F.lit("e"), F.col("id") % 2))
    return s.select("id", F.col("camera_id").alias("event_id"), F.col("plate_norm").alias("observed_norm"), right.alias("corrected_norm"), revision.alias("observed_model_revision"), engine.alias("observed_engine"))


def passages(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    k = F.col("o_orderkey") % 100
    readable = F.col("o_orderkey") % 3 != 0
    slices = F.array(F.when(F.col("o_orderkey") % 2 == 0, "day").otherwise("night"), F.concat(F.lit("w"), F.col("o_orderkey") % 4))
    events = F.when(F.col("o_orderkey") % 17 == 0, F.array().cast("array<string>")).when(F.col("o_orderkey") % 13 == 0, F.array(plate_of(k + 1))).when(F.col("o_orderkey") % 19 == 0, F.array(plate_of(k), plate_of(k + 2)))
    events = events.otherwise(F.when(readable | (F.col("o_orderkey") % 29 == 0), F.array(plate_of(k))).otherwise(F.array().cast("array<string>")))
    return o.select(
        F.col("o_orderkey").cast("string").alias("passage_id"),
        "o_orderkey",
        F.sha2(F.col("o_orderkey").cast("string"), 256).alias("evidence_digest"),
        F.concat(F.lit("c"), F.col("o_custkey") % 5).alias("camera_id"),
        F.concat(F.lit("s"), F.month("o_orderdate")).alias("session_id"),
        slices.alias("slices"),
        F.when(readable, plate_of(k)).otherwise("").alias("expected_plate"),
        readable.alias("readable"),
        events.alias("accepted_events"),
    )


def observations(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    k = (F.col("l_orderkey") % 100).cast("int")
    k = F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 5 == 0, k + 1).otherwise(k)
    return li.select(
        F.col("l_orderkey").alias("track_id"),
        F.col("l_linenumber").alias("seq"),
        F.col("l_partkey").alias("part"),
        plate_of(k).alias("text"),
        (100 - F.round(F.col("l_discount") * 100).cast("int") * 3).alias("confidence_pct"),
        (60 + F.round(F.col("l_tax") * 100).cast("int") * 4).alias("quality_pct"),
    )


#: The same in SQL.
VIEWS: dict[str, str] = {
    "sightings": f"""SELECT event_id AS id, user_id AS camera_id, ts AS created_at, epoch_us(ts) / 1e6 AS t, event_type AS vehicle_type, k,
        CASE WHEN event_id % 11 = 0 THEN '' ELSE plate END AS plate_norm, CASE WHEN event_id % 11 = 0 THEN plate ELSE '' END AS raw_guess_norm, plate,
        CAST(event_id * 37 % 100 AS INTEGER) AS confidence_pct, (event_id * 37 % 100) / 100 AS confidence,
        CASE WHEN event_id % 5 = 0 THEN '' ELSE 'city' || (event_id % 7) END AS city,
        (['confirmed-ai', 'auto-confirmed', 'suggested', 'unreadable'])[event_id % 4 + 1] AS review_status, value
        FROM (SELECT *, {plate_sql("k")} AS plate FROM (SELECT *, CAST(regexp_extract(props, '"k": *(\\d+)', 1) AS INTEGER) AS k FROM events))""",
    "cameras": """SELECT c_custkey AS id, c_name AS name, n_name AS city, c_custkey % 5 <> 0 AS enabled, CAST(c_custkey * 7 % 13 AS INTEGER) AS sort_order,
        c_custkey % 4 * 15.0 AS duplicate_seconds FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "watchlist": f"""SELECT id, {plate_sql("k")} AS plate_norm, status FROM (SELECT c_custkey % 100 AS k, min(c_custkey) AS id,
        arg_min(CASE c_mktsegment WHEN 'BUILDING' THEN 'blocked' WHEN 'MACHINERY' THEN 'wanted' ELSE 'allowed' END, c_custkey) AS status
        FROM customer WHERE c_custkey % 100 % 3 <> 0 GROUP BY 1)""",
    "feedback": f"""SELECT id, camera_id AS event_id, plate_norm AS observed_norm, CASE WHEN id % 3 = 0 THEN {plate_sql("(k + 1)")} ELSE {plate_sql("k")} END AS corrected_norm,
        CASE WHEN id % 4 = 3 THEN '' ELSE 'r' || (id % 4) END AS observed_model_revision, CASE WHEN id % 8 = 7 THEN '' ELSE 'e' || (id % 2) END AS observed_engine
        FROM sightings WHERE vehicle_type = 'error'""",
    "passages": f"""SELECT CAST(o_orderkey AS VARCHAR) AS passage_id, o_orderkey, sha256(CAST(o_orderkey AS VARCHAR)) AS evidence_digest, 'c' || (o_custkey % 5) AS camera_id,
        's' || month(o_orderdate) AS session_id, [CASE WHEN o_orderkey % 2 = 0 THEN 'day' ELSE 'night' END, 'w' || (o_orderkey % 4)] AS slices,
        CASE WHEN o_orderkey % 3 <> 0 THEN {plate_sql("(o_orderkey % 100)")} ELSE '' END AS expected_plate, o_orderkey % 3 <> 0 AS readable,
        CASE WHEN o_orderkey % 17 = 0 THEN CAST([] AS VARCHAR[]) WHEN o_orderkey % 13 = 0 THEN [{plate_sql("(o_orderkey % 100 + 1)")}]
             WHEN o_orderkey % 19 = 0 THEN [{plate_sql("(o_orderkey % 100)")}, {plate_sql("(o_orderkey % 100 + 2)")}]
             WHEN o_orderkey % 3 <> 0 OR o_orderkey % 29 = 0 THEN [{plate_sql("(o_orderkey % 100)")}] ELSE CAST([] AS VARCHAR[]) END AS accepted_events
        FROM orders""",
    "observations": f"""SELECT l_orderkey AS track_id, l_linenumber AS seq, l_partkey AS part, {plate_sql("k")} AS text,
        100 - CAST(round(l_discount * 100) AS INTEGER) * 3 AS confidence_pct, 60 + CAST(round(l_tax * 100) AS INTEGER) * 4 AS quality_pct
        FROM (SELECT *, CAST(CASE WHEN (l_orderkey + l_linenumber) % 5 = 0 THEN l_orderkey % 100 + 1 ELSE l_orderkey % 100 END AS INTEGER) AS k FROM lineitem)""",
}
_NEEDS = {"feedback": ["sightings"]}


def sql(body: str, *views: str) -> str:
    """``body`` after the definitions of ``views``; it may begin with further
    ``name AS (...)`` definitions and a semicolon before its SELECT."""
    names: list[str] = []
    for v in views:
        names += [n for n in (*_NEEDS.get(v, []), v) if n not in names]
    more, _, select = body.rpartition(";")
    parts = [f"{n} AS ({VIEWS[n]})" for n in names] + ([more] if more.strip() else [])
    return f"WITH {', '.join(parts)} {select}" if parts else select
