"""Writes to tables of files: upserts, idempotent appends, queues, corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.numbers import backoff_seconds
from ..plans import views as v
from ..plans.registry import query

#: Fixed value: bytes of an entry's payload at most.
MAX_PAYLOAD = 1 << 20


def align(df: DataFrame, schema: StructType, defaults: dict | None = None) -> DataFrame:
    """The columns of ``schema``, in order and type: missing ones from ``defaults``
    or null, others of ``df`` dropped."""
    have, defaults = set(df.columns), defaults or {}
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(defaults.get(f.name))).cast(f.dataType).alias(f.name) for f in schema])


def upsert(target: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """The target with each key's latest change instead of its row."""
    last = changes.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_n = 1").select(*target.columns)
    return target.join(last.select(key), key, "left_anti").select(*target.columns).unionByName(last)


def insert_missing(target: DataFrame, defaults: DataFrame, key: str) -> DataFrame:
    return target.unionByName(defaults.join(target.select(key), key, "left_anti").select(*target.columns))


def append_once(target: DataFrame, rows: DataFrame, receipts: DataFrame, key: str) -> DataFrame:
    """New rows to append: those without a receipt, one for each key. Receipts
    outlive their rows, so a replay after retention brings nothing back."""
    return rows.dropDuplicates([key]).join(receipts.select(key), key, "left_anti")


def correct(feedback: DataFrame, corrections: DataFrame) -> DataFrame:
    """Feedback after corrections (event_id, corrected_norm, id) in order: repeating
    the current correction changes nothing, another one supersedes it."""
    every = feedback.select("event_id", "corrected_norm", "id").unionByName(corrections.select("event_id", "corrected_norm", "id"))
    w = Window.partitionBy("event_id").orderBy("id")
    changed = every.withColumn("_same", F.lag("corrected_norm").over(w) == F.col("corrected_norm")).where("NOT coalesce(_same, false)")
    newest = F.max("id").over(Window.partitionBy("event_id"))
    return changed.withColumn("status", F.when(F.col("id") == newest, "confirmed").otherwise("superseded")).drop("_same")


def due(queue: DataFrame, now: float, after: int, batch: int = 64) -> DataFrame:
    """The next batch of pending entries whose time has come, in order."""
    return queue.where((F.col("status") == "pending") & (F.col("seq") > after) & (F.col("next_attempt") <= now)).orderBy("seq").limit(batch)


def replay(queue: DataFrame, now: float, by: str, batch: int = 64) -> DataFrame:
    """The next batch of a durable queue, in order: pending entries whose time has come
    and that no earlier pending entry of the same ``by`` holds up, so what was queued
    first is written first however often it has failed."""
    late = F.max(F.when(F.col("next_attempt") > now, 1).otherwise(0)).over(Window.partitionBy(by).orderBy("seq"))
    return queue.where("status = 'pending'").withColumn("_late", late).where("_late = 0").drop("_late").orderBy("seq").limit(batch)


def after_attempt(entries: DataFrame, now: float, base: float = 1.0, most: float = 60.0) -> DataFrame:
    """Entries after an attempt (``ok``): done, or pending again after a pause that
    doubles with every failure."""
    attempts = F.col("attempts") + F.when(F.col("ok"), 0).otherwise(1)
    out = entries.withColumn("attempts", attempts).withColumn("status", F.when(F.col("ok"), "done").otherwise("pending"))
    return out.withColumn("next_attempt", F.when(F.col("ok"), F.col("next_attempt")).otherwise(F.lit(now) + backoff_seconds(F.col("attempts"), base, most))).drop("ok")


def verify_entries(queue: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined with reason): digest of the payload, bounds and types of the
    fields. Columns payload, payload_sha256, status, attempts, next_attempt, retry_id,
    processing_ms."""
    finite = lambda c: F.coalesce((F.abs(F.col(c)) < float("inf")) & (F.col(c) >= 0), F.lit(False))
    reason = (
        F.when(~F.coalesce(F.sha2("payload", 256) == F.lower("payload_sha256"), F.lit(False)), "payload-digest-mismatch")
        .when(~F.coalesce(F.col("status").isin("pending", "failed"), F.lit(False)), "invalid-status")
        .when((F.col("attempts") < 0) | F.col("attempts").isNull(), "invalid-attempts")
        .when(~F.coalesce(F.length(F.trim("retry_id")).between(1, 128), F.lit(False)), "invalid-retry-id")
        .when(~finite("next_attempt") | ~finite("processing_ms"), "invalid-number")
        .when(F.octet_length("payload") > MAX_PAYLOAD, "payload-too-large")
    )
    judged = queue.withColumn("reason", reason)
    return judged.where("reason IS NULL").drop("reason"), judged.where("reason IS NOT NULL")


def fold_failures(failures: DataFrame) -> DataFrame:
    """Per entry: attempts, the first failure's time, the last one's error."""
    return failures.groupBy("seq").agg(F.count("*").alias("attempts"), F.min("failed_at").alias("first_failed_at"), F.max_by("error", "failed_at").alias("last_error"))


def fold_events(changes: DataFrame) -> DataFrame:
    """The event row after its observations in arrival order (key, seq, ts, plate,
    status, plate null when unreadable): an unreadable one never takes a reading
    away, an older one never replaces a newer, and after an operator's ``confirmed``
    only another confirmation counts. Conflicting plates of an unconfirmed event
    leave it for review; ``rival`` is the plate that the last conflict put in its place."""
    zero = F.struct(F.lit(None).cast("double").alias("ts"), F.lit(None).cast("string").alias("plate"), F.lit("new").alias("status"), F.lit(False).alias("conflict"), F.lit(None).cast("string").alias("rival"))

    def step(a, x):
        sticky = (a["status"] == "confirmed") & (x["status"] != "confirmed")
        stale = x["ts"] < a["ts"]
        skip = F.coalesce(sticky | stale | (x["plate"].isNull() & a["plate"].isNotNull()), F.lit(False))
        other = F.coalesce((a["plate"] != x["plate"]) & (x["status"] != "confirmed"), F.lit(False))
        taken = F.struct(x["ts"].alias("ts"), F.coalesce(x["plate"], a["plate"]).alias("plate"), x["status"].alias("status"), (a["conflict"] | other).alias("conflict"), F.when(other, a["plate"]).otherwise(a["rival"]).alias("rival"))
        return F.when(skip, a).otherwise(taken)

    seq = F.array_sort(F.collect_list(F.struct("seq", "ts", "plate", "status")))
    return changes.groupBy("key").agg(F.aggregate(seq, zero, step).alias("s")).select("key", "s.*")


def merge_events(changes: DataFrame, receipts: DataFrame, tombstones: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, new receipts) of observations that also have a ``retry_id``. One that was
    received before, or whose event was deleted, changes nothing, however often it is
    sent again; of those that repeat an id the first in order counts. A conflict leaves
    the event and opens a row of kind ``review`` with the plate that it replaced."""
    first = changes.groupBy("retry_id").agg(F.min(F.struct("seq", *[c for c in changes.columns if c not in ("retry_id", "seq")])).alias("x")).select("retry_id", "x.*")
    fresh = first.join(receipts.select("retry_id"), "retry_id", "left_anti").join(tombstones.select("key"), "key", "left_anti")
    events = fold_events(fresh)
    rows = events.select("key", F.lit("event").alias("kind"), "plate", "status")
    return rows.unionByName(events.where("conflict").select("key", F.lit("review").alias("kind"), F.col("rival").alias("plate"), F.lit("suggested").alias("status"))), fresh.select("retry_id")


def _settings(spark: SparkSession, d: str, even: bool) -> DataFrame:
    c = v.table(spark, d, "customer").where(F.col("c_custkey") % 2 == (0 if even else 1))
    return c.select((F.col("c_custkey") % 300).alias("key"), F.col("c_name").alias("value"), F.col("c_custkey").alias("at"))


_S = "s AS (SELECT c_custkey % 300 AS key, c_name AS value, c_custkey AS ver FROM customer), t AS (SELECT key, max(ver) AS ver, arg_max(value, ver) AS value FROM s WHERE ver % 2 = 0 AND key < 200 GROUP BY 1), c AS (SELECT key, max(ver) AS ver, arg_max(value, ver) AS value FROM s WHERE key >= 100 AND ver % 3 = 0 GROUP BY 1)"


def _target(spark: SparkSession, d: str) -> DataFrame:
    return _settings(spark, d, True).where("key < 200").groupBy("key").agg(F.max_by("value", "at").alias("value"), F.max("at").alias("at"))


def _changes(spark: SparkSession, d: str) -> DataFrame:
    return _settings(spark, d, True).unionByName(_settings(spark, d, False)).where("key >= 100 AND at % 3 = 0")


@query("upsert_latest", f"WITH {_S} SELECT key, coalesce(c.value, t.value) AS value FROM t FULL JOIN c USING (key)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return upsert(_target(spark, d), _changes(spark, d), "key", "at").select("key", "value")


@query("insert_missing", f"WITH {_S} SELECT key, coalesce(t.value, c.value) AS value FROM t FULL JOIN c USING (key)")
def _(spark: SparkSession, d: str) -> DataFrame:
    t = _target(spark, d)
    last = upsert(t.limit(0), _changes(spark, d), "key", "at")
    return insert_missing(t, last, "key").select("key", "value")


@query("append_once", v.sql("SELECT DISTINCT plate_norm FROM sightings WHERE plate_norm NOT IN (SELECT plate_norm FROM watchlist)", "sightings", "watchlist"))
def _(spark: SparkSession, d: str) -> DataFrame:
    s = v.sightings(spark, d).select("plate_norm")
    return append_once(s.limit(0), s, v.watchlist(spark, d), "plate_norm")


@query("correct_feedback", v.sql("""e AS (SELECT event_id, id % 3 AS c, id FROM feedback), l AS (SELECT *, lag(c) OVER (PARTITION BY event_id ORDER BY id) = c AS same FROM e), k AS (SELECT * FROM l WHERE NOT coalesce(same, false));
    SELECT event_id, CAST(c AS VARCHAR) AS corrected_norm, id, CASE WHEN id = max(id) OVER (PARTITION BY event_id) THEN 'confirmed' ELSE 'superseded' END AS status FROM k""", "feedback"))
def _(spark: SparkSession, d: str) -> DataFrame:
    f = v.feedback(spark, d).select("event_id", (F.col("id") % 3).cast("string").alias("corrected_norm"), "id")
    return correct(f.where("id % 2 = 0"), f.where("id % 2 = 1"))


def _queue(spark: SparkSession, d: str) -> DataFrame:
    o = v.table(spark, d, "orders")
    digest = F.when(F.col("o_orderkey") % 40 == 0, F.lit("0" * 64)).otherwise(F.sha2(F.col("o_orderpriority"), 256))
    return o.select(F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("failed").alias("status"), (F.col("o_custkey") % 100).cast("double").alias("next_attempt"), (F.col("o_custkey") % 5 - F.when(F.col("o_orderkey") % 50 == 1, 9).otherwise(0)).alias("attempts"), F.col("o_orderpriority").alias("payload"), digest.alias("payload_sha256"), F.when(F.col("o_orderkey") % 35 == 2, " ").otherwise(F.concat(F.lit("r"), "o_orderkey")).alias("retry_id"), F.when(F.col("o_orderkey") % 33 == 3, float("nan")).otherwise(1.0).alias("processing_ms"))


@query("due_queue", "SELECT o_orderkey AS seq, (o_custkey % 100)::DOUBLE AS next_attempt FROM orders WHERE o_orderstatus = 'O' AND o_orderkey > 100 AND o_custkey % 100 <= 50 ORDER BY 1 LIMIT 64")
def _(spark: SparkSession, d: str) -> DataFrame:
    return due(_queue(spark, d), 50.0, 100).select("seq", "next_attempt")


@query("quarantine", "WITH x AS (SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 40 = 0 THEN 'payload-digest-mismatch' WHEN o_orderkey % 50 = 1 THEN 'invalid-attempts' WHEN o_orderkey % 35 = 2 THEN 'invalid-retry-id' WHEN o_orderkey % 33 = 3 THEN 'invalid-number' END AS reason FROM orders) SELECT seq, reason FROM x WHERE reason IS NOT NULL")
def _(spark: SparkSession, d: str) -> DataFrame:
    return verify_entries(_queue(spark, d))[1].select("seq", "reason")


@query("failure_bookkeeping", "SELECT l_orderkey AS seq, count(*) AS attempts, min(l_linenumber * 1000 + l_partkey) AS first_failed_at, arg_max(l_returnflag, l_linenumber * 1000 + l_partkey) AS last_error FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber * 1000 + l_partkey) * FROM lineitem ORDER BY l_orderkey, l_linenumber * 1000 + l_partkey, l_returnflag) GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("l_linenumber") * 1000 + F.col("l_partkey")
    f = v.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("seq"), at.alias("failed_at")).agg(F.min("l_returnflag").alias("error"))
    return fold_failures(f)


def _fold_sql(where: str) -> str:
    return "WITH RECURSIVE " + v.sql("SELECT 1", "observations")[len("WITH ") : -len(" SELECT 1")] + f""", x0 AS (SELECT track_id AS key, track_id * 10 + seq AS retry_id, seq, part, (seq - part % 3)::DOUBLE AS ts, CASE WHEN part % 7 <> 0 THEN text END AS plate, CASE WHEN part % 23 = 0 THEN 'confirmed' ELSE 'suggested' END AS status FROM observations),
    x AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq, part, ts, plate NULLS FIRST, status) AS i FROM {where}),
    f AS (SELECT key, 0::BIGINT AS i, NULL::DOUBLE AS ts, NULL::VARCHAR AS plate, 'new' AS status, false AS conflict, NULL::VARCHAR AS rival FROM x WHERE i = 1
    UNION ALL SELECT key, i, CASE WHEN skip THEN ats ELSE ts END, CASE WHEN skip THEN aplate ELSE coalesce(plate, aplate) END, CASE WHEN skip THEN astatus ELSE status END, CASE WHEN skip THEN aconflict ELSE aconflict OR other END, CASE WHEN NOT skip AND other THEN aplate ELSE arival END
      FROM (SELECT x.key, x.i, x.ts, x.plate, x.status, f.ts AS ats, f.plate AS aplate, f.status AS astatus, f.conflict AS aconflict, f.rival AS arival, coalesce(f.plate <> x.plate AND x.status <> 'confirmed', false) AS other, coalesce(f.status = 'confirmed' AND x.status <> 'confirmed', false) OR coalesce(x.ts < f.ts, false) OR (x.plate IS NULL AND f.plate IS NOT NULL) AS skip FROM f JOIN x ON x.key = f.key AND x.i = f.i + 1)),
    e AS (SELECT key, arg_max(ts, i) AS ts, last(plate ORDER BY i) AS plate, arg_max(status, i) AS status, arg_max(conflict, i) AS conflict, last(rival ORDER BY i) AS rival FROM f GROUP BY 1)"""


def _observed(spark: SparkSession, d: str) -> DataFrame:
    o = v.observations(spark, d)
    plate = F.when(F.col("part") % 7 != 0, F.col("text"))
    status = F.when(F.col("part") % 23 == 0, "confirmed").otherwise("suggested")
    return o.select((F.col("track_id") * 10 + F.col("seq")).alias("retry_id"), F.col("track_id").alias("key"), F.struct("seq", "part").alias("seq"), (F.col("seq") - F.col("part") % 3).cast("double").alias("ts"), plate.alias("plate"), status.alias("status"))


@query("fold_events", _fold_sql("x0") + " SELECT * FROM e")
def _(spark: SparkSession, d: str) -> DataFrame:
    return fold_events(_observed(spark, d))


@query("merged_events", _fold_sql("(SELECT * FROM x0 WHERE retry_id % 9 <> 0 AND key % 50 <> 3 QUALIFY row_number() OVER (PARTITION BY retry_id ORDER BY seq, part, ts, plate NULLS FIRST, status) = 1)") + " SELECT key, 'event' AS kind, plate, status FROM e UNION ALL SELECT key, 'review', rival, 'suggested' FROM e WHERE conflict")
def _(spark: SparkSession, d: str) -> DataFrame:
    o = _observed(spark, d)
    return merge_events(o, o.select("retry_id").where("retry_id % 9 = 0").distinct(), o.select("key").where("key % 50 = 3").distinct())[0]


@query("ordered_replay", """WITH q AS (SELECT o_orderkey AS seq, o_custkey % 40 AS camera, (o_custkey % 100)::DOUBLE AS next, o_orderkey % 7 AS attempts FROM orders WHERE o_orderstatus = 'O'), l AS (SELECT *, max((next > 85)::INT) OVER (PARTITION BY camera ORDER BY seq) AS late FROM q), b AS (SELECT * FROM l WHERE late = 0 ORDER BY seq LIMIT 200)
    SELECT seq, CASE WHEN seq % 3 = 0 THEN 'done' ELSE 'pending' END AS status, CASE WHEN seq % 3 = 0 THEN attempts ELSE attempts + 1 END AS attempts, CASE WHEN seq % 3 = 0 THEN next ELSE 85 + least(60, pow(2, attempts)) END AS next_attempt FROM b""")
def _(spark: SparkSession, d: str) -> DataFrame:
    o = v.table(spark, d, "orders")
    q = o.select(F.col("o_orderkey").alias("seq"), (F.col("o_custkey") % 40).alias("camera"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("done").alias("status"), (F.col("o_custkey") % 100).cast("double").alias("next_attempt"), (F.col("o_orderkey") % 7).alias("attempts"))
    tried = replay(q, 85.0, "camera", 200).withColumn("ok", F.col("seq") % 3 == 0)
    return after_attempt(tried, 85.0).select("seq", "status", "attempts", "next_attempt")
