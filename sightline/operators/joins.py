"""Joins by time, interval, place and report key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry
from ..plans import views as v
from ..plans.registry import query


def asof_lookback(left: DataFrame, right: DataFrame, by: list[str], window: Column, ahead: float = 2.0, least: float = 2.0) -> DataFrame:
    """Each left row (id, t) with the latest right row (id, t) of the same keys in
    [t - max(window, least), t + ahead]; ties go to the larger id, and a row never
    finds itself. Bins as wide as the largest window turn the range into an
    equality, so a key with many rows is spread over its bins."""
    left = left.withColumn("_w", F.greatest(window, F.lit(least)))
    widest = max(least, left.agg(F.max("_w")).collect()[0][0] or 0.0, ahead)
    bins = left.withColumn("_bin", F.explode(F.array(*[(F.floor(F.col("t") / widest) + k).cast("long") for k in (-1, 0, 1)])))
    r = right.select(*by, F.col("id").alias("found_id"), F.col("t").alias("found_t"), F.floor(F.col("t") / widest).cast("long").alias("_bin"))
    near = (F.col("found_t") >= F.col("t") - F.col("_w")) & (F.col("found_t") <= F.col("t") + ahead) & (F.col("found_id") != F.col("id"))
    best = bins.join(r, [*by, "_bin"]).where(near).groupBy("id").agg(F.max_by(F.struct("found_id", "found_t"), F.struct("found_t", "found_id")).alias("_f"))
    return left.drop("_w").join(best, "id", "left").select(left.columns[:-1] + [F.col("_f.found_id"), F.col("_f.found_t")])


def eligible(expected: DataFrame, predicted: DataFrame, by: list[str]) -> DataFrame:
    """Pairs of one sample whose track ids agree, where one is asked for, and whose
    time lies in the window, both ends included; a window without ends takes all."""
    j = expected.alias("e").join(predicted.alias("p"), by)
    track = F.col("e.track_id").isNull() | F.coalesce(F.col("p.track_id") == F.col("e.track_id"), F.lit(False))
    free = F.col("e.start_ms").isNull() & F.col("e.end_ms").isNull()
    inside = F.coalesce(F.col("p.ts_ms") >= F.coalesce("e.start_ms", F.col("p.ts_ms")), F.lit(False)) & F.coalesce(F.col("p.ts_ms") <= F.coalesce("e.end_ms", F.col("p.ts_ms")), F.lit(False))
    return j.where(track & (free | inside))


def contained(regions: DataFrame, chars: DataFrame, by: list[str]) -> DataFrame:
    """Each region with the text of the characters whose centre lies in it, by x."""
    j = regions.join(chars, by, "left").withColumn("_in", geometry.contains_centre(F.col("region"), F.col("char")))
    found = F.sort_array(F.collect_list(F.when(F.col("_in"), F.struct(F.col("char")["x1"].alias("x"), F.col("glyph").alias("glyph")))))
    return j.groupBy(*by, "region_id").agg(F.array_join(F.transform(found, lambda c: c["glyph"]), "").alias("text"))


def best_overlap(first: DataFrame, second: DataFrame, by: list[str], least: float = 0.28) -> DataFrame:
    """Each row of ``second`` with its best overlapping row of ``first``, if any."""
    o = geometry.iou(F.col("box_1"), F.col("box_2"))
    j = second.join(first, by).withColumn("overlap", o).where(F.col("overlap") >= least)
    w = Window.partitionBy(*by, "id_2").orderBy(F.desc("overlap"), "id_1")
    return j.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*by, "id_2", "id_1", "overlap")


def compare_reports(baseline: DataFrame, current: DataFrame, keys: list[str], metrics: dict[str, tuple[float, float, int]]) -> DataFrame:
    """Rows of both reports with their regressions. ``metrics``: name to (relative
    tolerance, absolute tolerance, 1 if larger is worse, -1 if smaller is); a value
    on one side only is a regression."""
    b = baseline.select(*keys, *[F.col(m).alias(f"b_{m}") for m in metrics])
    j = b.join(current.select(*keys, *metrics), keys, "full")
    worse = []
    for m, (relative, absolute, sign) in metrics.items():
        x, y = F.col(m), F.col(f"b_{m}")
        bad = F.when(x.isNull() | y.isNull(), x.isNull() != y.isNull()).otherwise(sign * (x - y) > F.greatest(F.abs(y) * relative, F.lit(absolute)))
        worse.append(F.when(bad, F.lit(m)))
    return j.withColumn("regressions", F.array_join(F.array_compact(F.array(*worse)), ","))


def grid(parameters: dict[str, list], most: int = 50_000, valid=None) -> list[dict]:
    """All combinations of distinct parameter values, in order, without those that
    ``valid`` (a combination to a boolean) rules out; refuses more than ``most`` before
    that. The grid is a parameter list, not data."""
    out: list[dict] = [{}]
    for name, values in parameters.items():
        out = [o | {name: x} for o in out for x in dict.fromkeys(values)]
        if len(out) > most:
            raise ValueError(f"more than {most} combinations")
    return [o for o in out if valid is None or valid(o)]


_ASOF = """c AS (SELECT s.id, s.t, s.camera_id, s.plate, greatest(coalesce(c.duplicate_seconds, 0), 2) * 600 AS w FROM sightings s LEFT JOIN cameras c ON c.id = s.camera_id),
    m AS (SELECT c.id, max(row(r.t, r.id)) AS f FROM c JOIN sightings r ON r.camera_id = c.camera_id AND r.plate = c.plate AND r.t >= c.t - c.w AND r.t <= c.t + 2 AND r.id <> c.id GROUP BY 1);
    SELECT c.id, f[2] AS found_id FROM c LEFT JOIN m ON m.id = c.id"""


@query("asof_lookback", v.sql(_ASOF, "sightings", "cameras"))
def _(spark: SparkSession, d: str) -> DataFrame:
    s = v.sightings(spark, d).select("id", "t", "camera_id", "plate")
    c = v.cameras(spark, d).select(F.col("id").alias("camera_id"), "duplicate_seconds")
    left = s.join(c, "camera_id", "left").withColumn("w", F.greatest(F.coalesce("duplicate_seconds", F.lit(0.0)), F.lit(2.0)) * 600)
    return asof_lookback(left, s, ["camera_id", "plate"], F.col("w")).select("id", "found_id")


def expected_events(spark: SparkSession, d: str) -> DataFrame:
    o = v.table(spark, d, "orders")
    day = F.floor(v.micros(F.col("o_orderdate")) / 86_400_000_000)
    k = F.col("o_orderkey")
    return o.select(
        F.floor(k / 64).alias("sample"),
        k.alias("e"),
        F.when(k % 3 == 0, F.col("o_custkey") % 7).alias("track_id"),
        F.when(k % 5 != 0, day).alias("start_ms"),
        F.when(k % 5 != 0, day + 40).alias("end_ms"),
    )


def predicted_events(spark: SparkSession, d: str) -> DataFrame:
    li = v.table(spark, d, "lineitem")
    day = F.floor(v.micros(F.col("l_shipdate")) / 86_400_000_000)
    return li.where("l_linenumber = 1 and l_orderkey % 4 = 0").select(F.floor(F.col("l_orderkey") / 64).alias("sample"), F.col("l_orderkey").alias("p"), F.when(F.col("l_partkey") % 4 != 0, F.col("l_suppkey") % 7).alias("track_id"), day.alias("ts_ms"))


EVENTS_SQL = """ex AS (SELECT o_orderkey // 64 AS sample, o_orderkey AS e, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 7 END AS track_id, CASE WHEN o_orderkey % 5 <> 0 THEN epoch_us(o_orderdate) // 86400000000 END AS start_ms,
    CASE WHEN o_orderkey % 5 <> 0 THEN epoch_us(o_orderdate) // 86400000000 + 40 END AS end_ms FROM orders),
    pr AS (SELECT l_orderkey // 64 AS sample, l_orderkey AS p, CASE WHEN l_partkey % 4 <> 0 THEN l_suppkey % 7 END AS track_id, epoch_us(l_shipdate) // 86400000000 AS ts_ms FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 4 = 0),
    el AS (SELECT sample, e, p FROM ex JOIN pr USING (sample) WHERE (ex.track_id IS NULL OR coalesce(pr.track_id = ex.track_id, false)) AND ((start_ms IS NULL AND end_ms IS NULL) OR (ts_ms >= start_ms AND ts_ms <= end_ms)))"""


@query("eligible_pairs", v.sql(f"{EVENTS_SQL}; SELECT sample, e, p FROM el"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return eligible(expected_events(spark, d), predicted_events(spark, d), ["sample"]).select("sample", "e", "p")


def _boxes(spark: SparkSession, d: str, n: int) -> DataFrame:
    li = v.table(spark, d, "lineitem").where(F.col("l_linenumber") % 2 == n - 1)
    x, y = F.col("l_partkey") % 50, F.col("l_suppkey") % 10
    box = F.struct(x.cast("double").alias("x1"), y.cast("double").alias("y1"), (x + 20.0).alias("x2"), (y + 10.0).alias("y2"))
    return li.select(F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias(f"id_{n}"), box.alias(f"box_{n}"))


_BOX_SQL = """a AS (SELECT l_orderkey AS frame, l_linenumber AS id, (l_partkey % 50)::DOUBLE AS x, (l_suppkey % 10)::DOUBLE AS y FROM lineitem),
    o AS (SELECT p.frame, s.id AS id_2, p.id AS id_1, greatest(0, least(p.x, s.x) + 20 - greatest(p.x, s.x)) * greatest(0, least(p.y, s.y) + 10 - greatest(p.y, s.y)) AS i FROM a p JOIN a s ON p.frame = s.frame AND p.id % 2 = 0 AND s.id % 2 = 1),
    u AS (SELECT frame, id_2, id_1, i / (400 - i) AS overlap FROM o)"""


@query("best_overlap", v.sql(f"{_BOX_SQL}; SELECT frame, id_2, id_1, overlap FROM u WHERE overlap >= 0.28 QUALIFY row_number() OVER (PARTITION BY frame, id_2 ORDER BY overlap DESC, id_1) = 1"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return best_overlap(_boxes(spark, d, 1), _boxes(spark, d, 2), ["frame"])


@query("contained_characters", v.sql("""r AS (SELECT o_orderkey AS frame, o_orderkey AS region_id, (o_custkey % 30)::DOUBLE AS x FROM orders), c AS (SELECT l_orderkey AS frame, (l_partkey % 50)::DOUBLE AS x, CAST(l_linenumber AS VARCHAR) AS glyph FROM lineitem);
    SELECT r.frame, region_id, coalesce(string_agg(CASE WHEN c.x + 10 BETWEEN r.x AND r.x + 30 THEN glyph END, '' ORDER BY c.x, glyph), '') AS text FROM r LEFT JOIN c ON c.frame = r.frame GROUP BY ALL"""))
def _(spark: SparkSession, d: str) -> DataFrame:
    x = (F.col("o_custkey") % 30).cast("double")
    box = lambda a: F.struct(a.alias("x1"), F.lit(0.0).alias("y1"), a.alias("x2"), F.lit(10.0).alias("y2"))
    region = F.struct(x.alias("x1"), F.lit(0.0).alias("y1"), (x + 30).alias("x2"), F.lit(10.0).alias("y2"))
    r = v.table(spark, d, "orders").select(F.col("o_orderkey").alias("frame"), F.col("o_orderkey").alias("region_id"), region.alias("region"))
    cx = (F.col("l_partkey") % 50).cast("double") + 10
    c = v.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("frame"), box(cx).alias("char"), F.col("l_linenumber").cast("string").alias("glyph"))
    return contained(r, c, ["frame"])


@query("capacity_regressions", v.sql("""b AS (SELECT l_linenumber AS cameras, l_returnflag AS category, sum(CAST(l_quantity AS BIGINT)) AS fps, count(*) AS drops FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY ALL HAVING l_linenumber < 7),
    c AS (SELECT l_linenumber AS cameras, l_returnflag AS category, sum(CAST(l_quantity AS BIGINT)) AS fps, count(*) AS drops FROM lineitem WHERE l_orderkey % 2 = 1 GROUP BY ALL HAVING l_linenumber > 1);
    SELECT cameras, category, concat_ws(',', CASE WHEN b.fps IS NULL OR c.fps IS NULL OR b.fps - c.fps > b.fps * 0.01 THEN 'fps' END, CASE WHEN b.drops IS NULL OR c.drops IS NULL OR c.drops - b.drops > greatest(b.drops * 0.01, 5) THEN 'drops' END) AS regressions
    FROM b FULL JOIN c USING (cameras, category)"""))
def _(spark: SparkSession, d: str) -> DataFrame:
    li = v.table(spark, d, "lineitem").withColumnsRenamed({"l_linenumber": "cameras", "l_returnflag": "category"})
    report = lambda x: x.groupBy("cameras", "category").agg(F.sum(F.col("l_quantity").cast("long")).alias("fps"), F.count("*").alias("drops"))
    b, c = report(li.where("l_orderkey % 2 = 0 and cameras < 7")), report(li.where("l_orderkey % 2 = 1 and cameras > 1"))
    return compare_reports(b, c, ["cameras", "category"], {"fps": (0.01, 0.0, -1), "drops": (0.01, 5.0, 1)}).select("cameras", "category", "regressions")
