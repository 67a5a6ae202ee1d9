"""Dataset curation: duplicates, leakage-safe splits, consistency, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numbers, plates
from ..plans import views as v
from ..plans.registry import query


def first_per(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")


def supersede(feedback: DataFrame) -> DataFrame:
    """``current``: whether the row is the newest one of its event."""
    newest = F.max("id").over(Window.partitionBy("event_id"))
    return feedback.withColumn("current", F.col("event_id").isNull() | (F.col("id") == newest))


def suppress_repeats(events: DataFrame, same: float = 20.0, cross: float = 1.5) -> DataFrame:
    """``decision`` of every event in time order. Every event refreshes what was
    seen last, so each is compared with the one before: of its camera and plate,
    then of its plate at another camera. Empty plates are never repeats."""
    some = events.where("plate <> ''")  # the empty ones, however many, go into no window
    w = Window.partitionBy("camera_id", "plate").orderBy("t", "id")
    g = Window.partitionBy("plate").orderBy("t", "id")
    near = F.col("t") - F.lag("t").over(w) <= same
    far = (F.col("t") - F.lag("t").over(g) <= cross) & (F.lag("camera_id").over(g) != F.col("camera_id"))
    decision = F.when(F.lit(same > 0) & near, "same_camera_window").when(F.lit(cross > 0) & far, "overlapping_camera_window").otherwise("new")
    return some.withColumn("decision", decision).unionByName(events.where("plate = ''").withColumn("decision", F.lit("empty")))


def split_dedup(rows: DataFrame, splits: list[str]) -> tuple[DataFrame, DataFrame]:
    """(kept, excluded with reason). Splits are taken in order; a row goes if an
    earlier split kept its digest or identity, or its own split its digest; only
    kept rows claim anything, so each split is two anti-joins with those before."""
    kept, out = None, []
    for name in splits:
        own = rows.where(F.col("split") == name)
        n = F.row_number().over(Window.partitionBy("digest").orderBy("id"))
        reason = F.when(F.col("_d"), "digest-in-earlier-split").when(F.col("_i"), "identity-in-earlier-split").when(F.col("_n") > 1, "digest-repeated")
        if kept is not None:
            own = own.join(kept.select("digest", F.lit(True).alias("_d")).distinct(), "digest", "left").join(kept.select("identity", F.lit(True).alias("_i")).distinct(), "identity", "left")
        else:
            own = own.withColumn("_d", F.lit(None).cast("boolean")).withColumn("_i", F.lit(None).cast("boolean"))
        own = own.withColumn("_free", F.col("_d").isNull() & F.col("_i").isNull())
        first = own.where("_free").withColumn("_n", n)
        judged = first.unionByName(own.where("NOT _free").withColumn("_n", F.lit(1))).withColumn("reason", reason).select(*rows.columns, "reason")
        out.append(judged.where("reason IS NOT NULL"))
        good = judged.where("reason IS NULL").drop("reason")
        kept = good if kept is None else kept.unionByName(good)
    excluded = out[0]
    for x in out[1:]:
        excluded = excluded.unionByName(x)
    return kept, excluded


def group_split(groups: list[str], ratio: float, seed: int) -> set[str]:
    """Groups of the validation side: sorted, shuffled by the seed, at least one on
    either side. For a bounded list; split large sets by numbers.is_validation."""
    import random

    keys = sorted(set(groups))
    random.Random(seed).shuffle(keys)
    return set(keys[: max(1, min(len(keys) - 1, round(len(keys) * ratio)))]) if len(keys) > 1 else set()


def conflicting(rows: DataFrame, key: str, label: str) -> DataFrame:
    """Keys with more than one label; all their rows are to be set aside."""
    return rows.groupBy(key).agg(F.countDistinct(label).alias("labels")).where("labels > 1")


def overlap(rows: DataFrame, identity: str) -> DataFrame:
    """Identities shared by each pair of splits."""
    each = rows.select("split", identity).distinct()
    a, b = each.withColumnRenamed("split", "split_1"), each.withColumnRenamed("split", "split_2")
    return a.join(b, identity).where("split_1 < split_2").groupBy("split_1", "split_2").agg(F.count("*").alias("shared"))


def coverage(rows: DataFrame, column: str, required: list[str]) -> DataFrame:
    """Counts of the required categories, zero where none occurs."""
    spark = rows.sparkSession
    want = spark.createDataFrame([(x,) for x in required], f"{column} string")
    return F.broadcast(want).join(rows.groupBy(column).agg(F.count("*").alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def dense_ids(rows: DataFrame, by: str, order: str) -> DataFrame:
    """Ids from 1 within ``by`` in the order of a digest."""
    return rows.withColumn("dense_id", F.row_number().over(Window.partitionBy(by).orderBy(order)))


def samples(spark: SparkSession, d: str) -> DataFrame:
    docs = v.table(spark, d, "documents")
    split = F.when(F.col("doc_id") % 10 < 6, "test").when(F.col("doc_id") % 10 < 8, "validation").otherwise("train")
    return docs.select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("digest"), F.substring(F.sha2("text", 256), 1, 2).alias("identity"), split.alias("split"), "source", "lang")


_SAMPLES = "x AS (SELECT doc_id AS id, sha256(text) AS digest, substr(sha256(text), 1, 2) AS identity, CASE WHEN doc_id % 10 < 6 THEN 'test' WHEN doc_id % 10 < 8 THEN 'validation' ELSE 'train' END AS split, source, lang FROM documents)"
_SPLIT = f"""WITH {_SAMPLES}, k1 AS (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY id) AS n FROM x WHERE split = 'test'), a1 AS (SELECT * FROM k1 WHERE n = 1),
    k2 AS (SELECT *, digest IN (SELECT digest FROM a1) AS d, identity IN (SELECT identity FROM a1) AS i FROM x WHERE split = 'validation'), m2 AS (SELECT *, CASE WHEN NOT d AND NOT i THEN row_number() OVER (PARTITION BY digest, d OR i ORDER BY id) ELSE 1 END AS n FROM k2),
    a2 AS (SELECT digest, identity FROM a1 UNION ALL SELECT digest, identity FROM m2 WHERE NOT d AND NOT i AND n = 1),
    k3 AS (SELECT *, digest IN (SELECT digest FROM a2) AS d, identity IN (SELECT identity FROM a2) AS i FROM x WHERE split = 'train'), m3 AS (SELECT *, CASE WHEN NOT d AND NOT i THEN row_number() OVER (PARTITION BY digest, d OR i ORDER BY id) ELSE 1 END AS n FROM k3),
    every AS (SELECT id, split, CASE WHEN n > 1 THEN 'digest-repeated' END AS reason FROM k1 UNION ALL SELECT id, split, CASE WHEN d THEN 'digest-in-earlier-split' WHEN i THEN 'identity-in-earlier-split' WHEN n > 1 THEN 'digest-repeated' END FROM m2
    UNION ALL SELECT id, split, CASE WHEN d THEN 'digest-in-earlier-split' WHEN i THEN 'identity-in-earlier-split' WHEN n > 1 THEN 'digest-repeated' END FROM m3)"""


@query("first_per_digest", f"WITH {_SAMPLES} SELECT digest, min(id) AS id FROM x GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return first_per(samples(spark, d), "digest", "id").select("digest", "id")


@query("supersede_feedback", v.sql("SELECT id, id = max(id) OVER (PARTITION BY event_id) AS current FROM feedback", "feedback"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return supersede(v.feedback(spark, d)).select("id", "current")


@query("suppress_repeats", v.sql("""e AS (SELECT id, camera_id, t, CASE WHEN id % 50 = 0 THEN '' ELSE CAST(k % 5 AS VARCHAR) END AS plate FROM sightings);
    SELECT id, CASE WHEN plate = '' THEN 'empty' WHEN t - lag(t) OVER w <= 7200 THEN 'same_camera_window' WHEN t - lag(t) OVER g <= 900 AND lag(camera_id) OVER g <> camera_id THEN 'overlapping_camera_window' ELSE 'new' END AS decision
    FROM e WINDOW w AS (PARTITION BY camera_id, plate ORDER BY t, id), g AS (PARTITION BY plate ORDER BY t, id)""", "sightings"))
def _(spark: SparkSession, d: str) -> DataFrame:
    e = v.sightings(spark, d).select("id", "camera_id", "t", F.when(F.col("id") % 50 == 0, "").otherwise((F.col("k") % 5).cast("string")).alias("plate"))
    return suppress_repeats(e, 7200.0, 900.0).select("id", "decision")


@query("split_dedup_kept", f"{_SPLIT} SELECT id, split FROM every WHERE reason IS NULL")
def _(spark: SparkSession, d: str) -> DataFrame:
    return split_dedup(samples(spark, d), ["test", "validation", "train"])[0].select("id", "split")


@query("split_dedup_excluded", f"{_SPLIT} SELECT reason, split, count(*) AS n FROM every WHERE reason IS NOT NULL GROUP BY ALL")
def _(spark: SparkSession, d: str) -> DataFrame:
    return split_dedup(samples(spark, d), ["test", "validation", "train"])[1].groupBy("reason", "split").agg(F.count("*").alias("n"))


@query("hash_split", f"WITH {_SAMPLES} SELECT id, CAST('0x' || substr(sha256(digest), 1, 16) AS UBIGINT)::DOUBLE / 18446744073709551616.0 < 0.2 AS validation FROM x")
def _(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d).select("id", numbers.is_validation(F.col("digest"), 0.2).alias("validation"))


@query("conflicting_labels", "WITH x AS (SELECT sha256(lang || (n_chars % 40)) AS digest, quality FROM documents JOIN labels USING (doc_id)) SELECT digest, count(DISTINCT quality) AS labels FROM x GROUP BY 1 HAVING count(DISTINCT quality) > 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    x = v.table(spark, d, "documents").join(v.table(spark, d, "labels"), "doc_id").select(F.sha2(F.concat("lang", (F.col("n_chars") % 40).cast("string")), 256).alias("digest"), "quality")
    return conflicting(x, "digest", "quality")


@query("group_consistency", f"WITH {_SAMPLES} SELECT source, count(DISTINCT split) AS splits, count(DISTINCT lang) AS langs FROM x GROUP BY 1 HAVING count(DISTINCT split) > 1 OR count(DISTINCT lang) > 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d).groupBy("source").agg(F.countDistinct("split").alias("splits"), F.countDistinct("lang").alias("langs")).where("splits > 1 OR langs > 1")


@query("split_overlap", f"WITH {_SAMPLES}, e AS (SELECT DISTINCT split, digest FROM x) SELECT a.split AS split_1, b.split AS split_2, count(*) AS shared FROM e a JOIN e b USING (digest) WHERE a.split < b.split GROUP BY ALL")
def _(spark: SparkSession, d: str) -> DataFrame:
    return overlap(samples(spark, d), "digest")


@query("split_difference", f"WITH {_SAMPLES} SELECT digest FROM x WHERE split = 'train' EXCEPT SELECT digest FROM x WHERE split = 'test'")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d)
    return s.where("split = 'train'").select("digest").distinct().join(s.where("split = 'test'").select("digest"), "digest", "left_anti")


@query("split_intersection", f"WITH {_SAMPLES} SELECT identity FROM x WHERE split = 'train' INTERSECT SELECT identity FROM x WHERE split = 'test'")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d)
    return s.where("split = 'train'").select("identity").intersect(s.where("split = 'test'").select("identity"))


@query("coverage_matrix", f"WITH {_SAMPLES} SELECT w.lang, count(x.id) AS n FROM (SELECT unnest(['en', 'de', 'fr', 'xx']) AS lang) w LEFT JOIN x ON x.lang = w.lang GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return coverage(samples(spark, d), "lang", ["en", "de", "fr", "xx"])


@query("dataset_status", f"WITH {_SAMPLES} SELECT count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'validation') AS validation, count(*) FILTER (split = 'test') AS test, count(DISTINCT identity) AS plates, count(*) FILTER (split = 'train') >= 24 AND count(*) FILTER (split = 'validation') >= 12 AND count(DISTINCT identity) >= 8 AS ready FROM x")
def _(spark: SparkSession, d: str) -> DataFrame:
    n = lambda s: F.count_if(F.col("split") == s)
    ready = (n("train") >= 24) & (n("validation") >= 12) & (F.countDistinct("identity") >= 8)
    return samples(spark, d).agg(n("train").alias("train"), n("validation").alias("validation"), n("test").alias("test"), F.countDistinct("identity").alias("plates"), ready.alias("ready"))


@query("dense_export_ids", f"WITH {_SAMPLES} SELECT id, split, row_number() OVER (PARTITION BY split ORDER BY digest, id) AS dense_id FROM x")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d).withColumn("_o", F.struct("digest", "id"))
    return dense_ids(s, "split", "_o").select("id", "split", F.col("dense_id").cast("long").alias("dense_id"))


@query("merge_traces", v.sql("SELECT 'a:' || track_id AS track, seq FROM observations WHERE seq = 1 UNION ALL SELECT 'b:' || track_id, seq FROM observations WHERE seq = 2", "observations"))
def _(spark: SparkSession, d: str) -> DataFrame:
    o = v.observations(spark, d).select("track_id", "seq")
    one = lambda p, n: o.where(F.col("seq") == n).select(F.concat(F.lit(p), "track_id").alias("track"), "seq")
    return one("a:", 1).unionByName(one("b:", 2))


@query("alphabet_quarantine", v.sql(f"SELECT id FROM sightings WHERE NOT regexp_matches(plate_norm, '{plates.PLATE}')", "sightings"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return v.sightings(spark, d).where(~plates.plausible(F.col("plate_norm"))).select("id")


def group_violations(samples: DataFrame) -> DataFrame:
    """rule and key of everything that makes a dataset (path, digest, plate, group_id,
    split, license) inconsistent."""

    def several(rule: str, key: str, of: str) -> DataFrame:
        return samples.groupBy(F.col(key).alias("key")).agg(F.countDistinct(of).alias("n")).where("n > 1").select(F.lit(rule).alias("rule"), "key")

    def repeated(rule: str, key: str) -> DataFrame:
        return samples.groupBy(F.col(key).alias("key")).count().where("count > 1").select(F.lit(rule).alias("rule"), "key")

    licences = samples.agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("key"), F.countDistinct("license").alias("n")).where("n > 1").select(F.lit("several-licenses").alias("rule"), "key")
    out = several("group-of-several-plates", "group_id", "plate").unionByName(several("plate-in-several-splits", "plate", "split"))
    return out.unionByName(repeated("path-repeated", "path")).unionByName(repeated("digest-repeated", "digest")).unionByName(licences)


def normalised_export(images: DataFrame, annotations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(images, annotations) with dense ids: images (id, split, digest) are numbered
    within their split by digest, annotations (id, image) by their image's number, which
    they carry. A digest in two splits, or an annotation without an image, is an error."""
    if overlap(images, "digest").head(1):
        raise ValueError("a digest lies in two splits")
    if annotations.join(images, annotations["image"] == images["id"], "left_anti").head(1):
        raise ValueError("an annotation has no image")
    numbered = dense_ids(images.withColumn("_o", F.struct("digest", "id")), "split", "_o").drop("_o")
    own = annotations.join(numbered.select(F.col("id").alias("image"), "split", F.col("dense_id").alias("image_id")), "image")
    return numbered, dense_ids(own.withColumn("_o", F.struct("image_id", "id")), "split", "_o").drop("_o")


_DATASET = "s AS (SELECT event_id AS id, 'p' || (event_id % 997) AS path, sha256(CAST(event_id % 1993 AS VARCHAR)) AS digest, 'k' || (event_id % 211 // 2) AS plate, 'g' || (event_id % 211 // 2 % 90 + CASE WHEN event_id % 211 > 200 THEN 1 ELSE 0 END) AS group_id, CASE WHEN event_id % 211 < 20 AND event_id % 3 = 0 THEN 'test' ELSE 'train' END AS split, CASE WHEN event_id % 400 = 7 THEN 'other' ELSE 'MIT' END AS license FROM events)"


@query("group_violations", f"""WITH {_DATASET} SELECT 'group-of-several-plates' AS rule, group_id AS key FROM s GROUP BY 2 HAVING count(DISTINCT plate) > 1 UNION ALL SELECT 'plate-in-several-splits', plate FROM s GROUP BY 2 HAVING count(DISTINCT split) > 1
    UNION ALL SELECT 'path-repeated', path FROM s GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'digest-repeated', digest FROM s GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'several-licenses', string_agg(DISTINCT license, ',' ORDER BY license) FROM s HAVING count(DISTINCT license) > 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    pair = F.floor(k % 211 / 2)
    s = v.table(spark, d, "events").select(
        k.alias("id"), F.concat(F.lit("p"), k % 997).alias("path"), F.sha2((k % 1993).cast("string"), 256).alias("digest"), F.concat(F.lit("k"), pair).alias("plate"), F.concat(F.lit("g"), pair % 90 + F.when(k % 211 > 200, 1).otherwise(0)).alias("group_id"),
        F.when((k % 211 < 20) & (k % 3 == 0), "test").otherwise("train").alias("split"), F.when(k % 400 == 7, "other").otherwise("MIT").alias("license"),
    )
    return group_violations(s)


@query("export_annotations", """WITH i AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'val' ELSE 'train' END AS split, sha256(CAST(o_orderkey AS VARCHAR)) AS digest FROM orders), n AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY digest, id) AS image_id FROM i),
    a AS (SELECT l_orderkey * 100000 + l_linenumber * 10000 + l_partkey AS id, l_orderkey AS image FROM lineitem GROUP BY ALL) SELECT a.id, image_id, split, row_number() OVER (PARTITION BY split ORDER BY image_id, a.id) AS dense_id FROM a JOIN n ON n.id = a.image""")
def _(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    images = v.table(spark, d, "orders").select(k.alias("id"), F.when(k % 5 == 0, "val").otherwise("train").alias("split"), F.sha2(k.cast("string"), 256).alias("digest"))
    found = v.table(spark, d, "lineitem").select((F.col("l_orderkey") * 100000 + F.col("l_linenumber") * 10000 + F.col("l_partkey")).alias("id"), F.col("l_orderkey").alias("image")).distinct()
    return normalised_export(images, found.join(images.select(F.col("id").alias("image")), "image", "left_semi"))[1].select("id", F.col("image_id").cast("long").alias("image_id"), "split", F.col("dense_id").cast("long").alias("dense_id"))
