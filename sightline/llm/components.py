"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for every id in ``edges``
    (a, b). Minimum labels over edges, then a jump to the label's own label, until
    nothing changes; each round is a written table."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialize(spark, both, "edges")
    labels = materialize(spark, both.groupBy("a").agg(F.least("a", F.min("b")).alias("component")).withColumnRenamed("a", "id"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("component").alias("near"))
        met = labels.join(near.withColumnRenamed("a", "id"), "id").select("id", "component", F.least("component", "near").alias("next"))
        own = labels.select(F.col("id").alias("next"), F.col("component").alias("jump"))
        jumped = materialize(spark, met.join(own, "next").select("id", F.col("component").alias("old"), F.col("jump").alias("component")), "labels")
        labels = jumped.select("id", "component")
        if not jumped.where("old <> component").head(1):
            return labels
