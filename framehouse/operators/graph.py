"""Connected components of an edge table, by rounds of large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framehouse.plans.lineage import delete_path, fresh_path


def components(edges: DataFrame) -> DataFrame:
    """node, label (its component's smallest node) of every node of the edges (a, b), which may be of any ordered type.

    Each round joins every node with its smallest neighbour, and its result is written to the shared folder, so the
    plan stays short and a lost executor costs one round. Rounds grow with the logarithm of the longest path.
    """
    spark, kind = edges.sparkSession, edges.schema["a"].dataType.simpleString()
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    state, before = None, None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pair = lambda x: F.struct(F.col(x).alias("u"), F.col("m").alias("v"))
        small = large.join(low, "u").select(F.explode(F.array(pair("u"), pair("v"))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        path = fresh_path(spark, "stars")
        small.write.parquet(path)
        edges = spark.read.schema(f"u {kind}, v {kind}").parquet(path)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state is not None:
            delete_path(spark, state)
        state = path
        if now == before:
            break
        before = now
    tips = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label"))
    return tips.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
