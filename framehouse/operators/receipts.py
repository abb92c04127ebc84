"""Receipts of runs as rows: read from JSON text, judged, and turned into plans that undo them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NEWEST_TRANSFER = 2
TRANSFER = "schemaVersion int, status string, transfers array<struct<source string, dest string, hash string>>, __bad string"
DEDUPE = "schemaVersion int, kind string, status string, items array<struct<originalPath string, sizeBytes bigint, trashURL string>>, additionalSourceRoots array<string>, __bad string"
LAYOUT = "schemaVersion int, status string, items array<struct<sourcePath string, destinationPath string, hash string, completed boolean>>, __bad string"
STATUSES = ("PENDING", "COMPLETED", "ABORTED")


def _parsed(receipts: DataFrame, schema: str) -> DataFrame:
    """receipts (name, text) with r, their JSON; a text that doesn't fit the schema stands in r.__bad."""
    return receipts.withColumn("r", F.from_json("text", schema, {"columnNameOfCorruptRecord": "__bad", "mode": "PERMISSIVE"}))


def transfer_triage(receipts: DataFrame) -> DataFrame:
    """name, verdict (missing, malformed, unsupported, readable), n: a receipt without a version is of the first."""
    bad = F.col("r").isNull() | F.col("r.__bad").isNotNull() | F.col("r.transfers").isNull()
    verdict = F.when(F.col("text").isNull(), "missing").when(bad, "malformed").when(F.coalesce("r.schemaVersion", F.lit(1)) > NEWEST_TRANSFER, "unsupported").otherwise("readable")
    return _parsed(receipts, TRANSFER).select("name", verdict.alias("verdict"), F.when(verdict == "readable", F.size("r.transfers")).alias("n"))


def transfers(receipts: DataFrame) -> DataFrame:
    """name, at, source, dest, hash of the readable receipts."""
    readable = transfer_triage(receipts).where("verdict = 'readable'").select("name")
    found = _parsed(receipts, TRANSFER).join(readable, "name", "left_semi").select("name", F.posexplode("r.transfers").alias("at", "t"))
    return found.select("name", "at", "t.source", "t.dest", "t.hash")


def dedupe_items(receipts: DataFrame) -> DataFrame:
    """name, status, path, bytes of receipts of the kind dedupe and a known status; what older ones lack takes its default."""
    found = _parsed(receipts, DEDUPE).where("r.__bad IS NULL").select("name", F.coalesce("r.kind", F.lit("dedupe")).alias("kind"), F.coalesce("r.status", F.lit("COMPLETED")).alias("status"), F.explode("r.items").alias("i"))
    return found.where((F.col("kind") == "dedupe") & F.col("status").isin(*STATUSES)).select("name", "status", F.col("i.originalPath").alias("path"), F.coalesce("i.sizeBytes", F.lit(0)).alias("bytes"))


def layout_undo(receipts: DataFrame) -> DataFrame:
    """name, step, source, dest of the completed moves, each receipt's last first."""
    found = _parsed(receipts, LAYOUT).where("r.__bad IS NULL").select("name", F.size("r.items").alias("n"), F.posexplode("r.items").alias("at", "i")).where("i.completed")
    return found.select("name", (F.col("n") - F.col("at")).alias("step"), F.col("i.destinationPath").alias("source"), F.col("i.sourcePath").alias("dest"))


def revert_plan(moved: DataFrame, present: DataFrame, root: str) -> DataFrame:
    """moved with action: revert where the file is below the root and still has its hash, skip where not, missing where it is gone."""
    now = present.select(F.col("path").alias("dest"), F.col("identity").alias("__now"), F.lit(True).alias("__there"))
    inside = F.col("dest").startswith(f"{root.rstrip('/')}/")
    action = F.when(~inside, "skip").when(F.col("__there").isNull(), "missing").when(F.col("__now").eqNullSafe(F.col("hash")), "revert").otherwise("skip")
    return moved.join(now, "dest", "left").withColumn("action", action).drop("__now", "__there")
