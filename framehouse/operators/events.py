"""Event sessions of capture times and the names they get."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framehouse.operators import runs

GAP_SECONDS = 8 * 3600
# Folder names that say nothing of an event.
GENERIC = ("dcim", "camera", "photos", "photo", "imports", "import", "downloads", "download", "100apple", "101apple", "102apple", "100media")


def sessions(captures: DataFrame, gap: int = GAP_SECONDS) -> DataFrame:
    """captures (bucket, t in seconds, path, ..) with session: within a bucket a longer gap than ``gap`` begins the next."""
    found = runs.breaks(captures, "bucket", "t", ["path"], gap)
    return found.withColumn("session", F.concat("bucket", F.lit("-"), F.col("__n").cast("string"))).drop("__n")


def named(sessions_: DataFrame) -> DataFrame:
    """session, n, name: the most frequent folder that isn't generic, ties to the first by letters; null if none."""
    votes = sessions_.where(F.col("folder").isNotNull() & ~F.lower(F.trim("folder")).isin(*GENERIC)).groupBy("session", "folder").agg(F.count("*").alias("votes"))
    best = votes.groupBy("session").agg(F.min_by("folder", F.struct(-F.col("votes"), F.lower("folder"), "folder")).alias("name"))
    return sessions_.groupBy("session").agg(F.count("*").alias("n")).join(best, "session", "left")
