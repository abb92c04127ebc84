"""Histories that keep only the last used: what falls out begins again when it comes back.

Runs are dealt by ranges of time, and these cut into stretches. The last distinct folders at the end
of a stretch are a small summary, which composed in order give what each stretch begins with; a stretch then tells by itself
which of its runs found their folder kept. No Python worker holds more than a stretch.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framehouse.operators import runs

FOLDERS_KEPT = 12


def used(kept: list[str], folder: str, keep: int) -> tuple[list[str], bool]:
    """The kept folders, last used first, after a run on one, and whether it was among them."""
    return [folder, *(f for f in kept if f != folder)][:keep], folder in kept


def folder_history(history: DataFrame, keep: int = FOLDERS_KEPT, stretch_bits: int = runs.STRETCH_BITS) -> DataFrame:
    """folder, n_runs, last_deleted, last_failed, last_bytes, total_deleted, total_failed, total_bytes, place of the kept folders.

    history has folder, at, deleted, failed, bytes. Each run puts its folder first and the list is cut to ``keep``: totals
    are those since the folder last came on the list. Names are trimmed; runs without one don't count. Runs at one time go
    by folder, then by their counts; a null count is 0.
    """
    counts = ["deleted", "failed", "bytes"]
    named = history.select(F.trim("folder").alias("folder"), "at", *[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in counts]).where("folder <> '' AND at IS NOT NULL")
    dealt = runs.cut(runs.spread(named.withColumn("g", F.lit(0)), ["g"], ["at", "folder", *counts]), stretch_bits)
    latest = dealt.groupBy("__part", "folder").agg(F.max("__at").alias("__at"))
    tails = latest.groupBy("__part").agg(F.slice(F.sort_array(F.collect_list(F.struct("__at", "folder")), asc=False), 1, keep).alias("tail"))
    # keep names a stretch: the driver composes as many lists as there are stretches.
    kept, begins = [], []
    for r in sorted(tails.collect(), key=lambda r: r["__part"]):
        begins.append((r["__part"], kept))
        own = [x["folder"] for x in r["tail"]]
        kept = [*own, *(f for f in kept if f not in own)][:keep]
    if not begins:
        return dealt.select("folder", F.lit(0).cast("long").alias("n_runs"), *[F.col(c).alias(f"last_{c}") for c in counts], *[F.col(c).alias(f"total_{c}") for c in counts], F.lit(0).alias("place")).limit(0)
    spark = history.sparkSession
    starts = spark.createDataFrame(begins, "__part long, kept array<string>")

    def marked(rows: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("__at")
        now, found = list(start["kept"].iloc[0]), []
        for folder in rows["folder"]:
            now, was = used(now, folder, keep)
            found.append(not was)
        return rows.loc[found, ["folder", "__at"]]

    stretches = dealt.select("__part", "__at", "folder").groupBy("__part")
    fresh = stretches.cogroup(starts.groupBy("__part")).applyInPandas(marked, "folder string, __at long")
    places = F.broadcast(spark.createDataFrame([(f, k + 1) for k, f in enumerate(kept)], "folder string, place int"))
    began = fresh.join(places, "folder").groupBy("folder", "place").agg(F.max("__at").alias("__began"))
    mine = dealt.join(F.broadcast(began), "folder").where(F.col("__at") >= F.col("__began"))
    last = [F.max_by(c, "__at").alias(f"last_{c}") for c in counts]
    return mine.groupBy("folder", "place").agg(F.count("*").alias("n_runs"), *last, *[F.sum(c).alias(f"total_{c}") for c in counts]).select("folder", "n_runs", *[f"last_{c}" for c in counts], *[f"total_{c}" for c in counts], "place")
