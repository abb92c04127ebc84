"""A stream of directory snapshots as a stream of changes, and of run events as running counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from framehouse.operators import library


def changes_of(stamps: pd.Series, before: float | None) -> pd.Series:
    """created, removed, modified or none of each stamp after the one before it; a missing stamp says that the path is gone."""
    last = stamps.shift()
    last.iloc[0] = float("nan") if before is None else before
    there, was = stamps.notna(), last.notna()
    kind = pd.Series(None, index=stamps.index, dtype=object)
    kind[there & ~was], kind[~there & was], kind[there & was & (stamps != last)] = "created", "removed", "modified"
    return kind


def change_feed(observed: DataFrame) -> DataFrame:
    """path, at, change of a stream (path, at, stamp), where a null stamp says that the path is gone.

    The state of a path is its last stamp, so state is dealt by path and grows with the tree, not with the stream.
    """

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("at", kind="stable", ignore_index=True)
        stamps = rows["stamp"].astype(float)
        kind = changes_of(stamps, state.get[0] if state.exists else None)
        if pd.notna(stamps.iloc[-1]):
            state.update((float(stamps.iloc[-1]),))
        elif state.exists:
            state.remove()
        told = kind.notna()
        if told.any():
            yield pd.DataFrame({"path": key[0], "at": rows["at"][told], "change": kind[told]})

    rows = observed.select("path", "at", F.col("stamp").cast("double").alias("stamp"))
    return rows.groupBy("path").applyInPandasWithState(step, "path string, at timestamp, change string", "stamp double", "append", GroupStateTimeout.NoTimeout)


def write_changes(feed: DataFrame, folder: str, checkpoint: str, latency: str = "2 seconds", **trigger) -> StreamingQuery:
    """Write the feed, a folder for each batch of the latency, without removals of what lay under a path that went with it.

    A batch that is run again replaces its own folder, so every change is written once.
    """

    def put(batch: DataFrame, number: int) -> None:
        library.collapsed(batch).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/batch={number}")

    return feed.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": latency})).start()


def phase_counts(events: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """window, phase, n, bytes of a stream (at, phase, bytes); events later than ``late`` are dropped by the watermark."""
    return events.withWatermark("at", late).groupBy(F.window("at", width), "phase").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
