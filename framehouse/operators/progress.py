"""Transfer speed and remaining time: a sample counts once enough time has passed since the last one that counted.

Which sample is accepted depends on the one accepted before, so a run is a chain of successors. Samples are dealt by
ranges of (run, time). A range may be entered at the samples close to the range before it; for each of these the last
sample it leads to is found within the range, and these small maps, one for each run and range, are composed along the
run. With its entry known, every range gives its own rows: no task holds a whole run.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framehouse.operators import runs


def successors(at: np.ndarray, least: float) -> np.ndarray:
    """Of each of the ascending times the place of the first that is at least ``least`` later; their number, if none is."""
    to = np.searchsorted(at, at + least)
    while True:  # by differences, as two samples are compared, not by the rounded sum
        back = (to > 0) & (at[np.maximum(to - 1, 0)] - at >= least)
        on = (to < len(at)) & (at[np.minimum(to, len(at) - 1)] - at < least)
        if not (back | on).any():
            return to
        to = to - back + on


def ends(to: np.ndarray) -> np.ndarray:
    """The last place that each leads to, by pointer doubling."""
    n = len(to)
    step = np.where(to < n, to, np.arange(n))
    while (further := step[step]).tolist() != step.tolist():
        step = further
    return step


def speeds(samples: DataFrame, least_seconds: float = 0.5) -> DataFrame:
    """run, at, bytes_per_second, left_seconds over (run, at, done, total): speed since the last accepted sample.

    A run's first sample is where it begins. Each later one is accepted if least_seconds passed since the last accepted.
    left_seconds is null without progress. Samples without a time or without bytes done are none; a null run is a run.
    """
    kind = samples.schema["run"].dataType.simpleString()
    known = samples.where("at IS NOT NULL AND done IS NOT NULL").select("run", F.col("at").cast("double").alias("at"), F.col("done").cast("double").alias("done"), F.col("total").cast("double").alias("total"))
    dealt = runs.cut(runs.spread(known, ["run"], ["at", "done", "total"]))
    order = Window.partitionBy("run").orderBy("__part")
    parts = dealt.groupBy("run", "__part").agg(F.max("at").alias("until")).withColumn("before", F.lag("until").over(order)).select(F.col("run").alias("__run"), F.col("__part").alias("__in"), "before")
    same = F.col("run").eqNullSafe(F.col("__run")) & (F.col("__part") == F.col("__in"))
    met = dealt.join(parts, same).drop("__run", "__in")

    def entries(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("__at")
        at, done, before = rows["at"].to_numpy(), rows["done"].to_numpy(), rows["before"].iloc[0]
        n = 1 if pd.isna(before) else min(len(at), int((at - before < least_seconds).sum()) + 1)
        last = ends(successors(at, least_seconds))[:n]
        return pd.DataFrame({"run": [rows["run"].iloc[0]], "__part": [rows["__part"].iloc[0]], "first": [pd.isna(before)], "enter": [at[:n].tolist()], "leave_at": [at[last].tolist()], "leave_done": [done[last].tolist()]})

    maps = met.groupBy("run", "__part").applyInPandas(entries, f"run {kind}, __part long, first boolean, enter array<double>, leave_at array<double>, leave_done array<double>")

    def compose(rows: pd.DataFrame) -> pd.DataFrame:
        out, base = [], None
        for r in rows.sort_values("__part").itertuples(index=False):
            out.append((r[0], r[1], *(base or (None, None))))
            k = 0 if base is None else next((i for i, at in enumerate(r.enter) if at - base[0] >= least_seconds), None)
            base = base if k is None else (float(r.leave_at[k]), float(r.leave_done[k]))
        return pd.DataFrame(out, columns=["run", "__part", "base_at", "base_done"]).astype({"base_at": float, "base_done": float})

    bases = maps.groupBy("run").applyInPandas(compose, f"run {kind}, __part long, base_at double, base_done double")
    based = dealt.join(bases.select(F.col("run").alias("__run"), F.col("__part").alias("__in"), "base_at", "base_done"), same).drop("__run", "__in")

    def accepted(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("__at")
        at, to = rows["at"].to_numpy(), successors(rows["at"].to_numpy(), least_seconds)
        base = rows["base_at"].iloc[0]
        k = 0 if pd.isna(base) else next(iter(np.flatnonzero(at - base >= least_seconds)), len(at))
        chain = []
        while k < len(at):
            chain.append(int(k))
            k = to[k]
        got = rows.iloc[chain]
        begins = got[["at", "done"]].shift()
        if len(got):
            begins.iloc[0] = [base, rows["base_done"].iloc[0]]
        told = pd.DataFrame({"run": got["run"], "at": got["at"], "since": begins["at"], "was": begins["done"], "done": got["done"], "total": got["total"]})
        return told[told["since"].notna()]

    found = based.groupBy("run", "__part").applyInPandas(accepted, f"run {kind}, at double, since double, was double, done double, total double")
    speed = (F.col("done") - F.col("was")) / (F.col("at") - F.col("since"))
    return found.select("run", "at", speed.alias("bytes_per_second"), F.when(speed > 0, (F.col("total") - F.col("done")) / speed).alias("left_seconds"))
