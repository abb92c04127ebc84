"""Copy planning: from files with identity and date to placed, numbered transfers, with the counts and items of a preview."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framehouse.functions import media
from framehouse.operators import runs

TOLERANCE = 0.001


def with_cached_identity(files: DataFrame, cache: DataFrame) -> DataFrame:
    """files (path, size, mtime, ..) with the cached identity where size and time agree, and whether it was a hit."""
    known = cache.where(media.identity_parts(F.col("hash")).isNotNull()).select("path", F.col("hash").alias("__hash"), F.col("size").alias("__size"), F.col("mtime").alias("__mtime"))
    hit = (F.col("size") == F.col("__size")) & (F.abs(F.col("mtime") - F.col("__mtime")) < TOLERANCE)
    joined = files.join(known, "path", "left").withColumn("cache_hit", F.coalesce(hit, F.lit(False)))
    return joined.withColumn("identity", F.when(F.col("cache_hit"), F.col("__hash"))).drop("__hash", "__size", "__mtime")


def with_overrides(files: DataFrame, overrides: DataFrame) -> DataFrame:
    """An edit of this identity and path, else the edit of the identity if there is but one: date and event name replaced."""
    edit = F.struct("capture_date", "event_name")
    exact = overrides.select("identity", F.col("source_path").alias("path"), edit.alias("__exact"))
    alone = overrides.groupBy("identity").agg(F.count("*").alias("__n"), F.first(edit).alias("__alone")).where("__n = 1").drop("__n")
    joined = files.join(exact, ["identity", "path"], "left").join(alone, "identity", "left").withColumn("__edit", F.coalesce("__exact", "__alone"))
    return joined.withColumns({"captured_at": F.coalesce("__edit.capture_date", "captured_at"), "event_name": media.clean_event_name(F.col("__edit.event_name")), "date_edited": F.col("__edit.capture_date").isNotNull()}).drop("__exact", "__alone", "__edit")


def destination_identities(index: DataFrame) -> DataFrame:
    """identity, matched_path: of several files of an identity the last one indexed."""
    return index.where("identity IS NOT NULL").groupBy("identity").agg(F.max_by("path", "ordinal").alias("matched_path"))


def sequence_maxima(index: DataFrame) -> DataFrame:
    """bucket, is_duplicate, max_seq over the names of the destination."""
    named = index.select(media.indexed_bucket(F.col("path")).alias("bucket"), media.in_duplicates(F.col("path")).alias("is_duplicate"), media.indexed_sequence(F.col("path")).alias("seq"))
    return named.where("bucket IS NOT NULL AND seq IS NOT NULL").groupBy("bucket", "is_duplicate").agg(F.max("seq").alias("max_seq"))


def classified(files: DataFrame, index: DataFrame) -> DataFrame:
    """files with bucket, matched_path and status: hash_error, already_in_destination, new or duplicate.

    The first of an identity is found by a partial aggregation and a join back, not by a window, so that an identity
    that a third of all files share is no single task's work.
    """
    placed = files.withColumn("bucket", media.day_bucket(F.col("captured_at"))).join(destination_identities(index), "identity", "left")
    first = files.where("identity IS NOT NULL").groupBy("identity").agg(F.min("ordinal").alias("__first"))
    status = F.when(F.col("identity").isNull(), "hash_error").when(F.col("matched_path").isNotNull(), "already_in_destination").when(F.col("ordinal") == F.col("__first"), "new").otherwise("duplicate")
    return placed.join(first, "identity", "left").withColumn("status", status).drop("__first")


def copy_plan(files: DataFrame, index: DataFrame, root: str, layout: str = "yyyy/mm/dd", least_width: int = 3) -> DataFrame:
    """ordinal, source, dest, identity, bucket, is_duplicate, sequence, width of each file that is to be copied.

    Numbers go on from the destination's highest of the bucket, in the order of discovery; duplicates have their own. A
    bucket may be a third of all files: its numbers come from ranges.
    """
    todo = classified(files, index).where(F.col("status").isin("new", "duplicate")).withColumn("is_duplicate", F.col("status") == "duplicate")
    counted = runs.numbered(todo, ["bucket", "is_duplicate"], ["ordinal"]).join(sequence_maxima(index), ["bucket", "is_duplicate"], "left").withColumn("existing", F.coalesce("max_seq", F.lit(0)))
    sized = counted.withColumns({"sequence": F.col("existing") + F.col("__n"), "width": media.sequence_width(F.col("existing"), F.col("__all"), least_width)})
    event = F.col("event_name") if "event_name" in files.columns else None
    dest = media.planned_path(F.col("path"), root, F.col("bucket"), F.col("sequence"), F.col("width"), F.col("is_duplicate"), layout, event)
    return sized.select("ordinal", F.col("path").alias("source"), dest.alias("dest"), "identity", "bucket", "is_duplicate", "sequence", "width", "existing")


def plan_counts(files: DataFrame, index: DataFrame) -> DataFrame:
    return classified(files, index).groupBy("status").agg(F.count("*").alias("n"))


def width_notes(plan: DataFrame, least_width: int = 3) -> DataFrame:
    """bucket, kind: warning where a bucket that had files gets wider numbers, info where a new one needs them at once."""
    primary = plan.where("NOT is_duplicate").groupBy("bucket").agg(F.max("existing").alias("existing"), F.max("width").alias("width"), F.count("*").alias("planned"))
    before = F.greatest(F.lit(least_width), F.length(F.col("existing").cast("string")))
    kind = F.when((F.col("existing") > 0) & (F.col("width") > before), "warning").when((F.col("existing") == 0) & (F.col("width") > least_width), "info")
    return primary.withColumn("kind", kind).where("kind IS NOT NULL").select("bucket", "kind", "existing", "planned", "width")


def month_histogram(plan: DataFrame, samples: int = 4) -> DataFrame:
    """month, n, samples: the first paths of a month in the order of the plan. No list grows with the month."""
    keyed = plan.withColumn("month", media.month_key(F.col("bucket")))
    order = Window.partitionBy("month").orderBy("is_duplicate", "bucket", "ordinal")
    first = keyed.withColumn("r", F.row_number().over(order)).where(F.col("r") <= samples).groupBy("month").agg(F.array_sort(F.collect_list(F.struct("r", "source"))).alias("s"))
    counts = keyed.groupBy("month").agg(F.count("*").alias("n"))
    return counts.join(first, "month").select("month", "n", F.col("s.source").alias("samples"))


def histogram_of_paths(paths: DataFrame) -> DataFrame:
    """month, n of planned destination paths, by their names alone; other names are left out."""
    return paths.select(media.month_of_path(F.col("path")).alias("month")).where("month IS NOT NULL").groupBy("month").agg(F.count("*").alias("n"))


def review_items(files: DataFrame, index: DataFrame) -> DataFrame:
    """path, status, confidence, issues, needs_attention; date issues stand before that of the status."""
    judged = classified(files, index)
    date_issue = F.when(F.col("bucket") == media.UNKNOWN_DIRECTORY, "unknownDate").when(F.col("confidence") == "low", "lowConfidenceDate")
    status_issue = F.when(F.col("status") == "duplicate", "duplicate").when(F.col("status") == "hash_error", "hashError").when(F.col("status") == "already_in_destination", "alreadyInDestination")
    issues = F.array_compact(F.array(date_issue, status_issue))
    attention = F.arrays_overlap(issues, F.array(F.lit("unknownDate"), F.lit("lowConfidenceDate"), F.lit("hashError")))
    return judged.select("ordinal", "path", "status", "bucket", "confidence", issues.alias("issues")).withColumn("needs_attention", attention)


def review_summary(items: DataFrame) -> DataFrame:
    has = lambda issue: F.count_if(F.array_contains("issues", issue))
    return items.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "new").alias("ready"), F.count_if("needs_attention").alias("needs_attention"), has("unknownDate").alias("unknown_date"), has("lowConfidenceDate").alias("low_confidence"), has("duplicate").alias("duplicates"), has("alreadyInDestination").alias("already_there"), has("hashError").alias("hash_errors"))
