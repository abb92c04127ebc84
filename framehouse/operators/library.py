"""A library's layout, health, tables and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framehouse.functions import media
from framehouse.operators import runs


def layout_moves(files: DataFrame, root: str, layout: str) -> DataFrame:
    """path, dest, status (move, unchanged, unrecognized): names stay, directories follow the layout."""
    path, bucket = F.col("path"), media.managed_bucket(F.col("path"))
    relative = F.substring(path, len(root) + 2, 1 << 30)
    first = F.when(relative.startswith(f"{media.DUPLICATE_DIRECTORY}/"), f"{root}/{media.DUPLICATE_DIRECTORY}/").otherwise(f"{root}/")
    dest = F.concat(first, media.directories(bucket, layout, media.found_event_folder(relative)), media.filename(path))
    status = F.when(bucket.isNull(), "unrecognized").when(dest == path, "unchanged").otherwise("move")
    return files.select("path", F.when(bucket.isNotNull(), dest).alias("dest"), status.alias("status"))


def reclaimable(cache: DataFrame) -> DataFrame:
    """hash, copies, bytes: what all but the largest of each content take."""
    return cache.groupBy("hash").agg((F.count("*") - 1).alias("copies"), (F.sum("size") - F.max("size")).alias("bytes")).where("copies > 0")


def health_cards(files: DataFrame, cache: DataFrame, queue: DataFrame, artifacts: DataFrame, has_destination: bool = True) -> DataFrame:
    """card, value, bytes, severity (0 good, 1 attention, 2 critical), overall: each input is read once, and one row of each meets.

    Structure drift counts names that no plan writes, wherever they stand. Duplicates are the larger of what lies under
    Duplicate/ and what the cache tells, for files and for bytes.
    """
    name = media.filename(F.col("path"))
    unknown = F.array_contains(F.split("path", "/"), media.UNKNOWN_DIRECTORY) | name.startswith(media.UNKNOWN_PREFIX)
    duplicate = ~unknown & media.in_duplicates(F.col("path"))
    taken = lambda where: F.coalesce(F.sum(F.when(where, F.col("size"))), F.lit(0))
    tree = files.agg(F.count_if(unknown).alias("unknown"), taken(unknown).alias("unknown_bytes"), F.count_if(duplicate).alias("in_tree"), taken(duplicate).alias("tree_bytes"), F.count_if(~media.is_planned_name(name)).alias("drift"))
    cached = reclaimable(cache).agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("in_cache"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("cache_bytes"))
    jobs = queue.agg(F.count_if(F.col("status") == "PENDING").alias("pending"), F.count_if(F.col("status") == "FAILED").alias("failed"))
    receipts = artifacts.agg(F.count_if(F.col("name").startswith("audit_receipt_") | F.col("name").startswith("dedupe_audit_receipt_")).alias("receipts"))
    row = tree.join(cached, F.lit(True)).join(jobs, F.lit(True)).join(receipts, F.lit(True))  # one row each
    some = lambda c: F.when(c > 0, 1).otherwise(0)
    copies, none = F.greatest("in_tree", "in_cache"), F.lit(0)
    cards = F.array(*[F.struct(F.lit(card).alias("card"), value.cast("long").alias("value"), bytes_.cast("long").alias("bytes"), severity.alias("severity")) for card, value, bytes_, severity in (
        ("ready", F.lit(int(has_destination)), none, F.lit(int(not has_destination))),
        ("unknown-dates", F.col("unknown"), F.col("unknown_bytes"), some(F.col("unknown"))),
        ("duplicates", copies, F.greatest("tree_bytes", "cache_bytes"), some(copies)),
        ("interrupted-work", F.col("pending") + F.col("failed"), none, F.when(F.col("failed") > 0, 2).otherwise(some(F.col("pending")))),
        ("history", F.col("receipts"), none, 1 - some(F.col("receipts"))),
        ("structure-drift", F.col("drift"), none, some(F.col("drift"))))])
    overall = F.array_max(F.transform("cards", lambda c: c.severity))
    return row.select(cards.alias("cards")).select(F.explode("cards").alias("c"), overall.alias("overall")).select("c.*", "overall")


def upserted(table: DataFrame, changes: DataFrame, key: list[str], order: str, keep: str | None = None) -> DataFrame:
    """The table after its changes: of each key the change of the highest order, else the old row.

    With ``keep``, the first value that a key ever had in that column stays, as a row's place in a queue does.
    """
    columns = [c for c in table.columns if c != keep]
    both = table.withColumn("__at", F.lit(-1).cast("long")).unionByName(changes.select(*table.columns, F.col(order).cast("long").alias("__at")))
    last = F.max_by(F.struct(*columns), "__at").alias("__row")
    first = [F.min_by(keep, "__at").alias("__keep")] if keep else []
    merged = both.groupBy(*[F.col(c).alias(f"__k_{c}") for c in key]).agg(last, *first)
    return merged.select(*[F.col("__keep").alias(c) if c == keep else F.col(f"__row.{c}").alias(c) for c in table.columns])


def deleted(table: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    return table.join(keys.select(*key).distinct(), key, "left_anti")


def pruned(table: DataFrame, current: DataFrame) -> DataFrame:
    """The rows whose path is still there."""
    return table.join(current.select("path").distinct(), "path", "left_semi")


def source_log(history: DataFrame) -> DataFrame:
    """source, first_run, last_run, n_runs, last_copied, total_copied over (source, at, copied)."""
    return history.groupBy("source").agg(F.min("at").alias("first_run"), F.max("at").alias("last_run"), F.count("*").alias("n_runs"), F.max_by("copied", F.struct("at", "copied")).alias("last_copied"), F.sum("copied").alias("total_copied"))


def transfer_totals(outcomes: DataFrame) -> DataFrame:
    """copied_bytes and how many were copied, failed and skipped."""
    of = lambda status: F.count_if(F.col("status") == status)
    return outcomes.agg(F.coalesce(F.sum(F.when(F.col("status") == "COPIED", F.col("bytes"))), F.lit(0)).alias("copied_bytes"), of("COPIED").alias("copied"), of("FAILED").alias("failed"), of("SKIPPED").alias("skipped"))


def by_day(history: DataFrame, at: Column) -> DataFrame:
    return history.groupBy(F.date_format(at, "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


def running_count(days: DataFrame) -> DataFrame:
    """days (day, n) with the runs up to each; a row for a day, so one window over all of them is small."""
    return days.withColumn("runs", F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))


def bar_fills(months: DataFrame, copied: int) -> DataFrame:
    """month, n, filled: what is copied fills the months in order; a row for a month."""
    before = F.sum("n").over(Window.orderBy("month").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    return months.withColumn("filled", F.greatest(F.lit(0), F.least(F.col("n"), F.lit(copied) - before)))


def year_marks(months: DataFrame) -> DataFrame:
    year = F.substring("month", 1, 4)
    return months.withColumn("year", year).groupBy("year").agg(F.min("month").alias("month"))


def abort_points(outcomes: DataFrame, run: str, most_in_a_row: int = 5, most: int = 20) -> DataFrame:
    """run, aborted_at, reason: where a run's failures reach the limit. Success ends a row of them, skipping doesn't.

    Outcomes are dealt by ranges of (run, ordinal) and counted where they are; a row for each run and range carries on what
    its earlier ranges failed in all and since their last success. A null run is a run; a null status neither fails nor succeeds.
    """
    is_ = lambda status: F.coalesce((F.col("status") == status).cast("int"), F.lit(0))
    dealt = runs.spread(outcomes.select(F.col(run).alias("run"), "ordinal", is_("FAILED").alias("failed"), is_("COPIED").alias("copied")), ["run"], ["ordinal"])
    here = Window.partitionBy("run", "__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    island = Window.partitionBy("run", "__part", "island").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    local = dealt.withColumns({"island": F.sum("copied").over(here), "total": F.sum("failed").over(here)}).withColumn("in_row", F.sum("failed").over(island))
    parts = local.groupBy("run", "__part").agg(F.sum("failed").alias("failed"), F.max("island").alias("succeeded"), F.max_by("in_row", "__at").alias("tail"))
    ranges = Window.partitionBy("run").orderBy("__part")
    since = parts.withColumn("stretch", F.count_if(F.col("succeeded") > 0).over(ranges.rowsBetween(Window.unboundedPreceding, 0)))
    tails = since.withColumn("tails", F.sum("tail").over(Window.partitionBy("run", "stretch").orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)))
    before = tails.select(F.col("run").alias("__run"), F.col("__part").alias("__in"), runs.earlier(["run"], F.col("failed")).alias("failed_before"), F.coalesce(F.lag("tails").over(ranges), F.lit(0)).alias("row_before"))
    met = local.where("failed = 1").join(before, F.col("run").eqNullSafe(F.col("__run")) & (F.col("__part") == F.col("__in")))
    in_row = F.col("in_row") + F.when(F.col("island") == 0, F.col("row_before")).otherwise(0)
    reason = F.when(in_row >= most_in_a_row, "consecutive").when(F.col("total") + F.col("failed_before") >= most, "total")
    hits = met.withColumn("reason", reason).where("reason IS NOT NULL")
    return hits.groupBy(F.col("run").alias(run)).agg(F.min("ordinal").alias("aborted_at"), F.min_by("reason", "ordinal").alias("reason"))


def snapshot_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, change (created, removed, modified); what lay under a removed directory isn't told again.

    Ancestors are found by exploding each removed path's own prefixes and an equal join, not by comparing all paths.
    """
    old = before.select("path", F.col("stamp").alias("__old"), F.lit(True).alias("__was"))
    both = old.join(after.select("path", F.col("stamp").alias("__new"), F.lit(True).alias("__is")), "path", "full_outer")
    change = F.when(F.col("__was").isNull(), "created").when(F.col("__is").isNull(), "removed").when(~F.col("__old").eqNullSafe(F.col("__new")), "modified")
    changes = both.withColumn("change", change).where("change IS NOT NULL").select("path", "change")
    return collapsed(changes)


def collapsed(changes: DataFrame) -> DataFrame:
    """changes (path, change, ..) without removals of what lay under a path that is removed with it."""
    removed = changes.where("change = 'removed'").select("path").distinct()
    parts = F.split("path", "/")
    ancestors = removed.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("up")).where("up <> path AND up <> ''")
    under = ancestors.join(removed.select(F.col("path").alias("up")), "up", "left_semi").select("path").distinct()
    return changes.join(under.withColumn("__gone", F.lit(True)), "path", "left").where("NOT (change = 'removed' AND __gone <=> true)").drop("__gone")
