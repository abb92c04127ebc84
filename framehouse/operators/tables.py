"""Reading and editing the catalog's tables: cached identities, the copy queue, review overrides, features, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framehouse.functions import media
from framehouse.operators import runs
from framehouse.operators.library import upserted


def cached(cache: DataFrame, namespace: int) -> DataFrame:
    """The raw rows of a namespace, by path."""
    return cache.where(F.col("namespace") == namespace).orderBy("path")


def typed(table: DataFrame, column: str, strict: bool = True) -> DataFrame:
    """table with identity_size and digest of an identity text; one that doesn't parse fails the read, or is left out."""
    parts = media.identity_parts(F.col(column))
    if strict:
        parts = F.when(parts.isNull(), F.raise_error(F.concat(F.lit("not an identity: "), F.coalesce(column, F.lit("null"))))).otherwise(parts)
    found = table.withColumn("__parts", parts)
    return (found if strict else found.where("__parts IS NOT NULL")).withColumns({"identity_size": F.col("__parts.size"), "digest": F.col("__parts.digest")}).drop("__parts")


def counts(table: DataFrame, column: str) -> DataFrame:
    return table.groupBy(column).agg(F.count("*").alias("n"))


def queued(queue: DataFrame, status: str | None = None, by_source: bool = False) -> DataFrame:
    """Jobs of a status, or all, in the order they were first queued, or by source path."""
    return (queue if status is None else queue.where(F.col("status") == status)).orderBy("src_path" if by_source else "ordinal")


def overrides(table: DataFrame) -> DataFrame:
    """The edits by source path; one without a time counts as made at the epoch."""
    return table.withColumn("updated_at", F.coalesce("updated_at", F.lit(0).cast("timestamp"))).orderBy("source_path")


def override_of(table: DataFrame, identity: str, path: str) -> DataFrame:
    return table.where((F.col("identity") == identity) & (F.col("source_path") == path))


def features(table: DataFrame, prints: bool = False) -> DataFrame:
    """The feature rows; without prints the vectors aren't read."""
    return table if prints else table.drop("print")


def prints_of(table: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """path, print of the given paths, or of all that have one; missing ones are passed over."""
    known = table.where("print IS NOT NULL").select("path", "print")
    return known if paths is None else known.join(paths.select("path").distinct(), "path", "left_semi")


def preview_sample(files: DataFrame, each: int = 4) -> DataFrame:
    """folder, path, place of the first media of every folder, in natural order; hidden files don't count.

    A folder's rows meet only after each task has kept its first ones.
    """
    name = media.filename(F.col("path"))
    shown = files.where(media.is_media(F.col("path")) & ~name.startswith(".")).select(media.parent(F.col("path")).alias("folder"), "path", media.natural_key(name).alias("__key"))
    place = F.row_number().over(Window.partitionBy("folder").orderBy("__key", "path"))
    return shown.withColumn("place", place).where(F.col("place") <= each).drop("__key")


def same_content(index: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (digest, size) with each path of the fingerprint index that has them."""
    return asked.select("digest", "size").distinct().join(index.select("digest", "size", "path"), ["digest", "size"])


def with_status(queue: DataFrame, keys: DataFrame, status: str) -> DataFrame:
    """The queue with a status for the given src_paths."""
    hit = keys.select("src_path").distinct().withColumn("__hit", F.lit(True))
    return queue.join(hit, "src_path", "left").withColumn("status", F.when(F.col("__hit"), status).otherwise(F.col("status"))).drop("__hit").select(queue.columns)


def without_status(queue: DataFrame, status: str | None) -> DataFrame:
    """The queue without jobs of a status; without any, if None."""
    return queue.where(F.lit(False) if status is None else ~F.col("status").eqNullSafe(F.lit(status)))


def with_edits(table: DataFrame, edits: DataFrame) -> DataFrame:
    """The overrides after edits (of the same columns and at); one of neither date nor event deletes."""
    name = F.nullif(F.trim("event_name"), F.lit(""))
    after = upserted(table, edits, ["identity", "source_path"], "at").withColumn("event_name", name)
    return after.where("capture_date IS NOT NULL OR event_name IS NOT NULL")


def without_root(index: DataFrame, root: str) -> DataFrame:
    return index.where(~F.col("folder_root").eqNullSafe(F.lit(root)))


def outcomes_applied(queue: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The queue after the outcomes (src_path, at, status) of a run: the last of each pending job; others stay."""
    last = outcomes.groupBy("src_path").agg(F.max_by("status", "at").alias("__new"))
    joined = queue.join(last, "src_path", "left")
    return joined.withColumn("status", F.when(F.col("status") == "PENDING", F.coalesce("__new", "status")).otherwise(F.col("status"))).select(queue.columns)


def log_tail(lines: DataFrame, most_lines: int, most_bytes: int) -> DataFrame:
    """The newest lines (ordinal, text) of a log under both caps: bytes are summed from the end, the older ones cut off.

    Only the newest most_lines can stay, so no more than these meet in the running sum.
    """
    newest = lines.orderBy(F.desc("ordinal")).limit(most_lines)
    held = F.sum(F.octet_length("text")).over(Window.orderBy(F.desc("ordinal")).rowsBetween(Window.unboundedPreceding, 0))
    return newest.withColumn("__held", held).where(F.col("__held") <= most_bytes).drop("__held")


def collision_names(wanted: DataFrame, taken: DataFrame, prefix: str = "_collision_", most: int = 9999) -> DataFrame:
    """ordinal, path, free over requests (ordinal, path): the path itself, or one of its _collision_N names; each is given once.

    The r-th request of a path takes the r-th name that is free, the path itself before its numbers; null where none of
    ``most`` is left. A name is taken if a file has it, or if another request asks for just that name. Of the sorted taken
    numbers, the i-th has (number - i) free ones below it, so the r-th free number is r plus how many of these are below r.
    """
    numbered = runs.numbered(wanted.select("ordinal", "path").where("path IS NOT NULL"), ["path"], ["ordinal"]).drop("__all")
    asked = numbered.where("__n = 1").select("path")
    there = taken.select("path").where("path IS NOT NULL").distinct()
    busy = there.withColumn("__busy", F.lit(1))
    ranked = numbered.join(busy, "path", "left").withColumn("r", F.col("__n") - F.when(F.col("__busy").isNull(), 1).otherwise(0)).select("ordinal", "path", "r")
    # A number belongs to the name in front of it, which may end in another number.
    stem = media.stem(F.col("path"))
    parts = F.regexp_extract(stem, rf"^(.*){prefix}([1-9]\d*)$", 2), F.concat(F.regexp_extract(stem, rf"^(.*){prefix}([1-9]\d*)$", 1), media.suffix(F.col("path")))
    numbers = there.unionByName(asked).distinct().select(parts[1].alias("path"), parts[0].try_cast("int").alias("k")).where(F.col("k").between(1, most))
    # No more than ``most`` numbers and requests of a path meet.
    below = numbers.withColumn("v", F.col("k") - F.row_number().over(Window.partitionBy("path").orderBy("k"))).select("path", F.lit(None).cast("long").alias("ordinal"), F.col("v").cast("long").alias("v"))
    both = below.unionByName(ranked.where((F.col("r") > 0) & (F.col("r") <= most)).select("path", "ordinal", F.col("r").cast("long").alias("v")))
    passed = F.count_if(F.col("ordinal").isNull()).over(Window.partitionBy("path").orderBy("v", F.col("ordinal").isNull()).rowsBetween(Window.unboundedPreceding, 0))
    k = F.col("v") + F.col("passed")
    named = F.when(k <= most, F.concat(stem, F.lit(prefix), k.cast("string"), media.suffix(F.col("path"))))
    given = both.withColumn("passed", passed).where("ordinal IS NOT NULL").select("ordinal", "path", named.alias("free"))
    plain = ranked.where("r = 0").select("ordinal", "path", F.col("path").alias("free"))
    return given.unionByName(plain).unionByName(ranked.where(F.col("r") > most).select("ordinal", "path", F.lit(None).cast("string").alias("free")))


def hit_rate(hits: Column, misses: Column) -> Column:
    return F.coalesce(F.try_divide(hits, hits + misses), F.lit(0.0))
