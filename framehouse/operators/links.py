"""Paths behind links: the first part of a path that is a link is rewritten until none is, for all paths at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framehouse.functions import media
from framehouse.plans.lineage import written

MOST_LINKS = 40


def plain(path: Column) -> Column:
    """An absolute path without empty parts, ``.`` and ``..`` (which takes away the part before it)."""
    step = lambda done, part: F.when(part.isin("", "."), done).when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, part))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/"))


def prefixes(path: Column) -> Column:
    """The path's parts from the root on, each with all before it; the whole path last."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(2), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def resolved(paths: DataFrame, links: DataFrame, most: int = MOST_LINKS) -> DataFrame:
    """path, real of all distinct paths: null where links lead in a circle, or through more than ``most``.

    links has path and target, which may be relative to the link's directory. Each round rewrites the shortest prefix that
    is a link, as a file system does, and is written; only paths that still have one go on, and those that come to where they
    were go in a circle and end there. Of several targets of a link the smallest counts. Paths that aren't absolute are null.
    """
    rows = paths.select("path").where("path IS NOT NULL").distinct()
    to = links.where("path IS NOT NULL AND target IS NOT NULL").groupBy(plain(F.col("path")).alias("link")).agg(F.min("target").alias("target"))
    absolute = rows.where(F.col("path").startswith("/"))
    now = absolute.select("path", plain(F.col("path")).alias("now"), F.array().cast("array<string>").alias("seen"))
    done = rows.where(~F.col("path").startswith("/")).select("path", F.lit(None).cast("string").alias("real"))
    for _ in range(most + 1):
        each = now.select("path", F.posexplode(prefixes(F.col("now"))).alias("at", "link"))
        first = each.join(to, "link").groupBy("path").agg(F.min_by(F.struct("link", "target"), "at").alias("l"))
        link, target = F.col("l.link"), F.col("l.target")
        there = F.when(target.startswith("/"), target).otherwise(F.concat(media.parent(link), F.lit("/"), target))
        rest = F.substring(F.col("now"), F.length(link) + 1, F.length("now"))
        moved = F.when(F.col("l").isNotNull(), plain(F.concat(there, rest))).otherwise(F.col("now"))
        went = now.join(first, "path", "left").select("path", moved.alias("now"), F.col("l").isNotNull().alias("on"), F.array_append("seen", F.col("now")).alias("seen"))
        step = written(went.withColumn("circle", F.col("on") & F.array_contains("seen", F.col("now"))), "links")
        done = done.unionByName(step.where("NOT on OR circle").select("path", F.when(~F.col("circle"), F.col("now")).alias("real")))
        now = step.where("on AND NOT circle").select("path", "now", "seen")
        if not now.head(1):
            return done
    return done.unionByName(now.select("path", F.lit(None).cast("string").alias("real")))


def contained(paths: DataFrame, root: str, links: DataFrame) -> DataFrame:
    """path, real, inside: whether a path, links followed, is the root or below it; false where it can't be resolved."""
    top = paths.sparkSession.createDataFrame([(root,)], "path string")
    real_root = resolved(top, links).first()["real"]
    if real_root is None:
        return resolved(paths, links).withColumn("inside", F.lit(False))
    return resolved(paths, links).withColumn("inside", F.coalesce((F.col("real") == real_root) | F.col("real").startswith(f"{real_root.rstrip('/')}/"), F.lit(False)))
