"""What is to be deleted: decisions, the rules of pairs, and the rail that leaves no cluster empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framehouse.functions import media
from framehouse.plans.lineage import written

PAIR_KINDS = ("rawJpeg", "livePhoto")


def is_automatic(confidence: Column) -> Column:
    """Whether a cluster may be decided without a person."""
    return confidence == "high"


def effective(members: DataFrame, decisions: DataFrame) -> DataFrame:
    """members (cluster, path, keeper, confidence, paired_path, ..) with decision: the explicit one; else, with high
    confidence, keep the keeper and delete the others; else keep."""
    auto = F.when(is_automatic(F.col("confidence")) & (F.col("path") != F.col("keeper")), "delete").otherwise("keep")
    joined = members.join(decisions.select("path", F.col("decision").alias("__d")), "path", "left")
    return joined.withColumn("decision", F.coalesce("__d", auto)).drop("__d")


def of_pair_kinds(members: DataFrame, kinds: tuple[str, ...] = PAIR_KINDS) -> DataFrame:
    """members with paired_path only where the pair is of a kind that is kept or deleted as one."""
    still = F.col("is_live_still") if "is_live_still" in members.columns else F.lit(False)
    kind = media.pair_kind(still, F.col("paired_path"))
    return members.withColumn("paired_path", F.when(kind.isin(*kinds) if kinds else F.lit(False), F.col("paired_path")))


def one_decision(decided: DataFrame) -> DataFrame:
    """A path of several clusters has the decision of the last: of the highest ``later``, if there is such a column."""
    if "later" not in decided.columns:
        return decided
    each = decided.groupBy("path").agg(F.max_by("decision", F.struct("later", "cluster")).alias("__last"))
    return decided.join(each, "path").withColumn("decision", F.col("__last")).drop("__last")


def keep_wins(decided: DataFrame) -> DataFrame:
    """A member whose partner is kept, or that a kept member names as its partner, is kept: one pass over the decisions as they were."""
    kept = decided.where("decision = 'keep'")
    partners = kept.select(F.col("path").alias("paired_path")).distinct().withColumn("__kept", F.lit(True))
    named = kept.where("paired_path IS NOT NULL").select(F.col("paired_path").alias("path")).distinct().withColumn("__named", F.lit(True))
    joined = decided.join(partners, "paired_path", "left").join(named, "path", "left")
    saved = F.coalesce("__kept", "__named", F.lit(False)) & (F.col("decision") == "delete")
    return joined.withColumn("decision", F.when(saved, "keep").otherwise(F.col("decision"))).drop("__kept", "__named")


def never_empty(decided: DataFrame) -> DataFrame:
    """Only members of clusters in which something is kept."""
    some = decided.groupBy("cluster").agg(F.max(F.col("decision") == "keep").alias("some")).where("some").select("cluster")
    return decided.join(some, "cluster", "left_semi")


def deletion_plan(members: DataFrame, decisions: DataFrame, files: DataFrame, pair_overrides: DataFrame | None = None, kinds: tuple[str, ...] = PAIR_KINDS) -> DataFrame:
    """path, size, cluster, origin (null, or the deleted member whose partner this is), each path once.

    Pairs of other kinds than ``kinds`` aren't treated as one. A path of several clusters counts for the last.
    """
    later = F.col("later") if "later" in members.columns else F.lit(0)
    # Written once: what is decided directly, what is kept and what a partner follows all read it.
    decided = written(never_empty(keep_wins(one_decision(effective(of_pair_kinds(members, kinds), decisions)))).select("path", "size", "cluster", "paired_path", "decision", later.alias("later")), "decided")
    direct = decided.where("decision = 'delete'").groupBy("path").agg(F.max("size").alias("size"), F.max_by("cluster", F.struct("later", "cluster")).alias("cluster"), F.max("paired_path").alias("paired_path"))
    kept = decided.where("decision = 'keep'").select("path").distinct()
    partners = direct.where("paired_path IS NOT NULL").groupBy(F.col("paired_path").alias("path")).agg(F.min(F.struct(F.col("path").alias("origin"), "cluster")).alias("o"))
    partners = partners.join(kept, "path", "left_anti").join(direct, "path", "left_anti")
    if pair_overrides is not None:
        partners = partners.join(pair_overrides, "path", "left_anti")
    sized = partners.join(files.select("path", F.col("size").cast("long").alias("size")), "path").select("path", "size", "o.cluster", "o.origin")
    return direct.select("path", F.col("size").cast("long").alias("size"), "cluster", F.lit(None).cast("string").alias("origin")).unionByName(sized)
