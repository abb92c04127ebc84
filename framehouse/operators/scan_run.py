"""A scan for duplicates, phase by phase: each phase's figures come with its write, so progress costs no job of its own."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framehouse.operators import decisions, review, similarity
from framehouse.plans.lineage import observed


@dataclass
class Phase:
    name: str
    figures: dict
    rows: DataFrame = field(repr=False)


def scan(candidates: DataFrame, th: similarity.Thresholds = similarity.PRESETS["balanced"]) -> Iterator[Phase]:
    """Phases discovery, pairing, exact, edges, near, clusters, summary over photos with an identity; each is given when it is done.

    candidates are photo candidates with identity and, if known, from_cache. The summary's rows are scan_summary() of the
    plan that no explicit decision makes; a caller may stop between phases.
    """
    cached = F.count_if("from_cache") if "from_cache" in candidates.columns else F.lit(0).cast("long")
    photos, told = observed(candidates, "scan-photos", files=F.count("*"), bytes=F.coalesce(F.sum("size"), F.lit(0)), cache_hits=cached)
    yield Phase("discovery", told, photos)
    primaries, told = observed(similarity.primaries(photos), "scan-primaries", primaries=F.count("*"), paired=F.count("paired_path"))
    yield Phase("pairing", told, primaries)
    exact, told = observed(similarity.exact_clusters(photos), "scan-exact", members=F.count("*"), clusters=F.count_if(F.col("path") == F.col("cluster")))
    yield Phase("exact", told, exact)
    edges, copies = similarity.class_pairs(primaries, th)
    edges, told = observed(edges, "scan-edges", edges=F.count("*"), pairs=F.coalesce(F.sum("weight"), F.lit(0)))
    yield Phase("edges", told, edges)
    near, told = observed(similarity.with_partners(similarity.clusters(edges, copies), photos), "scan-near", members=F.count("*"), clusters=F.count_if(F.col("path") == F.col("cluster")))
    yield Phase("near", told, near)
    annotated = similarity.annotated(near, edges)
    known = annotated.select(F.concat(F.lit("near:"), "cluster").alias("cluster"), "confidence")
    both = similarity.all_clusters(near.select("path", "cluster").join(annotated.select("cluster", "kind"), "cluster"), exact)
    whole = both.join(photos, "path").join(known, "cluster", "left").withColumns({"confidence": F.coalesce("confidence", F.lit("high")), "later": (F.col("kind") != "exactDuplicate").cast("int")})
    whole, told = observed(whole, "scan-clusters", members=F.count("*"), exact_members=F.count_if(F.col("kind") == "exactDuplicate"))
    yield Phase("clusters", told, whole)
    members = whole.join(similarity.keepers(whole), "cluster")
    plan = decisions.deletion_plan(members, candidates.sparkSession.createDataFrame([], "path string, decision string"), photos)
    plan, told = observed(plan, "scan-plan", files=F.count("*"), bytes=F.coalesce(F.sum("size"), F.lit(0)))
    yield Phase("summary", told, review.scan_summary(whole.select("cluster", "kind").distinct(), plan, photos))
