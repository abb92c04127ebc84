"""What a person reviews: preview items and their edits, history, clusters and the decisions on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = ("needsAttention", "unknownDate", "lowConfidenceDate", "duplicates", "collisions", "ready", "all")
HISTORY = {"reports": ("dryRunReport", "csvArtifact"), "receipts": ("auditReceipt", "dedupeAuditReceipt", "reorganizeAuditReceipt", "jsonArtifact"), "logs": ("runLog", "queueDatabase")}
REVERTIBLE = ("auditReceipt", "dedupeAuditReceipt", "reorganizeAuditReceipt")
KINDS = ("exactDuplicate", "burst", "nearDuplicate", "editedVariant")


def shown(name: str) -> Column:
    """Whether a preview item passes a named filter."""
    has = lambda issue: F.array_contains("issues", issue)
    rules = {"needsAttention": F.col("needs_attention"), "unknownDate": has("unknownDate"), "lowConfidenceDate": has("lowConfidenceDate"), "duplicates": F.col("status") == "duplicate", "collisions": F.col("status") == "already_in_destination", "ready": F.col("status") == "new", "all": F.lit(True)}
    return F.coalesce(rules[name], F.lit(False))


def first_filter(items: DataFrame) -> DataFrame:
    """The items as a review opens: those that need attention if any do, else all."""
    any_ = items.agg(F.coalesce(F.bool_or("needs_attention"), F.lit(False)).alias("any"))
    return items.join(F.broadcast(any_), F.lit(True)).where("needs_attention OR NOT any").drop("any")  # one row


def with_edit(items: DataFrame, edits: DataFrame) -> DataFrame:
    """items after edits (path, capture_date, event_name): a date settles the date issues, an event alone doesn't."""
    e = edits.select("path", F.col("capture_date").alias("__date"), F.nullif(F.trim("event_name"), F.lit("")).alias("__event"), F.lit(True).alias("__edited"))
    joined = items.join(e, "path", "left")
    dated = F.col("__date").isNotNull()
    issues = F.when(dated, F.array_except("issues", F.array(F.lit("unknownDate"), F.lit("lowConfidenceDate")))).otherwise(F.col("issues"))
    attention = F.when(dated, F.array_contains("issues", "hashError")).otherwise(F.col("needs_attention"))
    made = {"issues": issues, "confidence": F.when(dated, "high").otherwise(F.col("confidence")), "event_name": F.when(F.col("__edited"), F.col("__event")).otherwise(F.col("event_name")), "needs_attention": attention}
    return joined.withColumns(made).select(items.columns)


def accepted(items: DataFrame, suggestions: DataFrame, filter_: str = "all") -> DataFrame:
    """path, event_name: what accepting all suggestions (path, name) of the visible items edits."""
    return items.where(shown(filter_)).select("path").join(suggestions.where("name IS NOT NULL").select("path", F.col("name").alias("event_name")), "path")


def filled_back(items: DataFrame, plan: DataFrame) -> DataFrame:
    """The items with the planned path of those that are to be copied."""
    return items.join(plan.select(F.col("source").alias("path"), F.col("dest").alias("planned_path")), "path", "left")


def history_class(kind: Column) -> Column:
    """reports, receipts, logs or other."""
    return F.coalesce(*[F.when(kind.isin(*kinds), name) for name, kinds in HISTORY.items()], F.lit("other"))


def found_in_history(entries: DataFrame, class_: str, text: str) -> DataFrame:
    """Entries (name, kind) of a class, or all, whose name or kind holds the text, case folded."""
    needle = text.strip().lower()
    hit = F.lower("name").contains(needle) | F.lower("kind").contains(needle) if needle else F.lit(True)
    return entries.where((F.lit(True) if class_ == "all" else history_class(F.col("kind")) == class_) & hit)


def revertible(entries: DataFrame) -> DataFrame:
    return entries.where(F.col("kind").isin(*REVERTIBLE)).orderBy(F.desc("at"), "name")


def known_confidence(confidence: Column) -> Column:
    """A cluster that wasn't judged counts as medium."""
    return F.coalesce(confidence, F.lit("medium"))


def triage(clusters: DataFrame) -> DataFrame:
    """kind, confidence, n, in_review over (cluster, kind, confidence), kinds in their fixed order by kind_no."""
    sure = known_confidence(F.col("confidence"))
    kind_no = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    return clusters.groupBy(kind_no.alias("kind_no"), "kind", sure.alias("confidence")).agg(F.count("*").alias("n")).withColumn("in_review", F.col("confidence").isin("medium", "low"))


def decided_for_clusters(members: DataFrame, actions: DataFrame) -> DataFrame:
    """path, decision after actions (cluster, at, action: accept, keepAll, deleteAll) over (cluster, path, keeper): the last wins."""
    last = actions.groupBy("cluster").agg(F.max_by("action", "at").alias("action"))
    decision = F.when(F.col("action") == "keepAll", "keep").when(F.col("action") == "deleteAll", "delete").otherwise(F.when(F.col("path") == F.col("keeper"), "keep").otherwise("delete"))
    return members.join(last, "cluster").select("path", decision.alias("decision"))


def latest_decisions(earlier: DataFrame, later: DataFrame) -> DataFrame:
    """path, decision of both; where both have one the later stands."""
    both = earlier.select("path", "decision", F.lit(0).alias("k")).unionByName(later.select("path", "decision", F.lit(1).alias("k")))
    return both.groupBy("path").agg(F.max_by("decision", "k").alias("decision"))


def kept_of(decided: DataFrame, cluster: str | None = None) -> DataFrame:
    """The members that a cluster, or each, keeps."""
    return decided.where((F.col("decision") == "keep") & (F.lit(True) if cluster is None else F.col("cluster") == cluster))


def reviewed(clusters: DataFrame, approved: DataFrame) -> DataFrame:
    return clusters.join(approved.select("cluster").distinct(), "cluster", "left_semi")


def bytes_by_cluster(plan: DataFrame) -> DataFrame:
    return plan.groupBy("cluster").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))


def scan_summary(clusters: DataFrame, plan: DataFrame, scanned: DataFrame) -> DataFrame:
    """kind, n of clusters (exact and near), with the bytes of the plan, the number of files scanned and, if scanned has
    ``from_cache``, how many were known before and how many not, on every row."""
    cached = F.coalesce(F.count_if("from_cache"), F.lit(0)) if "from_cache" in scanned.columns else F.lit(None).cast("long")
    files = scanned.agg(F.count("*").alias("scanned"), cached.alias("cache_hits")).withColumn("cache_misses", F.col("scanned") - F.col("cache_hits"))
    totals = plan.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("recoverable_bytes")).join(files, F.lit(True))  # one row each
    return clusters.groupBy("kind").agg(F.countDistinct("cluster").alias("n")).join(F.broadcast(totals), F.lit(True))


def months_in_order(months: DataFrame) -> DataFrame:
    """months with place: ascending, Unknown last; a row for a month."""
    return months.withColumn("place", F.row_number().over(Window.orderBy(F.col("month") == "Unknown", "month")))


def range_caption(months: DataFrame) -> DataFrame:
    """caption: the first and last year and the number of files."""
    dated = F.when(F.col("month") != "Unknown", F.substring("month", 1, 4))
    row = months.agg(F.min(dated).alias("a"), F.max(dated).alias("b"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    files = F.concat(F.format_number("n", 0), F.lit(" files"))
    years = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.concat("a", F.lit("–"), "b"))
    return row.select(F.when(F.col("a").isNotNull(), F.concat(years, F.lit(" · "), files)).when(F.col("n") > 0, files).otherwise("—").alias("caption"))
