"""Registered queries of the media-catalog operators, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framehouse.functions import media
from framehouse.operators import decisions, events, library, planning, similarity
from framehouse.plans import views
from framehouse.plans.lineage import written
from framehouse.plans.views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
PLAN = ("media", "dest", "seqs", "judged", "plan")
CLUSTERS = ("photos", "edges", "members")


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return register


def _plan(spark: SparkSession, sf_dir: str, **kw) -> DataFrame:
    return planning.copy_plan(views.media_files(spark, sf_dir), views.dest_index(spark, sf_dir), views.ROOT, **kw)


@query(with_views(*PLAN) + """SELECT ordinal, path AS source, identity, bucket, is_duplicate, sequence, width, '/lib/' || CASE WHEN is_duplicate THEN 'Duplicate/' ELSE '' END
  || CASE WHEN captured IS NULL THEN 'Unknown_Date/Unknown' ELSE strftime(captured, '%Y/%m/%d/%Y-%m-%d') END || '_' || CASE WHEN length(sequence::VARCHAR) >= width THEN sequence::VARCHAR ELSE lpad(sequence::VARCHAR, width::INT, '0') END || '.jpg' AS dest FROM plan""")
def copy_plan(spark, sf_dir):
    return _plan(spark, sf_dir).drop("existing")


@query(with_views(*PLAN) + """SELECT path AS source, '/lib/' || CASE WHEN is_duplicate THEN 'Duplicate/' ELSE '' END
  || CASE WHEN captured IS NULL THEN 'Unknown_Date/' || split_part(path, '/', 3) || '/Unknown' ELSE strftime(captured, '%Y/%b/') || split_part(path, '/', 3) || '/' || bucket END
  || '_' || CASE WHEN length(sequence::VARCHAR) >= greatest(2, length((existing + n_all)::VARCHAR)) THEN sequence::VARCHAR ELSE lpad(sequence::VARCHAR, greatest(2, length((existing + n_all)::VARCHAR))::INT, '0') END || '.jpg' AS dest FROM plan""")
def copy_plan_by_event(spark, sf_dir):
    files = views.media_files(spark, sf_dir).withColumn("event_name", media.event_folder(F.col("path"), "/src", F.lit(None).cast("string")))
    return planning.copy_plan(files, views.dest_index(spark, sf_dir), views.ROOT, "yyyy/mon/event", 2).select("source", "dest")


@query(with_views(*PLAN) + "SELECT status, count(*) AS n FROM judged GROUP BY 1")
def plan_counts(spark, sf_dir):
    return planning.plan_counts(views.media_files(spark, sf_dir), views.dest_index(spark, sf_dir))


@query(with_views(*PLAN) + "SELECT path, matched_path FROM judged WHERE matched_path IS NOT NULL")
def already_in_destination(spark, sf_dir):
    return planning.classified(views.media_files(spark, sf_dir), views.dest_index(spark, sf_dir)).where("matched_path IS NOT NULL").select("path", "matched_path")


@query(with_views(*PLAN) + "SELECT path, status FROM judged")
def first_occurrence(spark, sf_dir):
    return planning.classified(views.media_files(spark, sf_dir), views.dest_index(spark, sf_dir)).select("path", "status")


@query(with_views(*PLAN) + "SELECT * FROM seqs")
def dest_seq_max(spark, sf_dir):
    return planning.sequence_maxima(views.dest_index(spark, sf_dir))


@query(with_views(*PLAN) + """SELECT month, count(*) AS n, string_agg(path, '|' ORDER BY is_duplicate, bucket, ordinal) FILTER (r <= 4) AS samples FROM (
  SELECT *, CASE WHEN captured IS NULL THEN 'Unknown' ELSE bucket[1:7] END AS month, row_number() OVER (PARTITION BY CASE WHEN captured IS NULL THEN 'Unknown' ELSE bucket[1:7] END ORDER BY is_duplicate, bucket, ordinal) AS r FROM plan) GROUP BY 1""")
def month_histogram(spark, sf_dir):
    return planning.month_histogram(_plan(spark, sf_dir)).withColumn("samples", F.array_join("samples", "|"))


@query(with_views(*PLAN) + """SELECT bucket, kind, existing, planned, width FROM (SELECT bucket, max(existing) AS existing, count(*) AS planned, greatest(1, length((max(existing) + count(*))::VARCHAR)) AS width,
  CASE WHEN max(existing) > 0 AND length((max(existing) + count(*))::VARCHAR) > length(max(existing)::VARCHAR) THEN 'warning' WHEN max(existing) = 0 AND length(count(*)::VARCHAR) > 1 THEN 'info' END AS kind
  FROM plan WHERE NOT is_duplicate GROUP BY bucket) WHERE kind IS NOT NULL""")
def width_notes(spark, sf_dir):
    return planning.width_notes(_plan(spark, sf_dir, least_width=1), 1)


@query(with_views(*PLAN) + """SELECT count(*) AS total, count(*) FILTER (status = 'new') AS ready, count(*) FILTER (captured IS NULL OR confidence = 'low') AS needs_attention, count(*) FILTER (captured IS NULL) AS unknown_date,
  count(*) FILTER (captured IS NOT NULL AND confidence = 'low') AS low_confidence, count(*) FILTER (status = 'duplicate') AS duplicates, count(*) FILTER (status = 'already_in_destination') AS already_there, 0::BIGINT AS hash_errors FROM judged""")
def review_summary(spark, sf_dir):
    return planning.review_summary(planning.review_items(views.media_files(spark, sf_dir), views.dest_index(spark, sf_dir)))


@query(with_views(*PLAN) + """SELECT path, status, concat_ws('|', CASE WHEN captured IS NULL THEN 'unknownDate' WHEN confidence = 'low' THEN 'lowConfidenceDate' END, CASE status WHEN 'duplicate' THEN 'duplicate' WHEN 'already_in_destination' THEN 'alreadyInDestination' END) AS issues
  FROM judged WHERE captured IS NULL OR confidence = 'low' ORDER BY ordinal LIMIT 250""")
def topk_review(spark, sf_dir):
    items = planning.review_items(views.media_files(spark, sf_dir), views.dest_index(spark, sf_dir))
    return items.where("needs_attention").orderBy("ordinal").limit(250).select("path", "status", F.array_join("issues", "|").alias("issues"))


@query(with_views("media") + """, edits AS (SELECT identity, path AS source_path, DATE '2021-06-01' + (ordinal % 30)::INT AS day, CASE WHEN ordinal % 2 = 0 THEN 'Trip: a/b' END AS event FROM media WHERE ordinal % 7 = 0),
alone AS (SELECT identity, any_value(day) AS day, any_value(event) AS event FROM edits GROUP BY identity HAVING count(*) = 1)
SELECT m.path, CASE WHEN e.identity IS NOT NULL THEN strftime(e.day, '%Y-%m-%d') WHEN a.identity IS NOT NULL THEN strftime(a.day, '%Y-%m-%d') ELSE m.bucket END AS bucket,
  CASE WHEN e.identity IS NOT NULL THEN CASE WHEN e.event IS NOT NULL THEN 'Trip-a-b' END WHEN a.event IS NOT NULL THEN 'Trip-a-b' END AS event_name
FROM media m LEFT JOIN edits e ON e.identity = m.identity AND e.source_path = m.path LEFT JOIN alone a ON a.identity = m.identity""")
def review_overrides(spark, sf_dir):
    files = views.media_files(spark, sf_dir)
    day = F.date_add(F.lit("2021-06-01").cast("date"), (F.col("ordinal") % 30).cast("int"))
    edits = files.where("ordinal % 7 = 0").select("identity", F.col("path").alias("source_path"), day.cast("timestamp").alias("capture_date"), F.when(F.col("ordinal") % 2 == 0, "Trip: a/b").alias("event_name"))
    return planning.with_overrides(files, edits).select("path", media.day_bucket(F.col("captured_at")).alias("bucket"), "event_name")


@query("""WITH c AS (SELECT strftime(ts, '%Y-%m-%d') || '/' || user_id AS bucket, epoch_us(ts) // 1000000 AS t, event_id::VARCHAR AS path, event_type AS folder FROM events),
g AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 7200 THEN 0 ELSE 1 END AS new FROM c WINDOW w AS (PARTITION BY bucket ORDER BY t, path))
SELECT path, bucket || '-' || sum(new) OVER (PARTITION BY bucket ORDER BY t, path ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM g""")
def event_sessions(spark, sf_dir):
    return events.sessions(_captures(spark, sf_dir), 7200).select("path", "session")


def _captures(spark, sf_dir):
    return views.captures(spark, sf_dir).withColumn("bucket", F.concat("day", F.lit("/"), F.col("user_id").cast("string")))


@query("""WITH c AS (SELECT strftime(ts, '%Y-%m-%d') AS bucket, epoch_us(ts) // 1000000 AS t, event_id::VARCHAR AS path, event_type AS folder FROM events),
g AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 300 THEN 0 ELSE 1 END AS new FROM c WINDOW w AS (PARTITION BY bucket ORDER BY t, path)),
s AS (SELECT *, bucket || '-' || sum(new) OVER (PARTITION BY bucket ORDER BY t, path ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM g),
v AS (SELECT session, folder, count(*) AS c FROM s GROUP BY ALL), b AS (SELECT session, folder FROM v QUALIFY row_number() OVER (PARTITION BY session ORDER BY c DESC, lower(folder), folder) = 1)
SELECT session, count(*) AS n, any_value(b.folder) AS name FROM s JOIN b USING (session) GROUP BY session""")
def event_names(spark, sf_dir):
    return events.named(events.sessions(views.captures(spark, sf_dir).withColumnRenamed("day", "bucket"), 300))


@query(with_views("media") + "SELECT path, min(path) OVER w AS cluster, count(*) OVER w AS n FROM media WINDOW w AS (PARTITION BY identity) QUALIFY n > 1")
def exact_clusters(spark, sf_dir):
    return similarity.exact_clusters(views.media_files(spark, sf_dir))


@query(with_views("media") + "SELECT identity AS hash, count(*) - 1 AS copies, (sum(size) - max(size))::BIGINT AS bytes FROM media GROUP BY 1 HAVING count(*) > 1")
def reclaimable_bytes(spark, sf_dir):
    return library.reclaimable(views.media_files(spark, sf_dir).withColumnRenamed("identity", "hash"))


@query(with_views("media") + "SELECT DISTINCT split_part(path, '/', 3) AS folder, split_part(identity, '_', 2) AS digest FROM media")
def folder_digests(spark, sf_dir):
    files = views.media_files(spark, sf_dir)
    return files.select(media.parent_name(F.col("path")).alias("folder"), media.identity_parts(F.col("identity")).digest.alias("digest")).distinct()


@query(with_views("photos", "edges") + "SELECT a, b, t_delta, hamming, round(distance, 6) AS distance FROM near")
def similarity_edges(spark, sf_dir):
    return similarity.pairs(views.photo_candidates(spark, sf_dir)).withColumn("distance", F.round("distance", 6))


@query(with_views("photos") + """SELECT least(x.path, y.path) AS a, greatest(x.path, y.path) AS b, bit_count(xor(x.dhash, y.dhash))::INT AS hamming FROM photos x JOIN photos y ON x.path < y.path AND bit_count(xor(x.dhash, y.dhash)) <= 6
WHERE sqrt(list_sum(list_transform(list_zip(x.print, y.print), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) <= 0.2""")
def similarity_edges_undated(spark, sf_dir):
    return similarity.pairs(views.photo_candidates(spark, sf_dir), similarity.Thresholds(0.20, 6, None)).select("a", "b", "hamming")


def _members(spark, sf_dir):
    """The near clusters with their partners, and the edges: written once, for several passes read them."""
    photos = views.photo_candidates(spark, sf_dir)
    edges, copies = similarity.class_pairs(similarity.primaries(photos))
    edges = written(edges, "photo-edges")
    return written(similarity.with_partners(similarity.clusters(edges, copies), photos), "photo-members"), edges


@query(with_views(*CLUSTERS) + "SELECT path, cluster FROM members")
def near_clusters(spark, sf_dir):
    return _members(spark, sf_dir)[0].select("path", "cluster")


@query(with_views(*CLUSTERS) + "SELECT cluster, path, rank FROM ranked")
def keeper_ranking(spark, sf_dir):
    return similarity.ranked(_members(spark, sf_dir)[0]).select("cluster", "path", F.col("rank").cast("long").alias("rank"))


@query(with_views(*CLUSTERS) + """, k AS (SELECT * FROM ranked WHERE rank = 1), o AS (SELECT r.* FROM ranked r JOIN k USING (cluster) WHERE r.path <> k.path AND r.paired_path IS DISTINCT FROM k.path QUALIFY row_number() OVER (PARTITION BY r.cluster ORDER BY r.quality DESC, r.path DESC) = 1)
SELECT cluster, k.path AS keeper, o.path AS runner_up, concat_ws('|', CASE WHEN k.quality - o.quality > 0.01 THEN 'quality' END, CASE WHEN k.sharpness - o.sharpness > 0.05 THEN 'sharpness' END, CASE WHEN k.face - o.face > 0.05 THEN 'face' END,
  CASE WHEN k.eyes > 0.7 AND o.eyes < 0.5 THEN 'eyes' END, CASE WHEN k.smile - o.smile > 0.15 THEN 'smile' END, CASE WHEN k.pixel_height::DOUBLE / o.pixel_height > 1.1 THEN 'resolution' END, CASE WHEN k.size - o.size > 100000 THEN 'size' END, CASE WHEN k.is_raw AND NOT o.is_raw THEN 'raw' END) AS factors
FROM k JOIN o USING (cluster)""")
def runner_up(spark, sf_dir):
    return similarity.runners_up(_members(spark, sf_dir)[0]).withColumn("factors", F.array_join("factors", "|"))


ANNOTATED = """, reason AS (SELECT m.cluster, avg(distance) AS avg_distance, min(distance) AS min_distance, (sum(hamming) // count(*))::BIGINT AS avg_hamming FROM pnear n JOIN members m ON m.path = n.a GROUP BY 1),
facts AS (SELECT cluster, count(*) AS n, max(t) - min(t) AS span, CASE WHEN max(t) - min(t) <= 10 THEN 'burst' ELSE 'nearDuplicate' END AS kind,
  max(CASE WHEN face > 0.8 THEN 2 WHEN face > 0.3 THEN 1 WHEN face IS NOT NULL THEN 0 END) - min(CASE WHEN face > 0.8 THEN 2 WHEN face > 0.3 THEN 1 WHEN face IS NOT NULL THEN 0 END) AS faces,
  max(pixel_width::DOUBLE / pixel_height) / min(pixel_width::DOUBLE / pixel_height) AS framing, min(sharpness) AS s0, max(sharpness) AS s1, sum(size) FILTER (rank > 1)::BIGINT AS prunable_bytes FROM ranked GROUP BY 1),
told AS (SELECT *, concat_ws('|', CASE WHEN faces >= 1 THEN 'differentPeople' END, CASE WHEN framing > 1.1 THEN 'differentFraming' END, CASE WHEN kind = 'nearDuplicate' AND span > 300 THEN 'largeTimeGap' END, CASE WHEN s0 > 0.01 AND s1 / s0 > 2.5 THEN 'exposure' END) AS warnings FROM facts),
annotated AS (SELECT cluster, n, kind, span, round(avg_distance, 6) AS avg_distance, round(min_distance, 6) AS min_distance, avg_hamming, warnings, prunable_bytes,
  CASE WHEN warnings <> '' THEN 'low' WHEN avg_distance < 0.1 AND span < 5 THEN 'high' WHEN avg_distance > 0.3 THEN 'low' ELSE 'medium' END AS confidence FROM told JOIN reason USING (cluster))
"""


@query(with_views(*CLUSTERS) + ANNOTATED + "SELECT * FROM annotated")
def cluster_annotations(spark, sf_dir):
    told = similarity.annotated(*_members(spark, sf_dir))
    return told.withColumns({"warnings": F.array_join("warnings", "|"), "avg_distance": F.round("avg_distance", 6), "min_distance": F.round("min_distance", 6)})


@query(with_views(*CLUSTERS) + "SELECT path, cluster FROM members WHERE cluster NOT IN (SELECT cluster FROM members GROUP BY 1 HAVING bool_and(size % 2 = 0))")
def superseded_clusters(spark, sf_dir):
    members, _ = _members(spark, sf_dir)
    return similarity.without_superseded(members.select("path", "cluster"), members.where("size % 2 = 0").select("path"))


@query(with_views(*CLUSTERS) + ANNOTATED + """, asked AS (SELECT path, CASE WHEN size % 3 = 0 THEN 'keep' ELSE 'delete' END AS decision FROM photos WHERE size % 5 < 3),
first AS (SELECT r.*, coalesce(d.decision, CASE WHEN confidence = 'high' AND rank > 1 THEN 'delete' ELSE 'keep' END) AS d0 FROM ranked r JOIN annotated USING (cluster) LEFT JOIN asked d ON d.path = r.path),
wins AS (SELECT f.*, CASE WHEN d0 = 'delete' AND EXISTS (SELECT 1 FROM first k WHERE k.path = f.paired_path AND k.d0 = 'keep') THEN 'keep' ELSE d0 END AS d1 FROM first f),
safe AS (SELECT * FROM wins WHERE cluster IN (SELECT cluster FROM wins WHERE d1 = 'keep')),
direct AS (SELECT path, size, cluster, paired_path FROM safe WHERE d1 = 'delete')
SELECT path, size, cluster, NULL::VARCHAR AS origin FROM direct UNION ALL
SELECT p.path, p.size, d.cluster, d.path FROM direct d JOIN photos p ON p.path = d.paired_path WHERE p.path NOT IN (SELECT path FROM safe WHERE d1 = 'keep') AND p.path NOT IN (SELECT path FROM direct)""")
def deletion_plan(spark, sf_dir):
    members, edges = _members(spark, sf_dir)
    told = similarity.annotated(members, edges).select("cluster", "confidence").join(similarity.keepers(members), "cluster")
    asked = views.photo_candidates(spark, sf_dir).where("size % 5 < 3").select("path", F.when(F.col("size") % 3 == 0, "keep").otherwise("delete").alias("decision"))
    return decisions.deletion_plan(members.join(told, "cluster"), asked, views.photo_candidates(spark, sf_dir))


@query("""WITH f AS (SELECT doc_id, '/x/' || CASE doc_id % 6 WHEN 0 THEN 'IMG_' || d || '_101112' WHEN 1 THEN 'VID-' || d || '-WA0001' WHEN 2 THEN d || '_101112' WHEN 3 THEN 'trip ' || d[1:4] || '-' || d[5:6] || '-' || d[7:8] WHEN 4 THEN 'a_' || d || '_b' ELSE 'plain ' || d END || '.jpg' AS path, d, doc_id % 6 AS kind
  FROM (SELECT doc_id, (1890 + doc_id % 230)::VARCHAR || lpad((1 + doc_id % 13)::VARCHAR, 2, '0') || lpad((1 + doc_id % 31)::VARCHAR, 2, '0') AS d FROM documents))
SELECT path, CASE WHEN kind < 5 AND d[1:4]::INT BETWEEN 1900 AND 2100 THEN strftime(try_strptime(d, '%Y%m%d'), '%Y-%m-%d') END AS day FROM f""")
def filename_dates(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    pad = lambda x: F.lpad(x.cast("string"), 2, "0")
    y, m, d = (1890 + i % 230).cast("string"), pad(1 + i % 13), pad(1 + i % 31)
    day = F.concat(y, m, d)
    names = [F.concat(F.lit("IMG_"), day, F.lit("_101112")), F.concat(F.lit("VID-"), day, F.lit("-WA0001")), F.concat(day, F.lit("_101112")), F.concat(F.lit("trip "), y, F.lit("-"), m, F.lit("-"), d), F.concat(F.lit("a_"), day, F.lit("_b")), F.concat(F.lit("plain "), day)]
    path = F.concat(F.lit("/x/"), F.element_at(F.array(*names), (i % 6 + 1).cast("int")), F.lit(".jpg"))
    return docs.select(path.alias("path")).select("path", F.date_format(media.filename_date(F.col("path")), "yyyy-MM-dd").alias("day"))


@query(with_views("media") + """SELECT ordinal, CASE WHEN ordinal % 3 = 0 AND captured IS NOT NULL THEN 'photoMetadata' WHEN ordinal % 4 = 0 THEN 'fileSystemCreated' WHEN ordinal % 5 = 0 THEN 'fileSystemModified' ELSE 'unknown' END AS source,
  CASE WHEN ordinal % 3 = 0 AND captured IS NOT NULL THEN 'high' WHEN ordinal % 4 = 0 OR ordinal % 5 = 0 THEN 'low' ELSE 'unknown' END AS confidence FROM media""")
def resolved_dates(spark, sf_dir):
    at = lambda k, t: F.when(F.col("ordinal") % k == 0, t)
    fixed = F.lit("2019-05-05").cast("timestamp")
    date = media.resolved_date(F.col("path"), at(3, F.col("captured_at")), at(4, fixed), at(5, fixed))
    return views.media_files(spark, sf_dir).select("ordinal", date.source.alias("source"), date.confidence.alias("confidence"))


def _library(spark, sf_dir):
    """The destination with events, and some names that no plan writes."""
    odd = F.when(F.col("ordinal") % 50 == 0, F.regexp_replace("path", r"\.jpg$", "_collision_1.jpg")).when(F.col("ordinal") % 70 == 0, F.concat(F.lit("/lib/"), media.filename(F.col("path")))).otherwise(F.col("path"))
    return views.dest_index(spark, sf_dir).withColumn("path", odd)


LIBRARY = """, lib AS (SELECT ordinal, identity, size, bucket, CASE WHEN ordinal % 50 = 0 THEN regexp_replace(path, '\\.jpg$', '_collision_1.jpg') WHEN ordinal % 70 = 0 THEN '/lib/' || regexp_extract(path, '[^/]*$') ELSE path END AS path FROM dest),
target AS (SELECT path, CASE WHEN ordinal % 50 <> 0 THEN CASE WHEN path LIKE '/lib/Duplicate/%' THEN '/lib/Duplicate/' ELSE '/lib/' END || CASE WHEN bucket = 'Unknown_Date' THEN 'Unknown_Date/' ELSE LAYOUT END || regexp_extract(path, '[^/]*$') END AS dest FROM lib)
"""


@query(with_views("media", "dest") + LIBRARY.replace("LAYOUT", "bucket[1:4] || '/' || bucket[6:7] || '/'") + "SELECT path, dest, CASE WHEN dest IS NULL THEN 'unrecognized' WHEN dest = path THEN 'unchanged' ELSE 'move' END AS status FROM target")
def layout_moves(spark, sf_dir):
    return library.layout_moves(_library(spark, sf_dir), views.ROOT, "yyyy/mm")


@query(with_views("media", "dest", "jobs", "artifacts") + LIBRARY.replace("LAYOUT", "''") + """, tree AS (SELECT *, path LIKE '%/Unknown!_Date/%' ESCAPE '!' OR regexp_extract(path, '[^/]*$') LIKE 'Unknown!_%' ESCAPE '!' AS unknown, regexp_extract(path, '[^/]*$') AS name FROM lib),
copies AS (SELECT count(*) - 1 AS n, sum(size) - max(size) AS b FROM media GROUP BY identity), q AS (SELECT count(*) FILTER (status = 'PENDING') AS p, count(*) FILTER (status = 'FAILED') AS f FROM jobs),
cards AS (SELECT 'ready' AS card, 1::BIGINT AS value, 0::BIGINT AS bytes, 0 AS severity UNION ALL
  SELECT 'unknown-dates', count(*), coalesce(sum(size), 0)::BIGINT, (count(*) > 0)::INT FROM tree WHERE unknown UNION ALL
  SELECT 'duplicates', greatest(n, (SELECT sum(n) FROM copies))::BIGINT, greatest(b, (SELECT sum(b) FROM copies))::BIGINT, (greatest(n, (SELECT sum(n) FROM copies)) > 0)::INT FROM (SELECT count(*) AS n, coalesce(sum(size), 0) AS b FROM tree WHERE NOT unknown AND path LIKE '%/Duplicate/%') UNION ALL
  SELECT 'interrupted-work', p + f, 0, CASE WHEN f > 0 THEN 2 WHEN p > 0 THEN 1 ELSE 0 END FROM q UNION ALL
  SELECT 'history', count(*), 0, (count(*) = 0)::INT FROM artifacts WHERE starts_with(name, 'audit_receipt_') OR starts_with(name, 'dedupe_audit_receipt_') UNION ALL
  SELECT 'structure-drift', count(*), 0, (count(*) > 0)::INT FROM tree WHERE NOT (starts_with(name, 'Unknown_') OR (length(name) >= 15 AND regexp_matches(name, '^[0-9]{4}-[0-9]{2}-[0-9]{2}_'))))
SELECT *, (SELECT max(severity) FROM cards) AS overall FROM cards""")
def health_cards(spark, sf_dir):
    cache = views.media_files(spark, sf_dir).withColumnRenamed("identity", "hash")
    return library.health_cards(_library(spark, sf_dir), cache, views.copy_jobs(spark, sf_dir), views.artifacts(spark, sf_dir))


@query(with_views("jobs") + "SELECT status, count(*) AS n, sum(bytes)::BIGINT AS bytes FROM jobs GROUP BY 1")
def queue_counts(spark, sf_dir):
    return views.copy_jobs(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


@query(with_views("jobs") + """SELECT ordinal, src_path, CASE WHEN ordinal % 3 = 0 THEN 'COPIED' ELSE status END AS status FROM jobs UNION ALL SELECT ordinal + 100000000, '/new/' || ordinal, 'PENDING' FROM jobs WHERE ordinal % 9 = 0""")
def queue_upsert(spark, sf_dir):
    jobs = views.copy_jobs(spark, sf_dir).select("ordinal", "src_path", "status")
    later = F.col("ordinal") + 100_000_000
    changes = jobs.where("ordinal % 3 = 0").select(later.alias("ordinal"), "src_path", F.lit("COPIED").alias("status"))
    new = jobs.where("ordinal % 9 = 0").select(later.alias("ordinal"), F.concat(F.lit("/new/"), F.col("ordinal").cast("string")).alias("src_path"), F.lit("PENDING").alias("status"))
    return library.upserted(jobs, changes.unionByName(new), ["src_path"], "ordinal", keep="ordinal")


@query(with_views("media") + """SELECT path, CASE WHEN ordinal % 4 = 0 THEN 'changed' ELSE identity END AS hash, size FROM media WHERE ordinal % 6 <> 5""")
def cache_upsert(spark, sf_dir):
    files = views.media_files(spark, sf_dir)
    cache = files.select("path", F.col("identity").alias("hash"), "size")
    one = files.where("ordinal % 4 = 0").select("path", F.lit("older").alias("hash"), "size", F.lit(1).alias("at"))
    two = files.where("ordinal % 4 = 0").select("path", F.lit("changed").alias("hash"), "size", F.lit(2).alias("at"))
    return library.deleted(library.upserted(cache, one.unionByName(two), ["path"], "at"), files.where("ordinal % 6 = 5"), ["path"])


@query(with_views("media") + "SELECT path, size FROM media WHERE ordinal % 3 <> 0")
def stale_prune(spark, sf_dir):
    files = views.media_files(spark, sf_dir)
    return library.pruned(files.select("path", "size"), files.where("ordinal % 3 <> 0"))


@query(with_views("media") + """, gone AS (SELECT path FROM media WHERE ordinal % 11 = 0)
SELECT path, 'removed' AS change FROM gone UNION ALL SELECT path, 'modified' FROM media WHERE ordinal % 11 <> 0 AND ordinal % 13 = 0 UNION ALL SELECT '/gone', 'removed' UNION ALL SELECT '/new' || path, 'created' FROM media WHERE ordinal % 19 = 0""")
def snapshot_diff(spark, sf_dir):
    files = views.media_files(spark, sf_dir).select("ordinal", "path", F.col("size").alias("stamp"))
    under = files.where("ordinal % 23 = 0").select(F.concat(F.lit("/gone"), "path").alias("path"), "stamp")
    before = files.select("path", "stamp").unionByName(under).unionByName(spark.range(1).select(F.lit("/gone").alias("path"), F.lit(0).cast("long").alias("stamp")))
    after = files.where("ordinal % 11 <> 0").select("path", F.when(F.col("ordinal") % 13 == 0, -1).otherwise(F.col("stamp")).alias("stamp"))
    new = files.where("ordinal % 19 = 0").select(F.concat(F.lit("/new"), "path").alias("path"), "stamp")
    return library.snapshot_changes(before, after.unionByName(new))


@query(with_views("jobs") + ", d AS (SELECT strftime(done, '%Y-%m-%d') AS day, count(*) AS n FROM jobs GROUP BY 1) SELECT day, n, sum(n) OVER (ORDER BY day)::BIGINT AS runs FROM d")
def history_by_day(spark, sf_dir):
    return library.running_count(library.by_day(views.copy_jobs(spark, sf_dir), F.col("at")))


@query(with_views(*PLAN) + """, m AS (SELECT CASE WHEN captured IS NULL THEN 'Unknown' ELSE bucket[1:7] END AS month, count(*) AS n FROM plan GROUP BY 1)
SELECT month, n, greatest(0, least(n, 500 - (sum(n) OVER (ORDER BY month) - n)))::BIGINT AS filled FROM m""")
def waterfall_fill(spark, sf_dir):
    months = planning.month_histogram(_plan(spark, sf_dir)).select("month", "n")
    return library.bar_fills(months, 500)


@query(with_views("jobs") + """SELECT run::VARCHAR AS source, min(strftime(done, '%Y-%m-%d')) AS first_run, max(strftime(done, '%Y-%m-%d')) AS last_run, count(*) AS n_runs, arg_max(bytes, (done, bytes)) AS last_copied, sum(bytes)::BIGINT AS total_copied FROM jobs GROUP BY 1""")
def source_log(spark, sf_dir):
    runs = views.copy_jobs(spark, sf_dir).select(F.col("run").cast("string").alias("source"), "at", F.col("bytes").alias("copied"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return library.source_log(runs).select("source", day("first_run"), day("last_run"), "n_runs", "last_copied", "total_copied")


@query(with_views("jobs") + """, c AS (SELECT *, sum((status = 'COPIED')::INT) OVER w AS island, sum((status = 'FAILED')::INT) OVER w AS total FROM jobs WINDOW w AS (PARTITION BY run ORDER BY ordinal ROWS UNBOUNDED PRECEDING)),
i AS (SELECT *, sum((status = 'FAILED')::INT) OVER (PARTITION BY run, island ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS in_row FROM c)
SELECT run, ordinal AS aborted_at, CASE WHEN in_row >= 5 THEN 'consecutive' ELSE 'total' END AS reason FROM i WHERE status = 'FAILED' AND (in_row >= 5 OR total >= 20) QUALIFY row_number() OVER (PARTITION BY run ORDER BY ordinal) = 1""")
def abort_points(spark, sf_dir):
    return library.abort_points(views.copy_jobs(spark, sf_dir), "run")


@query(with_views("media") + """SELECT '/p/' || split_part(path, '/', 3) || '/' || ordinal || '.dng' AS raw, '/p/' || split_part(path, '/', 3) || '/' || ordinal || CASE WHEN ordinal % 2 = 0 THEN '.HEIC' ELSE '.jpg' END AS photo FROM media WHERE ordinal % 3 = 0""")
def raw_pairs(spark, sf_dir):
    files = views.media_files(spark, sf_dir)
    base = F.concat(F.lit("/p/"), media.parent_name(F.col("path")), F.lit("/"), F.col("ordinal").cast("string"))
    names = F.array_compact(F.array(F.concat(base, F.lit(".jpg")), F.when(F.col("ordinal") % 2 == 0, F.concat(base, F.lit(".HEIC"))), F.when(F.col("ordinal") % 3 == 0, F.concat(base, F.lit(".dng")))))
    listed = files.select("ordinal", F.posexplode(names).alias("k", "path")).select((F.col("ordinal") * 4 + F.col("k")).alias("ordinal"), "path")
    return similarity.raw_pairs(listed)


#: A photo's names by its ordinal: some are RAW with JPEG, some HEIC with one or two movies, some both, some only look like it.
PAIRED = """, each AS (SELECT ordinal, identity || ordinal // 2 AS content_id, '/l/' || split_part(path, '/', 3) || '/' || (ordinal // 2) || '/' || ordinal AS base FROM media),
names AS (SELECT base || '.HEIC' AS path, ordinal * 8 AS ordinal, content_id FROM each WHERE ordinal % 3 < 2 UNION ALL SELECT base || CASE WHEN ordinal % 2 = 0 THEN '.MOV' ELSE '.m4v' END, ordinal * 8 + 1, content_id FROM each WHERE ordinal % 4 < 3
  UNION ALL SELECT base || '.dng', ordinal * 8 + 2, NULL FROM each WHERE ordinal % 5 < 2 UNION ALL SELECT base || '.jpg', ordinal * 8 + 3, content_id FROM each WHERE ordinal % 7 < 3 UNION ALL SELECT base || '.png', ordinal * 8 + 4, content_id FROM each),
live AS (SELECT h.path AS photo, m.path AS movie, h.ordinal AS ph, m.ordinal AS mo FROM names h JOIN names m ON h.content_id = m.content_id AND regexp_extract(h.path, '^(.*)/', 1) = regexp_extract(m.path, '^(.*)/', 1)
  WHERE h.path LIKE '%.HEIC' AND (m.path LIKE '%.MOV' OR m.path LIKE '%.m4v') QUALIFY row_number() OVER (PARTITION BY h.path ORDER BY m.ordinal DESC) = 1)
"""


def _paired_names(spark, sf_dir):
    files, i = views.media_files(spark, sf_dir), F.col("ordinal")
    half = F.floor(i / 2).cast("string")
    base = F.concat(F.lit("/l/"), media.parent_name(F.col("path")), F.lit("/"), half, F.lit("/"), i.cast("string"))
    name = lambda k, tail, when, known=True: F.when(when, F.struct(F.concat("base", tail).alias("path"), (i * 8 + k).alias("ordinal"), (F.col("content_id") if known else F.lit(None).cast("string")).alias("content_id")))
    each = files.select("ordinal", F.concat("identity", half).alias("content_id"), base.alias("base"))
    movie = F.when(i % 2 == 0, ".MOV").otherwise(".m4v")
    names = F.array_compact(F.array(name(0, F.lit(".HEIC"), i % 3 < 2), name(1, movie, i % 4 < 3), name(2, F.lit(".dng"), i % 5 < 2, False), name(3, F.lit(".jpg"), i % 7 < 3), name(4, F.lit(".png"), F.lit(True))))
    return each.select(F.explode(names).alias("n")).select("n.*")


@query(with_views("media") + PAIRED + "SELECT photo, movie FROM live")
def live_pairs(spark, sf_dir):
    return similarity.live_pairs(_paired_names(spark, sf_dir))


@query(with_views("media") + PAIRED + """, raws AS (SELECT regexp_replace(path, '\\.[^.]*$', '') AS base, max_by(path, ordinal) FILTER (path LIKE '%.dng') AS raw, max_by(path, ordinal) FILTER (path LIKE '%.jpg' OR path LIKE '%.HEIC') AS photo FROM names GROUP BY 1),
every AS (SELECT photo AS path, movie AS partner, 'livePhoto' AS kind, 1 AS r, mo AS o FROM live UNION ALL SELECT movie, photo, 'livePhoto', 1, ph FROM live
  UNION ALL SELECT raw, photo, 'rawJpeg', 0, 0 FROM raws WHERE raw IS NOT NULL AND photo IS NOT NULL UNION ALL SELECT photo, raw, 'rawJpeg', 0, 0 FROM raws WHERE raw IS NOT NULL AND photo IS NOT NULL)
SELECT path, partner, kind FROM every QUALIFY row_number() OVER (PARTITION BY path ORDER BY r DESC, o DESC) = 1""")
def pair_table(spark, sf_dir):
    return similarity.pair_table(_paired_names(spark, sf_dir))
