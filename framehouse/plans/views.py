"""Media tables derived from the driver's tables by arithmetic alone, so that any engine makes the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framehouse.functions import scores

ROOT = "/lib"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def media_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text, at = F.coalesce("text", F.lit("")), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 400).cast("int"))
    return docs.select(
        F.col("doc_id").alias("ordinal"),
        F.concat(F.lit("/src/"), "source", F.lit("/doc_"), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".jpg")).alias("path"),
        F.concat(F.octet_length(text).cast("string"), F.lit("_"), F.md5(text)).alias("identity"),
        F.octet_length(text).cast("long").alias("size"),
        F.when(F.col("doc_id") % 17 != 0, at.cast("timestamp")).alias("captured_at"),
        F.when(F.col("doc_id") % 5 == 0, "low").otherwise("high").alias("confidence"),
    )


def dest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth file is at the destination, numbered by its id, some of them under Duplicate."""
    files = media_files(spark, sf_dir).where("ordinal % 10 = 0")
    day = F.coalesce(F.date_format("captured_at", "yyyy-MM-dd"), F.lit("Unknown"))
    where = F.when(F.col("ordinal") % 30 == 0, f"{ROOT}/Duplicate/").otherwise(f"{ROOT}/")
    name = F.concat(where, F.coalesce(F.date_format("captured_at", "yyyy/MM/dd"), F.lit("Unknown_Date")), F.lit("/"), day, F.lit("_"), F.lpad((F.col("ordinal") % 97).cast("string"), 3, "0"), F.lit(".jpg"))
    return files.select("ordinal", name.alias("path"), "identity", "size")


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    at = F.col("ts").cast("timestamp")
    return events.select(F.date_format(at, "yyyy-MM-dd").alias("day"), "user_id", F.unix_seconds(at).alias("t"), F.col("event_id").cast("string").alias("path"), F.col("event_type").alias("folder"))


def photo_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector is a photo; some have altered copies a few seconds later, so that pairs and triples are near."""
    base = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    flipped = lambda k: F.transform("v", lambda x, i: F.when(i == k, -x).otherwise(x))
    kinds = F.array(
        F.struct(F.lit("a").alias("kind"), F.lit(0).alias("later"), F.col("v").alias("print")),
        F.when(F.col("vec_id") % 3 == 0, F.struct(F.lit("b").alias("kind"), F.lit(2).alias("later"), flipped(F.col("vec_id") % 64).alias("print"))),
        F.when(F.col("vec_id") % 6 == 0, F.struct(F.lit("c").alias("kind"), F.lit(25).alias("later"), flipped((F.col("vec_id") + 7) % 64).alias("print"))),
    )
    each = base.select("vec_id", F.explode(F.array_compact(kinds)).alias("k"))
    n = F.col("vec_id") * 3 + F.ascii("k.kind") - 97
    path = lambda kind: F.concat(F.lit("/lib/"), F.lpad(F.col("vec_id").cast("string"), 6, "0"), F.lit("_"), kind, F.lit(".jpg"))
    rows = each.select(
        path(F.col("k.kind")).alias("path"), (F.col("vec_id") * 60 + F.col("k.later")).alias("t"), F.col("k.print").alias("print"),
        (F.lit(1000) + n * 7919 % 900_000).alias("size"), (F.lit(0.05) + (n * 37 % 100) / 200).alias("sharpness"),
        F.when(n % 4 != 0, (n * 13 % 100) / 100).alias("face"), F.when(n % 3 == 0, (n * 29 % 100) / 100).alias("eyes"), F.when(n % 5 == 0, (n * 31 % 100) / 100).alias("smile"),
        F.lit(4000).alias("pixel_width"), F.when(n % 7 == 0, 2000).otherwise(3000).alias("pixel_height"), (n % 11 == 0).alias("is_raw"),
        F.when((F.col("k.kind") == "a") & (F.col("vec_id") % 12 == 0), path(F.lit("b"))).when((F.col("k.kind") == "b") & (F.col("vec_id") % 12 == 0), path(F.lit("a"))).alias("paired_path"),
    )
    quality = scores.quality(F.col("sharpness"), F.col("face"), F.col("size"), F.col("pixel_width"), F.col("pixel_height"))
    return rows.withColumns({"dhash": scores.sign_bits(F.col("print")), "quality": F.round(quality, 9)})


def cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files as a table of cached identities in two namespaces, some of which don't parse."""
    hash_ = F.when(F.col("ordinal") % 13 == 0, "broken").otherwise(F.col("identity"))
    return media_files(spark, sf_dir).select(F.when(F.col("ordinal") % 3 == 0, 2).otherwise(1).alias("namespace"), "path", hash_.alias("hash"), "size", (F.col("ordinal") + F.lit(0.25)).alias("mtime"))


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, n = F.col("doc_id"), F.col("doc_id").cast("string")
    names = [("dry_run_report_", ".csv"), ("audit_receipt_", ".json"), ("dedupe_audit_receipt_", ".json"), ("reorganize_audit_receipt_", ".json"), ("list_", ".csv"), ("extra_", ".json"), ("IMG_", ".jpg"), ("notes_", ".txt")]
    return table(spark, sf_dir, "documents").select(i.alias("ordinal"), F.element_at(F.array(*[F.concat(F.lit(a), n, F.lit(b)) for a, b in names]), (i % 8 + 1).cast("int")).alias("name"), F.length("text").cast("long").alias("size"))


def copy_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "P", "PENDING").when(F.col("o_orderstatus") == "O", "COPIED").otherwise("FAILED")
    return orders.select(F.col("o_orderkey").alias("ordinal"), F.concat(F.lit("/src/"), F.col("o_orderkey").cast("string")).alias("src_path"), (F.col("o_custkey") % 50).alias("run"), status.alias("status"), F.col("o_totalprice").cast("long").alias("bytes"), F.col("o_orderdate").cast("timestamp").alias("at"))


# The same views in SQL.
SQL = {
    "media": """media AS (SELECT doc_id AS ordinal, '/src/' || source || '/doc_' || lpad(doc_id::VARCHAR, 8, '0') || '.jpg' AS path,
  strlen(coalesce(text, '')) || '_' || md5(coalesce(text, '')) AS identity, strlen(coalesce(text, ''))::BIGINT AS size,
  CASE WHEN doc_id % 17 <> 0 THEN DATE '2020-01-01' + (doc_id % 400)::INT END AS captured,
  CASE WHEN doc_id % 17 <> 0 THEN strftime(DATE '2020-01-01' + (doc_id % 400)::INT, '%Y-%m-%d') ELSE 'Unknown_Date' END AS bucket,
  CASE WHEN doc_id % 5 = 0 THEN 'low' ELSE 'high' END AS confidence FROM documents)""",
    "dest": """dest AS (SELECT ordinal, CASE WHEN ordinal % 30 = 0 THEN '/lib/Duplicate/' ELSE '/lib/' END
  || CASE WHEN captured IS NULL THEN 'Unknown_Date/Unknown' ELSE strftime(captured, '%Y/%m/%d/%Y-%m-%d') END || '_' || lpad((ordinal % 97)::VARCHAR, 3, '0') || '.jpg' AS path, identity, size, bucket
  FROM media WHERE ordinal % 10 = 0)""",
    "seqs": "seqs AS (SELECT bucket, ordinal % 30 = 0 AS is_duplicate, max(ordinal % 97) AS max_seq FROM dest GROUP BY ALL)",
    "judged": """judged AS (SELECT m.*, d.path AS matched_path, CASE WHEN d.path IS NOT NULL THEN 'already_in_destination'
  WHEN row_number() OVER (PARTITION BY m.identity ORDER BY m.ordinal) = 1 THEN 'new' ELSE 'duplicate' END AS status
  FROM media m LEFT JOIN (SELECT identity, max_by(path, ordinal) AS path FROM dest GROUP BY 1) d USING (identity))""",
    "plan": """plan AS (SELECT *, existing + rn AS sequence, greatest(3, length((existing + n_all)::VARCHAR)) AS width FROM (
  SELECT j.*, j.status = 'duplicate' AS is_duplicate, coalesce(s.max_seq, 0) AS existing, row_number() OVER w AS rn, count(*) OVER (PARTITION BY j.bucket, j.status) AS n_all
  FROM judged j LEFT JOIN seqs s ON s.bucket = j.bucket AND s.is_duplicate = (j.status = 'duplicate') WHERE status IN ('new', 'duplicate')
  WINDOW w AS (PARTITION BY j.bucket, j.status ORDER BY j.ordinal)))""",
    "photos": """raw AS (SELECT vec_id, k, CASE k WHEN 'a' THEN 0 WHEN 'b' THEN 2 ELSE 25 END AS later, list_transform(embedding, lambda x: x::DOUBLE) AS v,
    CASE k WHEN 'a' THEN -1 WHEN 'b' THEN vec_id % 64 ELSE (vec_id + 7) % 64 END AS flip
  FROM embeddings, (VALUES ('a', 1), ('b', 3), ('c', 6)) x(k, every) WHERE vec_id % every = 0),
numbered AS (SELECT *, vec_id * 3 + ascii(k) - 97 AS n, list_transform(v, lambda x, i: CASE WHEN i - 1 = flip THEN -x ELSE x END) AS print FROM raw),
photos0 AS (SELECT '/lib/' || lpad(vec_id::VARCHAR, 6, '0') || '_' || k || '.jpg' AS path, vec_id * 60 + later AS t, print,
  1000 + n * 7919 % 900000 AS size, 0.05::DOUBLE + (n * 37 % 100)::DOUBLE / 200 AS sharpness,
  CASE WHEN n % 4 <> 0 THEN (n * 13 % 100)::DOUBLE / 100 END AS face, CASE WHEN n % 3 = 0 THEN (n * 29 % 100)::DOUBLE / 100 END AS eyes, CASE WHEN n % 5 = 0 THEN (n * 31 % 100)::DOUBLE / 100 END AS smile,
  4000 AS pixel_width, CASE WHEN n % 7 = 0 THEN 2000 ELSE 3000 END AS pixel_height, n % 11 = 0 AS is_raw,
  CASE WHEN vec_id % 12 = 0 AND k IN ('a', 'b') THEN '/lib/' || lpad(vec_id::VARCHAR, 6, '0') || CASE k WHEN 'a' THEN '_b.jpg' ELSE '_a.jpg' END END AS paired_path,
  list_aggregate(list_transform(print, lambda x, i: CASE WHEN x > 0 THEN 1::UBIGINT << (i - 1)::UBIGINT ELSE 0::UBIGINT END), 'bit_or') AS dhash FROM numbered),
photos AS (SELECT *, round(0.5 * sharpness + 0.15 * least(1.0, log2(pixel_width::DOUBLE * pixel_height) / 24) + 0.10 * least(1.0, log2(size::DOUBLE) / 26) + 0.25 * coalesce(face, sharpness), 9) AS quality FROM photos0)""",
    "edges": """edges AS (SELECT least(x.path, y.path) AS a, greatest(x.path, y.path) AS b, abs(x.t - y.t) AS t_delta, bit_count(xor(x.dhash, y.dhash))::INT AS hamming,
  sqrt(list_sum(list_transform(list_zip(x.print, y.print), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS distance
  FROM photos x JOIN photos y ON x.path < y.path AND abs(x.t - y.t) <= 30 AND bit_count(xor(x.dhash, y.dhash)) <= 10),
near AS (SELECT * FROM edges WHERE distance <= 0.35)""",
    "members": """prim AS (SELECT path FROM photos WHERE paired_path IS NULL OR path < paired_path),
pnear AS (SELECT * FROM near WHERE a IN (SELECT path FROM prim) AND b IN (SELECT path FROM prim)),
reach AS (SELECT a AS path, b AS other FROM pnear UNION SELECT b, a FROM pnear UNION SELECT r.path, CASE WHEN n.a = r.other THEN n.b ELSE n.a END FROM reach r JOIN pnear n ON n.a = r.other OR n.b = r.other),
heads AS (SELECT path, least(path, min(other)) AS cluster FROM reach GROUP BY path),
members AS (SELECT p.*, m.cluster FROM heads m JOIN photos p USING (path) UNION ALL SELECT q.*, m.cluster FROM heads m JOIN photos p USING (path) JOIN photos q ON q.path = p.paired_path),
ranked AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY quality DESC, sharpness DESC, size DESC, pixel_width * pixel_height DESC, coalesce(face, 0) DESC, coalesce(eyes, 0) DESC, coalesce(smile, 0) DESC, is_raw DESC, path) AS rank FROM members)""",
    "cache": """cache AS (SELECT CASE WHEN ordinal % 3 = 0 THEN 2 ELSE 1 END AS namespace, path, CASE WHEN ordinal % 13 = 0 THEN 'broken' ELSE identity END AS hash, size, ordinal + 0.25::DOUBLE AS mtime FROM media)""",
    "artifacts": """artifacts AS (SELECT doc_id AS ordinal, CASE doc_id % 8 WHEN 0 THEN 'dry_run_report_' || doc_id || '.csv' WHEN 1 THEN 'audit_receipt_' || doc_id || '.json' WHEN 2 THEN 'dedupe_audit_receipt_' || doc_id || '.json'
  WHEN 3 THEN 'reorganize_audit_receipt_' || doc_id || '.json' WHEN 4 THEN 'list_' || doc_id || '.csv' WHEN 5 THEN 'extra_' || doc_id || '.json' WHEN 6 THEN 'IMG_' || doc_id || '.jpg' ELSE 'notes_' || doc_id || '.txt' END AS name, length(text)::BIGINT AS size FROM documents)""",
    "jobs": """jobs AS (SELECT o_orderkey AS ordinal, '/src/' || o_orderkey AS src_path, o_custkey % 50 AS run, CASE o_orderstatus WHEN 'P' THEN 'PENDING' WHEN 'O' THEN 'COPIED' ELSE 'FAILED' END AS status,
  trunc(o_totalprice)::BIGINT AS bytes, o_orderdate AS done FROM orders)""",
}


def with_views(*names: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(SQL[n] for n in names) + "\n"
