"""Registered queries that act on files: tasks write them from the rows of a table to the shared folder, act, and tell the outcome."""

from __future__ import annotations

import contextlib
import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framehouse.functions import media
from framehouse.operators import actions
from framehouse.plans import views
from framehouse.plans.catalog import query
from framehouse.plans.lineage import fresh_path, written
from framehouse.sources import metadata, receipt_files
from framehouse.sources.scan import with_content_identity


def folder(spark: SparkSession, name: str) -> str:
    """A new folder that all tasks see as a path; the shared folder must be a mounted one."""
    path = fresh_path(spark, name)
    if not re.match(r"^(file:)?/", path):
        raise ValueError("file actions need a shared folder with a path")
    return re.sub(r"^file:(//)?", "", path)


def put(rows: DataFrame) -> DataFrame:
    """Write rows (path, data) as files. One that stands there is changed in place: to give up its blocks is slow on some file systems."""

    def act(path: str, data: bytes) -> tuple:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with contextlib.suppress(FileNotFoundError):  # a repeated task writes the same bytes again
            with open(path, "r+b") as out:
                out.write(data)
                out.truncate()
            return path, len(data)
        draft = f"{path}.{os.getpid()}.draft"
        with open(draft, "wb") as out:
            out.write(data)
        os.replace(draft, path)
        return path, len(data)

    return actions.each_row(rows, ["path", "data"], act, "path string, size long")


def _bytes(hexed: str) -> Column:
    return F.unhex(F.lit(hexed))


#: A TIFF block with a date, one with an original date and its offset in the other byte order, and a movie's metadata.
DATED = "49492A0008000000" "0100" "32010200140000001A000000" "00000000"
ORIGINAL = "4D4D002A00000008" "0001" "87690004000000010000001A" "00000000" "0002" "900300020000001400000038" "90110002000000070000004C" "00000000"
JPEG, JPEG_END = "FFD8FFE10036457869660000", "FFDA00040000FFD9"
MOVIE = "000000106674797071742020" "00000000" "000000106D646174" "0000000000000000" "000000AE6D6F6F76" "000000A66D657461" "0000002068646C72" + "00" * 24 + "0000003E6B657973" "0000000000000001" "0000002E6D647461"
ITEM = "00000040696C7374" "0000003800000001" "0000003064617461" "0000000100000000"


@query("""WITH f AS (SELECT doc_id, doc_id % 5 AS kind, TIMESTAMP '2001-01-01' + to_hours(doc_id::INT) AS t, md5(coalesce(text, '')) AS id FROM documents)
SELECT doc_id, CASE kind WHEN 0 THEN strftime(t, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(t, '%Y-%m-%d %H:%M:%S') WHEN 2 THEN strftime(t - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') END AS taken_at, CASE WHEN kind = 3 THEN id END AS content_id FROM f""")
def file_metadata(spark, sf_dir):
    """Photos and movies with the dates and identifiers of their rows, read back by ranges; every fifth is cut off."""
    top, i = folder(spark, "media-files"), F.col("doc_id")
    date = F.encode(F.date_format(F.timestamp_seconds(F.lit(978_307_200) + i * 3600), "yyyy:MM:dd HH:mm:ss"), "UTF-8")
    dated = F.concat(_bytes(DATED), date, _bytes("00"))
    original = F.concat(_bytes(ORIGINAL), date, _bytes("00"), F.encode(F.lit("+02:00"), "UTF-8"), _bytes("00"))
    movie = F.concat(_bytes(MOVIE), F.encode(F.lit("com.apple.quicktime.content.identifier"), "UTF-8"), _bytes(ITEM), F.encode(F.md5(F.coalesce("text", F.lit(""))), "UTF-8"))
    kinds = [(dated, ".tif"), (F.concat(_bytes(JPEG), dated, _bytes(JPEG_END)), ".JPG"), (original, ".dng"), (movie, ".MOV"), (F.substring(original, 1, 60), ".nef")]
    pick = lambda at: F.element_at(F.array(*[k[at] if at == 0 else F.lit(k[at]) for k in kinds]), (i % 5 + 1).cast("int"))
    rows = views.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit(f"{top}/"), i.cast("string"), pick(1)).alias("path"), pick(0).alias("data"))
    put(rows)
    return metadata.with_metadata(rows.select("doc_id", "path")).select("doc_id", F.date_format("taken_at", "yyyy-MM-dd HH:mm:ss").alias("taken_at"), "content_id")


def _sources(spark: SparkSession, sf_dir: str, top: str, where: str = "true") -> DataFrame:
    rows = views.table(spark, sf_dir, "documents").where(where)
    return rows.select(F.col("doc_id").alias("ordinal"), F.concat(F.lit(f"{top}/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))


@query("""WITH d AS (SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
o AS (SELECT doc_id, n, CASE WHEN doc_id % 11 = 0 OR doc_id % 7 = 0 THEN 'SKIPPED' ELSE 'COPIED' END AS status FROM d)
SELECT doc_id AS ordinal, status, CASE WHEN status = 'COPIED' THEN n END AS bytes, doc_id || CASE WHEN status = 'COPIED' AND doc_id % 5 = 0 THEN '_collision_1' ELSE '' END || '.txt' AS name, status = 'COPIED' AS in_receipt,
  CASE WHEN status = 'COPIED' THEN CASE WHEN doc_id % 3 = 0 THEN 'skipped' WHEN doc_id % 13 = 0 THEN 'missing' ELSE 'reverted' END END AS reverted FROM o""")
def copied_and_reverted(spark, sf_dir):
    """Whole texts as files: copied with their receipt, some of them changed or removed since, then reverted by what the receipt says."""
    source, dest, logs = (folder(spark, f"media-{k}") for k in ("from", "to", "logs"))
    files = _sources(spark, sf_dir, source)
    put(files.where("ordinal % 11 > 0"))
    put(_sources(spark, sf_dir, dest, "doc_id % 5 = 0").withColumn("data", F.encode(F.lit("another file"), "UTF-8")))
    known = with_content_identity(files.select("ordinal", "path"))
    planned = F.when(F.col("ordinal") % 7 == 0, F.concat(F.lit("0_"), "identity")).otherwise(F.col("identity"))
    jobs = written(known.select("ordinal", F.col("path").alias("source"), F.regexp_replace("path", f"^{source}", dest).alias("dest"), F.coalesce(planned, F.lit("0_gone")).alias("identity")), "copy-jobs")
    outcomes = actions.copy_files(jobs, retries=1)
    done = outcomes.where("status = 'COPIED'")
    run = receipt_files.write_receipt(done.select("ordinal", "source", "dest", F.col("identity").alias("hash")), logs)
    put(actions.spread_out(done.where("ordinal % 3 = 0")).select(F.col("dest").alias("path"), F.encode(F.lit("changed"), "UTF-8").alias("data")))
    actions.trash(done.where("ordinal % 3 > 0 AND ordinal % 13 = 0").select(F.col("dest").alias("path"), F.col("bytes").alias("size")), f"{dest}-bin")
    told = written(receipt_files.entries(spark, logs, run, "ordinal long, source string, dest string, hash string"), "receipt-entries")
    back = actions.revert_copies(told, dest).select("ordinal", F.col("status").alias("reverted"))
    named = outcomes.select("ordinal", "status", "bytes", media.filename(F.col("dest")).alias("name"))
    return named.join(told.select("ordinal", F.lit(True).alias("in_receipt")), "ordinal", "left").join(back, "ordinal", "left").withColumn("in_receipt", F.coalesce("in_receipt", F.lit(False)))


@query("""SELECT doc_id AS ordinal, octet_length(encode(coalesce(text, '')))::BIGINT AS bytes, doc_id % 4 > 0 AS trashed, CASE WHEN doc_id % 4 > 0 AND doc_id % 6 > 0 AND doc_id % 9 > 0 THEN 'restored' ELSE 'failed' END AS restored FROM documents""")
def trashed_and_restored(spark, sf_dir):
    """Files moved to the trash, of which some weren't there, and back where nothing new stands and the root is theirs."""
    top = folder(spark, "media-trash")
    place = F.concat(F.lit(f"{top}/"), F.when(F.col("ordinal") % 9 == 0, "other/").otherwise("lib/"), media.filename(F.col("path")))
    files = _sources(spark, sf_dir, top).withColumn("path", place)
    put(files.where("ordinal % 4 > 0"))
    items = actions.trash(files.select("path", F.octet_length("data").cast("long").alias("size")), f"{top}/bin")
    put(files.where("ordinal % 6 = 0").select("path", F.encode(F.lit("new"), "UTF-8").alias("data")))
    back = actions.restore(items, [f"{top}/lib"]).select(F.col("originalPath").alias("path"), F.col("status").alias("restored"))
    return files.select("ordinal", "path").join(items.select(F.col("originalPath").alias("path"), F.col("sizeBytes").alias("bytes"), F.col("trashURL").isNotNull().alias("trashed")), "path").join(back, "path").drop("path")
