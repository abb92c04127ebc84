"""File trees, drop manifests, receipts and profiles as DataFrames. Every scan has an ordinal: the order of discovery."""

from __future__ import annotations

import hashlib
import json
import os
import re
import stat
import unicodedata
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

from framehouse.functions import media
from framehouse.operators import runs
from framehouse.plans.lineage import written

FILES = StructType([StructField("ordinal", LongType()), StructField("path", StringType()), StructField("size", LongType()), StructField("mtime", DoubleType()), StructField("is_directory", BooleanType())])
PACKAGES = (".app", ".bundle", ".framework", ".photoslibrary", ".photolibrary")  # fixed values: directories shown as one file
CHUNK = 1 << 20


def natural_key(name: str) -> list:
    """Digits by their number, the rest without case: near to the order in which file managers list names."""
    folded = unicodedata.normalize("NFC", name).casefold()
    return [(0, int(x), "") if x.isdecimal() else (1, 0, x) for x in re.split(r"(\d+)", folded) if x] + [(2, 0, name)]


def sort_text(name: str, directory: bool, directories_first: bool) -> str:
    """natural_key() as one text that sorts alike, after a sign that keeps files and directories apart."""
    parts = [f"0{len(str(n)):03d}{n}" if kind == 0 else f"{kind}{text}\x02" for kind, n, text in natural_key(name)]
    return f"{int(directory != directories_first)}" + "".join(parts) + "\x01"


LISTED = StructType([*FILES.fields[1:], StructField("place", StringType()), StructField("issue", StringType())])


def listed(directories: DataFrame, directories_first: bool = False) -> DataFrame:
    """What the directories (path, place) hold: a row for each file and directory shown, or one that says what couldn't be read.

    place sorts entries in the order of discovery: below their directory's place, by kind and natural order. Names that
    begin with a dot, links and packages aren't shown; only regular files are files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for top, place in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows: list[tuple] = []
                try:
                    with os.scandir(top) as entries:
                        for e in entries:
                            if e.name.startswith(".") or e.is_symlink() or e.name.lower().endswith(PACKAGES):
                                continue
                            try:
                                s = e.stat(follow_symlinks=False)
                            except OSError as error:
                                rows.append((e.path, None, None, None, None, f"{e.path}: {error.strerror}"))
                                continue
                            directory = stat.S_ISDIR(s.st_mode)
                            if directory or stat.S_ISREG(s.st_mode):
                                rows.append((e.path, s.st_size, s.st_mtime_ns / 1e9, directory, place + sort_text(e.name, directory, directories_first), None))
                except OSError as error:
                    rows.append((top, None, None, None, None, f"{top}: {error.strerror}"))
                for k in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 10_000]), (pa.string(), pa.int64(), pa.float64(), pa.bool_(), pa.string(), pa.string()))], LISTED.fieldNames())

    return directories.mapInArrow(run, LISTED)


def scan_entries(spark: SparkSession, root: str, directories_first: bool = False) -> tuple[DataFrame, DataFrame]:
    """ordinal, path, size, mtime, is_directory of all below root, and path, issue of what couldn't be read.

    The directories of a level are listed in one job, spread over tasks, so a scan takes as many jobs as the tree is deep.
    All executors must see the tree. A directory's files come before its subdirectories, or after them.
    """
    tasks = max(1, spark.sparkContext.defaultParallelism)
    level, found = spark.createDataFrame([(root, "")], "path string, place string"), []
    while True:
        found.append(written(listed(level.repartition(tasks, "path"), directories_first), "tree-level"))
        level = found[-1].where("is_directory").select("path", "place")
        if not level.head(1):
            break
    whole = reduce(DataFrame.unionByName, found)
    numbered = runs.numbered(whole.where("issue IS NULL").withColumn("__tree", F.lit(0)), ["__tree"], ["place"])
    files = numbered.select((F.col("__n") - 1).alias("ordinal"), "path", "size", "mtime", "is_directory")
    return files, whole.where("issue IS NOT NULL").select("path", "issue")


def scan_tree(spark: SparkSession, root: str, media_only: bool = True) -> tuple[DataFrame, DataFrame]:
    """The media files below root (all files and directories, unless media_only), with issues; a directory's files first."""
    files, issues = scan_entries(spark, root)
    if media_only:
        files = files.where(~F.col("is_directory") & media.is_media(F.col("path")) & ~media.is_skipped(media.filename(F.col("path"))))
    return files, issues


def scan_roots(scans: list[DataFrame]) -> DataFrame:
    """Several scans, the first named first; a path that more than one has is the first's."""
    tagged = [s.withColumn("root_no", F.lit(k)) for k, s in enumerate(scans)]
    both = tagged[0]
    for t in tagged[1:]:
        both = both.unionByName(t)
    return both.groupBy("path").agg(F.min_by(F.struct(*both.columns), F.struct("root_no", "ordinal")).alias("r")).select("r.*")


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """ordinal, path, is_directory of a JSON manifest's items, each path at its first place, and issues (path, issue).

    A manifest that isn't such JSON, or isn't there, gives an issue and no items; packages are left out with an issue.
    """
    schema = "items array<struct<path string, isDirectory boolean>>, __bad string"
    try:
        text = spark.read.text(path, wholetext=True).select(F.from_json("value", schema, {"columnNameOfCorruptRecord": "__bad"}).alias("m"))
        sound = text.count() > 0
    except AnalysisException:
        text, sound = spark.createDataFrame([], "m struct<items: array<struct<path: string, isDirectory: boolean>>, __bad: string>"), False
    rows = text.where("m.__bad IS NULL").select(F.posexplode("m.items").alias("ordinal", "i")).select(F.col("ordinal").cast("long").alias("ordinal"), "i.path", F.col("i.isDirectory").alias("is_directory"))
    package = F.coalesce(F.array_max(F.array(*[F.lower("path").endswith(p) for p in PACKAGES])), F.lit(False))
    first = rows.where("path IS NOT NULL").groupBy("path").agg(F.min("ordinal").alias("ordinal"), F.min_by("is_directory", "ordinal").alias("is_directory")).withColumn("__package", package)
    issues = first.where("__package").select("path", F.lit("a package").alias("issue"))
    broken = text.where("m IS NULL OR m.__bad IS NOT NULL OR m.items IS NULL").select(F.lit(path).alias("path"), F.lit("not a manifest").alias("issue"))
    if not sound:
        broken = spark.createDataFrame([(path, "not readable")], "path string, issue string")
    return first.where("NOT __package").select("ordinal", "path", "is_directory"), issues.unionByName(broken)


def with_content_identity(files: DataFrame) -> DataFrame:
    """files with identity ``size_digest``: BLAKE2b of the size's digits and the bytes; null where a file can't be read.

    Spark has no BLAKE2b, so files are hashed in Arrow batches, by parts: no file is held whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [file_identity(p) for p in batch.column(batch.schema.get_field_index("path")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, "identity"])

    return files.mapInArrow(run, StructType([*files.schema.fields, StructField("identity", StringType())]))


def file_identity(path: str) -> str | None:
    try:
        fd = os.open(path, os.O_RDONLY | os.O_NOFOLLOW)
        with os.fdopen(fd, "rb") as f:
            size = os.fstat(f.fileno()).st_size
            h = hashlib.blake2b(str(size).encode())
            while part := f.read(CHUNK):
                h.update(part)
    except OSError:
        return None
    return f"{size}_{h.hexdigest()}"


def read_transfers(spark: SparkSession, path: str, newest: int = 2) -> DataFrame:
    """file, ordinal, source, dest, hash of copy receipts; a receipt without a version is of the first, a newer one fails."""
    schema = "schemaVersion int, transfers array<struct<source string, dest string, hash string>>"
    receipts = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path).withColumn("file", F.input_file_name())
    sound = receipts.where(F.assert_true(F.coalesce("schemaVersion", F.lit(1)) <= newest, F.lit("a receipt of a newer version")).isNull())
    return sound.select("file", F.posexplode("transfers").alias("ordinal", "t")).select("file", "ordinal", "t.source", "t.dest", "t.hash")


def read_moves(spark: SparkSession, path: str) -> DataFrame:
    """source, dest, hash of the completed moves of layout receipts, each receipt's last first."""
    schema = "items array<struct<sourcePath string, destinationPath string, hash string, completed boolean>>"
    moves = spark.read.schema(schema).option("multiLine", True).json(path).select(F.input_file_name().alias("file"), F.posexplode("items").alias("at", "m"))
    return moves.where("m.completed").orderBy("file", F.desc("at")).select(F.col("m.sourcePath").alias("source"), F.col("m.destinationPath").alias("dest"), "m.hash")


def read_review(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, str]:
    """The items of a review's JSON lines, in their order of writing if they have an ordinal, and the filter it opens with.

    needsAttention if any item needs it, else all. A line that doesn't fit fails the read; a file that isn't there has no items.
    """
    try:
        items = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    except AnalysisException:
        items = spark.createDataFrame([], schema)
    attention = items.where("needs_attention").head(1)
    return (items.orderBy("ordinal") if "ordinal" in items.columns else items), "needsAttention" if attention else "all"


SOURCE_LOG = "sourcePath string, firstTransferredAt timestamp, lastTransferredAt timestamp, runCount int, lastCopiedCount int, totalCopiedCount int"


def read_source_log(spark: SparkSession, path: str) -> DataFrame:
    """source, first_run, last_run, n_runs, last_copied, total_copied of a destination's log, the last used first; no rows of one that isn't sound."""
    schema = ArrayType(StructType.fromDDL(SOURCE_LOG))
    none = spark.createDataFrame([], "r struct<" + ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in StructType.fromDDL(SOURCE_LOG).fields) + ">")
    try:
        text = spark.read.text(path, wholetext=True)
        sound = text.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"))
        found = sound.select(F.explode("r").alias("r"))
        whole = found.where("r.sourcePath IS NULL OR r.firstTransferredAt IS NULL OR r.lastTransferredAt IS NULL OR r.runCount IS NULL OR r.lastCopiedCount IS NULL OR r.totalCopiedCount IS NULL").count() == 0
    except (AnalysisException, Py4JJavaError, PySparkException):
        whole, found = False, none
    rows = found if whole else none
    return rows.select(F.col("r.sourcePath").alias("source"), F.col("r.firstTransferredAt").alias("first_run"), F.col("r.lastTransferredAt").alias("last_run"), F.col("r.runCount").alias("n_runs"), F.col("r.lastCopiedCount").alias("last_copied"), F.col("r.totalCopiedCount").alias("total_copied")).orderBy(F.desc("last_run"), "source")


def artifact_kind(name):
    """The kind of a run's artifact by its file name, as a column, the first that fits; null for other files."""
    both = lambda prefix, suffix, kind: (name.startswith(prefix) & name.endswith(suffix), kind)
    rules = [both("dry_run_report_", ".csv", "dryRunReport"), both("dedupe_audit_receipt_", ".json", "dedupeAuditReceipt"), both("reorganize_audit_receipt_", ".json", "reorganizeAuditReceipt"), both("audit_receipt_", ".json", "auditReceipt"), both("", ".csv", "csvArtifact"), both("", ".json", "jsonArtifact")]
    return F.coalesce(*[F.when(fits, kind) for fits, kind in rules])


def read_profiles(spark: SparkSession, text: str) -> DataFrame:
    """name, source, dest of a two-level listing of ``name:`` and indented ``key: value`` lines."""
    rows: dict[str, dict[str, str]] = {}
    name = None
    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        key, _, value = line.strip().partition(":")
        if line[0] not in " \t":
            name = key.strip().strip("\"'")
            rows[name] = {}
        elif name is not None:
            rows[name][key.strip()] = value.strip().strip("\"'")
    return spark.createDataFrame([(n, r.get("source"), r.get("dest")) for n, r in rows.items()], "name string, source string, dest string")


def write_profiles(profiles: list[tuple[str, str, str]]) -> str:
    """The listing again, ``default`` first, then by name without case."""
    order = sorted(profiles, key=lambda p: (p[0] != "default", p[0].casefold()))
    return "".join(f"{json.dumps(n)}:\n  source: {json.dumps(s)}\n  dest: {json.dumps(d)}\n" for n, s, d in order)
