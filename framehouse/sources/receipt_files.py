"""Receipts of runs, written by the tasks that did the work: a header that goes from PENDING to COMPLETED or ABORTED, and parts.

``df.write.format("receipt")`` puts the header first, before any row. Each task writes its rows to a part of its own attempt, a JSON
object a line; the commit names the parts of the attempts that count and turns the header to COMPLETED, a failure turns it to
ABORTED with the parts that were whole. Nothing of a run passes through the driver but the names of its parts. A run that
was killed leaves its header PENDING: ``recover`` makes it ABORTED, with every whole line of all its parts.
"""

from __future__ import annotations

import json
import os
import re
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from framehouse.sources import shared_files

#: What a receipt is called, its operation, and the names of its entries.
KINDS = {
    "transfer": ("audit_receipt_", "organize", "transfers"),
    "dedupe": ("dedupe_audit_receipt_", "deduplicate", "items"),
    "reorganize": ("reorganize_audit_receipt_", "reorganize", "items"),
}
VERSION = 2


@dataclass
class Part(WriterCommitMessage):
    name: str
    rows: int


class ReceiptWriter(DataSourceWriter):
    def __init__(self, schema: StructType, options: dict):
        self.folder, self.columns = options["path"].rstrip("/"), schema.fieldNames()
        self.kind = options.get("kind", "transfer")
        self.run = options.get("run") or uuid.uuid4().hex
        prefix, operation, _ = KINDS[self.kind]
        started = time.time()
        self.stem = f"{prefix}{time.strftime('%Y%m%d_%H%M%S', time.gmtime(started))}_{self.run}"
        self.header = {**json.loads(options.get("header", "{}")), "schemaVersion": VERSION, "runID": self.run, "operation": operation, "startedAt": stamp(started), "status": "PENDING"}
        if self.kind == "dedupe":
            self.header["kind"] = "dedupe"
        self._publish({})

    def _publish(self, more: dict) -> None:
        shared_files.replace(self.folder, f"{self.stem}.json", (json.dumps({**self.header, **more}, sort_keys=True) + "\n").encode())

    def write(self, rows: Iterator[Row]) -> Part:
        name, n = f"{self.stem}.{uuid.uuid4().hex}.part", 0
        with shared_files.writer(self.folder, name) as out:
            for row in rows:
                entry = {k: v for k, v in zip(self.columns, row) if v is not None}
                out.write((json.dumps(entry, sort_keys=True, ensure_ascii=False) + "\n").encode("utf-8", "surrogatepass"))
                n += 1
        return Part(name, n)

    def commit(self, messages: list[Part]) -> None:
        self._end("COMPLETED", messages, None)

    def abort(self, messages: list[Part | None]) -> None:
        self._end("ABORTED", messages, "the run failed before it was finished")

    def _end(self, status: str, messages: list, reason: str | None) -> None:
        parts = [m for m in messages if m is not None and m.rows]
        more = {"status": status, "finishedAt": stamp(time.time()), "parts": sorted(p.name for p in parts), "total_jobs": sum(p.rows for p in parts)}
        self._publish(more | ({"abortReason": reason} if reason else {}))
        named = {p.name for p in parts}
        for name in shared_files.listed(self.folder, f"{self.stem}."):  # of attempts that don't count
            if name.endswith(".part") and name not in named:
                shared_files.remove(self.folder, name)


class ReceiptSource(DataSource):
    """Options: path, kind (transfer, dedupe, reorganize), run, and header, a JSON object with more fields of the header."""

    @classmethod
    def name(cls) -> str:
        return "receipt"

    def schema(self) -> str:
        return "source string, dest string, hash string"

    def writer(self, schema: StructType, overwrite: bool) -> ReceiptWriter:
        return ReceiptWriter(schema, dict(self.options))


def stamp(seconds: float) -> str:
    return time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(seconds))


def write_receipt(rows: DataFrame, folder: str, kind: str = "transfer", run: str | None = None, **header: str) -> str:
    """Write rows as a receipt of the kind and give the run's id."""
    rows.sparkSession.dataSource.register(ReceiptSource)
    run = run or uuid.uuid4().hex
    rows.write.format("receipt").mode("append").option("kind", kind).option("run", run).option("header", json.dumps(header)).save(folder)
    return run


def headers(spark: SparkSession, folder: str) -> list[tuple[str, dict]]:
    """name and header of every receipt of the folder: a small file a run. One that isn't JSON is passed over."""
    found = []
    for name in sorted(shared_files.listed(folder, "")):
        if name.endswith(".json") and name.startswith(tuple(prefix for prefix, _, _ in KINDS.values())):
            try:
                header = json.loads(shared_files.read(folder, name))
            except ValueError:
                continue
            if isinstance(header, dict):
                found.append((name, header))
    return found


def entries(spark: SparkSession, folder: str, run: str, schema: str) -> DataFrame:
    """The rows of a run's receipt, once each; lines that are torn or don't fit the schema are left out."""
    parts = next((h.get("parts", []) for _, h in headers(spark, folder) if h.get("runID") == run), [])
    if not parts:
        return spark.createDataFrame([], schema)
    lines = spark.read.text([f"{folder.rstrip('/')}/{p}" for p in parts])
    parsed = lines.select(F.from_json("value", f"{schema}, __bad string", {"columnNameOfCorruptRecord": "__bad"}).alias("r"))
    return parsed.where("r IS NOT NULL AND r.__bad IS NULL").select("r.*").drop("__bad").distinct()


def recover(spark: SparkSession, folder: str) -> list[str]:
    """Turn every PENDING header to ABORTED with all parts of its run, and give the runs' ids. Not for runs still at work.

    Attempts of one task may have written the same rows: entries() gives each once. A torn last line stays in its part.
    """
    done = []
    for name, header in headers(spark, folder):
        if header.get("status") == "PENDING":
            stem = name.removesuffix(".json")
            parts = sorted(p for p in shared_files.listed(folder, f"{stem}.") if p.endswith(".part"))
            more = {"status": "ABORTED", "recoveredAt": stamp(time.time()), "abortReason": "the run was interrupted; what it lists was done", "parts": parts}
            shared_files.replace(folder, name, (json.dumps({**header, **more}, sort_keys=True) + "\n").encode())
            done.append(header.get("runID") or re.sub(r"^.*_", "", stem))
    return done


def whole_receipt(spark: SparkSession, folder: str, run: str, schema: str) -> DataFrame:
    """name, text: a run's receipt as one JSON text with its entries within, as older readers want it. For small runs."""
    name, header = next((n, h) for n, h in headers(spark, folder) if h.get("runID") == run)
    field = next(f for prefix, operation, f in KINDS.values() if operation == header["operation"])
    listed = entries(spark, folder, run, schema).agg(F.to_json(F.collect_list(F.struct("*"))).alias("list"))
    head = json.dumps({k: v for k, v in header.items() if k != "parts"}, sort_keys=True)[:-1]
    return listed.select(F.lit(os.path.basename(name)).alias("name"), F.concat(F.lit(f'{head}, "{field}": '), F.coalesce("list", F.lit("[]")), F.lit("}")).alias("text"))
