"""WARC archives of pages, read back and merged to one ordered capture history.

Each task writes gzip members, one for a record, to archives of its own. Reading an archive back gives a run of
captures sorted by URL key and time. Runs are merged in two levels, both by a loser tree: a task merges those of up to
``FAN`` archives as it reads them, and of the longer runs each range of (URL key, time, page) merges its parts, so the
histories are globally ordered without one task seeing them all. Nothing is sorted after the archives' own runs: a
range takes its rows as they come, and a new run begins wherever the order falls.

Defined results: a null html is an empty payload; a null url has an empty target and key. Of records with equal
payloads of at least ``smallest`` bytes those with the largest page_id are responses (all of them, if the row is
repeated); the others revisit it. A group without any page_id, and payloads below ``smallest``, are responses
throughout. Only page_id, url and html are read; an empty table gives no archives and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from itertools import batched

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framehouse.llm import files
from framehouse.plans.lineage import fresh_path, written

SMALLEST, ARCHIVE_BYTES, FAN, CHUNK = 0, 64 << 20, 8, 1 << 14
FIRST = datetime(2024, 1, 1, tzinfo=timezone.utc)
CAPTURE = "page_id long, url_key string, captured string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long"
CAPTURE_ARROW = pa.schema([("page_id", pa.int64()), ("url_key", pa.string()), ("captured", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def url_key(url: str) -> str:
    """Host labels reversed, then the rest: com,example)/path?query."""
    m = re.match(r"[^:/?#]*://([^/?#]*)([^#]*)", url)
    if not m:
        return url
    host = re.sub(r"^www\.", "", m[1].lower().rpartition("@")[2])
    host, _, port = host.partition(":")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port not in ("", "80", "443") else "") + ")" + (m[2] or "/").lower()


def captured_at(page_id: int | None) -> str:
    """The tables hold no capture time: a second for each page_id after a fixed start stands for it."""
    return (FIRST + timedelta(seconds=(page_id or 0) % (1 << 31))).strftime("%Y-%m-%dT%H:%M:%SZ")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None) -> bytes:
    """A WARC 1.1 record as one gzip member; a revisit has the HTTP header of its payload but not the payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = f"{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{url}')}"
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {captured_at(page_id)}",
        f"WARC-Target-URI: {re.sub(r'[\r\n]', ' ', url)}", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"X-Page-ID: {'' if page_id is None else page_id}",
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        head[2:2] = [f"X-Refers-To-Page: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def write_archives(pages: DataFrame, path: str, smallest: int = SMALLEST, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives under path; archive, bytes, n_records of each. Whether a page revisits is known before its record is written."""
    named = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    keyed = named.withColumn("sha", F.sha1(F.encode("html", "UTF-8")))
    # Only payloads that repeat need their latest page; the aggregation meets before the shuffle, so a hot payload is one row a task.
    again = keyed.where(F.octet_length("html") >= smallest).groupBy("sha").agg(F.count("*").alias("n"), F.max("page_id").alias("latest")).where("n > 1").select("sha", "latest")
    decided = keyed.join(again, "sha", "left").select("page_id", "url", "html", F.when(F.col("latest") > F.col("page_id"), F.col("latest")).when(F.col("page_id").isNull(), F.col("latest")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        made, parts, size = [], [], 0

        def close() -> None:
            nonlocal parts, size
            name = f"part-{task.partitionId():06d}-{len(made):04d}.warc.gz"
            files.put(path, name, f"{task.stageId()}-{task.attemptNumber()}", parts)
            made.append((name, size, len(parts)))
            parts, size = [], 0

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                parts.append(record(row[0], row[1], row[2].encode("utf-8", "surrogatepass"), row[3]))
                size += len(parts[-1])
                if size >= archive_bytes:
                    close()
        if parts:
            close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*made), (pa.string(), pa.int64(), pa.int64()))], ["archive", "bytes", "n_records"])

    return written(decided.mapInArrow(write, "archive string, bytes long, n_records long"), "warc-manifest")


def records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """offset, length, header and block of each gzip member, fed by chunks so that a member costs its own bytes and one chunk."""
    at, view = 0, memoryview(data)
    while at < len(data):
        unzip, parts, end = zlib.decompressobj(31), [], at
        while not unzip.eof:
            if end >= len(data):
                raise ValueError(f"the member at {at} is cut short")
            parts.append(unzip.decompress(view[end : end + CHUNK]))
            end = min(end + CHUNK, len(data))
        end -= len(unzip.unused_data)
        head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        yield at, end - at, fields, rest[: int(fields["Content-Length"])]
        at = end


def capture_key(row: tuple) -> tuple:
    """URL key, time, page, archive and place: the order of the history."""
    return row[1], row[2], -1 if row[0] is None else row[0], row[7], row[8]


def read_captures(archives: DataFrame, path: str, fan: int = FAN) -> DataFrame:
    """A capture for each record, with the digest and length of the payload that the archive gives, in one sorted run a task."""

    def captures(name: str) -> list[tuple]:
        run = []
        for offset, length, f, block in records(files.get(path, name)):
            http, _, payload = block.partition(b"\r\n\r\n")
            page, kind = f["X-Page-ID"], f["WARC-Type"]
            n = int(re.search(rb"Content-Length: (\d+)", http)[1]) if kind == "revisit" else len(payload)
            sha = f["WARC-Payload-Digest"].removeprefix("sha1:") if kind == "revisit" else digest(payload)
            run.append((int(page) if page else None, url_key(f.get("WARC-Target-URI", "")), f["WARC-Date"], n, sha, kind, int(f["X-Refers-To-Page"]) if kind == "revisit" else None, name, offset, length))
        return sorted(run, key=capture_key)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [name for batch in batches for name in batch.column(0).to_pylist()]
        for at in range(0, len(names), fan):
            merged = LoserTree([captures(name) for name in names[at : at + fan]], capture_key)
            for rows in batched(merged, 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*rows), CAPTURE_ARROW)], schema=CAPTURE_ARROW)

    tasks = max(1, -(-archives.count() // fan), archives.sparkSession.sparkContext.defaultParallelism)
    return archives.select("archive").repartition(tasks, "archive").mapInArrow(read, CAPTURE)


class LoserTree:
    """k sorted runs as one: each inner node holds the run that lost there, so a step replays one path of log2 k matches."""

    def __init__(self, runs: list[list], key):
        self.runs, self.key, self.at = runs, key, [0] * len(runs)
        self.k = 1 << max(0, (len(runs) - 1).bit_length())
        self.keys = [self._next(i) for i in range(self.k)]
        self.loser = [0] * self.k
        self.winner = self._play(1)

    def _next(self, i: int) -> tuple:
        """(0, key, run) sorts before (1,), the end of a run."""
        if i >= len(self.runs) or self.at[i] >= len(self.runs[i]):
            return (1,)
        return (0, self.key(self.runs[i][self.at[i]]), i)

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        won, lost = (a, b) if self.keys[a] <= self.keys[b] else (b, a)
        self.loser[node] = lost
        return won

    def __iter__(self) -> Iterator:
        while self.runs and self.keys[self.winner] != (1,):
            i = self.winner
            yield self.runs[i][self.at[i]]
            self.at[i] += 1
            self.keys[i] = self._next(i)
            node = (i + self.k) // 2
            while node:
                if self.keys[self.loser[node]] < self.keys[i]:
                    self.loser[node], i = i, self.loser[node]
                node //= 2
            self.winner = i


def merged_index(captures: DataFrame, n_ranges: int) -> DataFrame:
    """The captures in the order of (URL key, time, page): range by range, each range's runs merged by a loser tree.

    Ranges are over the time and page as well as the URL key, so one hot URL fills many ranges. range_no and position
    number the history.
    """
    schema = f"{CAPTURE}, range_no int, position long"

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: list[list] = []
        last = None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                key = capture_key(row)
                if last is None or key < last:
                    runs.append([])
                runs[-1].append(row)
                last = key
        number, out, n = TaskContext.get().partitionId(), [], 0

        def batch_of(rows: list) -> pa.RecordBatch:
            arrays = [pa.array(list(c), t.type) for c, t in zip(zip(*rows), CAPTURE_ARROW)]
            arrays += [pa.array([number] * len(rows), pa.int32()), pa.array(range(n - len(rows), n), pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, [*CAPTURE_ARROW.names, "range_no", "position"])

        for row in LoserTree(runs, capture_key):
            out.append(row)
            n += 1
            if len(out) == 10_000:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    return captures.repartitionByRange(n_ranges, "url_key", "captured", "page_id").mapInArrow(merge, schema)


def capture_history(pages: DataFrame, path: str | None = None, smallest: int = SMALLEST, range_rows: int = 100_000) -> DataFrame:
    """Write, read back, merge: every record once; history_no numbers them in the global order, position within a range."""
    path = path or fresh_path(pages.sparkSession, "warc")
    archives = write_archives(pages, path, smallest)
    total = archives.agg(F.sum("n_records")).first()[0] or 0
    captures = written(read_captures(archives, path), "warc-captures")
    merged = written(merged_index(captures, max(1, -(-total // range_rows))), "warc-history")
    # A row for each range: how many captures stand before it.
    before, starts = 0, []
    for r in sorted(merged.groupBy("range_no").agg(F.count("*").alias("n")).collect()):
        starts.append((r.range_no, before))
        before += r.n
    offsets = pages.sparkSession.createDataFrame(starts, "range_no int, before long")
    return merged.join(F.broadcast(offsets), "range_no").withColumn("history_no", F.col("before") + F.col("position")).drop("before")
