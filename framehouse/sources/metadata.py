"""Camera dates and live-photo identifiers from the files themselves, by ranged reads: no file is read whole.

Tasks walk the little that they need of a file: the segments of a JPEG or the boxes of a HEIC to its TIFF block, the
directories of that block, the nested boxes of a movie. What doesn't parse, ends early or points back to where it came
from gives nulls. The texts found are turned to instants by Spark's own functions.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from framehouse.functions import media

#: TIFF tags, and the names of boxes and keys.
DATE, EXIF, ORIGINAL, ORIGINAL_OFFSET, MAKER_NOTE = 0x0132, 0x8769, 0x9003, 0x9011, 0x927C
MAKER, CONTENT_TAG = b"Apple iOS\0", 0x0011
CONTENT_KEY = b"com.apple.quicktime.content.identifier"
MOST_ENTRIES, MOST_TEXT, MOST_STEPS = 4096, 1024, 10_000


class Broken(Exception):
    """The file isn't what it says, or ends early."""


class Window:
    """Reads at offsets of a file, counted from a base."""

    def __init__(self, file: BinaryIO, base: int = 0):
        self.file, self.base = file, base

    def at(self, offset: int, n: int) -> bytes:
        self.file.seek(self.base + offset)
        data = self.file.read(n)
        if len(data) < n:
            raise Broken
        return data


def directory(w: Window, order: str, offset: int) -> dict[int, tuple[int, int, int]]:
    """tag: (type, count, where its value stands) of a TIFF directory."""
    (n,) = struct.unpack(f"{order}H", w.at(offset, 2))
    if n > MOST_ENTRIES:
        raise Broken
    data, found = w.at(offset + 2, 12 * n), {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(f"{order}HHI", data, 12 * k)
        size = {1: 1, 2: 1, 3: 2, 4: 4, 7: 1}.get(kind, 8) * count
        place = offset + 2 + 12 * k + 8
        found.setdefault(tag, (kind, count, place if size <= 4 else struct.unpack_from(f"{order}I", data, 12 * k + 8)[0]))
    return found


def text(w: Window, entry: tuple[int, int, int] | None) -> str | None:
    if entry is None or entry[0] != 2 or not 0 < entry[1] <= MOST_TEXT:
        return None
    return w.at(entry[2], entry[1]).split(b"\0")[0].decode("ascii", "replace") or None


def pointer(w: Window, order: str, entry: tuple[int, int, int] | None) -> int | None:
    return struct.unpack(f"{order}I", w.at(entry[2], 4))[0] if entry and entry[0] == 4 else None


def tiff_facts(w: Window) -> tuple[str | None, str | None, str | None, str | None]:
    """The original date and its offset, the file's date, and the content identifier of a TIFF block."""
    head = w.at(0, 8)
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(head[:4])
    if order is None:
        raise Broken
    first = struct.unpack(f"{order}I", head[4:])[0]
    main = directory(w, order, first)
    date, original, offset, content = text(w, main.get(DATE)), None, None, None
    inner = pointer(w, order, main.get(EXIF))
    if inner == first:
        raise Broken
    if inner is not None:
        exif = directory(w, order, inner)
        original, offset = text(w, exif.get(ORIGINAL)), text(w, exif.get(ORIGINAL_OFFSET))
        note = exif.get(MAKER_NOTE)
        if note and note[1] > 14 and w.at(note[2], len(MAKER)) == MAKER:
            own = Window(w.file, w.base + note[2])  # its offsets count from its own start
            its = {b"MM": ">", b"II": "<"}.get(own.at(12, 2))
            content = text(own, directory(own, its, 14).get(CONTENT_TAG)) if its else None
    return original, offset, date, content


def boxes(w: Window, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """name, body's start and end of the boxes between two offsets; bodies are passed over unread."""
    for _ in range(MOST_STEPS):
        if end - start < 8:
            return
        size, name = struct.unpack(">I4s", w.at(start, 8))
        body = start + 8
        if size == 1:
            size, body = struct.unpack(">Q", w.at(body, 8))[0], body + 8
        stop = end if size == 0 else start + size
        if stop < body or stop > end:
            raise Broken
        yield name, body, stop
        start = stop
    raise Broken


def child(w: Window, start: int, end: int, name: bytes) -> tuple[int, int] | None:
    return next(((a, b) for found, a, b in boxes(w, start, end) if found == name), None)


def heic_block(w: Window, size: int) -> int | None:
    """Where the TIFF block of a HEIC stands: the place that iloc gives for the item that iinf calls Exif."""
    meta = child(w, 0, size, b"meta")
    if meta is None:
        return None
    start, end = meta[0] + 4, meta[1]
    info, places = child(w, start, end, b"iinf"), child(w, start, end, b"iloc")
    if info is None or places is None:
        return None
    wanted = None
    for name, a, b in boxes(w, info[0] + (6 if w.at(info[0], 1) == b"\0" else 8), info[1]):
        version = w.at(a, 1)[0]
        if name == b"infe" and version >= 2:
            wide = 4 if version > 2 else 2
            if w.at(a + 4 + wide + 2, 4) == b"Exif":
                wanted = int.from_bytes(w.at(a + 4, wide), "big")
    version, sizes = w.at(places[0], 1)[0], int.from_bytes(w.at(places[0] + 4, 2), "big")
    of, ln, base, index = (sizes >> 12) & 15, (sizes >> 8) & 15, (sizes >> 4) & 15, sizes & 15 if version else 0
    at, wide = places[0] + 6, 4 if version == 2 else 2
    number = lambda n: (int.from_bytes(w.at(at, n), "big") if n else 0, at + n)
    items, at = number(wide)
    for _ in range(min(items, MOST_STEPS)):
        item, at = number(wide)
        at += 2 if version else 0
        at += 2
        start, at = number(base)
        extents, at = number(2)
        for k in range(min(extents, MOST_STEPS)):
            at += index
            offset, at = number(of)
            at += ln
            if item == wanted and k == 0:
                place = start + offset
                return place + 4 + int.from_bytes(w.at(place, 4), "big")
    return None


def image_facts(file: BinaryIO) -> tuple[str | None, str | None, str | None, str | None]:
    w = Window(file)
    head = w.at(0, 12)
    if head[:4] in (b"II*\0", b"MM\0*"):
        return tiff_facts(w)
    if head[4:8] == b"ftyp":
        place = heic_block(w, file.seek(0, 2))
        return tiff_facts(Window(file, place)) if place is not None else (None,) * 4
    if head[:2] != b"\xff\xd8":
        raise Broken
    at = 2
    for _ in range(MOST_STEPS):
        mark, size = struct.unpack(">HH", w.at(at, 4))
        if mark >> 8 != 0xFF or mark in (0xFFDA, 0xFFD9) or size < 2:
            break
        if mark == 0xFFE1 and size >= 16 and w.at(at + 4, 6) == b"Exif\0\0":
            return tiff_facts(Window(file, at + 10))
        at += 2 + size
    return (None,) * 4


def movie_identifier(file: BinaryIO) -> str | None:
    """The value that a movie's metadata has under the key of content identifiers."""
    w = Window(file)
    moov = child(w, 0, file.seek(0, 2), b"moov")
    meta = moov and child(w, *moov, b"meta")
    if not meta:
        return None
    start = meta[0] + (0 if w.at(meta[0] + 4, 4) == b"hdlr" else 4)
    keys, items = child(w, start, meta[1], b"keys"), child(w, start, meta[1], b"ilst")
    if not keys or not items:
        return None
    # Keys are sized like boxes, named by their namespace; items are named by the number of their key.
    names = [w.at(a, b - a) if b - a <= MOST_TEXT else b"" for _, a, b in boxes(w, keys[0] + 8, keys[1])]
    for name, a, b in boxes(w, *items):
        k = int.from_bytes(name, "big")
        if 0 < k <= len(names) and names[k - 1] == CONTENT_KEY and (data := child(w, a, b, b"data")) and 8 <= data[1] - data[0] <= MOST_TEXT:
            return w.at(data[0] + 8, data[1] - data[0] - 8).decode("utf-8", "replace") or None
    return None


def _facts(path: str, movie: bool, photo: bool) -> tuple[str | None, str | None, str | None, str | None]:
    try:
        with open(path, "rb") as file:
            if movie:
                return None, None, None, movie_identifier(file)
            return image_facts(file) if photo else (None,) * 4
    except (OSError, Broken, struct.error):
        return (None,) * 4


def with_metadata(files: DataFrame) -> DataFrame:
    """files (path, ..) with taken_at (the original date by its offset, else the file's date) and content_id.

    Photos have both, movies the identifier; other files, and those that can't be read, have nulls. All executors must see
    the files.
    """
    rows = files.select("*", media.extension(F.col("path")).isin(".mov", ".m4v").alias("__movie"), media.is_photo(F.col("path")).alias("__photo"))
    names = ["__original", "__offset", "__date", "content_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda c: batch.column(batch.schema.get_field_index(c)).to_pylist()
            found = [_facts(p, m, i) for p, m, i in zip(column("path"), column("__movie"), column("__photo"))]
            columns = list(zip(*found)) if found else [()] * 4
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.string()) for c in columns)], [*batch.schema.names, *names])

    read = rows.mapInArrow(run, StructType([*rows.schema.fields, *(StructField(n, StringType()) for n in names)]))
    taken = F.coalesce(media.exif_date(F.col("__original"), F.col("__offset")), media.exif_date(F.col("__date"), F.lit(None).cast("string")))
    return read.select(*files.columns, taken.alias("taken_at"), "content_id")
