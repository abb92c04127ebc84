"""Dates and identifiers from generated files, pixel features and links, against plain readings."""

import builtins
import math
import os
import random
import struct

import pytest
from pyspark.sql import functions as F

from framehouse.functions import pixels
from framehouse.operators import links
from framehouse.sources import metadata


def tiff(order="<", date=None, original=None, offset=None, content=None, cycle=False, first=8):
    """A TIFF block with IFD0, an Exif directory and a maker note, in either byte order."""
    p = lambda form, *v: struct.pack(order + form, *v)
    heap, base = b"", first + 400

    def put(data):
        nonlocal heap
        at = base + len(heap)
        heap += data + b"\0" * (len(data) % 2)
        return at

    def ascii_(tag, value):
        data = value.encode() + b"\0"
        return tag, 2, len(data), p("I", put(data)) if len(data) > 4 else data.ljust(4, b"\0")

    def ifd(entries):
        return p("H", len(entries)) + b"".join(p("HHI", t, k, n) + v for t, k, n, v in entries) + p("I", 0)

    inner = [ascii_(0x9003, original)] if original else []
    inner += [ascii_(0x9011, offset)] if offset else []
    if content:
        value = content.encode() + b"\0"
        note = b"Apple iOS\0\0\1MM" + struct.pack(">H", 1) + struct.pack(">HHII", 0x11, 2, len(value), 14 + 2 + 12 + 4) + struct.pack(">I", 0) + value
        inner.append((0x927C, 7, len(note), p("I", put(note))))
    outer = [ascii_(0x0132, date)] if date else []
    outer.append((0x8769, 4, 1, p("I", first if cycle else first + 200)))
    return ({"<": b"II*\0", ">": b"MM\0*"}[order] + p("I", first) + b"\0" * (first - 8) + ifd(outer).ljust(200, b"\0") + ifd(inner)).ljust(base, b"\0") + heap


def jpeg(block, before=b""):
    segment = lambda mark, data: struct.pack(">HH", mark, len(data) + 2) + data
    return b"\xff\xd8" + segment(0xFFE0, b"JFIF\0" + before) + segment(0xFFE1, b"Exif\0\0" + block) + segment(0xFFDA, b"\0" * 8) + b"scan" * 1000 + b"\xff\xd9"


def box(name, body, wide=False):
    return struct.pack(">I4sQ", 1, name, len(body) + 16) + body if wide else struct.pack(">I4s", len(body) + 8, name) + body


def movie(value, key=b"com.apple.quicktime.content.identifier", full=False, wide=True):
    keys = box(b"keys", struct.pack(">II", 0, 2) + box(b"mdta", b"com.apple.other") + box(b"mdta", key))
    items = box(b"ilst", box(struct.pack(">I", 1), box(b"data", struct.pack(">II", 1, 0) + b"else")) + box(struct.pack(">I", 2), box(b"data", struct.pack(">II", 1, 0) + value.encode())))
    meta = box(b"meta", (b"\0" * 4 if full else b"") + box(b"hdlr", b"\0" * 24) + keys + items)
    return box(b"ftyp", b"qt  \0\0\0\0") + box(b"mdat", b"\1" * 100_000, wide) + box(b"moov", box(b"mvhd", b"\0" * 20) + meta)


def heic(block):
    info = box(b"iinf", struct.pack(">IH", 0, 2) + box(b"infe", struct.pack(">IHH4s", 2 << 24, 1, 0, b"hvc1")) + box(b"infe", struct.pack(">IHH4s", 2 << 24, 2, 0, b"Exif")))
    make = lambda at: box(b"meta", b"\0" * 4 + info + box(b"iloc", struct.pack(">IHH", 0, 0x4400, 2) + struct.pack(">HHHII", 1, 0, 1, 0, 4) + struct.pack(">HHHII", 2, 0, 1, at, len(block) + 10)))
    head = box(b"ftyp", b"heic\0\0\0\0")
    at = len(head) + len(make(0)) + 8
    return head + make(at) + box(b"mdat", struct.pack(">I", 6) + b"Exif\0\0" + block)


def test_dates_and_identifiers_of_generated_files(spark, tmp_path):
    files = {
        "a.jpg": (jpeg(tiff("<", "2001:01:01 00:00:00", "2020:02:03 04:05:06", "+02:00")), "2020-02-03 02:05:06", None),
        "b.jpg": (jpeg(tiff(">", "2001:01:01 00:00:00")), "2001-01-01 00:00:00", None),
        "c.tif": (tiff(">", None, "2019-05-06 07:08:09", "bad", first=30), "2019-05-06 07:08:09", None),
        "d.dng": (tiff("<", "2018:01:02 03:04:05", "nonsense"), "2018-01-02 03:04:05", None),
        "e.heic": (heic(tiff(">", original="2022:10:11 12:13:14", content="ID-1")), "2022-10-11 12:13:14", "ID-1"),
        "f.MOV": (movie("ID-1"), None, "ID-1"),
        "g.m4v": (movie("ID-2", full=True, wide=False), None, "ID-2"),
        "h.mov": (movie("x", key=b"com.apple.none"), None, None),
        "cyclic.tif": (tiff("<", "2001:01:01 00:00:00", cycle=True), None, None),
        "short.jpg": (jpeg(tiff("<", "2001:01:01 00:00:00"))[:200], None, None),
        "empty.jpg": (b"", None, None), "noise.jpg": (os.urandom(3000), None, None), "noise.mov": (b"\0\0\0\5moov" * 50, None, None),
        "long.jpg": (jpeg(tiff("<", "2001:01:01 00:00:00"), before=b"\0" * 60_000), "2001-01-01 00:00:00", None),
        "text.txt": (jpeg(tiff("<", "2001:01:01 00:00:00")), None, None),
    }
    for name, (data, _, _) in files.items():
        (tmp_path / name).write_bytes(data)
    rows = spark.createDataFrame([(k, str(tmp_path / n)) for k, n in enumerate(files)] + [(99, str(tmp_path / "none.jpg"))], "k int, path string")
    got = {r.path.rsplit("/", 1)[1]: (r.at, r.content_id) for r in metadata.with_metadata(rows).select("path", "content_id", F.date_format("taken_at", "yyyy-MM-dd HH:mm:ss").alias("at")).collect()}
    assert got == {**{n: (at, c) for n, (_, at, c) in files.items()}, "none.jpg": (None, None)}


def test_no_file_is_read_whole(tmp_path):
    class Counted:
        def __init__(self, data):
            self.data, self.at, self.n = data, 0, 0

        def seek(self, at, whence=0):
            self.at = at if whence == 0 else len(self.data) + at
            return self.at

        def read(self, n):
            self.n += n
            self.at, data = self.at + n, self.data[self.at : self.at + n]
            return data

    for data, use in ((movie("ID"), metadata.movie_identifier), (heic(tiff()) + b"\0" * 500_000, metadata.image_facts), (jpeg(tiff("<", "2001:01:01 00:00:00")) + b"\0" * 500_000, metadata.image_facts)):
        file = Counted(data)
        use(file)
        assert file.n < 3000 < len(data)


def plain_laplacians(p, w, h):
    return [p[(y - 1) * w + x] + p[(y + 1) * w + x] + p[y * w + x - 1] + p[y * w + x + 1] - 4 * p[y * w + x] for y in range(1, h - 1) for x in range(1, w - 1)]


def test_pixel_features_against_loops(spark):
    rng = random.Random(3)
    images = [(k, w, h, [rng.randint(0, 255) for _ in range(w * h)]) for k, (w, h) in enumerate([(9, 8), (27, 16), (31, 29), (2, 5), (3, 3), (40, 9)])]
    images += [(90, 9, 8, [7] * 72), (91, 9, 8, None), (92, 4, 4, [])]
    c = F.col
    got = spark.createDataFrame(images, "k int, w int, h int, p array<int>").select(
        "k", pixels.shrunk(c("p"), c("w"), c("h")).alias("small"), pixels.laplacian_variance(c("p"), c("w"), c("h")).alias("var"), pixels.gray_sharpness(c("p"), c("w"), c("h")).alias("gray"),
        pixels.sharpness(c("p"), c("w"), c("h")).alias("sharp"), pixels.region_sharpness(c("p"), c("w"), c("h"), F.lit(0.25), F.lit(0.5), F.lit(0.5), F.lit(0.25)).alias("region"))
    hashes = {r.k: r.d for r in got.select("k", pixels.dhash(c("small")).alias("d")).collect()}
    for r in got.collect():
        _, w, h, p = next(i for i in images if i[0] == r.k)
        if not p or r.k == 92:
            assert hashes[r.k] is None and r.sharp == 0.05
            continue
        lap = plain_laplacians(p, w, h)
        var = sum(x * x for x in lap) / len(lap) - (sum(lap) / len(lap)) ** 2 if lap else 0
        scale = lambda x: math.log10(1 + 20 * x) / math.log10(21)
        assert r.var == pytest.approx(var) and r.gray == pytest.approx(scale(var))
        assert r.sharp == pytest.approx(scale(builtins.min(1, sum(x * x for x in lap) / len(lap) / 255**2)) if lap else 0.05)
        left, right, top, bottom = max(0, w * 0.25 - 10), builtins.min(w, w * 0.75 + 10), max(0, h * 0.25 - 10), builtins.min(h, h * 0.5 + 10)
        if right - left > 8 and bottom - top > 8:
            x0, x1, y0, y1 = math.floor(left), math.ceil(right), math.floor(top), math.ceil(bottom)
            inner = plain_laplacians([p[y * w + x] for y in range(y0, y1) for x in range(x0, x1)], x1 - x0, y1 - y0)
            assert r.region == pytest.approx(scale(sum(x * x for x in inner) / len(inner) - (sum(inner) / len(inner)) ** 2))
        else:
            assert r.region == 0
        if w >= 9 and h >= 8:
            cell = lambda x, y: [p[b * w + a] for b in range(y * h // 8, (y + 1) * h // 8) for a in range(x * w // 9, (x + 1) * w // 9)]
            small = [math.floor(sum(v) / len(v) + 0.5) for y in range(8) for x in range(9) for v in [cell(x, y)]]
            assert r.small == small
            bits = sum(1 << (y * 8 + x) for y in range(8) for x in range(8) if small[y * 9 + x] < small[y * 9 + x + 1])
            assert hashes[r.k] == (bits - (1 << 64) if bits >> 63 else bits)
        else:
            assert r.small is None and hashes[r.k] is None


def test_links_against_a_file_system(spark, tmp_path):
    """Chains, relative targets, links within targets, circles and links to nothing, as realpath sees them."""
    top = os.path.realpath(tmp_path)
    made = {"a": "real", "b": "./a", "deep/up": "../real", "deep/abs": f"{top}/b", "loop1": "loop2", "loop2": "loop1", "self": "self/x", "dead": "nowhere", "chain0": "real"} | {f"chain{i}": f"chain{i - 1}" for i in range(1, 12)}
    (tmp_path / "real/sub").mkdir(parents=True)
    (tmp_path / "deep").mkdir()
    for link, target in made.items():
        os.symlink(target, tmp_path / link)
    asked = ["real/sub/x", "a/sub/x", "b/sub", "deep/up/sub/x", "deep/abs/sub", "deep/x/../up/q", "chain11/sub/x", "dead/y", "plain/./z", "a", "ab/x"]
    circles = ["loop1/x", "loop2", "self", "self/y"]
    rows = spark.createDataFrame([(f"{top}/{p}",) for p in asked + circles] + [("not/absolute",), (None,)], "path string")
    table = spark.createDataFrame([(f"{top}/{k}", v) for k, v in made.items()], "path string, target string")
    got = {r.path: r.real for r in links.resolved(rows, table).collect()}
    assert got == {**{f"{top}/{p}": os.path.realpath(f"{top}/{p}") for p in asked}, **{f"{top}/{p}": None for p in circles}, "not/absolute": None}
    inside = {r.path.removeprefix(f"{top}/") for r in links.contained(rows, f"{top}/b", table).where("inside").collect()}
    assert inside == {"real/sub/x", "a/sub/x", "b/sub", "deep/up/sub/x", "deep/abs/sub", "deep/x/../up/q", "chain11/sub/x", "a"}
