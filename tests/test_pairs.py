"""Pairs of photos as one: the pair table, kinds that are switched off, paths of several clusters, equal photos."""

import itertools
import random

from framehouse.functions import media
from framehouse.operators import decisions, similarity, tables


def test_live_photos_go_before_raw_pairs(spark):
    names = [("/a/1.HEIC", "x"), ("/a/1.m4v", "x"), ("/a/1.dng", None), ("/a/2.PNG", "y"), ("/a/2.mov", "y"), ("/a/3.heic", "z"), ("/a/3b.HEIC", "z"), ("/a/3.MOV", "z"), ("/b/3.MOV", "z"), ("/a/4.cr2", None), ("/a/4.jpg", None), ("/a/4.jpeg", None)]
    table = spark.createDataFrame([(k, p, c) for k, (p, c) in enumerate(names)], "ordinal int, path string, content_id string")
    got = {r.path: (r.partner, r.kind) for r in similarity.pair_table(table).collect()}
    live, raw = "livePhoto", "rawJpeg"
    assert got == {"/a/1.HEIC": ("/a/1.m4v", live), "/a/1.m4v": ("/a/1.HEIC", live), "/a/1.dng": ("/a/1.HEIC", raw), "/a/3.heic": ("/a/3.MOV", live), "/a/3b.HEIC": ("/a/3.MOV", live), "/a/3.MOV": ("/a/3b.HEIC", live), "/a/4.cr2": ("/a/4.jpeg", raw), "/a/4.jpeg": ("/a/4.cr2", raw)}


def plan(spark, members, asked=(), **kw):
    rows = spark.createDataFrame([(c, p, 10, k, conf, partner, later) for c, p, k, conf, partner, later in members], "cluster string, path string, size int, keeper string, confidence string, paired_path string, later int")
    files = spark.createDataFrame([(p, 10) for p in {m[1] for m in members} | {m[4] for m in members if m[4]}], "path string, size int")
    found = decisions.deletion_plan(rows, spark.createDataFrame(list(asked), "path string, decision string"), files, **kw)
    return {(r.path, r.cluster, r.origin) for r in found.collect()}


def test_kinds_of_pairs_are_switched_one_by_one(spark):
    members = [("c", "/k.jpg", "/k.jpg", "high", None, 0), ("c", "/l.heic", "/k.jpg", "high", "/l.mov", 0), ("c", "/r.dng", "/k.jpg", "high", "/r.jpg", 0)]
    direct = {("/l.heic", "c", None), ("/r.dng", "c", None)}
    assert plan(spark, members) == direct | {("/l.mov", "c", "/l.heic"), ("/r.jpg", "c", "/r.dng")}
    assert plan(spark, members, kinds=("livePhoto",)) == direct | {("/l.mov", "c", "/l.heic")}
    assert plan(spark, members, kinds=("rawJpeg",)) == direct | {("/r.jpg", "c", "/r.dng")}
    assert plan(spark, members, kinds=()) == direct


def test_a_kept_member_saves_the_partner_it_names(spark):
    """Only the RAW names the photo: keeping the RAW keeps the photo, whichever way the pair is written."""
    members = [("c", "/a.dng", "/z.jpg", "high", "/a.heic", 0), ("c", "/a.heic", "/z.jpg", "high", "/a.mov", 0), ("c", "/z.jpg", "/z.jpg", "high", None, 0)]
    assert plan(spark, members, [("/a.dng", "keep")]) == set()
    assert plan(spark, members, [("/a.dng", "keep")], kinds=("livePhoto",)) == {("/a.heic", "c", None), ("/a.mov", "c", "/a.heic")}


def test_a_path_of_two_clusters_counts_for_the_last(spark):
    members = [("exact:1", "/a", "/a", "high", None, 0), ("exact:1", "/b", "/a", "high", None, 0), ("near:1", "/b", "/b", "low", None, 1), ("near:1", "/c", "/b", "low", None, 1)]
    assert plan(spark, members) == set()
    assert plan(spark, [(*m[:3], "high", *m[4:]) for m in members]) == {("/c", "near:1", None)}


def test_equal_photos_are_one_row_and_tell_the_same(spark):
    rng = random.Random(4)
    kinds = [(k * 7, rng.getrandbits(62), [rng.uniform(0, 1) for _ in range(3)]) for k in range(6)]
    kinds += [(t + 3, d ^ 5, [x + 0.05 for x in p]) for t, d, p in kinds[:4]]
    photos = [(f"/p{k:03}", *rng.choice(kinds)) for k in range(150)] + [("/undated", None, 1, [0.5] * 3), ("/bare", 5, None, None)]
    table = spark.createDataFrame(photos, "path string, t long, dhash long, print array<double>")
    every = similarity.pairs(table).collect()
    edges, copies = similarity.class_pairs(table)
    rows = edges.collect()
    assert len(rows) < 60 and sum(r.weight for r in rows) == len(every)
    assert abs(sum(r.distance * r.weight for r in rows) - sum(r.distance for r in every)) < 1e-6 and sum(r.hamming * r.weight for r in rows) == sum(r.hamming for r in every)
    plain = {r.path: r.cluster for r in similarity.clusters(similarity.pairs(table)).collect()}
    assert {r.path: r.cluster for r in similarity.clusters(edges, copies).collect()} == plain and len(plain) > 100
    alike = spark.createDataFrame([(f"/q{k}", 9, 77, [0.0]) for k in range(3000)], "path string, t long, dhash long, print array<double>")
    edges, copies = similarity.class_pairs(alike)
    assert [r.weight for r in edges.collect()] == [3000 * 2999 // 2] and similarity.clusters(edges, copies).count() == 3000


def test_natural_order(spark):
    names = ["IMG_2.jpg", "img_10.jpg", "IMG_010b.jpg", "IMG_1.jpg", "a", "B", "IMG.jpg", "12", "9", "IMG_2_3.jpg", "IMG_2_12.jpg", "IMG_99999999999999999999.jpg"]
    got = [r.n for r in spark.createDataFrame([(n,) for n in names], "n string").orderBy(media.natural_key(__import__("pyspark.sql.functions", fromlist=["col"]).col("n"))).collect()]
    assert got == ["9", "12", "a", "B", "IMG.jpg", "IMG_1.jpg", "IMG_2.jpg", "IMG_2_3.jpg", "IMG_2_12.jpg", "img_10.jpg", "IMG_010b.jpg", "IMG_99999999999999999999.jpg"]
    table = spark.createDataFrame([(f"/{f}/{n}",) for f, n in itertools.product("xy", ["p10.jpg", "p9.jpg", ".p1.jpg", "p8.txt", "P7.MOV", "p100.heic", "p11.png"])], "path string")
    assert {f: [r.path.split("/")[-1] for r in sorted(rows, key=lambda r: r.place)] for f, rows in itertools.groupby(sorted(tables.preview_sample(table).collect()), key=lambda r: r.folder)} == {f: ["P7.MOV", "p9.jpg", "p10.jpg", "p11.png"] for f in ("/x", "/y")}
