import hashlib
import json

import pytest
from pyspark.sql import functions as F

from framehouse.functions import media, scores
from framehouse.operators import events, graph, library, planning, similarity
from framehouse.sources import scan
from framehouse.streaming import changes


def one(spark, row, schema, expr):
    return spark.createDataFrame([row], schema).select(expr.alias("x")).first().x


@pytest.mark.parametrize("name,day", [("IMG_20240229_101010.jpg", "2024-02-29"), ("IMG_20230229_101010.jpg", None), ("VID-20200101-WA0003.mp4", "2020-01-01"), ("20191231-235959.jpg", "2019-12-31"), ("x 2021-07-04 y.png", "2021-07-04"), ("a_20180102_b.jpg", "2018-01-02"), ("IMG_18991231_101010.jpg", None), ("IMG_20231301_101010 2020-02-03.jpg", "2020-02-03"), ("plain.jpg", None)])
def test_filename_dates(spark, name, day):
    found = one(spark, (f"/a/{name}",), "p string", media.filename_date(F.col("p")))
    assert (str(found) if found else None) == day


def test_names(spark):
    rows = [("/a/b.tar.JPG", ".JPG", True), ("/a/.hidden", "", False), ("/a/b", "", False), ("/a.d/b", "", False)]
    df = spark.createDataFrame(rows, "p string, s string, m boolean")
    assert all(r.x == r.s and r.y == r.m for r in df.select("*", media.suffix(F.col("p")).alias("x"), media.is_media(F.col("p")).alias("y")).collect())
    assert one(spark, (1234, 3), "n int, w int", media.sequence_text(F.col("n"), F.col("w"))) == "1234"
    assert one(spark, (7, 3), "n int, w int", media.sequence_text(F.col("n"), F.col("w"))) == "007"
    assert one(spark, (" a/b:\n c ",), "e string", media.clean_event_name(F.col("e"))) == "a-b-c"
    assert one(spark, ("12_ab_c",), "i string", media.identity_parts(F.col("i"))) == (12, "ab_c")
    assert one(spark, ("_ab",), "i string", media.identity_parts(F.col("i"))) is None
    assert one(spark, ("2020/May/Trip/2020-05-01_001.jpg",), "r string", media.found_event_folder(F.col("r"))) == "Trip"
    assert one(spark, ("2020/05/01/2020-05-01_001.jpg",), "r string", media.found_event_folder(F.col("r"))) is None
    assert one(spark, ("/d/Unknown_007_collision_1.jpg",), "r string", media.managed_bucket(F.col("r"))) is None
    assert one(spark, ("/d/Unknown_007_collision_1.jpg",), "r string", media.indexed_bucket(F.col("r"))) == "Unknown_Date"


def test_a_file_at_the_destination_is_never_a_duplicate_and_numbers_go_on(spark):
    files = spark.createDataFrame([(1, "/s/a.jpg", "1_x", "2020-01-01"), (2, "/s/b.jpg", "1_x", "2020-01-01"), (3, "/s/c.jpg", "2_y", "2020-01-01"), (4, "/s/d.jpg", "2_y", "2020-01-02"), (5, "/s/e.jpg", None, "2020-01-01"), (6, "/s/f.jpg", "3_z", None)], "ordinal long, path string, identity string, d string").withColumn("captured_at", F.col("d").cast("timestamp"))
    index = spark.createDataFrame([(1, "/d/2020/01/01/2020-01-01_009.jpg", "1_x"), (2, "/d/Duplicate/2020/01/02/2020-01-02_4.jpg", "0_q")], "ordinal long, path string, identity string")
    assert {r.status: r.n for r in planning.plan_counts(files, index).collect()} == {"already_in_destination": 2, "new": 2, "duplicate": 1, "hash_error": 1}
    plan = {r.source: r.dest for r in planning.copy_plan(files, index, "/d").collect()}
    assert plan == {"/s/c.jpg": "/d/2020/01/01/2020-01-01_010.jpg", "/s/d.jpg": "/d/Duplicate/2020/01/02/2020-01-02_005.jpg", "/s/f.jpg": "/d/Unknown_Date/Unknown_001.jpg"}
    cache = spark.createDataFrame([("/s/a.jpg", "1_x", 1, 5.0), ("/s/b.jpg", "bad", 1, 5.0), ("/s/c.jpg", "2_y", 9, 5.0)], "path string, hash string, size long, mtime double")
    listed = files.select("path").withColumns({"size": F.lit(1), "mtime": F.lit(5.0004)})
    assert [r.path for r in planning.with_cached_identity(listed, cache).where("cache_hit").collect()] == ["/s/a.jpg"]


def test_a_gap_must_be_longer_than_the_limit(spark):
    rows = [("d", 0, "a", "DCIM"), ("d", 10, "b", "Trip"), ("d", 21, "c", None), ("e", 22, "d", "DCIM")]
    df = events.sessions(spark.createDataFrame(rows, "bucket string, t long, path string, folder string"), 10)
    assert {r.path: r.session for r in df.collect()} == {"a": "d-1", "b": "d-1", "c": "d-2", "d": "e-1"}
    assert {r.session: r.name for r in events.named(df).collect()} == {"d-1": "Trip", "d-2": None, "e-1": None}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    assert {r.node: r.label for r in graph.components(edges).collect()} == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}
    assert graph.components(edges.limit(0)).count() == 0


def test_pairs_at_the_ends_of_stretches(spark):
    rows = [("a", 29, 0, [0.0]), ("b", 31, 1, [0.1]), ("c", 59, 0, [0.0]), ("d", 60, 0, [0.0]), ("e", None, 0, [0.0]), ("f", 59, 2047, [0.0])]
    df = spark.createDataFrame(rows, "path string, t long, dhash long, print array<double>")
    near = {(r.a, r.b) for r in similarity.pairs(df).collect()}
    assert near == {("a", "b"), ("a", "c"), ("b", "c"), ("b", "d"), ("c", "d")} | {("b", "f")}
    assert ("a", "e") in {(r.a, r.b) for r in similarity.pairs(df, similarity.Thresholds(window=None)).collect()}


def test_scores(spark):
    schema = "s double, f double, e double, m double, b double, z long, w int, h int"
    cols = [F.col(c) for c in "sfembzwh"]
    assert one(spark, (0.5, None, 0.9, 0.5, 0.2, 0, None, 3), schema, scores.quality(cols[0], cols[1], *cols[5:])) == pytest.approx(0.25 + 0.15 * 0.3 + 0.03 + 0.125)
    whole = 0.35 * 0.5 + 0.3 * 0.9 + 0.05 + 0.03 + 0.03 + 0.025
    assert one(spark, (0.5, None, 0.9, 0.5, 0.2, 0, None, 3), schema, scores.expression_quality(*cols)) == pytest.approx(whole * (1 - 0.06))


def test_upsert_keeps_the_first_place(spark):
    table = spark.createDataFrame([(1, "a", "x"), (2, "b", "x")], "ordinal long, k string, v string")
    new = spark.createDataFrame([(9, "a", "y"), (10, "c", "z"), (11, "a", "w")], "ordinal long, k string, v string")
    out = library.upserted(table, new, ["k"], "ordinal", keep="ordinal")
    assert sorted(map(tuple, out.collect())) == [(1, "a", "w"), (2, "b", "x"), (10, "c", "z")]


def test_scan_and_identity(spark, tmp_path):
    for name in ("b/img10.jpg", "b/img2.JPG", "b/note.txt", "a.png", ".hidden.jpg", "pics.photoslibrary/x.jpg", "README.md"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    (tmp_path / "link.jpg").symlink_to(tmp_path / "a.png")
    files, issues = scan.scan_tree(spark, str(tmp_path))
    rows = scan.with_content_identity(files).orderBy("ordinal").collect()
    assert [r.path.removeprefix(f"{tmp_path}/") for r in rows] == ["a.png", "b/img2.JPG", "b/img10.jpg"] and issues.count() == 0
    assert rows[0].identity == "5_" + hashlib.blake2b(b"5a.png").hexdigest()
    assert scan.scan_roots([files, files]).count() == 3
    manifest = tmp_path / "m.json"
    manifest.write_text(json.dumps({"items": [{"path": "/x", "isDirectory": True}, {"path": "/y", "isDirectory": False}, {"path": "/x", "isDirectory": False}]}))
    items, problems = scan.read_manifest(spark, str(manifest))
    assert sorted((r.ordinal, r.path, r.is_directory) for r in items.collect()) == [(0, "/x", True), (1, "/y", False)] and problems.count() == 0
    manifest.write_text('{"items": 5')
    items, problems = scan.read_manifest(spark, str(manifest))
    assert items.count() == 0 and problems.count() == 1
    items, problems = scan.read_manifest(spark, str(tmp_path / "none.json"))
    assert items.count() == 0 and problems.first().issue == "not readable"
    entries, _ = scan.scan_entries(spark, str(tmp_path), directories_first=True)
    kinds = [r.is_directory for r in entries.orderBy("ordinal").collect()]
    assert kinds[0] and not kinds[-1] and [r.ordinal for r in entries.orderBy("ordinal").collect()] == list(range(len(kinds)))
    layout = tmp_path / "reorganize_audit_receipt_1.json"
    layout.write_text(json.dumps({"items": [{"sourcePath": f"/s{k}", "destinationPath": f"/d{k}", "hash": "h", "completed": k != 1} for k in range(3)]}))
    assert [(r.source, r.dest) for r in scan.read_moves(spark, str(layout)).collect()] == [("/s2", "/d2"), ("/s0", "/d0")]
    receipt = tmp_path / "audit_receipt_1.json"
    receipt.write_text(json.dumps({"transfers": [{"source": "s", "dest": "d", "hash": "h"}]}))
    assert scan.read_transfers(spark, str(receipt)).first().dest == "d"
    receipt.write_text(json.dumps({"schemaVersion": 3, "transfers": [{"source": "s"}]}))
    with pytest.raises(Exception, match="newer version"):
        scan.read_transfers(spark, str(receipt)).collect()
    text = scan.write_profiles([("b", "/s", "/d"), ("default", "/x", "/y")])
    assert [tuple(r) for r in scan.read_profiles(spark, text).collect()] == [("default", "/x", "/y"), ("b", "/s", "/d")]


def test_change_feed(spark, tmp_path):
    src = str(tmp_path / "in")
    batch = lambda rows: spark.createDataFrame(rows, "path string, at timestamp, stamp double").coalesce(1).write.mode("append").parquet(src)
    at = lambda s: __import__("datetime").datetime(2024, 1, 1, 0, 0, s)
    batch([("a", at(1), 1.0), ("b", at(1), 1.0), ("a", at(2), 2.0)])
    batch([("b", at(3), None), ("a", at(3), 2.0)])
    stream = spark.readStream.schema("path string, at timestamp, stamp double").option("maxFilesPerTrigger", 1).parquet(src)
    query = changes.change_feed(stream).writeStream.format("memory").queryName("feed").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    rows = sorted((r.path, r.change) for r in spark.table("feed").collect())
    assert rows == [("a", "created"), ("a", "modified"), ("b", "created"), ("b", "removed")]


def test_crowded_stretches_give_the_same_pairs(spark, monkeypatch):
    from framehouse.operators import similarity
    from framehouse.plans import views

    photos = views.photo_candidates(spark, "/root/testdata/sf0.001").withColumn("t", F.col("t") % 200)
    plain = {tuple(r) for r in similarity.pairs(photos).collect()}
    monkeypatch.setattr(similarity, "CROWD", 30)
    assert {tuple(r) for r in similarity.pairs(photos).collect()} == plain and plain


def test_numbers_and_breaks_of_a_hot_group(spark):
    from framehouse.operators import runs

    rows = [("hot", i * 7 % 500, f"p{i}") for i in range(500)] + [("cold", i, f"q{i}") for i in range(3)]
    frame = spark.createDataFrame(rows, "g string, t long, path string").repartition(5)
    got = {(r.g, r.t): (r["__n"], r["__all"]) for r in runs.numbered(frame, ["g"], ["t"]).collect()}
    assert all(got["hot", i] == (i + 1, 500) for i in range(500)) and got["cold", 2] == (3, 3)
    gaps = spark.createDataFrame([("a", t, str(t)) for t in (0, 5, 6, 30, 31, 70)] + [("b", 31, "x")], "g string, t long, path string")
    assert {(r.g, r.t): r["__n"] for r in runs.breaks(gaps, "g", "t", ["path"], 10).collect()} == {("a", 0): 1, ("a", 5): 1, ("a", 6): 1, ("a", 30): 2, ("a", 31): 2, ("a", 70): 3, ("b", 31): 1}


def test_abort_points_across_ranges(spark):
    said = ["FAILED" if n % 7 in (1, 2, 4) else "SKIPPED" if n % 7 == 3 else "COPIED" for n in range(300)]
    long_row = ["COPIED"] * 199 + ["FAILED", "SKIPPED"] * 40 + ["COPIED"] * 21
    given = {"hot": said, "late": long_row, "few": ["FAILED"] * 4 + [None], None: ["FAILED"] * 6}
    want = {}
    for run, outcomes in given.items():
        in_row = total = 0
        for n, status in enumerate(outcomes):
            in_row, total = (0 if status == "COPIED" else in_row + (status == "FAILED")), total + (status == "FAILED")
            if status == "FAILED" and (in_row >= 5 or total >= 20):
                want[run] = (n, "consecutive" if in_row >= 5 else "total")
                break
    rows = spark.createDataFrame([(run, n, s) for run, o in given.items() for n, s in enumerate(o)], "r string, ordinal int, status string")
    got = {r.r: (r.aborted_at, r.reason) for r in library.abort_points(rows, "r").collect()}
    assert got == want and len(want) == 3
    assert library.abort_points(rows.limit(0), "r").count() == 0
