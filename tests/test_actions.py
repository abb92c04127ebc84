"""Versioned tables, receipts and file actions: readers during commits, killed writers, tasks that run twice."""

import hashlib
import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from framehouse.operators import actions
from framehouse.sources import receipt_files, versions
from framehouse.sources.scan import file_identity

ENTRY = "source string, dest string, hash string"


def test_readers_see_whole_versions_during_commits(spark, tmp_path):
    table = versions.VersionedTable(spark, str(tmp_path / "t"), "a int")
    assert table.read().count() == 0 and table.version() == 0
    rows = lambda k: spark.range(5).select((F.col("id") + k).cast("int").alias("a")).coalesce(1)
    table.replace(rows(0))
    seen, errors, over = [], [], threading.Event()

    def watch():
        while not over.is_set():
            try:
                seen.append(sorted(r.a for r in table.read().collect()))
            except Exception as error:  # noqa: BLE001
                errors.append(error)

    reader = threading.Thread(target=watch)
    reader.start()
    pinned = table.read()
    for k in range(1, 51):
        table.replace(rows(k))
    over.set()
    reader.join()
    assert not errors and seen and all(len(s) == 5 and s[-1] - s[0] == 4 for s in seen)
    assert table.version() == 51 and sorted(r.a for r in pinned.collect()) == [0, 1, 2, 3, 4]
    assert table.clean_up(keep=2) == 0  # all are young
    assert table.clean_up(keep=2, older_than=-5) == 49
    assert sorted(r.a for r in table.read().collect()) == [50, 51, 52, 53, 54] and table.read(50).count() == 5


def test_of_two_writers_one_loses(spark, tmp_path):
    table = versions.VersionedTable(spark, str(tmp_path / "t"), "a int")
    table.replace(spark.createDataFrame([(1,)], "a int"))
    table.replace(spark.createDataFrame([(2,)], "a int"), after=1)
    with pytest.raises(versions.Conflict):
        table.replace(spark.createDataFrame([(3,)], "a int"), after=1)
    assert [r.a for r in table.read().collect()] == [2]
    add = lambda k: table.update(lambda df: df.unionByName(spark.createDataFrame([(k,)], "a int")))
    both = [threading.Thread(target=add, args=(k,)) for k in (10, 20, 30)]
    [t.start() for t in both], [t.join() for t in both]
    assert sorted(r.a for r in table.read().collect()) == [2, 10, 20, 30] and table.version() == 5
    assert len([n for n in os.listdir(tmp_path / "t") if n.startswith("rows-")]) == 5
    (tmp_path / "t" / "log" / f"{6:020d}.json").write_text('{"rows": ')  # a writer that isn't done, on a store that shows it
    assert table.version() == 5 and table.read().count() == 4


def test_migrations_land_together(spark, tmp_path):
    table = versions.VersionedTable(spark, str(tmp_path / "t"), "a int")
    table.replace(spark.createDataFrame([(1,)], "a int"))
    steps = {1: lambda df: df.withColumn("b", F.col("a") * 10), 3: lambda df: df.withColumn("c", F.col("b") + 1)}
    with pytest.raises(Exception):
        table.migrate({**steps, 4: lambda df: df.select("missing")})
    assert table.schema_version() == 0 and table.read().columns == ["a"]
    assert table.migrate(steps) == 3 and table.schema_version() == 3
    assert [tuple(r) for r in table.read().collect()] == [(1, 10, 11)] and table.migrate(steps) == 3 and table.version() == 2


def test_receipt_of_a_run(spark, tmp_path):
    folder = str(tmp_path / "logs")
    rows = spark.createDataFrame([(f"/s{i}", f"/d{i}", f"{i}_é\n" if i else None) for i in range(40)], ENTRY).repartition(4)
    run = receipt_files.write_receipt(rows, folder, "transfer", destinationRoot="/d")
    (name, header), = receipt_files.headers(spark, folder)
    assert header["status"] == "COMPLETED" and header["runID"] == run and header["total_jobs"] == 40 and header["destinationRoot"] == "/d" and name.startswith("audit_receipt_")
    assert sorted(receipt_files.entries(spark, folder, run, ENTRY).collect()) == sorted(rows.collect())
    whole = receipt_files.whole_receipt(spark, folder, run, ENTRY).first()
    assert len(json.loads(whole.text)["transfers"]) == 40 and json.loads(whole.text)["schemaVersion"] == 2


def test_failed_run_is_aborted_and_killed_run_recovers(spark, tmp_path):
    folder = str(tmp_path / "logs")
    rows = spark.range(0, 40, 1, 4).select(F.concat(F.lit("/s"), F.col("id").cast("string")).alias("source"), F.lit("/d").alias("dest"), F.when(F.col("id") == 39, F.raise_error(F.lit("lost"))).otherwise(F.lit("h")).alias("hash"))
    with pytest.raises(Exception):
        receipt_files.write_receipt(rows, folder, "transfer", run="broken")
    header = dict((h["runID"], h) for _, h in receipt_files.headers(spark, folder))["broken"]
    assert header["status"] == "ABORTED" and header["total_jobs"] == receipt_files.entries(spark, folder, "broken", ENTRY).count()
    # A killed run: its header is still PENDING, one attempt was repeated, the last line of a part is torn.
    stem = "audit_receipt_20240101_000000_killed"
    line = lambda i: json.dumps({"source": f"/s{i}", "dest": f"/d{i}", "hash": "h"}) + "\n"
    (tmp_path / "logs" / f"{stem}.json").write_text(json.dumps({"runID": "killed", "status": "PENDING", "operation": "organize", "schemaVersion": 2}))
    (tmp_path / "logs" / f"{stem}.a.part").write_text(line(1) + line(2))
    (tmp_path / "logs" / f"{stem}.b.part").write_text(line(1) + line(2) + line(3) + line(4)[:-9])
    assert receipt_files.recover(spark, folder) == ["killed"] and receipt_files.recover(spark, folder) == []
    assert sorted(r.source for r in receipt_files.entries(spark, folder, "killed", ENTRY).collect()) == ["/s1", "/s2", "/s3"]
    assert dict((h["runID"], h["status"]) for _, h in receipt_files.headers(spark, folder)) == {"broken": "ABORTED", "killed": "ABORTED"}


def identity(data):
    return f"{len(data)}_{hashlib.blake2b(str(len(data)).encode() + data).hexdigest()}"


def make(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)
    return str(path)


JOBS = "ordinal long, source string, dest string, identity string"


def test_copies_keep_what_stands_and_tell_each_outcome(spark, tmp_path):
    jobs = [(i, make(tmp_path / f"s/{i}.jpg", b"x" * i), str(tmp_path / f"d/{i % 3}/{i}.jpg"), identity(b"x" * i)) for i in range(12)]
    make(tmp_path / "d/0/3.jpg", b"other")
    (tmp_path / "s/5.jpg").write_bytes(b"changed")
    (tmp_path / "s/7.jpg").unlink()
    got = {r.ordinal: r for r in actions.copy_files(spark.createDataFrame(jobs, JOBS), run="r1").collect()}
    assert len(got) == 12 and {k for k, r in got.items() if r.status == "SKIPPED"} == {5, 7}
    assert {r.status for k, r in got.items() if k not in (5, 7)} == {"COPIED"}
    assert got[3].dest.endswith("/3_collision_1.jpg") and (tmp_path / "d/0/3.jpg").read_bytes() == b"other"
    names = sorted(p.name for p in (tmp_path / "d").rglob("*") if p.is_file())
    assert names == sorted(["3.jpg", "3_collision_1.jpg", *(f"{i}.jpg" for i in range(12) if i not in (3, 5, 7))])
    assert all(file_identity(r.dest) == identity(b"x" * k) and os.stat(r.dest).st_nlink == 1 for k, r in got.items() if r.status == "COPIED")


def test_repeated_tasks_give_each_file_once(spark, tmp_path):
    """Both phases run twice over the same jobs, as after a lost executor or beside a speculative task."""
    jobs = [(i, make(tmp_path / f"s/{i}.jpg", b"y" * (i + 1)), str(tmp_path / f"d/{i // 2}.jpg"), identity(b"y" * (i + 1))) for i in range(6)]
    table = spark.createDataFrame(jobs, JOBS)
    twice = actions.prepared(table, "r").unionByName(actions.prepared(table, "r"))
    assert len({r.temporary for r in twice.collect()}) == 12
    stopped = twice.withColumn("stop", F.lit(False))
    first, second = (actions.finished(stopped, "r").select("ordinal", "dest", "status").distinct().collect() for _ in range(2))
    assert sorted(first) == sorted(second) and len(first) == 6 and {r.status for r in first} == {"COPIED"} and len({r.dest for r in first}) == 6
    actions.tidied(table, "r")
    files = [p for p in (tmp_path / "d").rglob("*") if p.is_file()]
    assert {str(p) for p in files} == {r.dest for r in first} and sorted(p.read_bytes() for p in files) == [b"y" * (i + 1) for i in range(6)]


def test_failures_in_a_row_stop_the_run(spark, tmp_path):
    make(tmp_path / "blocked", b"a file where a folder should be")
    jobs = [(i, make(tmp_path / f"s/{i}.jpg", b"z" * i), str(tmp_path / ("blocked" if 2 <= i < 7 else "d") / f"{i}.jpg"), None) for i in range(12)]
    got = {r.ordinal: r.status for r in actions.copy_files(spark.createDataFrame(jobs, JOBS), retries=1).collect()}
    assert [got[i] for i in range(12)] == ["COPIED"] * 2 + ["FAILED"] * 5 + ["PENDING"] * 5
    assert sorted(os.listdir(tmp_path / "d")) == ["0.jpg", "1.jpg"]


def test_revert_only_what_is_still_the_copy(spark, tmp_path):
    root = tmp_path / "d"
    same, changed, gone, outside = make(root / "a.jpg", b"a"), make(root / "b.jpg", b"b2"), str(root / "c.jpg"), make(tmp_path / "x.jpg", b"x")
    os.symlink(outside, root / "l.jpg")
    os.symlink(tmp_path, root / "way")
    rows = [(0, "/s", same, identity(b"a")), (1, "/s", changed, identity(b"b")), (2, "/s", gone, "h"), (3, "/s", outside, identity(b"x")), (4, "/s", str(root / "l.jpg"), identity(b"x")), (5, "/s", str(root / "way/x.jpg"), identity(b"x")), (6, "/s", str(root), "h")]
    table = spark.createDataFrame(rows, "ordinal int, source string, dest string, hash string")
    got = {r.ordinal: r.status for r in actions.revert_copies(table, str(root), "r").collect()}
    assert got == {0: "reverted", 1: "skipped", 2: "missing", 3: "skipped", 4: "skipped", 5: "skipped", 6: "skipped"}
    assert sorted(os.listdir(root)) == ["b.jpg", "l.jpg", "way"] and os.path.exists(outside) and (root / "b.jpg").read_bytes() == b"b2"


def test_trash_and_restore_twice(spark, tmp_path):
    lib, bin_ = tmp_path / "lib", str(tmp_path / "bin")
    paths = [make(lib / f"f{i}/same.jpg", bytes([i])) for i in range(4)]
    plan = spark.createDataFrame([(p, 1) for p in [*paths, str(lib / "none.jpg")]], "path string, size int")
    first, second = (sorted(actions.trash(plan, bin_, "r").collect()) for _ in range(2))
    assert first == second and [r.trashURL is None for r in first] == [True if r.originalPath.endswith("none.jpg") else False for r in first]
    assert not [p for p in lib.rglob("*") if p.is_file()]
    make(lib / "f1/same.jpg", b"new")
    items = spark.createDataFrame(first)
    got = {r.originalPath: r.status for r in actions.restore(items, [str(lib)]).collect()}
    assert got == {paths[0]: "restored", paths[1]: "failed", paths[2]: "restored", paths[3]: "restored", str(lib / "none.jpg"): "failed"}
    assert [open(p, "rb").read() for p in paths] == [b"\0", b"new", b"\2", b"\3"] and all(os.stat(p).st_nlink == 1 for p in paths)
    assert {r.status for r in actions.restore(items, [str(tmp_path / "else")]).collect()} == {"failed"}


def test_a_run_with_its_receipt_and_back(spark, tmp_path):
    jobs = [(i, make(tmp_path / f"s/{i}.jpg", b"q" * i), str(tmp_path / f"d/{i}.jpg"), identity(b"q" * i)) for i in range(8)]
    outcomes = actions.copy_files(spark.createDataFrame(jobs, JOBS))
    told = outcomes.where("status = 'COPIED'").select("ordinal", "source", "dest", F.col("identity").alias("hash"))
    run = receipt_files.write_receipt(told, str(tmp_path / "logs"))
    back = receipt_files.entries(spark, str(tmp_path / "logs"), run, "ordinal long, " + ENTRY)
    assert {r.status for r in actions.revert_copies(back, str(tmp_path / "d")).collect()} == {"reverted"} and os.listdir(tmp_path / "d") == []
