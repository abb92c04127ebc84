"""Readers of reviews and source logs, the one-file report, figures that ride on writes, and the change feed against a batch diff."""

import csv
import datetime
import json

import pytest
from pyspark.sql import functions as F

from framehouse.operators import library
from framehouse.plans.lineage import observed
from framehouse.sources import scan, sinks
from framehouse.streaming import changes


def test_review_and_source_log(spark, tmp_path):
    path, schema = tmp_path / "review.jsonl", "ordinal int, path string, needs_attention boolean"
    path.write_text("".join(json.dumps({"ordinal": k, "path": f"/p{k}", "needs_attention": k == 3, "other": 1}) + "\n" for k in (5, 3, 1)))
    items, opening = scan.read_review(spark, str(path), schema)
    assert [r.ordinal for r in items.collect()] == [1, 3, 5] and opening == "needsAttention"
    path.write_text(json.dumps({"ordinal": 1, "path": "/p", "needs_attention": False}) + "\n")
    assert scan.read_review(spark, str(path), schema)[1] == "all" and scan.read_review(spark, str(tmp_path / "none"), schema)[0].count() == 0
    path.write_text('{"ordinal": 1, "path": "/p"}\n{"ordinal": ')
    with pytest.raises(Exception):
        scan.read_review(spark, str(path), schema)[0].collect()
    log = tmp_path / "log.json"
    record = lambda p, day: {"sourcePath": p, "firstTransferredAt": "2024-01-01T00:00:00Z", "lastTransferredAt": f"2024-02-{day:02}T00:00:00Z", "runCount": 2, "lastCopiedCount": 3, "totalCopiedCount": 7}
    log.write_text(json.dumps([record("/a", 3), record("/b", 9), record("/c", 5)]))
    assert [(r.source, r.total_copied) for r in scan.read_source_log(spark, str(log)).collect()] == [("/b", 7), ("/c", 7), ("/a", 7)]
    for broken in ("[{", json.dumps([{"sourcePath": "/a"}]), json.dumps({"sourcePath": 1})):
        log.write_text(broken)
        assert scan.read_source_log(spark, str(log)).count() == 0
    assert scan.read_source_log(spark, str(tmp_path / "none.json")).count() == 0


def test_report_is_one_whole_file(spark, tmp_path):
    rows = [(k, f'/s "{k}",\n', f"/d/{k}", None if k == 4 else "h", "b", k % 2 == 0) for k in range(9)]
    plan = spark.createDataFrame(rows, "ordinal int, source string, dest string, identity string, bucket string, is_duplicate boolean").repartition(4)
    assert sinks.write_report_file(plan, str(tmp_path), "dry_run_report_1.csv") == 9
    assert [p.name for p in tmp_path.iterdir()] == ["dry_run_report_1.csv"]
    with open(tmp_path / "dry_run_report_1.csv", newline="") as f:
        got = list(csv.reader(f))
    assert got[0] == ["Source", "Destination", "Hash", "Status"] and [r[1] for r in got[1:]] == [f"/d/{k}" for k in (1, 3, 5, 7, 0, 2, 4, 6, 8)] and got[1][0] == '/s "1",\n' and got[7][2] == ""
    with pytest.raises(Exception):
        sinks.write_report_file(plan.withColumn("dest", F.when(F.col("ordinal") == 7, F.raise_error(F.lit("x"))).otherwise(F.col("dest"))), str(tmp_path), "b.csv")
    assert [p.name for p in tmp_path.iterdir()] == ["dry_run_report_1.csv"]


def test_figures_ride_on_the_write(spark):
    rows, told = observed(spark.range(100), "test", n=F.count("*"), most=F.max("id"))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    assert told == {"n": 100, "most": 99} and len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == jobs and rows.count() == 100


def test_feed_agrees_with_the_batch_diff(spark, tmp_path):
    """Three looks at a tree, of which whole directories vanish: what the stream writes is what a diff of two looks gives."""
    looks = [{f"/t/{d}/{e}/f{k}": float(k) for d in "ab" for e in "xy" for k in range(3)} | {f"/t/{d}": 0.0 for d in "ab"} | {f"/t/{d}/{e}": 0.0 for d in "ab" for e in "xy"}]
    looks.append({p: s + ("f1" in p) for p, s in looks[0].items() if not p.startswith("/t/a/x") and p != "/t/b/y/f2"} | {"/t/new": 1.0})
    looks.append({p: s for p, s in looks[1].items() if not p.startswith("/t/b")})
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k, look in enumerate(looks):
        before = looks[k - 1] if k else {}
        rows = [(p, datetime.datetime(2024, 1, 1, 0, k), look.get(p)) for p in {*before, *look}]
        spark.createDataFrame(rows, "path string, at timestamp, stamp double").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("path string, at timestamp, stamp double").option("maxFilesPerTrigger", 1).parquet(src)
        query = changes.write_changes(changes.change_feed(stream), out, str(tmp_path / "state"), availableNow=True)
        query.awaitTermination(180)
        assert query.exception() is None
    frame = lambda look: spark.createDataFrame(list(look.items()), "path string, stamp double")
    want = [(p, c) for a, b in zip([{}, *looks], looks) for p, c in library.snapshot_changes(frame(a), frame(b)).collect()]
    got = [(r.path, r.change) for r in spark.read.parquet(out).collect()]
    assert sorted(got) == sorted(want) and ("/t/b", "removed") in got and ("/t/b/x", "removed") not in got
