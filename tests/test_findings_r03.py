"""What the third review found, each on the smallest input that shows it."""

import random

import duckdb
from pyspark.sql import functions as F

from framehouse.llm import decontaminate
from framehouse.operators import actions, links, recency
from framehouse.plans import catalog, ledger  # noqa: F401  (registers its queries with the catalog's)


def test_moves_of_files_of_one_path(spark, tmp_path):
    """Paths come again after 38,800 ids: the SQL joins each file of a path with each."""
    ids = [i + 38_800 * k for i in range(10, 200, 10) for k in range(3)]
    text = ", ".join(f"({i}, 'text', 'src1')" for i in ids)
    spark.sql(f"SELECT * FROM VALUES {text} AS t(doc_id, text, source)").selectExpr("CAST(doc_id AS long) AS doc_id", "text", "source").write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(db.sql(catalog.ORACLE_SQL["move_order"]).fetchall())
    got = sorted(tuple(r) for r in catalog.QUERIES["move_order"](spark, str(tmp_path)).select("path", "dest", "place").collect())
    assert got == want and len(want) > len({path for path, _, _ in want})


def test_leaks_that_no_fingerprint_comes_near(spark):
    """With a radius of none only equal windows are near: edited, cut and moved passages are found all the same."""
    words = lambda k, n: [f"w{k}x{i}" for i in range(n)]
    items = [(k, " ".join(words(k, 60))) for k in range(6)]
    edited = lambda k: [*words(k, 60)[:57], "other", *words(k, 60)[58:]]
    docs = [(0, words(0, 60)), (1, edited(1)), (2, words(2, 60)[:50]), (3, ["before", *words(3, 60)[28:], *words(3, 60)[:28], "after"]), (4, words(4, 30)), (5, [f"v{i}" for i in range(80)])]
    frames = spark.createDataFrame([(k, " ".join(w)) for k, w in docs], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.find_leaks(*frames, radius=0).collect()}
    assert got == {(r.doc_id, r.item_id): r.similarity for r in decontaminate.find_leaks(*frames).collect()}
    assert got.keys() == {(0, 0), (1, 1), (2, 2), (3, 3)}


def test_a_history_is_marked_by_stretches(spark):
    """A stretch is all that a Python worker holds: many small ones in each range give the same history."""
    rng, kept, told = random.Random(5), [], {}
    runs_ = [(f"/r{min(int(rng.expovariate(0.2)), 30)}", k, k % 7, k % 3, 100 + k) for k in range(3_000)]
    for folder, _, deleted, failed, size in runs_:
        before = told[folder] if folder in kept else (0, 0, 0, 0, 0, 0, 0)
        told[folder] = (before[0] + 1, deleted, failed, size, before[4] + deleted, before[5] + failed, before[6] + size)
        kept = [folder, *(f for f in kept if f != folder)][:12]
    history = spark.createDataFrame(runs_, "folder string, at long, deleted long, failed long, bytes long")
    got = recency.folder_history(history, stretch_bits=4)
    assert sorted(tuple(r) for r in got.collect()) == sorted((f, *told[f], k + 1) for k, f in enumerate(kept))


def test_circles_of_links_end_where_they_close(spark, monkeypatch):
    """A circle takes a round for each of its links and one more, not forty; long chains and growing paths are as they were."""
    rounds, plain = [], links.written
    monkeypatch.setattr(links, "written", lambda df, name: rounds.append(name) or plain(df, name))
    known = [("/a/x", "../b/x"), ("/b/x", "/a/x"), ("/self", "self"), *[(f"/c{k}", f"/c{k + 1}") for k in range(5)]]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    asked = ["/a/x/1.jpg", "/b/x/deep/2.jpg", "/self/3.jpg", "/c0/4.jpg", "/a/y/../5.jpg", "no/root", "/c4"]
    got = dict(tuple(r) for r in links.resolved(frame([(p,) for p in asked], "path string"), frame(known, "path string, target string")).collect())
    assert got == {"/a/x/1.jpg": None, "/b/x/deep/2.jpg": None, "/self/3.jpg": None, "/c0/4.jpg": "/c5/4.jpg", "/a/y/../5.jpg": "/a/5.jpg", "no/root": None, "/c4": "/c5"}
    assert len(rounds) == 6
    grows = links.resolved(frame([("/g/1.jpg",), ("/h/2.jpg",)], "path string"), frame([("/g", "/g/g"), ("/h", "/i")], "path string, target string"), most=3)
    assert dict(tuple(r) for r in grows.collect()) == {"/g/1.jpg": None, "/h/2.jpg": "/i/2.jpg"}


def test_files_are_dealt_to_all_tasks(spark, tmp_path, monkeypatch):
    """Marks go job by job and not folder by folder, and rows that would all fit in one task are spread before files are touched."""
    shown, plain = {}, actions.written

    def kept(df, name):
        out = plain(df.withColumn("__task", F.spark_partition_id()), name)
        shown.setdefault(df.columns[0] + df.columns[-1], []).append(out.select("__task").distinct().count())
        return out.drop("__task")

    monkeypatch.setattr(actions, "written", kept)
    (tmp_path / "from").mkdir()
    for k in range(40):
        (tmp_path / "from" / f"{k}.txt").write_text(f"text {k}")
    jobs = spark.createDataFrame([(k, f"{tmp_path}/from/{k}.txt", f"{tmp_path}/to/{k}.txt", None) for k in range(40)], "ordinal long, source string, dest string, identity string").coalesce(1)
    done = actions.copy_files(jobs)
    assert {r.status for r in done.collect()} == {"COPIED"} and sorted(p.name for p in (tmp_path / "to").iterdir()) == sorted(f"{k}.txt" for k in range(40))
    assert min(shown["ordinalgone"]) > 1
    gone = actions.trash(done.select(F.col("dest").alias("path"), F.col("bytes").alias("size")).coalesce(1), f"{tmp_path}/bin")
    assert gone.where("trashURL IS NULL").count() == 0 and min(shown["originalPathmessage"]) > 1
    assert actions.restore(gone.coalesce(1), [str(tmp_path)]).where("status = 'restored'").count() == 40
    assert min(shown["originalPathmessage"]) > 1 and min(shown["heldheld"]) > 1 and not list((tmp_path / "bin").rglob("*.restored"))
