import base64
import hashlib
import random

from framehouse.llm import warc


def test_round_trip(spark):
    rows = [(i, f"http://h{i % 3}.example.com/p{i % 5}", f"<p>page {i % 7}</p>" if i % 4 else None, "x") for i in range(60)]
    rows += [(None, None, "<p>page 1</p>", "y"), (None, "no scheme", "alone é\r\n\r\nx", "y"), (59, "http://again", "<p>page 3</p>", "z"), (1000, "http://e", "", None)]
    got = warc.capture_history(spark.createDataFrame(rows, "page_id long, url string, html string, sha string").repartition(3)).collect()
    assert len(got) == len(rows)
    groups = {}
    for p, _, h, _ in rows:
        groups.setdefault(h or "", []).append(p)
    want = []
    for p, _, h, _ in rows:
        body = (h or "").encode()
        top = max((x for x in groups[h or ""] if x is not None), default=None)
        refers = top if len(groups[h or ""]) > 1 and p != top else None
        want.append((p, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if refers is not None else "response", refers))
    assert sorted(map(str, want)) == sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got)
    order = [(r.url_key, r.captured) for r in sorted(got, key=lambda r: r.history_no)]
    assert order == sorted(order) and sorted(r.history_no for r in got) == list(range(len(got)))


def test_many_archives_in_a_task_and_many_ranges(spark, monkeypatch):
    rows = [(i, f"http://h{i * 7 % 11}.org/p{i % 13}", f"body {i % 29} " * 9) for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    from framehouse.plans.lineage import fresh_path, written

    path = fresh_path(spark, "warc")
    archives = warc.write_archives(pages, path, archive_bytes=1500)
    assert archives.count() > 40
    captures = written(warc.read_captures(archives, path, fan=5), "captures")
    got = sorted(warc.merged_index(captures, 6).collect(), key=lambda r: (r.range_no, r.position))
    keys = [(r.url_key, r.captured, r.page_id) for r in got]
    assert keys == sorted(keys) and len({r.range_no for r in got}) > 3
    assert sorted(r.page_id for r in got) == list(range(400))


def test_reading_an_archive_takes_time_in_proportion():
    import time

    one = warc.record(1, "http://a.org/x", random.Random(1).randbytes(3000), None)

    def seconds(n):
        began = time.perf_counter()
        assert sum(1 for _ in warc.records(one * n)) == n
        return time.perf_counter() - began

    seconds(500)
    assert seconds(8000) < 16 * min(seconds(1000) for _ in range(3)) + 0.5  # eight times as much; copying the rest each time would take 64 times
    assert [r[0] for r in warc.records(one * 3)] == [0, len(one), 2 * len(one)]


def test_empty(spark):
    assert warc.capture_history(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_loser_tree():
    rng = random.Random(3)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(9))) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_url_key():
    assert warc.url_key("https://WWW.b.Example.com:443/A?q#f") == "com,example,b)/a?q"
