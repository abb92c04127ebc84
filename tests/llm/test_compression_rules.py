import random
import re
from collections import Counter

import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from framehouse.llm import compression_rules

DIR = "/root/testdata/sf0.01"


def plain(text):
    """The base counts, read off the rules one by one."""
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    runs = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times, covered = Counter(runs), set()
    for i, r in enumerate(runs):
        if times[r] > 1:
            covered.update(range(i, i + 8))
    lines, seen, again = text.split("\n"), set(), 0
    for line in lines:
        if line.strip(" \t\n\v\f\r"):
            again += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(covered), n < 20 or 100 * len(covered) > 30 * n


def verdict(text, failed):
    data = (text or "").encode()
    ratio = lambda b: len(zstandard.ZstdCompressor(level=3).compress(b)) / len(b)
    fits = lambda b: [low <= ratio(b) <= high for at, low, high in compression_rules.BANDS if at <= len(b)][-1]
    if failed or not data or not fits(data):
        return False
    chunks = [data[i : i + 4096] for i in range(0, len(data), 4096)]
    return len(chunks) == 1 or sum(len(c) for c in chunks if not fits(c)) <= len(data) / 4


def test_every_document_against_a_plain_reading(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    got = {tuple(r)[:8] for r in compression_rules.judge(docs).collect()}
    want = set()
    for r in docs.collect():
        base = plain(r.text)
        want.add((r.doc_id, *base, verdict(r.text, base[-1])))
    assert got == want
    assert 0.5 < sum(x[-1] for x in got) / len(got) < 1


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n\t |#é", max_size=120))
def test_base_counts(text):
    assert compression_rules.Judge(compression_rules.Limits()).row(text)[:6] == plain(text)


def test_bands_catch_what_the_base_rules_let_through(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    key = lambda n: " ".join("".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(40)) for _ in range(n))
    stutter = " ".join(w for w in (word() for _ in range(300)) for _ in range(7))
    rows = [(1, prose(30)), (2, prose(400)), (3, prose(9000)), (4, stutter), (5, key(200)), (6, prose(1500) + " " + key(300)), (7, prose(9000) + " " + key(20)), (8, None), (9, ""), (None, prose(50)), (2, prose(400))]
    table = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, kept int")
    got = [(r.doc_id, r.base_failed, r.kept) for r in compression_rules.judge(table).collect()]
    bad = {(4, False, False), (5, False, False), (6, False, False), (8, True, False), (9, True, False)}
    assert {g for g in got if not g[2]} == bad and len(got) == len(rows)
    kept = compression_rules.keep_good(table)
    assert kept.columns == table.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 2, 3, 7]
    assert compression_rules.judge(table.limit(0)).count() == 0
