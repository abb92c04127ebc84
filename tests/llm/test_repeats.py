import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from framehouse.llm import repeats


def brute(texts, width):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + width] for d in data for i in range(len(d) - width + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - width + 1):
            if seen[d[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        n = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), n, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    words = [rng.choice(["über", "niño", "plain", "x"]) + str(i) for i in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [prose(60) for _ in range(4)]
    texts = [prose(rng.randrange(1, 200)) for _ in range(30)]
    texts += [prose(rng.randrange(0, 40)) + rng.choice(passages) + prose(rng.randrange(0, 40)) for _ in range(30)]
    texts += ["a" * 1000, "ab" * 300, "tick " * 90, None, "", "é" * 100, "é" * 101, "short"]
    copy = texts[3]
    near = copy[: len(copy) // 2] + "!" + copy[len(copy) // 2 :]
    inside = prose(50) + passages[0] + " " + passages[0]
    return [*texts, copy, copy, near, inside, passages[1], passages[1][:190], "s" * 199, "s" * 199]


@pytest.mark.parametrize("most", [None, 1500, 300])
def test_against_brute_force(spark, monkeypatch, most):
    if most:
        monkeypatch.setattr(repeats, "BUCKET_BYTES", 20_000)
        monkeypatch.setattr(repeats, "MOST_BYTES", most)  # some anchors are cut finer, once or twice
    texts = corpus(5)
    frame = spark.createDataFrame([(i, t, i, "k") for i, t in enumerate(texts)], "doc_id long, text string, n_bytes long, key string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.digest_repeats(frame).collect()}
    want = dict(enumerate(brute(texts, 200)))
    assert got == want


def test_merge_of_many_shards_equals_one_sort():
    rng = np.random.default_rng(2)
    shards = [rng.integers(97, 99, n).astype(np.uint8) for n in (40, 9, 64, 100)]
    suffix, common, _ = repeats.merged(shards, 24)
    rotations = [bytes(np.roll(s, -i))[:24].ljust(24, b"~") if len(s) >= 24 else (bytes(np.roll(s, -i)) * 4)[:24] for s in shards for i in range(len(s))]
    order = [rotations[i] for i in suffix]
    assert order == sorted(rotations) and sorted(suffix.tolist()) == list(range(len(rotations)))
    shared = lambda a, b: next((k for k in range(24) if a[k] != b[k]), 24)
    assert common.tolist()[1:] == [shared(a, b) // 8 * 8 for a, b in zip(order, order[1:])]


def test_columns_of_any_name_stay(spark):
    texts = corpus(7)[:40] + ["same passage " * 30] * 2 + ["", None]
    rows = [(i, t, "k", "h", "kept", "removed", i) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, __key string, __had string, key string, had string, row int")
    out = repeats.remove_repeats(frame)
    assert out.columns == frame.columns
    got = {r.doc_id: r for r in out.collect()}
    assert all(tuple(got[i])[2:] == r[2:] for i, r in enumerate(rows)) and got[len(rows) - 1].text is None
    left = {r.doc_id for r in repeats.remove_repeats(frame, drop_emptied=True).collect()}
    assert left == {i for i, r in enumerate(rows) if not r[1] or got[i].text}


def test_rows_and_columns_stay(spark):
    texts = corpus(6)
    rows = [(i, t, "z", len(t or "")) for i, t in enumerate(texts)] + [(None, texts[0], "z", 4)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_chars int")
    out = repeats.remove_repeats(frame)
    assert out.columns == frame.columns and out.count() == len(rows)
    got = {r.doc_id: r for r in out.collect()}
    want = brute([r[1] for r in rows], 200)
    same = [i for i, w in enumerate(want[:-1]) if w[1] == 0]
    assert all(got[i].text == texts[i] for i in same)
    assert all(got[i].n_chars == len(got[i].text) for i, w in enumerate(want[:-1]) if w[1])
    assert repeats.digest_repeats(frame.limit(0)).count() == 0
