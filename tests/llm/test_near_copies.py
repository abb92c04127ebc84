import random
import re

import pytest

from framehouse.llm import near_copies


def brute(rows, t=0.8):
    sets = []
    for _, text in rows:
        w = [x for x in re.split(r"[^\w]+|_", (text or "").lower()) if x]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    n = len(rows)
    near = [[j for j in range(n) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j])] for i in range(n)]
    label = list(range(n))
    for _ in range(n):
        new = [min([label[i], *(label[j] for j in near[i])]) for i in range(n)]
        if new == label:
            break
        label = new
    ids = lambda members: min(rows[i][0] for i in members)
    return {rows[i][0]: (ids([j for j in range(n) if label[j] == label[i]]), ids([j for j in range(n) if sets[j] == sets[i] and (sets[i] or j == i)]), len(near[i])) for i in range(n)}


def corpus():
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(300)]
    make = lambda n: [rng.choice(vocab) for _ in range(n)]
    texts = [make(rng.randrange(5, 120)) for _ in range(40)]
    for _ in range(100):
        w = list(rng.choice(texts[:25]))
        for _ in range(rng.randrange(0, 1 + len(w) // 30)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        texts.append(w)
    texts += [[], ["one"], ["one"], ["One", "two"], ["tick"] * 3000, ["tick"] * 9]
    rows = [(i + 100, ", ".join(w)) for i, w in enumerate(texts)] + [(5, None), (6, "...")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [512, 7])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_copies, "BLOCK", block)
    rows = corpus()
    frame = spark.createDataFrame([(*r, 3, "q") for r in rows], "doc_id long, text string, n int, cid string")
    out = near_copies.join(frame).collect()
    assert len(out) == len(rows)
    assert {r.doc_id: (r.class_id, r.copy_id, r.n_links) for r in out} == brute(rows)


def test_one_of_each_class_stays(spark):
    rows = corpus()
    want = {i for i, (c, _, _) in brute(rows).items() if c == i}
    rows += [rows[0], rows[1], (None, rows[2][1])]
    frame = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string")
    kept = near_copies.keep_one(frame)
    assert kept.columns == frame.columns
    ids = [r.doc_id for r in kept.collect()]
    assert set(ids) == want and len(ids) <= len(want) + 2  # repeated rows without words stay
    assert near_copies.join(frame.limit(0)).count() == 0


def test_columns_of_any_name_stay(spark):
    frame = spark.createDataFrame([(1, "a b c d e f", "x", "y", "z"), (2, "a b c d e f", "x2", "y2", "z2"), (3, None, "x3", "y3", "z3")], "doc_id long, text string, __doc string, __text string, row string")
    kept = near_copies.keep_one(frame)
    assert kept.columns == frame.columns and sorted(map(tuple, kept.collect())) == sorted(tuple(r) for r in frame.collect() if r.doc_id != 2)


def test_unrelated_long_texts_do_not_agree():
    import numpy as np

    rng = np.random.default_rng(5)
    a, b = (near_copies.signature(rng.integers(0, 1 << 64, 200_000, np.uint64)) for _ in range(2))
    assert (a == b).mean() < 0.01


def test_large_sets_meet_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK_BYTES", 4000)  # a few sets of a hundred hashes
    rows = corpus()
    out = near_copies.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.class_id, r.copy_id, r.n_links) for r in out} == brute(rows)


def test_pruning_keeps_what_the_posterior_keeps():
    need = near_copies.least_matches(0.8)
    assert need == sorted(need) and all(m < 0.8 * (k + 1) * near_copies.AT_ONCE for k, m in enumerate(need))


def test_incidence_counts_equal_intersections():
    import numpy as np

    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 9000, 700, np.uint64)) for _ in range(12)]
    a, b = np.triu_indices(12, 1)
    assert near_copies.common_counts(sets, sets, a, b).tolist() == [len(np.intersect1d(sets[i], sets[j])) for i, j in zip(a, b)]


def test_a_clique_is_sent_as_often_as_it_has_blocks_and_no_more(spark, monkeypatch):
    """Near copies all of one another: what is shuffled grows with the members, and every pair is linked all the same."""
    monkeypatch.setattr(near_copies, "BLOCK", 16)
    rng = random.Random(6)
    base = [f"b{k}" for k in range(200)]

    def copies(n):
        out = []
        for k in range(n):
            w = list(base)
            w[rng.randrange(len(w))] = f"x{k}"
            out.append((k, " ".join(w)))
        return spark.createDataFrame(out, "doc_id long, text string")

    from pyspark.sql import functions as F

    sent = {}
    for n in (10_000, 20_000):
        one_band = spark.range(n).select(F.lit(0).alias("band"), F.lit(7).cast("long").alias("value"), F.col("id").alias("cid"), F.lit(200).alias("n"))
        sent[n] = near_copies.meetings(one_band).count()
    assert sent[20_000] == 2 * sent[10_000] == 20_000 * near_copies.BLOCKS
    got = near_copies.join(copies(1200)).collect()
    assert len(got) == 1200 and {(r.class_id, r.n_links) for r in got} == {(0, 1199)}


def test_partner_lists_and_roots():
    import numpy as np

    rng = np.random.default_rng(8)
    for n, k in ((1000, 3), (1000, 900), (9, 9), (70, 0)):
        places = np.sort(rng.choice(n, k, replace=False))
        assert near_copies.unpacked(near_copies.packed(places, n)).tolist() == places.tolist()
    assert near_copies.unpacked(b"").tolist() == []
    roots = near_copies.Roots(8)
    for a, b in ((6, [7]), (1, [2, 3]), (5, [3]), (0, [4])):
        roots.link(a, np.array(b))
    assert roots.of.tolist() == [0, 1, 1, 1, 0, 1, 6, 6]
