import random

import numpy as np

from framehouse.llm import quality, toxicity

DIR = "/root/testdata/sf0.01"


def held_out_rows(spark, scored, label):
    labels = spark.read.parquet(f"{DIR}/labels.parquet").select("doc_id", label)
    return scored.join(labels, "doc_id").collect()


def test_quality_on_rated_documents(spark):
    docs, labels = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "labels"))
    out = quality.classify(docs, labels.where("doc_id % 3 <> 0"))
    assert out.count() == docs.count()
    rows = [r for r in held_out_rows(spark, out, "quality") if r.doc_id % 3 == 0]
    assert np.mean([r.selected == (r.quality == 1) for r in rows]) > 0.95


def test_ordinal_grades_and_ordered_thresholds():
    rng = np.random.default_rng(5)
    texts, grades = [], []
    for _ in range(400):
        g = int(rng.integers(0, 4))
        words = ["good" if rng.random() < 0.1 + 0.25 * g else "bad" for _ in range(40)]
        texts.append(" ".join(words)), grades.append(g)
    model = quality.fit([quality.features(t) for t in texts], np.array(grades))
    assert (np.diff(model.thresholds) > 0).all() and model.grades == 4
    expected = model.tails(np.array([quality.ChunkScores(model).score(t) for t in texts])).sum(1)
    assert np.corrcoef(expected, grades)[0, 1] > 0.85


def test_quality_edges(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")
    docs = spark.createDataFrame([(1, "fine words here", 0.5), (2, "BAD!! BAD!!", 1.0), (3, None, 2.0), (3, "", None), (None, "x " * 50000, 0.0)], "doc_id long, text string, quality_tail double").drop("quality_tail")
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == 5 and len({r.tail_probability for r in rows if r.doc_id == 3}) == 1
    assert quality.classify(docs.limit(0), labels).count() == 0
    assert all(r.selected for r in quality.classify(docs, labels.where("quality = 1")).collect())
    assert not any(r.selected for r in quality.classify(docs, labels.limit(0)).collect())


def test_words_and_subwords_together_are_those_of_each():
    rng = random.Random(5)
    letters = "abcxyz019ÀßéжяΣς漢字İ𝒳٣"
    words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, 12))).lower() for _ in range(400)} | {"a", "aaaaaaaa", "abababab", "\ud800b"})
    buckets, sizes = toxicity.bags(words)
    at = 0
    for w, n in zip(words, sizes.tolist()):
        assert sorted(buckets[at : at + n].tolist()) == sorted(toxicity.subwords(w)), w
        at += n
    assert at == len(buckets) and len(toxicity.bags([])[0]) == 0
    spaces = " \t\n\x1c\x85\xa0\u3000_,.-"
    for _ in range(300):
        text = "".join(rng.choice(letters + letters + spaces) for _ in range(rng.randint(0, 300)))
        assert toxicity.distinct_words(text) == set(toxicity.words_of(text))


def test_toxicity_on_held_out_documents(spark):
    """The held-out fifth of the largest table: ranking, and the threshold that training rows gave, against calling nothing toxic."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.classify(docs, labels).cache()
    assert out.count() == docs.count()
    known = labels.select("doc_id", "toxic").where("toxic IS NOT NULL")
    rows = [r for r in out.join(known, "doc_id").collect() if r.held_out]
    z, y, called = (np.array([r[c] for r in rows]) for c in ("score", "toxic", "predicted"))
    place = np.empty(len(z))
    place[np.argsort(z, kind="stable")] = np.arange(1, len(z) + 1)
    n = int(y.sum())
    auc = (place[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))
    hits = int((called * y).sum())
    assert n > 50 and auc >= 0.9 and hits >= 0.7 * n and hits >= 0.75 * called.sum()
    assert (called == y).mean() > max(y.mean(), 1 - y.mean()) and 0 <= z.min() <= z.max() <= 1


def test_threshold_of_the_largest_f1():
    rng = np.random.default_rng(1)
    z, y, w = np.round(rng.normal(0, 1, 60), 1), rng.integers(0, 2, 60), rng.uniform(0.5, 2, 60)
    f1 = lambda t: 2 * (w * y)[z >= t].sum() / (w[z >= t].sum() + (w * y).sum())
    assert abs(f1(toxicity.best_shift(z, y, w)) - max(f1(t) for t in z)) < 1e-12


def test_misspellings_share_vectors():
    rng = np.random.default_rng(2)
    calm = lambda n: " ".join(rng.choice(["river", "stone", "paper", "window", "garden", "silver"], n))
    texts = [calm(30) for _ in range(60)] + [f"{calm(15)} dreadful horrible {calm(15)}" for _ in range(60)]
    scores = toxicity.WordLogits(toxicity.fit(texts, np.array([0] * 60 + [1] * 60)))
    assert scores.scores([f"{calm(10)} dreadfull horribble {calm(10)}"])[0] > 0.5 > scores.scores([calm(500)])[0]


def test_long_runs_are_read_to_their_end():
    rng = np.random.default_rng(2)
    calm = lambda n: " ".join(rng.choice(["river", "stone", "paper", "window", "garden", "silver"], n))
    texts = [calm(30) for _ in range(60)] + [f"{calm(15)} dreadful horrible {calm(15)}" for _ in range(60)]
    scores = toxicity.WordLogits(toxicity.fit(texts, np.array([0] * 60 + [1] * 60)))
    plain = "riverstonepaperwindowgardensilver" * 4
    assert scores.scores([plain + "dreadfulhorrible" * 8])[0] > 0.5 > scores.scores([plain])[0]
    assert scores.scores([plain + "dreadfulhorrible" * 8 + plain])[0] > 0.5
    run = "".join(map(chr, rng.integers(97, 123, 1000)))
    for n in (59, 60, 61, 64, 65, 116, 117, 1000):
        pieces = toxicity.words_of(run[:n])
        assert {p[i : i + 5] for p in pieces for i in range(len(p) - 4)} == {run[i : i + 5] for i in range(n - 4)} and max(map(len, pieces)) <= 60
    assert quality.chunk_buckets("a" * 40 + "-x1")[1] != quality.chunk_buckets("a" * 40 + "?x1")[1]


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None, 1), (1, "", 2), (None, "a " * 60000, 3)], "doc_id long, text string, score int")
    one = spark.createDataFrame([(5, 1)], "doc_id long, toxic int")
    for labels in (one, one.limit(0)):
        rows = toxicity.classify(docs, labels).collect()
        assert len(rows) == 3 and all(0 <= r.score <= 1 for r in rows) and not any(r.held_out for r in rows if r.doc_id is None)
    assert toxicity.classify(docs.limit(0), one).count() == 0


def test_gradient_of_the_ordinal_likelihood():
    rng = np.random.default_rng(8)
    n, d, k = 12, 5, 4
    x, grades, weight = rng.normal(0, 1, (n, d)), rng.integers(0, k, n), rng.uniform(0.5, 2, n)
    row, ids = (a.ravel() for a in np.indices((n, d)))
    theta = rng.normal(0, 0.7, d + k - 1)

    def plain(theta):
        cuts, total = [theta[d], theta[d] + np.exp(theta[d + 1]), theta[d] + np.exp(theta[d + 1]) + np.exp(theta[d + 2])], 0.0
        for i in range(n):
            tails = [1.0, *(1 / (1 + np.exp(t - x[i] @ theta[:d])) for t in cuts), 0.0]
            total -= weight[i] * np.log(tails[grades[i]] - tails[grades[i] + 1])
        return total / n + 0.5e-5 * (theta[:d] ** 2).sum()

    value, gradient = quality.loss(theta, ids, x.ravel(), row, grades, weight, k)
    assert abs(value - plain(theta)) < 1e-9
    for j in range(len(theta)):
        e = np.zeros(len(theta))
        e[j] = 1e-6
        assert abs((plain(theta + e) - plain(theta - e)) / 2e-6 - gradient[j]) < 1e-6


def test_scores_of_all_documents_against_a_plain_reading(spark):
    import re
    import zlib

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    for r in docs.collect():
        vectors = []
        for word in sorted(set(re.findall(r"[^\W_]+", r.text.lower()))):
            marked = f"<{word}>"
            grams = {marked} | {marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1)}
            vectors.append(np.mean([model.vectors[zlib.crc32(g.encode()) % toxicity.BUCKETS] for g in grams], axis=0))
        a, b = (np.mean(vectors, axis=0) @ model.output if vectors else 0) + model.bias
        z = b - a
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-z))) < 1e-9
    grader = quality.train(docs, labels)
    tails = {r.doc_id: r.quality_tail for r in quality.score(docs, grader).collect()}
    for r in docs.collect():
        ids, values = quality.features(r.text)
        score = sum(grader.weights[i] * v for i, v in zip(ids.tolist(), values.tolist()))
        assert abs(tails[r.doc_id] - 1 / (1 + np.exp(grader.thresholds[0] - score))) < 1e-6


def test_a_hot_labelled_id_is_one_row(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    assert quality.rated(docs, labels, "quality", 10, 100).count() == 2
