import hashlib
from fractions import Fraction

import numpy as np

from framehouse.llm import codes, whitening

DIR = "/root/testdata/sf0.01"
NAN, INF = float("nan"), float("inf")
ODD = [(90, None, 1), (91, [], 1), (92, [None, 1.0], 1), (93, [NAN, 1.0], 1), (94, [INF, 1.0], 1), (95, [1.0, 2.0, 3.0], 1), (96, [1e30, 0.0], 1)]


def whole(rows):
    return np.floor(1024 * np.array([list(r) for r in rows], float)).astype(np.int64)


def checked_whitening(got, ids, x, components=8):
    n, d = x.shape
    k = min(components, d)
    assert len(got) == n * k and {r.n for r in got} == {n}
    sums = [sum(c) for c in zip(*x.tolist())]
    exact = np.array([[Fraction(n * a - s, n) for a, s in zip(row, sums)] for row in x.tolist()], dtype=object)
    cov = (exact.T @ exact / n).astype(float)
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    want = (exact.astype(float) @ axes[:, :k]) / np.sqrt(values[:k])
    deviation = {(i, sum((n * a - s) ** 2 for a, s in zip(row, sums))) for i, row in zip(ids, x.tolist())}
    assert {(r.vec_id, r.deviation) for r in got} == deviation
    at = {}
    for r in got:
        at.setdefault(r.component, {})[r.vec_id] = r
    for c in range(1, k + 1):
        z = np.array([at[c][i].whitened for i in ids])
        w = want[:, c - 1]
        assert np.abs(z * np.sign(z @ w) - w).max() < 1e-8
        assert abs(at[c][ids[0]].explained - values[c - 1] / np.trace(cov)) < 1e-10
    errors = {r.identity_error for r in got}
    assert len(errors) == 1 and errors.pop() < 1e-9


def test_whitening_of_the_table(spark):
    table = spark.read.parquet(f"{DIR}/embeddings.parquet")
    rows = table.orderBy("vec_id").collect()
    checked_whitening(whitening.whiten(table.repartition(7)).collect(), [r.vec_id for r in rows], whole([r.embedding for r in rows]) + 100_000)


def test_whitening_with_small_spread_and_odd_rows(spark):
    """One dimension spreads over a few whole numbers, another over thousands; their covariance is not lost."""
    rng = np.random.default_rng(2)
    rows = [(i, [float(rng.normal(0, 9)), float(900 + rng.integers(0, 3) / 1024)], 0) for i in range(300)]
    table = spark.createDataFrame(rows + ODD, "vec_id long, embedding array<double>, component int")
    checked_whitening(whitening.whiten(table).collect(), [r[0] for r in rows], whole([r[1] for r in rows]) + 100_000)
    assert whitening.whiten(table.limit(0)).count() == 0 and whitening.whiten(table.where("vec_id > 1000")).count() == 0


def test_whitening_of_degenerate_rows(spark):
    table = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, 4.0])], "vec_id long, embedding array<double>")
    got = sorted(whitening.whiten(table).collect(), key=repr)
    assert [(r.vec_id, r.component) for r in got].count((1, 1)) == 2 and any(r.vec_id is None for r in got)
    assert all(r.whitened is None for r in got if r.component == 2) and all(abs(r.identity_error) < 1e-12 for r in got)
    one = whitening.whiten(table.where("vec_id IS NULL")).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, 0.0, None)] * 2


def test_deviations_beyond_fast_arithmetic():
    x, n = np.array([[3_000_000, 1], [5, 7]]), 2000
    sums = np.array([4_000_000_000, 9000])
    assert whitening.deviations(x, n, sums) == [(n * 3_000_000 - 4_000_000_000) ** 2 + (n - 9000) ** 2, None]
    assert whitening.deviations(np.array([[2**30]]), 2**33, np.array([0])) == [None]


def test_jacobi_keeps_small_eigenvalues():
    scale = np.array([1.0, 1e-5, 1e-9])
    core = np.array([[1, 0.5, 0.25], [0.5, 1, 0.5], [0.25, 0.5, 1]])
    graded = core * np.outer(scale, scale)
    values, axes = whitening.jacobi(graded)
    assert np.allclose(axes.T @ axes, np.eye(3), atol=1e-14)
    # The smallest is det / (product of the two larger), known to high relative accuracy.
    det = np.linalg.det(core) * np.prod(scale) ** 2
    assert abs(values.prod() / det - 1) < 1e-10


def plain_codes(rows, rounds=4, parts=4, entries=256):
    """rows: (vec_id, label, vector), in the order of vec_id."""
    x = whole([r[2] for r in rows])
    w = x.shape[1] // parts
    cut = x.reshape(len(x), parts, w)
    books = [[cut[i, p].tolist() for i in range(min(entries, len(x)))] for p in range(parts)]
    for step in range(rounds + 1):
        gap = [((cut[:, p, None, :] - np.array(books[p])[None]) ** 2).sum(2) for p in range(parts)]
        near = [g.argmin(1) for g in gap]
        if step < rounds:
            for p in range(parts):
                for e in set(near[p].tolist()):
                    mine = cut[near[p] == e, p]
                    books[p][e] = [int(s) // len(mine) for s in mine.sum(0)]
    error = sum(g.min(1) for g in gap)
    by_label = {}
    for r, e in zip(rows, error.tolist()):
        by_label[r[1]] = by_label.get(r[1], 0) + e
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return {(r[0], "".join(f"{near[p][i]:02x}" for p in range(parts)), int(error[i]), by_label[r[1]], sha) for i, r in enumerate(rows)}


def test_codes_of_a_table_with_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, None if i % 5 == 0 else i % 3, np.round(rng.normal(0, 0.02 if i % 2 else 0.5, 12), 2).tolist()) for i in range(700)]
    odd = [(1000 + i, 1, v) for i, v, _ in ODD]
    table = spark.createDataFrame([(a, c, b) for a, b, c in rows + odd], "vec_id long, embedding array<double>, label int").repartition(5)
    got = codes.compress(table.withColumn("code", table.label)).collect()
    assert len(got) == 700 and {tuple(r) for r in got} == plain_codes(rows)
    assert codes.compress(table.limit(0)).count() == 0


def test_codes_of_few_repeated_vectors(spark):
    """Ties go to the lower entry; a length of 5 is filled up to 8."""
    rows = [(1, 7, [0.1] * 5), (2, 7, [0.1] * 5), (3, None, [0.9, 0.1, 0.1, 0.1, 0.3])]
    table = spark.createDataFrame([(a, c, b) for a, b, c in rows], "vec_id long, embedding array<double>, label int")
    padded = [(a, b, c + [0.0] * 3) for a, b, c in rows]
    assert {tuple(r) for r in codes.compress(table).collect()} == plain_codes(padded)


def test_nearest_entries_prunes_nothing_that_is_nearest():
    rng = np.random.default_rng(5)
    for spread in (3, 1000, 60_000_000):
        x, book = rng.integers(-spread, spread, (500, 16)), rng.integers(-spread, spread, (256, 16))
        book[100:120] = book[50:70]
        x[:40] = book[30:70]
        gap = ((x[:, None] - book[None]) ** 2).sum(2)
        at, best = codes.nearest_entries(x, book)
        assert (at == gap.argmin(1)).all() and (best == gap.min(1)).all()
