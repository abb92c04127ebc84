import numpy as np

from framehouse.llm import nearest

DIR = "/root/testdata/sf0.01"


def brute(rows, k, every):
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        score = (v * v[i]).sum(1)
        score[ids == ids[i]] = -np.inf
        best = [j for j in np.lexsort((ids, -score))[:k] if score[j] > -np.inf]
        out[int(ids[i])] = [(int(ids[j]), score[j]) for j in best]
    return out


def test_recall_and_exact_scores(spark):
    table = spark.read.parquet(f"{DIR}/embeddings.parquet")
    got = {}
    for r in nearest.search(table).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    want = brute([(r.vec_id, r.embedding) for r in table.collect()], 20, 20)
    assert got.keys() == want.keys()
    share = [len({a for a, _ in got[q]} & {a for a, _ in want[q]}) / 20 for q in want]
    assert np.mean(share) >= 0.9
    exact = {(q, a): s for q in want for a, s in want[q]}
    assert all(exact.get((q, a), s) == s for q in got for a, s in got[q])


def test_recall_with_many_lists(spark, monkeypatch):
    monkeypatch.setattr(nearest, "PER_ROOT", 8)
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(0, 1, 12) * rng.uniform(0.5, 2)).tolist()) for i in range(3000)]
    got = {(r.query_id, r.vec_id) for r in nearest.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    want = {(q, a) for q, x in brute(rows, 20, 20).items() for a, _ in x}
    assert len(got & want) / len(want) >= 0.9


def test_edges(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0], "a"), (20, [1.0, 0.0], "b"), (3, [1.0, 0.0], "c"), (4, [0.0, 0.0], "d"), (5, None, "e"), (6, [None, 1.0], "f"), (7, [nan, 1.0], "g"), (40, [], "h"), (None, [1.0, 1.0], "i"), (60, [1.0, 2.0, 3.0], "j"), (8, [float("inf"), 1.0], "k"), (3, [1.0, 0.0], "c")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in nearest.search(table).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 3, 1.0), (0, 2, 20, 1.0), (20, 1, 0, 1.0), (20, 2, 3, 1.0)]
    assert nearest.search(table.limit(0)).count() == 0


def test_hot_vector_is_split_and_ties_go_to_smaller_ids(spark):
    rows = [(i, [1.0, 0.5] if i % 3 else [0.2, float(i % 7) / 10 + 0.1]) for i in range(400)]
    got = nearest.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shelf=32).collect()
    want = brute(rows, 20, 20)
    assert {(r.query_id, r.rank, r.vec_id) for r in got} == {(q, k + 1, a) for q, x in want.items() for k, (a, _) in enumerate(x)}


def test_repeated_ids_leave_room_for_others(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [1.0, float(x)]) for i, x in enumerate(rng.uniform(0, 1, 60))]
    rows += [(1, [3.0, 1.0])] * 30 + [(3, [2.0, 1.0 + j / 64]) for j in range(30)]  # of equal and of different vectors
    got = {}
    for r in nearest.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shelf=16).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    vectors = {}
    for i, v in rows:
        vectors.setdefault(i, []).append(v)
    for q in (0, 20, 40):
        score = {i: max(float(np.dot(v, vectors[q][0])) for v in vs) for i, vs in vectors.items() if i != q}
        want = sorted(score, key=lambda i: (-score[i], i))[:20]
        assert got[q].keys() == set(want) and all(abs(got[q][i] - score[i]) < 1e-12 for i in want)
