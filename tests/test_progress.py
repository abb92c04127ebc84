"""Speed by accepted samples, folder history with eviction, names for several requests: each against a step-by-step reading."""

import random

import pytest

from framehouse.operators import progress, recency, tables


def accepted(samples, least=0.5):
    out = set()
    for run in {s[0] for s in samples}:
        base = None
        for _, at, done, total in sorted((s for s in samples if s[0] == run), key=lambda s: s[1:]):
            if base is None:
                base = at, done
            elif at - base[0] >= least:
                speed = (done - base[1]) / (at - base[0])
                out.add((run, at, speed, (total - done) / speed if speed > 0 else None))
                base = at, done
    return out


SAMPLES = "run string, at double, done double, total double"


def test_samples_closer_than_the_least_give_every_second_one(spark):
    samples = [("a", 0.3 * i, 100.0 * i, 900.0) for i in range(6)]
    got = {tuple(r) for r in progress.speeds(spark.createDataFrame(samples, SAMPLES)).collect()}
    assert got == accepted(samples) and len(got) == 2
    assert progress.speeds(spark.createDataFrame([], SAMPLES)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_speeds_of_a_hot_run_over_many_ranges(spark, seed):
    rng = random.Random(seed)
    samples = [("hot", t, t * rng.choice([1, 0.5]), 9e5) for t in (sum(rng.choice([0.01, 0.1, 0.25, 0.3, 7]) for _ in range(1)) + i * 0.13 for i in range(900))]
    samples += [(None, float(i), 5.0, 9.0) for i in range(5)] + [(f"r{i}", float(j), float(j), 100.0) for i in range(20) for j in range(3)]
    table = spark.createDataFrame(samples + [("hot", None, 1.0, 1.0), ("hot", 1.0, None, 1.0)], SAMPLES)
    assert {tuple(r) for r in progress.speeds(table).collect()} == accepted(samples)


def test_folder_that_fell_out_begins_again(spark):
    rng = random.Random(5)
    names = [f"/f{i}" for i in range(20)]
    rows = [(f" {rng.choice(names[: 4 + k // 40])} ", k, rng.randint(0, 9), rng.choice([None, 1]), rng.randint(0, 99)) for k in range(600)] + [("  ", 700, 1, 1, 1)]
    kept = []
    for folder, _, deleted, failed, size in rows:
        folder = folder.strip()
        if not folder:
            continue
        was = next((r for r in kept if r[0] == folder), (folder, 0, 0, 0, 0, 0, 0, 0))
        new = (folder, was[1] + 1, deleted, failed or 0, size, was[5] + deleted, was[6] + (failed or 0), was[7] + size)
        kept = [new, *(r for r in kept if r[0] != folder)][:12]
    table = spark.createDataFrame(rows, "folder string, at int, deleted int, failed int, bytes int").repartition(7)
    got = sorted((tuple(r) for r in recency.folder_history(table).collect()), key=lambda r: r[-1])
    assert got == [(*r, k + 1) for k, r in enumerate(kept)]
    assert recency.folder_history(table.limit(0)).count() == 0


def test_names_for_several_requests(spark):
    taken = ["/d/a.jpg", "/d/a_collision_2.jpg", "/d/a_collision_3.jpg", "/d/a_collision_7.jpg", "/d/a_collision_07.jpg", "/d/b_collision_1.jpg"]
    wanted = [(i, "/d/a.jpg") for i in range(5)] + [(10, "/d/b.jpg"), (11, "/d/b.jpg"), (12, "/d/c.jpg"), (13, "/d/a_collision_5.jpg"), (14, "/d/a_collision_5.jpg")]
    got = {r.ordinal: r.free for r in tables.collision_names(spark.createDataFrame(wanted, "ordinal int, path string"), spark.createDataFrame([(t,) for t in taken], "path string")).collect()}
    numbers = [1, 4, 6, 8, 9]  # 5 is another request's own name
    assert got == {**{i: f"/d/a_collision_{n}.jpg" for i, n in enumerate(numbers)}, 10: "/d/b.jpg", 11: "/d/b_collision_2.jpg", 12: "/d/c.jpg", 13: "/d/a_collision_5.jpg", 14: "/d/a_collision_5_collision_1.jpg"}
    few = tables.collision_names(spark.createDataFrame(wanted[:5], "ordinal int, path string"), spark.createDataFrame([(t,) for t in taken], "path string"), most=4)
    assert sorted(str(r.free) for r in few.collect()) == ["/d/a_collision_1.jpg", "/d/a_collision_4.jpg", "None", "None", "None"]
