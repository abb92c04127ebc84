import random
import re
from collections import Counter

from framehouse.llm import decontaminate as d


def brute(docs, items):
    words = lambda t: [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]
    sh = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    out = {}
    for doc, text in docs:
        a = sh(words(text))
        for item, t in items:
            b, best = sh(words(t)), None
            for s in {i - j for i, x in enumerate(a) for j, y in enumerate(b) if x == y}:
                lo, hi = max(0, s), min(len(a), s + len(b))
                ca, cb = Counter(a[lo:hi]), Counter(b)
                common = sum((ca & cb).values())
                sim = common / (hi - lo + len(b) - common)
                if sim >= 0.8 and (best is None or (sim, -lo) > best[:2]):
                    best = (sim, -lo, hi - lo + 4)
            if best:
                out[doc, item] = (-best[1], best[2], best[0])
    return out


def test_against_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(60)]
    make = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, make(rng.randrange(6, 40))) for i in range(12)] + [(50, ["tick"] * 20), (51, make(3)), (52, [])]
    docs = []
    for k in range(60):
        passage = list(rng.choice(items)[1])
        if k % 3 == 1 and len(passage) > 12:
            passage[rng.randrange(len(passage))] = "edited"
        if k % 3 == 2 and passage:
            passage.insert(rng.randrange(len(passage)), "more")
        docs.append((k, ", ".join(make(rng.randrange(0, 30)) + passage + make(rng.randrange(0, 30))).upper()))
    docs += [(100, None), (101, ""), (102, " ".join(["tick"] * 4000)), (102, " ".join(["tick"] * 4000)), (103, " ".join(items[3][1]))]
    items = [(i, " ".join(w)) for i, w in items] + [(99, None)]
    frame = spark.createDataFrame([(*x, 1, "z") for x in docs], "doc_id long, text string, n long, fp string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start, r.n_words, r.similarity) for r in d.find_leaks(frame, bench).collect()}
    want = brute(dict(docs).items(), items)
    assert got.keys() == want.keys()
    assert all(got[k][:2] == want[k][:2] and abs(got[k][2] - want[k][2]) < 1e-12 for k in want)
    kept = {r.doc_id for r in d.decontaminate(frame, bench).collect()}
    assert kept == {k for k, _ in docs} - {k for k, _ in want}
    assert d.find_leaks(frame.limit(0), bench).count() == 0 and d.find_leaks(frame, bench.limit(0)).count() == 0


def slid(docs, items):
    """The best similarity over the windows at all starts, aligned to a shared shingle or not."""
    words = lambda t: [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]
    sh = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    out = {}
    for doc, text in docs:
        a = sh(words(text))
        for item, t in items:
            b = sh(words(t))
            for s in range(1 - len(b), len(a)):
                lo, hi = max(0, s), min(len(a), s + len(b))
                common = sum((Counter(a[lo:hi]) & Counter(b)).values())
                sim = common / (hi - lo + len(b) - common)
                if sim >= 0.8 and sim > out.get((doc, item), 0):
                    out[doc, item] = sim
    return out


def test_windows_stand_at_every_start(spark):
    rng = random.Random(8)
    make = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    a, b, c = make(27), make(27), make(30)
    items = [(1, a + b), (2, c), (3, ["tick"] * 9 + ["tock"] * 9), (4, make(9))]
    docs = [(1, make(9) + b + a + make(9)), (2, b + a), (3, c[1:-1]), (4, make(3) + ["tock"] * 40 + ["tick"] * 40), (5, a), (6, items[3][1][1:]), (7, b[:20] + make(4) + a)]
    # Few words, so that shingles repeat and stand at many places.
    for k in range(40):
        passage = [rng.choice("pq") for _ in range(rng.randrange(9, 24))]
        turn = rng.randrange(len(passage))
        items.append((10 + k, passage))
        docs.append((10 + k, [rng.choice("pq") for _ in range(rng.randrange(0, 9))] + passage[turn:] + passage[:turn]))
    docs, items = ([(i, " ".join(w)) for i, w in x] for x in (docs, items))
    got = {(r.doc_id, r.item_id): r.similarity for r in d.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = slid(docs, items)
    assert {(1, 1), (2, 1)} <= want.keys() and want.keys() != brute(docs, items).keys()
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_only_leaked_rows_of_a_doc_id_go(spark):
    leak, clean = " ".join(f"w{i}" for i in range(20)), " ".join(f"v{i}" for i in range(20))
    docs = spark.createDataFrame([(None, leak), (None, clean), (None, None), (7, leak), (7, leak), (7, clean), (7, None), (8, clean)], "doc_id long, text string")
    kept = [tuple(r) for r in d.decontaminate(docs, spark.createDataFrame([(1, leak)], "item_id long, text string")).collect()]
    assert sorted(kept, key=str) == sorted([(None, clean), (None, None), (7, clean), (7, None), (8, clean)], key=str)


def test_blocks_hold_every_fingerprint_within_59_bits(spark):
    from pyspark.sql import functions as F

    rng = random.Random(1)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = []
    for _ in range(300):
        a = [rng.getrandbits(64) for _ in range(d.PRINTS)]
        b = list(a)
        for bit in rng.sample(range(d.PRINTS * d.BITS), d.PRINTS * d.BITS // d.BLOCK - 1):
            b[bit // d.BITS] ^= 1 << bit % d.BITS
        rows.append(([signed(x) for x in a], [signed(x ^ (rng.getrandbits(4) << 60)) for x in b]))
    df = spark.createDataFrame(rows, "a array<long>, b array<long>")
    assert df.where(F.arrays_overlap(d.blocks(F.col("a")), d.blocks(F.col("b")))).where(d.hamming(F.col("a"), F.col("b")) == 59).count() == 300


def test_items_that_trade_heavy_shingles(spark):
    """Fingerprints by multiplicity differ in half their bits here; similarity is 0.846."""
    rng = random.Random(2)
    other = lambda: [f"o{rng.randrange(10**6)}" for _ in range(40)]
    items = [(k, " ".join([f"a{k}"] * 46 + [f"b{k}"] * 54)) for k in range(6)]
    docs = [(k, " ".join([*other(), *[f"a{k}"] * 54, *[f"b{k}"] * 46, *other()])) for k in range(6)]
    got = d.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(k, k) for k in range(6)} and all(abs(r.similarity - 0.846) < 0.001 for r in got)


def test_recall_at_the_threshold(spark):
    """Items of words that hardly repeat, edited until their similarity is just above the threshold, all starts judged."""
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(400)]
    make = lambda n: [rng.choice(vocab) for _ in range(n)]
    items, docs = [], []
    for k in range(150):
        item = make(rng.randrange(20, 120))
        copy = list(item)
        while True:
            edited = list(copy)
            at = rng.randrange(len(edited))
            edited[at : at + rng.randrange(2)] = make(rng.randrange(1, 3))
            if not slid([(0, " ".join(edited))], [(0, " ".join(item))]):
                break
            copy = edited
        cut = rng.choice([0, 0, len(copy) // 2])  # some halves trade places
        docs.append((k, " ".join(make(rng.randrange(0, 60)) + copy[cut:] + copy[:cut] + make(rng.randrange(0, 60)))))
        items.append((k, " ".join(item)))
    got = {(r.doc_id, r.item_id): r.similarity for r in d.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {k: v for doc, item in zip(docs, items) for k, v in slid([doc], [item]).items()}
    assert len(want) > 90 and want.keys() <= got.keys() and all(abs(got[k] - v) < 1e-12 for k, v in want.items())


def test_a_shingle_of_all_items_is_no_candidate(spark):
    """Items share an instruction, and so do texts: only leaks come out, and the caller's columns stay."""
    rng = random.Random(3)
    make = lambda n: [f"v{rng.randrange(10**5)}" for _ in range(n)]
    told = make(12)
    items = [(k, " ".join(told + make(28))) for k in range(40)]
    docs = [(k, " ".join(make(20) + told + make(20)), "x", k) for k in range(80)] + [(100 + k, "before " + items[k][1], "y", k) for k in range(5)] + [(200, None, None, None), (201, "", "", 0)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, __doc string, __leaked int").withColumn("doc", d.row_key())
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in d.find_leaks(frame, bench).collect()} == {(100 + k, k) for k in range(5)}
    kept = d.decontaminate(frame, bench)
    assert kept.columns == frame.columns and sorted(kept.collect()) == sorted(frame.where("NOT coalesce(doc_id BETWEEN 100 AND 104, false)").collect())
    small = d.find_leaks(frame, bench, broadcast_bytes=0)
    assert {(r.doc_id, r.item_id) for r in small.collect()} == {(100 + k, k) for k in range(5)}


def test_an_item_of_seventy_thousand_words(spark):
    rng = random.Random(11)
    words = [f"v{rng.randrange(5000)}" for _ in range(70_000)]
    docs = [(1, " ".join(words)), (2, " ".join(words[:30_000])), (3, " ".join(words[:35_000] + ["edited"] + words[35_001:]))]
    bench = spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
    got = {r.doc_id: r.similarity for r in d.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got.keys() == {1, 3} and got[1] == 1 and 0.9998 < got[3] < 1
