import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from framehouse.llm import packing, tokens

ODD = [None, "", " ", "Hello, World's end!! 123 don't", "á ÀÉÎ straße İx Σας", "x\x0by\x1cz\xa0q r", "<|endoftext|> <|x 'LL", "日本語テキスト 🙂🙂", "''s''t", "tab\tsep\r\nline", "a" * 5000, "µ²ªº ½ _a_b"]


def test_ids_equal_the_tokenizers_own(spark):
    path = tokens.default_tokenizer()
    texts = ODD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    plain = Tokenizer.from_file(path)
    for text, got in zip(texts, tokens.WordEncoder(path).encode(texts)):
        assert np.frombuffer(got, "<u4").tolist() == plain.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("texts", [[], ODD + ["word " * 9000, "same text", "same text"]])
def test_pieces_and_places(spark, texts):
    docs = spark.createDataFrame([(i if i != 3 else None, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, bin string, pool int")
    rows = packing.pack(docs).collect()
    plain = Tokenizer.from_file(tokens.default_tokenizer())
    want = []
    for i, t in enumerate(texts):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want.append((i if i != 3 else None, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted(map(str, want)) == sorted(str(tuple(r[:5])) for r in rows)
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in places.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 2048
    if rows:
        assert len(places) <= -(-sum(r.length for r in rows) // 2048) + 1


def test_crossover_keeps_every_item_within_capacity():
    rng = np.random.default_rng(7)
    sizes = rng.integers(1, 1200, 300)
    parents = []
    for _ in range(2):
        bins = np.zeros(300, np.int64)
        packing.best_fit(sizes, rng.permutation(300), bins, {}, 2048)
        parents.append(packing.numbered(bins))
    child = packing.crossover(sizes, *parents, rng, 2048)
    assert len(child) == 300 and packing.fills(sizes, child).max() <= 2048
    (best, *_), crossed = packing.evolved(sizes, parents, rng, 2048)
    assert crossed and packing.fills(sizes, best).max() <= 2048 and best.max() <= min(p.max() for p in parents)


def falling(sizes, capacity=2048):
    bins = np.zeros(len(sizes), np.int64)
    packing.best_fit(sizes, np.argsort(-sizes, kind="stable"), bins, {}, capacity)
    return packing.numbered(bins).max() + 1


def test_evolution_beats_best_fit_where_that_is_not_the_least():
    rng = np.random.default_rng(0)
    a = rng.integers(780, 1000, 60)
    b = np.array([rng.integers(512, (2048 - x) // 2 + 1) for x in a])
    for sizes in (np.concatenate([a, b, 2048 - a - b]), rng.integers(300, 1000, 600)):
        one, n1 = packing.evolved(sizes, [], np.random.default_rng(1), 2048, True)
        two, n2 = packing.evolved(sizes, [], np.random.default_rng(2), 2048, False)
        met, n3 = packing.evolved(sizes, [two[0], *one], np.random.default_rng(3), 2048)
        assert n1 and n2 and n3 and not np.array_equal(one[0], two[0])  # what migrates is not the island's own
        assert packing.fills(sizes, met[0]).max() <= 2048 and met[0].max() + 1 < falling(sizes)


def test_crossover_runs_on_documents_and_never_needs_more_than_best_fit(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sizes = np.array([r.length for r in packing.token_pieces(docs).where("length < 2048").select("length").collect()])
    population, crossed = packing.evolved(sizes, [], np.random.default_rng(1), 2048)
    assert crossed >= 2 * packing.LEAST_GENERATIONS and population[0].max() + 1 <= falling(sizes)
    assert packing.evolved(np.array([5]), [], np.random.default_rng(1), 2048)[0][0].tolist() == [0]
