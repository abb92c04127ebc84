import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from framehouse.llm import token_shards as ts
from framehouse.llm.tokens import default_tokenizer


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000, 4097])
def test_feistel_is_a_keyed_permutation(n):
    a, b = ts.feistel(np.arange(n), n, 1), ts.feistel(np.arange(n), n, 2)
    assert sorted(a) == list(range(n))
    assert n < 17 or (a != b).any() and (a != np.arange(n)).any()


@pytest.mark.parametrize("texts", [[], ["one two three " * 40, None, "", "again", "again", "x " * 500]])
def test_round_trip(spark, tmp_path, texts):
    docs = spark.createDataFrame([(i if i else None, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, slot int").repartition(2)
    rows = ts.materialise(docs, f"file://{tmp_path}", length=16, shard_bytes=34 * 7).collect()
    plain, whole = Tokenizer.from_file(default_tokenizer()), []
    for i, t in enumerate(texts):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        whole.append((i or None, ids))
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.start, r.n_tokens, r.ids_crc32))
    assert got.keys() == {i for i, _ in whole}
    for i, ids in whole:
        parts, at = sorted(got[i]), 0
        for start, n, crc in parts:
            assert start == at and n > 0 and crc == zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())
            at += n
        assert at == len(ids)
    total = len({r.slot for r in rows})
    assert {r.slot for r in rows} == set(range(total))
    # Two partitions, so at most two sequences are not full.
    tokens = sum(len(ids) for _, ids in whole)
    assert tokens / 16 <= total <= tokens // 16 + 2
    assert all(r.byte_offset // 34 == r.slot % 7 and r.shard == r.slot // 7 for r in rows)
    if rows:
        left = list(ts.resume(f"file://{tmp_path}", 10, 7, total, 16))
        assert len(left) == total - 10 and sum(len(x) for x in left) == sum(r.n_tokens for r in rows if r.slot >= 10)
        for r in rows:
            if r.slot >= 10:
                at = (r.byte_offset % 34 - 2) // 2
                assert zlib.crc32(left[r.slot - 10][at : at + r.n_tokens].astype("<u4").tobytes()) == r.ids_crc32
