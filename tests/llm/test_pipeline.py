import zlib

import corpus_pipeline
import numpy as np
from test_decontaminate import brute as leaks
from test_near_copies import brute as near

from framehouse.llm import quality
from framehouse.llm.tokens import default_tokenizer

DIR = "/root/testdata/sf0.001"


def kept_text(texts, width=200):
    data, seen = [t.encode() for t in texts], {}
    for d in data:
        for i in range(len(d) - width + 1):
            w = d[i : i + width]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - width + 1):
            if seen[d[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        out.append(bytes(b for b, g in zip(d, gone) if not g).decode("utf-8", "ignore"))
    return out


def test_stages_against_brute_force(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    model = quality.train(docs, spark.read.parquet(f"{DIR}/labels.parquet"))
    scores = quality.ChunkScores(model)
    good = [(i, t) for i, t in rows.items() if model.tails(np.array([scores.score(t)]))[0, 0] >= 0.5]
    classes = near(good)
    one = [(i, t) for i, t in good if classes[i][0] == i]
    cut = [(i, t) for (i, was), t in zip(one, kept_text([t for _, t in one])) if t or not was]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    leaked = {d for d, _ in leaks(cut, items)}
    clean = [(i, t) for i, t in cut if i not in leaked]
    tokenizer = Tokenizer.from_file(default_tokenizer())
    want = set()
    for i, t in clean:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            piece = ids[k : k + 2048]
            want.add((i, k // 2048, k, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes())))
    out = corpus_pipeline.run(spark, DIR).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out} == want and len(out) == len(want)
    assert 0 < len(clean) < len(rows)


def test_all_stages_but_the_last_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(30)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DIR)
        assert [f[:2] for f in out.dtypes] == [f[:2] for f in docs.dtypes]
