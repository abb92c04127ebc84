"""Toxicity by subword bags: words are averages of character n-gram vectors, texts averages of their distinct words, under a linear softmax.

Vectors and softmax are trained jointly in numpy, on the averages of whole texts. A misspelled word that was never seen
shares most n-grams, so most of its vector, with words that were. A run of more than LONG letters and digits is read as
several words of LONG, which overlap so that no n-gram is lost.

The model is fitted on at most ``each`` rows of either label (those with the smallest hash of doc_id,
of texts of at most ``longest`` characters, never rows held out); every document is scored whole. These rows are cut in
PARTS; a model is fitted on all but each of them, and the mean of their logits is one wider model of the same kind. Each
part is judged by the model that hasn't seen it, and the bias moved to where these logits part the labels best (by F1, with
the labels as frequent as they are among all labelled rows): balanced training alone would call too much toxic.

Defined results: a null or empty text has the score of the bias alone. Null labels are not used, and of several texts of a
labelled doc_id the smallest is fitted. Without rows of both
labels the score is the known label (0 without any). Repeated rows are scored alike.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS, WIDTH, GRAMS = 1 << 16, 8, (3, 4, 5)
EACH, LONGEST, EPOCHS, STEPS, BATCH, RATE, SEED = 2500, 20_000, 12, 200, 64, 0.5, 11
FOLDS, PARTS = 5, 4
WORD = re.compile(r"[^\W_]+")
LONG = 60
MOST = 1_000_000
TOGETHER = 1 << 20  # characters of the texts that are scored together


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters and digits; those above LONG in overlapping pieces, which no n-gram falls between."""
    return pieces(text.lower())


def pieces(lowered: str) -> list[str]:
    words = WORD.findall(lowered)
    if max(map(len, words), default=0) <= LONG:
        return words
    step = LONG - max(GRAMS) + 1
    return [w[at : at + LONG] for w in words for at in range(0, max(1, len(w) - max(GRAMS) + 1), step)]


def distinct_words(text: str) -> set[str]:
    """The set of words_of(text). No word holds white space, so equal stretches between it are looked at once."""
    found: set[str] = set()
    for c in set(text.lower().split()):
        if len(c) <= LONG and c.isalnum():
            found.add(c)
        else:
            found.update(pieces(c))
    return found


def subwords(word: str) -> list[int]:
    """Buckets of the word within < and >, and of its n-grams."""
    marked = f"<{word}>"
    parts = {marked, *(marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1))}
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) % BUCKETS for p in sorted(parts)]


def crc_table() -> np.ndarray:
    """What crc32 adds for each byte."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, c >> 1 ^ np.uint32(0xEDB88320), c >> 1)
    return c


CRC = crc_table()


def bags(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that subwords() gives for every word, one word after another, and how many each has.

    The n-grams at all places of all words are hashed together, character by character of the n-gram and byte by byte of
    the character. In a word, n-grams of one length with one crc32 count as one.
    """
    marked = [f"<{w}>" for w in words]
    sizes = np.array([len(m) for m in marked], np.int64)
    data = np.frombuffer("".join(marked).encode("utf-8", "surrogatepass"), np.uint8)
    starts = np.flatnonzero((data & 0xC0) != 0x80)  # where characters begin
    n_chars = len(starts)
    widths = np.append(np.diff(starts, append=len(data)), np.zeros(max(GRAMS), np.int64))
    starts, data = np.append(starts, np.full(max(GRAMS), len(data))), np.append(data, np.zeros(4, np.uint8))
    own = np.repeat(np.arange(len(words), dtype=np.uint64), sizes) << 32
    room = np.repeat(np.cumsum(sizes), sizes) - np.arange(n_chars)
    state = np.full(n_chars, 0xFFFFFFFF, np.uint32)
    owners, buckets = [], []
    for n in range(1, max(GRAMS) + 1):
        at, width = starts[n - 1 : n - 1 + n_chars], widths[n - 1 : n - 1 + n_chars]
        state = CRC[(state ^ data[at]) & 0xFF] ^ (state >> 8)
        for k in range(1, int(width.max(initial=1))):
            more = np.flatnonzero(width > k)
            state[more] = CRC[(state[more] ^ data[at[more] + k]) & 0xFF] ^ (state[more] >> 8)
        if n in GRAMS:
            keys = np.sort(own[room >= n] | ~state[room >= n])
            keys = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
            owners.append((keys >> 32).astype(np.int64))
            buckets.append((keys % BUCKETS).astype(np.int64))
    whole = np.flatnonzero(sizes > max(GRAMS))  # shorter ones are n-grams themselves
    owners.append(whole)
    buckets.append(np.array([zlib.crc32(marked[i].encode("utf-8", "surrogatepass")) % BUCKETS for i in whole.tolist()], np.int64))
    owner = np.concatenate(owners)
    return np.concatenate(buckets)[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))


@dataclass(frozen=True)
class SubwordModel:
    vectors: np.ndarray  # BUCKETS x width
    output: np.ndarray  # width x 2
    bias: np.ndarray  # 2

    def bucket_logits(self) -> list[float]:
        """What a subword adds to the difference of the two logits, before averaging."""
        return (self.vectors @ (self.output[:, 1] - self.output[:, 0])).tolist()

    def flat(self) -> SubwordModel:
        """A model of one dimension with the same difference of logits: all that scoring needs."""
        return SubwordModel(np.array(self.bucket_logits())[:, None], np.array([[0.0, 1.0]]), self.bias)


def mean_of(models: list[SubwordModel], shift: float) -> SubwordModel:
    """One model whose logits are the means of theirs, less shift for the second label."""
    bias = np.mean([m.bias for m in models], 0) - np.array([0.0, shift])
    return SubwordModel(np.hstack([m.vectors for m in models]), np.vstack([m.output for m in models]) / len(models), bias)


def fit(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> SubwordModel:
    rng = np.random.default_rng(seed)
    vectors, output, bias = rng.uniform(-0.5, 0.5, (BUCKETS, WIDTH)) / WIDTH, rng.normal(0, 0.5, (WIDTH, 2)), np.zeros(2)
    labels = np.asarray(labels, np.int64)
    if len(set(labels.tolist())) < 2:
        return SubwordModel(vectors * 0, output, np.array([0.0, 500.0 if len(labels) and labels[0] else -500.0]))
    docs = [dict.fromkeys(words_of(t)) for t in texts]
    vocab: dict[str, int] = {}
    coded = [np.array([vocab.setdefault(w, len(vocab)) for w in d], np.int64) for d in docs]
    flat, sizes = bags(list(vocab))
    starts, across = np.concatenate([[0], np.cumsum(sizes)]), np.ascontiguousarray(vectors.T)  # a row a dimension stays in the cache
    g_vec, g_out, g_bias = np.full(BUCKETS, 1e-6), np.full((WIDTH, 2), 1e-6), np.full(2, 1e-6)

    def bag(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Subwords of the words and the word that each belongs to."""
        n = sizes[words]
        at = np.repeat(starts[words] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return flat[at], np.repeat(np.arange(len(words)), n)

    for _ in range(max(epochs, -(-STEPS * BATCH // max(1, len(docs))))):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), BATCH):
            chosen = [i for i in order[at : at + BATCH] if len(coded[i])]
            if not chosen:
                continue
            used, word_at = np.unique(np.concatenate([coded[i] for i in chosen]), return_inverse=True)
            counts = np.array([len(coded[i]) for i in chosen])
            doc = np.repeat(np.arange(len(chosen)), counts)
            subs, owner = bag(used)
            word_vec = np.column_stack([np.bincount(owner, v[subs], len(used)) for v in across]) / sizes[used][:, None]
            text_vec = np.column_stack([np.bincount(doc, word_vec[word_at, c], len(chosen)) for c in range(WIDTH)]) / counts[:, None]
            z = text_vec @ output + bias
            z -= z.max(1, keepdims=True)
            prob = np.exp(z) / np.exp(z).sum(1, keepdims=True)
            err = prob
            err[np.arange(len(chosen)), labels[chosen]] -= 1
            d_out, d_bias, d_text = text_vec.T @ err, err.sum(0), err @ output.T
            d_word = np.column_stack([np.bincount(word_at, (d_text[:, c] / counts)[doc], len(used)) for c in range(WIDTH)]) / sizes[used][:, None]
            touched = np.flatnonzero(np.bincount(subs, minlength=BUCKETS))
            d_vec = np.array([np.bincount(subs, d[owner], BUCKETS)[touched] for d in np.ascontiguousarray(d_word.T)])
            g_vec[touched] += (d_vec**2).mean(0)
            g_out += d_out**2
            g_bias += d_bias**2
            across[:, touched] -= RATE * d_vec / np.sqrt(g_vec[touched])
            output -= 0.1 * d_out / np.sqrt(g_out)
            bias -= 0.1 * d_bias / np.sqrt(g_bias)
    return SubwordModel(np.ascontiguousarray(across.T), output, bias)


class WordLogits(dict):
    def __init__(self, model: SubwordModel):
        super().__init__()
        self.buckets, self.bias = np.array(model.bucket_logits()), float(model.bias[1] - model.bias[0])

    def logits(self, texts: list[str | None]) -> list[float]:
        """Logits of the texts, whose unknown words are looked up together."""
        bags_of = [distinct_words(t) if t else set() for t in texts]
        if len(self) > MOST:
            self.clear()
        if new := [w for w in set().union(*bags_of) if w not in self]:
            buckets, sizes = bags(new)
            sums = np.bincount(np.repeat(np.arange(len(new)), sizes), self.buckets[buckets], len(new))
            self.update(zip(new, (sums / sizes).tolist()))
        return [self.bias + (math.fsum(map(self.__getitem__, words)) / len(words) if words else 0.0) for words in bags_of]

    def scores(self, texts: list[str | None]) -> list[float]:
        """Scores of texts of any number and length, as many together as have TOGETHER characters, one at least."""
        found, at = [], 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and size < TOGETHER:
                size += len(texts[end] or "")
                end += 1
            found += self.logits(texts[at:end])
            at = end
        return (1 / (1 + np.exp(-np.clip(np.array(found, np.float64), -500, 500)))).tolist()


def best_shift(logits: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> float:
    """What to take off logits so that 0 parts them with the largest F1; between the two logits on either side."""
    order = np.argsort(-logits, kind="stable")
    z, y, w = logits[order], labels[order], weights[order]
    hits, called = np.cumsum(w * y), np.cumsum(w)
    f1 = 2 * hits / (called + (w * y).sum())
    f1[:-1][z[1:] == z[:-1]] = 0  # equal logits are called alike
    k = int(f1.argmax())
    return float((z[k] + z[k + 1]) / 2 if k + 1 < len(z) else z[k])


def parts_of(texts: list[str]) -> np.ndarray:
    return np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) % PARTS for t in texts])


def without_part(texts: list[str], labels: np.ndarray, k: int, epochs: int = EPOCHS) -> tuple[SubwordModel, np.ndarray]:
    """A model of all but part k, and its logits of that part."""
    part = parts_of(texts)
    model = fit([t for t, p in zip(texts, part) if p != k], labels[part != k], epochs)
    scored = WordLogits(model)
    return model, np.array(scored.logits([texts[i] for i in np.flatnonzero(part == k).tolist()]))


def fit_with_threshold(texts: list[str], labels: np.ndarray, weights: np.ndarray, spark: SparkSession) -> SubwordModel:
    """The mean of models that leave one part out each, its bias moved to the threshold that they give for what they haven't
    seen. Each is fitted by a task of its own, on the rows (their number is bounded) that all of them get."""
    part = parts_of(texts)
    if any(len(set(labels[part != k].tolist())) < 2 for k in range(PARTS)):
        return fit(texts, labels)
    shared = spark.sparkContext.broadcast((texts, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                model, logits = without_part(*shared.value, k)
                arrays = [x.tobytes() for x in (model.vectors, model.output, model.bias, logits)]
                yield pa.RecordBatch.from_arrays([pa.array([k]), *(pa.array([x], pa.binary()) for x in arrays)], ["k", "vectors", "output", "bias", "logits"])

    rows = spark.range(0, PARTS, 1, PARTS).mapInArrow(run, "k long, vectors binary, output binary, bias binary, logits binary").collect()
    models, logits = [], np.zeros(len(texts))
    for r in sorted(rows, key=lambda r: r.k):
        models.append(SubwordModel(np.frombuffer(r.vectors).reshape(BUCKETS, WIDTH), np.frombuffer(r.output).reshape(WIDTH, 2), np.frombuffer(r.bias)))
        logits[part == r.k] = np.frombuffer(r.logits)
    return mean_of(models, best_shift(logits, labels, weights))


def held_out(doc_id) -> object:
    return F.crc32(doc_id.cast("string")) % FOLDS == 0


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", each: int = EACH, longest: int = LONGEST) -> SubwordModel:
    known = labels.select(F.col("doc_id").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id IS NOT NULL").where(~held_out(F.col("doc_id"))).distinct()
    one = lambda y: known.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(each)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.length("text") <= longest)
    # At most 2 x each rows of at most longest characters: one text of a doc_id and label, whatever stands in docs.
    rows = texts.join(F.broadcast(one(0).unionByName(one(1))), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).where("text IS NOT NULL").collect()
    rows.sort(key=lambda r: (r.doc_id, r.label, r.text))
    y = np.array([r.label for r in rows], np.int64)
    often = {r.label: r["count"] for r in known.groupBy("label").count().collect() if r.label in (0, 1)}
    weight = {k: often[k] / max(1, int((y == k).sum())) for k in often}
    return fit_with_threshold([r.text for r in rows], y, np.array([weight.get(k, 1.0) for k in y.tolist()]), docs.sparkSession)


def score(docs: DataFrame, model: SubwordModel) -> DataFrame:
    """doc_id and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model.flat())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logits = WordLogits(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(logits.scores(batch.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, each: int = EACH) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = score(docs, train(docs, labels, each=each))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
