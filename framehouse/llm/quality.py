"""Quality by ordinal regression: a cumulative-link model of graded ratings over hashed text features.

One weight vector is shared by all grades, and ordered thresholds cut its score: P(grade >= k) = sigmoid(score - t_k).
The expected grade is the sum of these tails, and the tail at a chosen grade selects documents.

The model is fitted on the driver on at most ``sample`` rated rows (those with the smallest hash of doc_id, of texts of
at most ``longest`` characters); every document is scored whole.

Defined results: null and empty texts have no features and get the score of the intercept alone. Null ratings are not
used; equal ratings of a document count once, different ones each, and of several texts of a rated doc_id the smallest is
fitted. Without any rating, or with one grade only, every document
gets the tail 1 of that grade (0 without ratings: grade 0). Repeated rows are scored alike; other columns are kept or
ignored as the function says.
"""

from __future__ import annotations

import operator
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

BUCKETS = 1 << 15
SAMPLE, LONGEST, STEPS = 6000, 20_000, 250
LETTERS = re.compile("[a-zß-öø-ÿ]+"), re.compile("[A-ZÀ-ÖØ-Þ]+"), re.compile("[0-9]+")
#: Shares of the whole text that stand in the buckets after the hashed ones.
SHARES = ("repeat", "distinct", "same_line", "line_breaks")
MOST = 1_000_000


def chunk_buckets(chunk: str) -> tuple[int, int]:
    """The bucket of the word and that of its shape, in which runs of like letters are one sign."""
    shape = chunk
    for sign, run in zip("aA0", LETTERS):
        shape = run.sub(sign, shape)
    return zlib.crc32(chunk.lower().encode("utf-8", "surrogatepass")) % BUCKETS, zlib.crc32(b"shape " + shape.encode("utf-8", "surrogatepass")) % BUCKETS


def shares(text: str, chunks: list[str]) -> list[float]:
    n, lines = max(1, len(chunks)), text.split("\n")
    return [
        sum(map(operator.eq, chunks, chunks[1:])) / n,
        len(set(chunks)) / n / 4,
        1 - len(set(lines)) / len(lines),
        min(1.0, (len(lines) - 1) / n),
    ]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted buckets and their values: the mean over the chunks, then the shares."""
    chunks = (text or "").split()
    if not chunks:
        return np.zeros(0, np.int64), np.zeros(0)
    counts = Counter(chunks)
    at = np.array([chunk_buckets(c) for c in counts], np.int64)
    n = np.array(list(counts.values()), float) / len(chunks)
    ids, inverse = np.unique(at.ravel(), return_inverse=True)
    values = np.bincount(inverse, np.repeat(n, 2))
    return np.append(ids, BUCKETS + np.arange(len(SHARES))), np.append(values, shares(text, chunks))


@dataclass(frozen=True)
class OrdinalModel:
    weights: np.ndarray  # BUCKETS + len(SHARES)
    thresholds: np.ndarray  # of grades 1.., ascending
    grades: int

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1.."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -500, 500)))


def cut_points(rest: np.ndarray) -> np.ndarray:
    """Ordered thresholds of a first one and the logarithms of the steps between them."""
    return np.cumsum(np.concatenate([rest[:1], np.exp(rest[1:])]))


def loss(theta: np.ndarray, ids: np.ndarray, values: np.ndarray, row: np.ndarray, grades: np.ndarray, weight: np.ndarray, k: int) -> tuple[float, np.ndarray]:
    """The weighted negative log-likelihood of the grades with a small penalty on the weights, and its gradient.

    theta holds the feature weights, then the k - 1 thresholds as cut_points() reads them.
    """
    d, n, at = len(theta) - k + 1, len(grades), np.arange(len(grades))
    score = np.bincount(row, values * theta[ids], n)
    tail = np.column_stack([np.ones(n), 1 / (1 + np.exp(-np.clip(score[:, None] - cut_points(theta[d:])[None, :], -500, 500))), np.zeros(n)])
    p = np.maximum(tail[at, grades] - tail[at, grades + 1], 1e-9)
    slope = tail * (1 - tail)  # of each tail by the score; 0 at both ends
    g_score = -(slope[at, grades] - slope[at, grades + 1]) / p * weight / n
    g_t = np.zeros((n, k + 1))
    np.add.at(g_t, (at, grades), slope[at, grades] / p * weight / n)
    np.add.at(g_t, (at, grades + 1), -slope[at, grades + 1] / p * weight / n)
    suffix = np.cumsum(g_t[:, 1:k].sum(0)[::-1])[::-1]
    gradient = np.concatenate([np.bincount(ids, values * g_score[row], d) + 1e-5 * theta[:d], suffix[:1], suffix[1:] * np.exp(theta[d + 1 :])])
    return float(-(np.log(p) * weight).sum() / n + 0.5e-5 * (theta[:d] ** 2).sum()), gradient


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, steps: int = STEPS) -> OrdinalModel:
    """Full-batch Adam on the likelihood of the grades, each grade weighing as much as every other; thresholds stay ordered."""
    grades = np.asarray(grades, np.int64)
    k = int(grades.max()) + 1 if len(grades) else 1
    if len(set(grades.tolist())) < 2:
        return OrdinalModel(np.zeros(BUCKETS + len(SHARES)), np.where(np.arange(1, k) <= (grades[0] if len(grades) else 0), -500.0, 500.0), k)
    ids, values = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    reached = np.array([(grades >= j).mean() for j in range(1, k)]).clip(1e-3, 1 - 1e-3)
    start = -np.log(reached / (1 - reached))
    d = BUCKETS + len(SHARES)
    theta = np.concatenate([np.zeros(d), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    weight = len(grades) / (len(set(grades.tolist())) * np.bincount(grades, minlength=k)[grades])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        _, grad = loss(theta, ids, values, row, grades, weight, k)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta -= 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return OrdinalModel(theta[:d], cut_points(theta[d:]), k)


class ChunkScores(dict):
    """The weight of each chunk, worked out when it is first met."""

    def __init__(self, model: OrdinalModel):
        super().__init__()
        self.w = model.weights

    def __missing__(self, chunk: str) -> float:
        a, b = chunk_buckets(chunk)
        self[chunk] = s = float(self.w[a] + self.w[b])
        return s

    def score(self, text: str | None) -> float:
        chunks = (text or "").split()
        if not chunks:
            return 0.0
        if len(self) > MOST:
            self.clear()
        return sum(map(self.__getitem__, chunks)) / len(chunks) + float(np.dot(self.w[BUCKETS:], shares(text, chunks)))


def rated(docs: DataFrame, labels: DataFrame, grade: str, sample: int, longest: int) -> DataFrame:
    """features and grade of the bounded sample; the texts stay on the executors."""
    chosen = labels.select(F.col("doc_id").alias("doc_id"), F.col(grade).cast("int").alias("grade")).where("doc_id IS NOT NULL AND grade >= 0").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(sample)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.length("text") <= longest)
    # At most sample rows: one text of a doc_id and grade, whatever stands in docs.
    joined = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "grade").agg(F.min("text").alias("text"))

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t) for t in batch.column(2).to_pylist()]
            cols = [batch.column(0), batch.column(1), pa.array([x.astype("<i4").tobytes() for x, _ in found], pa.binary()), pa.array([x.astype("<f4").tobytes() for _, x in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "grade", "ids", "vals"])

    return joined.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(featurise, "doc_id long, grade int, ids binary, vals binary")


def train(docs: DataFrame, labels: DataFrame, grade: str = "quality", sample: int = SAMPLE, longest: int = LONGEST) -> OrdinalModel:
    rows = sorted(rated(docs, labels, grade, sample, longest).collect(), key=lambda r: (r.doc_id, r.grade))
    return fit([(np.frombuffer(r.ids, "<i4").astype(np.int64), np.frombuffer(r.vals, "<f4").astype(float)) for r in rows], np.array([r.grade for r in rows], np.int64))


def score(docs: DataFrame, model: OrdinalModel, at_least: int = 1) -> DataFrame:
    """All columns of docs, then quality_expected and quality_tail, P(grade >= at_least). The model has a fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scores = ChunkScores(model)
        for batch in batches:
            s = np.array([scores.score(t) for t in batch.column(batch.schema.get_field_index("__text")).to_pylist()])
            tails = model.tails(s).reshape(len(s), -1)
            tail = np.ones(len(s)) if at_least <= 0 else tails[:, at_least - 1] if at_least <= tails.shape[1] else np.zeros(len(s))
            own = [c for c, n in zip(batch.columns, batch.schema.names) if n != "__text"]
            yield pa.RecordBatch.from_arrays([*own, pa.array(tails.sum(1)), pa.array(tail)], [*(n for n in batch.schema.names if n != "__text"), "quality_expected", "quality_tail"])

    out = StructType([*docs.schema.fields, StructField("quality_expected", DoubleType()), StructField("quality_tail", DoubleType())])
    return docs.withColumn("__text", F.col("text").cast("string")).mapInArrow(run, out)


def classify(docs: DataFrame, labels: DataFrame, grade: str = "quality", at_least: int = 1, sample: int = SAMPLE) -> DataFrame:
    """doc_id, expected_grade, tail_probability, selected of every document."""
    model = train(docs, labels, grade, sample)
    scored = score(docs.select("doc_id", "text"), model, at_least)
    return scored.select("doc_id", F.col("quality_expected").alias("expected_grade"), F.col("quality_tail").alias("tail_probability"), (F.col("quality_tail") >= 0.5).alias("selected"))


def select(docs: DataFrame, model: OrdinalModel, at_least: int = 1, tail: float = 0.5) -> DataFrame:
    """The rows of docs, whole, whose probability of a grade of at_least is tail or more; its columns may have any names."""
    held = docs.select(F.col("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    return score(held, model, at_least).where(F.col("quality_tail") >= tail).select("__row.*")
