"""Quality rules with compression bands: zstandard ratios over whole documents and fixed chunks, with limits by length.

A ratio is compressed bytes over bytes of the UTF-8 text. Short texts compress less, so the band that a ratio must keep
depends on the number of bytes it was taken of (BANDS): below it the text repeats itself, above it there is nothing that
language would have in common (keys, encoded data). A document goes if its own ratio is outside the band of its length,
or if chunks outside theirs hold more than CHUNK_SHARE of its bytes, so that a bad stretch cannot hide in a long text.
Chunks are CHUNK bytes at fixed places, the last one as long as what is left.

Before that, base rules: words are runs of characters other than space and the controls from tab to carriage return; a
document of fewer than 20 words, or with more than 30 in 100 words inside runs of eight that occur again, fails.

Defined results: a null text counts as empty; an empty text has no words, fails the base rules and has a null ratio.
Repeated rows are each judged; a null doc_id is reported as null. An empty table gives no rows. Only doc_id and text are
read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
RUN, LEAST_WORDS, REPEATED_PERCENT = 8, 20, 30
LEVEL, CHUNK, CHUNK_SHARE = 3, 4096, 0.25
#: From so many bytes: the least and the largest ratio that pass.
BANDS = [(0, 0.0, 9.9), (64, 0.42, 1.25), (256, 0.38, 1.0), (1024, 0.30, 0.80), (4096, 0.25, 0.72), (16384, 0.20, 0.70)]
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, n_chunks int, n_bad_chunks int"


@dataclass(frozen=True)
class Limits:
    bands: tuple = tuple(BANDS)
    chunk: int = CHUNK
    chunk_share: float = CHUNK_SHARE

    def passes(self, ratio: float, n_bytes: int) -> bool:
        _, low, high = max(b for b in self.bands if b[0] <= n_bytes)
        return low <= ratio <= high


def repeated_words(words: list[str]) -> int:
    """How many words stand in a run of RUN words that occurs twice or more."""
    n = len(words) - RUN + 1
    if n < 2:
        return 0
    known: dict[str, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    if len(known) == len(words):
        return 0
    # Numbers of runs of 2, 4 and 8 words: two runs have one number only if they are equal.
    step = 1
    while step < RUN:
        pairs = ids[:-step] * (int(ids.max()) + 1) + ids[step:]
        ids = np.unique(pairs, return_inverse=True)[1]
        step *= 2
    again = np.bincount(ids)[ids] > 1
    change = np.zeros(len(words) + 1, np.int64)
    change[:n] += again
    change[RUN:] -= again
    return int((np.cumsum(change[:-1]) > 0).sum())


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return len(lines) - len(set(lines))


class Judge:
    def __init__(self, limits: Limits):
        self.limits, self.zstd = limits, zstandard.ZstdCompressor(level=LEVEL)

    def ratio(self, data: bytes) -> float:
        return len(self.zstd.compress(data)) / len(data)

    def bands(self, data: bytes) -> tuple[float | None, int, int, bool]:
        """The ratio of the whole, the number of chunks and of bad ones, and whether all of it passes."""
        if not data:
            return None, 0, 0, True
        whole, limits = self.ratio(data), self.limits
        if len(data) <= limits.chunk:
            good = limits.passes(whole, len(data))
            return whole, 1, int(not good), good
        chunks = [data[a : a + limits.chunk] for a in range(0, len(data), limits.chunk)]
        bad = [c for c in chunks if not limits.passes(self.ratio(c), len(c))]
        good = limits.passes(whole, len(data)) and sum(map(len, bad)) <= limits.chunk_share * len(data)
        return whole, len(chunks), len(bad), good

    def row(self, text: str | None) -> tuple:
        text = text or ""
        words = WORD.findall(text)
        n, repeats = len(words), repeated_words(words)
        failed = n < LEAST_WORDS or 100 * repeats > REPEATED_PERCENT * n
        ratio, chunks, bad, good = self.bands(text.encode("utf-8", "surrogatepass"))
        return n, sum(map(len, words)), sum(map(text.count, SYMBOLS)), repeated_lines(text), repeats, failed, not failed and good, ratio, chunks, bad


def judge(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id, the base counts and verdicts, the ratio and the chunks of every document."""
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64(), pa.int32(), pa.int32()]
    names = [part.split()[0] for part in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judged = Judge(limits)
        for batch in batches:
            rows = [judged.row(t.as_py()) for t in batch.column(1)]
            columns = list(zip(*rows)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows of docs, whole, that pass; the caller's columns may have any names."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    paired = docs.select(F.col("text").cast("string").alias("text"), row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judged = Judge(limits)
        for batch in batches:
            good = pa.array([judged.row(t.as_py())[6] for t in batch.column(0)], pa.bool_())
            yield batch.select([1]).filter(good)

    return paired.mapInArrow(run, paired.select("row").schema).select("row.*")
