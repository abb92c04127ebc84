"""Vector code compression: parts of vectors coded by codebooks, nearest entries found by partial distances.

Entries become whole numbers floor(1024 c), so that distances are exact. Of a codebook the dimensions go by falling
variance; a block of vectors keeps the (vector, entry) pairs whose distance so far does not strictly exceed the best
complete distance known of the vector, and the masks narrow with every dimension. The entry that leads on the first
dimensions is completed first, and the leader again halfway, so that the bound is low when most pairs are still there.

Codebooks begin as the parts of the vectors of the smallest ids; each round assigns all vectors and adds up, in tasks,
sums and counts by entry. Only such sums, of the size of the codebooks, reach the driver.

Defined results: vectors that are null, empty, or hold null or non-finite entries are left out, as are those with an entry
of 65536 or more in magnitude and those of another than the most frequent length (of equally frequent ones the longest is
taken). A length that the parts don't divide is filled up with zeros. Null vec_ids come last among the smallest; of equal
ones the smaller vector comes first. With fewer vectors than entries, there are as many entries as vectors. Repeated rows
each count. An empty table gives no rows. Columns other than vec_id, embedding and label are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framehouse.llm.vectors import commonest_size, tree_sum, usable, whole
from framehouse.plans.lineage import written

PARTS, ENTRIES, ROUNDS, LARGEST = 4, 256, 4, 65536.0
AT_ONCE = 2048


def nearest_entries(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of x: the index of its nearest row of the book (the lowest of equals), and their squared distance."""
    d = x.shape[1]
    order = np.argsort(-book.var(0), kind="stable")
    reach = int(max(np.abs(x).max(initial=0), np.abs(book).max()))
    kind = np.int32 if d * (2 * reach) ** 2 < 2**31 else np.int64
    x, book = np.ascontiguousarray(x[:, order], kind), np.ascontiguousarray(book[:, order], kind)
    at, best = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for lo in range(0, len(x), AT_ONCE):
        at[lo : lo + AT_ONCE], best[lo : lo + AT_ONCE] = _nearest(x[lo : lo + AT_ONCE], book)
    return at, best


def _nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n, d = x.shape
    head, half = max(1, d // 4), max(1, d // 2)
    partial = np.zeros((n, len(book)), x.dtype)
    for c in range(head):
        partial += (x[:, c, None] - book[None, :, c]) ** 2
    at = partial.argmin(1)
    best = ((x - book[at]) ** 2).sum(1, dtype=x.dtype)
    row, entry = np.nonzero(partial <= best[:, None])
    so_far = partial[row, entry]
    for c in range(head, d):
        so_far = so_far + (x[row, c] - book[entry, c]) ** 2
        if c == half:
            first = np.flatnonzero(np.diff(row, prepend=-1))
            order = np.lexsort((so_far, row))[first]  # the leader of each row
            who, leads = row[order], entry[order]
            best[who] = np.minimum(best[who], ((x[who] - book[leads]) ** 2).sum(1, dtype=x.dtype))
        stay = so_far <= best[row]
        row, entry, so_far = row[stay], entry[stay], so_far[stay]
    order = np.lexsort((entry, so_far, row))
    first = order[np.flatnonzero(np.diff(row[order], prepend=-1))]
    return entry[first], so_far[first]


def split(x: np.ndarray) -> np.ndarray:
    """rows x PARTS x width."""
    missing = -x.shape[1] % PARTS
    return np.pad(x, ((0, 0), (0, missing))).reshape(len(x), PARTS, -1)


def kept(vectors: DataFrame) -> tuple[DataFrame, int | None]:
    """vec_id, label and x (whole entries, 4 bytes each), written; and their dimension (None without rows)."""
    good = vectors.where(usable(vectors, "embedding", LARGEST)).select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    d = commonest_size(good, "embedding")
    if d is None:
        return good, None
    whole_entries = F.transform("embedding", lambda c: F.floor(F.lit(1024.0) * c).cast("int"))
    return written(good.where(F.size("embedding") == d).select("vec_id", "label", whole_entries.alias("x")), "code-vectors"), d


def rows_of(column: pa.Array, d: int) -> np.ndarray:
    return split(column.flatten().to_numpy().astype(np.int64).reshape(len(column), d))


def first_books(rows: DataFrame, d: int) -> np.ndarray:
    """PARTS x entries x width: the parts of the vectors of the smallest ids."""
    chosen = rows.orderBy(F.asc_nulls_last("vec_id"), "x").limit(ENTRIES).select("x").collect()
    return split(np.array([r.x for r in chosen], np.int64).reshape(len(chosen), d)).transpose(1, 0, 2).copy()


def next_books(rows: DataFrame, books: np.ndarray, d: int) -> np.ndarray:
    """Each entry replaced by the floored mean of the parts nearest to it; unused ones stay."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    parts, k, width = books.shape

    def add(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        books, total, some = shared.value, np.zeros((parts, k, width + 1), np.int64), False
        for batch in batches:
            if batch.num_rows:
                some, x = True, rows_of(batch.column(0), d)
                for p in range(parts):
                    at, _ = nearest_entries(x[:, p], books[p])
                    np.add.at(total[p], at, np.column_stack([x[:, p], np.ones(len(x), np.int64)]))
        return total if some else None

    total = tree_sum(rows.select("x"), add, "<i8").reshape(parts, k, width + 1)
    used = total[:, :, width:]
    return np.where(used > 0, total[:, :, :width] // np.maximum(used, 1), books)


def train(rows: DataFrame, d: int, rounds: int = ROUNDS) -> np.ndarray:
    books = first_books(rows, d)
    for _ in range(rounds):
        books = next_books(rows, books, d)
    return books


def encode(rows: DataFrame, books: np.ndarray, d: int) -> DataFrame:
    """vec_id, label, code, error of every row."""
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for batch in batches:
            x = rows_of(batch.column(2), d)
            found = [nearest_entries(x[:, p], books[p]) for p in range(len(books))]
            codes = np.column_stack([at for at, _ in found]).astype(np.uint8)
            error = sum(best for _, best in found)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in codes]), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    label = rows.schema["label"].dataType.simpleString()
    return rows.select("vec_id", "label", "x").mapInArrow(run, f"vec_id long, label {label}, code string, error long")


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every kept row."""
    rows, d = kept(vectors)
    if d is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    books = train(rows, d, rounds)
    coded = written(encode(rows, books, d), "codes")
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
