"""N-gram Jaccard join with Bayesian candidate pruning: MinHash values compared step by step, the rest verified exactly.

A text is the set of its runs of five words (words are runs of letters and digits, lower-cased; a text of one to four
words is one run). Texts of equal sets are one class of copies, of which one representative goes on. Candidates share
one of ``BANDS`` bands of ``ROWS`` MinHash values; a pair at the threshold shares none with a probability of 1.3e-7. A
pair is looked at only in the first band that it shares: its MinHash values are compared ``AT_ONCE`` at a time, and it is
dropped when, from a uniform prior, the posterior probability that its similarity reaches the threshold is below
``TOLERANCE``; values of 16 bits agree by chance once in 65,536, at any length of the texts, and the posterior counts that
in. What is left is verified on the sets of 64-bit hashes, without estimates.

Pairs never become rows. A band's members are cut into blocks, and each pair of blocks meets in a task, so a member is sent
as often as there are blocks: up to ``BLOCKS`` however many members there are, until their sets fill ``BLOCK_BYTES`` a block
(or their signatures do). A member's row carries its partners there, as bits where they are many. Verification gives each
member the number of its links and the root of its part of the graph, and components come of these by rounds of large and
small stars. All pairs of a clique are compared: that work, and a bit for each pair, is quadratic in the clique.

Defined results: null and empty texts and those without letters or digits have no words: no links, each row a class of
its own. Repeated rows are copies: they link with each other. A row with a null doc_id is judged alike; a class has the
smallest doc_id that isn't null. An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framehouse.llm.decontaminate import words_of
from framehouse.operators import graph
from framehouse.plans.lineage import written

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS, AT_ONCE, TOLERANCE = 40, 5, 20, 1e-9
BLOCK, BLOCKS, BLOCK_BYTES = 256, 8, 32 << 20
LEFT, RIGHT = 256, 4096
HASHES = BANDS * ROWS
RNG = np.random.default_rng(4)
FACTORS = RNG.integers(1, 1 << 64, (2, HASHES), np.uint64) | np.uint64(1)
PLACES = RNG.integers(1, 1 << 64, WORDS + 1, np.uint64) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_set(words: np.ndarray) -> np.ndarray:
    """Sorted hashes of the runs of five word hashes; of all words, if there are one to four."""
    n = len(words) - WORDS + 1
    if n < 1:
        return mixed((words * PLACES[: len(words)]).sum(keepdims=True) + np.uint64(len(words))) if len(words) else words
    return np.unique(mixed(sum(words[k : k + n] * PLACES[k] for k in range(WORDS))))


def signature(shingles: np.ndarray) -> np.ndarray:
    """16 bits of the least value of each hash function, hashed again: the least of many values has nothing but zeros above."""
    least = np.full(HASHES, np.iinfo(np.uint64).max)
    for a in range(0, len(shingles), 256):
        least = np.minimum(least, (shingles[a : a + 256, None] * FACTORS[0] + FACTORS[1]).min(0))
    return (mixed(least) >> np.uint64(48)).astype(np.uint16)


def least_matches(similarity: float, tolerance: float = TOLERANCE) -> list[int]:
    """Of the first AT_ONCE, 2 AT_ONCE, ... values, how many must agree for a pair to stay.

    After m of h agree, a uniform prior gives Beta(m + 1, h - m + 1); its mass above s is P(Binomial(h + 1, s) <= m).
    s is the rate at which values of such a pair agree: by similarity, or else by chance.
    """
    similarity += (1 - similarity) / 65536
    out = []
    for h in range(AT_ONCE, HASHES + 1, AT_ONCE):
        mass, m = 0.0, -1
        while mass < tolerance:
            m += 1
            mass += np.exp(lgamma(h + 2) - lgamma(m + 1) - lgamma(h + 2 - m) + m * log(similarity) + (h + 1 - m) * log(1 - similarity))
        out.append(m)
    return out


def shingled(docs: DataFrame) -> DataFrame:
    """tid (SHA-256 of the text), text's word hashes, with the columns of docs given."""
    return docs.withColumn("words", F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)))


def with_text_key(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("text_key"))


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, set_key (null without words), n, sig of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, sigs = [], [], []
            for words in batch.column(2):
                s = shingle_set(np.asarray(words.values).view(np.uint64))
                sizes.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sigs.append(signature(s).astype("<u2").tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(sigs, pa.binary())], ["doc_id", "text_key", "set_key", "n", "sig"])

    return shingled(with_text_key(docs)).select("doc_id", "text_key", "words").mapInArrow(run, "doc_id long, text_key binary, set_key binary, n int, sig binary")


def by_group(key: list[str], f, schema: str):
    """mapInArrow over rows sorted by key: f gets the columns of each whole group as lists, and yields tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            edges = edges_of(table)
            if len(edges) > 2:
                yield from f(table.slice(0, edges[-2]).combine_chunks(), edges[:-1])
            rest = table.slice(edges[-2]) if len(edges) > 1 else None
        if rest is not None and rest.num_rows:
            yield from f(rest.combine_chunks(), np.array([0, rest.num_rows]))

    def edges_of(table: pa.Table) -> np.ndarray:
        n = table.num_rows
        if not n:
            return np.zeros(1, int)
        change = np.zeros(n - 1, bool)
        for k in key:
            x = table.column(k).to_numpy()
            change |= x[1:] != x[:-1]
        return np.concatenate([[0], np.flatnonzero(change) + 1, [n]])

    return lambda df, parts: df.repartition(parts, *key).sortWithinPartitions(*key, "cid").mapInArrow(run, schema)


def band_hashes(sigs: np.ndarray) -> np.ndarray:
    """One 64-bit number for each band of each signature; equal numbers of a band are taken for equal values."""
    rows = sigs.reshape(len(sigs), BANDS, ROWS).astype(np.uint64)
    x = np.full(rows.shape[:2], np.uint64(1)) * np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        x = mixed(x * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, k])
    return x.view(np.int64)


def surviving(sigs: np.ndarray, bands: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray, band: int, similarity: float, need: list[int], ordered: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the members ``left`` and ``right`` (each pair once, if ordered) whose first shared band is this one and that outlive every comparison."""
    fits = np.minimum(sizes[left, None], sizes[None, right]) >= similarity * np.maximum(sizes[left, None], sizes[None, right])
    if ordered:
        fits &= left[:, None] < right[None, :]
    for k in range(band):
        fits &= bands[left, k, None] != bands[None, right, k]
    a, b = np.nonzero(fits)
    a, b = left[a], right[b]
    same = np.zeros(len(a), np.int32)
    for step, least in enumerate(need):
        part = slice(step * AT_ONCE, (step + 1) * AT_ONCE)
        for c in range(0, len(a), 65536):
            same[c : c + 65536] += (sigs[a[c : c + 65536], part] == sigs[b[c : c + 65536], part]).sum(1, dtype=np.int32)
        stay = same >= least
        a, b, same = a[stay], b[stay], same[stay]
    return a, b


def packed(places: np.ndarray, n: int) -> bytes:
    """Ascending places below n, as a list or as bits, whichever is shorter."""
    if 32 * len(places) <= n:
        return b"\0" + places.astype("<u4").tobytes()
    flags = np.zeros(n, bool)
    flags[places] = True
    return b"\1" + np.packbits(flags).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.int64)
    if data[0] == 0:
        return np.frombuffer(data, "<u4", offset=1).astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=1)))


def common_counts(left: list[np.ndarray], right: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many hashes left[a] and right[b] have in common; by products of incidence blocks where many pairs are asked for."""
    if len(a) <= 2 * (len(left) + len(right)):
        return np.array([len(np.intersect1d(left[i], right[j], assume_unique=True)) for i, j in zip(a.tolist(), b.tolist())], np.int64)
    sets = [*left, *right]
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(ids, kind="stable")
    ids, row = ids[order], row[order]
    total = np.zeros((len(left), len(right)), np.float32)  # whole numbers below 2**24 a block, summed exactly while sets are smaller
    exact = np.zeros(len(a), np.int64)
    for c in range(0, int(ids[-1]) + 1, 4096):
        lo, hi = np.searchsorted(ids, [c, c + 4096])
        block = np.zeros((len(sets), 4096), np.float32)
        block[row[lo:hi], ids[lo:hi] - c] = 1
        total += block[: len(left)] @ block[len(left) :].T
        if c // 4096 % 2048 == 2047:
            exact += total[a, b].astype(np.int64)
            total[:] = 0
    return exact + total[a, b].astype(np.int64)


class Roots:
    """The smallest member of each member's component, by rows of links: a row of links that are all of one component costs a look."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def link(self, member: int, others: np.ndarray) -> None:
        found = np.unique(np.append(self.of[others], self.of[member]))
        if len(found) > 1:
            self.of[np.isin(self.of, found[1:])] = found[0]


def meetings(banded: DataFrame) -> DataFrame:
    """band, value, i, j (a pair of blocks, i <= j), own (the member's block), cid: where each member of a band meets others.

    banded has band, value, cid, n. A member has a row for each block, its own and each other one once.
    """
    shared = banded.groupBy("band", "value").agg(F.count("*").alias("m"), F.sum("n").alias("hashes")).where("m > 1")
    by_bytes = F.greatest(F.ceil(F.col("hashes") * 8 / BLOCK_BYTES), F.ceil(F.col("m") * (HASHES * 2) / BLOCK_BYTES))
    blocks = F.least(F.col("m"), F.greatest(F.least(F.ceil(F.col("m") / BLOCK), F.lit(BLOCKS)), by_bytes)).cast("int")
    members = banded.drop("n").join(shared, ["band", "value"]).withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    return members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("band", "value", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cid")


def linked(docs: DataFrame, reps: DataFrame, similarity: float) -> DataFrame:
    """cid, n_links (documents of other sets), root: a row for each representative and place where it has links."""
    spark = docs.sparkSession
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    need = least_matches(similarity)

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                cids, sizes, data = (c.to_pylist() for c in batch.slice(a, 2048).columns)
                x = band_hashes(np.frombuffer(b"".join(data), "<u2").reshape(len(data), HASHES))
                cols = [np.tile(np.arange(BANDS, dtype=np.int32), len(data)), x.ravel(), np.repeat(np.array(cids, np.int64), BANDS), np.repeat(np.array(sizes, np.int32), BANDS)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["band", "value", "cid", "n"])

    banded = written(reps.select("cid", "n", "sig").mapInArrow(band, "band int, value long, cid long, n int"), "near-bands")
    met = meetings(banded)
    key = ["band", "value", "i", "j"]

    def prune(table: pa.Table, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
        names = table.column_names
        cols = {k: table.column(k).to_numpy() for k in names if k != "sig"}
        data = np.frombuffer(b"".join(table.column("sig").to_pylist()), "<u2").reshape(-1, HASHES)
        values = band_hashes(data)
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
            own, i, j = cols["own"][lo:hi], cols["i"][lo], cols["j"][lo]
            left = lo + np.flatnonzero(own == i)
            right = left if i == j else lo + np.flatnonzero(own == j)
            if not len(left) or not len(right):
                continue
            lists, known = {}, np.zeros(hi - lo, bool)
            for x in range(0, len(left), LEFT):
                found = [surviving(data, values, cols["n"], left[x : x + LEFT], right[y : y + RIGHT], int(cols["band"][lo]), similarity, need, i == j) for y in range(0, len(right), RIGHT)]
                a, b = (np.concatenate(parts) for parts in zip(*found))
                order = np.lexsort((b, a))
                a, b = a[order] - lo, b[order] - lo
                who, first = np.unique(a, return_index=True)
                lists.update((k, packed(places, hi - lo)) for k, places in zip(who.tolist(), np.split(b, first[1:])))
                known[a] = known[b] = True
            at = np.flatnonzero(known)
            for c in range(0, len(at), 2048):
                some = at[c : c + 2048]
                picked = [pa.array(cols[k][lo + some]) for k in [*key, "cid", "n", "copies"]]
                yield pa.RecordBatch.from_arrays([*picked, pa.array(some.astype(np.int32)), pa.array([lists.get(k, b"") for k in some.tolist()], pa.binary())], [*key, "cid", "n", "copies", "place", "partners"])

    schema = "band int, value long, i int, j int, cid long, n int, copies long, place int, partners binary"
    signed_members = met.join(reps.select("cid", "n", "copies", "sig"), "cid")
    pruned = written(by_group(key, prune, schema)(signed_members, parts), "near-pruned")

    # Sets are made again, of the few texts that have partners.
    asked = pruned.select("cid").distinct().join(reps.select("cid", "text_key"), "cid")
    texts = with_text_key(docs).groupBy("text_key").agg(F.first("text").alias("text")).join(asked, "text_key").select("cid", "text")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(np.asarray(w.values).view(np.uint64)).astype("<u8").tobytes() for w in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["cid", "shingles"])

    sets = shingled(texts).select("cid", "words").mapInArrow(sets_of, "cid long, shingles binary")

    def verify(table: pa.Table, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
        cid, n, copies, place = (table.column(k).to_numpy() for k in ("cid", "n", "copies", "place"))
        partners, data = table.column("partners"), table.column("shingles")
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
            links, roots = np.zeros(hi - lo, np.int64), Roots(hi - lo)
            sets = [np.frombuffer(d.as_buffer(), "<u8") for d in data.slice(lo, hi - lo)]
            sizes, count = n[lo:hi].astype(np.int64), copies[lo:hi]
            for x in range(0, hi - lo, LEFT):
                lists = [np.searchsorted(place[lo:hi], unpacked(p.as_py())) for p in partners.slice(lo + x, min(LEFT, hi - lo - x))]
                a = x + np.repeat(np.arange(len(lists)), [len(k) for k in lists])
                b = np.concatenate(lists).astype(np.int64)
                yes = np.zeros(len(a), bool)
                for y in range(0, hi - lo, RIGHT):
                    here = np.flatnonzero((b >= y) & (b < y + RIGHT))
                    if len(here):
                        who, from_ = np.unique(a[here], return_inverse=True)
                        whom, to = np.unique(b[here], return_inverse=True)
                        common = common_counts([sets[k] for k in who], [sets[k] for k in whom], from_, to)
                        yes[here] = common >= similarity * (sizes[a[here]] + sizes[b[here]] - common)
                a, b = a[yes], b[yes]
                np.add.at(links, a, count[b])
                np.add.at(links, b, count[a])
                who, first = np.unique(a, return_index=True)
                for member, others in zip(who.tolist(), np.split(b, first[1:])):
                    roots.link(member, others)
            has = np.flatnonzero(links)
            if len(has):
                own = cid[lo:hi]
                yield pa.RecordBatch.from_arrays([pa.array(own[has]), pa.array(links[has]), pa.array(own[roots.of[has]])], ["cid", "n_links", "root"])

    return by_group(key, verify, "cid long, n_links long, root long")(pruned.join(sets, "cid"), parts)


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, text_key, class_no (null without words), class_id, copy_id, n_links of every row."""
    rows = written(signed(docs), "near-signed")
    kinds = rows.where("set_key IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("copy_id"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("text_key").alias("text_key"), F.first("sig").alias("sig"))
    reps = written(kinds.withColumn("cid", F.monotonically_increasing_id()), "near-classes")
    found = written(linked(docs, reps, similarity), "near-links")
    links = found.groupBy("cid").agg(F.sum("n_links").alias("links"))
    labelled = graph.components(found.select(F.col("cid").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("cid"), "label")
    named = reps.select("set_key", "cid", "copy_id", "copies").join(links, "cid", "left").join(labelled, "cid", "left").withColumn("class_no", F.coalesce("label", "cid"))
    ids = named.groupBy("class_no").agg(F.min("copy_id").alias("class_id"))
    known = written(named.join(ids, "class_no").select("set_key", "class_no", "class_id", "copy_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "near-known")
    joined = rows.select("doc_id", "text_key", "set_key").join(known, "set_key", "left")
    alone = F.col("class_no").isNull()
    own = lambda c: F.when(alone, F.col("doc_id")).otherwise(F.col(c)).alias(c)
    return joined.select("doc_id", "text_key", "class_no", own("class_id"), own("copy_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def join(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (smallest doc_id of its component), copy_id (of its copies), n_links of every row."""
    return classes(docs, similarity).select("doc_id", "class_id", "copy_id", "n_links")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs, whole, one of each class: that of the smallest doc_id. Rows without words all stay."""
    found = written(classes(docs, similarity), "near-judged")
    best = found.where("class_no IS NOT NULL").groupBy("class_no").agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id").alias("id"), F.col("text_key").alias("key"))).alias("b")).select("b.id", "b.key")
    wordless = found.where("class_no IS NULL").select(F.col("doc_id").alias("id"), F.col("text_key").alias("key")).distinct()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # The caller's row is one struct, so its columns may have any names.
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc"), F.unhex(F.sha2(text, 256)).alias("text_key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    match = lambda right: keyed["doc"].eqNullSafe(right["id"]) & (keyed["text_key"] == right["key"])
    kept = keyed.join(best, match(best), "left_semi").dropDuplicates(["doc", "text_key"])
    return kept.unionByName(keyed.join(wordless, match(wordless), "left_semi")).select("row.*")
