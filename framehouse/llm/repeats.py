"""Suffix-array dedup: bytes of texts that stand in a 200-byte string found twice, by merging Burrows-Wheeler transforms of shards.

Equal texts are one text first: with two copies, every 200-byte string of a text repeats. For the others, each window of
``width`` bytes is given to an anchor, the first of its ``GRAM``-byte substrings with the least hash. Equal windows have
equal anchors, so only windows of anchors that occur twice can repeat; neighbouring windows of an anchor are one
segment. Where all segments of an anchor are equal, all their windows repeat. Where they differ, the distinct segments
go to a bucket by anchor. In a bucket, each shard of segments has a suffix array and a Burrows-Wheeler transform of its
own, over symbols of eight bytes. The transforms are merged by refining their interleave: the order of all suffixes by
their first h bytes, sorted stably by the symbol before each, is that by their first h + 8 bytes. The step at which two
neighbours part gives their common prefix, and after width / 8 steps the intervals that never parted are the strings that
repeat. No suffixes of different shards are ever compared, nor sorted again.

A bucket's size is bounded. The segments of an anchor that alone exceeds it are cut finer, by anchors of longer
substrings (``FINER``), of which each has fewer segments; with the last, which are as long as a window, all of an anchor's
segments are one. Every part is judged by the same merge. Equal texts are told by SHA-256, equal segments by 128 bits of
hash.

Defined results: a null text is empty; texts under ``width`` bytes lose nothing. Repeated rows are copies of each other.
Rows with a null doc_id are judged alike. Spans are of bytes and may cut a character: where text is asked for, what is
left of a cut character goes. Only the named columns are read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framehouse.plans.lineage import bucketed, written

WIDTH, GRAM, STEP = 200, 64, 8
FINER = (0.75, 1.0)  # of a window
BUCKET_BYTES, MOST_BYTES, SHARD_BYTES = 2 << 20, 8 << 20, 1 << 19
SEPARATOR = b"\xff"  # not a byte of UTF-8
BASES = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
TABLES = np.random.default_rng(200).integers(1, 1 << 64, (2, 256), np.uint64)


class Hashes:
    """64-bit polynomial hashes of substrings, from sums of the bytes' numbers times powers of an odd base."""

    def __init__(self, which: int = 0):
        self.base, self.table = BASES[which], TABLES[which]
        self.powers, self.inverses = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if n >= len(self.powers):
            m = max(n + 1, 2 * len(self.powers))
            inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
            self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(m, self.base)]), dtype=np.uint64)
            self.inverses = np.cumprod(np.concatenate([[np.uint64(1)], np.full(m, inverse)]), dtype=np.uint64)

    def sums(self, data: np.ndarray) -> np.ndarray:
        self.reach(len(data))
        return np.concatenate([[np.uint64(0)], np.cumsum(self.table[data] * self.powers[: len(data)], dtype=np.uint64)])

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((sums[end] - sums[start]) * self.inverses[start])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def segments(data: np.ndarray, width: int, gram: int, both: tuple[Hashes, Hashes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, two hashes, first window and number of windows of each segment of a text of at least ``width`` bytes."""
    hashes, second = both
    sums = hashes.sums(data)
    span, n = width - gram + 1, len(data) - gram + 1
    gram_hash = mixed((sums[gram:] - sums[:n]) * hashes.inverses[:n])
    # The hash above, the place below: the least is the leftmost of those with the least hash.
    best = (gram_hash & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    have = 1
    while have < span:
        more = min(have, span - have)
        best = np.minimum(best[: len(best) - more], best[more:])
        have += more
    at = (best & np.uint64(0xFFFFFFFF)).astype(np.int64)
    start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    count = np.diff(np.append(start, len(at)))
    end = start + count - 1 + width
    return gram_hash[at[start]].view(np.int64), hashes.of(sums, start, end).view(np.int64), second.of(second.sums(data), start, end).view(np.int64), start, count


def suffix_order(data: np.ndarray, symbols: np.ndarray, depth: int) -> np.ndarray:
    """The rotations of a shard in the order of their first ``depth`` bytes or more, by doubling of the prefix."""
    n = len(data)
    rank, have = np.unique(symbols, return_inverse=True)[1].astype(np.uint64), STEP
    while have < depth:
        pair = rank * np.uint64(n) + np.roll(rank, -have)
        rank, have = np.unique(pair, return_inverse=True)[1].astype(np.uint64), 2 * have
    return np.argsort(rank, kind="stable")


def symbols_of(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of a cyclic text, as a number that sorts as they do."""
    x = data.astype(np.uint64)
    for have in (1, 2, 4):
        x = (x << np.uint64(8 * have)) | np.roll(x, -have)
    return x


def merged(shards: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the merged transforms: the suffix (as a place in the shards laid end to end) at each place of the order, the
    common prefix with the one before in whole symbols (``width`` if never parted), and the shard of each.
    """
    suffixes, symbols = [], []
    for data in shards:
        eight = symbols_of(data)
        order = suffix_order(data, eight, width)
        suffixes.append(order)
        symbols.append(eight[(order - STEP) % len(data)])  # the transform: what stands before each suffix
    sizes = np.array([len(s) for s in suffixes])
    n, base = int(sizes.sum()), np.concatenate([[0], np.cumsum(sizes)[:-1]])
    symbol = np.unique(np.concatenate(symbols), return_inverse=True)[1].astype(np.uint64) << np.uint64(32)
    shard = np.repeat(np.arange(len(shards), dtype=np.uint16), sizes)
    common, numbers = np.full(n, width, np.int32), np.arange(n, dtype=np.uint64)
    common[:1] = 0
    for depth in range(0, width, STEP):
        block = np.cumsum(common < width, dtype=np.int32)
        place = np.argsort(shard, kind="stable")
        keyed = np.empty(n, np.uint64)
        keyed[place] = symbol
        keyed = np.sort(keyed | numbers)  # stable, for the place stands below the symbol
        order = (keyed & np.uint64(0xFFFFFFFF)).astype(np.int64)
        shard, block, sym = shard[order], block[order], keyed >> np.uint64(32)
        parted = np.concatenate([[False], (sym[1:] != sym[:-1]) | (block[1:] != block[:-1])])
        common[parted & (common == width)] = depth
    suffix = np.empty(n, np.int64)
    suffix[np.argsort(shard, kind="stable")] = np.concatenate([s + b for s, b in zip(suffixes, base)])
    return suffix, common, shard


def repeated_windows(texts: list[bytes], copies: list[int], width: int, shard_bytes: int = SHARD_BYTES) -> list[np.ndarray]:
    """For each distinct segment, which of its windows stand in two places, a segment counting as often as it has copies."""
    laid, starts, shards, held = [], [], [], 0
    at = 0
    for text in texts:
        laid.append(text + SEPARATOR)
        starts.append(at)
        at += len(text) + 1
        held += len(text) + 1
        if held >= shard_bytes:
            shards.append(np.frombuffer(b"".join(laid), np.uint8))
            laid, held = [], 0
    if laid:
        shards.append(np.frombuffer(b"".join(laid), np.uint8))
    suffix, common, _ = merged(shards, width)
    weight = np.zeros(at, np.int64)
    for s, text, n in zip(starts, texts, copies):
        weight[s : s + len(text) - width + 1] = n
    interval = np.cumsum(common < width) - 1
    total = np.bincount(interval, weight[suffix])
    again = np.zeros(at, bool)
    again[suffix] = total[interval] >= 2
    return [again[s : s + len(t) - width + 1] for s, t in zip(starts, texts)]


def runs(flags: np.ndarray) -> np.ndarray:
    """First and end of each run of true flags, one after the other."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return edge.astype(np.int32)


def distinct_texts(docs: DataFrame) -> DataFrame:
    """key (SHA-256), tid, text, copies of each distinct text, as bytes' hash; a hot text meets itself before the shuffle."""
    named = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = named.select(F.unhex(F.sha2("text", 256)).alias("key"), "text")
    return keyed.groupBy("key").agg(F.first("text").alias("text"), F.count("*").alias("copies")).withColumn("tid", F.monotonically_increasing_id())


def repeated_spans(texts: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """key, found of the texts with repeated anchors: segments (start, n), and for judged ones (start, 0, spans), which are
    the first and end of each run of repeated windows, from the segment's start."""

    def anchor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = Hashes(0), Hashes(1)
        for batch in batches:
            found = [[], [], [], [], [], []]
            for tid, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                grams, *parts = segments(np.frombuffer(text.as_buffer(), np.uint8), width, gram, both)
                for own, x in zip(found, (grams, np.full(len(grams), tid), *parts)):
                    own.append(x)
            if found[0]:
                types = (np.int64, np.int64, np.int64, np.int64, np.int32, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(t)) for x, t in zip(found, types)], ["gram", "tid", "seg", "seg2", "start", "n"])

    long_ones = texts.where(F.octet_length("text") >= width).select("key", "tid", F.encode("text", "UTF-8").alias("data"))
    anchors = written(long_ones.select("tid", "data").mapInArrow(anchor, "gram long, tid long, seg long, seg2 long, start int, n int"), "repeat-anchors")
    # Written, so that both sides of the join come straight from shuffles and a hot anchor's rows can be split among tasks.
    counted = written(anchors.groupBy("gram").agg(F.count("*").alias("c"), ((F.min("seg") != F.max("seg")) | (F.min("seg2") != F.max("seg2"))).alias("differ")).where("c > 1"), "repeat-grams")
    places = written(anchors.join(counted, "gram").select("gram", "seg", "seg2", "tid", "start", "n", "differ"), "repeat-places")  # of repeated anchors alone
    # Distinct segments of anchors with different ones: the only ones whose bytes are looked at.
    kinds = places.where("differ").groupBy("gram", "seg", "seg2").agg(F.min(F.struct("tid", "start", "n")).alias("p"), F.count("*").alias("copies"))
    # The texts are in buckets by key: with its key looked up by tid, a cut goes to its text and no text is moved.
    ids = texts.select("tid", "key")
    wanted = kinds.groupBy("p.tid").agg(F.collect_list(F.struct("gram", "copies", "p.start", "p.n")).alias("cuts")).join(ids, "tid")  # of one text at most its own anchors
    cut = wanted.select("key", "cuts").join(long_ones, "key").select("tid", F.explode("cuts").alias("x"), "data").select("x.gram", "x.copies", "tid", "x.start", F.lit(0).alias("at"), F.expr(f"substring(data, x.start + 1, x.n + {width - 1})").alias("bytes"))
    cut = written(cut, "repeat-segments")

    def merge(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        found = repeated_windows(table.column("bytes").to_pylist(), table.column("copies").to_pylist(), width)
        spans = [(runs(f) + at).tolist() for f, at in zip(found, table.column("at").to_pylist())]
        return table.select(["tid", "start", "copies"]).append_column("spans", pa.array(spans, pa.list_(pa.int32())))

    def finer(gram: int):
        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            both = Hashes(0), Hashes(1)
            for batch in batches:
                for tid, start, at, copies, data in zip(*(batch.column(k).to_pylist() for k in range(5))):
                    grams, seg, seg2, first, n = segments(np.frombuffer(data, np.uint8), width, gram, both)
                    own = [data[a : a + m + width - 1] for a, m in zip(first.tolist(), n.tolist())]
                    same = [pa.array(np.full(len(n), x, t)) for x, t in ((tid, np.int64), (start, np.int32), (copies, np.int64))]
                    yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(seg), pa.array(seg2), *same, pa.array((first + at).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(own, pa.binary())], ["gram", "seg", "seg2", "tid", "start", "copies", "at", "n", "bytes"])

        return split

    place = ["tid", "start", "copies"]
    answers, level = [], cut
    for share in (*FINER, None):
        sized = level.groupBy("gram").agg(F.sum(F.octet_length("bytes")).alias("size"))
        total, most = sized.agg(F.sum("size"), F.max("size")).first()
        too_much = share is not None and (most or 0) > MOST_BYTES
        fitting = level.join(sized.where(F.col("size") <= MOST_BYTES), "gram", "left_semi") if too_much else level
        buckets = max(1, -(-(total or 0) // BUCKET_BYTES))
        dealt = fitting.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(buckets)))
        answers.append(dealt.groupBy("bucket").applyInArrow(merge, "tid long, start int, copies long, spans array<int>"))
        if not too_much:
            break
        hot = level.join(sized.where(F.col("size") > MOST_BYTES), "gram", "left_semi")
        answers.append(hot.select(*place, F.array().cast("array<int>").alias("spans")))  # those without any
        parts = written(hot.select("tid", "start", "at", "copies", "bytes").mapInArrow(finer(round(width * share)), "gram long, seg long, seg2 long, tid long, start int, copies long, at int, n int, bytes binary"), "repeat-finer")
        alike = written(parts.groupBy("gram", "seg", "seg2").agg(F.min(F.struct("tid", "start", "at")).alias("p"), F.sum("copies").alias("copies"), F.first("bytes").alias("bytes")), "repeat-alike")
        again = parts.where("copies = 1").join(alike.where("copies > 1").select("gram", "seg", "seg2"), ["gram", "seg", "seg2"], "left_semi")
        answers.append(again.select(*place, F.array(F.col("at"), F.col("at") + F.col("n")).alias("spans")))
        level = alike.select("gram", "copies", "p.tid", "p.start", "p.at", "bytes")
    answered = reduce(DataFrame.unionByName, answers)
    if len(answers) > 1:
        answered = answered.where("copies = 1").groupBy(*place).agg(F.flatten(F.collect_list("spans")).alias("spans"))
    # All windows of a segment with copies repeat. One without has a place of its own, and the merge has judged it.
    found = places.select("tid", "start", "n", F.lit(None).cast("array<int>").alias("spans"))
    single = answered.where("copies = 1").select("tid", "start", F.lit(0).alias("n"), "spans")
    of_text = found.unionByName(single).groupBy("tid").agg(F.collect_list(F.struct("start", "n", "spans")).alias("found"))  # of one text
    return of_text.join(ids, "tid").select("key", "found")


def judged(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, as_text: bool = False) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept of each distinct text; key is the text's SHA-256, kept its other bytes or characters."""
    texts = bucketed(distinct_texts(docs), "repeat-texts", "key")
    spans = repeated_spans(texts, width, gram)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, gone, n_spans, kept = [], [], [], [], []
            for key, copies, data, found in zip(*(batch.column(k).to_pylist() for k in range(4))):
                own = {x["start"]: x["spans"] for x in found or () if x["spans"] is not None}
                pairs = [(x["start"], x["start"] + x["n"]) for x in found or () if x["spans"] is None and x["start"] not in own]
                pairs += [(at + a, at + b) for at, spans in own.items() for a, b in zip(spans[::2], spans[1::2])]
                pairs = np.array(pairs, np.int64).reshape(-1, 2)
                if copies > 1 and len(data) >= width:
                    pairs = np.array([[0, len(data) - width + 1]])
                pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
                ends = np.maximum.accumulate(pairs[:, 1] + width - 1)  # windows to bytes
                new = np.concatenate([[True], pairs[1:, 0] > ends[:-1]]) if len(pairs) else np.zeros(0, bool)
                first = pairs[new, 0].tolist()
                last = ends[np.append(np.flatnonzero(new)[1:] - 1, len(pairs) - 1)].tolist() if len(pairs) else []
                left = b"".join(data[a:b] for a, b in zip([0, *last], [*first, len(data)]))
                keys.append(key), sizes.append(len(data)), gone.append(len(data) - len(left)), n_spans.append(len(first)), kept.append(left.decode("utf-8", "ignore") if as_text else left)
            types = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string() if as_text else pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((keys, sizes, gone, n_spans, kept), types)], ["key", "n_bytes", "n_removed", "n_spans", "kept"])

    whole = texts.join(spans, "key", "left").select("key", "copies", F.encode("text", "UTF-8").alias("data"), "found")
    return whole.mapInArrow(cut, f"key binary, n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}")


def keyed(docs: DataFrame, row: Column) -> DataFrame:
    """key, had (whether the text is not null) and the given row of every row of docs."""
    return docs.select(F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)).alias("key"), F.col("text").isNotNull().alias("had"), row.alias("row"))


def digest_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    found = judged(docs, width).select("key", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    return keyed(docs, F.col("doc_id")).join(written(found, "repeat-digests"), "key").select(F.col("row").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def remove_repeats(docs: DataFrame, width: int = WIDTH, drop_emptied: bool = False) -> DataFrame:
    """All columns and rows of docs, text without its repeated bytes (a null text stays null) and n_chars, if any, of what is left.

    With drop_emptied, rows go of which bytes were removed and none is left. The columns may have any names.
    """
    found = written(judged(docs, width, as_text=True).select("key", "kept", "n_removed"), "repeat-kept")
    # What is kept of a text is the whole of it where nothing went, so the text itself need not be moved.
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    joined = keyed(docs, F.struct(*others) if others else F.lit(None)).join(found, "key")
    if drop_emptied:
        joined = joined.where((F.col("n_removed") == 0) | (F.length("kept") > 0))
    text = F.when(F.col("had"), F.col("kept"))
    n_chars = lambda c: F.when(F.col("n_removed") > 0, F.length(text)).otherwise(F.col("row").getField(c)).cast(docs.schema[c].dataType)
    made = {"text": lambda c: text, "n_chars": n_chars}
    return joined.select([made.get(c, F.col("row").getField)(c).alias(c) for c in docs.columns])
