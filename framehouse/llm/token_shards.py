"""Token ids in training order: fixed-stride binary shards whose global order is a keyed permutation of all sequences.

The ids of documents, each followed by an end id, run on through sequences of ``length`` ids within a partition of the
input, so that only a partition's last sequence may be shorter. Sequence number i of n takes the global slot that a
keyed Feistel network gives it, walking its cycle until the slot is below n. Slots are dealt by range to shards, so
reading the shards one after another is reading in training order, and any slot's bytes are at a place known by
arithmetic. A task sends each shard its sequences as compressed blocks, not one by one. A table of documents tells which part of which document stands where.

A record is ``2 + 2 * length`` bytes: the number of ids, the ids as little-endian unsigned 16-bit numbers, zeros to the end.

Defined results: a null or empty text is the end id alone. Repeated rows, and rows with a null doc_id, each have places
of their own. An empty table writes no shards. Only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framehouse.llm import files
from framehouse.llm.tokens import default_tokenizer, slices, word_encoder
from framehouse.plans.lineage import fresh_path, written

LENGTH, SHARD_BYTES, KEY, ROUNDS, END_ID = 512, 16 << 20, 0x5EED, 6, 0
HELD_BYTES, BLOCK_LEVEL = 64 << 20, 3


def stride(length: int) -> int:
    return 2 + 2 * length


def feistel(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A permutation of 0..n-1: a balanced network over the next even number of bits, walked until it falls below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.SeedSequence(key).generate_state(ROUNDS, np.uint64)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            f = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            f ^= f >> np.uint64(29)
            f *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f >> np.uint64(32)) & mask)
        return (left << np.uint64(half)) | right

    with np.errstate(over="ignore"):
        out = once(index.astype(np.uint64))
        while (far := out >= np.uint64(n)).any():
            out[far] = once(out[far])
    return out.astype(np.int64)


PARTS = pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("offset", pa.int32()), ("n", pa.int32())])
SEQUENCE = pa.schema([("part", pa.int32()), ("at", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.binary()), ("docs", pa.list_(PARTS))])


def sequences(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH) -> DataFrame:
    """part, at, n_tokens, ids, docs of every sequence; (part, at) numbers them within the writing task.

    docs are the parts of documents in it: start counts the document's ids before the part, offset the sequence's.
    """
    path = tokenizer or default_tokenizer()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = word_encoder(path), TaskContext.get().partitionId()
        at, rest, size = 0, b"", 2 * length
        held, used = [[], [], [], []], [0]  # the columns of PARTS, and where each sequence's parts begin and end

        def table(data: list[bytes]) -> pa.RecordBatch:
            nonlocal at, held, used
            n = used[len(data)]
            items = pa.StructArray.from_arrays([pa.array(c[:n], t.type) for c, t in zip(held, PARTS)], fields=list(PARTS))
            cols = [pa.array([part] * len(data), pa.int32()), pa.array(range(at, at + len(data)), pa.int64()), pa.array([len(d) // 2 for d in data], pa.int32()), pa.array(data, pa.binary()), pa.ListArray.from_arrays(pa.array(used[: len(data) + 1], pa.int32()), items)]
            at, held, used = at + len(data), [c[n:] for c in held], [0]
            return pa.RecordBatch.from_arrays(cols, schema=SEQUENCE)

        for batch in slices(batches):
            raws, filled = [rest], len(rest) // 2
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist())):
                wide = np.append(np.frombuffer(ids, "<u4"), END_ID)
                if wide.max() > 0xFFFF:
                    raise ValueError("this vocabulary needs more than 16 bits an id")
                raws.append(wide.astype("<u2").tobytes())
                start, n = 0, len(wide)
                while start < n:
                    take = min(length - filled, n - start)
                    for column, x in zip(held, (doc, start, filled, take)):
                        column.append(x)
                    start, filled = start + take, filled + take
                    if filled == length:
                        used.append(len(held[0]))
                        filled = 0
            data = b"".join(raws)
            whole = len(data) - len(data) % size
            rest = data[whole:]
            if whole:
                yield table([data[a : a + size] for a in range(0, whole, size)])
        if rest:
            used.append(len(held[0]))
            yield table([rest])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return read.mapInArrow(cut, "part int, at long, n_tokens int, ids binary, docs array<struct<doc_id: long, start: long, offset: int, n: int>>")


def slotted(cut: DataFrame, key: int) -> tuple[DataFrame, int]:
    """The sequences with their slot. What reaches the driver is a count for each written partition."""
    counts = sorted((r.part, r.n) for r in cut.groupBy("part").agg(F.count("*").alias("n")).collect())
    starts, total = {}, 0
    for part, n in counts:
        starts[part], total = total, total + n

    @F.pandas_udf("long")
    def slot(part: pd.Series, at: pd.Series) -> pd.Series:
        return pd.Series(feistel((part.map(starts) + at).to_numpy(np.int64), total, key))

    return cut.withColumn("slot", slot("part", "at")), total


def write_shards(docs: DataFrame, path: str, tokenizer: str | None = None, length: int = LENGTH, key: int = KEY, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, int, int]:
    """Shards under path; the table of documents (slot, offset, doc_id, start, n), the number of slots and the slots of a shard."""
    cut = written(sequences(docs, tokenizer, length), "token-sequences", zstd_level=9)
    placed, total = slotted(cut, key)
    each = max(1, shard_bytes // stride(length))
    n_shards = max(1, -(-total // each))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd, held, size = zstandard.ZstdCompressor(level=BLOCK_LEVEL), {}, 0

        def blocks() -> pa.RecordBatch:
            shards = sorted(held)
            data = [zstd.compress(np.array([s for s, _ in held[k]], "<i8").tobytes() + np.array([len(i) for _, i in held[k]], "<u2").tobytes() + b"".join(i for _, i in held[k])) for k in shards]
            return pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array([len(held[k]) for k in shards], pa.int32()), pa.array(data, pa.binary())], ["shard", "rows", "data"])

        for batch in batches:
            for s, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(s // each, []).append((s, ids))
                size += len(ids)
            if size > HELD_BYTES:
                yield blocks()
                held, size = {}, 0
        if held:
            yield blocks()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, unzip, shards = TaskContext.get(), zstandard.ZstdDecompressor(), {}
        for batch in batches:
            for shard, rows, data in zip(*(c.to_pylist() for c in batch.columns)):
                raw = unzip.decompress(data)
                ends = 10 * rows + np.cumsum(np.frombuffer(raw, "<u2", rows, 8 * rows), dtype=np.int64)
                slots = np.frombuffer(raw, "<i8", rows).tolist()
                shards.setdefault(shard, {}).update((s, raw[a:b]) for s, a, b in zip(slots, [10 * rows, *ends[:-1].tolist()], ends.tolist()))
        for shard, found in sorted(shards.items()):
            first = shard * each
            want = min(each, total - first)
            if sorted(found) != list(range(first, first + want)):
                raise ValueError(f"shard {shard} hasn't every slot once")
            records = ((len(found[s]) // 2).to_bytes(2, "little") + found[s].ljust(2 * length, b"\0") for s in range(first, first + want))
            files.put(path, f"shard-{shard:08d}.bin", f"{task.stageId()}-{task.attemptNumber()}", records)
        yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int32())], ["done"])

    blocks = placed.select("slot", "ids").mapInArrow(deal, "shard int, rows int, data binary")
    blocks.repartitionById(n_shards, F.col("shard")).mapInArrow(write, "done int").agg(F.count("*")).collect()
    return placed.select("slot", F.explode("docs").alias("d")).select("slot", "d.offset", "d.doc_id", "d.start", "d.n"), total, each


def read_shards(index: DataFrame, path: str, total: int, each: int, length: int = LENGTH) -> DataFrame:
    """slot, shard, byte_offset, doc_id, start, n_tokens, ids_crc32 of every part of a document, the last from the shards' bytes.

    The table of documents goes to its shards as the sequences did; a task opens each shard once, and no shard's bytes move.
    """
    size, schema = stride(length), "slot long, shard long, byte_offset long, doc_id long, start long, n_tokens long, ids_crc32 long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, data = None, b""
        for batch in batches:
            slot, offset, n = (batch.column(k).to_numpy() for k in (0, 1, 4))
            shard, place = slot // each, slot % each * size + 2 + 2 * offset.astype(np.int64)
            crcs = []
            for s, a, m in zip(shard.tolist(), place.tolist(), n.tolist()):
                if s != opened:
                    opened, data = s, files.get(path, f"shard-{s:08d}.bin")
                crcs.append(zlib.crc32(np.frombuffer(data, "<u2", m, a).astype("<u4").tobytes()))
            cols = [batch.column(0), pa.array(shard), pa.array(place), batch.column(2), batch.column(3), pa.array(n.astype(np.int64)), pa.array(crcs, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["slot", "shard", "byte_offset", "doc_id", "start", "n_tokens", "ids_crc32"])

    shard_of = F.floor(F.col("slot") / F.lit(each)).cast("int")
    return index.repartitionById(max(1, -(-total // each)), shard_of).sortWithinPartitions("slot", "offset").mapInArrow(read, schema)


def resume(path: str, slot: int, each: int, total: int, length: int = LENGTH) -> Iterator[np.ndarray]:
    """The ids of every sequence from a slot on, in training order, for a reader that stopped there."""
    size = stride(length)
    while slot < total:
        shard, skip = divmod(slot, each)
        data = files.get(path, f"shard-{shard:08d}.bin", skip * size)
        for a in range(0, len(data), size):
            yield np.frombuffer(data, "<u2", int.from_bytes(data[a : a + 2], "little"), a + 2)
        slot = (shard + 1) * each


def materialise(docs: DataFrame, path: str | None = None, tokenizer: str | None = None, length: int = LENGTH, key: int = KEY, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """slot, shard, byte_offset, doc_id, start, n_tokens, ids_crc32 of every part of a document; ids as read back from the shards."""
    path = path or fresh_path(docs.sparkSession, "token-shards")
    index, total, each = write_shards(docs, path, tokenizer, length, key, shard_bytes)
    return read_shards(index, path, total, each, length)
