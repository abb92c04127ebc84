"""Best-fit packing of token pieces into sequences by a grouping genetic algorithm on islands.

Texts become ids by a tokenizer file, each followed by an end id; only documents above the capacity are cut. Whole
pieces fill a sequence of their own. The rest is dealt by hash into pools of a bounded number of pieces, and each pool
is evolved on several islands. Islands begin with different solutions: best fit of the pieces in falling order of size
on the first, in orders of their own chance elsewhere. Crossover injects whole well-filled bins of one parent into
another, drops the bins that hold the same pieces, lets displaced pieces take the places of smaller ones that they fill
better, and best-fits what is then left. Elites migrate between the islands of a pool, and the best solution stays.
Bins that are not well filled are then dealt together into new pools, where their old solution competes, so a second
round never uses more sequences.

Defined results: a null or empty text is its end id alone. Repeated rows, and rows with a null doc_id, are packed
each for itself. An empty table gives no rows. Only doc_id and text are read; other columns, of any name, are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framehouse.llm.tokens import default_tokenizer, word_encoder
from framehouse.plans.lineage import written

CAPACITY, END_ID = 2048, 0
POOL, ISLANDS, POPULATION, LEAST_GENERATIONS, GENERATIONS, PATIENCE = 4096, 2, 4, 2, 40, 6
WELL_FILLED = 0.97


def token_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; texts stay in their partition."""
    path = tokenizer or default_tokenizer()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = word_encoder(path), np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist())):
                data, n = ids + end, len(ids) // 4 + 1
                for k, at in enumerate(range(0, n, capacity)):
                    rows.append((doc, k, at, min(capacity, n - at), zlib.crc32(data[at * 4 : (at + capacity) * 4])))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return read.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: np.ndarray, order: np.ndarray, bins: np.ndarray, room: dict[int, int], capacity: int) -> None:
    """Put the items of order, one after another, into the open bin that they fill best, or a new one; bins and room change."""
    open_bins = sorted((r, b) for b, r in room.items() if r)
    new = max(room, default=-1) + 1
    for item, size in zip(order.tolist(), sizes[order].tolist()):
        at = bisect_left(open_bins, (size, -1))
        if at < len(open_bins):
            left, b = open_bins.pop(at)
        else:
            left, b, new = capacity, new, new + 1
        bins[item], room[b] = b, left - size
        if left > size:
            insort(open_bins, (left - size, b))


def numbered(bins: np.ndarray) -> np.ndarray:
    return np.unique(bins, return_inverse=True)[1].astype(np.int32)


def fills(sizes: np.ndarray, bins: np.ndarray) -> np.ndarray:
    return np.bincount(bins, sizes).astype(np.int64)


def fitness(sizes: np.ndarray, bins: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first; among equals, fuller and emptier bins rather than even ones."""
    full = fills(sizes, bins)
    return -len(full), float(((full / capacity) ** 2).mean()) if len(full) else 0.0


def replaced(sizes: np.ndarray, bins: np.ndarray, items: np.ndarray, room: np.ndarray) -> np.ndarray:
    """What is left of displaced items after each, the largest first, took the place of the smaller one by which its bin
    gains most; the smaller is displaced instead. Bins and room change. Their sum falls at every exchange, so it ends."""
    waiting = sorted((int(sizes[i]), int(i)) for i in items)
    left = []
    seated = np.ones(len(sizes), bool)
    seated[items] = False
    while waiting:
        size, item = waiting.pop()
        gain = size - sizes
        free = room[bins]
        fits = seated & (gain > 0) & (gain <= free) & (free > 0)
        if not fits.any():
            left.append(item)
            continue
        out = int(np.argmin(np.where(fits, free - gain, np.iinfo(np.int64).max)))
        room[bins[out]] -= gain[out]
        bins[item], seated[item], seated[out] = bins[out], True, False
        insort(waiting, (int(sizes[out]), out))
    return np.array(left, np.int64)


def crossover(sizes: np.ndarray, one: np.ndarray, other: np.ndarray, rng: np.random.Generator, capacity: int) -> np.ndarray:
    """A child of one with whole well-filled bins of other; bins that hold their items go, and what they displaced is placed anew."""
    full = fills(sizes, other)
    good = np.flatnonzero(full >= WELL_FILLED * capacity)
    if not len(good):
        good = np.argsort(-full, kind="stable")[: max(1, len(full) // 4)]
    chosen = np.zeros(len(full), bool)
    chosen[rng.permutation(good)[: max(1, int(len(good) * rng.uniform(0.02, 0.12)))]] = True
    injected = chosen[other]
    broken = np.zeros(one.max() + 1, bool)
    broken[one[injected]] = True
    # The worst bins of the child go too: their items are what keeps it from fewer bins.
    kept_fill = np.where(broken, capacity + 1, fills(sizes, one))
    broken[np.argsort(kept_fill, kind="stable")[:2]] = True
    displaced = broken[one] & ~injected
    child = np.where(injected, one.max() + 1 + other, one)
    kept = ~displaced
    ids, used = np.unique(child[kept], return_inverse=True)
    room = capacity - np.bincount(used, sizes[kept], len(ids)).astype(np.int64)
    child[kept] = used
    child[displaced] = 0  # not a place yet
    items = replaced(sizes, child, np.flatnonzero(displaced), room)
    best_fit(sizes, items[np.argsort(-sizes[items], kind="stable")], child, dict(enumerate(room.tolist())), capacity)
    return numbered(child)


def seeded(sizes: np.ndarray, rng: np.random.Generator, capacity: int, first: bool) -> list[np.ndarray]:
    """A population: the first island's has best fit in falling order; all others are best fits in orders of chance,
    from nearly falling to nearly random."""
    out = []
    for k in range(POPULATION):
        noise = sizes if first and not k else sizes * np.exp(rng.normal(0, 0.05 * 4**k / 4, len(sizes)))
        bins = np.zeros(len(sizes), np.int64)
        best_fit(sizes, np.argsort(-noise, kind="stable"), bins, {}, capacity)
        out.append(numbered(bins))
    return out


def evolved(sizes: np.ndarray, population: list[np.ndarray], rng: np.random.Generator, capacity: int, first: bool = True) -> tuple[list[np.ndarray], int]:
    """The population after its generations, the best first, and the number of crossovers.

    It ends after LEAST_GENERATIONS at the least possible number of bins, or when PATIENCE generations brought no fewer.
    """
    least = -(-int(sizes.sum()) // capacity)
    population = [p for p in population if len(p) == len(sizes)]
    if len(population) < POPULATION:
        population = [*population, *seeded(sizes, rng, capacity, first)][: POPULATION + 1]
    rank = lambda p: fitness(sizes, p, capacity)
    population.sort(key=rank, reverse=True)
    best, since, crossed = int(population[0].max()) + 1, 0, 0
    for generation in range(GENERATIONS):
        if generation >= LEAST_GENERATIONS and (best <= least or since >= PATIENCE):
            break
        a, b = rng.permutation(len(population))[:2]
        children = [crossover(sizes, population[a], population[b], rng, capacity), crossover(sizes, population[0], population[1 + rng.integers(len(population) - 1)], rng, capacity)]
        crossed += len(children)
        population = sorted([*population, *children], key=rank, reverse=True)[:POPULATION]
        since = 0 if population[0].max() + 1 < best else since + 1
        best = int(population[0].max()) + 1
    return population, crossed


def _epoch(states: DataFrame, capacity: int, epoch: int) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            pops, used, crossed = [], [], []
            for pool, island, sizes, pop in zip(frame["pool"], frame["island"], frame["sizes"], frame["pop"]):
                rng = np.random.default_rng([epoch, int(pool), int(island)])
                best, n = evolved(np.asarray(sizes, np.int64), [np.asarray(p, np.int64) for p in pop], rng, capacity, first=not island)
                pops.append([p.tolist() for p in best])
                used.append(int(best[0].max()) + 1)
                crossed.append(n)
            yield frame.assign(pop=pops, used=used, crossed=crossed)[["pool", "island", "rids", "sizes", "pop", "used", "crossed"]]

    return states.select("pool", "island", "rids", "sizes", "pop").mapInPandas(run, "pool long, island int, rids array<long>, sizes array<long>, pop array<array<int>>, used int, crossed int")


def pooled(items: DataFrame, n_items: int, capacity: int, deal: list[str], old: bool) -> DataFrame:
    """rid, pool, bin, fill of each item: every pool evolved on its islands, with elites migrating once.

    A pool holds about POOL items, whatever they are, for it is dealt by hash of a key that at most CAPACITY items share.
    """
    n_pools = max(1, -(-n_items // POOL))
    pools = (
        items.withColumn("pool", F.pmod(F.xxhash64(*deal, F.lit("pool")), F.lit(n_pools)))
        .groupBy("pool")
        .agg(F.array_sort(F.collect_list(F.struct("rid", "length", "old"))).alias("items"))
    )
    start = F.array(F.col("items.old")) if old else F.array().cast("array<array<int>>")
    states = pools.select("pool", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), F.col("items.rid").alias("rids"), F.col("items.length").alias("sizes"), start.alias("pop"))
    first = written(_epoch(states, capacity, 1), "pack-epoch")
    elites = first.select("pool", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int").alias("island"), F.slice("pop", 1, 1).alias("elite"))
    met = first.join(elites, ["pool", "island"]).withColumn("pop", F.concat("elite", "pop"))
    last = _epoch(met, capacity, 2)
    best = last.groupBy("pool").agg(F.min_by(F.struct("rids", "sizes", F.element_at("pop", 1).alias("bins")), F.struct("used", "island")).alias("b"))
    return best.select("pool", F.posexplode("b.rids").alias("at", "rid"), F.col("b.bins").alias("bins"), F.col("b.sizes").alias("sizes")).select(
        "rid", "pool", F.element_at("bins", F.col("at") + 1).alias("bin"), F.element_at("sizes", F.col("at") + 1).alias("length"))


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece."""
    pieces = written(token_pieces(docs, tokenizer, capacity).withColumn("rid", F.monotonically_increasing_id()), "pack-pieces")
    whole, tails = pieces.where(F.col("length") == capacity), pieces.where(F.col("length") < capacity)
    items = tails.select("rid", "length", F.lit(0).alias("old"))
    placed = written(pooled(items, tails.count(), capacity, ["rid"], old=False), "pack-placed")
    fill = placed.groupBy("pool", "bin").agg(F.sum("length").alias("fill"))
    loose = fill.where(F.col("fill") < WELL_FILLED * capacity)
    again = placed.join(loose, ["pool", "bin"], "left_semi")
    kept = placed.join(loose, ["pool", "bin"], "left_anti").select("rid", (F.col("pool") * F.lit(1 << 21) + F.col("bin")).alias("sequence_id"))
    # Old bins are dealt whole; their numbers within the new pool only need to differ.
    number = F.dense_rank().over(_by("again")).cast("int")
    n_loose = again.count()
    dealt = again.withColumn("again", F.pmod(F.xxhash64("pool", "bin", F.lit("pool")), F.lit(max(1, -(-n_loose // POOL)))))
    second = dealt.withColumn("old", number - 1).select("rid", "length", "old", F.col("pool").alias("p0"), F.col("bin").alias("b0"))
    moved = pooled(second, n_loose, capacity, ["p0", "b0"], old=True).select("rid", (F.lit(1 << 61) + F.col("pool") * F.lit(1 << 21) + F.col("bin")).alias("sequence_id"))
    seated = kept.unionByName(moved)
    alone = whole.withColumn("sequence_id", F.lit(1 << 62) + F.col("rid")).withColumn("offset", F.lit(0).cast("long"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    joined = tails.join(seated, "rid")
    before = F.sum("length").over(_sequence()) - F.col("length")
    return joined.withColumn("offset", before.cast("long")).select(columns).unionByName(alone.select(columns))


def _by(pool: str):
    from pyspark.sql import Window

    return Window.partitionBy(pool).orderBy("pool", "bin")


def _sequence():
    from pyspark.sql import Window

    return Window.partitionBy("sequence_id").orderBy("rid")
