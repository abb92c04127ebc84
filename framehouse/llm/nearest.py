"""Approximate nearest neighbours by largest inner product: balanced posting lists found through a graph of centroids.

Vectors get one more component that makes all norms equal, so that the largest inner product is the smallest distance.
Centroids, about ``PER_ROOT`` times the root of the number of vectors, are fitted in numpy on a bounded sample; every
vector is then indexed: in the list of its nearest centroid and, near a boundary, in the lists of further centroids
whose distance is within a ratio of the smallest. A query searches the graph of centroids, keeps the lists within a
ratio of the nearest one's distance, and scores their vectors exactly. That ratio is measured, not guessed: a bounded
number of probe queries is compared with all vectors by brute force, in blocks, and the ratio is the one within which
``RECALL`` of their true neighbours have a list.

Lists of near centroids stand together on shelves of about ``shelf`` vectors, a larger list on several; a shelf is what
one task reads. A query is answered first on its home shelf, that of its nearest list. On the other shelves it then
gives only what reaches the k-th score found at home, so that what meets of a query does not grow with its lists.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows
with a null vec_id or vectors of another than the most frequent length. Of repeated vec_ids a query's vector is the
smallest, and a candidate counts once with its best score. Ties go to the smaller vec_id. With fewer candidates than
``k``, all are returned. Only vec_id and embedding are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framehouse.plans.lineage import written

K, EVERY = 20, 20
SAMPLE, PER_ROOT, MOST_LISTS, SHELF, ASKED = 65_536, 4, 16_384, 4096, 2048
REPLICAS, BOUNDARY, LEAST_LISTS, DEGREE, SEED = 2, 1.1, 4, 16, 3
PROBES, RECALL = 128, 0.95


@dataclass(frozen=True)
class Centroids:
    points: np.ndarray  # lists x (dimension + 1)
    neighbours: np.ndarray  # lists x degree
    norm2: float  # the largest squared norm

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.norm2 - (vectors**2).sum(1), 0))
        return np.column_stack([vectors, rest])

    def nearest(self, point: np.ndarray, width: int) -> list[tuple[float, int]]:
        """Best-first search of the graph from spread entries: the ``width`` nearest centroids found, nearest first."""
        entries = np.unique(np.linspace(0, len(self.points) - 1, 8).astype(int))
        gap = lambda at: np.sqrt(((self.points[at] - point) ** 2).sum(1))
        seen, best, front = set(entries.tolist()), [], []
        for d, c in zip(gap(entries).tolist(), entries.tolist()):
            heappush(front, (d, c))
            heappush(best, (-d, c))
        while front:
            d, c = heappop(front)
            if len(best) >= width and d > -best[0][0]:
                break
            new = [n for n in self.neighbours[c].tolist() if n not in seen]
            if new:
                seen.update(new)
                for dn, n in zip(gap(np.array(new)).tolist(), new):
                    heappush(front, (dn, n))
                    heappush(best, (-dn, n))
                    if len(best) > width:
                        heappop(best)
        return sorted((-d, c) for d, c in best)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * a @ b.T, 0)


def fit(sample: np.ndarray, n: int, norm2: float, seed: int = SEED) -> Centroids:
    """Balanced k-means: each round the lists above twice the mean size lend their members to the emptiest centroids."""
    rng = np.random.default_rng(seed)
    shell = Centroids(np.zeros((1, sample.shape[1] + 1)), np.zeros((1, 1), int), norm2)
    x = np.unique(shell.lifted(sample), axis=0)
    k = int(min(max(1, PER_ROOT * np.sqrt(n)), MOST_LISTS, max(1, len(x) // 4)))
    points = x[rng.choice(len(x), k, replace=False)]
    for _ in range(8):
        near = np.concatenate([_squared(x[a : a + 4096], points).argmin(1) for a in range(0, len(x), 4096)])
        size = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        starts = np.concatenate([[0], np.cumsum(size)])
        points = np.array([x[order[starts[c] : starts[c + 1]]].mean(0) if size[c] else points[c] for c in range(k)])
        big, small = np.flatnonzero(size > 2 * len(x) / k), np.argsort(size, kind="stable")
        for c, empty in zip(big[np.argsort(-size[big], kind="stable")].tolist(), small.tolist()):
            if size[empty] * 4 > size[c]:
                break
            points[empty] = x[order[starts[c] + rng.integers(size[c])]]
    degree = min(DEGREE, k)
    links = np.concatenate([np.argsort(_squared(points[a : a + 1024], points), 1, kind="stable")[:, :degree] for a in range(0, k, 1024)])
    far = rng.integers(0, k, (k, 4))  # a few long links keep the graph in one piece
    return Centroids(points, np.column_stack([links, far, (np.arange(k) + 1) % k]), norm2)


def lists_of(vectors: np.ndarray, c: Centroids) -> list[list[int]]:
    """The nearest list of each vector, and further ones near the boundary that no chosen list stands before."""
    out = []
    for a in range(0, len(vectors), 2048):
        x = c.lifted(vectors[a : a + 2048])
        gap = np.sqrt(_squared(x, c.points))
        order = np.argsort(gap, 1, kind="stable")[:, : 2 * REPLICAS]
        for i, row in enumerate(order):
            chosen = [int(row[0])]
            for j in row[1:].tolist():
                if len(chosen) == REPLICAS or gap[i, j] > BOUNDARY * gap[i, chosen[0]]:
                    break
                if all(((c.points[j] - c.points[o]) ** 2).sum() > gap[i, j] ** 2 * 0.25 for o in chosen):
                    chosen.append(j)
            out.append(chosen)
    return out


def calibrated(c: Centroids, queries: np.ndarray, owner: np.ndarray, neighbours: np.ndarray, recall: float = RECALL) -> tuple[float, int]:
    """The distance ratio within which that share of true neighbours has a list, and how many lists it may span."""
    gap = np.sqrt(_squared(np.column_stack([queries, np.zeros(len(queries))]), c.points))
    ratio = gap / np.maximum(gap.min(1, keepdims=True), 1e-12)
    if not len(neighbours):
        return 1.0, LEAST_LISTS
    needed = [min(ratio[o, j] for j in lists) for o, lists in zip(owner, lists_of(neighbours, c))]
    cut = float(np.quantile(needed, recall, method="higher"))
    return cut, max(LEAST_LISTS, int((ratio <= cut).sum(1).max() * 1.25) + 8)


def searched(vectors: np.ndarray, c: Centroids, sizes: np.ndarray, k: int, ratio: float, width: int) -> list[list[int]]:
    """The lists of each query: at least LEAST_LISTS and enough to hold k others, then all within the distance ratio.

    ``sizes`` count distinct vec_ids, one that stands in more than REPLICAS lists by a share in each.
    """
    out = []
    for point in np.column_stack([vectors, np.zeros(len(vectors))]):
        found = c.nearest(point, width)
        chosen, held = [], 0.0
        for d, j in found:
            if len(chosen) >= LEAST_LISTS and held > REPLICAS * k + 1 and d > ratio * found[0][0]:
                break
            chosen.append(j)
            held += float(sizes[j])
        if held <= REPLICAS * k + 1:
            chosen = list(range(len(sizes)))
        out.append(chosen)
    return out


def best_of(queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, own: np.ndarray, k: int, wanted: np.ndarray | None = None, least: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the k best candidates of a block but itself, each id by its best row: its number, rows and scores.

    ``wanted`` says which rows a query may have, ``least`` which score one must reach.
    """
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    firsts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, int)
    floor = np.full(len(queries), -np.inf) if least is None else least
    for a in range(0, len(queries), 256):
        rough = queries[a : a + 256] @ vectors.T
        rough[own[a : a + 256, None] == ids[None, :]] = -np.inf
        if wanted is not None:
            rough[~wanted[a : a + 256][:, order]] = -np.inf
        by_id = rough if len(firsts) == len(ids) else np.maximum.reduceat(rough, firsts, 1)
        cut = np.partition(by_id, -k, 1)[:, -k] if len(firsts) > k else np.full(len(rough), -np.inf)
        cut = np.maximum(cut, floor[a : a + 256])
        slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(cut), cut, 0)))
        for i, row in enumerate(rough):
            at = np.flatnonzero((row >= cut[i] - slack[i]) & (row > -np.inf))
            score = (vectors[at] * queries[a + i]).sum(1)  # in one fixed order of addition, so equal vectors tie
            best = np.lexsort((ids[at], -score))
            best = best[score[best] >= floor[a + i]]
            best = best[np.sort(np.unique(ids[at][best], return_index=True)[1])[:k]]
            if len(best):
                yield a + i, order[at][best], score[best]


def shelved(c: Centroids, sizes: np.ndarray, shelf: int) -> tuple[np.ndarray, np.ndarray]:
    """The first shelf of each list and how many it has: near lists together up to ``shelf`` vectors, larger ones alone."""
    rest, order = [np.arange(len(c.points))], []
    while rest:  # halved along the widest axis again and again, so that neighbours in the order are near
        part = rest.pop()
        if len(part) <= 2:
            order += part.tolist()
            continue
        x = c.points[part]
        part = part[np.argsort(x[:, np.argmax(np.ptp(x, axis=0))], kind="stable")]
        rest += [part[len(part) // 2 :], part[: len(part) // 2]]
    first, parts, number, held = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64), 0, 0
    for j in order:
        n = int(sizes[j])
        if held and held + n > shelf:
            number, held = number + 1, 0
        first[j], parts[j] = number, max(1, -(-n // shelf))
        held += n
        if parts[j] > 1:
            number, held = number + int(parts[j]), 0
    return first, parts


def clean(embeddings: DataFrame) -> DataFrame:
    """vec_id, v (double) of the vectors that take part."""
    v = F.col("v")
    named = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    sound = named.where(F.col("vec_id").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0))
    length = sound.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return sound.where(F.size("v") == (length.d if length else 0))


def probed(vectors: DataFrame, c: Centroids, k: int) -> tuple[float, int]:
    """calibrated() from at most PROBES queries against all vectors; k rows of a probe from each partition meet."""
    drawn = vectors.orderBy(F.xxhash64("vec_id", F.lit("probe")), "vec_id").limit(PROBES).toPandas()
    own, queries = drawn["vec_id"].to_numpy(), np.array(drawn["v"].tolist())

    def exact(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = pd.DataFrame({"probe": pd.Series(dtype="int32"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64"), "v": pd.Series(dtype="object")})
        for f in frames:
            if len(f):
                ids, v = f["vec_id"].to_numpy(), f["v"]
                new = [pd.DataFrame({"probe": i, "vec_id": ids[rows], "score": score, "v": v.iloc[rows].to_numpy()}) for i, rows, score in best_of(queries, ids, np.array(v.tolist()), own, k)]
                best = pd.concat([best, *new]).sort_values(["probe", "score", "vec_id"], ascending=[True, False, True], kind="stable").drop_duplicates(["probe", "vec_id"]).groupby("probe").head(k)
        yield best

    order = Window.partitionBy("probe").orderBy(F.desc("score"), "vec_id")
    best = vectors.mapInPandas(exact, "probe int, vec_id long, score double, v array<double>")
    best = best.groupBy("probe", "vec_id").agg(F.max("score").alias("score"), F.max_by("v", F.struct("score", "v")).alias("v"))  # an id's rows stand in many blocks
    truth = best.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("probe", "v").toPandas()
    return calibrated(c, queries, truth["probe"].to_numpy(), np.array(truth["v"].tolist()))


def search(embeddings: DataFrame, k: int = K, every: int = EVERY, sample: int = SAMPLE, shelf: int = SHELF) -> DataFrame:
    """query_id, rank, vec_id, score: queries are the rows whose vec_id is divisible by ``every``."""
    spark = embeddings.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    vectors = written(clean(embeddings).dropDuplicates(["vec_id", "v"]), "ann-vectors")  # repeated rows add nothing
    asks = F.col("vec_id") % every == 0
    stats = vectors.agg(F.count("*").alias("n"), F.count_if(asks).alias("asked"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("norm2")).first()
    if not stats.n:
        return spark.createDataFrame([], out)
    drawn = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toPandas()
    model = spark.sparkContext.broadcast(fit(np.array(drawn["v"].tolist()), stats.n, stats.norm2))  # at most MOST_LISTS centroids
    ratio, width = probed(vectors, model.value, k)

    def index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                chosen = lists_of(np.array(f["v"].tolist()), model.value)
                yield f.assign(list=chosen).explode("list").astype({"list": "int32"})[["list", "vec_id", "v"]]

    postings = written(vectors.mapInPandas(index, "list int, vec_id long, v array<double>"), "ann-postings")
    listed = postings.groupBy("list", "vec_id").agg(F.count("*").alias("n")).withColumn("lists", F.count("*").over(Window.partitionBy("vec_id")))
    share = F.least(F.lit(1.0), F.lit(REPLICAS) / F.col("lists"))  # so that no set of lists counts a vec_id more than REPLICAS times
    per_list = listed.groupBy("list").agg(F.sum("n").alias("n"), F.sum(share).alias("ids")).collect()  # a row for each centroid
    counted, distinct = ({r.list: r[at] for r in per_list} for at in ("n", "ids"))
    n_lists = len(model.value.points)
    sizes = np.array([distinct.get(i, 0.0) for i in range(n_lists)])
    first, parts = shelved(model.value, np.array([counted.get(i, 0) for i in range(n_lists)]), shelf)

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            found = searched(np.array(f["v"].tolist()), model.value, sizes, k, ratio, width) if len(f) else []
            for vec_id, v, chosen in zip(f["vec_id"], f["v"], found):
                shelves: dict[int, list[int]] = {}
                for j in chosen:
                    for p in range(parts[j]):
                        shelves.setdefault(int(first[j]) + p, []).append(j)
                home = int(first[chosen[0]] + vec_id % parts[chosen[0]])
                rows += [(s, vec_id, v, lists, s == home) for s, lists in shelves.items()]
            if rows:
                yield pd.DataFrame(rows, columns=["shelf", "vec_id", "v", "lists", "home"])

    asked = vectors.where(asks).groupBy("vec_id").agg(F.min("v").alias("v")).repartition(max(1, -(-stats.asked // 256)), "vec_id")
    routed = written(asked.mapInPandas(route, "shelf long, vec_id long, v array<double>, lists array<int>, home boolean"), "ann-queries")
    places = spark.createDataFrame([(i, int(first[i]), int(parts[i])) for i in range(n_lists)], "list int, first long, parts int")  # a row for each centroid
    stocked = postings.join(F.broadcast(places), "list").select((F.col("first") + F.pmod(F.xxhash64("vec_id", "v"), F.col("parts"))).alias("shelf"), "list", "vec_id", "v")

    def meet(cands: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(cands) and len(queries):
            qid, ids = queries["vec_id"].to_numpy(), cands["vec_id"].to_numpy()
            names, local = np.unique(cands["list"].to_numpy(), return_inverse=True)
            may = np.array([np.isin(names, x) for x in queries["lists"]])[:, local]
            for i, at, scores in best_of(np.array(queries["v"].tolist()), ids, np.array(cands["v"].tolist()), qid, k, may, queries["least"].to_numpy(float)):
                rows.append(pd.DataFrame({"query_id": qid[i], "vec_id": ids[at], "score": scores}))
        return pd.concat(rows) if rows else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    def scored(queries: DataFrame) -> DataFrame:
        """query_id, vec_id, score. The queries of a shelf that many want are dealt, and its vectors stand with each share."""
        shares = queries.groupBy("shelf").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("shares"))
        left = stocked.join(shares, "shelf").withColumn("q", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
        right = queries.join(shares, "shelf").withColumn("q", F.pmod(F.xxhash64("vec_id"), F.col("shares")).cast("int")).drop("shares", "home")
        return left.groupBy("shelf", "q").cogroup(right.groupBy("shelf", "q")).applyInPandas(meet, "query_id long, vec_id long, score double")

    at_home = written(scored(routed.where("home").withColumn("least", F.lit(float("-inf")))), "ann-home")
    reached = at_home.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count("*") >= k, F.min("score")).otherwise(float("-inf")).alias("least"))
    elsewhere = routed.where("NOT home").join(reached, "vec_id", "left").fillna(float("-inf"), ["least"])
    once = at_home.unionByName(scored(elsewhere)).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
