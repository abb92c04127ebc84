"""Similar photos: pairs, clusters of pairs, the best of each cluster and what is to be said about it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framehouse.functions import media, scores
from framehouse.operators import graph, runs
from framehouse.plans.lineage import written

BURST_SECONDS = 10


@dataclass(frozen=True)
class Thresholds:
    distance: float = 0.35
    hamming: int = 10
    window: int | None = 30  # seconds between the two of a pair; None: any, dated or not


PRESETS = {"strict": Thresholds(0.20, 6), "balanced": Thresholds(), "loose": Thresholds(0.55, 16)}


#: Photos in a stretch of time and the one before, above which dhash blocks part them too.
CROWD = 1000


def dhash_blocks(dhash: Column, hamming: int) -> list[Column]:
    """hamming + 1 blocks of bits: two hashes within that many bits agree in one of them."""
    edges = [64 * k // (hamming + 1) for k in range(hamming + 2)]
    return [F.shiftrightunsigned(dhash, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(edges, edges[1:])]


def blocked(rows: DataFrame, hamming: int) -> DataFrame:
    """rows with block, a row for each block of the dhash; a row that isn't crowded has but one, which all such share."""
    each = F.array(*[F.struct(F.lit(k).alias("k"), bits.alias("bits")) for k, bits in enumerate(dhash_blocks(F.col("dhash"), hamming))])
    one = F.array(F.struct(F.lit(-1).alias("k"), F.lit(0).cast("long").alias("bits")))
    return rows.withColumn("block", F.explode(F.when(F.col("crowded"), each).otherwise(one))).drop("crowded")


def pairs(candidates: DataFrame, th: Thresholds = PRESETS["balanced"], distance: Callable[[Column, Column], Column] = scores.distance) -> DataFrame:
    """a, b, t_delta, hamming, distance of all pairs of (path, t, dhash, print) within the thresholds, a before b.

    With a window, a pair's times are in the same stretch of that length or in neighbours, so stretches are joined with
    themselves and the next; a stretch that a burst or an import crowds is joined by the blocks of dhashes as well. Without
    one, dhashes within k bits agree in one of k + 1 blocks, and blocks are joined. Vectors follow by path only after the
    cheap tests, so they aren't shuffled for pairs that fail them. ``distance`` may be another expression on two vectors.
    """
    light = candidates.where("dhash IS NOT NULL AND print IS NOT NULL").select("path", "t", "dhash")
    side = lambda df, s: df.select(*[F.col(c).alias(f"{c}_{s}") for c in ("path", "t", "dhash")], *[c for c in df.columns if c not in ("path", "t", "dhash")])
    if th.window is not None:
        at = F.floor(F.col("t") / th.window)
        dated = light.where("t IS NOT NULL")
        left, right = dated.withColumn("stretch", F.explode(F.array(at, at + 1))), dated.withColumn("stretch", at)
        crowds = left.groupBy("stretch").agg(F.count("*").alias("__n")).where(F.col("__n") > CROWD).select("stretch", F.lit(True).alias("crowded"))
        if crowds.head(1):
            left, right = (df.join(crowds, "stretch", "left").withColumn("crowded", F.coalesce("crowded", F.lit(False))) for df in (left, right))
            met = side(blocked(left, th.hamming), "x").join(side(blocked(right, th.hamming), "y"), ["stretch", "block"])
            same_bits = zip(dhash_blocks(F.col("dhash_x"), th.hamming), dhash_blocks(F.col("dhash_y"), th.hamming))
            first = F.coalesce(*[F.when(x == y, k) for k, (x, y) in enumerate(same_bits)])  # a pair counts in the first block it shares
            met = met.where((F.col("block.k") == -1) | (F.col("block.k") == first)).drop("block")
        else:
            met = side(left, "x").join(side(right, "y"), "stretch")
        # Of two in the same stretch each meets the other; of neighbours only the earlier meets the later.
        same = F.floor(F.col("t_x") / th.window) == F.col("stretch")
        met = met.where((~same | (F.struct("t_x", "path_x") < F.struct("t_y", "path_y"))) & (F.abs(F.col("t_x") - F.col("t_y")) <= th.window))
    else:
        all_blocked = blocked(light.withColumn("crowded", F.lit(True)), th.hamming)
        met = side(all_blocked, "x").join(side(all_blocked, "y"), "block").where("path_x < path_y").drop("block").distinct()
    near = met.withColumn("hamming", scores.hamming(F.col("dhash_x"), F.col("dhash_y"))).where(F.col("hamming") <= th.hamming)
    prints = candidates.select("path", "print")
    whole = near.join(prints.select(F.col("path").alias("path_x"), F.col("print").alias("print_x")), "path_x").join(prints.select(F.col("path").alias("path_y"), F.col("print").alias("print_y")), "path_y")
    far = whole.withColumn("distance", distance(F.col("print_x"), F.col("print_y"))).where(F.col("distance") <= th.distance)
    return far.select(F.least("path_x", "path_y").alias("a"), F.greatest("path_x", "path_y").alias("b"), F.abs(F.col("t_x") - F.col("t_y")).alias("t_delta"), "hamming", "distance")


def without_copies(candidates: DataFrame, th: Thresholds = PRESETS["balanced"]) -> tuple[DataFrame, DataFrame]:
    """Of photos of one time, dhash and print the one with the smallest path, with copies (their number); and path, of (that one).

    Equal photos are near the same others, so pairs of the ones that stay tell all. Those that can't be paired are left out.
    """
    known = candidates.where("dhash IS NOT NULL AND print IS NOT NULL" + (" AND t IS NOT NULL" if th.window is not None else ""))
    each = known.withColumn("__same", F.xxhash64("print")).groupBy("t", "dhash", "__same", "print").agg(F.min("path").alias("path"), F.count("*").alias("copies"))
    one = each.select("path", "t", "dhash", "print", "copies")
    several = each.where("copies > 1").select(F.col("path").alias("of"), F.col("t").alias("__t"), F.col("dhash").alias("__d"), F.col("print").alias("__p"))
    same = F.col("t").eqNullSafe(F.col("__t")) & (F.col("dhash") == F.col("__d")) & (F.col("print") == F.col("__p"))
    return one, known.select("path", "t", "dhash", "print").join(several, same).select("path", "of")


def class_pairs(candidates: DataFrame, th: Thresholds = PRESETS["balanced"], distance: Callable[[Column, Column], Column] = scores.distance) -> tuple[DataFrame, DataFrame]:
    """pairs() between photos that differ, and within equal ones (a = b), with weight: how many pairs of photos each stands for;
    and path, of of the photos that have equals. n equal photos make a row, not n x n / 2."""
    one, copies = without_copies(candidates, th)
    one, copies = written(one, "photo-classes"), written(copies, "photo-copies")
    n = one.select("path", "copies")
    between = pairs(one, th, distance).join(n.select(F.col("path").alias("a"), F.col("copies").alias("na")), "a").join(n.select(F.col("path").alias("b"), F.col("copies").alias("nb")), "b")
    # Of equal ones any two count as in order; a and b name the smallest of each class.
    within = one.where("copies > 1").select(F.col("path").alias("a"), F.col("path").alias("b"), F.when(F.col("t").isNotNull(), F.lit(0).cast("long")).alias("t_delta"), F.lit(0).alias("hamming"), F.lit(0.0).alias("distance"), F.expr("copies * (copies - 1) div 2").alias("weight"))
    columns = ["a", "b", "t_delta", "hamming", "distance", "weight"]
    return between.withColumn("weight", F.col("na") * F.col("nb")).select(columns).unionByName(within.select(columns)), copies


def clusters(edges: DataFrame, copies: DataFrame | None = None) -> DataFrame:
    """path, cluster (its smallest path) of all paths with an edge, or equal to one (copies: path, of)."""
    links = edges.select("a", "b")
    if copies is not None:
        links = links.unionByName(copies.select(F.col("path").alias("a"), F.col("of").alias("b")))
    return graph.components(links).select(F.col("node").alias("path"), F.col("label").alias("cluster"))


def primaries(candidates: DataFrame) -> DataFrame:
    """The candidates that stand for their pair: those without a partner, and of two the one whose path sorts first."""
    return candidates.where("paired_path IS NULL OR path < paired_path")


def with_partners(members: DataFrame, candidates: DataFrame) -> DataFrame:
    """members (path, cluster) as whole candidates, and the partner of each that is a candidate itself."""
    whole = candidates.join(members, "path")
    partner = whole.where("paired_path IS NOT NULL").select(F.col("paired_path").alias("path"), "cluster")
    return whole.unionByName(candidates.join(partner, "path"))


def all_clusters(near: DataFrame, exact: DataFrame) -> DataFrame:
    """path, cluster, kind of exact clusters and of near ones (path, cluster, kind) that aren't wholly within exact ones."""
    kept = without_superseded(near, exact)
    return exact.select("path", F.concat(F.lit("exact:"), "cluster").alias("cluster"), F.lit("exactDuplicate").alias("kind")).unionByName(kept.select("path", F.concat(F.lit("near:"), "cluster").alias("cluster"), "kind"))


def cluster_order(members: DataFrame) -> DataFrame:
    """members (cluster, kind, path, t) with cluster_no and member_no: exact clusters first, by path; others by their first
    date, members by date, undated first. Both are numbered by ranges, so that neither all clusters nor a large one meet in a task."""
    first = members.groupBy("cluster").agg(F.min((F.col("kind") != "exactDuplicate").cast("int")).alias("later"), F.min(F.coalesce("t", F.lit(-(1 << 62)).cast("long"))).alias("t0"), F.min("path").alias("p0"))
    placed = first.select("cluster", "later", F.when(F.col("later") == 0, F.lit(0).cast("long")).otherwise(F.col("t0")).alias("place"), "p0", F.lit(0).alias("g"))
    numbers = runs.numbered(placed, ["g"], ["later", "place", "p0", "cluster"]).select("cluster", F.col("__n").alias("cluster_no"))
    time = F.when(F.col("kind") == "exactDuplicate", F.lit(None)).otherwise(F.col("t"))
    keyed = members.withColumns({"__dated": time.isNotNull(), "__time": F.coalesce(time, F.lit(0).cast("long"))})
    return runs.numbered(keyed, ["cluster"], ["__dated", "__time", "path"]).withColumnRenamed("__n", "member_no").drop("__dated", "__time", "__all").join(numbers, "cluster")


def confidence(kind: Column, n_warnings: Column, distance: Column, span: Column) -> Column:
    """low with any warning, high for exact copies, then by mean distance (1 if unknown) and seconds between the members."""
    far = F.coalesce(distance, F.lit(1.0))
    return F.when((n_warnings > 0) & (kind != "exactDuplicate"), "low").when(kind == "exactDuplicate", "high").when((far < 0.10) & (span < 5), "high").when((kind == "editedVariant") | (far > 0.30), "low").otherwise("medium")


def exact_clusters(files: DataFrame) -> DataFrame:
    """path, cluster, n of the files whose identity others share."""
    groups = files.where("identity IS NOT NULL").groupBy("identity").agg(F.count("*").alias("n"), F.min("path").alias("cluster")).where("n > 1")
    return files.select("path", "identity").join(groups, "identity").select("path", "cluster", "n")


def preference() -> list[Column]:
    area = F.coalesce("pixel_width", F.lit(0)).cast("long") * F.coalesce("pixel_height", F.lit(0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return [-F.col("quality"), -F.col("sharpness"), -F.col("size"), -area, -zero("face"), -zero("eyes"), -zero("smile"), ~F.col("is_raw"), F.col("path")]


def keepers(members: DataFrame) -> DataFrame:
    """cluster, keeper: the preferred member of each, by an aggregation that meets before the shuffle."""
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(preference())])
    return members.groupBy("cluster").agg(F.min_by("path", key).alias("keeper"))


def ranked(members: DataFrame) -> DataFrame:
    return members.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy(*preference())))


def runners_up(members: DataFrame) -> DataFrame:
    """cluster, keeper, runner_up, factors: what the keeper has before the best by quality of the others but its partner."""
    chosen = members.join(keepers(members), "cluster")
    both = F.struct("path", "quality", "sharpness", "size", "face", "eyes", "smile", "is_raw", (F.col("pixel_width").cast("long") * F.col("pixel_height")).alias("area"))
    is_keeper, partner = F.col("path") == F.col("keeper"), F.coalesce(F.col("paired_path") == F.col("keeper"), F.lit(False))
    met = chosen.groupBy("cluster", "keeper").agg(F.max(F.when(is_keeper, both)).alias("k"), F.max_by(F.when(~is_keeper & ~partner, both), F.when(~is_keeper & ~partner, F.struct("quality", "path"))).alias("r")).where("r IS NOT NULL")
    k, r = (lambda c: F.col(f"k.{c}")), (lambda c: F.col(f"r.{c}"))
    more = lambda c, least: F.when(k(c) - r(c) > least, c)
    factors = F.array_compact(F.array(more("quality", 0.01), more("sharpness", 0.05), more("face", 0.05), F.when((k("eyes") > 0.7) & (r("eyes") < 0.5), "eyes"), more("smile", 0.15), F.when((r("area") > 0) & (k("area") / r("area") > 1.1), "resolution"), more("size", 100_000), F.when(k("is_raw") & ~r("is_raw"), "raw")))
    return met.select("cluster", "keeper", F.col("r.path").alias("runner_up"), factors.alias("factors"))


def annotated(members: DataFrame, edges: DataFrame) -> DataFrame:
    """cluster, n, kind, span, avg_distance, min_distance, avg_hamming, warnings, confidence, prunable_bytes.

    Two members differ in framing if the largest ratio of their aspects is above 1.1, which the extremes tell; where fewer
    than two aspects are known, areas aren't compared either.
    """
    w, h = F.col("pixel_width"), F.col("pixel_height")
    aspect, area = F.when((w > 0) & (h > 0), w / h), F.when(w.isNotNull() & h.isNotNull(), w.cast("long") * h)
    faces = F.when(F.col("face") > 0.8, 2).when(F.col("face") > 0.3, 1).when(F.col("face").isNotNull(), 0)
    spread = lambda c, name: [F.min(c).alias(f"{name}0"), F.max(c).alias(f"{name}1")]
    kept = keepers(members)
    whole = members.join(kept, "cluster").groupBy("cluster").agg(F.count("*").alias("n"), *spread("t", "t"), *spread(aspect, "aspect"), F.count(aspect).alias("aspects"), *spread(area, "area"), *spread(faces, "faces"), *spread("sharpness", "sharp"), F.sum(F.when(F.col("path") != F.col("keeper"), F.col("size")).otherwise(0)).alias("prunable_bytes"))
    owner = members.select(F.col("path").alias("a"), "cluster")
    weighted = edges if "weight" in edges.columns else edges.withColumn("weight", F.lit(1).cast("long"))
    reason = weighted.join(owner, "a").groupBy("cluster").agg((F.sum(F.col("distance") * F.col("weight")) / F.sum("weight")).alias("avg_distance"), F.min("distance").alias("min_distance"), F.expr("sum(hamming * weight) div sum(weight)").alias("avg_hamming"), F.max("t_delta").alias("most_delta"))
    joined = whole.join(reason, "cluster", "left").withColumn("span", F.coalesce(F.col("t1") - F.col("t0"), F.col("most_delta")))
    kind = F.when(F.col("t1") - F.col("t0") <= BURST_SECONDS, "burst").otherwise("nearDuplicate")
    told = joined.withColumn("kind", kind)
    warnings = F.array_compact(F.array(
        F.when(F.col("faces1") - F.col("faces0") >= 1, "differentPeople"),
        F.when((F.col("aspects") >= 2) & ((F.col("aspect1") / F.greatest("aspect0", F.lit(0.001)) > 1.10) | ((F.col("area0") > 0) & (F.col("area1") / F.col("area0") > 2.0))), "differentFraming"),
        F.when((F.col("kind") == "nearDuplicate") & (F.col("t1") - F.col("t0") > 300), "largeTimeGap"),
        F.when((F.col("sharp0") > 0.01) & (F.col("sharp1") / F.col("sharp0") > 2.5), "exposure"),
    ))
    return told.withColumn("warnings", warnings).withColumn("confidence", confidence(F.col("kind"), F.size("warnings"), F.col("avg_distance"), F.col("span"))).select("cluster", "n", "kind", "span", "avg_distance", "min_distance", "avg_hamming", "warnings", "confidence", "prunable_bytes")


def without_superseded(near: DataFrame, exact: DataFrame) -> DataFrame:
    """near (path, cluster) without the clusters all of whose members are in exact clusters."""
    held = exact.select("path").distinct().withColumn("__in", F.lit(True))
    gone = near.join(held, "path", "left").groupBy("cluster").agg(F.min(F.coalesce("__in", F.lit(False))).alias("all_in")).where("all_in").select("cluster")
    return near.join(gone, "cluster", "left_anti")


def raw_pairs(files: DataFrame) -> DataFrame:
    """raw, photo: same directory and name but for the extension; of several the last in the order of discovery."""
    ext = media.extension(F.col("path"))
    side = F.when(media.is_raw(F.col("path")), "raw").when(ext.isin(".jpg", ".jpeg", ".heic"), "photo")
    sided = files.select("path", "ordinal", media.stem(F.col("path")).alias("base"), side.alias("side")).where("side IS NOT NULL")
    last = lambda s: F.max_by(F.when(F.col("side") == s, F.col("path")), F.when(F.col("side") == s, F.col("ordinal"))).alias(s)
    return sided.groupBy("base").agg(last("raw"), last("photo")).where("raw IS NOT NULL AND photo IS NOT NULL").select("raw", "photo")


def live_pairs(files: DataFrame) -> DataFrame:
    """photo, movie of one directory and content identifier: a HEIC and a movie; of several movies the last."""
    known = files.where("content_id IS NOT NULL").withColumns({"dir": media.parent(F.col("path")), "ext": media.extension(F.col("path"))})
    movies = known.where(F.col("ext").isin(".mov", ".m4v")).groupBy("dir", "content_id").agg(F.max_by("path", "ordinal").alias("movie"))
    return known.where(F.col("ext") == ".heic").join(movies, ["dir", "content_id"]).select(F.col("path").alias("photo"), "movie")


def pair_table(files: DataFrame) -> DataFrame:
    """path, partner, kind (livePhoto or rawJpeg) over (ordinal, path, content_id): a path has one pair, as a live photo if it is one.

    Of several photos with one movie the last is the movie's partner. A RAW whose photo is the half of a live one still
    names that photo.
    """
    both = lambda df, a, b, kind, rank: df.select(F.explode(F.array(F.struct(F.col(a).alias("path"), F.col(b).alias("partner")), F.struct(F.col(b).alias("path"), F.col(a).alias("partner")))).alias("p")).select("p.*", F.lit(kind).alias("kind"), F.lit(rank).alias("rank"))
    every = both(live_pairs(files), "photo", "movie", "livePhoto", 1).unionByName(both(raw_pairs(files), "raw", "photo", "rawJpeg", 0))
    told = every.join(files.select(F.col("path").alias("partner"), "ordinal"), "partner")
    return told.groupBy("path").agg(F.max_by(F.struct("partner", "kind"), F.struct("rank", "ordinal")).alias("p")).select("path", "p.partner", "p.kind")
