"""Benchmark decontamination with DataFrame functions only: SimHash windows of item size, Hamming blocks, exact verification.

A text's words are runs of letters and digits, lower-cased; a shingle is five words. A window has as many words as a
benchmark item. Texts are looked at that have one of an item's rarest shingles: enough of these are taken that a window as
similar as asked holds one of them. Their windows of the item's size begin where that shingle would have the same place in
both, and at steps of a twelfth of the size where any item's shingles stand. Each such window and each item has PRINTS fingerprints of 64 bits over its distinct shingles, cut into blocks
of BLOCK bits, 60 in all: any two within 59 of the 600 bits agree in a block. At a similarity of 0.8 a bit differs with a
probability of 0.152, and all blocks with one of 3e-6. Windows and items of one size that share a block and differ in RADIUS
bits at most are candidates.

What fingerprints leave out has an exact way: a text that has one of an item's rarest shingles, and as many places with
shingles of items as a window must share, is a candidate although no window came near, so that no similar one is lost. An
item in which a shingle stands twice makes a candidate of every text that has one of its rarest shingles, for fingerprints
of distinct shingles say little of texts that repeat themselves.

For candidates, running counts over all starts give the window that is most similar by weighted Jaccard (sum of the smaller
over sum of the larger multiplicities of all shingles), exactly. Of equally similar windows one at which a shingle has the
same place in window and item goes first, then the earliest.

Defined results: null and empty texts and those under five words have no shingles and match nothing. Windows that would
begin before or end after the text are cut to it. Repeated rows of documents are matched alike and reported once a
doc_id; a null doc_id is reported as null. Items and texts may have up to 2**31 words. Repeated items are each reported. An
empty table gives no rows. Columns other than doc_id, item_id and text are ignored, and decontaminate() keeps them, whatever
their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framehouse.plans.lineage import written

WORDS, SIMILARITY = 5, 0.8
PRINTS, BLOCK, BITS, RADIUS, STEPS = 10, 10, 60, 160, 12
#: Bytes of a table that goes to every executor.
BROADCAST = 8 << 20


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def shingles_of(words: Column) -> Column:
    """Hashes of five words in a row, by position from 0; an empty array under five words.

    The words are hashed once and bound as a lambda variable: named within the inner lambda, they would be worked out
    again for every position.
    """
    hashed = F.transform(words, lambda x: F.xxhash64(x))
    run = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (WORDS - 1)), lambda i: F.xxhash64(*[F.element_at(w, i + k) for k in range(WORDS)]))
    none = F.array().cast("array<long>")
    return F.element_at(F.transform(F.array(hashed), lambda w: F.when(F.size(w) >= WORDS, run(w)).otherwise(none)), 1)


def fingerprint(shingle: Column) -> Column:
    """An aggregate: each bit is set if at least half of the shingles have it. Two 32-bit counters share a long."""
    spread = 0x0000000100000001
    sums = [F.sum(F.shiftrightunsigned(shingle, b).bitwiseAND(F.lit(spread))) for b in range(32)]
    n = F.count("*")
    bit = lambda b, lane: F.when(F.shiftrightunsigned(sums[b], 32 * lane).bitwiseAND(F.lit(0xFFFFFFFF)) * 2 >= n, F.lit(1 << (b + 32 * lane) if b + 32 * lane < 63 else -(1 << 63))).otherwise(F.lit(0))
    return reduce(lambda x, y: x.bitwiseOR(y), [bit(b, lane) for b in range(32) for lane in range(2)])


def fingerprints(windows: DataFrame, key: list[str]) -> DataFrame:
    """key, fps (PRINTS fingerprints) of windows (key, shingles): one hash of each distinct shingle for each fingerprint."""
    each = windows.select(*key, F.explode(F.array_distinct("shingles")).alias("shingle")).select(*key, "shingle", F.explode(F.array(*map(F.lit, range(PRINTS)))).alias("k"))
    one = each.groupBy(*key, "k").agg(fingerprint(F.xxhash64("shingle", "k")).alias("fp"))
    return one.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "fp"))), lambda x: x.fp).alias("fps"))


def blocks(fps: Column) -> Column:
    """array<struct<block, bits>>: BITS of each fingerprint in blocks of BLOCK bits."""
    each = [F.struct(F.lit(k * BITS + a).alias("block"), F.shiftrightunsigned(F.get(fps, F.lit(k)), a).bitwiseAND(F.lit((1 << BLOCK) - 1)).alias("bits")) for k in range(PRINTS) for a in range(0, BITS, BLOCK)]
    return F.array(*each)


def hamming(x: Column, y: Column) -> Column:
    low = F.lit((1 << BITS) - 1)
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b).bitwiseAND(low))), F.lit(0), lambda s, n: s + n)


def items_of(benchmark: DataFrame) -> DataFrame:
    """item, item_id, n (shingles), sh (their hashes) of items of five words or more; item tells repeated ids apart."""
    named = benchmark.select(F.col("item_id").cast("long").alias("item_id"), shingles_of(words_of(F.col("text"))).alias("sh"))
    return named.withColumn("item", F.xxhash64("item_id", "sh")).dropDuplicates(["item"]).where(F.size("sh") > 0).select("item", "item_id", F.size("sh").alias("n"), "sh")


def best_windows(hits: DataFrame, similarity: float) -> DataFrame:
    """doc, item, from, to, similarity: the most similar item-sized window of each text and item, where it is similar enough.

    hits has a row for each place ``at`` of a text (of ``total`` shingles) and item that have its shingle in common;
    ``ic`` is how often the item has it, at ``places``. A window holds as much in common with the item as it has places
    with fewer than ic further ones of the same shingle before them in the window: each place counts for one range of
    starts, from just after the ic-th place before it (at - n + 1 at least) to itself. The ranges' ends, summed up in
    order, are the common count of every start; between two ends it stays, and the shortest window is at either end.
    """
    pair = ["doc", "item"]
    held = hits.groupBy(*pair, "shingle", "total", "n", "ic", "places").agg(F.sort_array(F.collect_set("at")).alias("ats"))
    # A similarity needs that share of the item's shingles in common, so pairs with fewer in the whole text end here.
    enough = held.groupBy(*pair, "total", "n").agg(F.sum(F.least(F.size("ats"), F.col("ic"))).alias("most"), F.collect_list(F.struct("ats", "ic", "places")).alias("x"))
    one = enough.where(F.col("most") >= F.lit(similarity) * F.col("n") - 1e-9).select(*pair, "total", "n", F.explode("x").alias("x")).select(*pair, "total", "n", "x.*")
    end = lambda at, change, aligned: F.struct(at.cast("int").alias("at"), F.lit(change).alias("change"), F.lit(aligned).alias("aligned"))
    first = lambda p, k: F.greatest(p - F.col("n") + 1, F.when(k >= F.col("ic"), F.get(F.col("ats"), (k - F.col("ic")).cast("int")) + 1))
    ends = F.concat(
        F.transform("ats", lambda p, k: end(first(p, k), 1, 0)),
        F.transform("ats", lambda p: end(p + 1, -1, 0)),
        F.flatten(F.transform("ats", lambda p: F.transform("places", lambda i: end(p - i, 0, 1)))))
    steps = one.select(*pair, "total", "n", F.explode(ends).alias("e")).groupBy(*pair, "total", "n", F.col("e.at").alias("at")).agg(F.sum("e.change").alias("change"), F.max("e.aligned").alias("aligned"))
    order = Window.partitionBy(*pair).orderBy("at")
    counts = steps.withColumns({"common": F.sum("change").over(order), "next": F.lead("at").over(order)}).where(F.col("common") > 0)
    start = lambda at, aligned: F.struct(at.alias("at"), aligned.alias("aligned"))
    tried = counts.withColumn("s", F.explode(F.array(start(F.col("at"), F.col("aligned")), start(F.col("next") - 1, F.when(F.col("next") - 1 == F.col("at"), F.col("aligned")).otherwise(0)))))
    cut = tried.select(*pair, "n", "common", "s.aligned", F.greatest("s.at", F.lit(0)).alias("from"), F.least(F.col("s.at") + F.col("n"), F.col("total")).alias("to"))
    judged = cut.withColumn("similarity", F.col("common") / (F.col("to") - F.col("from") + F.col("n") - F.col("common"))).where(F.col("similarity") >= similarity)
    best = judged.groupBy(*pair).agg(F.max_by(F.struct("from", "to", "similarity"), F.struct("similarity", "aligned", -F.col("from"), -F.col("to"))).alias("b"))
    return best.select(*pair, "b.from", "b.to", "b.similarity")


def row_key() -> Column:
    """A hash of doc_id and text, as leaked rows are told apart: repeated rows have one key, a repeated or null doc_id has one a text."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def rarest(item_counts: DataFrame, spots: DataFrame, similarity: float) -> DataFrame:
    """item_counts without what an item has most often in common with texts: what stays is in every window similar enough.

    A window has at least similarity x n of the item's n shingles, so it can't do with those left out, which are fewer.
    """
    often = spots.groupBy("shingle").agg(F.count("*").alias("often"))
    known = item_counts.join(often, "shingle")
    # What no text has at all comes before all others, unseen.
    unseen = item_counts.groupBy("item", "n").agg(F.sum("ic").alias("all")).join(known.groupBy("item").agg(F.sum("ic").alias("seen")), "item").select("item", (F.col("all") - F.col("seen")).alias("unseen"))
    order = Window.partitionBy("item").orderBy("often", "shingle").rowsBetween(Window.unboundedPreceding, -1)
    placed = known.join(unseen, "item").withColumn("before", F.coalesce(F.sum("ic").over(order), F.lit(0)) + F.col("unseen"))
    return placed.where(F.col("before") <= F.col("n") - F.ceil(F.lit(similarity) * F.col("n") - 1e-9)).select("item", "n", "even", "shingle", "ic", "places")


def leaked_windows(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, broadcast_bytes: int = BROADCAST) -> DataFrame:
    """doc (the row_key), doc_id, item_id, from, to, similarity: the most similar window of each text and item, if similar enough."""
    items = written(items_of(benchmark), "leak-items").withColumn("even", F.size(F.array_distinct("sh")) == F.col("n"))
    held = items.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    sized = F.broadcast if 64 * held[0] <= broadcast_bytes else (lambda df: df)
    sized_prints = F.broadcast if held[1] * (PRINTS * (BITS // BLOCK) * 160) <= broadcast_bytes else (lambda df: df)
    where = items.select("item", "n", "even", F.posexplode("sh").alias("i", "shingle"))
    item_counts = written(where.groupBy("item", "n", "even", "shingle").agg(F.count("*").cast("int").alias("ic"), F.sort_array(F.collect_list("i")).alias("places")), "leak-item-shingles")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = texts.withColumn("doc", row_key())
    shingled = lambda df: df.select("doc", "doc_id", shingles_of(words_of(F.col("text"))).alias("sh")).where(F.size("sh") > 0)
    # Positions of item shingles: everything else of the corpus ends here. A shingle of many items is one row all the same.
    each = shingled(keyed).select("doc", "doc_id", F.size("sh").alias("total"), F.posexplode("sh").alias("at", "shingle"))
    spots = written(each.join(sized(item_counts.select("shingle").distinct()), "shingle", "left_semi"), "leak-spots")
    # Written once: three passes read it.
    rare = written(rarest(item_counts, spots, similarity), "leak-rare")
    met = spots.select("doc", "total", "at", "shingle").join(sized(rare), "shingle")
    repeated = met.where("NOT even").select("doc", "item").distinct()
    aligned = met.where("even").select("doc", "total", "n", F.explode(F.transform("places", lambda i: F.col("at") - i)).alias("f"))
    # A most similar window can begin at an item's shingle; of neighbouring starts one is enough to find the candidate.
    sizes = met.where("even").select("doc", "n").distinct()
    light = spots.select("doc", "total", "at")
    enough = light.join(sizes, "doc").groupBy("doc", "n").agg(F.count("*").alias("common")).where(F.col("common") >= F.lit(similarity) * F.col("n") - 1e-9).select("doc", "n")
    step = F.greatest(F.lit(1), F.floor(F.col("n") / STEPS).cast("int"))
    starts = light.join(enough, "doc").select("doc", "total", "n", (F.col("at") - F.col("at") % step).alias("f"))
    windows = written(aligned.unionByName(starts).select("doc", "n", F.greatest("f", F.lit(0)).alias("from"), F.least(F.col("f") + F.col("n"), "total").alias("to")).distinct(), "leak-windows")
    # Windows come from the texts again, for their other shingles need not be an item's.
    wanted = windows.groupBy("doc").agg(F.collect_set(F.struct("n", "from", "to")).alias("windows"))
    ids = windows.select("doc").distinct()
    few = ids.count() * 16 <= broadcast_bytes
    whole = shingled(keyed.join(F.broadcast(ids) if few else ids, "doc", "left_semi").dropDuplicates(["doc"])).join(wanted, "doc")
    cut = whole.select("doc", "sh", F.explode("windows").alias("x")).select("doc", "x.n", "x.from", "x.to", F.slice("sh", F.col("x.from") + 1, F.col("x.to") - F.col("x.from")).alias("shingles"))
    block_of = lambda df: df.withColumn("b", F.explode(blocks(F.col("fps")))).select("*", "b.block", "b.bits").drop("b")
    prints = fingerprints(cut, ["doc", "n", "from", "to"])
    item_prints = fingerprints(items.where("even").select("item", "n", F.col("sh").alias("shingles")), ["item", "n"]).withColumnRenamed("fps", "item_fps")
    found = block_of(prints).join(sized_prints(block_of(item_prints.withColumnRenamed("item_fps", "fps")).withColumnRenamed("fps", "item_fps")), ["n", "block", "bits"])
    near = written(found.where(hamming(F.col("fps"), F.col("item_fps")) <= radius).select("doc", "item").distinct(), "leak-near")
    # Fingerprints miss a similar window now and then: pairs with a rare shingle and places enough are the rest, judged exactly.
    rest = met.where("even").select("doc", "item", "n").distinct().join(enough, ["doc", "n"], "left_semi").select("doc", "item").join(near, ["doc", "item"], "left_anti")
    pairs = written(near.unionByName(rest).unionByName(repeated), "leak-pairs")
    # Exact weighted similarity, over all starts.
    hits = spots.select("doc", "total", "at", "shingle").join(pairs.select("doc").distinct(), "doc", "left_semi").join(sized(item_counts.drop("even")), "shingle").join(pairs, ["doc", "item"], "left_semi")
    best = best_windows(hits, similarity)
    names = spots.select("doc", "doc_id").distinct()
    return best.join(names, "doc").join(sized(items.select("item", "item_id")), "item").select("doc", "doc_id", "item_id", "from", "to", "similarity")


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, broadcast_bytes: int = BROADCAST) -> DataFrame:
    """doc_id, item_id, start (word, from 0), n_words, similarity: the most similar window of each leaked item."""
    best = leaked_windows(docs, benchmark, similarity, radius, broadcast_bytes)
    found = best.groupBy("doc_id", "item_id").agg(F.max_by(F.struct(F.col("from").alias("start"), (F.col("to") - F.col("from") + WORDS - 1).alias("n_words"), "similarity"), F.struct("similarity", -F.col("from"), -F.col("to"))).alias("b"))
    return found.select("doc_id", "item_id", "b.start", "b.n_words", "b.similarity")


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs, whole, without those of which the text has a leaked item; other texts of the same doc_id, null or not, stay."""
    leaked = leaked_windows(docs, benchmark, similarity).select("doc").distinct()
    # The caller's row is one struct, so its columns may have any names.
    keyed = docs.select(row_key().alias("doc"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return keyed.join(leaked, "doc", "left_anti").select("row.*")
