"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A mask such as 11101011 reads the words under its ones and ignores the others. Hashes of the
masked words of test items and documents are joined; each hit lines a document up with an item.
Along that line the words themselves are compared: a document is contaminated if `window`
neighbouring words (or the whole item, if shorter) agree in `percent` per cent of their places.

The two masks for windows of 13 words together hit every one with two words substituted. Items under 13
words have masks of their own length: with m substitutions allowed, their places are dealt to m + 2
groups in turn, and each mask reads two groups, which some pair of groups always leaves whole. So nothing
that agrees is missed, whatever the item's length. Documents are hashed with the masks of those lengths
only that the items have. Other windows and percentages get masks made in the same way.

Words are lower-cased runs of letters, marks and digits. The test side is broadcast only if its counted
seeds are at most `max_broadcast`; above that the two sides are joined by a shuffle.

Defined results: null or empty texts are clean, and so is everything for items without words; each row is
judged by its own text, also where rows share a doc_id (null included); items that share an item_id are
all searched for, and repeated ones count once; a null item_id is an id; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed masks of weight 6 for windows of 13 words with 2 substitutions.
MASKS = ("11101011", "110100111")
WINDOW, PERCENT = 13, 80


def words_of(text: Column | str) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")


def masks_for(n: int, percent: int) -> list[list[int]]:
    """Places that each mask reads of n words, so that whatever substitutions `percent` allows, one mask reads none."""
    groups = n - -(-n * percent // 100) + 2
    if groups == 2 or groups > n:
        return [[*range(n)]] if groups == 2 else [[i] for i in range(n)]
    return [[i for i in range(n) if i % groups in two] for two in combinations(range(groups), 2)]


def seed_masks(lengths: list[int], window: int, percent: int) -> list[tuple[int, list[int]]]:
    """(length of the items, places): masks for items under `window` words of these lengths, and for all others (length `window`)."""
    out = [(n, at) for n in sorted(lengths) if n < window for at in masks_for(n, percent)]
    if any(n >= window for n in lengths):
        ready = [[i for i, bit in enumerate(m) if bit == "1"] for m in MASKS]
        out += [(window, at) for at in (ready if (window, percent) == (WINDOW, PERCENT) else masks_for(window, percent))]
    return out


def _seeds(hashes: str, n: Column, masks: list[tuple[int, list[int]]]) -> Column:
    """From the words' hashes, those of all masks at all places, mask by mask inside a place; null where a mask does not fit."""

    def at(i: Column) -> Column:
        return F.array(*[F.when(i + places[-1] < n, F.xxhash64(F.lit(k), *[F.get(hashes, i + o) for o in places])) for k, (_, places) in enumerate(masks)])

    return F.flatten(F.transform(hashes, lambda w, i: at(i)))


def find_overlaps(docs: DataFrame, items: DataFrame, window: int = WINDOW, percent: int = PERCENT, max_broadcast: int = 2_000_000) -> DataFrame:
    """doc_id, ver (a hash of the text), item_id, shift, n_matched: documents and items with a window that agrees."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    items = items.select("item_id", F.xxhash64("item_id", "text", F.col("item_id").isNull()).alias("item"), words_of("text").alias("item_words")).withColumn("item_n", F.size("item_words")).where("item_n > 0")
    # At most `window` rows: lengths from there on are one.
    lengths = [r[0] for r in items.select(F.least("item_n", F.lit(window))).distinct().collect()]
    hashed = lambda words: F.transform(words, lambda w: F.xxhash64(w))
    docs = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("ver"), words_of("text").alias("words")).withColumn("n", F.size("words"))
    masks = seed_masks(lengths, window, percent) or [(1, [0])]
    per = F.lit(len(masks))
    seeds = items.withColumn("hashes", hashed("item_words")).select("item", "item_n", F.posexplode(_seeds("hashes", F.col("item_n"), masks)).alias("i", "h")).withColumn("item_at", F.floor(F.col("i") / per).cast("int")).where("h is not null")
    mine = F.get(F.array(*[F.lit(n) for n, _ in masks]), F.pmod("i", per))
    seeds = seeds.where(F.when(F.col("item_n") < window, (mine == F.col("item_n")) & (F.col("item_at") == 0)).otherwise(mine == window)).select("h", "item", "item_n", "item_at").distinct()
    if seeds.count() <= max_broadcast:
        seeds = F.broadcast(seeds)
    # A column of its own, so that the explode is compiled and carries no copy of the hashes to each row; the outer
    # form, and no filter on n, as Spark would push a filter below these steps and run them all twice.
    places = docs.withColumn("hashes", hashed("words")).withColumn("all_seeds", _seeds("hashes", F.col("n"), masks)).select("doc_id", "ver", "words", "n", F.posexplode_outer("all_seeds").alias("i", "h"))
    hits = places.join(seeds, "h").withColumn("shift", F.floor(F.col("i") / per).cast("int") - F.col("item_at"))
    start = F.greatest("shift", F.lit(0))
    stop = F.least(F.col("n"), F.col("shift") + F.col("item_n"))
    lined = hits.select("doc_id", "ver", "item", "shift", F.slice("words", start + 1, stop - start).alias("part"))
    lined = lined.groupBy("doc_id", "ver", "item", "shift").agg(F.first("part").alias("part"))  # all parts of a group are equal
    both = lined.join(items, "item")
    own = F.slice("item_words", F.greatest(-F.col("shift"), F.lit(0)) + 1, F.size("part"))
    both = both.withColumn("same", F.zip_with("part", own, lambda a, b: F.when(a == b, 1).otherwise(0)))
    width = F.least(F.lit(window), F.col("item_n"))
    agree = lambda i: F.aggregate(F.slice("same", i + 1, width), F.lit(0), lambda s, x: s + x) * 100 >= width * percent
    both = both.where(F.size("same") >= width).where(F.exists(F.sequence(F.lit(0), F.size("same") - width), agree))
    return both.select("doc_id", "ver", "item_id", "shift", F.aggregate("same", F.lit(0), lambda s, x: s + x).alias("n_matched"))


def decontaminate(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """doc_id, contaminated, n_items, item_id and n_matched of the best match: a row for each row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # A struct counts as an id also where the id in it is null.
    found = find_overlaps(docs, items, **how).groupBy(F.col("doc_id").alias("found_id"), F.col("ver").alias("found_ver")).agg(F.count_distinct(F.struct("item_id")).alias("n_items"), F.max(F.struct("n_matched", "item_id")).alias("best"))
    ids = docs.select("doc_id", F.xxhash64("text").alias("ver"))
    return ids.join(found, ids["doc_id"].eqNullSafe(found["found_id"]) & (ids["ver"] == found["found_ver"]), "left").select(
        "doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.col("best.item_id").alias("item_id"), F.col("best.n_matched").cast("long").alias("n_matched")
    )
