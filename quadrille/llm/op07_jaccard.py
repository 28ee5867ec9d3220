"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

The columns are shingles, and a row is a set of them; copies (equal sets) are one row. Rows are kept cut
into `BLOCKS` blocks of columns. The product is formed in two steps:

1. Over the rare columns. A pair can reach the threshold only if it shares a column among the first
   `n - ceil(t n) + 1` of each row under one global order of columns, rare ones first (from a fixed-size
   count sketch over all shingles). Only that part of the matrix is multiplied here. Overlaps are
   counted pair by pair, and pairs are discarded whose sizes, or whose count and what is
   left of either row behind the last shared column, rule the threshold out.
2. Over all columns. The sizes of `BINS` narrow blocks bound an overlap from above (the sum of the smaller
   ones), which discards most pairs without their rows. The others are multiplied block by block: the matrix
   is stored by row and wide block, each pair meets its two parts of a block, and the partial counts are added up by pair.

In a long column, pairs within one group are not all multiplied: each row meets one pivot, linked rows
become one component, and only pairs between different components are left for the next pass. The
result is exact. Long columns, sets that many rows have, and components of many rows are dealt out to many tasks.

Defined results: null, empty or wordless texts have no shingles and no links; a null doc_id takes
part in nothing and gets a null component_id; rows that share a doc_id are one node with several
sets, so they share its component; repeated rows are copies; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quadrille.llm import common as c
from quadrille.llm.graph import components

#: Counters of the sketch: 4 MB in all, whatever the input.
SKETCH_BITS = 20
SKETCH_BLOCK = 4096
#: Columns of up to this many rows are multiplied in full at once.
SHORT = 16
#: Passes with pivots at most before the rest is multiplied in full.
PIVOT_PASSES = 6
#: Narrow blocks of columns, whose sizes bound an overlap, and wide ones, over which it is added up; both are powers of 2.
BINS, BLOCKS = 256, 8
#: Shingles of a row that is bounded by the sizes of its narrow blocks; they must fit in 16 bits.
MOST_BINNED = 1 << 15


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text its distinct shingle hashes, sorted."""
    off, words = c.split_words(texts, lower=True)
    codes, distinct = c.word_codes(words)
    h = c.word_hashes(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    grams = c.gram_hashes(h, k)
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        n = b - a
        if n >= k:
            yield np.unique(grams[a : b - k + 1])
        elif n:
            yield c.gram_hashes(h[a:b], n)[:1]
        else:
            yield np.zeros(0, np.uint64)


def _digest(u: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    with np.errstate(over="ignore"):
        two = np.array([np.add.reduce(c.mix(u, 1)), np.bitwise_xor.reduce(c.mix(u, 2)) if len(u) else 0], np.uint64)
    return tuple(two.view(np.int64).tolist())


_FIRST = "doc_id long, n long, d1 long, d2 long, block int, counts binary"


def _digests(k: int):
    """Rows of documents, and as each task's last rows its part of the count sketch."""

    def run(batches):
        sketch, seen, names = np.zeros(1 << SKETCH_BITS, np.int64), False, [f.split()[0] for f in _FIRST.split(", ")]
        for b in c.text_slices(batches):
            sets, seen, m = list(shingle_sets(b.column("text"), k)), True, b.num_rows
            sketch += np.bincount((np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(sketch))
            d1, d2 = zip(*map(_digest, sets), strict=True)
            yield pa.record_batch([b.column("doc_id"), pa.array(map(len, sets), pa.int64()), pa.array(d1), pa.array(d2), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=names)
        if seen:
            parts = sketch.astype("<u4").reshape(-1, SKETCH_BLOCK)
            m = len(parts)
            yield pa.record_batch([pa.nulls(m, pa.int64())] * 4 + [pa.array(range(m), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=names)

    return run


def _add_blocks(batches):
    """The sums of the sketch's blocks, part by part, so that a task holds its blocks' counters and no more."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for block, x in zip(b.column("block").to_pylist(), b.column("counts"), strict=True):
            held = total.setdefault(block, np.zeros(SKETCH_BLOCK, np.int64))
            held += np.frombuffer(x.as_buffer(), "<u4")
    yield pa.record_batch([pa.array(total, pa.int32()), pa.array([x.astype("<i8").tobytes() for x in total.values()], pa.binary())], names=["block", "counts"])


_RARE, _ROWS = "row_id long, n long, prefix array<bigint>, bins array<smallint>", "row_id long, block int, part array<bigint>"


def _sets_of(b: pa.RecordBatch, k: int, seen: set) -> Iterator[tuple[int, np.ndarray]]:
    """(row_id, its set) of the texts that stand for a set; d1 says for which."""
    for row, want, u in zip(b.column("row_id").to_pylist(), b.column("d1").to_pylist(), shingle_sets(b.column("text"), k), strict=True):
        if row not in seen and _digest(u)[0] == want:  # not a repeated row, nor another text of this doc_id
            seen.add(row)
            yield row, u


def _rare(k: int, percent: int, sketch):
    """The rare columns of each row, in the global order, and the sizes of its narrow blocks."""

    def run(batches):
        count, seen = sketch.value, set()
        for b in c.text_slices(batches):
            ids, n, prefix, bins = [], [], [], []
            for row, u in _sets_of(b, k, seen):
                ids.append(row)
                n.append(len(u))
                p = len(u) - -(-percent * len(u) // 100) + 1
                prefix.append(c.as_long(u[np.lexsort((u, count[(u >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]))[:p]]))
                bins.append(np.bincount((u & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS).astype(np.int16) if len(u) < MOST_BINNED else None)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(prefix, pa.list_(pa.int64())), pa.array(bins, pa.list_(pa.int16()))], names=[f.split()[0] for f in _RARE.split(", ")])

    return run


def _blocks(k: int):
    """All columns of each row, a wide block a row."""

    def run(batches):
        seen, edges = set(), np.arange(1, BLOCKS, dtype=np.uint64) << np.uint64(65 - BLOCKS.bit_length())
        for b in c.text_slices(batches):
            ids, flat, cuts = [], [], []
            for row, u in _sets_of(b, k, seen):
                ids.append(row)
                flat.append(c.as_long(u))
                cuts.append(np.diff(np.concatenate(([0], np.searchsorted(u, edges), [len(u)]))))
            if ids:
                parts = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.concatenate(cuts)))).astype(np.int32)), pa.array(np.concatenate(flat)))
                rows = pa.record_batch([pa.array(np.repeat(np.array(ids, np.int64), BLOCKS)), pa.array(np.tile(np.arange(BLOCKS, dtype=np.int32), len(ids))), parts], names=[f.split()[0] for f in _ROWS.split(", ")])
                yield rows.filter(pa.array(np.concatenate(cuts) > 0))

    return run


def _size_bound(percent: int):
    """Sizes that still allow the threshold."""
    return F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent


def _in_order(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _side(rows: DataFrame, x: str, *keys: str) -> DataFrame:
    return rows.select("h", *keys, F.col("row_id").alias(x), *[F.col(y).alias(f"{y}_{x}") for y in ("n", "left", "long", "label")])


def _reach(overlap, n_a, n_b, percent: int):
    return overlap * (100 + percent) >= (n_a + n_b) * percent


def _may_link(percent: int):
    """Sizes and places that still allow the threshold. At the first column that a pair shares in the
    global order, the overlap is at most what is left of either row; at later columns this fails no sooner."""
    return _size_bound(percent) & _reach(F.least("left_a", "left_b"), F.col("n_a"), F.col("n_b"), percent)


def _multiply(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of rows that share a column, with their overlaps counted.

    Behind the last shared column either row has `left` - 1; before it, the overlap is what is counted here,
    and at most the long columns, which are not."""
    met = _side(rows, "a").join(_side(rows, "b"), "h").where((F.col("label_a") < F.col("label_b")) & _may_link(percent))
    counted = met.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(
        F.count("*").alias("common"), F.min(F.least("left_a", "left_b")).alias("left"), F.first(F.least("long_a", "long_b")).alias("long"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b")
    )
    return counted.where(_reach(F.col("common") + F.col("long") + F.col("left") - 1, F.col("n_a"), F.col("n_b"), percent)).select("a", "b")


def _dealt(rows: DataFrame, total: int) -> DataFrame:
    """rows with a salt: those of long columns, at most c.HEAVY of them, are dealt out."""
    return rows.withColumn("salt", F.when(F.col("len") > max(total // c.HEAVY, 1), F.pmod(F.xxhash64("row_id"), F.lit(c.SALTS)).cast("int")).otherwise(F.lit(0)))


def _for_all(columns: DataFrame, total: int) -> DataFrame:
    """columns (h, len) with each salt that their rows may have."""
    return columns.withColumn("salt", F.explode(F.when(F.col("len") > max(total // c.HEAVY, 1), F.sequence(F.lit(0), F.lit(c.SALTS - 1))).otherwise(F.array(F.lit(0)))))


def _meet(rows: DataFrame, pivots: DataFrame, total: int, percent: int) -> DataFrame:
    """Pairs of a row and its column's pivot, at any column that they share, not only at the first one."""
    met = _side(_dealt(rows, total), "a", "salt").join(_side(_for_all(pivots, total), "b", "salt"), ["h", "salt"])
    return _in_order(met.where((F.col("label_a") != F.col("label_b")) & _size_bound(percent)))


def _cross(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of rows that share a column and are of different components.

    A column's components are paired first, by the ranges of their sizes and places, so that pairs
    inside one are not even looked at; then the smaller component's rows are brought in, then the other's."""
    parts = rows.groupBy("h", "label").agg(F.count("*").alias("k"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("left").alias("left"))
    part = lambda x: parts.select("h", *[F.col(y).alias(f"{y}_{x}") for y in ("label", "k", "lo", "hi", "left")])
    near = (F.col("lo_a") * percent <= F.col("hi_b") * 100) & (F.col("lo_b") * percent <= F.col("hi_a") * 100)
    near = near & _reach(F.least("left_a", "left_b"), F.col("lo_a"), F.col("lo_b"), percent)
    met = part("a").join(part("b"), "h").where((F.struct("k_a", "label_a") < F.struct("k_b", "label_b")) & near)
    met = met.select("h", "label_a", "label_b")
    return _in_order(met.join(_side(rows, "a"), ["h", "label_a"]).join(_side(rows, "b"), ["h", "label_b"]).where(_may_link(percent)))


def _joined(pairs: DataFrame, rows: DataFrame, *names: str) -> DataFrame:
    for side in "ab":
        pairs = pairs.join(rows.select(F.col("row_id").alias(side), *[F.col(x).alias(f"{x}_{side}") for x in names]), side)
    return pairs


def _bounded(pairs: DataFrame, bins: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes of narrow blocks still allow the threshold."""
    most = F.aggregate(F.zip_with("bins_a", "bins_b", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    most = F.coalesce(most, F.least("n_a", "n_b"))
    return _joined(pairs, bins, "n", "bins").where(_reach(most, F.col("n_a"), F.col("n_b"), percent)).select("a", "b", "n_a", "n_b").distinct()


def _links(pairs: DataFrame, matrix: DataFrame, percent: int) -> DataFrame:
    """The pairs whose overlap reaches the threshold: each block of columns is multiplied by itself, and the partial counts are added up."""
    part = lambda x: matrix.select(F.col("row_id").alias(x), "block", F.col("part").alias(f"part_{x}"))
    met = pairs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))).join(part("a"), ["a", "block"]).join(part("b"), ["b", "block"])
    counted = met.groupBy("a", "b", "n_a", "n_b").agg(F.sum(F.size(F.array_intersect("part_a", "part_b"))).alias("overlap"))
    return counted.where(_reach(F.col("overlap"), F.col("n_a"), F.col("n_b"), percent)).select("a", "b")


def _rows(docs: DataFrame, first: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(row_id, n, prefix, bins; d1, d2, size, row_id, class_id, n): the rare part of the matrix, and the row of each set, with n, the documents that have it."""
    spark = docs.sparkSession
    sketch = np.zeros(((1 << SKETCH_BITS) // SKETCH_BLOCK, SKETCH_BLOCK), np.int64)
    blocks = first.where("block is not null").select("block", "counts").repartition("block").mapInArrow(c.tidy(_add_blocks), "block int, counts binary")
    for x in blocks.collect():  # 8 MB of counters, whatever the input
        sketch[x["block"]] = np.frombuffer(x["counts"], "<i8")
    shared = spark.sparkContext.broadcast(np.minimum(sketch.ravel(), 2**31 - 1).astype(np.int32))
    classes = first.where("n > 0 and doc_id is not null").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"))
    # A row is named by its smallest doc_id, or by a hash of its set if that doc_id has several sets.
    several = classes.groupBy("class_id").agg(F.count("*").alias("sets")).where("sets > 1")
    row_id = F.when(F.col("sets").isNull(), F.col("class_id")).otherwise(F.xxhash64("d1", "d2", "class_id"))
    classes = c.cut(classes.join(several, "class_id", "left").select("d1", "d2", F.col("n").alias("size"), row_id.alias("row_id"), "class_id", F.col("copies").alias("n")), "jaccard_classes")
    rare = c.cut(_texts(docs, classes).mapInArrow(c.tidy(_rare(k, percent, shared)), _RARE), "jaccard_rare")
    shared.unpersist()
    return rare, classes


def _texts(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The text that stands for each set, among other texts of its doc_id."""
    return docs.join(classes.select(F.col("class_id").alias("doc_id"), "row_id", "d1"), "doc_id").select("row_id", "d1", "text")


def jaccard_join(docs: DataFrame, k: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """Join documents whose k-word shingle sets have a Jaccard similarity of percent / 100 or more.

    Returns (rows, links). rows: doc_id, n_shingles, class_id (smallest doc_id with the same set),
    component_id (smallest doc_id that links reach). links: a, b: linked rows of the matrix, enough of
    them to connect every component.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    first = c.cut(docs.mapInArrow(c.tidy(_digests(k)), _FIRST), "jaccard_digests")
    rare, classes = _rows(docs, first, k, percent)
    labels, links = _linked(docs, classes, rare, k, percent)

    # Sets of one doc_id belong together.
    rows = first.where("block is null").select("doc_id", F.col("n").alias("size"), "d1", "d2")
    full, have = rows.where("size > 0"), F.col("doc_id").isNotNull()
    digest = ["d1", "d2", "size"]
    sets = c.join_counted(full.where(have).distinct(), classes, digest, ["doc_id"]).select("doc_id", "row_id")
    both = sets.groupBy("doc_id").agg(F.min("row_id").alias("a"), F.max("row_id").alias("top")).where("a < top").select("doc_id", "a")
    same = sets.join(both, "doc_id").where("a < row_id").select("a", F.col("row_id").alias("b"))
    classes = classes.withColumnRenamed("n", "copies").join(labels, "row_id", "left").withColumn("label", F.coalesce("label", "row_id"))
    name = lambda x: classes.select(F.col("row_id").alias(x), F.col("label").alias(f"label_{x}"))
    same = c.cut(same.join(name("a"), "a").join(name("b"), "b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).where("a <> b"), "jaccard_shared")
    if not same.isEmpty():
        classes = _renamed(classes, components(same), "row_id")
    least = c.cut(classes.groupBy("label").agg(F.min("class_id").alias("component_id"), F.count("*").alias("n")), "jaccard_least")
    classes = c.join_counted(classes, least, ["label"], ["row_id"])
    classes = c.cut(classes.select("d1", "d2", "size", "row_id", "class_id", "component_id", F.col("copies").alias("n")), "jaccard_components")
    c.drop_table(least)
    c.drop_table(same)

    named = c.join_counted(full.where(have).withColumn("at", F.monotonically_increasing_id()), classes.drop("row_id"), digest, ["at"])
    out = named.select("doc_id", F.col("size").alias("n_shingles"), "class_id", "component_id")
    unnamed = F.lit(None).cast("long")
    out = out.union(full.where(~have).select("doc_id", "size", unnamed, unnamed))
    # Rows without words are linked with nothing, but share their doc_id's component.
    alone = rows.where("size = 0").select("doc_id", F.col("size").alias("n_shingles"))
    others = sets.join(alone.select("doc_id").distinct(), "doc_id", "left_semi").join(classes.select("row_id", "component_id"), "row_id").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    alone = alone.join(others, "doc_id", "left")
    return out.union(alone.select("doc_id", "n_shingles", F.col("doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"))), links


def _renamed(rows: DataFrame, joined: DataFrame, by: str | None = None) -> DataFrame:
    """rows, with their label's component as label. joined: node, component.

    by: rows of one label are dealt out by this column, where many rows may have one label and few labels change."""
    salt = F.pmod(F.xxhash64(by), F.lit(c.SALTS)).cast("int") if by else F.lit(0)
    new = joined.select(F.col("node").alias("label"), "component", F.explode(F.sequence(F.lit(0), F.lit(c.SALTS - 1 if by else 0))).alias("salt"))
    return rows.withColumn("salt", salt).join(new, ["label", "salt"], "left").withColumn("label", F.coalesce("component", "label")).drop("component", "salt")


def _linked(docs: DataFrame, classes: DataFrame, rare: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(row_id, label; a, b): the component of each row that has a link, and links that join them."""
    cells = rare.select("row_id", "n", F.posexplode("prefix").alias("pos", "h")).select("row_id", "n", "h", (F.col("n") - F.col("pos")).alias("left"))
    columns = c.cut(cells.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "jaccard_columns")  # columns with a single row make no pair
    cells = c.join_counted(cells.withColumnRenamed("n", "size"), columns, ["h"], ["row_id"]).select("row_id", F.col("size").alias("n"), "h", "left", F.col("n").alias("len"))
    seen = Observation()
    cells = c.cut(cells.observe(seen, F.count("*").alias("n")), "jaccard_cells")
    live = c.cut(cells.select("row_id").distinct(), "jaccard_live")
    bins = c.cut(rare.join(live, "row_id", "left_semi").select("row_id", "n", "bins"), "jaccard_bins")
    c.drop_table(rare)
    matrix = c.cut(_texts(docs, classes.join(live, "row_id", "left_semi")).mapInArrow(c.tidy(_blocks(k)), _ROWS), "jaccard_matrix")
    long = cells.where(F.col("len") > SHORT)
    lead = long.groupBy("row_id").agg(F.max(F.col("left") / F.col("n")).alias("lead"), F.count("*").alias("long"))
    short = cells.where(F.col("len") <= SHORT).join(lead, "row_id", "left").withColumn("long", F.coalesce("long", F.lit(0))).withColumn("label", F.col("row_id"))
    rest = long.join(lead, "row_id").withColumn("label", F.col("row_id"))
    pairs, labels, links, tables = _multiply(short, percent), None, [], [columns, cells, live, bins]
    crossing, falling, total = float("inf"), True, seen.get.get("n", 0)
    for turn in range(PIVOT_PASSES + 1):
        last = turn and (turn == PIVOT_PASSES or not falling or crossing <= total // 8 + 20_000)
        if last:
            pairs = _cross(rest, percent)
        else:
            # First the row that has the least before its first long column: of near copies, the one nearest to all others.
            order = F.struct(F.lit(0.0) if turn else -F.col("lead"), F.xxhash64("row_id", F.lit(turn)))
            pivot = rest.groupBy("h").agg(F.min(F.struct(order.alias("order"), "row_id", "n", "left", "long", "label")).alias("p"), F.first("len").alias("len")).select("h", "len", "p.row_id", "p.n", "p.left", "p.long", "p.label")
            more = _meet(rest, pivot, total, percent)
            pairs = more if turn else pairs.union(more).distinct()
        pairs = c.cut(_bounded(pairs, bins, percent), "jaccard_pairs")
        found = c.cut(_links(pairs, matrix, percent), "jaccard_links")
        c.drop_table(pairs)
        links.append(found)
        if labels is None:
            joined = components(found)
            labels = joined.select(F.col("node").alias("row_id"), F.col("component").alias("label"))
        else:  # only what joins two components is looked at
            name = lambda x: labels.select(F.col("row_id").alias(x), F.col("label").alias(f"label_{x}"))  # noqa: B023, E731
            end = lambda x: F.coalesce(f"label_{x}", x).alias(x)
            joined = components(found.join(name("a"), "a", "left").join(name("b"), "b", "left").select(end("a"), end("b")))
            # A row that had no link yet is a component of its own.
            fresh = joined.select(F.col("node").alias("row_id"), F.col("component").alias("label")).join(labels, "row_id", "left_anti")
            labels = c.cut(_renamed(labels, joined, "row_id").select("row_id", "label").union(fresh), "jaccard_labels")
        if last:
            break
        # Columns that still hold rows of several components.
        rest = _renamed(rest, joined, "h" if turn else None)  # at first each label is a row's own
        open_ = rest.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.first("len").alias("len")).where("lo < hi")
        rest = c.cut(_dealt(rest, total).join(_for_all(open_, total), ["h", "salt"], "left_semi").select("row_id", "n", "h", "left", "long", "len", "lead", "label"), "jaccard_rest")
        tables.append(rest)
        parts = rest.groupBy("h", "label").count().groupBy("h").agg(F.sum("count").alias("s"), F.sum(F.col("count").cast("double") * F.col("count")).alias("q"))
        pairs_left = F.coalesce(F.sum((F.col("s").cast("double") * F.col("s") - F.col("q")) / 2), F.lit(0.0))
        before = crossing
        crossing = parts.agg(pairs_left).first()[0]
        falling = crossing < before / 2  # else the pairs left are mostly of different texts, and pivots do not thin them out
        if not crossing:
            break
    for x in tables:
        c.drop_table(x)
    c.drop_table(matrix)
    return labels, reduce(DataFrame.union, links)
