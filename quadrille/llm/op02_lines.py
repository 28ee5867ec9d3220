"""Line dedup by content-defined chunks of lines, in DataFrame functions only.

A window is two lines in a row, and its rolling hash is taken over their two line hashes. A chunk begins at each
window whose rolling hash is the least of those up to `radius` before and after it, so an insertion moves the
boundaries next to it and no others. A chunk's last line is the next one's first: every window lies in one chunk,
and no chunk has fewer than two lines. The chunks whose hashes occur twice are grouped and joined by their text,
byte for byte, and the lines of a chunk that occurs anywhere before (smaller doc_id, or earlier in the same
document) are removed.

What is left is cut again with the next, smaller radius of `radii`, inside the chunks: so copies of whole
texts and long passages go as chunks of several lines, and only the chunks at their ends and those of other text
reach the next turn. At radius 0 a chunk is a window. A chunk that stays is the first of its text, so
whatever is removed later stands before in a chunk that stays too: with a last radius of 0 exactly the passages
of two lines or more that stand before lose all their lines, wherever they begin and end. No line vanishes
altogether: the first place of a line's text is never removed.

Defined results: a null text stays null with no lines; an empty text is one empty line, and empty lines
are lines; a null doc_id takes no part; rows that share a doc_id are told apart by their texts, and
repeated rows are one document, so all keep the same lines; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm import common as c

PLACE = ["doc_id", "ver", "at"]
#: Chunks of three windows on average, then the windows themselves.
RADII = (1, 0)


def line_chunks(parts: DataFrame, radius: int) -> DataFrame:
    """parts: doc_id, ver, at (its first line), h (the hashes of its lines). The same of the chunks in each part."""
    # A column for each step, which the next one names more than once, so that a lambda looks values up in it and doesn't compute
    # the array again; and no filter before the explode, which Spark would move below the hashes and so compute them twice.
    parts = parts.withColumn("rolling", F.transform(F.slice("h", F.lit(1), F.greatest(F.size("h") - 1, F.lit(0))), lambda x, i: F.xxhash64(x, F.get("h", i + 1))))
    first = lambda i: F.greatest(i - radius, F.lit(0))
    least = lambda i: F.get("rolling", i) == F.array_min(F.slice("rolling", first(i) + 1, i + radius + 1 - first(i)))
    begins = F.filter(F.sequence(F.lit(0), F.size("rolling") - 1), lambda i: (i == 0) | least(i) if radius else F.lit(True))
    parts = parts.withColumn("marks", F.when(F.size("rolling") > 0, F.concat(begins, F.array(F.size("rolling")))))
    lines = lambda j: F.slice("h", F.get("marks", j) + 1, F.get("marks", j + 1) - F.get("marks", j) + 1)
    chunks = F.transform(F.sequence(F.lit(0), F.size("marks") - 2), lambda j: F.struct((F.col("at") + F.get("marks", j)).alias("at"), lines(j).alias("h")))
    rows = parts.withColumn("chunks", F.when(F.col("marks").isNotNull(), chunks)).select("doc_id", "ver", F.explode_outer("chunks").alias("k"))
    return rows.select("doc_id", "ver", "k.*").where("at is not null")


def later_chunks(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_id, ver, at, stop: the chunks (lines at to stop, without stop) whose text is that of a chunk before."""
    units = chunks.select(*PLACE, (F.col("at") + F.size("h")).alias("stop"), F.xxhash64("h").alias("key"))
    # 8 bytes a chunk find the hashes that occur twice; only their chunks move with their text. A common
    # chunk's places are dealt out.
    twice = c.cut(units.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "line_twice")
    named = c.join_counted(units, twice, ["key"], PLACE).groupBy("doc_id", "ver").agg(F.collect_set(F.struct("at", "stop")).alias("ends"))
    named = c.cut(named, "line_named")
    # Sort-merge joins at every size, so that a small run shows what a large one moves.
    lines = docs.join(named.hint("merge"), ["doc_id", "ver"]).select("doc_id", "ver", "ends", F.split("text", "\n").alias("lines"))
    text = lambda u: F.array_join(F.slice("lines", u["at"] + 1, F.least(u["stop"], F.size("lines")) - u["at"]), "\n")
    texts = F.transform("ends", lambda u: F.struct(u["at"].alias("at"), u["stop"].alias("stop"), text(u).alias("unit")))
    found = lines.withColumn("w", texts).select("doc_id", "ver", F.explode_outer("w").alias("w")).select("doc_id", "ver", "w.*")
    found = c.cut(found, "line_units")
    first = c.cut(found.groupBy("unit").agg(F.min(F.struct(*PLACE)).alias("first"), F.count("*").alias("n")).where("n > 1"), "line_first")
    later = c.join_counted(found, first, ["unit"], PLACE).where(F.struct(*PLACE) > F.col("first"))
    out = c.cut(later.select(*PLACE, "stop"), "line_later")
    for t in (twice, named, found, first):
        c.drop_table(t)
    return out


def repeated_lines(docs: DataFrame, radii: tuple[int, ...] = RADII) -> DataFrame:
    """doc_id, ver, gone: the places, in order, of lines in chunks that occur before."""
    left = docs.select("doc_id", "ver", F.lit(0).alias("at"), F.transform(F.split("text", "\n"), lambda x: F.xxhash64(x)).alias("h"))
    later, held = [], None
    for radius in radii:
        chunks = line_chunks(left, radius)
        later.append(later_chunks(docs, chunks))
        if radius != radii[-1]:
            before, held = held, c.cut(chunks.join(later[-1].select(*PLACE).hint("merge"), PLACE, "left_anti"), "line_left")
            left = held
            if before is not None:
                c.drop_table(before)
    spans = reduce(DataFrame.union, later).groupBy("doc_id", "ver").agg(F.flatten(F.collect_list(F.sequence("at", F.col("stop") - 1))).alias("gone"))
    out = c.cut(spans.select("doc_id", "ver", F.array_sort(F.array_distinct("gone")).alias("gone")), "line_repeats")
    for t in [*later, held]:
        if t is not None:
            c.drop_table(t)
    return out


def dedup_lines(docs: DataFrame, radii: tuple[int, ...] = RADII) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_text: the texts without passages of two lines or more that occur before."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("ver"))
    both = docs.join(repeated_lines(docs.where("doc_id is not null and text is not null"), radii).hint("merge"), ["doc_id", "ver"], "left")
    # Lines in a row are one span; what stays are the lines between the spans, in order.
    starts = F.filter("gone", lambda x, j: (j == 0) | (x - F.get("gone", j - 1) > 1))
    stops = F.filter("gone", lambda x, j: (j == F.size("gone") - 1) | (F.get("gone", j + 1) - x > 1))
    both = both.withColumn("spans", F.zip_with(starts, stops, lambda a, b: F.struct(a.alias("start"), (b + 1).alias("stop")))).withColumn("lines", F.split("text", "\n"))
    lines, before = F.col("lines"), lambda j: F.coalesce(F.get("spans", j - 1)["stop"], F.lit(0))
    stays = F.transform(
        F.sequence(F.lit(0), F.size("spans")),
        lambda j: F.slice(lines, before(j) + 1, F.coalesce(F.get("spans", j)["start"], F.size(lines)) - before(j)),
    )
    kept = F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(stays), "\n"))
    removed = F.coalesce(F.aggregate("spans", F.lit(0), lambda a, x: a + x["stop"] - x["start"]), F.lit(0))
    return both.select("doc_id", F.coalesce(F.when(F.col("text").isNotNull(), F.size("lines")), F.lit(0)).cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"), kept.alias("kept_text"))
