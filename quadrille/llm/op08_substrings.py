"""Substring dedup: prefix-partitioned suffix trees over words, read off at their deep nodes.

A suffix starts at every word. Its path is the words that follow; a node at depth `window` with
two or more leaves is a repeat, and neighbouring repeats join into maximal ones. The tree is
never built whole:

1. Prefixes of variable length split the suffixes. A suffix's prefix goes from its start to the end of
   the k words with the least hash among the first `window`, so it has k to `window` words, and
   equal paths have equal prefixes. Suffixes next to each other mostly end their prefixes at the same
   place, and travel together as one stretch of text of at most 2 * window - k words. The places are
   counted; a place that no other one equals has no deep node, and is left out here.
2. The places that stay are dealt by their k words, and tasks take them in groups that memory holds. In a
   group the suffixes are sorted by prefix doubling over their words themselves (ranks of one word, of
   two, of four, up to `window`), which gives the subtree's nodes at depth `window`: suffixes of one rank.
3. Groups of more than `GROUP` places, or of a `SHARE`th of all, are lengthened to the whole depth: their suffixes
   are grouped by their `window` words. A group's leaves are combined before the shuffle to the earliest one,
   so a passage that a third of all documents share is a row per task, not a group in one task.

Leaves after a node's earliest one are repeats. Equal hashes bring suffixes together; only equal words count.

Defined results: a null text has no words; a null doc_id repeats nothing and stays as it is; rows
that share a doc_id are neither earlier nor later than each other at the same start, so repeated
rows keep what one would keep; texts shorter than the window stay; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm import common as c

#: Places in a group that one task sorts at a time, at most; with `window` 20 and k 8 a place brings up to 32 words.
GROUP = 50_000
#: A group with over 1 / SHARE of all places (and over LEAST of them) is long too, so that small tables go the way of large ones.
SHARE, LEAST = 2000, 100
#: Nodes of long groups that tasks look up in a table of their own, at most, about 150 bytes each; more are joined.
FEW = 50_000


def _windows(texts: pa.Array, k: int, window: int):
    """(offsets, word hashes, starts of whole windows, place of the prefix that stands for each, prefix hashes)."""
    off, words = c.split_words(texts)
    codes, distinct = c.word_codes(words)
    h = c.word_hashes(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    grams, n, reach = c.gram_hashes(h, k), len(h), window - k + 1
    if n < window:
        return off, h, np.zeros(0, np.int64), np.zeros(0, np.int64), grams
    m = n - window + 1
    least, place = grams[:m].copy(), np.zeros(m, np.int32)
    for j in range(1, reach):
        better = grams[j : j + m] < least
        least[better] = grams[j : j + m][better]
        place[better] = j
    end = np.repeat(off[1:], np.diff(off))[:m]
    starts = np.flatnonzero(np.arange(m) + window <= end)
    return off, h, starts, starts + place[starts], grams


def _prefixes(k: int, window: int):
    def run(batches):
        for b in c.text_slices(batches):
            off, _, _, at, grams = _windows(b.column("text"), k, window)
            at = np.unique(at)
            doc = np.searchsorted(off, at, side="right") - 1
            cuts = np.searchsorted(doc, np.arange(b.num_rows + 1)).astype(np.int32)
            pos = pa.ListArray.from_arrays(pa.array(cuts), pa.array((at - off[doc]).astype(np.int32)))
            hs = pa.ListArray.from_arrays(pa.array(cuts), pa.array(c.as_long(grams[at])))
            yield pa.record_batch([b.column("doc_id"), b.column("ver"), hs, pos], names=["doc_id", "ver", "prefix", "pos"])

    return run


def _stretches(k: int, window: int, whole: bool):
    """For each place in `pos` the text of its suffixes down to `window` words, words joined by a space: start (of the
    first), n (how many), words. whole: each suffix by itself."""

    def run(batches):
        for b in c.text_slices(batches, limit=c.SLICE_BYTES // 2):
            off, h, starts, at, grams = _windows(b.column("text"), k, window)
            _, words = c.split_words(b.column("text"))
            lists = b.column("pos")
            live = np.zeros(len(h) + 1, bool)
            live[np.repeat(off[:-1], np.asarray(pc_len(lists), np.int64)) + np.asarray(lists.flatten(), np.int64)] = True
            starts, at = starts[live[at]], at[live[at]]
            head = np.arange(len(starts)) if whole else np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))[: len(at)])
            n = np.diff(np.append(head, len(starts)))
            first = starts[head]
            doc = np.searchsorted(off, first, side="right") - 1
            for x in range(0, len(first), 1 << 14):  # a few at a time bound the memory
                y = slice(x, x + (1 << 14))
                lens = n[y] + window - 1
                ends = np.cumsum(lens)
                idx = np.repeat(first[y] - (ends - lens), lens) + np.arange(ends[-1])
                text = pa.compute.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), words.take(pa.array(idx))), " ")
                yield pa.record_batch(
                    [pa.array(c.as_long(grams[at[head[y]]])), b.column("doc_id").take(pa.array(doc[y])), b.column("ver").take(pa.array(doc[y])), pa.array((first[y] - off[doc[y]]).astype(np.int32)), pa.array(n[y].astype(np.int32)), text],
                    names=["prefix", "doc_id", "ver", "start", "n", "words"],
                )

    return run


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ranks of pairs of ranks."""
    return np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]


def _later(t: pa.Table, window: int) -> pa.RecordBatch:
    """doc_id, ver, starts: the suffixes of whole groups whose first `window` words an earlier suffix has too."""
    off, words = c.split_words(t.column("words").combine_chunks())
    rank, width = c.word_codes(words)[0], 1
    while width < window:  # doubled, and at last with an overlap
        step = min(width, window - width)
        rank, width = _pairs(rank[: len(rank) - step], rank[step:]), width + step
    n = t.column("n").to_numpy()
    leaf = np.repeat(np.arange(len(n)), n)
    shift = np.arange(len(leaf)) - np.repeat(np.cumsum(n) - n, n)
    node, doc, start = rank[off[leaf] + shift], t.column("doc_id").to_numpy()[leaf], t.column("start").to_numpy()[leaf] + shift
    order = np.lexsort((start, doc, node))
    begin = np.maximum.accumulate(np.where(np.concatenate(([True], node[order[1:]] != node[order[:-1]])), np.arange(len(order)), 0))
    first = order[begin]
    gone = np.sort(order[(doc[order] != doc[first]) | (start[order] != start[first])])
    rows, count = np.unique(leaf[gone], return_counts=True)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))).astype(np.int32)), pa.array(start[gone].astype(np.int32)))
    t = t.take(pa.array(rows))
    return pa.record_batch([t.column("doc_id").combine_chunks(), t.column("ver").combine_chunks(), lists], names=["doc_id", "ver", "starts"])


def _subtrees(window: int):
    """Rows come in the order of their prefixes; a group is held until it is whole."""

    def run(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t])
            prefix = t.column("prefix").to_numpy()
            whole = int(np.searchsorted(prefix, prefix[-1])) if len(prefix) else 0
            if whole:
                yield _later(t.slice(0, whole), window)
            held = t.slice(whole)
        if held is not None and held.num_rows:
            yield _later(held, window)

    return run


def _looked_up(first):
    """doc_id, ver, starts: of suffixes of long groups, a document's in a row, those whose node has an earlier one."""

    def run(batches):
        t = first.value
        nodes, docs, starts = (t.column(x).combine_chunks() for x in ("words", "doc_id", "start"))
        docs, starts = np.asarray(docs), np.asarray(starts)
        for b in batches if len(docs) else ():
            node = np.asarray(pa.compute.fill_null(pa.compute.index_in(b.column("words"), value_set=nodes), -1))
            doc, ver, start = (np.asarray(b.column(x)) for x in ("doc_id", "ver", "start"))
            gone = np.flatnonzero((node >= 0) & ((doc != docs[node]) | (start != starts[node])))
            if len(gone):
                doc, ver = doc[gone], ver[gone]
                head = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (ver[1:] != ver[:-1]))))
                lists = pa.ListArray.from_arrays(pa.array(np.append(head, len(gone)).astype(np.int32)), pa.array(start[gone].astype(np.int32)))
                yield pa.record_batch([pa.array(doc[head]), pa.array(ver[head]), lists], names=["doc_id", "ver", "starts"])

    return run


def pc_len(lists: pa.Array) -> pa.Array:
    return pa.compute.fill_null(pa.compute.list_value_length(lists), 0)


def _remove(window: int):
    def run(batches):
        for b in c.text_slices(batches):
            off, words = c.split_words(b.column("text"))
            mark = np.zeros(len(words) + 1, np.int32)
            lists = b.column("starts")
            at = np.repeat(off[:-1], np.asarray(pc_len(lists), np.int64)) + np.asarray(lists.flatten(), np.int64)
            mark += np.bincount(at, minlength=len(mark)).astype(np.int32) - np.bincount(at + window, minlength=len(mark)).astype(np.int32)
            gone = np.cumsum(mark[:-1]) > 0
            total = np.concatenate(([0], np.cumsum(gone)))
            left = np.concatenate(([0], np.cumsum(~gone)))[off]
            kept = pa.ListArray.from_arrays(pa.array(left.astype(np.int32)), words.filter(pa.array(~gone)))
            yield pa.record_batch(
                [b.column("doc_id"), pa.array(np.diff(off)), pa.array(total[off[1:]] - total[off[:-1]]), pa.compute.binary_join(kept, " ")],
                names=["doc_id", "n_words", "n_removed", "kept_text"],
            )

    return run


def _same_row(a: DataFrame, b: DataFrame) -> Column:
    return (a["doc_id"] == b["doc_id"]) & (a["ver"] == b["ver"])


def repeated_windows(docs: DataFrame, window: int = 20, k: int = 8) -> DataFrame:
    """doc_id, ver (a hash of the text), starts: the windows of each document that also start earlier."""
    docs = docs.where("doc_id is not null and text is not null")
    prefixes = c.cut(docs.mapInArrow(c.tidy(_prefixes(k, window)), "doc_id long, ver long, prefix array<bigint>, pos array<int>"), "prefixes")
    places = prefixes.select("doc_id", "ver", F.inline(F.arrays_zip("prefix", "pos")))
    groups = c.cut(places.groupBy("prefix").agg(F.count("*").alias("n")).where("n > 1"), "prefix_groups")
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    is_long = F.col("n") > min(GROUP, max(total // SHARE, LEAST))
    live = c.join_counted(places, groups, ["prefix"], ["doc_id", "pos"]).groupBy("doc_id", "ver").agg(F.collect_set(F.when(~is_long, F.col("pos"))).alias("pos"), F.collect_set(F.when(is_long, F.col("pos"))).alias("long_pos"))
    live = c.cut(live, "prefix_places")
    c.drop_table(prefixes)

    def texts(pos: str) -> DataFrame:
        return docs.join(live.where(F.size(pos) > 0), ["doc_id", "ver"]).select("doc_id", "ver", "text", F.col(pos).alias("pos"))

    kinds = "prefix long, doc_id long, ver long, start int, n int, words string"
    dealt = texts("pos").mapInArrow(c.tidy(_stretches(k, window, False)), kinds).repartition("prefix").sortWithinPartitions("prefix")
    found = dealt.mapInArrow(c.tidy(_subtrees(window)), "doc_id long, ver long, starts array<int>")
    if not groups.where(is_long).isEmpty():
        leaves = c.cut(texts("long_pos").mapInArrow(c.tidy(_stretches(k, window, True)), kinds).select("words", "doc_id", "ver", "start"), "long_suffixes")
        nodes = c.cut(leaves.groupBy("words").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "start")).alias("first")).where("n > 1"), "long_nodes")
        if nodes.count() <= FEW:
            first = docs.sparkSession.sparkContext.broadcast(nodes.select("words", "first.*").toArrow())
            later = leaves.mapInArrow(c.tidy(_looked_up(first)), "doc_id long, ver long, starts array<int>")
        else:
            met = c.join_counted(leaves, nodes, ["words"], ["doc_id", "start"]).where(F.struct("doc_id", "start") > F.col("first"))
            later = met.select("doc_id", "ver", F.array("start"))
        found = found.union(later)
    out = c.cut(found.groupBy("doc_id", "ver").agg(F.flatten(F.collect_list("starts")).alias("starts")), "repeats")
    c.drop_table(groups)
    c.drop_table(live)
    return out


def remove_repeats(docs: DataFrame, window: int = 20, k: int = 8) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (words left, joined by a space): each word goes that a
    window of `window` words covers whose words also start earlier (smaller doc_id, or smaller start)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("ver"))
    found = repeated_windows(docs, window, k)
    both = docs.join(found, _same_row(docs, found), "left").select(docs["doc_id"], "text", "starts")
    return both.mapInArrow(c.tidy(_remove(window)), "doc_id long, n_words long, n_removed long, kept_text string")


def maximal_repeats(docs: DataFrame, window: int = 20, k: int = 8) -> DataFrame:
    """doc_id, ver, start, stop (words): the joined repeats of each document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("ver"))
    starts = F.array_sort(F.array_distinct("starts"))
    gap = lambda x, i: (i == 0) | (x > F.get(F.col("s"), i - 1) + window)
    heads = repeated_windows(docs, window, k).select("doc_id", "ver", starts.alias("s"))
    heads = heads.withColumn("head", F.filter("s", gap)).withColumn("tail", F.filter("s", lambda x, i: (i == F.size("s") - 1) | (F.get(F.col("s"), i + 1) > x + window)))
    return heads.select("doc_id", "ver", F.inline(F.arrays_zip(F.col("head").alias("start"), F.transform("tail", lambda x: x + window).alias("stop"))))
