"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut into short paragraphs: at line breaks, at the end of clauses, and after eight words; all characters belong to
one. A paragraph's digest has 64 bits, and its second, third... occurrence in a text has one of its own. A sketch
adds each digest to three cells (count, xor of digests, xor of checks). The sketches of two versions are subtracted cell by
cell, and peeling cells with one digest recovers the digests that only one of them has. If something is left,
both are sketched four times as large with other hashes, until nothing is. The fingerprint is the smallest sketch.

Numpy handles all texts of a slice at once; the next document of each comes from a shuffle by ranges of doc_id.

Defined results: a null text is empty and has no paragraphs; two empty texts are alike (1.0); ties in doc_id are ordered by
text; rows with a null doc_id come first; of repeated rows, the next one is the same again; one row alone is its own
next; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm import common as c

#: Up to eight words and the stops behind them, or stops and white space alone.
PARAGRAPH = re.compile(r"(?:[^\s,.;:!?]+[^\S\n]*){1,8}[,.;:!?]*\s*|[\s,.;:!?]+")
#: Cells of the fingerprint, and how many times as many the next try has.
CELLS, MORE = 24, 4
#: Peeling rounds of one try. A sketch that holds its load is done in a few; a wrong check cannot go on for ever.
ROUNDS = 100


def paragraph_digests(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, digest) of each paragraph; a row's digests are distinct."""
    lists = [PARAGRAPH.findall(t) for t in texts]
    rows = np.repeat(np.arange(len(texts)), [len(x) for x in lists])
    flat = np.array([p for x in lists for p in x], dtype=object)
    keys = pd.util.hash_array(flat) if len(flat) else np.zeros(0, np.uint64)
    order = np.lexsort((keys, rows))
    r, k = rows[order], keys[order]
    new = np.ones(len(k), bool)
    new[1:] = (r[1:] != r[:-1]) | (k[1:] != k[:-1])
    start = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
    nth = (np.arange(len(k)) - start).astype(np.uint64)
    return r, np.where(nth > 0, c.mix(k ^ c.mix(nth, 5), 6), k)


class Cells:
    """The sketches of n texts, side by side."""

    def __init__(self, n: int, size: int):
        self.n, self.size = n, size
        self.count, self.keys, self.checks = np.zeros(n * size, np.int64), np.zeros(n * size, np.uint64), np.zeros(n * size, np.uint32)

    def _places(self, rows: np.ndarray, keys: np.ndarray) -> Iterator[np.ndarray]:
        third = self.size // 3
        for j in range(3):
            yield rows * self.size + j * third + (c.mix(keys, 1000 + self.size * 3 + j) % np.uint64(third)).astype(np.int64)

    def add(self, rows: np.ndarray, keys: np.ndarray, signs: np.ndarray | int) -> None:
        checks = _check(keys)
        for at in self._places(rows, keys):
            np.add.at(self.count, at, signs)
            np.bitwise_xor.at(self.keys, at, keys)
            np.bitwise_xor.at(self.checks, at, checks)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(rows, digests, signs) that the cells hold, and for each text whether nothing is left. Empties the cells."""
        found = []
        for _ in range(ROUNDS):
            at = np.flatnonzero(np.abs(self.count) == 1)
            at = at[_check(self.keys[at]) == self.checks[at]]
            if not len(at):
                break
            rows, keys, signs = at // self.size, self.keys[at], self.count[at]
            order = np.lexsort((keys, rows))
            rows, keys, signs = rows[order], keys[order], signs[order]
            once = np.ones(len(rows), bool)
            once[1:] = (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])
            rows, keys, signs = rows[once], keys[once], signs[once]
            self.add(rows, keys, -signs)
            found.append((rows, keys, signs))
        left = (self.count != 0) | (self.keys != 0) | (self.checks != 0)
        done = ~left.reshape(self.n, self.size).any(axis=1)
        parts = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)]
        return *parts, done

    def texts(self, totals: np.ndarray) -> list[str]:
        """Each sketch as a string: the number of its digests, and its cells."""
        kind = np.dtype([("count", "<u2"), ("key", "<u8"), ("check", "<u4")])
        cells = np.zeros(self.n * self.size, kind)
        cells["count"], cells["key"], cells["check"] = self.count & 0xFFFF, self.keys, self.checks
        cells = cells.reshape(self.n, self.size)
        return [base64.b64encode(int(t).to_bytes(4, "little") + x.tobytes()).decode() for t, x in zip(totals, cells, strict=True)]


def _check(keys: np.ndarray) -> np.ndarray:
    return (c.mix(keys, 77) >> np.uint64(32)).astype(np.uint32)


def sketch(n: int, rows: np.ndarray, keys: np.ndarray, size: int = CELLS) -> Cells:
    cells = Cells(n, size)
    cells.add(rows, keys, 1)
    return cells


def difference(n: int, left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], size: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows, digests, signs: 1 in left only, -1 in right only) of n pairs, and the cells it took for each pair."""
    todo, cells, found = np.arange(n), np.zeros(n, np.int64), []
    (lr, lk), (rr, rk) = left, right
    while len(todo):
        place = np.full(n, -1)
        place[todo] = np.arange(len(todo))
        both = Cells(len(todo), size)
        for rows, keys, sign in ((lr, lk, 1), (rr, rk, -1)):
            own = place[rows] >= 0
            both.add(place[rows[own]], keys[own], sign)
        rows, keys, signs, done = both.peel()
        cells[todo[done]] = size
        good = done[rows]
        found.append((todo[rows[good]], keys[good], signs[good]))
        todo, size = todo[~done], size * MORE
    parts = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)]
    return *parts, cells


def _lists(n: int, rows: np.ndarray, keys: np.ndarray) -> pa.Array:
    """The digests of each row, in order."""
    order = np.lexsort((keys, rows))
    off = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=n)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(c.as_long(keys[order])))


def compare(df: DataFrame, base: str, others: list[str], keep: str) -> DataFrame:
    """df: columns of text. keep: the other columns of the result, as DDL. Adds, for base and others X: X_paragraphs, X_fingerprint,
    and for others the digests that only base (X_removed) or only X (X_added) has, and the cells it took (X_cells)."""
    names = [x.split()[0] for x in keep.split(", ")]
    parts = [f"{x}_{y}" for x in (base, *others) for y in ("paragraphs long", "fingerprint string")]
    parts += [f"{x}_{y}" for x in others for y in ("removed array<long>", "added array<long>", "cells long")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in c.text_slices(batches, base):
            n = batch.num_rows
            digests = {x: paragraph_digests([t or "" for t in batch.column(x).to_pylist()]) for x in (base, *others)}
            out = [batch.column(x) for x in names]
            for x in (base, *others):
                totals = np.bincount(digests[x][0], minlength=n)
                out += [pa.array(totals, pa.int64()), pa.array(sketch(n, *digests[x]).texts(totals), pa.string())]
            for x in others:
                rows, keys, signs, cells = difference(n, digests[base], digests[x])
                out += [_lists(n, rows[signs > 0], keys[signs > 0]), _lists(n, rows[signs < 0], keys[signs < 0]), pa.array(cells, pa.int64())]
            yield pa.RecordBatch.from_arrays(out, names=[*names, *[p.split()[0] for p in parts]])

    return df.select(*names, base, *others).mapInArrow(c.tidy(run), ", ".join([keep, *parts]))


def likeness(base: str, other: str):
    """Share of the paragraphs of both that they have in common, from a result of compare()."""
    own, theirs, gone = F.col(f"{base}_paragraphs"), F.col(f"{other}_paragraphs"), F.size(f"{other}_removed")
    every = theirs + gone
    return F.when(every == 0, 1.0).otherwise((own - gone) / F.greatest(every, F.lit(1)))


def with_next(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, text, next_text: the text that follows in the order of doc_id, after the last the first.

    Rows go to ranges of doc_id; the first row of each range goes to the range before it as well. Ids that many rows share
    are ranged by a hash of their texts too, and their repeated rows travel once."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = rows.groupBy("doc_id").agg(F.count("*").alias("n"))
    total = ids.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    heavy = [r[0] for r in ids.where(F.col("n") > max(total // c.HEAVY, 1)).select("doc_id").collect()]  # at most HEAVY ids
    is_heavy = F.coalesce(F.col("doc_id").isin(*[x for x in heavy if x is not None]), F.lit(None in heavy)) if heavy else F.lit(False)
    rows = rows.withColumn("h", F.when(is_heavy, F.xxhash64("text")).otherwise(F.lit(0).cast("long")))
    place = F.struct("doc_id", "h")
    n_ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.select("doc_id", "h").repartitionByRange(n_ranges, "doc_id", "h")
    firsts = ranged.groupBy(F.spark_partition_id().alias("p")).agg(F.min(place).alias("place"))  # a row a range
    bounds = firsts.agg(F.sort_array(F.collect_set("place")).alias("bounds"))
    one = F.lit(1).cast("long")
    if heavy:
        rows = rows.where(~is_heavy).withColumn("copies", one).unionByName(rows.where(is_heavy).groupBy("doc_id", "h", "text").agg(F.count("*").alias("copies")))
    else:
        rows = rows.withColumn("copies", one)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(20))])
    found = F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get("bounds", at + s) <= place, at + s).otherwise(at))
    rows = rows.crossJoin(F.broadcast(bounds)).withColumn("range", found)
    own = F.struct(F.col("range").alias("range"), F.lit(False).alias("beyond"))
    before = F.struct(F.pmod(F.col("range") - 1, F.size("bounds")).alias("range"), F.lit(True).alias("beyond"))
    goes = F.when(F.get("bounds", F.col("range")) == place, F.array(own, before)).otherwise(F.array(own))
    rows = rows.select("doc_id", "h", "text", "copies", F.inline(goes)).repartition("range")
    follows = F.lead("text").over(Window.partitionBy("range").orderBy("beyond", "doc_id", "h", "text"))
    rows = rows.withColumn("next_text", follows).where("not beyond")
    if not heavy:
        return rows.select("doc_id", "text", "next_text")
    rows = rows.select("doc_id", "text", "next_text", "copies", F.explode(F.sequence(one, F.col("copies"))).alias("k"))
    return rows.select("doc_id", "text", F.when(F.col("k") < F.col("copies"), F.col("text")).otherwise(F.col("next_text")).alias("next_text"))
