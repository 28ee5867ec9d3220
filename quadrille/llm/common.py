"""Helpers shared by the text operators: scratch tables, words, ragged arrays, hashes."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
_libc = ctypes.CDLL(None)
#: Text bytes that a task holds as words at one time.
SLICE_BYTES = 3 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        raise ValueError("spark.checkpoint.dir must name, when the session starts, a folder that the driver and all executors share")
    path = f"{top.rstrip('/')}/{re.sub('[^A-Za-z0-9]+', '_', name)}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


#: While a table is written: Spark removes the execution's shuffle files when it ends, and hands Python fewer rows at a
#: time than its 10,000 (33 MB of documents of 600 words, and as much again twice while the buffers grow).
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and return the written table.

    Later jobs read it instead of computing it anew, also when an executor is lost. The
    shuffle files behind df are not needed any more then, so they go at once.
    """
    path = scratch_path(df.sparkSession, name)
    write(df, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def write(df: DataFrame, path: str) -> None:
    conf = df.sparkSession.conf
    before = {k: conf.get(k, None) for k in _WRITING}
    for k, v in _WRITING.items():
        conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


def drop_table(df: DataFrame) -> None:
    """Delete a table made by cut() that no later plan reads."""
    spark = df.sparkSession
    jpath = spark._jvm.org.apache.hadoop.fs.Path(df.scratch)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


#: A key with over 1 / HEAVY of all rows is dealt out to SALTS tasks; there are at most HEAVY of them.
HEAVY, SALTS = 1000, 64


def join_counted(rows: DataFrame, groups: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Inner join of rows with a written table that has a row a key and n, the rows of that key.

    Rows of a heavy key are dealt out by the columns `by`, and meet a copy of their group in each task."""
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    is_heavy = F.col("n") > max(total // HEAVY, 1)
    heavy = groups.where(is_heavy).select(*keys, F.lit(True).alias("heavy"))  # at most HEAVY rows
    salt = F.when(F.col("heavy"), F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    dealt = rows.join(F.broadcast(heavy), keys, "left").withColumn("salt", salt).drop("heavy")
    copies = groups.withColumn("salt", F.explode(F.when(is_heavy, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(copies, [*keys, "salt"]).drop("salt")


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def tidy(run):
    """A function for mapInArrow that gives its memory back to the machine when its task ends.

    Spark keeps Python workers for later tasks, and what they have freed would stay with them."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Join and cut batches so that a slice has about `limit` bytes of text, or one row."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= limit:
            yield from _cut_rows(held, column, limit)
            held, size = [], 0
    yield from _cut_rows(held, column, limit)


def _cut_rows(held: list[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    held = [b for b in held if b.num_rows]
    for batch in pa.Table.from_batches(held).combine_chunks().to_batches() if len(held) > 1 else held:
        n = batch.num_rows
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64).cumsum()
        start = 0
        while start < n:
            before = size[start - 1] if start else 0
            stop = max(int(np.searchsorted(size, before + limit, side="right")), start + 1)
            yield batch.slice(start, stop - start)
            start = stop


def split_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, pa.Array]:
    """(offsets, words): the words of text i are words[offsets[i]:offsets[i + 1]]; null has none."""
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    words, off = lists.flatten(), np.asarray(lists.offsets, dtype=np.int64)
    off = off - off[0]
    real = np.asarray(pc.greater(pc.binary_length(words), 0))
    if not real.all():  # white space at either end leaves an empty piece
        words = words.filter(pa.array(real))
        off = np.concatenate(([0], np.cumsum(real)))[off]
    return off, words


def word_codes(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(codes, distinct words)."""
    d = words.dictionary_encode()
    return np.asarray(d.indices, dtype=np.int64), d.dictionary


def word_hashes(distinct: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word, the same in every task."""
    if not len(distinct):
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(distinct.to_numpy(zero_copy_only=False), categorize=False)


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambler of 64-bit integers."""
    with np.errstate(over="ignore"):
        h = h + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % (1 << 64))
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gram_hashes(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of each k consecutive entries of h, by the position of the first; ends are padded with 0."""
    n = len(h)
    out = np.zeros(n, np.uint64)
    if n < k:
        return out
    m = n - k + 1
    acc = np.zeros(m, np.uint64)
    prime = np.uint64(0x100000001B3 + 2 * seed)
    with np.errstate(over="ignore"):
        for j in range(k):
            acc = acc * prime + h[j : j + m]
    out[:m] = mix(acc, k + 64 * seed)
    return out


def gather(flat: np.ndarray, off: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate the pieces flat[off[c]:off[c + 1]] for c in codes; the second result has each piece's end."""
    lens = (off[codes + 1] - off[codes]).astype(np.int32)
    ends = np.cumsum(lens, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    idx = np.repeat((off[codes] - (ends - lens)).astype(np.int32), lens)
    idx += np.arange(total, dtype=np.int32)
    return flat[idx], ends


def ragged(lists: list) -> tuple[np.ndarray, np.ndarray]:
    """(flat values, offsets) of lists of integers."""
    off = np.concatenate(([0], np.cumsum([len(x) for x in lists], dtype=np.int64)))
    return np.fromiter((i for x in lists for i in x), dtype=np.int64, count=int(off[-1])), off


def as_long(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h).view(np.int64)
