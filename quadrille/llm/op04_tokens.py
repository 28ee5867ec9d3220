"""Token-ID output: frequency-ranked ids in a byte-aligned code with separate control bytes.

Frequent ids get small ranks. A rank takes one to four bytes, low byte first; two bits in a
control byte tell how many, four ranks to a control byte. Control bytes and data bytes stand
apart, so a reader turns a control byte into four lengths by one table lookup in numpy.

An output folder holds `ranks` (rank, id) and `blocks`, Parquet tables whose rows are blocks in
ascending order of doc_id: part (place of the file), block, doc_ids, lens (ids of each document),
control, data. Spark's commit makes the files of a lost or repeated task count once.

Defined results: null or empty texts have only the end id; a null doc_id sorts first; rows that
share a doc_id stand together in the order of their ids; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrille.llm import common as c

#: Ids in a block, if it has more than one document.
BLOCK_IDS = 1 << 19
#: Words are split by the tokenizer's own rule here; only the characters below U+0130 are taken this
#: way, as normal form C and lower case are settled for them one by one. All others go to the library whole.
_SPACE = "\t-\r \x85\xa0"
_PIECES = regex.compile(rf"\n|'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")
#: Pieces whose ids a worker keeps, about 100 bytes each.
KEPT = 300_000
_loaded: dict = {}
_known: dict = {}


def _byte_letters() -> dict[int, str]:
    """The letters by which byte-level vocabularies write bytes: printable ones as they are, others from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()


def tokenizer(file: str):
    if file not in _loaded:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import public_tokenizers
        from tokenizers import Tokenizer

        _loaded[file] = Tokenizer.from_file(file if Path(file).is_absolute() else public_tokenizers.path(file))
    return _loaded[file]


def _simple(words: pa.Array) -> np.ndarray:
    return np.asarray(pc.and_not(pc.match_substring_regex(words, r"^[\x{0}-\x{12F}]*$"), pc.match_substring(words, "<|")))


def _piece_ids(pieces: list[str], file: str) -> list:
    """The ids of pieces; a worker keeps those that it has seen, up to KEPT."""
    model, known = tokenizer(file).model, _known.setdefault(file, {})
    if len(known) > KEPT:
        known.clear()
    out = []
    for p in pieces:
        ids = known.get(p)
        if ids is None:
            ids = known[p] = np.array([t.id for t in model.tokenize(p if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(_LETTERS))], np.uint32).tobytes() if p != "\n" else b""
        out.append(ids)
    return out


def _cut(words: list[str], file: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of words of simple characters, lower-cased already."""
    pieces = pa.array(_PIECES.findall("\n".join(words)), pa.string()).dictionary_encode()
    seen = pieces.dictionary.to_pylist()
    ids = _piece_ids(seen, file)
    flat, off = np.frombuffer(b"".join(ids), np.uint32), np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids])))
    codes = np.asarray(pieces.indices, np.int64)
    got, ends = c.gather(flat, off, codes)
    breaks = ends[codes == seen.index("\n")] if len(words) > 1 else ends[:0]
    return got, np.concatenate(([0], breaks, [len(got)]))


def encode_words(words: pa.Array, file: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of each word. A text's ids are its words' ids in a row: the vocabulary drops
    white space, and neither its pieces nor its special strings reach over it."""
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    simple = _simple(words)
    if simple.all():
        return _cut(pc.utf8_lower(words).to_pylist(), file)
    some = words.filter(pa.array(simple))
    got, off = _cut(pc.utf8_lower(some).to_pylist(), file) if len(some) else (np.zeros(0, np.int64), np.zeros(1, np.int64))
    other, more = c.ragged([x.ids for x in tokenizer(file).encode_batch(words.filter(pa.array(~simple)).to_pylist(), add_special_tokens=False)])
    # Both kinds of words, back in their order.
    flat, both = np.concatenate((got, other)), np.concatenate((off, off[-1] + more[1:]))
    place = np.empty(len(words), np.int64)
    place[simple], place[~simple] = np.arange(len(some)), np.arange(len(some), len(words))
    ids, ends = c.gather(flat, both, place)
    return ids, np.concatenate(([0], ends))


_ENCODED = "doc_id long, ids binary, width int, counts binary"


def _encode(file: str, end_id: int):
    """Rows of documents, and as each task's last row how often it used each id."""

    def run(batches):
        size = max(tokenizer(file).get_vocab_size(), end_id + 1)
        kind, total = ("<u2", 2) if size <= 1 << 16 else ("<u4", 4), np.zeros(size, np.int64)
        for b in c.text_slices(batches, limit=4 * c.SLICE_BYTES):
            off, words = c.split_words(b.column("text"))
            codes, distinct = c.word_codes(words)
            flat, woff = encode_words(distinct, file)
            # The end id is one more word, after each document.
            codes = np.insert(codes, off[1:], len(distinct)).astype(np.int32)
            off = off + np.arange(len(off))
            flat, woff = np.append(flat, end_id).astype(kind[0]), np.append(woff, woff[-1] + 1)
            used = np.repeat(np.bincount(codes, minlength=len(distinct) + 1), np.diff(woff))
            total += np.bincount(flat, used, size).astype(np.int64)
            step = 0
            while step < b.num_rows:  # a few documents at a time bound the memory
                stop = max(int(np.searchsorted(off, off[step] + (1 << 19), side="right")) - 1, step + 1)
                stop = min(stop, b.num_rows)
                ids, ends = c.gather(flat, woff, codes[off[step] : off[stop]])
                cuts = kind[1] * np.concatenate(([0], ends))[off[step : stop + 1] - off[step]].astype(np.int32)
                raw, n = pa.Array.from_buffers(pa.binary(), stop - step, [None, pa.py_buffer(cuts), pa.py_buffer(ids)]), stop - step
                yield pa.record_batch([b.column("doc_id").slice(step, n), raw, pa.array(np.full(n, kind[1], np.int32)), pa.nulls(n, pa.binary())], names=_names(_ENCODED))
                step = stop
        if total.any():
            yield pa.record_batch([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int32()), pa.array([total.astype("<i8").tobytes()], pa.binary())], names=_names(_ENCODED))

    return run


def _names(fields: str) -> list[str]:
    return [f.split()[0] for f in fields.split(", ")]


def _count(batches):
    """The counts of a few tasks as rows, an id a row."""
    for b in batches:
        for x in b.column("counts"):
            n = np.frombuffer(x.as_buffer(), "<i8")
            at = np.flatnonzero(n)
            yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(n[at])], names=["id", "n"])


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit numbers."""
    v = np.ascontiguousarray(ranks, "<u4")
    size = 1 + (v > 0xFF) + (v > 0xFFFF) + (v > 0xFFFFFF)
    bits = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    bits[: len(v)] = size - 1
    bits = bits.reshape(-1, 4)
    control = bits[:, 0] | bits[:, 1] << 2 | bits[:, 2] << 4 | bits[:, 3] << 6
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


#: Control byte to four lengths.
_SIZES = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1
#: Length to the bits that count.
_MASK = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = _SIZES[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    ends = np.cumsum(size, dtype=np.int64)
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    at = ends - size
    v = raw[at].astype(np.uint32)
    for j in (1, 2, 3):
        v |= raw[at + j].astype(np.uint32) << np.uint32(8 * j)
    return v & _MASK[size]


_BLOCKS = "part int, block int, n_ids long, doc_ids array<bigint>, lens array<int>, control binary, data binary"


def _write(rank_of):
    def run(batches):
        rank, part, block = rank_of.value, TaskContext.get().partitionId(), 0
        docs, ids, held = [], [], 0

        def flush():
            flat = np.concatenate(ids)
            control, data = pack(rank[flat])
            cols = [[part], [block], [len(flat)], [docs], [[len(x) for x in ids]], [control], [data]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            return pa.record_batch([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], names=_names(_BLOCKS))

        for b in batches:
            for d, x, w in zip(b.column("doc_id").to_pylist(), b.column("ids"), b.column("width").to_pylist(), strict=True):
                docs.append(d)
                ids.append(np.frombuffer(x.as_buffer(), f"<u{w}"))
                held += len(ids[-1])
                if held >= BLOCK_IDS:
                    yield flush()
                    docs, ids, held, block = [], [], 0, block + 1
        if docs:
            yield flush()

    return run


def write_tokens(docs: DataFrame, path: str, file: str = "word_bpe_49k.json", end_id: int = 1) -> None:
    """Encode the texts of docs (doc_id, text) and write the ids to the folder `path`."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    encoded = c.cut(docs.mapInArrow(c.tidy(_encode(file, end_id)), _ENCODED), "token_ids")
    ranked = encoded.where("counts is not null").select("counts").mapInArrow(c.tidy(_count), "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    encoded_rows = encoded.where("counts is null").select("doc_id", "ids", "width")
    order = [r["id"] for r in ranked.orderBy(F.desc("n"), "id").collect()]  # at most the vocabulary
    rank = np.zeros(max(order, default=0) + 1, np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    spark.createDataFrame(list(enumerate(order)), "rank int, id int").coalesce(1).write.parquet(f"{path}/ranks")
    ordered = encoded_rows.repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id", "ids")
    c.write(ordered.mapInArrow(c.tidy(_write(spark.sparkContext.broadcast(rank))), _BLOCKS), f"{path}/blocks")
    c.drop_table(encoded)


def read_tokens(spark: SparkSession, path: str, each: Callable[[np.ndarray], object] | None = None, kind: pa.DataType | None = None, sql: str = "ids array<int>") -> DataFrame:
    """doc_id, start, n_tokens and `each` of a document's ids (by default the ids), from the files.

    start: ids of all documents before it."""
    order = np.array([r["id"] for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()], np.int32)
    ids_of = spark.sparkContext.broadcast(order)
    kind, name = kind or pa.list_(pa.int32()), sql.split()[0]
    each = each or (lambda x: x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                lens = np.asarray(b.column("lens")[r].values, np.int64)
                ends = np.cumsum(lens)
                ids = ids_of.value[unpack(b.column("control")[r].as_py(), b.column("data")[r].as_py(), int(ends[-1]))]
                got = [each(ids[e - n : e]) for e, n in zip(ends.tolist(), lens.tolist(), strict=True)]
                yield pa.record_batch(
                    [b.column("doc_ids")[r].values, pa.array(ends - lens + b.column("base")[r].as_py()), pa.array(lens), pa.array(got, kind)],
                    names=["doc_id", "start", "n_tokens", name],
                )

    blocks = spark.read.parquet(f"{path}/blocks")
    # Two steps keep each ordered group small: files (one row each) and the blocks of one file.
    files = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("file_base"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    at = blocks.select("part", "block", "n_ids").withColumn("in_file", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(files, "part")
    at = at.select("part", "block", (F.col("file_base") + F.col("in_file")).alias("base"))
    return blocks.join(at, ["part", "block"]).select("base", "doc_ids", "lens", "control", "data").mapInArrow(c.tidy(run), f"doc_id long, start long, n_tokens long, {sql}")


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))


def token_digests(docs: DataFrame, file: str = "word_bpe_49k.json") -> DataFrame:
    """Write docs' ids to the shared folder, read them back: doc_id, start, n_tokens, ids_crc32."""
    path = c.scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, file)
    return read_tokens(docs.sparkSession, path, crc32, pa.int64(), "ids_crc32 long")
