"""Tokeniser fertility: how public vocabularies cut a text, with rejection bands per language or script.

Two public vocabularies cut each text: a byte-level one the whole text with its white space, a piece one the
words of the text joined by single spaces (it would show line breaks as byte fallback). Each distinct word
of a slice is cut into pieces once. A document's figures are characters per token (both), the share of
tokens that stand for single bytes (byte fallback) and the entropy of its token distribution. A
group's bands come from all its documents that pass the base rules: quartiles, widened by a multiple of
the distance between them, from counts of values in steps of 1 / `STEPS`, so that they are the same in any
order and partitioning. The fewer documents a group has, the more its bands open towards those of
all documents in the same script, where these reach further, and very few reject next to nothing. So
no group is judged by the figures of another script, and nothing jumps at a group size. A group is the
declared language, or the main script of the letters where none is declared.

Defined results: null or empty texts have no words and fail the base rules; a null language is
grouped by script; a null doc_id or a repeated row is a row like any other; other columns are ignored.
"""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm import common as c

#: Documents that a group needs for bands of its own alone; with fewer than the second, all bands reach further in proportion.
MIN_GROUP, FEW = 100, 20
#: Distances between the quartiles that a band reaches beyond them, and the least such distance as a share of the median.
REACH, LEAST = 4.0, 0.08
#: Steps of 1 in which values are counted.
STEPS = 10_000
_loaded: dict = {}

#: First code points of scripts, ascending; letters below the first are Latin.
SCRIPTS = ((0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "other"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0780, "other"), (0x0900, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x4E00, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"))


def _vocabularies(piece_file: str, byte_file: str):
    if (piece_file, byte_file) not in _loaded:
        import base64

        import public_tokenizers
        import sentencepiece
        import tiktoken

        at = lambda f: f if Path(f).is_absolute() else public_tokenizers.path(f)
        sp = sentencepiece.SentencePieceProcessor(model_file=at(piece_file))
        with open(at(byte_file), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        enc = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        is_byte = np.array([sp.IsByte(i) for i in range(sp.GetPieceSize())])
        _loaded[piece_file, byte_file] = sp, enc, is_byte
    return _loaded[piece_file, byte_file]


def _script(text: str) -> str:
    """The script with the most letters."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    letters = points[(points > 0x7F) | ((points | 32) >= 97) & ((points | 32) <= 122)]
    if not len(letters):
        return "none"
    at = np.searchsorted([s for s, _ in SCRIPTS], letters, side="right") - 1
    n: dict[str, int] = {}
    for i, k in zip(*np.unique(at, return_counts=True), strict=True):
        n[SCRIPTS[i][1]] = n.get(SCRIPTS[i][1], 0) + int(k)
    return max(sorted(n), key=n.__getitem__)


def _repeated(codes: np.ndarray, kinds: int) -> int:
    """Words in 3-word windows that occur twice or more."""
    n = len(codes)
    if n < 4:
        return 0
    if kinds >= 1 << 20:
        codes, kinds = np.unique(codes, return_inverse=True)[1], n
    if kinds < 1 << 20:
        keys = (codes[:-2] * kinds + codes[1:-1]) * kinds + codes[2:]
    else:
        pairs = np.unique(codes[:-1] * kinds + codes[1:], return_inverse=True)[1]
        keys = pairs[:-1] * kinds + codes[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    if not same.any():
        return 0
    hit = np.zeros(n, bool)
    for side in (order[1:][same], order[:-1][same]):
        for j in range(3):
            hit[side + j] = True
    return int(hit.sum())


def _duplicate_lines(text: bytes) -> int:
    if b"\n" not in text:
        return 0
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_FIELDS = "doc_id long, lang string, script string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, text_chars long, piece_tokens long, byte_tokens long, fallback_share double, entropy double"


def _measure(piece_file: str, byte_file: str):
    def run(batches):
        sp, enc, is_byte = _vocabularies(piece_file, byte_file)
        for b in c.text_slices(batches, limit=2 * c.SLICE_BYTES):
            texts = pc.fill_null(b.column("text"), "")
            off, words = c.split_words(texts)
            codes, distinct = c.word_codes(words)
            names = distinct.to_pylist()
            flat, woff = c.ragged(sp.encode(names, num_threads=1))
            chars = np.asarray(pc.utf8_length(distinct), np.int64)
            fall = np.concatenate(([0], np.cumsum(is_byte[flat])))
            total = lambda v: np.diff(np.concatenate(([0], np.cumsum(v[codes])))[off])
            columns = [np.diff(off), total(chars)]
            symbols, dup, rep, entropy, group, scripts, byte_n = [], [], [], [], [], [], []
            langs = b.column("lang").to_pylist()
            for i, (x, y) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
                raw = texts[i].as_buffer()
                symbols.append(int(_SYMBOL[np.frombuffer(raw, np.uint8)].sum()))
                dup.append(_duplicate_lines(raw.to_pybytes()))
                own = codes[x:y]
                rep.append(_repeated(own, len(names)))
                ids, _ = c.gather(flat, woff, own)
                if len(ids):
                    ids.sort()
                    n = np.diff(np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1], [True]))))
                    entropy.append(float(np.log2(len(ids)) - (n * np.log2(n)).sum() / len(ids)))
                else:
                    entropy.append(0.0)
                text = texts[i].as_py()
                byte_n.append(len(enc.encode_ordinary(text)))
                scripts.append(_script(text))
                group.append(langs[i] if langs[i] is not None else f"script:{scripts[-1]}")
            pieces = total(np.diff(woff))
            share = total(np.diff(fall[woff])) / np.maximum(pieces, 1)
            columns += [symbols, dup, rep, np.asarray(pc.utf8_length(texts), np.int64), pieces, byte_n, share, entropy]
            yield pa.record_batch([b.column("doc_id"), pa.array(group, pa.string()), pa.array(scripts, pa.string()), *(pa.array(x) for x in columns)], names=[f.split()[0] for f in _FIELDS.split(", ")])

    return run


#: Measure, whether a low and whether a high value is out of band.
MEASURES = (("piece_chars", True, True), ("byte_chars", True, True), ("fallback_share", False, True), ("entropy_share", True, False))


def fertility(docs: DataFrame, piece_file: str = "piece_bpe_32k.model", byte_file: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """docs: doc_id, text, lang. Returns the base measures, the fertility measures, base_failed, out_of_band, kept.

    piece_chars, byte_chars: characters per token; entropy_share: token entropy in bits, as a share
    of the most that so many tokens could have."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    m = c.cut(docs.mapInArrow(c.tidy(_measure(piece_file, byte_file)), _FIELDS), "fertility")
    m = (
        m.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
        .withColumn("piece_chars", F.col("word_chars") / F.greatest("piece_tokens", F.lit(1)))
        .withColumn("byte_chars", F.col("text_chars") / F.greatest("byte_tokens", F.lit(1)))
        .withColumn("entropy_share", F.when(F.col("piece_tokens") > 1, F.col("entropy") / F.log2("piece_tokens")).otherwise(0.0))
    )
    # Counts of all good documents' values, a row a group and value.
    values = F.array(*[F.struct(F.lit(i).alias("i"), F.round(F.col(name) * STEPS).cast("long").alias("v")) for i, (name, _, _) in enumerate(MEASURES)])
    counts = m.where("not base_failed").select("lang", "script", F.explode(values).alias("x")).groupBy("lang", "script", "x.i", "x.v").agg(F.count("*").alias("n"))
    counts = c.cut(counts, "fertility_counts")

    def bands(by: str) -> DataFrame:
        """Both ends of each measure's band. The written table is small, or joined by a shuffle where it is not."""
        up = Window.partitionBy(by, "i").orderBy("v")
        own = counts.groupBy(by, "i", "v").agg(F.sum("n").alias("n")).select(by, "i", "v", F.sum("n").over(up).alias("upto"), F.sum("n").over(Window.partitionBy(by, "i")).alias("docs"))
        q = own.groupBy(by, "i").agg(F.first("docs").alias("docs"), *[(F.min(F.when(4 * F.col("upto") >= k * F.col("docs"), F.col("v"))) / STEPS).alias(f"q{k}") for k in (1, 2, 3)])
        wide = REACH * F.greatest(F.lit(1.0), FEW / F.col("docs")) * F.greatest(F.col("q3") - F.col("q1"), F.lit(LEAST) * F.col("q2"), F.lit(0.01))
        q = q.select(by, "i", "docs", (F.col("q1") - wide).alias("low"), (F.col("q3") + wide).alias("high"))
        pick = lambda x, i: F.max(F.when(F.col("i") == i, F.col(x)))
        ends = [pick(x, i).alias(f"{by}_{x}_{name}") for i, (name, _, _) in enumerate(MEASURES) for x in ("low", "high")]
        return c.cut(q.groupBy(by).agg(F.first("docs").alias(f"{by}_docs"), *ends), "fertility_bands")

    m = m.join(bands("lang"), "lang", "left").join(bands("script"), "script", "left")
    lacks = F.greatest(1 - F.col("lang_docs") / MIN_GROUP, F.lit(0.0))
    out = F.lit(False)
    for name, low, high in MEASURES:
        least = F.coalesce(F.col(f"lang_low_{name}") - lacks * F.greatest(F.col(f"lang_low_{name}") - F.col(f"script_low_{name}"), F.lit(0.0)), f"script_low_{name}")
        most = F.coalesce(F.col(f"lang_high_{name}") + lacks * F.greatest(F.col(f"script_high_{name}") - F.col(f"lang_high_{name}"), F.lit(0.0)), f"script_high_{name}")
        out = out | (F.col(name) < least if low else F.lit(False)) | (F.col(name) > most if high else F.lit(False))
    m = m.withColumn("out_of_band", F.coalesce(out, F.lit(False))).withColumn("kept", ~F.col("base_failed") & ~F.col("out_of_band"))
    return m.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "out_of_band", "piece_chars", "byte_chars", "fallback_share", "entropy", "entropy_share")
