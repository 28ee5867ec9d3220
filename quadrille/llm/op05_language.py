"""Language ID by Bayesian evidence fusion.

Evidence for each language: the likelihood of the text's byte trigrams (naive Bayes, tempered, as
neighbouring trigrams say much the same), the language that the markup declares, a country suffix
of the address, and a prior of the host. Priors are smoothed down a hierarchy, all rows, suffix,
domain, host, by grouped sums of the texts' posteriors; a row's own text is left out of its host's
prior. One more class, `und`, has a uniform text model and stands for none of the languages.

The trigram counts come from a seeded sample of labelled rows, about `max_rows` a language
at most. Every labelled language is a class; the model takes 256 KB a language in the driver and in a
task, and no plan grows with their number. All rows are scored whole.

Where a row's label is what the model learns from, as with documents, it is not also read as a
declaration: `from_documents` leaves it out unless asked.

Defined results: null or empty texts have no text evidence; null declarations, suffixes and hosts
say nothing (their rows share one host); repeated rows each count; a null doc_id is a row like any
other; without labelled rows everything is `und`; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm import common as c

BITS = 16
#: Languages that a task holds counts of at one time.
HELD = 64
#: Trigrams that a text counts for at most.
TEXT_WEIGHT = 40.0
#: Share of trigrams that no language explains: numbers, keys, names.
ODD = 0.3
#: Chance that a declaration, or a country suffix, is wrong; rows that a parent's prior counts for.
DECLARED_WRONG, SUFFIX_WRONG, PRIOR_ROWS = 0.1, 0.3, 20.0
#: Least posterior of a row that is kept.
LEAST = 0.5
#: Country suffixes and the main language there. Fixed values.
SUFFIX_LANGUAGE = {"at": "de", "ar": "es", "au": "en", "br": "pt", "cl": "es", "cn": "zh", "co": "es", "de": "de", "es": "es", "fr": "fr", "gb": "en", "ie": "en", "it": "it", "jp": "ja", "kr": "ko", "mx": "es", "nl": "nl", "nz": "en", "pe": "es", "pl": "pl", "pt": "pt", "ru": "ru", "uk": "en", "us": "en"}


def _tag(name: str) -> Column:
    """The language of a tag such as en-US or pt_BR; blank for null."""
    tag = F.coalesce(F.lower(F.col(name).cast("string")), F.lit(""))
    return F.substring_index(F.regexp_replace(tag, "_", "-"), "-", 1)


def _trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of the trigram at each byte, offsets)."""
    low = pc.utf8_lower(pc.fill_null(texts, ""))
    low = pa.concat_arrays([low])  # offsets from 0
    n = len(low)
    off = np.frombuffer(low.buffers()[1], np.int32, n + 1, low.offset * 4).astype(np.int64)
    raw = np.frombuffer(low.buffers()[2], np.uint8)[: off[-1]] if off[-1] else np.zeros(0, np.uint8)
    raw = np.concatenate((raw, np.zeros(2, np.uint8))).astype(np.uint32)
    code = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
    return (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS), off


def _count(place: dict):
    def rows(total: dict):
        for k, n in total.items():
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([n.astype("<i8").tobytes()], pa.binary())], names=["k", "counts"])

    def run(batches):
        total = {}
        for b in c.text_slices(batches, limit=1 << 20):
            code, off = _trigrams(b.column("text"))
            for lang, x, y in zip(b.column("lang").to_pylist(), off[:-1].tolist(), off[1:].tolist(), strict=True):
                if y - x > 2:
                    if place[lang] not in total and len(total) == HELD:
                        yield from rows(total)
                        total = {}
                    n = total.setdefault(place[lang], np.zeros(1 << BITS, np.int64))
                    n += np.bincount(code[x : y - 2], minlength=1 << BITS)
        yield from rows(total)

    return run


def _add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, k = np.zeros(1 << BITS, np.int64), None
    for b in batches:
        k = b.column("k").slice(0, 1) if k is None else k
        for x in b.column("counts"):
            total += np.frombuffer(x.as_buffer(), "<i8")
    yield pa.record_batch([k, pa.array([total.astype("<i8").tobytes()], pa.binary())], names=["k", "counts"])


def train(labelled: DataFrame, max_rows: int = 5000, seed: int = 0) -> tuple[list[str], np.ndarray]:
    """labelled: doc_id, text, lang. Returns the languages and log probabilities (language, bucket), the last for `und`."""
    labelled = labelled.where("lang is not null and text is not null").select("doc_id", "text", _tag("lang").alias("lang")).where("lang <> ''")
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # a row a language
    langs = sorted(sizes)
    out = np.full((len(langs) + 1, 1 << BITS), -BITS * math.log(2), np.float32)
    if not langs:
        return langs, out
    share = F.create_map(*[x for g, n in sizes.items() for x in (F.lit(g), F.lit(int(min(1.0, max_rows / n) * (1 << 20))))])
    pick = F.pmod(F.xxhash64("doc_id", F.xxhash64("text"), F.lit(seed), F.lit("lang")), F.lit(1 << 20)) < F.try_element_at(share, "lang")
    place = {x: i for i, x in enumerate(langs)}
    counted = labelled.where(pick).select("text", "lang").mapInArrow(c.tidy(_count(place)), "k int, counts binary").groupBy("k").applyInArrow(_add_counts, "k int, counts binary")
    out[:-1] = math.log((1 - ODD) / (1 << BITS) + ODD / (1 << BITS))  # a language whose texts have no trigrams
    for r in counted.toLocalIterator():  # a row a language
        n = np.frombuffer(r["counts"], "<i8") + 0.1
        out[r["k"]] = np.log((1 - ODD) * n / n.sum() + ODD / (1 << BITS))
    return langs, out


def _score(model, n_classes: int, extra: list[str]):
    def run(batches):
        logp = model.value
        for b in c.text_slices(batches, limit=1 << 20):
            code, off = _trigrams(b.column("text"))
            n = np.maximum(np.diff(off) - 2, 0)
            full = np.flatnonzero(n)
            like = np.zeros((b.num_rows, n_classes))
            ends = off[1:] - 2
            inside = np.zeros(len(code) + 1, np.int8)
            inside[off[:-1][full]] += 1
            inside[ends[full]] -= 1
            live = code[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
            if len(full):
                at = np.concatenate(([0], np.cumsum(n[full])[:-1]))
                for k in range(n_classes):
                    like[full, k] = np.add.reduceat(logp[k][live], at, dtype=np.float64)
            like *= np.minimum(1.0, TEXT_WEIGHT / np.maximum(n, 1))[:, None]
            post = np.exp(like - like.max(axis=1, keepdims=True))
            post /= post.sum(axis=1, keepdims=True)
            row = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, n_classes, dtype=np.int32)), pa.array(m.ravel()))
            yield pa.record_batch([*(b.column(x) for x in extra), pa.array(n), row(like), row(post)], names=[*extra, "n_trigrams", "text_log", "text_post"])

    return run


def identify(rows: DataFrame, langs: list[str], logp: np.ndarray, keys: str = "doc_id long") -> DataFrame:
    """rows: the key columns, text, declared, suffix, domain, host. Returns the keys, language,
    confidence, kept, text_language, n_trigrams."""
    spark, classes = rows.sparkSession, [*langs, "und"]
    names = [k.split()[0] for k in keys.split(", ")]
    extra = [*names, "declared", "suffix", "domain", "host"]
    blank = lambda x: F.coalesce(F.lower(F.col(x).cast("string")), F.lit(""))
    rows = rows.select(*names, F.col("text").cast("string").alias("text"), _tag("declared").alias("declared"), *[blank(x).alias(x) for x in extra[-3:]])
    kinds = f"{keys}, declared string, suffix string, domain string, host string, n_trigrams long, text_log array<double>, text_post array<double>"
    model = spark.sparkContext.broadcast(logp)
    scored = c.cut(rows.mapInArrow(c.tidy(_score(model, len(classes), extra)), kinds), "language_text")

    # Sums of posteriors at each level, from the level below, a row a class; empty texts know nothing.
    n_classes, site = len(classes), ["suffix", "domain", "host"]
    mass = scored.where("n_trigrams > 0").select(*site, F.posexplode("text_post").alias("k", "p"))
    hosts = c.cut(mass.groupBy(*site, "k").agg(F.sum("p").alias("s")), "language_hosts")
    vector = lambda m: F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)), lambda k: F.coalesce(F.try_element_at(m, k), F.lit(0.0)))

    def sums(*keys: str) -> DataFrame:
        """A vector of sums for each key: an entry a class."""
        return hosts.groupBy(*keys, "k").agg(F.sum("s").alias("s")).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("k", "s"))).alias("m")).select(*keys, vector("m").alias("sums"))

    norm = lambda a: F.transform(a, lambda x: x / F.aggregate(a, F.lit(0.0), lambda s, y: s + y))
    smooth = lambda s, p: norm(F.zip_with(s, p, lambda x, y: F.greatest(x, F.lit(0.0)) + PRIOR_ROWS * y))
    words = lambda names: F.split(F.lit("\n".join(names)), "\n")
    every = np.ones(n_classes)
    for r in hosts.groupBy("k").agg(F.sum("s").alias("s")).collect():  # a row a class
        every[r["k"]] += r["s"]
    level = words([repr(float(x)) for x in every / every.sum()]).cast("array<double>")
    suffixes = sums("suffix").select("suffix", smooth(F.col("sums"), level).alias("p"))
    domains = sums("suffix", "domain").join(suffixes, "suffix").select("suffix", "domain", smooth(F.col("sums"), F.col("p")).alias("p"))
    known = sums(*site).join(domains, ["suffix", "domain"]).select(*site, F.col("sums").alias("host_sum"), F.col("p").alias("domain_prior"))
    # Hosts of empty texts only have the prior of all. A host may hold a third of all rows.
    sizes = scored.groupBy(*site).agg(F.count("*").alias("n"))
    j = c.join_counted(scored, c.cut(sizes.join(known, site, "left"), "language_priors"), site, [*names, "n_trigrams"])
    none = F.array_repeat(F.lit(0.0), n_classes)
    own = F.when(F.col("n_trigrams") > 0, F.col("text_post")).otherwise(none)
    j = j.withColumn("prior", smooth(F.zip_with(F.coalesce("host_sum", none), own, lambda a, b: a - b), F.coalesce("domain_prior", level)))

    def says(place: Column, wrong: float, k: Column) -> Column:
        """Log likelihood of a statement about the language, for class k; one that names no known class says nothing."""
        return F.when(place == 0, 0.0).when(place == k + 1, math.log(1 - wrong)).otherwise(math.log(wrong / max(len(langs), 1)))

    country = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SUFFIX_LANGUAGE.items() for x in kv]), F.col("suffix")), F.lit(""))
    place = lambda x: F.array_position(words(langs), x).cast("int") if langs else F.lit(0)
    j = j.withColumn("says", F.struct(place(F.col("declared")).alias("declared"), place(country).alias("country")))
    total = F.transform(F.arrays_zip("text_log", "prior"), lambda x, k: x["text_log"] + F.log(x["prior"]) + says(F.col("says.declared"), DECLARED_WRONG, k) + says(F.col("says.country"), SUFFIX_WRONG, k))
    j = j.withColumn("total", total)
    best = F.array_position("total", F.array_max("total")).cast("int")
    weight = F.aggregate(F.transform("total", lambda x: F.exp(x - F.array_max("total"))), F.lit(0.0), lambda s, x: s + x)
    named = lambda at: F.element_at(words(classes), at)
    out = j.select(*names, named(best).alias("language"), (1 / weight).alias("confidence"), named(F.array_position("text_post", F.array_max("text_post")).cast("int")).alias("text_language"), "n_trigrams")
    return out.withColumn("kept", (F.col("language") != "und") & (F.col("confidence") >= LEAST))


def from_documents(docs: DataFrame, declared: bool = False) -> DataFrame:
    """Documents as rows: their source is the host; their language column is a declaration only if asked, as it is also the label."""
    null = F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (F.col("lang") if declared else null).alias("declared"), null.alias("suffix"), F.lit("documents").alias("domain"), F.col("source").alias("host"))


def from_pages(pages: DataFrame) -> DataFrame:
    """Web pages as rows: text without markup, the html tag's language, parts of the address."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z]+://(?:[^/@]*@)?([^/:?#]+)", 1))
    html = F.coalesce("html", F.lit(""))
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?\w+;", " ")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), text.alias("text"), F.regexp_extract(html, r"(?i)<html[^>]*?\slang\s*=\s*[\"']?([A-Za-z-]+)", 1).alias("declared"), host.alias("host"))
    parts = F.split("host", r"\.")
    return pages.select("page_id", "text", "declared", F.element_at(parts, -1).alias("suffix"), F.array_join(F.slice(parts, -F.least(F.size(parts), F.lit(2)), 2), ".").alias("domain"), "host")
