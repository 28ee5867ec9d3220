"""Quality classifier by co-training: a view of the text and a view of the page's metadata.

Each view is a logistic regression. In each round a view labels the pool rows of which it is surest, and
the other view learns from them; rows that were used leave the pool. A fifth of the labelled rows is held
out from the choice of words and from the fit: on it each view's score is calibrated, and a small
regression combines the calibrated views. Two targets are learnt: quality and toxicity.

Training uses seeded samples of about `max_labelled` labelled and `max_pool` other rows, whose words are
counted on Spark; the driver gets these rows with the chosen words only (`WORDS` a target at most), however long
the texts are. Every row is scored, over its whole text. If more rows have labels, they are drawn for each
target and kind, rare kinds first, and weigh as many rows as they stand for.

Defined results: null or empty texts have no words; null metadata is a value of its own; rows of
labels that share a doc_id count as their largest values; labels of unknown documents and null
labels are ignored; if a target has labels of one kind only, its score is that kind's; with under
`LEAST_LABELS` labels of both kinds, or none, the target keeps all; with a single label of a kind its
score is the share of ones; repeated rows are scored alike; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm import common as c

TARGETS = ("quality", "toxic")
#: Words chosen for each target at most, documents of the sample that a word needs, and standard
#: deviations by which its share must differ between the labels (many words are tried).
WORDS, LEAST_DOCS, LEAST_Z = 1500, 8, 5.0
ROUNDS, SURE = 3, 100
LEAST_LABELS = 10
META = 160
_STATS = 8
_FIELDS = "row long, doc_id long, quality int, toxic int, stands double, words array<bigint>, stats array<float>, meta array<int>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>@{}[]\\^~_=+")] = True


def _features(b: pa.RecordBatch):
    """(hashes of the stripped words, their codes by place, offsets, stats, meta features)."""
    texts = pc.fill_null(b.column("text"), "")
    off, words = c.split_words(texts)
    codes, distinct = c.word_codes(words)
    bare = pc.utf8_lower(pc.replace_substring_regex(distinct, r"^[^\pL\pN]+|[^\pL\pN]+$", ""))
    h = c.word_hashes(bare)
    n = np.diff(off)
    rows = len(n)
    doc = np.repeat(np.arange(rows), n)
    chars = np.bincount(doc, np.asarray(pc.utf8_length(distinct), float)[codes], rows) if len(codes) else np.zeros(rows)
    pairs = np.unique(doc * max(len(distinct), 1) + codes)
    kinds = np.bincount(pairs // max(len(distinct), 1), minlength=rows) if len(codes) else np.zeros(rows)
    sym, lines, uniq = np.zeros(rows), np.zeros(rows), np.zeros(rows)
    for i in range(rows):
        raw = texts[i].as_buffer().to_pybytes()
        sym[i] = _SYMBOL[np.frombuffer(raw, np.uint8)].sum()
        parts = raw.split(b"\n")
        lines[i], uniq[i] = len(parts), len(set(parts))
    some = np.maximum(n, 1)
    log = np.log1p(n)
    stats = np.stack([log / 10, (log / 7) ** 2, np.minimum(sym / some, 2), kinds / some, np.minimum(chars / some / 10, 5), uniq / np.maximum(lines, 1), np.log1p(lines) / 10, n < 50], axis=1).astype(np.float32)
    col = lambda x: pd_hash(b.column(x))
    size = np.minimum(np.log2(1 + np.asarray(pc.fill_null(b.column("n_chars"), 0), float).clip(0)), 31).astype(np.int64)
    meta = np.stack([col("source") % 64, 64 + col("lang") % 64, 128 + size], axis=1)
    return h, codes, off, stats, meta


def pd_hash(values: pa.Array) -> np.ndarray:
    codes, distinct = c.word_codes(pc.fill_null(values, "\0null"))
    return (c.word_hashes(distinct) >> np.uint64(1)).astype(np.int64)[codes]


def _collect(batches):
    for b in c.text_slices(batches):
        h, codes, off, stats, meta = _features(b)
        words = [c.as_long(np.unique(h[codes[x:y]])) for x, y in zip(off[:-1], off[1:], strict=True)]
        yield pa.record_batch([*(b.column(x) for x in ("row", "doc_id", *TARGETS, "stands")), pa.array(words, pa.list_(pa.int64())), pa.array(list(stats), pa.list_(pa.float32())), pa.array([list(m) for m in meta], pa.list_(pa.int32()))], names=[f.split()[0] for f in _FIELDS.split(", ")])


class Sparse:
    """Rows of features: sorted places with values."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], width: int):
        self.n, self.width = len(rows), width
        self.row = np.repeat(np.arange(self.n), [len(a) for a, _ in rows])
        self.at = np.concatenate([a for a, _ in rows]).astype(np.int64) if rows else np.zeros(0, np.int64)
        self.v = np.concatenate([v for _, v in rows]).astype(np.float64) if rows else np.zeros(0)

    def dot(self, w):
        return np.bincount(self.row, self.v * w[self.at], self.n)

    def back(self, r):
        return np.bincount(self.at, self.v * r[self.row], self.width)

    def take(self, keep):
        out = object.__new__(Sparse)
        place = np.full(self.n, -1)
        place[keep] = np.arange(len(keep))
        live = place[self.row] >= 0
        out.n, out.width, out.row, out.at, out.v = len(keep), self.width, place[self.row][live], self.at[live], self.v[live]
        return out


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fit(x: Sparse, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, turns: int = 200, rate: float = 0.1) -> np.ndarray:
    """Logistic regression by Adam over all rows. The last weight is the bias."""
    w, m, s = (np.zeros(x.width + 1) for _ in range(3))
    weight = weight / weight.sum()
    for t in range(1, turns + 1):
        r = weight * (_sigmoid(x.dot(w[:-1]) + w[-1]) - y)
        g = np.append(x.back(r) + ridge * w[:-1], r.sum())
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return w


def _column(*z):
    return Sparse([(np.arange(len(z)), np.array(r)) for r in zip(*z, strict=True)], len(z))


def _folds(y: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(held, base): the places of labelled rows, a fifth of each kind held out; both sides hold both kinds."""
    rng, held, base = np.random.default_rng(seed), [], []
    for kind in (0, 1):
        order = rng.permutation(np.flatnonzero(y == kind))
        n = max(len(order) // 5, 1)
        held.append(order[:n])
        base.append(order[n:])
    return np.concatenate(held), np.concatenate(base)


def cotrain(text: Sparse, meta: Sparse, y: np.ndarray, held: np.ndarray, base: np.ndarray, weight: np.ndarray | None = None) -> dict:
    """y: 0, 1, or -1 for rows of the pool. weight: the rows that each row stands for."""
    pool = np.flatnonzero(y < 0)
    weight = np.ones(len(y)) if weight is None else weight / weight[y >= 0].mean()
    learn = {v: (base, y[base].astype(float), weight[base]) for v in ("text", "meta")}
    views, weights = {"text": text, "meta": meta}, {}
    for turn in range(ROUNDS + 1):
        for v, x in views.items():
            rows, target, how = learn[v]
            weights[v] = _fit(x.take(rows), target, how)
        if not len(pool) or turn == ROUNDS:
            break
        used = []
        for v, other in (("text", "meta"), ("meta", "text")):
            z = views[v].take(pool).dot(weights[v][:-1]) + weights[v][-1]
            by = np.argsort(z, kind="stable")
            k = min(SURE, len(pool) // 4)
            low, high = by[:k][z[by[:k]] < -2], by[len(by) - k :][z[by[len(by) - k :]] > 2]
            picked = np.concatenate((pool[low], pool[high]))
            new = np.concatenate((np.zeros(len(low)), np.ones(len(high))))
            rows, target, how = learn[other]
            learn[other] = np.concatenate((rows, picked)), np.concatenate((target, new)), np.concatenate((how, np.full(len(picked), 0.3)))
            used.append(picked)
        pool = np.setdiff1d(pool, np.concatenate(used))
    z = {v: views[v].take(held).dot(weights[v][:-1]) + weights[v][-1] for v in views}
    scale = {v: _fit(_column(z[v]), y[held].astype(float), weight[held], 1e-4) for v in views}
    flat = [scale[v][0] * z[v] + scale[v][1] for v in views]
    return weights | {"scale": scale, "join": _fit(_column(*flat), y[held].astype(float), weight[held], 1e-4)}


def _rates(n: dict, rows: int, most: int) -> dict:
    """The share to draw for each (target, kind), of n labels: a quarter of `most`, and what the other kind leaves of a half."""
    half = most / 2
    return {(t, k): 1.0 if rows <= most else min(1.0, max(half / 2, half - n[t, 1 - k]) / max(n[t, k], 1)) for t, k in n}


def _constant(t: str, n0: int, n1: int) -> float | None:
    """The score where the labels are too few to learn from; None: learn."""
    if n0 and n1 and n0 + n1 >= LEAST_LABELS:
        return None if min(n0, n1) > 1 else n1 / (n0 + n1)
    return float(t == "quality") if bool(n0) == bool(n1) else float(n1 > 0)


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = 6000, max_pool: int = 4000, seed: int = 0) -> dict:
    """docs: doc_id, text, source, lang, n_chars. labels: doc_id, quality, toxic."""
    labels = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*[F.max(F.col(t).cast("int")).alias(t) for t in TARGETS])
    # Rows are drawn, not ids, which many rows may share; repeated rows are one.
    name = F.xxhash64("doc_id", "text", "source", "lang", "n_chars", F.lit(seed), F.lit("cotrain"))
    docs = docs.withColumn("drawn_by", name)
    names = c.cut(docs.groupBy("doc_id", "drawn_by").agg(F.count("*").alias("n")), "cotrain_names")
    labels = c.cut(names.select("doc_id", "drawn_by").join(labels, "doc_id"), "cotrain_labels")
    at = F.pmod(F.col("drawn_by"), F.lit(1 << 40))
    limit = lambda share: F.lit(int(share * (1 << 40)))
    strata = [(t, k) for t in TARGETS for k in (0, 1)]
    n = labels.agg(F.count(F.coalesce(*TARGETS)).alias("rows"), *[F.count_if(F.col(t) == k).alias(f"{t}{k}") for t, k in strata]).first().asDict()
    share = _rates({(t, k): n[f"{t}{k}"] for t, k in strata}, n["rows"], max_labelled)
    # One draw a row: it is in if any of its kinds takes it, so its chance is the largest of theirs.
    chance = F.greatest(*[F.when(F.col(t) == k, limit(share[t, k])).otherwise(F.lit(0).cast("long")) for t, k in strata])
    some = labels.withColumn("chance", chance).where(at < F.col("chance")).select("doc_id", "drawn_by", *TARGETS, ((1 << 40) / F.col("chance")).alias("stands"))
    # About max_labelled and max_pool rows are drawn; each goes on once.
    known = docs.join(F.broadcast(some), ["doc_id", "drawn_by"])
    open_ = names.join(labels.select("doc_id").distinct(), "doc_id", "left_anti")
    pool = open_.where(at < limit(min(1.0, max_pool / max(names.count(), 1)))).select("drawn_by")
    pool = docs.join(F.broadcast(pool.distinct()), "drawn_by", "left_semi")
    pool = pool.select("*", *[F.lit(None).cast("int").alias(t) for t in TARGETS], F.lit(1.0).alias("stands"))
    known = known.unionByName(pool).dropDuplicates(["drawn_by"]).withColumnRenamed("drawn_by", "row")
    sample = c.cut(known.mapInArrow(c.tidy(_collect), _FIELDS), "cotrain_sample")
    light = sample.select("row", "doc_id", *TARGETS, "stands").toPandas().sort_values(["doc_id", "row"], kind="stable")  # numbers only, a row a drawn one
    y = {t: light[t].fillna(-1).to_numpy().astype(int) for t in TARGETS}
    weight, place = light["stands"].to_numpy(), {r: i for i, r in enumerate(light["row"].tolist())}
    fixed = {t: _constant(t, n[f"{t}0"], n[f"{t}1"]) for t in TARGETS}
    fixed |= {t: n[f"{t}1"] / max(n[f"{t}0"] + n[f"{t}1"], 1) for t in TARGETS if fixed[t] is None and min((y[t] == k).sum() for k in (0, 1)) < 2}
    folds = {t: _folds(y[t], seed + k) for k, t in enumerate(TARGETS) if fixed[t] is None}
    kept = np.unique(np.array([w for t, (_, base) in folds.items() for w in _choose(sample, light["row"].to_numpy()[base], y[t][base], weight[base])], np.int64))
    text_rows, meta_rows = [None] * len(place), [None] * len(place)
    mine = F.array_intersect("words", F.split(F.lit(",".join(map(str, kept.tolist()))), ",").cast("array<bigint>")) if len(kept) else F.array().cast("array<bigint>")
    for r in sample.select("row", mine.alias("words"), "stats", "meta").toLocalIterator():
        at = np.searchsorted(kept, np.sort(np.array(r["words"], np.int64)))
        text_rows[place[r["row"]]] = np.concatenate((at, len(kept) + np.arange(_STATS))), np.concatenate((np.ones(len(at)), r["stats"]))
        meta_rows[place[r["row"]]] = np.array(r["meta"]), np.ones(3)
    text, page = Sparse(text_rows, len(kept) + _STATS), Sparse(meta_rows, META)
    return {"words": kept, "targets": {t: cotrain(text, page, y[t], *folds[t], weight) if t in folds else fixed[t] for t in TARGETS}}


def _choose(sample: DataFrame, rows: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[int]:
    """The words whose share differs most between the two kinds, over the rows that the given ones stand for."""
    marks = sample.sparkSession.createDataFrame(list(zip(rows.tolist(), y.tolist(), weight.tolist(), strict=True)), "row long, y int, w double")
    total = [max(weight[y == k].sum(), 1e-9) for k in (0, 1)]
    like = [max(t**2 / max((weight[y == k] ** 2).sum(), 1e-9), 1) for k, t in enumerate(total)]  # equal rows that would be as exact
    words = sample.select("row", "words").join(F.broadcast(marks), "row").select("y", "w", F.explode("words").alias("word"))
    part = [F.sum(F.when(F.col("y") == k, F.col("w")).otherwise(0.0)) / total[k] for k in (0, 1)]
    words = words.groupBy("word").agg(F.count("*").alias("docs"), part[0].alias("p0"), part[1].alias("p1")).where(F.col("docs") >= LEAST_DOCS)
    p = (F.col("p0") * like[0] + F.col("p1") * like[1]) / (like[0] + like[1])
    z = F.abs(F.col("p1") - F.col("p0")) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-6)) * (1 / like[0] + 1 / like[1]))
    best = words.select("word", z.alias("z")).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "word").limit(WORDS)
    return [r["word"] for r in best.collect()]


def _scores(shared):
    def run(batches):
        model = shared.value
        kept = model["words"]
        for b in c.text_slices(batches):
            h, codes, off, stats, meta = _features(b)
            rows, h = len(off) - 1, c.as_long(h)
            at = np.searchsorted(kept, h) if len(kept) else np.zeros(len(h), np.int64)
            known = (at < len(kept)) & (kept[np.minimum(at, len(kept) - 1)] == h) if len(kept) else np.zeros(len(h), bool)
            at = np.where(known, at, -1)[codes] if len(codes) else np.zeros(0, np.int64)
            doc = np.repeat(np.arange(rows), np.diff(off))
            cells = np.unique(doc[at >= 0] * max(len(kept), 1) + at[at >= 0])
            doc, at = cells // max(len(kept), 1), cells % max(len(kept), 1)
            out = []
            for t in TARGETS:
                m = model["targets"][t]
                if isinstance(m, float):
                    out += [np.full(rows, m)] * 3
                    continue
                z_text = np.bincount(doc, m["text"][at], rows) + stats @ m["text"][len(kept) : -1] + m["text"][-1]
                z_meta = m["meta"][meta].sum(axis=1) + m["meta"][-1]
                flat = [m["scale"][v][0] * z + m["scale"][v][1] for v, z in (("text", z_text), ("meta", z_meta))]
                out += [_sigmoid(flat[0] * m["join"][0] + flat[1] * m["join"][1] + m["join"][2]), *map(_sigmoid, flat)]
            yield pa.record_batch([b.column("doc_id"), *map(pa.array, out)], names=["doc_id", *(f"{t}{v}" for t in TARGETS for v in ("", "_text", "_meta"))])

    return run


def classify(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """doc_id, for each target its score and both calibrated views, kept."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(x).cast("string").alias(x) for x in ("text", "source", "lang")], F.col("n_chars").cast("long").alias("n_chars"))
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **how))
    scored = docs.mapInArrow(c.tidy(_scores(shared)), "doc_id long, " + ", ".join(f"{t}{v} double" for t in TARGETS for v in ("", "_text", "_meta")))
    return scored.withColumn("kept", (F.col("quality") >= 0.5) & (F.col("toxic") < 0.5))
