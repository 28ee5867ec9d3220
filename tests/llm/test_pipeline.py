"""Each stage of the pipeline against plain versions, on rows with null, shared and repeated ids and clashing columns."""

import random
import tempfile
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_brute import _jaccard, _overlap, _plain_words, _shared_targets

import corpus_pipeline as p
from quadrille.llm import op04_tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, times int, copy string, row_key long, rows int, row string, taken int, id string, component_id long"


@pytest.fixture(scope="module")
def made():
    rng = random.Random(30)
    word = lambda: f"w{rng.randrange(900)}"
    items = [[word() for _ in range(n)] for n in (6, 14, 30)]
    rows = []
    for i in range(120):
        text = [word() for _ in range(rng.randrange(0, 70))]
        if i % 10 == 1:
            at = rng.randrange(len(text) + 1)
            text[at:at] = items[i % 3]
        rows.append((rng.choice([i, i, i % 7, None]), " ".join(text), "en", rng.choice(["a", "b", None]), i % 2))
    for i in range(60):  # exact and near copies
        d, t, *rest = rows[rng.randrange(100)]
        w = t.split(" ")
        if i % 2 and len(w) > 40:
            w[rng.randrange(len(w))] = "changed"
        rows.append((rng.choice([d, 1000 + i, None]), " ".join(w), *rest))
    rows += rows[:4] + [rows[5]] * 6 + [(1, None, None, None, None), (2, "", "en", "a", 0), (None, None, None, None, None), (3000, " ".join(word() for _ in range(4000)), "en", "a", 1)]
    rows = [(*r, 1, "x", 7, 2, "y", 5, "z", 9) for r in rows]
    return items, rows


@pytest.fixture(scope="module")
def folder(spark, made):
    d = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(made[0])], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def run(spark, stage, rows, folder):
    out = stage(spark, spark.createDataFrame(rows, SCHEMA).repartition(4), folder)
    assert out.columns == [f.split()[0] for f in SCHEMA.split(", ")]
    return Counter(map(tuple, out.collect()))


def test_near_duplicates(spark, made, folder):
    rows = list(set(made[1]))
    at = dict(enumerate(rows))
    top = _jaccard([(i, r[1]) for i, r in at.items()])
    parts = {}
    for i, r in at.items():
        parts.setdefault(top[i] if brute.words(r[1]) else ("alone", i), []).append(r)
    got = run(spark, p.near_duplicates, made[1], folder)
    assert sum(got.values()) == len(parts) and set(got) <= set(rows)
    order = lambda r: (r[0] is None, r[0] or 0)
    for part in parts.values():
        kept = [r for r in part if got[r]]
        assert len(kept) == 1 and order(kept[0]) == min(map(order, part))


def test_decontamination(spark, made, folder):
    want = Counter(r for r in made[1] if not any(_overlap(_plain_words(r[1]), w) for w in made[0]))
    assert run(spark, p.decontamination, made[1], folder) == want and 0 < sum(want.values()) < len(made[1])


def test_mixing(spark, made, folder):
    rows = made[1]
    got, size = run(spark, p.mixing, rows, folder), lambda r: len(brute.words(r[1]))
    have = Counter(rows)
    names = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    targets = _shared_targets([sum(size(r) for r in rows if r[3] == s) for s in names], [1 + i % 3 for i in range(len(names))])
    assert all(n <= 3 * have[r] and size(r) for r, n in got.items())
    for s, target in zip(names, targets, strict=True):
        assert abs(sum(size(r) * n for r, n in got.items() if r[3] == s) - target) <= max(size(r) for r in rows if r[3] == s)


@pytest.mark.parametrize("shared", [1, 20])
def test_rows_that_share_a_hash(spark, made, folder, monkeypatch, shared):
    """With a first hash of few values, rows are told apart by the second one, and none is lost or taken for another."""
    hashes = p._hashes
    monkeypatch.setattr(p, "_hashes", lambda docs: (F.pmod(hashes(docs)[0], F.lit(shared)), hashes(docs)[1]))
    want = Counter(r for r in made[1] if not any(_overlap(_plain_words(r[1]), w) for w in made[0]))
    assert run(spark, p.decontamination, made[1], folder) == want
    kept = run(spark, p.near_duplicates, made[1], folder)
    assert set(kept.values()) == {1} and set(kept) <= set(made[1])
    assert {r for r in made[1] if not brute.words(r[1])} <= set(kept)
    assert sum(kept.values()) == len({top for i, top in _jaccard(list(enumerate(r[1] for r in set(made[1])))).items()})


def test_language(spark, folder):
    rng = random.Random(31)
    words, more = {"en": "the and of to in that was his", "de": "der die und ist nicht mit den das"}, (1, "x", 7, 2, "y", 5, "z", 9)
    clean = [(rng.choice([i, None, 3]), " ".join(rng.choice(words[g].split()) for _ in range(30)), g, "s", i, *more) for i in range(60) for g in words]
    noise = [(rng.choice([i, None, 3]), "".join(chr(rng.randrange(0x2800, 0x28FF)) for _ in range(200)), None, None, 0, *more) for i in range(5)]
    assert run(spark, p.language, clean + clean[:3] + noise + noise[:1], folder) == Counter(clean + clean[:3])
    unlabelled = [(1, "the and", None, None, 0, *more), (2, None, None, None, 0, *more)]
    assert run(spark, p.language, unlabelled, folder) == Counter(unlabelled)


def test_token_output(spark, made, folder):
    tok = op04_tokens.tokenizer("word_bpe_49k.json")
    got = p.token_output(spark, spark.createDataFrame(made[1], SCHEMA), folder).collect()
    ids = lambda t: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1])
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((r[0], len(x := ids(r[1])), op04_tokens.crc32(x)) for r in made[1])


def test_empty_tables(spark, folder):
    for name, stage in p.STAGES:
        assert stage(spark, spark.createDataFrame([], SCHEMA), folder).count() == 0, name
