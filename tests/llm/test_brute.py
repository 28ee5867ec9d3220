"""Operators against plain versions on rows made at random, with shared and null ids, repeats and extra columns."""

import itertools
import random
import re
import zlib
from fractions import Fraction

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quadrille.llm import common as c
from quadrille.llm import graph, op01_fertility, op02_lines, op03_decontaminate, op04_tokens, op05_language, op06_chat, op07_jaccard, op08_substrings, op09_cotrain, op10_mixing
from quadrille.llm.graph import components


def _plain_words(text):
    return re.findall(r"\w+", (text or "").lower().replace("_", " "))


def _overlap(doc, item, window=13, percent=80):
    """Whether `window` words in a row, or the whole item, agree in enough places, along any line."""
    width = min(window, len(item))
    for shift in range(-len(item) + 1, len(doc)):
        lo, hi = max(shift, 0), min(len(doc), shift + len(item))
        same = [doc[i] == item[i - shift] for i in range(lo, hi)]
        if any(sum(same[i : i + width]) * 100 >= width * percent for i in range(len(same) - width + 1)):
            return True
    return False


def test_masks_leave_no_pattern_out():
    for n in range(1, 13):
        most = n - -(-n * 80 // 100)
        masks = op03_decontaminate.masks_for(n, 80)
        for k in range(most + 1):
            for gone in itertools.combinations(range(n), k):
                assert any(not set(m) & set(gone) for m in masks), (n, gone)
    for gone in itertools.combinations(range(13), 2):
        assert any(not {at + i for i, bit in enumerate(m) if bit == "1"} & set(gone) for m in op03_decontaminate.MASKS for at in range(13 - len(m) + 1))


def test_decontaminate_items_of_any_length(spark):
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(3000)}"
    items = [(i, [word() for _ in range(n)]) for i, n in enumerate([*range(1, 31)] * 2)]
    items += [(7, [word() for _ in range(6)]), (None, [word() for _ in range(11)])]
    docs = []
    for i in range(400):
        text = [word() for _ in range(rng.randrange(0, 60))]
        if i % 4:
            part = list(items[rng.randrange(len(items))][1])
            for _ in range(rng.randrange(0, 4)):
                part[rng.randrange(len(part))] = word()
            at = rng.randrange(len(text) + 1)
            text[at:at] = part
        docs.append((rng.choice([i, i % 9, None]), " ".join(text).upper() if i % 2 else ", ".join(text)))
    docs += [docs[1], docs[1], (5, None), (None, None), (6, "")]
    want = [(d, sum(_overlap(_plain_words(t), w) for _, w in items) > 0, t) for d, t in docs]
    rows = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, n int, item string").repartition(4)
    tests = spark.createDataFrame([(i, " ".join(w), 3) for i, w in items] + [(99, None, 1), (98, "  ", 1)], "item_id long, text string, shift int")
    for limit in (10**6, 0):
        got = op03_decontaminate.decontaminate(rows, tests, max_broadcast=limit).collect()
        key = lambda x: (x[0] is None, x[0] or 0, x[1])
        assert sorted(((r["doc_id"], r["contaminated"]) for r in got), key=key) == sorted(((d, x) for d, x, _ in want), key=key)
    assert sum(x for _, x, _ in want) > 100
    assert not op03_decontaminate.decontaminate(rows, tests.where("false")).where("contaminated").count()


def test_decontaminate_long_text(spark):
    rng = random.Random(12)
    words = [f"w{rng.randrange(500)}" for _ in range(30_000)]
    item = [f"v{i}" for i in range(40)]
    far = words[:29_000] + item + words[29_000:]
    rows = spark.createDataFrame([(1, " ".join(words)), (1, " ".join(far)), (2, "x" * 200_000)], "doc_id long, text string")
    got = op03_decontaminate.decontaminate(rows, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["contaminated"]) for r in got) == [(1, False), (1, True), (2, False)]


def test_encode_words_like_whole_texts():
    tok = op04_tokens.tokenizer("word_bpe_49k.json")
    rng = random.Random(13)
    marks = [*"abcXYZéÉßñÑ  \t\n.,;:'!?<|>0123456789-_/\\«»\xa0\x85\x1c ½²ª", "'s", "'LL", "<|endoftext|>", "İ", "ı", "漢", "字", "é", "Å", "ﬁ", "😀", "​", "Σ", "ς"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randrange(60))) for _ in range(4000)] + [""]
    off, words = c.split_words(pa.array(texts))
    codes, distinct = c.word_codes(words)
    flat, at = op04_tokens.encode_words(distinct, "word_bpe_49k.json")
    for i, text in enumerate(texts):
        assert c.gather(flat, at, codes[off[i] : off[i + 1]])[0].tolist() == tok.encode(text, add_special_tokens=False).ids, text


def test_tokens_of_shared_ids(spark):
    tok = op04_tokens.tokenizer("word_bpe_49k.json")
    rng = random.Random(14)
    rows = [(rng.choice([None, 1, 2, 3, 4]), " ".join(f"word{rng.randrange(99)}" for _ in range(rng.randrange(9))), 1, 2) for _ in range(60)]
    rows += [rows[0], rows[1], (2, None, 1, 2), (9, "x " * 40_000, 1, 2)]
    got = op04_tokens.token_digests(spark.createDataFrame(rows, "doc_id long, text string, start int, part int").repartition(5)).collect()
    digest = lambda t: (len(i := tok.encode(t or "", add_special_tokens=False).ids) + 1, zlib.crc32(np.array([*i, 1], "<u4").tobytes()))
    key = lambda x: (x[0] is not None, x[0] or 0, x[1:])
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=key) == sorted(((d, *digest(t)) for d, t, _, _ in rows), key=key)
    before = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == before
        before += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))


@pytest.mark.parametrize("radii", [(1, 0), (0,), (4, 1, 0), (1,), (3,)])
def test_line_dedup_with_any_chunks(spark, radii):
    rng = random.Random(15)
    rows = [(rng.choice([i, None]) if i % 9 == 0 else i, "\n".join(rng.choice(["a", "b", "c", "", f"own {i}"]) for _ in range(rng.randrange(9))), "x", 1) for i in range(80)]
    rows += [rows[3], rows[3], (3, rows[5][1], "x", 1), (200, "\n".join(f"line {rng.randrange(300)}" for _ in range(20_000)), "x", 1), (201, "y" * 300_000, "x", 1)]
    got = op02_lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, lines string, at int").repartition(4), radii).collect()
    assert len(got) == len(rows)
    kept = {(r["doc_id"], r["n_lines"]): r for r in got}
    for d, t, _, _ in rows:
        lines = t.split("\n")
        r = kept[d, len(lines)]
        if d is None:
            assert r["n_removed"] == 0
    # No line's text is lost altogether, and what larger chunks remove, windows do too; a last radius of 0 finds all.
    assert {x for _, t, _, _ in rows for x in t.split("\n")} == {x for r in got for x in r["kept_text"].split("\n")}
    full = op02_lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, lines string, at int"), (0,))
    if radii[-1] == 0:
        assert sorted(map(str, got)) == sorted(map(str, full.collect()))
    assert 0 < sum(r["n_removed"] for r in got) <= full.groupBy().sum("n_removed").first()[0]


def test_line_chunks_move_with_the_text(spark):
    rng = random.Random(16)
    lines = [f"line {rng.randrange(10**9)}" for _ in range(2000)]
    # Five insertions change the chunks around them only, so a copy goes but for a few lines at each insertion.
    other = list(lines)
    for at in (1700, 1200, 900, 400, 0):
        other.insert(at, f"new {at}")
    df = spark.createDataFrame([(1, 1, 0, "\n".join(lines)), (2, 2, 0, "\n".join(other))], "doc_id long, ver long, at int, text string")
    parts = df.select("doc_id", "ver", "at", F.transform(F.split("text", "\n"), lambda x: F.xxhash64(x)).alias("h"))
    chunks = op02_lines.line_chunks(parts, 1).collect()
    sets = [[tuple(r["h"]) for r in chunks if r["doc_id"] == d] for d in (1, 2)]
    assert 2 < sum(map(len, sets[0])) / len(sets[0]) < 5 and min(map(len, sets[0])) >= 2
    assert len(set(sets[0]) - set(sets[1])) <= 15
    for radii, rest in (((1,), 60), ((4, 1), 60), ((1, 0), 5)):
        got = {r["doc_id"]: r["n_removed"] for r in op02_lines.dedup_lines(df, radii).collect()}
        assert got[1] == 0 and 2000 - (rest if radii[-1] else 0) <= got[2] <= 2000


def _jaccard(rows, k=5, percent=80):
    """rows: (doc_id, text). {doc_id: smallest doc_id that it reaches}, where rows of one doc_id are one node."""
    sets = [(d, brute.shingles(t, k)) for d, t in rows if d is not None]
    up = {d: d for d, _ in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                lo, hi = sorted((top(a), top(b)))
                up[hi] = lo
    return {d: top(d) for d in up}


def test_jaccard_shared_ids(spark, monkeypatch):
    rng = random.Random(16)
    text = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    common = text(40).split()
    base = [text(rng.randrange(1, 90)).split() for _ in range(12)]
    base += [common + b for b in base[:6]]
    rows = []
    for i in range(260):
        w = list(base[rng.randrange(len(base))])
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((rng.choice([i, i, i, i, i % 5, None]), " ".join(w)))
    rows += [rows[0], rows[0], rows[1], (300, None), (301, ""), (1, ""), (None, None), (302, text(6000)), (303, " \t ")]
    rows += [(304, rows[-2][1] + " end"), (-7, rows[-2][1])]
    want, sizes = _jaccard(rows), lambda t: len(brute.shingles(t))
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n int, row_id string").repartition(5)
    for short in (16, 1):
        monkeypatch.setattr(op07_jaccard, "SHORT", short)
        got = op07_jaccard.jaccard_join(df)[0].collect()
        key = lambda x: tuple((v is None, v or 0) for v in x)
        assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=key) == sorted(((d, sizes(t), want.get(d)) for d, t in rows), key=key)
    three = [(3, base[0]), (4, base[1]), (5, base[0]), (5, base[1])]
    got = op07_jaccard.jaccard_join(spark.createDataFrame([(d, " ".join(w)) for d, w in three], "doc_id long, text string"))[0].collect()
    assert {r["component_id"] for r in got} == {3}


def test_components_of_long_chains(spark):
    rng = random.Random(17)
    names = rng.sample(range(10**9), 600)
    links = [(names[i], names[i + 1]) for i in range(299)] + [(names[300], names[i]) for i in range(301, 600)] + [(5, 5)]
    rng.shuffle(links)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()}
    assert got == {x: min(part) for part in (names[:300], names[300:]) for x in part}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_deal_hubs_out(spark, monkeypatch):
    monkeypatch.setattr(graph, "HUB", 3)
    monkeypatch.setattr(graph.c, "HEAVY", 20)
    monkeypatch.setattr(graph.c, "SALTS", 4)
    rng = random.Random(18)
    links = [(0, i) for i in range(1, 200)] + [(199, 500), (500, 501)] + [(900, 900 + i) for i in range(1, 90)] + [(700, 701)]
    links = [x if rng.random() < 0.5 else x[::-1] for x in links]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long").repartition(9)).collect()}
    assert got == {**{x: 0 for x in [*range(200), 500, 501]}, **{900 + i: 900 for i in range(90)}, 700: 700, 701: 700}
    plan = graph._to_least(spark.createDataFrame(links, "a long, b long"), "a", "b", len(links))
    assert "salt" in plan._jdf.queryExecution().toString()


def test_jaccard_blocks_add_up(spark):
    """The product of two rows, added up over the blocks of the stored matrix, is the size of their intersection."""
    rng = random.Random(19)
    sets = [set(rng.sample(range(-(2**63), 2**63, 2**55), rng.choice([1, 8, 200]))) for _ in range(12)]
    sets += [set(rng.sample(sorted(x), max(1, len(x) * 9 // 10))) for x in sets]
    cells = [(i, (v >> 60) & 7, v) for i, x in enumerate(sets) for v in x]
    matrix = spark.createDataFrame(cells, "row_id long, block int, v long").groupBy("row_id", "block").agg(F.collect_list("v").alias("part"))
    every = [(i, j, len(sets[i]), len(sets[j])) for i in range(len(sets)) for j in range(i)]
    got = op07_jaccard._links(spark.createDataFrame(every, "a long, b long, n_a long, n_b long"), matrix, 80)
    assert {(r["a"], r["b"]) for r in got.collect()} == {(i, j) for i, j, _, _ in every if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}


def test_jaccard_sketch_is_summed_part_by_part():
    part = lambda x: np.full(op07_jaccard.SKETCH_BLOCK, x, "<u4").tobytes()
    batches = [pa.record_batch([pa.array(b, pa.int32()), pa.array([part(x) for x in v], pa.binary())], names=["block", "counts"]) for b, v in (([3, 5, 3], [1, 2, 4]), ([], []), ([5], [2**32 - 1]))]
    (out,) = op07_jaccard._add_blocks(batches)
    got = {b: set(np.frombuffer(x, "<i8").tolist()) for b, x in zip(out.column("block").to_pylist(), out.column("counts").to_pylist(), strict=True)}
    assert got == {3: {5}, 5: {2**32 + 1}}


def _shared_targets(sizes, weights, most=3):
    """Share by weight, stop at most * size, share the excess again."""
    left, out, open_ = Fraction(sum(sizes)), [Fraction(0)] * len(sizes), set(range(len(sizes)))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if unit * weights[i] > most * sizes[i]}
        if not full:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = Fraction(most * sizes[i])
        left -= sum(out[i] for i in full)
        open_ -= full
    return [float(x) for x in out]


def test_mixing_single_sources(spark):
    rng = random.Random(18)
    rows = [(rng.choice([i, i, None, i % 3]), " ".join("w" for _ in range(rng.randrange(30))), rng.choice([None, "", "a", "b", "é", "z", "\U0001f600", "rare" if i < 3 else "c"]), 1, "x") for i in range(900)]
    rows += [rows[0]] * 5 + [(1, None, "a", 1, "x"), (2, None, "empty", 1, "x"), (3, "w " * 5000, "b", 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, taken int, sources string")
    got = op10_mixing.mix_by_source(df.repartition(6)).collect()
    assert sorted(map(str, got)) == sorted(map(str, op10_mixing.mix_by_source(df.repartition(2)).collect()))
    names = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(len(brute.words(r[1])) for r in rows if r[2] == s) for s in names]
    targets = dict(zip(names, _shared_targets(sizes, [1 + i % 3 for i in range(len(names))]), strict=True))
    assert len(got) == len(rows)
    for s, size in zip(names, sizes, strict=True):
        own = [r for r in got if r["source"] == s]
        assert {(r["source_size"], r["target"]) for r in own} == {(size, targets[s])}
        assert abs(sum(r["taken"] for r in own) - targets[s]) <= max(r["size"] for r in own)
        times = {r["taken"] // r["size"] for r in own if r["size"]}
        assert all(r["taken"] % r["size"] == 0 if r["size"] else r["taken"] == 0 for r in own) and max(times, default=0) - min(times, default=0) <= 1 and max(times, default=0) <= 3


def _best_flow(patterns, quotas, most):
    """The largest flow and its least cost, by trying all splits of single words along cheapest paths (Bellman-Ford)."""
    n, m = len(patterns), len(quotas)
    arcs = [[0, 1 + i, w, k] for i, (_, w) in enumerate(patterns) for k in range(1, most + 1)]
    arcs += [[1 + i, 1 + n + s, 10**9, 0] for i, (ss, _) in enumerate(patterns) for s in ss] + [[1 + n + s, 1 + n + m, q, 0] for s, q in enumerate(quotas)]
    arcs += [[b, a, 0, -p] for a, b, _, p in arcs]
    half, flow, cost = len(arcs) // 2, 0, 0
    while True:
        dist, via = {0: 0}, {}
        for _ in range(n + m + 2):
            for e, (a, b, room, p) in enumerate(arcs):
                if room and a in dist and dist[a] + p < dist.get(b, 10**9):
                    dist[b], via[b] = dist[a] + p, e
        v = 1 + n + m
        if v not in dist:
            return flow, cost
        path = []
        while v:
            path.append(via[v])
            v = arcs[via[v]][0]
        room = min(arcs[e][2] for e in path)
        for e in path:
            arcs[e][2] -= room
            arcs[(e + half) % (2 * half)][2] += room
        flow, cost = flow + room, cost + room * dist[1 + n + m]


def test_flow_is_largest_and_cheapest():
    rng = random.Random(19)
    for _ in range(60):
        m = rng.randrange(1, 5)
        patterns = [(tuple(sorted(rng.sample(range(m), rng.randrange(1, m + 1)))), rng.randrange(0, 9)) for _ in range(rng.randrange(1, 6))]
        quotas = [rng.randrange(0, 25) for _ in range(m)]
        got = op10_mixing.route(patterns, quotas, 3)
        used = [sum(f.values()) for f in got]
        assert all(set(f) <= set(p) for f, (p, _) in zip(got, patterns, strict=True)) and all(u <= 3 * w for u, (_, w) in zip(used, patterns, strict=True))
        assert all(sum(f.get(s, 0) for f in got) <= q for s, q in enumerate(quotas))
        price = sum(k * min(max(u - (k - 1) * w, 0), w) for u, (_, w) in zip(used, patterns, strict=True) for k in (1, 2, 3))
        assert (sum(used), price) == _best_flow(patterns, quotas, 3)


def test_mixing_overlapping_sources(spark):
    rng = random.Random(20)
    sets = [["a"], ["a", "b"], ["b"], ["b", "c"], ["d"], [None], ["e", None], ["f"]]
    rows = [(i, i % 7, rng.randrange(1, 20), rng.choice(sets)) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, ver long, size long, sources array<string>")
    quotas = {"a": 4000, "b": 1500, "c": 2500, "d": 900, "e": 700, None: 5000, "f": 10**6}
    got = op10_mixing.mix(df, spark.createDataFrame(list(quotas.items()), "source string, quota long")).collect()
    words = [(tuple(s), sum(r[2] for r in rows if r[3] == s)) for s in sets]
    names = list(quotas)
    flow = op10_mixing.route([(tuple(names.index(x) for x in s), w) for s, w in words], list(quotas.values()), 3)
    assert len(got) == len(rows)
    for s, _ in words:
        own = [r for r in got if tuple(r["sources"]) == s]
        assert max(len(r["used_for"]) for r in own) - min(len(r["used_for"]) for r in own) <= 1
        assert all(r["taken"] == r["size"] * len(r["used_for"]) and set(r["used_for"]) <= set(s) for r in own)
    largest = max(r[2] for r in rows)
    for i, x in enumerate(names):
        taken = sum(r["size"] * r["used_for"].count(x) for r in got)
        assert abs(taken - sum(f.get(i, 0) for f in flow)) <= 2 * largest * sum(x in s for s in sets), x


def test_fertility_measures_and_bands(spark):
    rng = random.Random(21)
    sp, enc, is_byte = op01_fertility._vocabularies("piece_bpe_32k.model", "byte_bpe_50k.tiktoken")
    letters = {"en": "etaoinshrdlu", "ru": "оеаинтсрвлкм", None: "αειορνστ"}
    rows = []
    for i in range(240):
        lang = rng.choice(list(letters))
        words = ["".join(rng.choice(letters[lang]) for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 120))]
        words = [w if rng.random() < 0.97 else rng.choice(["\U0001f600", "漢字", "$$$", "a\xa0b"]) for w in words]
        rows.append((rng.choice([i, None, 3]), "".join(w + rng.choice([" ", " ", "  ", "\n", "\t", " \n"]) for w in words), lang, 1, "x"))
    rows += [(900 + i, "".join(chr(rng.randrange(0x2800, 0x28FF)) for _ in range(400)).replace("⠁", " ") + " x" * 60, "en", 1, "x") for i in range(3)]
    rows += [rows[0], rows[0], (1, None, None, 1, "x"), (2, "", "en", 1, "x"), (4, "lang " * 30_000, "en", 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int, script string")
    got = [r.asDict() for r in op01_fertility.fertility(df.repartition(7)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, (r.asDict() for r in op01_fertility.fertility(df.repartition(2)).collect())))

    want = []
    for d, text, lang, _, _ in rows:
        n, chars, symbols, dup, rep = brute.base(text)
        ids = sp.encode(" ".join(brute.words(text)))
        tokens = len(enc.encode_ordinary(text or ""))
        share = [ids.count(x) / len(ids) for x in set(ids)]
        bits = abs(sum(p * np.log2(p) for p in share))
        want.append({
            "doc_id": d, "n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": rep, "base_failed": n < 50 or 100 * rep > 50 * n, "group": lang or f"script:{op01_fertility._script(text or '')}", "script": op01_fertility._script(text or ""),
            "piece_chars": chars / max(len(ids), 1), "byte_chars": len(text or "") / max(tokens, 1), "fallback_share": sum(is_byte[i] for i in ids) / max(len(ids), 1), "entropy_share": bits / np.log2(len(ids)) if len(ids) > 1 else 0.0,
        })

    def ends(rows, name):
        v = sorted(np.floor(r[name] * 10_000 + 0.5) for r in rows)
        q = [v[-(-len(v) * k // 4) - 1] / 10_000 for k in (1, 2, 3)]
        reach = op01_fertility.REACH * max(1, op01_fertility.FEW / len(v)) * max(q[2] - q[0], op01_fertility.LEAST * q[1], 0.01)
        return q[0] - reach, q[2] + reach

    good = [r for r in want if not r["base_failed"]]
    for r in want:
        r["out_of_band"] = False
        same = {by: [x for x in good if x[by] == r[by]] for by in ("group", "script")}
        lacks = max(1 - len(same["group"]) / op01_fertility.MIN_GROUP, 0)
        for name, low, high in op01_fertility.MEASURES:
            if not same["script"] and not same["group"]:
                continue
            own = ends(same["group"] or same["script"], name)
            lo, hi = ends(same["script"] or same["group"], name)
            if same["group"]:
                lo, hi = own[0] - lacks * max(own[0] - lo, 0), own[1] + lacks * max(hi - own[1], 0)
            r["out_of_band"] |= bool((low and r[name] < lo) or (high and r[name] > hi))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "out_of_band"]
    assert sorted(str([r[x] for x in names] + [round(float(r[x]), 6) for x in ("piece_chars", "byte_chars", "fallback_share", "entropy_share")]) for r in got) == sorted(str([r[x] for x in names] + [round(float(r[x]), 6) for x in ("piece_chars", "byte_chars", "fallback_share", "entropy_share")]) for r in want)
    assert all(r["kept"] == (not r["base_failed"] and not r["out_of_band"]) for r in got) and sum(r["out_of_band"] for r in got) >= 3


def _post(log):
    p = np.exp(np.array(log) - max(log))
    return p / p.sum()


def test_language_against_plain_sums(spark):
    rng = random.Random(22)
    words = {"en": "the and of to in that", "de": "der die und ist nicht mit", "fr": "les des une est dans", "odd": "zz qq"}
    sites = [("de", "x.de", "a.x.de"), ("de", "x.de", "b.x.de"), ("com", "y.com", "y.com"), (None, None, None)]
    rows = []
    for i in range(150):
        lang = rng.choice(list(words))
        rows.append((rng.choice([i, None, 5]), " ".join(rng.choice(words[lang].split()) for _ in range(rng.randrange(0, 12))), rng.choice([lang, "en-GB", None, "xx", ""]), *rng.choice(sites), 1))
    rows += [rows[0], rows[0], (7, None, None, "de", "x.de", "a.x.de", 1), (8, "", "DE_at", "uk", "z.uk", "z.uk", 1), (9, "ab" * 60_000, None, None, None, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, declared string, suffix string, domain string, host string, p int").repartition(4)
    labelled = spark.createDataFrame([(i, " ".join(rng.choice(words[g].split()) for _ in range(20)), g) for i in range(80) for g in words], "doc_id long, text string, lang string")
    langs, logp = op05_language.train(labelled)
    got = op05_language.identify(df, langs, logp).collect()

    n_c, tidy = len(langs) + 1, lambda x: (x or "").lower()
    like, post, n_tri = [], [], []
    for r in rows:
        raw = (r[1] or "").lower().encode()
        at = [((raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) * 0x9E3779B1 % 2**32) >> 16 for i in range(len(raw) - 2)]
        v = logp[:, at].sum(axis=1, dtype=np.float64) * min(1.0, 40.0 / max(len(at), 1)) if at else np.zeros(n_c)
        like.append(v)
        n_tri.append(len(at))
        post.append(_post(v))
    site = [tuple(map(tidy, r[3:6])) for r in rows]
    total = lambda keep: sum([p for p, s, n in zip(post, site, n_tri, strict=True) if n and keep(s)], np.zeros(n_c))
    smooth = lambda s, p: (np.maximum(s, 0) + 20 * p) / (np.maximum(s, 0) + 20 * p).sum()
    every = total(lambda s: True) + 1
    want = []
    for r, s, v, p, n in zip(rows, site, like, post, n_tri, strict=True):
        level = every / every.sum()
        live = any(m and x == s for x, m in zip(site, n_tri, strict=True))
        if live:
            level = smooth(total(lambda x: x[:2] == s[:2]), smooth(total(lambda x: x[0] == s[0]), level))  # noqa: B023
        prior = smooth(total(lambda x: x == s) - (p if n else 0), level)  # noqa: B023
        score = v + np.log(prior)
        for told, wrong in ((tidy(r[2]).replace("_", "-").split("-")[0], 0.1), (op05_language.SUFFIX_LANGUAGE.get(s[0], ""), 0.3)):
            if told in langs:
                score = score + np.where(np.arange(n_c) == langs.index(told), np.log(1 - wrong), np.log(wrong / len(langs)))
        best = int(score.argmax())
        want.append((r[0], [*langs, "und"][best], round(float(_post(score)[best]), 5), n))
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["language"], round(r["confidence"], 5), r["n_trigrams"])) for r in got)
    assert all(r["kept"] == (r["language"] != "und" and r["confidence"] >= 0.5) for r in got)


def test_many_languages(spark):
    rng = random.Random(23)
    words = {f"l{i:03}": [f"{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + j)}{i}" for j in range(8)] for i in range(230)}
    rows = [(k * 10 + j, " ".join(rng.choice(w) for _ in range(25)), g, "s") for k, (g, w) in enumerate(words.items()) for j in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    langs, logp = op05_language.train(df)
    assert langs == sorted(words) and logp.shape[0] == 231
    got = {r["doc_id"]: r["language"] for r in op05_language.identify(op05_language.from_documents(df), langs, logp).collect()}
    assert np.mean([got[d] == g for d, _, g, _ in rows]) > 0.98


@pytest.mark.parametrize("group", [50_000, 3])
def test_substrings_shared_ids(spark, monkeypatch, group):
    monkeypatch.setattr(op08_substrings, "GROUP", group)
    monkeypatch.setattr(op08_substrings, "FEW", group)
    rng = random.Random(24)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(60))
    passages = [[word() for _ in range(rng.randrange(18, 60))] for _ in range(6)]
    rows = []
    for i in range(150):
        text = [word() for _ in range(rng.randrange(0, 50))]
        for _ in range(rng.randrange(3)):
            part = passages[min(rng.randrange(12), 5)]
            lo = rng.randrange(len(part) // 2)
            at = rng.randrange(len(text) + 1)
            text[at:at] = part[lo : lo + rng.randrange(10, 60)]
        rows.append((rng.choice([i, i, i, i % 6, None]), rng.choice([" ", "\n", " \t"]).join(text)))
    rows += [rows[0], rows[0], (500, None), (501, ""), (502, " ".join(["same"] * 300)), (503, " ".join(word() for _ in range(20_000))), (504, " ".join(passages[5]) + " é\xa0x")]
    first = {}
    for d, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = brute.words(t)
        for i in range(len(w) - 19):
            key = tuple(w[i : i + 20])
            first[key] = min(first.get(key, (d, i)), (d, i))
    want = []
    for d, t in rows:
        w = brute.words(t)
        gone = {i + j for i in range(len(w) - 19) if d is not None and first[tuple(w[i : i + 20])] != (d, i) for j in range(20)}
        want.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    df = spark.createDataFrame([(d, t, 1, "x", 2) for d, t in rows], "doc_id long, text string, n int, prefix string, start int").repartition(6)
    got = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in op08_substrings.remove_repeats(df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and sum(x[2] for x in want) > 500


def test_chat_with_other_columns(spark):
    rows = [(c, t, r, x, "a", 1) for c in (1, None) for t, (r, x) in enumerate([("user", "hi"), ("assistant", None), ("user", "x" * 200_000), ("assistant", "[OUT] ok</s>")])]
    df = spark.createDataFrame(rows + rows[:1], "conv_id long, turn long, role string, text string, turns string, state int")
    got = {r["conv_id"]: r for r in op06_chat.format_chats(df).select("*", op06_chat.read_turns("formatted").alias("read"), op06_chat.read_loss("segments").alias("lost")).collect()}
    assert [(x["role"], x["text"]) for x in got[None]["read"]] == [(r[2], r[3] or "") for r in rows[:4]] and got[None]["lost"] == "[OUT] ok</s>" and got[None]["valid"]
    assert got[1]["n_turns"] == 5 and got[1]["bad_turn"] == 1 and not got[1]["valid"]


def test_cotraining_folds_and_pool():
    y = np.array([0] * 40 + [1] * 10 + [-1] * 50)
    held, base = op09_cotrain._folds(y, 3)
    assert not set(held) & set(base) and set(held) | set(base) == set(range(50)) and set(y[held]) == set(y[base]) == {0, 1} and len(held) == 10
    one = op09_cotrain.Sparse([(np.array([int(k != 1)]), np.ones(1)) for k in y], 2)
    seen, fit = [], op09_cotrain._fit

    def spy(x, target, weight, *more):
        seen.append(x.n)
        return fit(x, target, weight, *more)

    op09_cotrain._fit, before = spy, op09_cotrain.SURE
    try:
        op09_cotrain.SURE = 1000
        op09_cotrain.cotrain(one, one, y, held, base)
    finally:
        op09_cotrain._fit, op09_cotrain.SURE = fit, before
    assert max(seen) <= 40 + 50  # no pool row is learnt from twice


def _plain_fit(x, y, ridge, weight=None):
    """Logistic regression on a full matrix whose last column is ones, by 200 turns of Adam."""
    weight = np.ones(len(y)) if weight is None else np.array(weight)
    w, m, s = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for t in range(1, 201):
        g = x.T @ ((1 / (1 + np.exp(-(x @ w))) - y) * weight) / weight.sum()
        g[:-1] += ridge * w[:-1]
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g**2
        w = w - 0.1 * m / (1 - 0.9**t) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return w


def _plain_cotraining(docs, labels):
    """{doc_id: (score, text view, metadata view) of each target}: the whole operator on full matrices, text by text."""
    docs = sorted(docs)
    code = lambda x: int(c.word_hashes(pa.array([x]))[0] >> np.uint64(1)) % 64
    bags, stats, meta = [], [], np.zeros((len(docs), 161))
    for i, (_, text, source, lang, n_chars) in enumerate(docs):
        words, lines = (text or "").split(), (text or "").split("\n")
        bags.append({re.sub(r"^[\W_]+|[\W_]+$", "", w).lower() for w in words})
        n, some = len(words), max(len(words), 1)
        odd = sum((text or "").count(x) for x in "#*$%&|<>@{}[]\\^~_=+")
        stats.append([np.log1p(n) / 10, (np.log1p(n) / 7) ** 2, min(odd / some, 2), len(set(words)) / some, min(sum(map(len, words)) / some / 10, 5), len(set(lines)) / len(lines), np.log1p(len(lines)) / 10, n < 50])
        meta[i, [code(source or "\0null"), 64 + code(lang or "\0null"), 128 + int(np.log2(1 + (n_chars or 0))), 160]] = 1
    y = {t: np.array([labels.get(d[0], (None, None))[k] for d in docs], float) for k, t in enumerate(op09_cotrain.TARGETS)}
    folds = {t: op09_cotrain._folds(np.nan_to_num(y[t], nan=-1).astype(int), k) for k, t in enumerate(y)}
    kept = set()
    for t, (_, base) in folds.items():
        kinds = [[bags[i] for i in base if y[t][i] == k] for k in (0, 1)]
        for word in set().union(*kinds[0], *kinds[1]):
            n = [sum(word in b for b in kind) for kind in kinds]
            p, both = [n[k] / len(kinds[k]) for k in (0, 1)], sum(n) / sum(map(len, kinds))
            z = abs(p[1] - p[0]) / np.sqrt(max(both * (1 - both), 1e-6) * sum(1 / len(kind) for kind in kinds))
            if sum(n) >= op09_cotrain.LEAST_DOCS and z >= op09_cotrain.LEAST_Z:
                kept.add(word)
    text = np.array([[float(w in b) for w in sorted(kept)] + list(np.float32(s)) + [1.0] for b, s in zip(bags, stats, strict=True)])
    out = {d[0]: [] for d in docs}
    for t, (held, base) in folds.items():
        views, learn, pool = (text, meta), [[(i, y[t][i], 1.0) for i in base] for _ in "ab"], set(np.flatnonzero(np.isnan(y[t])).tolist())
        for turn in range(op09_cotrain.ROUNDS + 1):
            fits = [_plain_fit(x[[i for i, _, _ in rows]], np.array([v for _, v, _ in rows]), 1e-3, [h for _, _, h in rows]) for x, rows in zip(views, learn, strict=True)]
            if turn == op09_cotrain.ROUNDS or not pool:
                break
            gone = set()
            for v in (0, 1):
                by = sorted((views[v][i] @ fits[v], i) for i in pool)
                k = min(op09_cotrain.SURE, len(pool) // 4)
                sure = [(i, 0.0, 0.3) for z, i in by[:k] if z < -2] + [(i, 1.0, 0.3) for z, i in by[len(by) - k :] if z > 2]
                learn[1 - v] += sure
                gone |= {i for i, _, _ in sure}
            pool -= gone
        z = [x @ w for x, w in zip(views, fits, strict=True)]
        one = lambda *cols: np.stack([*cols, np.ones(len(cols[0]))], axis=1)
        flat = [one(x) @ _plain_fit(one(x[held]), y[t][held], 1e-4) for x in z]
        joined = one(*flat) @ _plain_fit(one(*[x[held] for x in flat]), y[t][held], 1e-4)
        for i, d in enumerate(docs):
            out[d[0]] += [1 / (1 + np.exp(-x[i])) for x in (joined, *flat)]
    return out, len(kept)


def test_cotraining_against_full_matrices(spark, monkeypatch):
    """Choice of words, both views, the exchange of labels over the rounds, calibration and the joint score."""
    monkeypatch.setattr(op09_cotrain, "SURE", 15)
    rng, docs, labels = random.Random(23), [], {}
    for i in range(420):
        good, bad = rng.random() < 0.5, rng.random() < 0.3
        words = [f"w{rng.randrange(60)}" for _ in range(rng.randrange(5, 70))]
        words += [rng.choice(["Clear", "source,", "(proof)"])] * (rng.random() < (0.7 if good else 0.2)) + ["#$%"] * (not good) * rng.randrange(2) + [rng.choice(["slur", "Hate!"])] * (rng.random() < (0.8 if bad else 0.1))
        rng.shuffle(words)
        text = "".join(w + rng.choice("   \n") for w in words)
        docs.append((i, text, f"s{rng.randrange(6) + 2 * good + 2 * bad}", rng.choice(["en", "de", None]), len(text)))
        if i % 3:
            labels[i] = (int(good) if i % 4 else None, int(bad) if i % 5 else (None if i % 4 else 0))
    docs[7] = (7, None, None, None, None)
    docs[9] = (9, "", "s1", "en", 0)
    want, words = _plain_cotraining(docs, labels)
    table = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, n_chars long").repartition(5)
    marks = spark.createDataFrame([(i, q, t) for i, (q, t) in labels.items()], "doc_id long, quality int, toxic int")
    names = [f"{t}{v}" for t in op09_cotrain.TARGETS for v in ("", "_text", "_meta")]
    got = {r["doc_id"]: [r[x] for x in names] for r in op09_cotrain.classify(table, marks).collect()}
    assert words >= 3 and set(got) == set(want)
    for d, scores in want.items():
        assert got[d] == pytest.approx(scores, abs=1e-6)
    for x in (0, 3):  # scores that differ, so that the comparison says something
        assert len({round(got[d][x], 3) for d in got}) > 100


def test_cotraining_awkward_rows(spark):
    rng = random.Random(25)
    rows = []
    for i in range(400):
        bad = i % 2 == 0
        text = " ".join(f"w{rng.randrange(200)}" + (" spam" if bad and rng.random() < 0.5 else "") for _ in range(60))
        rows.append((i if i % 20 else None, text, "en", "s", 10, 1, "x", "y"))
    rows += [rows[1], rows[1], (3, None, None, None, None, 1, "x", "y"), (3, "", "", "", 0, 1, "x", "y"), (5000, " ".join(f"u{i}" for i in range(60_000)), "en", "s", 10, 1, "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row int, words string, stands string").repartition(4)
    marks = spark.createDataFrame([(i, i % 2, 0, 1) for i in range(200)] + [(5000, 1, 1, 1), (5000, 0, 0, 1), (None, 1, 1, 1)], "doc_id long, quality int, toxic int, chance int")
    got = op09_cotrain.classify(df, marks).collect()
    assert len(got) == len(rows) and all(0 <= r["quality"] <= 1 and 0 <= r["toxic"] <= 1 for r in got)
    held = [r for r in got if r["doc_id"] is not None and 200 <= r["doc_id"] < 400]
    assert np.mean([(r["quality"] >= 0.5) == (r["doc_id"] % 2 == 1) for r in held]) > 0.95
    same = [r for r in got if r["doc_id"] == 1]
    assert len(same) == 3 and len({tuple(r) for r in same}) == 1


def test_join_counted_deals_heavy_keys(spark, monkeypatch):
    monkeypatch.setattr(c, "HEAVY", 5)
    rng = random.Random(26)
    rows = [(i, "hot" if i % 3 else f"k{rng.randrange(40)}", None if i % 7 == 0 else "x") for i in range(600)]
    df = spark.createDataFrame(rows, "id long, key string, other string")
    counts = df.groupBy("key").count().withColumnRenamed("count", "n").where("n > 1")
    got = sorted((r["id"], r["n"]) for r in c.join_counted(df, c.cut(counts, "counts"), ["key"], ["id"]).collect())
    have = {k: sum(r[1] == k for r in rows) for k in {r[1] for r in rows}}
    assert got == sorted((i, have[k]) for i, k, _ in rows if have[k] > 1)
    assert c.join_counted(df.where("false"), c.cut(counts.where("false"), "none"), ["key"], ["id"]).count() == 0


def test_mixing_of_one_network_with_many_patterns():
    """100,000 patterns over 60 sources, one connected network: all quotas are met within the offers, patterns used evenly."""
    rng = random.Random(33)
    patterns = {}
    while len(patterns) < 100_000:
        patterns[tuple(sorted(rng.sample(range(60), rng.randrange(1, 6))))] = rng.randrange(1, 10**6)
    patterns = list(patterns.items())
    total, weights = sum(w for _, w in patterns), [1 + i % 3 for i in range(60)]
    quotas = [total * w // sum(weights) for w in weights]
    flow = op10_mixing.route(patterns, quotas, 3)
    got = [0] * 60
    for (sources, words), shares in zip(patterns, flow, strict=True):
        assert set(shares) <= set(sources) and 0 <= sum(shares.values()) <= 3 * words
        for s, n in shares.items():
            got[s] += n
    assert got == quotas


def test_mixing_of_single_sources_goes_through_the_flow(spark, monkeypatch):
    solved, solve = [], op10_mixing._solve
    monkeypatch.setattr(op10_mixing, "_solve", lambda most: solved.append(most) or solve(most))
    rows = [(i, " ".join(["w"] * (i % 7)), [None, "a", "b", "c"][i % 4]) for i in range(200)]
    got = op10_mixing.mix_by_source(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert solved == [3] and len(got) == 200
    for s in (None, "a", "b", "c"):
        mine = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 18  # three documents of six words
