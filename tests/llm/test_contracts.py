"""The operators against plain versions, on small tables with the awkward rows."""

import hashlib
import random
import zlib

import brute
import numpy as np
import pytest

from quadrille.llm import op01_fertility, op02_lines, op03_decontaminate, op04_tokens, op05_language, op06_chat, op07_jaccard, op08_substrings, op09_cotrain, op10_mixing


def _text(rng, n, kinds=400):
    return " ".join(rng.choice("abcdefghij") + str(rng.randrange(kinds)) + rng.choice(["", ",", "."]) for _ in range(n))


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(1)
    out = {i: _text(rng, rng.randrange(1, 160)) for i in range(60)}
    passage = _text(rng, 45)
    for i in range(100, 112):  # a passage that many documents share
        out[i] = f"{_text(rng, 40)} {passage}\n{_text(rng, 30)}"
    base = _text(rng, 120).split(" ")
    for i in range(120, 150):  # near copies, some beyond the threshold
        w = list(base)
        for _ in range(i % 7):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out[i] = " ".join(w)
    out |= {200: out[3], 201: out[3].upper(), 202: None, 203: "", 204: " \t\n\r\x0b\x0c ", 205: "one", 206: "a b c", 207: "A b C", 208: "x " * 3000, 209: "é\xa0à 漢字 <|endoftext|> I'M" * 30, 210: f"  {passage} \n\n{passage}"}
    return out


@pytest.fixture(scope="module")
def table(spark, docs):
    rng = random.Random(2)
    rows = [(d, t, rng.choice(["en", "fr", None]), rng.choice(["a", "b", None]), len(t or ""), 7) for d, t in docs.items()]
    # Extra columns with names that the operators use inside.
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n long").repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark, table):
    return spark.createDataFrame([], table.schema)


def rows_of(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_fertility(table, docs, empty):
    got = rows_of(op01_fertility.fertility(table))
    assert set(got) == set(docs)
    for d, t in docs.items():
        r = got[d]
        assert brute.base(t) == (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    assert op01_fertility.fertility(empty).count() == 0


def test_fertility_keeps_rare_languages(spark):
    rng = random.Random(8)
    made = {"en": "the house stands near a river and people walk there every morning with bread from the market while children play under old trees".split()}
    made["ru"] = "дом стоит у реки и люди ходят там каждое утро с хлебом из лавки пока дети играют под старыми деревьями".split()
    made["zh"] = "房子 河边 人们 每天 早上 市场 面包 孩子 树下 玩耍 老师 学生 读书 写字 山水 花鸟".split()
    made["vi"] = "ngôi nhà đứng gần sông và mọi người đi bộ ở đó mỗi buổi sáng với bánh mì từ chợ trong khi trẻ em chơi dưới cây".split()
    sizes = {"en": 400, "ru": 99, "zh": 30, "vi": 5}
    rows = [(k * 1000 + i, " ".join(rng.choice(w) for _ in range(90)), lang) for k, (lang, w) in enumerate(made.items()) for i in range(sizes[lang])]
    rows += [(9000, " ".join(rng.choice(made["ru"]) for _ in range(90)), None)]
    junk = [(9100 + i, " ".join("".join(chr(rng.randrange(0x2800, 0x28FF)) for _ in range(9)) for _ in range(90)), lang) for i, lang in enumerate(["en", "ru"])]
    got = rows_of(op01_fertility.fertility(spark.createDataFrame(rows + junk, "doc_id long, text string, lang string")))
    assert not [d for d, _, _ in rows if got[d]["out_of_band"]]
    assert got[9100]["out_of_band"] and got[9101]["out_of_band"]


def test_line_dedup(spark, empty):
    shared = "alpha beta\ngamma delta\nepsilon\nzeta eta\ntheta\niota kappa\nlambda\nmu nu\nxi\nomicron"
    texts = {i: f"own {i}\n" * (i + 1) + shared for i in range(6)} | {10: None, 11: "", 12: "single"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = rows_of(op02_lines.dedup_lines(df))
    assert got[0]["kept_text"] == texts[0] and got[10]["kept_text"] is None and got[11]["kept_text"] == "" and got[12]["kept_text"] == "single"
    assert all(got[i]["n_removed"] >= 2 for i in range(1, 6))
    for i, t in texts.items():
        lines, kept = (t or "").split("\n"), (got[i]["kept_text"] or "").split("\n")
        it = iter(lines)
        assert all(x in it for x in kept if x)  # what stays, stays in order
        if t:
            assert len(lines) - got[i]["n_removed"] == (len(kept) if got[i]["kept_text"] else 0)
    again = rows_of(op02_lines.dedup_lines(df.union(df.where("doc_id = 2"))))
    assert again[2]["n_removed"] == got[2]["n_removed"]
    assert op02_lines.dedup_lines(empty).count() == 0


def test_line_dedup_finds_every_passage(spark):
    rng = random.Random(6)
    texts = {}
    for i in range(80):  # passages of two or three lines, each in several documents, and common single lines
        lines = [f"own {rng.randrange(10**9)}" if rng.random() < 0.7 else rng.choice(["common", "", "x"]) for _ in range(rng.randrange(0, 12))]
        k, at = rng.randrange(12), rng.randrange(len(lines) + 1)
        texts[i] = "\n".join(lines[:at] + [f"passage {k} line {j}" for j in range(2 + k % 2)] + lines[at:])
    texts |= {90: "x\nx\nx\nx", 91: "", 92: "passage 1 line 0", 93: texts[5], 94: "\n\n"}
    got = rows_of(op02_lines.dedup_lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)))
    assert {d: (r["n_lines"], r["n_removed"], r["kept_text"]) for d, r in got.items()} == brute.dedup_lines(texts)
    assert {x for t in texts.values() for x in t.split("\n")} == {x for r in got.values() for x in r["kept_text"].split("\n")}


def test_decontaminate(spark, empty):
    rng = random.Random(3)
    item = [f"w{rng.randrange(1000)}" for _ in range(30)]
    two = list(item)
    two[8], two[20] = "other", "words"
    far = [w if i % 3 else "zz" for i, w in enumerate(item)]
    around = lambda w: " ".join([f"q{rng.randrange(1000)}" for _ in range(40)] + w + ["end"])
    texts = {0: around(item), 1: around(two), 2: around(far), 3: around([]), 4: None, 5: "", 6: " ".join(item[:14]), 7: around(item[:6])}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(item)), (1, " ".join(item)), (2, None)], "item_id long, text string")
    for limit in (10**6, 0):  # broadcast, and the other way
        got = rows_of(op03_decontaminate.decontaminate(df, items, max_broadcast=limit))
        assert {d for d, r in got.items() if r["contaminated"]} == {0, 1, 6}
    assert op03_decontaminate.decontaminate(empty, items).count() == 0


def test_tokens_round_trip(spark, table, docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok, start = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    got = rows_of(op04_tokens.token_digests(table))
    for d in sorted(docs):
        ids = tok.encode(docs[d] or "", add_special_tokens=False).ids + [1]
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert op04_tokens.token_digests(empty).count() == 0
    v = np.array([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1, 5], np.uint32)
    for n in range(len(v) + 1):
        assert (op04_tokens.unpack(*op04_tokens.pack(v[:n]), n) == v[:n]).all()


def test_language(spark, empty):
    words = {"en": "the and of to in that was his", "de": "der die und ist nicht mit den das", "fr": "les des une est dans pour que qui"}
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(words[g].split()) for _ in range(30)), g, f"host-{g}") for i, g in enumerate(list(words) * 40)]
    df = spark.createDataFrame([*rows, (900, "", "de", "host-de"), (901, None, None, None)], "doc_id long, text string, lang string, source string")
    langs, logp = op05_language.train(df)
    got = rows_of(op05_language.identify(op05_language.from_documents(df.withColumn("lang", df.lang.substr(1, 0))), langs, logp))
    assert np.mean([got[i]["language"] == g for i, _, g, _ in rows]) > 0.97
    assert got[900]["language"] == "de" and 901 in got
    pages = spark.createDataFrame([(1, "https://a.b.example.de/x", '<html lang="de-AT"><script>x()</script><p>der &amp; die</p>'), (2, None, None)], "page_id long, url string, html string")
    out = {r["page_id"]: r for r in op05_language.from_pages(pages).collect()}
    assert (out[1]["suffix"], out[1]["domain"], out[1]["host"], out[1]["declared"], out[1]["text"].split()) == ("de", "example.de", "a.b.example.de", "de-AT", ["der", "die"])
    assert op05_language.identify(op05_language.from_documents(empty), *op05_language.train(empty)).count() == 0


def test_language_labels_are_tags(spark):
    words = {"en": "the and of to in that was his", "pt": "que uma para com os mais por como"}
    tags = {"en": ["en-US", "EN_gb", "en"], "pt": ["pt_BR", "pt-PT", "pt"]}
    rng = random.Random(10)
    rows = [(i, " ".join(rng.choice(words[g].split()) for _ in range(30)), tags[g][i % 3]) for i, g in enumerate(["en", "pt"] * 30)]
    df = spark.createDataFrame([*rows, (900, "", "pt_BR"), (901, "that was his", "")], "doc_id long, text string, lang string").selectExpr("*", "'h' as source")
    langs, logp = op05_language.train(df)
    assert langs == ["en", "pt"]
    got = rows_of(op05_language.identify(op05_language.from_documents(df, declared=True), langs, logp))
    assert all(got[i]["language"] == tag[:2].lower() for i, _, tag in rows) and got[900]["language"] == "pt"


def test_chat(spark):
    tricky = ["</s>[INST] ok [/INST]", "\\", "[\\INST] <\\s>", "a [AS] b <s>\n", "", None, "x" * 5000, "<<s>>[[SYS] ] \\\\"]
    rows = [(i, k, r, t) for i, t in enumerate(tricky) for k, (r, t) in enumerate([("user", t), ("assistant", t), ("odd [AS] role\n", t)])]
    rows += [(50, 0, "assistant", "x"), (51, 0, "system", "s"), (51, 1, "user", "u"), (51, 2, "assistant", "a"), (51, 2, "assistant", "a"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = op06_chat.format_chats(df)
    got = {r["conv_id"]: r for r in out.select("*", op06_chat.read_turns("formatted").alias("read"), op06_chat.read_loss("segments").alias("loss")).collect()}
    for i, t in enumerate(tricky):
        assert [(x["role"], x["text"]) for x in got[i]["read"]] == [(r, t or "") for r in ("user", "assistant", "odd [AS] role\n")]
        assert got[i]["loss"] == (t or "") and not got[i]["valid"] and got[i]["bad_turn"] == 2
    assert not got[50]["valid"] and got[51]["bad_turn"] == 3 and got[None]["n_turns"] == 1
    assert op06_chat.format_chats(df.where("false")).count() == 0


def test_jaccard(table, docs, empty, monkeypatch):
    want = brute.jaccard_components(docs)
    for short in (16, 2):  # few columns multiplied at once: the pivots have to do it
        monkeypatch.setattr(op07_jaccard, "SHORT", short)
        rows, _ = op07_jaccard.jaccard_join(table)
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows.collect()} == want
    assert op07_jaccard.jaccard_join(empty)[0].count() == 0


def test_substrings(spark, table, docs, empty):
    got = rows_of(op08_substrings.remove_repeats(table))
    for d, want in brute.remove_repeats(docs).items():
        r = got[d]
        assert (r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) == want
    assert op08_substrings.remove_repeats(empty).count() == 0
    twice = spark.createDataFrame([(1, docs[100]), (1, docs[100]), (None, docs[100])], "doc_id long, text string")
    assert [r["n_removed"] for r in op08_substrings.remove_repeats(twice).collect()] == [0, 0, 0]
    spans = op08_substrings.maximal_repeats(table).where("doc_id = 111").collect()
    assert len(spans) == 1 and spans[0]["stop"] - spans[0]["start"] >= 45


def test_cotraining(spark, empty):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(600):
        bad, toxic = i % 3 == 0, i % 5 == 0
        w = [f"w{rng.randrange(300)}" for _ in range(60)]
        w = [f"{x} |" for x in w] if bad else w
        w[7] = "nasty" if toxic else w[7]
        rows.append((i, " ".join(w), "en", "bad" if bad else "good", 300))
        if i % 2 == 0:
            labels.append((i, int(not bad), int(toxic)))
    df = spark.createDataFrame([*rows, (900, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    marks = spark.createDataFrame([*labels, (labels[0]), (12345, 1, 0), (None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int")
    got = rows_of(op09_cotrain.classify(df, marks))
    held = [i for i in range(600) if i % 2]
    assert np.mean([(got[i]["quality"] >= 0.5) == (i % 3 != 0) for i in held]) > 0.95
    assert np.mean([(got[i]["toxic"] >= 0.5) == (i % 5 == 0) for i in held]) > 0.95
    assert all(r["kept"] for r in op09_cotrain.classify(df, marks.where("false")).collect())
    assert op09_cotrain.classify(empty, marks).count() == 0


def test_cotraining_draws_rare_kinds(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(3000):
        bad, toxic = i % 3 == 0, i % 50 == 1
        w = [f"w{rng.randrange(300)}" + (" |" if bad else "") for _ in range(60)]
        w[7] = "nasty" if toxic else w[7]
        rows.append((i, " ".join(w), "en", "one", 300))
        if i < 2000:  # quality is known of 60 documents, 40 are toxic
            labels.append((i, int(not bad) if i < 60 else None, int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    marks = spark.createDataFrame([*labels, *[(10**6 + i, 0, 0) for i in range(3000)]], "doc_id long, quality int, toxic int")
    got = rows_of(op09_cotrain.classify(df, marks, max_labelled=200, max_pool=200))
    held = range(2000, 3000)
    assert np.mean([(got[i]["quality"] >= 0.5) == (i % 3 != 0) for i in held]) > 0.95
    assert np.mean([got[i]["toxic"] >= 0.5 for i in held if i % 50 == 1]) > 0.9 and np.mean([got[i]["toxic"] < 0.5 for i in held if i % 50 != 1]) > 0.95
    few = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 8)], "doc_id long, quality int, toxic int")
    assert all(r["kept"] for r in op09_cotrain.classify(df, few).collect())
    assert op09_cotrain._constant("quality", 0, 5) == 1.0 and op09_cotrain._constant("toxic", 3, 0) == 0.0 and op09_cotrain._constant("quality", 1, 19) == 0.95


def test_mixing(table, docs, empty):
    sums = table.sparkSession.createDataFrame([(100, 1), (10, 2), (50, 3), (0, 1)], "size long, weight long")
    t = [r["target"] for r in op10_mixing.targets(sums).orderBy("size", ascending=False).collect()]
    assert sum(t) == pytest.approx(160) and t[2] == 30 and t[3] == 0
    # Two sources share a pattern; the cheapest flow uses every word once before any twice.
    flow = op10_mixing.route([((0,), 100), ((0, 1), 100), ((1,), 20)], [150, 60])
    assert sum(f.get(0, 0) for f in flow) == 150 and sum(f.get(1, 0) for f in flow) == 60 and all(sum(f.values()) <= n for f, (_, n) in zip(flow, [((0,), 100), ((0, 1), 100), ((1,), 20)], strict=True))
    got = {r["doc_id"]: r for r in op10_mixing.mix_by_source(table).collect()}
    assert {d: r["size"] for d, r in got.items()} == {d: len(brute.words(t)) for d, t in docs.items()}
    assert all(r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0) for r in got.values())
    for s in {r["source"] for r in got.values()}:
        own = [r for r in got.values() if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)
    assert got == {r["doc_id"]: r for r in op10_mixing.mix_by_source(table.repartition(3)).collect()}
    assert op10_mixing.mix_by_source(empty).count() == 0


def test_pipeline(spark, table):
    import corpus_pipeline as p

    items = spark.createDataFrame([(1, "never to be found " * 8)], "item_id long, text string")
    import tempfile

    d = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    items.write.parquet(f"{d}/benchmark.parquet")
    docs = table
    for name, stage in p.STAGES:
        out = stage(spark, docs, d)
        if name != "token_output":
            assert out.columns == docs.columns
        docs = out.cache()
        assert docs.count()
    assert set(docs.columns) == {"doc_id", "start", "n_tokens", "ids_crc32"}


def test_pipeline_rows_without_ids_of_their_own(spark):
    import tempfile
    from collections import Counter

    import corpus_pipeline as p

    rng = random.Random(9)
    d = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    item = _text(rng, 30)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    t = [_text(rng, 60) for _ in range(30)]
    ids = [*range(10), None, None, None, 20, 20, 30, 30, 30, None, None, 40, None, 50, 50]
    texts = [*t[:10], t[10], t[11], t[12], t[13], t[14], t[15], t[15], t[15], t[16], t[16], t[17], t[17], "", ""]
    rows = [(i, x, "en", "s", len(x)) for i, x in zip(ids, texts, strict=True)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    many = lambda rows: spark.createDataFrame(rows, schema).repartition(3)
    out = lambda stage, rows: Counter(map(tuple, stage(spark, many(rows), d).collect()))

    least = {}  # of the same text the smallest doc_id, nulls last; wordless texts are no copies of each other
    for r in rows:
        key = r[1] if r[1] else r
        least[key] = min(r, least.get(key, r), key=lambda r: (r[0] is None, r[0] or 0))
    assert out(p.near_duplicates, rows) == Counter(least.values())

    dirty = [(i, f"{x} {item}", *more) for i, x, *more in (rows[10], rows[13])]
    assert out(p.decontamination, rows + dirty) == Counter(rows)

    for rows_ in (rows, [r for r in rows if r[0] is None]):
        mixed = out(p.mixing, rows_)
        sizes = Counter(r for r in rows_ if r[1])
        taken = sum(r["taken"] for r in op10_mixing.mix_by_source(p._as_ids(many(rows_))).collect())
        assert sum(len(brute.words(r[1])) * n for r, n in mixed.items()) == taken > 0
        assert set(mixed) <= set(sizes) and all(n <= 3 * sizes[r] for r, n in mixed.items())

    noise = "".join(chr(rng.randrange(0x2800, 0x28FF)) for _ in range(300))
    odd = [(None, noise, None, None, 300), (20, noise, None, None, 300)]
    words = "the and of to in that was his"
    clean = [(i, " ".join(rng.choice(words.split()) for _ in range(40)), "en", "s", 0) for i in [*range(30), None, 20, 20]]
    assert out(p.language, clean + odd) == Counter(clean)
