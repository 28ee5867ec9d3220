"""Repair, trie and fingerprints against plain versions, on awkward rows and on the given tables."""

import random
from collections import Counter
from types import SimpleNamespace

import brute
import numpy as np
import pytest

from quadrille.llm import common as c
from quadrille.llm import op11_repair, op12_trie, op13_sketch, queries

SF = "/root/testdata/sf0.001"
ROLES = ["user", "assistant", "system", "user", "assistant", "tool", "", None]
TEXTS = ["Yes.", "No!", "Why", "so it is", " \t", "", None, "a?\n", "x" * 5000 + "."]


def awkward_turns(seed, n=60):
    rng, rows = random.Random(seed), []
    for conv in [*range(n), None]:
        for k in range(rng.randrange(0, 13)):
            rows.append((conv, rng.choice([k, k, k, k // 2, None]), rng.choice(ROLES), rng.choice(TEXTS)))
    rows += [rows[3], rows[3], (90, None, "user", "Hi."), (91, 5, None, None), (92, 1, "user", "The end."), (92, 9, "assistant", "Fine.")]
    rows += [(100 + i, k, "user" if k % 2 == 0 else "assistant", f"same {k}.") for i in range(40) for k in range(9)]  # a third of all rows
    return rows


@pytest.fixture
def folder(spark, tmp_path):
    def write(name, rows, kinds):
        spark.createDataFrame(rows, kinds).repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def test_a_session_without_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir must name, when the session starts, a folder"):
        c.scratch_path(SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None)), "x")


def test_survivors_against_all_edits():
    rng = random.Random(5)
    for _ in range(500):
        turns = [(k, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["A.", "b", "", f"{k}?", "c!"])) for k in range(rng.randrange(0, 9))]
        ops, lines, seen, cost = [], [], set(), 0

        def emit(node):
            nonlocal cost
            ops.append(node.op)
            cost += node.cost
            if node.op != "D":
                lines.append(f"{node.role}:{node.row[2] if node.row else ''}")

        machine = op11_repair.Survivors(op11_repair.Costs(), emit)
        for turn, role, text in turns:
            machine.add((turn, role, text, op11_repair.fault_of(text, (role, text) in seen)))
            seen.add((role, text))
        machine.end()
        want = brute.repair(turns)
        assert (cost, "".join(ops)) == want[5:7], turns
        assert brute.hashlib.sha256("\n".join(lines).encode()).hexdigest() == want[7]


def test_survivors_hold_what_is_unresolved_only():
    sent, held = [], 0
    machine = op11_repair.Survivors(op11_repair.Costs(), sent.append)
    for k in range(20_000):
        machine.add((k, "user" if k % 2 == 0 else "assistant", f"{k}.", None))

        if k % 50 == 0:
            found = [machine.root]
            for node in found:
                found.extend(node.kids)
            held = max(held, len(found))
    machine.end()
    assert len(sent) == 20_000 and held < 40


def test_repair_awkward_rows(spark, folder):
    rows = awkward_turns(1)
    sf = folder("conversations", [(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, seen string")
    got = {r[0]: tuple(r)[1:] for r in queries.op11_repair_turns(spark, sf).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}
    after = brute.conversations(brute.damaged(rows), " ")
    assert got == {conv: brute.repair(after.get(conv, [])) for conv in {r[0] for r in rows}}


def test_repair_gives_the_repaired_turns(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hm."), (1, 2, "system", "No."), (2, 0, "assistant", "Yes.")]
    got = op11_repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("conv_id", "step").collect()
    assert [(r.conv_id, r.op, r.found_role, r.role, r.text, r.cost) for r in got] == [(1, "D", "user", "user", "Hi.", 2), (1, "K", "user", "user", "Hm.", 0), (1, "R", "system", "assistant", "No.", 1), (2, "D", "assistant", "assistant", "Yes.", 2)]


def as_nodes(rows):
    return {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}


def test_trie_awkward_rows(spark, folder):
    rows = awkward_turns(2)
    sf = folder("conversations", [(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, depth int, a int")
    rows = queries.op12_prefix_trie(spark, sf).collect()
    assert len(as_nodes(rows)) == len(rows)
    assert as_nodes(rows) == brute.trie(brute.rebuilt(awkward_turns(2)))


@pytest.mark.parametrize("block", [1, 3, 8])
def test_trie_of_nested_conversations(spark, block):
    """Deep nesting, a conversation without turns, copies, and blocks of any length give the same nodes."""
    rng = random.Random(block)
    convs = {0: []} | {i: [("u", "x" * k) for k in range(i)] for i in range(1, 30)} | {i: [("u", "x" * k) for k in range(rng.randrange(20))] + [("a", rng.choice("pq"))] * rng.randrange(4) for i in range(30, 60)}
    rows = [(conv, d + 1, f"{r}{t}".encode(), len(t)) for conv, turns in convs.items() for d, (r, t) in enumerate(turns)]
    turns = spark.createDataFrame(rows, "conv_id long, depth int, digest binary, bytes long")
    nodes, members = op12_trie.trie(spark.createDataFrame([(x,) for x in convs], "conv_id long"), turns, block)
    got = nodes.join(op12_trie.ends_digest(members), op12_trie.KEY, "left").na.fill({"ends_sha256": brute.hashlib.sha256(b"").hexdigest()})
    assert as_nodes(got.collect()) == brute.trie(convs)


def test_ends_in_several_texts(spark, monkeypatch):
    monkeypatch.setattr(op12_trie, "ENDS", 7)
    ids = random.Random(3).sample(range(-50, 200), 120)
    members = spark.createDataFrame([(i, 0, 0, i % 2) for i in ids], "conv_id long, depth int, a long, b long")
    got = {r.b: r.ends_sha256 for r in op12_trie.ends_digest(members).collect()}
    assert got == {k: brute.hashlib.sha256(",".join(str(i) for i in sorted(ids) if i % 2 == k).encode()).hexdigest() for k in (0, 1)}


def alike(a, b):
    a, b = (Counter(op13_sketch.PARAGRAPH.findall(x)) for x in (a, b))
    every = (a | b).total()
    return (a & b).total() / every if every else 1.0


def test_paragraphs_hold_every_character():
    rng = random.Random(1)
    for _ in range(2000):
        text = "".join(rng.choice("ab, .;\n\t !é") for _ in range(rng.randrange(60)))
        assert "".join(op13_sketch.PARAGRAPH.findall(text)) == text


def test_fingerprints_of_awkward_documents(spark, folder):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["one", "two,", "three.", "four\n", "é", "\U0001f600"]) for _ in range(rng.choice([0, 1, 5, 40, 300]))) for _ in range(80)]
    docs = [(i * 3, rng.choice([texts[i], texts[i], None, ""])) for i in range(80)] + [(1000, "long, " * 30_000), (1001, "x" * 100_000)]
    sf = folder("documents", [(*d, 1, "y") for d in docs], "doc_id long, text string, range int, h string")
    got = {r.doc_id: r for r in queries.op13_fingerprint(spark, sf).collect()}
    docs = [(d, t or "") for d, t in docs]
    assert len(got) == len(docs)
    prints = {}
    for (doc, text), (_, after) in zip(docs, [*docs[1:], docs[0]], strict=True):
        r, half = got[doc], len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert (r.n_chars, r.edited_sha256) == (len(text), brute.hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(alike(text, edited), abs=1e-12) and r.near_next == pytest.approx(alike(text, after), abs=1e-12)
        for x, y in ((text, r.fingerprint), (edited, r.edited_fingerprint)):
            assert prints.setdefault(x, y) == y
    assert len(set(prints.values())) == len(prints)


def test_next_of_shared_ids(spark):
    rows = [(rng_id, f"t{k % 7}") for k, rng_id in enumerate([None] * 20 + [5] * 30 + [1, 2, 9, 9, 11])] + [(5, "same")] * 40
    got = op13_sketch.with_next(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, beyond int").repartition(5)).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    assert Counter(r.next_text for r in got) == Counter(t for _, t in rows)
    once = {1: "t2", 11: None}
    by_id = {r.doc_id: r.next_text for r in got if r.doc_id in once}
    assert by_id[1] == next(t for d, t in rows if d == 2)
    assert by_id[11] in {t for d, t in rows if d is None}
    assert sum(r.next_text == "same" for r in got if (r.doc_id, r.text) == (5, "same")) == 39
    alone = op13_sketch.with_next(spark.createDataFrame([(3, "me")], "doc_id long, text string")).collect()
    assert [tuple(r) for r in alone] == [(3, "me", "me")]


def test_sketch_gives_back_the_difference():
    rng = np.random.default_rng(7)
    for n in (0, 1, 5, 40, 900):
        a, b = rng.integers(0, 1 << 63, n, dtype=np.uint64), rng.integers(0, 1 << 63, n // 3, dtype=np.uint64)
        both = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
        rows = lambda k: np.full(len(k), 1)
        left, right = np.concatenate([a, both]), np.concatenate([b, both])
        at, keys, signs, cells = op13_sketch.difference(3, (rows(left), left), (rows(right), right))
        assert set(keys[signs > 0]) == set(a) and set(keys[signs < 0]) == set(b) and set(at) <= {1}
        assert cells[0] == op13_sketch.CELLS and cells[1] >= len(a) + len(b)


def test_empty_tables(spark, folder):
    sf = folder("conversations", [], "conv_id long, turn long, role string, text string")
    folder("documents", [], "doc_id long, text string")
    for f in (queries.op11_repair_turns, queries.op12_prefix_trie, queries.op13_fingerprint):
        assert f(spark, sf).collect() == []


def test_given_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert as_nodes(queries.op12_prefix_trie(spark, SF).collect()) == brute.trie(brute.rebuilt(rows))


@pytest.mark.parametrize("ids", ["shared", "null"])
def test_cotraining_draws_rows_not_ids(spark, monkeypatch, ids):
    """A third of all rows with one labelled id, or null ids only: the samples keep to their sizes."""
    from pyspark.sql import functions as F

    from quadrille.llm import op09_cotrain

    rows = spark.range(6000).select(F.when(F.col("id") % 3 == 0, F.lit(7) if ids == "shared" else F.lit(None)).otherwise(F.col("id") if ids == "shared" else F.lit(None)).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 5500).alias("text"), F.lit("s").alias("source"), F.lit("en").alias("lang"), F.lit(9).cast("long").alias("n_chars"))
    labels = spark.range(0, 600).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    sizes, cut = {}, c.cut

    def counted(df, name):
        out = cut(df, name)
        if name == "cotrain_sample":
            sizes["labelled"], sizes["pool"] = out.where("coalesce(quality, toxic) is not null").count(), out.where("coalesce(quality, toxic) is null").count()
            assert out.select("row").distinct().count() == out.count()
        return out

    monkeypatch.setattr(op09_cotrain.c, "cut", counted)
    op09_cotrain.train(rows, labels, max_labelled=500, max_pool=1500)
    assert 0.85 * 1500 * (3667 / 5500 if ids == "shared" else 1) < sizes["pool"] < 1.1 * 1500
    assert sizes["labelled"] < 1.15 * 500 if ids == "shared" else sizes["labelled"] == 0
