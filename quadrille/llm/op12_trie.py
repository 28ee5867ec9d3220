"""Prefix trie of conversations: blocks of turns are grouped first, turns only where siblings diverge.

A turn is a digest of role and text; its place and digest give two hashes, and their xor over the first d turns names a
prefix in 128 bits. Conversations are cut into blocks of a fixed length. Blocks with the same way to them are
grouped by their digests, so copies are counted once from here on. Where all that go on after a prefix share the next
block, its turns are nodes as they stand; only where they do not, the distinct blocks are taken apart turn by turn.

Sums over subtrees: nodes on one way with the same members form a chain, named by the smallest member and the number of
members. What hangs below a chain hangs at its last node. Chains add up by pointer doubling, so the rounds are the
logarithm of the deepest nesting of chains, and a chain's nodes differ by running sums of their own parts.

Defined results: null role and text are empty; null turns come first, ties in turn are ordered by role, then text, and
repeated rows are turns of their own; rows with a null conv_id belong to no conversation; a conversation without turns
is a member of the root; without conversations there are no nodes; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm import common as c

#: Turns of a block.
BLOCK = 4
#: Conversation ids of one text of ends; a group of ids never has more.
ENDS = 1 << 16
KEY, ABOVE, CHAIN = ["depth", "a", "b"], ["above_depth", "above_a", "above_b"], ["conv_id", "n_convs"]


def ordered(rows: DataFrame) -> DataFrame:
    """rows: conv_id, turn, role, text. Returns conv_id, place (from 1), digest, bytes of the text; texts stay behind."""
    role, text = [F.coalesce(F.col(x).cast("string"), F.lit("")) for x in ("role", "text")]
    rows = rows.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    return rows.select("conv_id", place.alias("place"), digest.alias("digest"), F.octet_length("text").cast("long").alias("bytes"))


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The contract's conversations: (conv_id; conv_id, depth, digest, bytes). The first h turns are those of another conversation."""
    turns = c.cut(turns, "trie_turns")
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    firsts = turns.where("place <= 8").withColumnRenamed("conv_id", "base")
    n_first = firsts.groupBy("base").agg(F.count("*").alias("n_first"))
    convs = convs.withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % 9).cast("int")).withColumn("base", F.col("conv_id") - F.col("conv_id") % 5)
    convs = c.cut(convs.join(n_first, "base", "left").withColumn("n_first", F.least("h", F.coalesce("n_first", F.lit(0)))), "trie_convs")
    given = convs.select("conv_id", "base", "h").join(firsts, "base").where("place <= h").select("conv_id", F.col("place").alias("depth"), "digest", "bytes")
    own = c.join_counted(turns, convs.select("conv_id", "n", "h", "n_first"), ["conv_id"], ["place"]).where("place > h")
    own = own.select("conv_id", (F.col("place") - F.col("h") + F.col("n_first")).cast("int").alias("depth"), "digest", "bytes")
    return convs.select("conv_id"), given.unionByName(own)


def _xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def _alone(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks that all share who go on after a prefix, the others)."""
    key = ["block", *ABOVE[1:]]
    alone = rows.groupBy(*key).agg(F.count("*").alias("variants"), F.min("a").alias("a"), F.min("b").alias("b")).where("variants = 1").select(*key, "a", "b")
    whole = [*key, "a", "b"]  # names one variant, so no key is heavy
    return rows.join(alone, whole, "left_semi"), rows.join(alone, whole, "left_anti")


def prefix_nodes(convs: DataFrame, turns: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """convs: conv_id. turns: conv_id, depth (from 1, without gaps), digest, bytes.

    Returns nodes (depth, a, b: the key; above_depth, above_a, above_b: the parent's; conv_id: smallest member, n_convs,
    bytes of the last text) and members (conv_id and the key of the node where the conversation ends)."""
    hashed = turns.select("conv_id", "depth", F.xxhash64("depth", "digest").alias("a"), F.xxhash64(F.lit("second"), "digest", "depth").alias("b"), "bytes")
    at = F.floor((F.col("depth") - 1) / block).cast("int")
    blocks = hashed.groupBy("conv_id", at.alias("block")).agg(F.sort_array(F.collect_list(F.struct("depth", "a", "b", "bytes"))).alias("turns"), *[F.bit_xor(x).alias(f"own_{x}") for x in "ab"])
    so_far = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    blocks = blocks.withColumns({x: F.bit_xor(f"own_{x}").over(so_far) for x in "ab"})
    blocks = blocks.withColumns({f"above_{x}": _xor(F.col(x), F.col(f"own_{x}")) for x in "ab"})
    same = ["block", "above_a", "above_b", "a", "b"]
    variants = c.cut(blocks.groupBy(*same).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("turns").alias("turns")), "trie_blocks")

    def step(turn: Column, i: Column) -> Column:
        """One turn of a block as a node: its key, its parent's, its bytes."""
        upto = lambda x: F.aggregate(F.transform(F.slice("turns", 1, i + 1), lambda t: t[x]), F.col(f"above_{x}"), _xor)
        key = {x: upto(x) for x in "ab"}
        above = {x: _xor(key[x], turn[x]) for x in "ab"}
        return F.struct(turn["depth"].alias("depth"), key["a"].alias("a"), key["b"].alias("b"), (turn["depth"] - 1).alias("above_depth"), above["a"].alias("above_a"), above["b"].alias("above_b"), turn["bytes"].alias("bytes"))

    split = lambda rows: rows.select("conv_id", "n_convs", F.inline(F.transform("turns", step)))
    alone, others = _alone(variants)
    refined = split(others).groupBy(*KEY, *ABOVE).agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.first("bytes").alias("bytes"))
    zero, none = F.lit(0).cast("long"), F.lit(None)
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(F.lit(0).alias("depth"), zero.alias("a"), zero.alias("b"), none.cast("int").alias("above_depth"), *[none.cast("long").alias(x) for x in ABOVE[1:]], *CHAIN, zero.alias("bytes"))
    nodes = root.unionByName(split(alone)).unionByName(refined)
    ends = hashed.groupBy("conv_id").agg(F.max("depth").alias("depth"), *[F.bit_xor(x).alias(x) for x in "ab"])
    members = convs.join(ends, "conv_id", "left").select("conv_id", F.coalesce("depth", F.lit(0)).alias("depth"), *[F.coalesce(x, zero).alias(x) for x in "ab"])
    return nodes, members


def _double(chains: DataFrame) -> DataFrame:
    """chains: conv_id, n_convs (the key), up_id, up_n (the chain above, null for the root's), saved, leaves. Adds to each chain what lies below."""
    up = ["up_id", "up_n"]
    while not chains.where("up_id is not null").isEmpty():
        below = chains.where("up_id is not null").groupBy(*up).agg(F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"), F.count("*").alias("n"))
        both = chains.join(below.select(F.col("up_id").alias("conv_id"), F.col("up_n").alias("n_convs"), "more_saved", "more_leaves", "n"), CHAIN, "left").na.fill(0, ["more_saved", "more_leaves"])
        both = c.cut(both.select(*CHAIN, *up, (F.col("saved") + F.col("more_saved")).alias("saved"), (F.col("leaves") + F.col("more_leaves")).alias("leaves"), "n"), "trie_chains")
        groups = both.where("n is not null").select(F.col("conv_id").alias("up_id"), F.col("n_convs").alias("up_n"), F.col("up_id").alias("next_id"), F.col("up_n").alias("next_n"), "n")
        low = c.join_counted(both.where("up_id is not null").drop("n"), groups, up, CHAIN)
        low = low.select(*CHAIN, F.col("next_id").alias("up_id"), F.col("next_n").alias("up_n"), "saved", "leaves")
        chains = c.cut(both.where("up_id is null").drop("n").unionByName(low), "trie_doubled")
    return chains


def trie(convs: DataFrame, turns: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """As prefix_nodes(); nodes have parent_conv_id, n_children, n_leaves and saved_tokens (over the subtree) besides."""
    nodes, members = prefix_nodes(convs, turns, block)
    nodes = c.cut(nodes, "trie_nodes")
    kids = nodes.where("depth > 0").groupBy(*[F.col(x).alias(y) for x, y in zip(ABOVE, KEY, strict=True)]).agg(F.count("*").alias("n_children"))
    nodes = c.cut(nodes.join(kids, KEY, "left").na.fill(0, ["n_children"]), "trie_children")
    groups = nodes.where("n_children > 0").select(*[F.col(x).alias(y) for x, y in zip(KEY, ABOVE, strict=True)], F.col("conv_id").alias("parent_conv_id"), F.col("n_convs").alias("parent_n"), F.col("n_children").alias("n"))
    low = c.join_counted(nodes.where("depth > 0"), groups, ABOVE, KEY).drop("n")
    none = F.lit(None).cast("long")
    nodes = c.cut(nodes.where("depth = 0").withColumns({"parent_conv_id": none, "parent_n": none}).unionByName(low), "trie_linked")

    part = (F.col("n_convs") - 1) * F.col("bytes")
    shared = nodes.where("n_convs > 1").withColumn("part", part)
    top = F.min(F.struct("depth", "parent_conv_id", "parent_n")).alias("top")
    chains = shared.groupBy(*CHAIN).agg(F.sum("part").alias("saved"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaves"), top)
    chains = chains.select(*CHAIN, F.col("top.parent_conv_id").alias("up_id"), F.col("top.parent_n").alias("up_n"), "saved", "leaves")
    single = nodes.where("n_convs = 1 and parent_n > 1").groupBy(F.col("parent_conv_id").alias("conv_id"), F.col("parent_n").alias("n_convs")).agg(F.count("*").alias("single"))
    chains = chains.join(single, CHAIN, "left").na.fill(0, ["single"]).withColumn("leaves", F.col("leaves") + F.col("single")).drop("single")
    totals = _double(c.cut(chains, "trie_chain")).select(*CHAIN, "saved", "leaves")

    before = F.coalesce(F.sum("part").over(Window.partitionBy(*CHAIN).orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = shared.withColumn("before", before).join(totals, CHAIN).withColumn("saved_tokens", F.col("saved") - F.col("before")).withColumnRenamed("leaves", "n_leaves")
    out = [*KEY, "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    alone = nodes.where("n_convs = 1").withColumns({"n_leaves": F.lit(1).cast("long"), "saved_tokens": F.lit(0).cast("long")})
    return sums.select(*out).unionByName(alone.select(*out)), members


def ends_digest(members: DataFrame) -> DataFrame:
    """The key of each node where conversations end, and ends_sha256 of their ids in order, joined by commas.

    Ids come in texts of a range of ids each; a task hashes the texts of a node one after the other."""
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    texts = members.groupBy(*KEY, F.floor(F.col("conv_id") / ENDS).alias("part")).agg(ids.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha, out = None, None, []
        for batch in batches:
            for *now, ids in zip(*[batch.column(x).to_pylist() for x in (*KEY, "ids")], strict=True):
                if key != now:
                    if key is not None:
                        out.append((*key, sha.hexdigest()))
                    key, sha = now, hashlib.sha256(ids.encode())
                else:
                    sha.update(f",{ids}".encode())
            if out:
                yield _as_batch(out)
        if key is not None:
            yield _as_batch([(*key, sha.hexdigest())])

    texts = texts.repartition(*KEY).sortWithinPartitions(*KEY, "part")
    return texts.mapInArrow(c.tidy(run), "depth int, a long, b long, ends_sha256 string")


def _as_batch(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.string())
    batch = pa.RecordBatch.from_arrays([pa.array(col, k) for col, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[*KEY, "ends_sha256"])
    out.clear()
    return batch
