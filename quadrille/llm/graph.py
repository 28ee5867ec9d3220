"""Connected components of a table of links, by alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quadrille.llm import common as c


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch's links as stars: every node with the smallest node that it reaches inside the batch."""
    for b in batches:
        if not b.num_rows:
            continue
        nodes, place = np.unique(np.concatenate([np.asarray(b.column(x)) for x in "ab"]), return_inverse=True)
        up = np.arange(len(nodes))
        x, y = place[: b.num_rows], place[b.num_rows :]
        while True:  # the smaller root of each link's ends goes to both, and roads are halved, until nothing changes
            low = np.minimum(up[x], up[y])
            before = up.copy()
            for side in (up[x], up[y], x, y):
                np.minimum.at(up, side, low)
            up = up[up]
            if (up == before).all():
                break
        leaf = up != np.arange(len(nodes))
        yield pa.record_batch([pa.array(nodes[up[leaf]]), pa.array(nodes[leaf])], names=["a", "b"])


#: Links of a node that a task takes by itself, at least; the links of larger hubs are dealt out.
HUB = 100_000


def _to_least(links: DataFrame, node: str, other: str, total: int) -> DataFrame:
    """links, each with m, the smallest neighbour of its node. total: at least the number of links.

    A node with over 1 / c.HEAVY of all links, and over HUB of them, has its links dealt out, and m copied to them."""
    least = links.groupBy(node).agg(F.min(other).alias("m"), F.count("*").alias("n"))
    most = max(total // c.HEAVY, HUB)
    if total <= most:
        return links.join(least.drop("n"), node)
    hubs = least.where(F.col("n") > most).select(node, F.lit(True).alias("hub"))  # fewer than c.HEAVY
    salt = F.when(F.col("hub"), F.pmod(F.xxhash64(other), F.lit(c.SALTS)).cast("int")).otherwise(F.lit(0))
    copies = F.when(F.col("n") > most, F.sequence(F.lit(0), F.lit(c.SALTS - 1))).otherwise(F.array(F.lit(0)))
    dealt = links.join(F.broadcast(hubs), node, "left").withColumn("salt", salt).drop("hub")
    return dealt.join(least.withColumn("salt", F.explode(copies)).drop("n"), [node, "salt"]).drop("salt")


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Each node hands its larger neighbours to its smallest one."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _to_least(both, "a", "b", 2 * total).where("b > a").select(F.least("a", "m").alias("a"), "b")


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Each node hands its smaller neighbours, and itself, to the smallest one. Edges have a < b."""
    met = _to_least(edges, "b", "a", total)
    return met.select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a < b").distinct()


def components(links: DataFrame) -> DataFrame:
    """links: a, b. Returns node, component (the smallest node that it reaches), for nodes with a link.

    Links are contracted in their tasks, then star by star until a turn changes nothing, which takes about as
    many turns as the logarithm of the longest road. A turn counts its edges as it writes them."""
    seen = Observation()
    table = edges = c.cut(links.where("a <> b").select("a", "b").mapInArrow(c.tidy(_contract), "a long, b long").observe(seen, F.count("*").alias("n")), "star")
    last = (seen.get.get("n", 0), None)
    while last[0]:
        seen = Observation()
        out = _small_star(_large_star(edges, last[0]), last[0]).observe(seen, F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40))).alias("h"))
        edges, old = c.cut(out, "star"), table
        c.drop_table(old)
        table, now = edges, (seen.get.get("n", 0), seen.get.get("h"))
        if now == last:
            break
        last = now
    roots = edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(roots)
