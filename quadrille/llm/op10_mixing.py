"""Mixing sources to target weights by a min-cost flow over membership patterns.

Documents are summed by the set of sources that they belong to (their pattern). In the flow
network each pattern offers its words once for each repetition, each repetition dearer than the
one before, to the sources of the pattern; each source takes up to its target. The cheapest
flow of the largest size says how many words of each pattern each source gets. A seeded hash
then puts each pattern's documents in order, and a prefix of that order has the words.

Patterns that share sources form connected networks, and the flow of each is solved in a task, from a row for each
pattern and source; a source whose documents have no other source is a network of two nodes. A network has a row a pattern,
whatever the number of documents: 100,000 patterns take a task some seconds. Neither documents nor sources meet on the driver.

Defined results: a null text has size 0; size 0 takes nothing; a null source is a source of its
own and sorts last; a null doc_id takes part like any other; repeated rows each count, and stand side by
side in the order; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import deque
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm import common as c
from quadrille.llm.graph import components

#: Ranges of the hash in which a pattern's words are summed; only those that a cut falls in are ordered.
RANGES = 4096


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """Adds rank, from 0, over all rows: a range of rows a task, and the sizes of the ranges before."""
    parts = c.cut(rows.repartitionByRange(*order).withColumn("range_part", F.spark_partition_id()), "mix_ranges")
    before = Window.orderBy("range_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    base = parts.groupBy("range_part").agg(F.count("*").alias("k")).select("range_part", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("range_part").orderBy(*order)) - 1
    return parts.withColumn("inside", inside).join(base, "range_part").withColumn("rank", F.col("base") + F.col("inside")).drop("range_part", "base", "inside")


def targets(sums: DataFrame, most: int = 3) -> DataFrame:
    """sums: size, weight. Adds target and quota (whole words): all sizes shared by weight; a target stops at
    most * size, and the excess is shared again by weight among the others until none is above.

    Each turn sums a row a source with the share that a unit of weight has, which only rises."""
    weight, size = F.col("weight").cast("decimal(38,0)"), F.col("size").cast("decimal(38,0)")
    total, weights = sums.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    unit, last = Fraction(total, max(weights, 1)), None
    full = F.lit(False)
    while unit != last:
        full = F.lit(unit.numerator).cast("decimal(38,0)") * weight > F.lit(most * unit.denominator).cast("decimal(38,0)") * size
        stopped, left = sums.agg(F.coalesce(F.sum(F.when(full, F.lit(most) * F.col("size"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))).first()
        last, unit = unit, Fraction(total - stopped, left) if left else unit
    top = max(sums.agg(F.max("weight")).first()[0] or 1, 1)
    share = [float(unit * w) for w in range(top + 1)]
    pick = lambda v, kind: F.get(F.array(*[F.lit(x) for x in v]), F.col("weight").cast("int")).cast(kind)
    return sums.withColumns({"target": F.when(full, (F.lit(most) * F.col("size")).cast("double")).otherwise(pick(share, "double")), "quota": F.when(full, F.lit(most) * F.col("size")).otherwise(pick([round(x) for x in share], "long"))})


def route(patterns: list[tuple[tuple[int, ...], int]], quotas: list[int], most: int = 3) -> list[dict[int, int]]:
    """Min-cost flow. patterns: (sources, words). Returns for each pattern the words that each source gets.

    The k-th use of a pattern's words costs k, and all other arcs are free, so a cheapest augmenting path is any
    that begins with a cheapest use: the largest flow with each pattern used once, raised to two uses, and so on."""
    n_p, n_s = len(patterns), len(quotas)
    start, end = n_p + n_s, n_p + n_s + 1
    graph: list[list[int]] = [[] for _ in range(end + 1)]
    to, cap = [], []

    def arc(u: int, v: int, room: int) -> int:
        for a, b, r in ((u, v, room), (v, u, 0)):
            graph[a].append(len(to))
            to.append(b)
            cap.append(r)
        return len(to) - 2

    offers = [arc(start, i, 0) for i in range(n_p)]
    for i, (sources, words) in enumerate(patterns):
        for s in sources:
            arc(i, n_p + s, most * words)
    for s, q in enumerate(quotas):
        arc(n_p + s, end, q)
    for _ in range(most):
        for e, (_, words) in zip(offers, patterns, strict=True):
            cap[e] += words
        while True:
            level, queue = {start: 0}, deque([start])
            while queue:
                u = queue.popleft()
                for e in graph[u]:
                    if cap[e] and to[e] not in level:
                        level[to[e]] = level[u] + 1
                        queue.append(to[e])
            if end not in level:
                break
            tried, path, u = [0] * (end + 1), [], start
            while True:
                if u == end:
                    room = min(cap[e] for e in path)
                    for e in path:
                        cap[e] -= room
                        cap[e ^ 1] += room
                    path, u = [], start
                while tried[u] < len(graph[u]) and not (cap[e := graph[u][tried[u]]] and level.get(to[e]) == level[u] + 1):
                    tried[u] += 1
                if tried[u] < len(graph[u]):
                    path.append(graph[u][tried[u]])
                    u = to[path[-1]]
                elif path:
                    u = to[path.pop() ^ 1]
                    tried[u] += 1
                else:
                    break
    return [{to[e] - n_p: cap[e ^ 1] for e in graph[i] if not e & 1 and n_p <= to[e] < start and cap[e ^ 1]} for i in range(n_p)]


def _sizes(batches):
    for b in c.text_slices(batches):
        off, _ = c.split_words(b.column("text"))
        rest = [b.column(i) for i in range(b.num_columns) if b.schema.names[i] != "text"]
        names = [n for n in b.schema.names if n != "text"]
        yield pa.record_batch([*rest, pa.array(np.diff(off))], names=[*names, "size"])


def with_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, ver (a hash of the text), size: words of the whole text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return docs.select("doc_id", "source", F.xxhash64("text").alias("ver"), "text").mapInArrow(c.tidy(_sizes), "doc_id long, source string, ver long, size long")


def _solve(most: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """One connected network. A row is a pattern and one of its sources."""
        quotas = pdf.drop_duplicates("source").assign(key=lambda x: x["source"].fillna("")).sort_values("key", kind="stable")
        place = {s if isinstance(s, str) else None: i for i, s in enumerate(quotas["source"])}
        sets = [(tuple(None if x is None else str(x) for x in r.sources), int(r.words)) for r in pdf.drop_duplicates("pattern").sort_values("pattern").itertuples()]
        flow = route([(tuple(place[x] for x in names), words) for names, words in sets], [int(q) for q in quotas["quota"]], most)
        names = [None if not isinstance(s, str) else s for s in quotas["source"]]
        rows = [(list(key), names[j], n) for (key, _), f in zip(sets, flow, strict=True) for j, n in sorted(f.items())]
        return pd.DataFrame(rows, columns=["sources", "source", "got"])

    return run


def _plans(sums: DataFrame, quotas: DataFrame, most: int) -> DataFrame:
    """sums: sources, words. quotas: source, quota. sources, words, shares: for each pattern its sources and the words they get."""
    each = sums.withColumn("source", F.explode("sources"))
    each = each.join(quotas.select(F.col("source").alias("name"), "quota"), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    # Sources that some document shares with another one.
    shared = each.where(F.size("sources") > 1).select(F.col("source").alias("other")).distinct().withColumn("shared", F.lit(True))
    each = each.join(shared, F.col("source").eqNullSafe(F.col("other")), "left").drop("other").withColumn("shared", F.coalesce("shared", F.lit(False)))
    each = each.withColumn("pattern", F.xxhash64("sources", F.lit("pattern"))).withColumn("node", F.xxhash64("source", F.col("source").isNull(), F.lit("source")))
    each = c.cut(each, "mix_network")
    names = ["component", "pattern", "sources", "source", "words", "quota"]
    network = each.where("not shared").withColumn("component", F.col("pattern")).select(names)  # nothing else reaches them
    linked = each.where("shared")
    if not linked.isEmpty():
        joined = components(linked.select(F.col("pattern").alias("a"), F.col("node").alias("b")))
        network = network.union(linked.join(joined.withColumnRenamed("node", "pattern"), "pattern").select(names))
    flow = network.groupBy("component").applyInPandas(_solve(most), "sources array<string>, source string, got long")
    shares = flow.where("got > 0").groupBy("sources").agg(F.array_sort(F.collect_list(F.struct("source", "got"))).alias("shares"))  # a source of the pattern each
    return c.cut(sums.join(shares, "sources"), "mix_plans")


def mix(rows: DataFrame, quotas: DataFrame, seed: int = 0, most: int = 3) -> DataFrame:
    """rows: doc_id, ver, size, sources (array of names, sorted). quotas: source, quota. Adds taken, the words that the
    mix takes, and used_for, the source that each copy goes to.

    A document is taken whole, a number of times that differs by one at most within its pattern."""
    rows = rows.withColumn("at", F.xxhash64("doc_id", "ver", F.lit(seed), F.lit("mix"))).withColumn("range", F.pmod(F.shiftright("at", 24), F.lit(RANGES)))
    by_range = c.cut(rows.groupBy("sources", "range").agg(F.sum("size").alias("in_range")), "mix_by_range")
    plans = _plans(by_range.groupBy("sources").agg(F.sum("in_range").alias("words")).where("words > 0"), quotas, most)
    before = Window.partitionBy("sources").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # up to RANGES rows
    ranges = by_range.withColumn("base", F.coalesce(F.sum("in_range").over(before), F.lit(0))).join(plans, "sources")
    # A pattern's uses stand one behind the other, and its sources share them in turn: their ends are the cuts.
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x["got"])
    ranges = ranges.withColumn("ends", F.transform("shares", lambda x, i: F.struct(x["source"].alias("source"), total(F.slice("shares", F.lit(1), i + 1)).alias("stop"))))
    place = lambda e: F.pmod(e["stop"], F.col("words"))
    inside = F.exists("ends", lambda e: (place(e) > F.col("base")) & (place(e) < F.col("base") + F.col("in_range")))
    ranges = c.cut(ranges.select("sources", "range", "words", "base", "ends", inside.alias("cut")), "mix_cuts")

    rows = rows.join(ranges, ["sources", "range"], "left").withColumn("cut", F.coalesce("cut", F.lit(False)))
    order = Window.partitionBy("sources", "range").orderBy("at", "doc_id", "ver", "size").rowsBetween(Window.unboundedPreceding, -1)
    split = rows.where("cut").withColumn("base", F.col("base") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    # A copy goes to the source that its middle lies in; without a cut in its range, any place there says the same.
    rows = rows.where("not cut").withColumn("middle", F.col("base").cast("double")).unionByName(split.withColumn("middle", F.col("base") + F.col("size") / 2))
    copies = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.filter("ends", lambda e: k * F.col("words") + F.col("middle") < e["stop"])),
        lambda left: F.size(left) > 0,
    )
    used = F.when((F.col("size") > 0) & F.col("ends").isNotNull(), F.transform(copies, lambda left: left[0]["source"])).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("used_for", used).withColumn("taken", F.col("size") * F.size("used_for"))
    return rows.drop("at", "range", "words", "base", "ends", "cut", "middle")


def mix_by_source(docs: DataFrame, seed: int = 0, most: int = 3) -> DataFrame:
    """Mix documents of single sources with weights 1, 2, 3, repeating, in the order of the sources.

    doc_id, source, size, source_size, target, taken."""
    rows = c.cut(with_sizes(docs), "mix_sizes")
    sums = rows.groupBy("source").agg(F.sum("size").alias("size"))
    sums = ranked(sums, F.col("source").isNull(), F.col("source")).withColumn("weight", 1 + F.col("rank") % 3)
    per = c.cut(targets(c.cut(sums, "mix_sources"), most), "mix_targets")
    mixed = mix(rows.withColumn("sources", F.array("source")), per, seed, most)
    per = per.select(F.array("source").alias("sources"), F.col("size").alias("source_size"), "target")
    return mixed.join(per, "sources", "left").select("doc_id", "source", "size", "source_size", "target", "taken")
