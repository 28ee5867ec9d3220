"""Exact order statistics by distributed selection.

Values of a group are counted by ranges, and only the range that holds the wanted rank is looked at again, in finer ranges
between its own least and largest value, until few are left. Counts move, values do not, so a group may have any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.sinks.scratch import written

#: Ranges of a round, and the rows of a range that are ordered at last.
PARTS, FEW = 1024, 2000


def _reached(counts: DataFrame, group: list[str], order: str) -> DataFrame:
    """Of counted ranges or values, those that hold the rank; rank becomes the one inside. A group has at most PARTS or FEW rows here."""
    before = F.coalesce(F.sum("c").over(Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("before", before).where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("c")))
    return counts.withColumn("rank", F.col("rank") - F.col("before")).drop("before")


def order_statistics(rows: DataFrame, keys: list[str], value: str, targets: DataFrame, few: int = FEW, parts: int = PARTS) -> DataFrame:
    """targets: the keys, name, rank (from 0). Returns keys, name, value: the value of each rank in the order of its group.

    Values that are null or NaN do not count; a rank that the group does not have gives no row. Rows are read once a round: give a
    written table."""
    given, keys = keys, [f"key_{i}" for i in range(len(keys))]  # names that no column of this function has
    named = [F.col(x).alias(y) for x, y in zip(given, keys, strict=True)]
    v, group = F.col("v"), [*keys, "name"]
    rows = rows.select(*named, F.col(value).cast("double").alias("v")).where(v.isNotNull() & ~F.isnan(v))
    ends = rows.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("c"))
    live = written(targets.select(*named, "name", F.col("rank").cast("long").alias("rank")).join(ends, keys).where("rank >= 0 and rank < c"), "ranks")
    wide = (F.col("c") > few) & (F.col("lo") < F.col("hi"))
    while not live.where(wide).isEmpty():
        near = rows.join(live.where(wide).drop("c"), keys).where(v.between(F.col("lo"), F.col("hi")))
        part = F.least(F.floor((v - F.col("lo")) / (F.col("hi") - F.col("lo")) * parts), F.lit(parts - 1))
        counts = near.groupBy(*group, "rank", part.alias("part")).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("c"))
        live = written(live.where(~wide).unionByName(_reached(counts, group, "part").drop("part")), "ranks")
    one = F.col("lo") == F.col("hi")
    counts = rows.join(live.where(~one).drop("c"), keys).where(v.between(F.col("lo"), F.col("hi"))).groupBy(*group, "rank", "v").agg(F.count("*").alias("c"))
    out = live.where(one).select(*group, F.col("lo").alias("value")).unionByName(_reached(counts, group, "v").select(*group, v.alias("value")))
    return out.select(*[F.col(y).alias(x) for x, y in zip(given, keys, strict=True)], "name", "value")


def percentiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float], few: int = FEW) -> DataFrame:
    """keys and a column for each named share: the percentile with linear interpolation between the two values around it."""
    v = F.col(value).cast("double")
    n = rows.where(v.isNotNull() & ~F.isnan(v)).groupBy(*keys).agg(F.count("*").alias("n"))
    at = {name: F.lit(float(share)) * (F.col("n") - 1) for name, share in shares.items()}
    both = F.array(*[F.struct(F.lit(f"{name} {side}").alias("name"), f(x).cast("long").alias("rank")) for name, x in at.items() for side, f in (("low", F.floor), ("high", F.ceil))])
    found = order_statistics(rows, keys, value, n.select(*keys, F.inline(both)), few)
    pick = lambda name, side: F.max(F.when(F.col("name") == f"{name} {side}", F.col("value"))).alias(f"{name} {side}")
    out = found.groupBy(*keys).agg(*[pick(name, side) for name in shares for side in ("low", "high")]).join(n, keys)

    def between(name: str) -> Column:
        low, high, x = F.col(f"`{name} low`"), F.col(f"`{name} high`"), at[name]
        return low + (high - low) * (x - F.floor(x))

    return out.select(*keys, *[between(name).alias(name) for name in shares])


def nearest_rank(n: Column, percent: int) -> Column:
    """The rank (from 0) of the nearest-rank percentile among n values, in integers: ceil(percent * n / 100) - 1."""
    return F.floor((F.lit(percent) * n + 99) / 100) - 1
