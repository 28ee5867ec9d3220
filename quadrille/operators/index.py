"""Places in an order, counted over all tasks: rows are numbered where they are, behind the sizes of the parts before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.sinks.scratch import scratch_path, written


def number_parts(rows: DataFrame, part: str, k: str, within: list[str], name: str) -> DataFrame:
    """rows: a written table whose parts follow each other by `part` and whose rows, inside a part, by `k`. Adds name: the place from 0
    among the rows of the same `within`. What is ordered here is a row a part."""
    keys = [*within, part]
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n_in_part"), F.min(k).alias("first_k"))
    before = F.sum("n_in_part").over(Window.partitionBy(*(within or [F.lit(0)])).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.withColumn("before", F.coalesce(before, F.lit(0))).drop("n_in_part")
    return rows.join(sizes, keys).withColumn(name, F.col("before") + F.col(k) - F.col("first_k")).drop("before", "first_k", part, k)


def dense_index(rows: DataFrame, order: list[str], within: list[str] | None = None, name: str = "index") -> DataFrame:
    """Adds the place from 0 of each row in an order, apart for each `within`. Keys must not be null.

    Without a shared folder to hold the ranges, one task numbers a group."""
    within = within or []
    keys = [*within, *order]
    if scratch_path(rows.sparkSession, "ranges") is None:
        return rows.withColumn(name, (F.row_number().over(Window.partitionBy(*(within or [F.lit(0)])).orderBy(*order)) - 1).cast("long"))
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = written(ranged.select("*", F.spark_partition_id().alias("range_no"), row_in_task().alias("row_no")), "ranges")
    return number_parts(ranged, "range_no", "row_no", within, name)


def row_in_task() -> Column:
    """A number that grows by one from row to row of a task."""
    return F.monotonically_increasing_id()
