"""The bin pyramid: everything is grouped once at the finest zoom, and coarser zooms are sums of that."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.functions.coords import finite, parent
from quadrille.operators.index import dense_index

BIN = ["coord_key", "zoom", "bin_x", "bin_y"]


def coarsen(fine: DataFrame, finest: int, keys: list[str], sums: dict[str, Callable]) -> DataFrame:
    """fine: bins of the finest zoom with the columns that sums adds up. Returns all zooms.

    Rows move once, to the square of a middle zoom that they lie in; below it all zooms are summed where the rows are. The zooms
    above take one row a square and key, so what moves twice is small."""
    top = (finest + 1) // 2
    square, add = ["coord_key", "top_x", "top_y", *keys], [f(name).alias(name) for name, f in sums.items()]
    rows = fine.withColumns({f"top_{a}": parent(f"bin_{a}", finest - top) for a in "xy"}).repartition(*square)

    def every(df: DataFrame, low: int, high: int, names: tuple[str, str]) -> DataFrame:
        """Each row at the zooms low to high; it is given at high."""
        df = df.withColumn("zoom", F.explode(F.sequence(F.lit(low), F.lit(high))))
        return df.withColumns({f"bin_{a}": parent(name, F.lit(high) - F.col("zoom")) for a, name in zip("xy", names, strict=True)})

    below = every(rows, top, finest, ("bin_x", "bin_y")).groupBy(*square, "zoom", "bin_x", "bin_y").agg(*add)
    out = [*BIN, *keys, *sums]
    if top == 0:
        return below.select(*out)
    above = every(rows.groupBy(*square).agg(*add).withColumns({f"top_{a}": parent(f"top_{a}") for a in "xy"}), 0, top - 1, ("top_x", "top_y"))
    return below.select(*out).unionByName(above.groupBy(*BIN, *keys).agg(*add).select(*out))


def bin_counts(binned: DataFrame, finest: int) -> DataFrame:
    """binned: coord_key, cell_id, bin_x, bin_y at the finest zoom. cell_count of every bin that has cells."""
    fine = binned.groupBy("coord_key", "bin_x", "bin_y").agg(F.count("*").alias("cell_count"))
    return coarsen(fine, finest, [], {"cell_count": F.sum})


def bin_sums(expr: DataFrame, binned: DataFrame, finest: int, genes: DataFrame | None = None) -> DataFrame:
    """sum and max (not below 0) of a bin by gene, at all zooms; absent genes are 0 and have no row."""
    if genes is not None:
        expr = expr.join(genes.select("gene"), "gene", "left_semi")
    fine = expr.join(binned, "cell_id").groupBy("coord_key", "bin_x", "bin_y", "gene").agg(F.sum("value").alias("sum"), F.greatest(F.max("value"), F.lit(0.0)).alias("max"))
    return coarsen(fine, finest, ["gene"], {"sum": F.sum, "max": F.max})


def with_means(sums: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds cell_count and the mean over all cells of the bin."""
    return sums.join(counts, BIN).withColumn("mean", F.col("sum") / F.col("cell_count"))


def bin_expression(expr: DataFrame, binned: DataFrame, finest: int, counts: DataFrame, genes: DataFrame | None = None) -> DataFrame:
    """sum, max (not below 0) and mean over all cells of the bin, by gene; absent genes are 0 and have no row."""
    return with_means(bin_sums(expr, binned, finest, genes), counts)


def group_expression(expr: DataFrame, groups: DataFrame) -> DataFrame:
    """groups: group, cell_id. Mean and true maximum over the group's cells, absent values being 0."""
    n = groups.groupBy("group").agg(F.count("*").alias("n"))
    got = expr.join(groups, "cell_id").groupBy("group", "gene").agg(F.sum("value").alias("sum"), F.max("value").alias("m"), F.count("*").alias("nnz")).join(n, "group")
    return got.select("group", "gene", (F.col("sum") / F.col("n")).alias("mean"), F.when(F.col("nnz") < F.col("n"), F.greatest("m", F.lit(0.0))).otherwise(F.col("m")).alias("max"))


def bin_categories(cells: DataFrame, binned: DataFrame, finest: int, column: str) -> DataFrame:
    """column, category, n: cells of a bin by category; null is the category `nan`."""
    rows = binned.join(cells.select("cell_id", F.coalesce(F.col(column).cast("string"), F.lit("nan")).alias("category")), "cell_id")
    fine = rows.groupBy("coord_key", "bin_x", "bin_y", "category").agg(F.count("*").alias("n"))
    return coarsen(fine, finest, ["category"], {"n": F.sum}).withColumn("column", F.lit(column))


def bin_numbers(cells: DataFrame, binned: DataFrame, finest: int, column: str) -> DataFrame:
    """mean over the finite values of a bin, null if there are none."""
    value = F.col(column).cast("double")
    rows = binned.join(cells.select("cell_id", value.alias("v")), "cell_id").withColumn("v", F.when(finite("v"), F.col("v")))
    fine = rows.groupBy("coord_key", "bin_x", "bin_y").agg(F.sum("v").alias("sum"), F.count("v").alias("n"))
    out = coarsen(fine, finest, [], {"sum": F.sum, "n": F.sum})
    return out.withColumn("mean", F.try_divide("sum", "n")).withColumn("column", F.lit(column))


def bin_cells(binned: DataFrame, finest: int, zoom: int) -> DataFrame:
    """cell_ids of each bin at one zoom, in order. At coarse zooms lists grow with the data: ask for fine ones."""
    up = finest - zoom
    at = binned.select("coord_key", F.lit(zoom).alias("zoom"), parent("bin_x", up).alias("bin_x"), parent("bin_y", up).alias("bin_y"), "cell_id")
    return at.groupBy(*BIN).agg(F.sort_array(F.collect_list("cell_id")).alias("cell_ids"))


def bin_index(bins: DataFrame) -> DataFrame:
    """Adds bin_index: rank among the bins with cells of its coordinate system and zoom."""
    return dense_index(bins, ["bin_x", "bin_y"], ["coord_key", "zoom"], "bin_index").withColumn("bin_index", F.col("bin_index").cast("int"))


def category_dictionary(cells: DataFrame, column: str) -> DataFrame:
    """category, category_index: the values in order, from 0; null is `nan`."""
    values = cells.select(F.coalesce(F.col(column).cast("string"), F.lit("nan")).alias("category")).distinct()
    return dense_index(values, ["category"], name="category_index").select(F.lit(column).alias("column"), "category", F.col("category_index").cast("int").alias("category_index"))


def dominant(bin_cat: DataFrame, categories: DataFrame) -> DataFrame:
    """The category with the most cells of each bin, the first of equals."""
    rows = bin_cat.join(categories.select("category", "category_index"), "category")
    top = F.min(F.struct((-F.col("n")).alias("n"), "category_index", "category")).alias("t")
    return rows.groupBy(*BIN).agg(top).select(*BIN, F.col("t.category_index").alias("category_index"), F.col("t.category").alias("category"))
