"""Questions about genes, bins and categories at one zoom of the pyramid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.functions import colors
from quadrille.functions.coords import bin_bounds
from quadrille.operators.pyramid import BIN
from quadrille.operators.quantiles import nearest_rank, order_statistics


def bins_at(counts: DataFrame, zoom: int, coord_key: str | None = None) -> DataFrame:
    out = counts.where(F.col("zoom") == zoom)
    return out if coord_key is None else out.where(F.col("coord_key") == coord_key)


def gene_vector(counts: DataFrame, bin_expr: DataFrame, gene: str, zoom: int, how: str = "mean") -> DataFrame:
    """expression of a gene in every bin of a zoom, 0 where it has none; an unknown `how` is the mean."""
    how = how if how in ("mean", "max") else "mean"
    values = bin_expr.where((F.col("zoom") == zoom) & (F.col("gene") == gene)).select(*BIN, F.col(how).alias("v"))
    return bins_at(counts, zoom).join(values, BIN, "left").select(*BIN, "cell_count", F.coalesce("v", F.lit(0.0)).alias("expression"))


def gene_stats(counts: DataFrame, bin_expr: DataFrame, zoom: int, how: str = "mean") -> DataFrame:
    """For each gene: expressing_bins, total_bins, total_cells, mean over expressing bins, max, p80, range and auto_max."""
    totals = bins_at(counts, zoom).groupBy("coord_key").agg(F.count("*").alias("total_bins"), F.sum("cell_count").alias("total_cells"))
    keys, value = ["coord_key", "gene"], F.col(how)
    rows = bin_expr.where(F.col("zoom") == zoom)
    stats = rows.groupBy(*keys).agg(
        F.count_if(value > 0).alias("expressing_bins"), F.avg(F.when(value > 0, value)).alias("mean"), F.max(how).alias("top"), F.min(how).alias("low"), F.count("*").alias("stored")
    )
    ranks = stats.where("expressing_bins > 0").select(*keys, F.lit("p80").alias("name"), nearest_rank(F.col("expressing_bins"), 80).alias("rank"))
    p80 = order_statistics(rows.where(value > 0), keys, how, ranks).select(*keys, F.col("value").alias("p80"))
    out = stats.join(p80, keys, "left").join(F.broadcast(totals), "coord_key")  # a row a coordinate system
    absent = F.col("stored") < F.col("total_bins")
    top = F.when(absent, F.greatest("top", F.lit(0.0))).otherwise(F.col("top"))
    return out.select(
        "coord_key", "gene", "expressing_bins", "total_bins", "total_cells", F.coalesce("mean", F.lit(0.0)).alias("mean"), top.alias("max"),
        F.when(absent, F.least("low", F.lit(0.0))).otherwise(F.col("low")).alias("min"), F.coalesce("p80", F.lit(0.0)).alias("p80"), F.coalesce("p80", top).alias("auto_max"),
    )


def expressing_bins(vector: DataFrame, dominant: DataFrame | None = None, threshold: float = 0.0, offset: int = 0, limit: int = 100) -> DataFrame:
    """A page of the bins with expression >= threshold, in bin order, each with total_count."""
    limit = 100 if limit <= 0 else min(limit, 1000)
    rows = vector.where(F.col("expression") >= threshold)
    total = rows.agg(F.count("*").alias("total_count"))
    page = rows.orderBy("coord_key", "bin_x", "bin_y").offset(offset).limit(limit)
    if dominant is not None:
        page = page.join(dominant, BIN, "left")
    return page.crossJoin(F.broadcast(total))  # one row


def legend(counts: DataFrame, dominant: DataFrame, categories: DataFrame, zoom: int) -> DataFrame:
    """Cells of the bins that each category dominates; categories without any stay, with 0."""
    sums = dominant.where(F.col("zoom") == zoom).join(counts, BIN).groupBy("category_index").agg(F.sum("cell_count").alias("c"), F.count("*").alias("b"))
    out = categories.join(sums, "category_index", "left")
    return out.select("category", "category_index", F.coalesce("c", F.lit(0)).alias("cell_count"), F.coalesce("b", F.lit(0)).alias("bin_count"), colors.category(F.col("category_index")).alias("color"))


def centroids(counts: DataFrame, dominant: DataFrame, categories: DataFrame, zoom: int) -> DataFrame:
    """Middle of the bins that a category dominates, weighted by their cells; null without any."""
    b = bin_bounds(zoom)
    rows = dominant.where(F.col("zoom") == zoom).join(counts, BIN).withColumns({"mx": b["mid_x"], "my": b["mid_y"]})
    w = F.col("cell_count")
    sums = rows.groupBy("category_index").agg(F.sum(F.col("mx") * w).alias("sx"), F.sum(F.col("my") * w).alias("sy"), F.sum(w).alias("cells"), F.count("*").alias("bins"))
    out = categories.join(sums, "category_index", "left")
    return out.select("category", F.try_divide("sx", "cells").alias("x"), F.try_divide("sy", "cells").alias("y"), F.coalesce("bins", F.lit(0)).alias("bin_count"), F.coalesce("cells", F.lit(0)).alias("cell_count"))


def category_means(vector: DataFrame, dominant: DataFrame, categories: DataFrame) -> DataFrame:
    """Plain mean of a gene's bin values over the bins that each category dominates, and it as a share of the largest."""
    m = vector.join(dominant, BIN).groupBy("category_index").agg(F.avg("expression").alias("m"), F.count("*").alias("b"))
    out = categories.join(m, "category_index", "left").select("column", "category", F.coalesce("m", F.lit(0.0)).alias("mean"), F.coalesce("b", F.lit(0)).alias("bin_count"))
    top = F.greatest(F.max("mean").over(Window.partitionBy("column")), F.lit(0.0))
    return out.withColumn("relative", F.col("mean") / F.when(top > 0, top).otherwise(F.lit(1.0)) * 100)
