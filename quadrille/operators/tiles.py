"""Map tiles as tables of pixels."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions import colors
from quadrille.functions.coords import check_tile, tile_of
from quadrille.operators.query import bins_at


def tile_bins(counts: DataFrame, map_zoom: int, finest: int, tile_size: int = 256, tile: tuple[int, int] | None = None) -> DataFrame:
    """The bins of all tiles of a map zoom, or of one tile, with their place inside the tile."""
    src, cols = tile_of(map_zoom, finest, tile_size)
    out = bins_at(counts, src).withColumns(cols)
    if tile:
        check_tile(map_zoom, *tile)
        k = src - map_zoom
        x0, y0 = tile[0] << k, (2**map_zoom - 1 - tile[1]) << k
        # The range is what a scan can use; it says the same as the tile's address.
        out = out.where(F.col("bin_x").between(x0, x0 + 2**k - 1) & F.col("bin_y").between(y0, y0 + 2**k - 1))
    return out


def tile_index(tiles: DataFrame) -> DataFrame:
    """The bins of each tile as one list."""
    return tiles.groupBy("coord_key", "tile_x", "tile_y").agg(F.sort_array(F.collect_list(F.struct("bin_x", "bin_y"))).alias("bins"))


def pixels(tiles: DataFrame, tile_size: int = 256, point_size: float = 1.0) -> DataFrame:
    """Adds px, py, dot: the square that a bin takes in its tile."""
    size = round(min(max(point_size, 0.1), 5.0), 3)
    s = F.lit(float(tile_size)) / F.col("per_tile")
    dot = s * size
    return tiles.withColumns({
        "px": F.col("local_x") * s + (s - dot) / 2,
        "py": (F.col("per_tile") - 1 - F.col("local_y")) * s + (s - dot) / 2,
        "dot": dot,
        "density_color": colors.density(F.col("cell_count")),
    })


def expression_pixels(tiles: DataFrame, vector: DataFrame, low: float | None = None, high: float | None = None, auto_max: float | None = None, cmap: str = "viridis") -> DataFrame:
    """Pixels coloured by a gene; the range is 0 (or low) to high, else auto_max, else the largest value."""
    keys = ["coord_key", "zoom", "bin_x", "bin_y"]
    rows = tiles.join(vector.select(*keys, "expression"), keys)
    if high is None and auto_max is None:
        rows = rows.crossJoin(F.broadcast(vector.agg(F.max("expression").alias("high"))))  # one row
        top = F.col("high")
    else:
        top = F.lit(float(high if high is not None else auto_max))
    t = colors.scaled(F.col("expression"), F.lit(float(low or 0.0)), top)
    return rows.withColumn("t", t).withColumn("color", colors.ramp(F.col("t"), cmap))


def category_pixels(tiles: DataFrame, dominant: DataFrame, shown: list[str] | None = None) -> DataFrame:
    """Pixels coloured by the dominant category. shown: None is all, [] none, a list those; others get index -1."""
    keys = ["coord_key", "zoom", "bin_x", "bin_y"]
    rows = tiles.join(dominant, keys)
    keep = F.lit(True) if shown is None else F.col("category").isin(*shown) if shown else F.lit(False)
    rows = rows.withColumn("category_index", F.when(keep, F.col("category_index")).otherwise(-1))
    return rows.withColumn("color", F.when(F.col("category_index") >= 0, colors.category(F.col("category_index"))))


def tile_grid(spark: SparkSession, bounds_max: float, map_zoom: int, tile_size: int = 256) -> DataFrame:
    """All tile addresses of a map zoom."""
    n = max(1, math.ceil(bounds_max * 2**map_zoom / tile_size))
    axis = spark.range(n)
    return axis.select(F.col("id").cast("int").alias("tile_x"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("tile_y"))
