"""Questions about single cells: boxes, polygons, filters, lookups, samples."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.functions.coords import SIDE, in_polygon, in_z_ranges

#: Cell ids of a block of the matrix by genes.
BLOCK_CELLS = 1 << 16


def parse_filter(given) -> list[str] | None:
    """None: no filter. A list, JSON array, comma-separated string or {"categories": [...]}: those; empty: nothing."""
    if given is None:
        return None
    if isinstance(given, dict):
        return parse_filter(given.get("categories"))
    if isinstance(given, (list, tuple)):
        return [v for x in given for v in (parse_filter(x) if isinstance(x, str) and len(given) > 1 and x.startswith("[") else [str(x)])]
    text = given.strip()
    if text.startswith("["):
        return [str(x) for x in json.loads(text)]
    return [x.strip() for x in text.split(",") if x.strip()]


def keep_categories(cells: DataFrame, column: str, shown: list[str] | None) -> DataFrame:
    return cells if shown is None else cells.where(F.col(column).isin(*shown) if shown else F.lit(False))


def sample_key(seed: int, id_column: str = "cell_id") -> Column:
    """A pseudo-random order of ids that any engine with md5 can repeat."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_column).cast("string")))


def sample(rows: DataFrame, k: int, seed: int = 0, id_column: str = "cell_id") -> DataFrame:
    """The k rows with the least keys: the same for any partitioning."""
    return rows.withColumn("score", sample_key(seed, id_column)).orderBy("score", id_column).limit(max(k, 0)).drop("score")


def sample_groups(rows: DataFrame, group: str, k: int | None, seed: int = 0, id_column: str = "cell_id") -> DataFrame:
    """Up to k rows of each group; Spark keeps k a task before the shuffle. None keeps all."""
    if k is None:
        return rows
    order = Window.partitionBy(group).orderBy(sample_key(seed, id_column), id_column)
    return rows.withColumn("k", F.row_number().over(order)).where(F.col("k") <= k).drop("k")


def in_box(points: DataFrame, box: tuple[float, float, float, float], x: str = "nx", y: str = "ny", finest: int | None = None, side: float = SIDE) -> DataFrame:
    """Points in a box, its sides included. finest: points have z_key, the place of their bin at that zoom on the curve by
    which they are laid out, so that row groups beyond the box are not read."""
    x0, y0, x1, y1 = box
    rows = points if finest is None else points.where(in_z_ranges(box, finest, side))
    return rows.where(F.col(x).between(x0, x1) & F.col(y).between(y0, y1))


def in_region(points: DataFrame, vertices: list[tuple[float, float]], x: str = "nx", y: str = "ny") -> DataFrame:
    return points.where(in_polygon(vertices, x, y))


def _square(column: str, zoom: int, side: float) -> Column:
    """The grid square of a coordinate; what lies beyond the map belongs to the squares at its sides."""
    held = F.least(F.greatest(F.floor(F.col(column) / (side / 2**zoom)), F.lit(0)), F.lit(2**zoom - 1))
    return held.cast("int")


def join_boxes(points: DataFrame, boxes: DataFrame, zoom: int = 5, x: str = "nx", y: str = "ny", side: float = SIDE) -> DataFrame:
    """boxes: box_id, x0, y0, x1, y1. Pairs of points and boxes around them: an equi-join on the squares of a zoom, then the exact test.

    A box has no squares beyond the map, so at most 4^zoom copies; in squares that lie inside a box no point is tested."""
    size = side / 2**zoom
    each = lambda lo, hi: F.explode(F.sequence(_square(lo, zoom, side), _square(hi, zoom, side)))
    grid = boxes.where((F.col("x0") <= F.col("x1")) & (F.col("y0") <= F.col("y1"))).withColumn("gx", each("x0", "x1")).withColumn("gy", each("y0", "y1"))
    within = lambda g, lo, hi: (F.col(g) > 0) & (F.col(g) < 2**zoom - 1) & (F.col(lo) <= F.col(g) * size) & ((F.col(g) + 1) * size <= F.col(hi))
    grid = grid.withColumn("inside", within("gx", "x0", "x1") & within("gy", "y0", "y1"))
    keyed = points.withColumn("gx", _square(x, zoom, side)).withColumn("gy", _square(y, zoom, side))
    exact = F.col(x).between(F.col("x0"), F.col("x1")) & F.col(y).between(F.col("y0"), F.col("y1"))
    return keyed.join(grid, ["gx", "gy"]).where(F.col("inside") | exact).drop("gx", "gy", "inside")


def cover_polygons(polygons: DataFrame, zoom: int = 6, side: float = SIDE) -> DataFrame:
    """polygons: region_id, vertices (array of x, y). The squares of a zoom that a polygon meets: region_id, gx, gy, odd, edges.

    The map is cut into quarters again and again. A quarter hands on those edges that a ray to the right, from some of its points,
    may or may not cross; edges that every such ray crosses are counted in odd, and others are forgotten. A quarter without edges is inside
    (odd = 1) or gone, and is not cut further but laid out as squares at the end."""
    point = lambda p: (p["x"], p["y"])

    def edge(v: Column, i: Column) -> Column:
        (x1, y1), (x2, y2) = point(F.element_at("vertices", F.when(i == 0, -1).otherwise(i))), point(v)
        return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))

    edges = F.filter(F.transform("vertices", edge), lambda e: e["y1"] != e["y2"])
    cells = polygons.where(F.size("vertices") >= 3).select("region_id", F.lit(0).alias("level"), F.lit(0).alias("gx"), F.lit(0).alias("gy"), F.lit(0).alias("odd"), edges.alias("edges"))
    part = lambda a, b: F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"))
    quarters, same = F.array(*[part(a, b) for a in (0, 1) for b in (0, 1)]), F.array(part(0, 0))
    for level in range(1, zoom + 1):
        size, last, done = side / 2**level, 2**level - 1, F.size("edges") == 0
        rows = cells.withColumn("q", F.explode(F.when(done, same).otherwise(quarters)))
        rows = rows.withColumns({"level": F.when(done, F.col("level")).otherwise(level)} | {g: F.when(done, F.col(g)).otherwise(F.col(g) * 2 + F.col(f"q.{k}")) for g, k in (("gx", "a"), ("gy", "b"))})
        # Squares at the sides reach as far as there are points.
        low = {g: F.when(F.col(g) == 0, float("-inf")).otherwise(F.col(g) * size) for g in ("gx", "gy")}
        high = {g: F.when(F.col(g) == last, float("inf")).otherwise((F.col(g) + 1) * size) for g in ("gx", "gy")}
        rows = rows.withColumns({"lx": low["gx"], "hx": high["gx"], "ly": low["gy"], "hy": high["gy"]})
        met = F.filter("edges", lambda e: (F.least(e["y1"], e["y2"]) < F.col("hy")) & (F.greatest(e["y1"], e["y2"]) > F.col("ly")) & (F.greatest(e["x1"], e["x2"]) > F.col("lx")))
        sure = lambda e: (F.least(e["x1"], e["x2"]) >= F.col("hx")) & (F.least(e["y1"], e["y2"]) <= F.col("ly")) & (F.greatest(e["y1"], e["y2"]) >= F.col("hy"))
        rows = rows.select("region_id", "level", "gx", "gy", "odd", "hx", "ly", "hy", met.alias("met"))
        rows = rows.select("region_id", "level", "gx", "gy", ((F.col("odd") + F.size(F.filter("met", sure))) % 2).alias("odd"), F.filter("met", lambda e: ~sure(e)).alias("edges"))
        cells = rows.where((F.size("edges") > 0) | (F.col("odd") == 1))
    n = F.call_function("shiftleft", F.lit(1), F.lit(zoom) - F.col("level"))
    for g in ("gx", "gy"):
        cells = cells.withColumn(g, F.explode(F.sequence(F.col(g) * n, F.col(g) * n + n - 1)))
    return cells.drop("level")


def join_polygons(points: DataFrame, polygons: DataFrame, zoom: int = 6, x: str = "nx", y: str = "ny", side: float = SIDE) -> DataFrame:
    """polygons: region_id, vertices (array of x, y). Pairs of points and polygons around them by the even-odd rule: an equi-join with the
    squares that cover the polygons, where a square inside has no test and another one only its own edges."""
    keyed = points.withColumn("gx", _square(x, zoom, side)).withColumn("gy", _square(y, zoom, side))
    px, py = F.col(x), F.col(y)
    crosses = lambda e: ((e["y1"] > py) != (e["y2"] > py)) & (px < (e["x2"] - e["x1"]) * (py - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"])
    near = keyed.join(cover_polygons(polygons, zoom, side), ["gx", "gy"])
    odd = (F.col("odd") + F.size(F.filter("edges", crosses))) % 2 == 1
    return near.where(odd).drop("gx", "gy", "odd", "edges")


def lookup_sparse(expr: DataFrame, cells: DataFrame, gene: str) -> DataFrame:
    """Stored values of a gene for given cells."""
    return expr.where(F.col("gene") == gene).join(cells.select("cell_id").distinct(), "cell_id").select("cell_id", "value")


def lookup_dense(expr: DataFrame, ids: DataFrame, gene: str) -> DataFrame:
    """ids: position, cell_id. A value for every id, 0 if none is stored."""
    values = expr.where(F.col("gene") == gene).select("cell_id", "value")
    return ids.join(values, "cell_id", "left").select("position", "cell_id", F.coalesce("value", F.lit(0.0)).alias("value"))


def gene_values(blocks: DataFrame, gene: str, cells: tuple[int, int] | None = None, block: int = BLOCK_CELLS) -> DataFrame:
    """blocks: as sinks.write_gene_blocks() writes them. cell_id, gene, value of one gene, as lookups take them; cells: the least and
    the largest id to read. Other genes and other ranges of cells are left out by the table's statistics."""
    rows = blocks.where(F.col("gene") == gene)
    if cells is not None:
        rows = rows.where(F.col("block").between(cells[0] // block, cells[1] // block))
    rows = rows.select("gene", F.inline(F.arrays_zip("cell_ids", "values"))).select(F.col("cell_ids").alias("cell_id"), "gene", F.col("values").alias("value"))
    return rows if cells is None else rows.where(F.col("cell_id").between(*cells))


def scan_cells(expr: DataFrame, cells: DataFrame) -> DataFrame:
    return expr.join(cells.select("cell_id"), "cell_id", "left_semi")


def read_category(cells: DataFrame, column: str, chosen: DataFrame | None = None) -> DataFrame:
    rows = cells.where(F.col(column).isNotNull() & (F.col(column) != ""))
    rows = rows if chosen is None else rows.join(chosen.select("cell_id"), "cell_id", "left_semi")
    return rows.select("cell_id", F.col(column).alias("category"))


def column_values(cells: DataFrame, column: str) -> DataFrame:
    return cells.where(F.col(column) != "").select(F.col(column).cast("string").alias("value")).distinct()


def cells_in_box(points: DataFrame, box, cells: DataFrame, expr: DataFrame | None = None, gene: str | None = None, column: str | None = None, shown: list[str] | None = None, limit: int = 5000, seed: int = 0, finest: int | None = None) -> DataFrame:
    """Cells in a box with a gene and a category, a seeded sample of all that match; total_count, truncated. finest: as for in_box()."""
    limit = max(0, min(limit, 50_000))
    rows = in_box(points, box, finest=finest).select("cell_id", "nx", "ny")
    if column:
        rows = rows.join(cells.select("cell_id", F.col(column).cast("string").alias("category")), "cell_id", "left").withColumn("category", F.coalesce("category", F.lit("")))
        rows = keep_categories(rows, "category", shown)
    if gene:
        rows = rows.join(expr.where(F.col("gene") == gene).select("cell_id", F.col("value").alias("expression")), "cell_id", "left").withColumn("expression", F.coalesce("expression", F.lit(0.0)))
    total = rows.agg(F.count("*").alias("total_count"))
    return sample(rows, limit, seed).crossJoin(F.broadcast(total)).withColumn("truncated", F.col("total_count") > limit)  # one row


def region_counts(points: DataFrame, vertices, cells: DataFrame, column: str) -> DataFrame:
    """Cells inside a polygon by category, blanks as `(unknown)`."""
    rows = in_region(points, vertices).join(cells.select("cell_id", F.trim(F.col(column).cast("string")).alias("c")), "cell_id", "left")
    name = F.when(F.coalesce("c", F.lit("")) == "", F.lit("(unknown)")).otherwise(F.col("c"))
    return rows.groupBy(name.alias("category")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category")
