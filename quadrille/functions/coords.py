"""Coordinates, bins and tiles as column expressions."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Side of the map, and the room left at its far edges.
SIDE, EDGE = 256.0, 0.001
PADDING = 0.02


def finite(column: str | Column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def transform_params(coords: DataFrame, side: float = SIDE, padding: float = PADDING) -> DataFrame:
    """coords: coord_key, cell_id, x, y. One row a coord_key: padded bounds, ranges, scale, origin.

    Rows that are not finite are left out; n_dropped counts them. One aggregation over all rows."""
    ok = finite("x") & finite("y")
    p = coords.groupBy("coord_key").agg(
        *[f(F.when(ok, F.col(a))).alias(f"{n}_{a}") for a in "xy" for n, f in (("min", F.min), ("max", F.max))],
        F.count_if(~ok).alias("n_dropped"),
    )
    for a in "xy":
        pad = (F.col(f"max_{a}") - F.col(f"min_{a}")) * padding
        p = p.withColumn(f"pad_{a}", pad)
        p = p.withColumn(f"min_{a}", F.col(f"min_{a}") - F.col(f"pad_{a}")).withColumn(f"max_{a}", F.col(f"max_{a}") + F.col(f"pad_{a}")).drop(f"pad_{a}")
        p = p.withColumn(f"range_{a}", F.col(f"max_{a}") - F.col(f"min_{a}"))
    p = p.withColumn("max_range", F.greatest("range_x", "range_y"))
    p = p.withColumn("scale", F.when(F.col("max_range") > 0, (side - EDGE) / F.col("max_range")))
    for a in "xy":
        p = p.withColumn(f"origin_{a}", F.col(f"min_{a}") - (F.col("max_range") - F.col(f"range_{a}")) / 2)
    return p.withColumn("side", F.lit(side)).withColumn("padding", F.lit(padding))


def normalize(coords: DataFrame, params: DataFrame) -> DataFrame:
    """Adds nx, ny inside the map; equal points all go to its centre; points that are not finite go.

    params has a row a coordinate system, so it is small by its meaning; Spark checks its size."""
    out = coords.where(finite("x") & finite("y")).join(params.select("coord_key", "scale", "origin_x", "origin_y", "side"), "coord_key")
    most = F.col("side") - EDGE
    for a in "xy":
        v = (F.col(a) - F.col(f"origin_{a}")) * F.col("scale")
        out = out.withColumn(f"n{a}", F.when(F.col("scale").isNull(), most / 2).otherwise(F.least(F.greatest(v, F.lit(0.0)), most)))
    return out.drop("scale", "origin_x", "origin_y", "side")


def denormalize(points: DataFrame, params: DataFrame) -> DataFrame:
    """Adds x, y from nx, ny."""
    out = points.join(params.select("coord_key", "scale", "origin_x", "origin_y"), "coord_key")
    for a in "xy":
        # Equal points have no scale; they stood at the origin, half of no range away.
        out = out.withColumn(a, F.coalesce(F.col(f"n{a}") / F.col("scale"), F.lit(0.0)) + F.col(f"origin_{a}"))
    return out.drop("scale", "origin_x", "origin_y")


def check_zoom(zoom: int, levels: int | None = None) -> int:
    if zoom < 0 or (levels is not None and zoom >= levels):
        raise ValueError(f"zoom {zoom} is outside [0, {levels})")
    return zoom


def bin_size(zoom: int, side: float = SIDE) -> float:
    return side / 2 ** check_zoom(zoom)


def bin_of(column: str, zoom: int, side: float = SIDE) -> Column:
    b = F.floor(F.col(column) / F.lit(bin_size(zoom, side))).cast("int")
    return F.least(F.greatest(b, F.lit(0)), F.lit(2**zoom - 1))


def assign_bins(points: DataFrame, zoom: int, side: float = SIDE) -> DataFrame:
    """Adds bin_x, bin_y at a zoom from nx, ny."""
    return points.withColumn("bin_x", bin_of("nx", zoom, side)).withColumn("bin_y", bin_of("ny", zoom, side))


def parent(column: str | Column, levels: int | Column = 1) -> Column:
    return F.call_function("shiftright", F.col(column) if isinstance(column, str) else column, F.lit(levels) if isinstance(levels, int) else levels)


def bin_bounds(zoom: int | Column, side: float = SIDE) -> dict[str, Column]:
    """Low, high and middle of a bin on both axes."""
    z = F.lit(zoom) if isinstance(zoom, int) else zoom
    s = F.lit(side) / F.pow(F.lit(2.0), z)
    out = {}
    for a in "xy":
        b = F.col(f"bin_{a}")
        out |= {f"lo_{a}": b * s, f"hi_{a}": (b + 1) * s, f"mid_{a}": (b + 0.5) * s}
    return out


def bin_id(zoom: int) -> Column:
    return F.col("bin_x").cast("long") * F.lit(2**zoom) + F.col("bin_y")


def _spread(v: Column) -> Column:
    """The low 16 bits of v, each followed by a zero."""
    v = v.cast("long")
    for step, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        v = v.bitwiseOR(F.shiftleft(v, step)).bitwiseAND(F.lit(mask))
    return v


def z_key(x: str | Column = "bin_x", y: str | Column = "bin_y") -> Column:
    """The place of a bin on the curve that goes through each quarter of the map, and of a quarter, before it leaves it."""
    x, y = [F.col(v) if isinstance(v, str) else v for v in (x, y)]
    return F.shiftleft(_spread(x), 1).bitwiseOR(_spread(y))


def z_ranges(box: tuple[float, float, float, float], zoom: int, side: float = SIDE, most: int = 64) -> list[tuple[int, int]]:
    """Ranges of z keys of a zoom (both ends belong to them) that hold all bins of a box, by descent; at most about `most`.

    Where more were needed, the last quarters that the box only touches count as a whole."""
    x0, y0, x1, y1 = box
    whole, touched = [], [(0, 0, 0)]
    for level in range(zoom + 1):
        size, cells = side / 2**level, touched
        touched = []
        for key, i, j in cells:
            # Points beyond the map are in the bins at its sides.
            lo_x, hi_x = (-math.inf if i == 0 else i * size), (math.inf if i == 2**level - 1 else (i + 1) * size)
            lo_y, hi_y = (-math.inf if j == 0 else j * size), (math.inf if j == 2**level - 1 else (j + 1) * size)
            if x1 < lo_x or x0 >= hi_x or y1 < lo_y or y0 >= hi_y:
                continue
            span = 4 ** (zoom - level)
            if level == zoom or (x0 <= lo_x and hi_x <= x1 and y0 <= lo_y and hi_y <= y1):
                whole.append((key * span, (key + 1) * span - 1))
            else:
                touched.append((key, i, j))
        if len(whole) + 2 * len(touched) > most:
            span = 4 ** (zoom - level)
            whole += [(key * span, (key + 1) * span - 1) for key, _, _ in touched]
            break
        touched = [(key * 4 + 2 * a + b, 2 * i + a, 2 * j + b) for key, i, j in touched for a in (0, 1) for b in (0, 1)]
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(whole):
        if out and lo == out[-1][1] + 1:
            out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out


def in_z_ranges(box: tuple[float, float, float, float], zoom: int, side: float = SIDE, key: str = "z_key", most: int = 64) -> Column:
    """Whether a row's bin can meet a box: a few ranges of a column that Parquet has statistics of."""
    out = F.lit(False)
    for lo, hi in z_ranges(box, zoom, side, most):
        out = out | F.col(key).between(lo, hi)
    return out


def source_zoom(map_zoom: int, finest: int, tile_size: int = 256) -> int:
    """The coarsest zoom with at most one pixel a bin, or the finest there is."""
    return min(finest, check_zoom(map_zoom) + int(math.log2(tile_size)))


def tile_of(map_zoom: int, finest: int, tile_size: int = 256) -> tuple[int, dict[str, Column]]:
    """(source zoom, columns tile_x, tile_y, local_x, local_y, per_tile); y is counted from the other side."""
    src = source_zoom(map_zoom, finest, tile_size)
    k = src - map_zoom
    return src, {
        "tile_x": parent("bin_x", k),
        "tile_y": F.lit(2**map_zoom - 1) - parent("bin_y", k),
        "local_x": F.col("bin_x") - F.call_function("shiftleft", parent("bin_x", k), F.lit(k)),
        "local_y": F.col("bin_y") - F.call_function("shiftleft", parent("bin_y", k), F.lit(k)),
        "per_tile": F.lit(2**k),
    }


def check_tile(map_zoom: int, x: int, y: int) -> None:
    if map_zoom < 0 or not (0 <= x < 2**map_zoom and 0 <= y < 2**map_zoom):
        raise ValueError(f"no tile {map_zoom}/{x}/{y}")


def grow_box(box: tuple[float, float, float, float], share: float = 0.3) -> tuple[float, float, float, float]:
    """(x0, y0, x1, y1) larger by a share of its size on each side."""
    x0, y0, x1, y1 = box
    dx, dy = (x1 - x0) * share, (y1 - y0) * share
    return x0 - dx, y0 - dy, x1 + dx, y1 + dy


def box_holds(outer: tuple, inner: tuple) -> bool:
    return outer[0] <= inner[0] and outer[1] <= inner[1] and outer[2] >= inner[2] and outer[3] >= inner[3]


def row_limit(zoom: int, native: int, base: int = 5000, most: int = 20_000) -> int:
    """Rows to fetch at a zoom beyond the native one: twice as many a level, up to a limit."""
    return int(min(most, base * 2.0 ** min(2, zoom - native)))


def in_polygon(vertices: list[tuple[float, float]], x: str = "x", y: str = "y") -> Column:
    """Even-odd rule, behind a bounding box that Parquet statistics can use."""
    if not 3 <= len(vertices) <= 2001:
        raise ValueError("a polygon has 3 to 2001 vertices")
    xs, ys = [float(v[0]) for v in vertices], [float(v[1]) for v in vertices]
    edge = lambda a, b: F.struct(*[F.lit(v).alias(n) for v, n in zip((*a, *b), ("x1", "y1", "x2", "y2"), strict=True)])
    points = list(zip(xs, ys, strict=True))
    edges = F.array(*[edge(a, b) for a, b in zip(points, [points[-1], *points[:-1]], strict=True) if a[1] != b[1]])
    px, py = F.col(x), F.col(y)
    crosses = lambda e: ((e["y1"] > py) != (e["y2"] > py)) & (px < (e["x2"] - e["x1"]) * (py - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"])
    n = F.aggregate(edges, F.lit(0), lambda s, e: s + crosses(e).cast("int"))
    return px.between(min(xs), max(xs)) & py.between(min(ys), max(ys)) & (F.pmod(n, F.lit(2)) == 1)


def column_name(name: str) -> str:
    return name.replace(".", "_")


def coord_names(keys: list[str]) -> dict[str, str]:
    """Names for coordinate systems that are safe in paths, distinct."""
    out, used = {}, set()
    for key in dict.fromkeys(keys):
        base = re.sub("[^A-Za-z0-9]+", "_", key).strip("_") or "coord"
        name, k = base, 2
        while name in used:
            name, k = f"{base}_{k}", k + 1
        used.add(name)
        out[key] = name
    return out
