"""Colours as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Colour stops (red, green, blue) from low to high. Fixed values.
VIRIDIS = [(68, 1, 84), (72, 35, 116), (64, 67, 135), (52, 94, 141), (41, 120, 142), (32, 144, 140), (34, 167, 132), (68, 190, 112), (121, 209, 81), (189, 222, 38), (253, 231, 37)]
PLASMA = [(13, 8, 135), (75, 3, 161), (125, 3, 168), (168, 34, 150), (203, 70, 121), (229, 107, 93), (248, 148, 65), (253, 195, 40), (240, 249, 33)]
INFERNO = [(0, 0, 4), (40, 11, 84), (101, 21, 110), (159, 42, 99), (212, 72, 66), (245, 125, 21), (250, 193, 39), (252, 255, 164)]
MAGMA = [(0, 0, 4), (28, 16, 68), (79, 18, 123), (129, 37, 129), (181, 54, 122), (229, 80, 100), (251, 135, 97), (254, 194, 135), (252, 253, 191)]
SEURAT = [(211, 211, 211), (255, 0, 0)]
MAPS = {"viridis": VIRIDIS, "plasma": PLASMA, "inferno": INFERNO, "magma": MAGMA, "seurat": SEURAT}
#: Colours of categories, by index. Fixed values.
CATEGORIES = ["#1f77b4", "#ff7f0e", "#2ca02c", "#d62728", "#9467bd", "#8c564b", "#e377c2", "#7f7f7f", "#bcbd22", "#17becf", "#aec7e8", "#ffbb78", "#98df8a", "#ff9896", "#c5b0d5", "#c49c94", "#f7b6d2", "#c7c7c7", "#dbdb8d", "#9edae5"]
UNKNOWN = "#808080"


def ramp(t: Column, name: str = "viridis") -> Column:
    """struct(r, g, b) at t, held to [0, 1]; channels are cut, not rounded."""
    stops = MAPS[name]
    held = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)) * (len(stops) - 1)
    low = F.least(F.floor(held).cast("int"), F.lit(len(stops) - 2))
    part = held - low

    def channel(k: int) -> Column:
        values = F.array(*[F.lit(float(s[k])) for s in stops])
        a, b = F.element_at(values, low + 1), F.element_at(values, low + 2)
        return F.floor(a + (b - a) * part).cast("int")

    return F.struct(channel(0).alias("r"), channel(1).alias("g"), channel(2).alias("b"))


def density(count: Column) -> Column:
    return ramp(F.least(count / 1000.0, F.lit(1.0)))


def category(index: Column) -> Column:
    """Hex colour of a category index; an unknown category is grey."""
    at = F.pmod(index, F.lit(len(CATEGORIES))) + 1
    return F.when(index.isNotNull(), F.element_at(F.array(*[F.lit(x) for x in CATEGORIES]), at)).otherwise(UNKNOWN)


def scaled(value: Column, low: Column, high: Column) -> Column:
    """Place of a value in a range; the ends are swapped if needed, and an empty range counts as 1."""
    lo, hi = F.least(low, high), F.greatest(low, high)
    return F.least(F.greatest((F.coalesce(value, F.lit(0.0)) - lo) / F.when(hi > lo, hi - lo).otherwise(F.lit(1.0)), F.lit(0.0)), F.lit(1.0))
