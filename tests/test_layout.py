"""Layouts by place: the curve, boxes that prune, polygons by cover."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille import sinks
from quadrille.functions import coords as C
from quadrille.operators import cells as K
from quadrille.operators import pyramid as B


def rows_read(df):
    """Rows that the scans of a plan without exchanges have put out."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def key_of(x, y):
    return sum(((x >> b & 1) << 2 * b + 1) | ((y >> b & 1) << 2 * b) for b in range(16))


def test_curve(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(1 << 16), rng.randrange(1 << 16)) for _ in range(200)] + [(0, 0), (65535, 65535), (0, 65535)]
    got = [r[0] for r in spark.createDataFrame(pairs, "bin_x int, bin_y int").select(C.z_key()).collect()]
    assert got == [key_of(x, y) for x, y in pairs]


@pytest.mark.parametrize("most", [8, 64, 10_000])
def test_ranges_hold_all_bins_of_a_box(most):
    rng = random.Random(most)
    for _ in range(60):
        zoom, side = rng.randrange(0, 7), 256.0
        x0, y0 = rng.uniform(-40, 260), rng.uniform(-40, 260)
        box = (x0, y0, x0 + rng.choice([0, 3, 60, 400]), y0 + rng.choice([0, 5, 90, 400]))
        ranges = C.z_ranges(box, zoom, side, most)
        held, n, size = set(), 2**zoom, side / 2**zoom
        for lo, hi in ranges:
            held |= set(range(lo, hi + 1))
        low = lambda i: -math.inf if i == 0 else i * size
        high = lambda i, n=n: math.inf if i == n - 1 else (i + 1) * size
        need = {key_of(i, j) for i in range(n) for j in range(n) if low(i) <= box[2] and box[0] < high(i) and low(j) <= box[3] and box[1] < high(j)}
        assert need <= held and len(ranges) <= most + 4
        if most == 10_000:
            assert held == need
    assert C.z_ranges((0, 0, 256, 256), 5) == [(0, 1023)] and C.z_ranges((9, 9, 3, 3), 5) == []


@pytest.fixture(scope="module")
def placed(spark, tmp_path_factory):
    """400,000 points, laid out by place."""
    path = str(tmp_path_factory.mktemp("places") / "p")
    points = spark.range(400_000).select(F.lit("u").alias("coord_key"), F.col("id").alias("cell_id"), (F.rand(1) * 255.99).alias("nx"), (F.rand(2) * 255.99).alias("ny"))
    points.write.parquet(path + "0")
    points = spark.read.parquet(path + "0")
    sinks.write_places(C.assign_bins(points, 7), 7, path)
    return points, path


def test_small_boxes_read_few_rows(spark, placed):
    points, path = placed
    for box in ((100.0, 40.0, 125.6, 65.6), (0.0, 0.0, 25.6, 25.6), (200.3, 220.7, 225.9, 246.3)):  # 1 % of the map
        near = K.in_box(spark.read.parquet(path), box, "x_normalized", "y_normalized", 7).select("cell_id", "x_normalized", "y_normalized")
        read = rows_read(near)
        assert read < 0.05 * 400_000
        assert sorted(r[0] for r in near.collect()) == sorted(r[0] for r in K.in_box(points, box).select("cell_id").collect())


def test_boxes_of_any_size(spark, placed):
    points = placed[0].limit(3000).unionByName(spark.createDataFrame([("u", -1, -5.0, 300.0), ("u", -2, 256.0, -0.5)], "coord_key string, cell_id long, nx double, ny double"))
    boxes = [(0, 10.0, 10.0, 60.5, 31.0), (1, -1e6, -1e6, 1e6, 1e6), (2, 8.0, 8.0, 16.0, 16.0), (3, 250.0, -1.0, 300.0, 2.0), (4, 5.0, 5.0, 4.0, 4.0), (5, -10.0, 290.0, -1.0, 301.0)]
    got = {(r[0], r[1]) for r in K.join_boxes(points, spark.createDataFrame(boxes, "box_id int, x0 double, y0 double, x1 double, y1 double")).select("box_id", "cell_id").collect()}
    at = [(r["cell_id"], r["nx"], r["ny"]) for r in points.collect()]
    assert got == {(b, i) for b, x0, y0, x1, y1 in boxes for i, x, y in at if x0 <= x <= x1 and y0 <= y <= y1}


def inside(xs, ys, shape):
    """Even-odd rule, all points at once."""
    odd = np.zeros(len(xs), bool)
    for (x1, y1), (x2, y2) in zip([shape[-1], *shape[:-1]], shape, strict=True):
        if y1 != y2:
            odd ^= ((y1 > ys) != (y2 > ys)) & (xs < (x2 - x1) * (ys - y1) / (y2 - y1) + x1)
    return odd


def test_polygons_of_many_vertices(spark, placed):
    rng = np.random.default_rng(5)
    turn = np.sort(rng.uniform(0, 2 * math.pi, 2001))
    far = rng.uniform(20, 140, 2001)  # a star, in part beyond the map
    star = [(130 + float(r * math.cos(a)), 120 + float(r * math.sin(a))) for r, a in zip(far, turn, strict=True)]
    bow = [(16.0, 16.0), (200.0, 200.0), (200.0, 16.0), (16.0, 200.0)]  # crosses itself, corners on the grid
    box = [(8.0, 8.0), (8.0, 64.0), (72.0, 64.0), (72.0, 8.0)]
    shapes = {1: star, 2: bow, 3: box, 4: [(1.0, 1.0), (2.0, 2.0)], 5: [(-50.0, -50.0), (400.0, -50.0), (400.0, 400.0), (-50.0, 400.0)]}
    regions = spark.createDataFrame([(k, [{"x": x, "y": y} for x, y in v]) for k, v in shapes.items()], "region_id int, vertices array<struct<x:double,y:double>>")
    edge_points = spark.createDataFrame([("u", -1 - k, float(x), float(y)) for k, (x, y) in enumerate([(8, 8), (8, 64), (72, 8), (16, 16), (108, 108), (40, 8), (0, 0), (300, 300), (-3, 7)])], "coord_key string, cell_id long, nx double, ny double")
    points = placed[0].where("cell_id < 100000").unionByName(edge_points)
    joined = K.join_polygons(points, regions)
    got = {}
    for r in joined.select("region_id", "cell_id").collect():
        got.setdefault(r[0], set()).add(r[1])
    at = points.toPandas()
    for k in (1, 2, 3, 5):
        assert got[k] == set(at["cell_id"][inside(at["nx"].to_numpy(), at["ny"].to_numpy(), shapes[k])].tolist())
    assert 4 not in got
    cover = K.cover_polygons(regions)
    assert "vertices" not in cover.columns and cover.where("region_id = 1").agg(F.max(F.size("edges"))).first()[0] < 200
    assert cover.groupBy("region_id").count().agg(F.max("count")).first()[0] <= 4**6
    assert cover.where("region_id = 5 and size(edges) > 0").count() <= 4 * 64


def test_equal_points_come_back(spark):
    df = spark.createDataFrame([("a", i, 3.0, -7.0) for i in range(3)] + [("b", 9, 1.0, 1.0), ("b", 10, 2.0, 4.0)], "coord_key string, cell_id long, x double, y double")
    p = C.transform_params(df)
    back = C.denormalize(C.normalize(df, p).drop("x", "y"), p)
    assert {(r["cell_id"], round(r["x"], 9), round(r["y"], 9)) for r in back.collect()} == {(r["cell_id"], r["x"], r["y"]) for r in df.collect()}


def test_zoom_is_checked():
    assert C.bin_size(3) == 32 and C.check_zoom(2, 3) == 2
    for zoom, levels in ((-1, None), (3, 3), (7, 3)):
        with pytest.raises(ValueError):
            C.check_zoom(zoom, levels)


def test_genes_are_read_without_the_matrix(spark, tmp_path):
    expr = spark.range(300_000).select((F.col("id") % 3001).alias("cell_id"), F.concat(F.lit("g"), F.col("id") % 200).alias("gene"), (F.col("id") % 17 + 1).cast("double").alias("value")).dropDuplicates(["cell_id", "gene"])
    expr.write.parquet(f"{tmp_path}/expr")
    expr = spark.read.parquet(f"{tmp_path}/expr")
    sinks.write_gene_blocks(expr, f"{tmp_path}/blocks", cells=256)
    blocks = spark.read.parquet(f"{tmp_path}/blocks")
    n = blocks.count()
    assert n >= 200 * 3001 // 256 and blocks.agg(F.max(F.size("cell_ids"))).first()[0] <= 256
    for gene in ("g0", "g77", "g199"):
        got = K.gene_values(blocks, gene)
        assert rows_read(got) < 0.05 * n
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expr.where(F.col("gene") == gene).select("cell_id", "gene", "value").collect()))
    part = K.gene_values(blocks, "g77", (300, 700), 256)
    assert rows_read(part) <= 20 and sorted(r[0] for r in part.collect()) == sorted(r[0] for r in expr.where("gene = 'g77' and cell_id between 300 and 700").select("cell_id").collect())
    assert K.gene_values(blocks, "none").count() == 0


def shuffled_rows(df):
    """Rows that all exchanges of an executed plan have written."""
    df.collect()
    todo, seen, total = [df._jdf.queryExecution().executedPlan()], set(), 0
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
        elif name.startswith(("ShuffleQueryStage", "TableCacheQueryStage")):
            todo.append(node.plan())
        elif not name.startswith("ReusedExchange"):
            if name == "Exchange" and node.hashCode() not in seen:
                seen.add(node.hashCode())
                total += node.metrics().apply("shuffleRecordsWritten").value()
            kids = node.children()
            todo += [kids.apply(i) for i in range(kids.size())]
    return total


@pytest.mark.parametrize("finest", [0, 1, 2, 7])
def test_pyramid_moves_rows_once(spark, tmp_path, finest):
    n = 2**finest
    rows = spark.range(60_000).select(F.lit("u").alias("coord_key"), F.floor(F.rand(3) * n).cast("int").alias("bin_x"), F.floor(F.rand(4) * n).cast("int").alias("bin_y"), (F.col("id") % 3).alias("gene"))
    fine = rows.groupBy("coord_key", "bin_x", "bin_y", "gene").agg(F.count("*").alias("sum"), F.max("bin_x").alias("max"))
    fine.write.parquet(f"{tmp_path}/fine")
    fine = spark.read.parquet(f"{tmp_path}/fine")
    got = B.coarsen(fine, finest, ["gene"], {"sum": F.sum, "max": F.max})
    if finest == 7:
        assert shuffled_rows(got) <= 1.4 * fine.count()
    at = fine.toPandas()
    want = set()
    for z in range(finest + 1):
        at["x"], at["y"] = at["bin_x"] // 2 ** (finest - z), at["bin_y"] // 2 ** (finest - z)
        for (x, y, g), rows in at.groupby(["x", "y", "gene"]):
            want.add(("u", z, int(x), int(y), int(g), int(rows["sum"].sum()), int(rows["max"].max())))
    assert {tuple(r) for r in got.collect()} == want
