"""More hand-made cases: names, several coordinate systems, gene selection, ranks, catalog, colours, results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille import sinks
from quadrille.functions import colors
from quadrille.functions import coords as C
from quadrille.operators import cells as K
from quadrille.operators import de as D
from quadrille.operators import genes as G
from quadrille.operators import tiles as L
from quadrille.plans.preprocess import Config, preprocess, stored_config
from quadrille.sources import atlas, catalog


def test_renamed_genes_are_distinct(spark):
    given = ["A", "A", "A-1", "A-2", "A", "B", "A-1", "B-x", "B", "A-1-1"]
    genes = spark.createDataFrame([(f"e{i}", x, i) for i, x in enumerate(given)], "gene string, name string, n int")
    got = {r["gene_original"]: r["gene"] for r in atlas.rename_genes(genes, "name").collect()}
    assert len(set(got.values())) == len(given)
    assert [got[f"e{i}"] for i in range(len(given))] == ["A", "A-3", "A-1", "A-2", "A-4", "B", "A-1-2", "B-x", "B-1", "A-1-1"]
    with pytest.raises(ValueError):
        atlas.rename_genes(spark.createDataFrame([("a", None)], "gene string, name string"), "name")


@pytest.fixture(scope="module")
def two_systems(spark):
    rng = np.random.default_rng(1)
    points = [(k, i, float(x), float(y)) for k in ("X_umap", "X_pca") for i, (x, y) in enumerate(rng.normal(size=(40, 2)))]
    cells = spark.createDataFrame([(i, "A" if i % 3 else "B") for i in range(40)], "cell_id long, kind string")
    expr = spark.createDataFrame([(i, f"g{j}", float((i * j) % 5 + 1)) for i in range(40) for j in range(12) if (i + j) % 2], "cell_id long, gene string, value double")
    return {"cells": cells, "expr": expr, "coords": spark.createDataFrame(points, "coord_key string, cell_id long, x double, y double")}


def test_cells_have_one_row_each(spark, two_systems, tmp_path):
    marked = spark.createDataFrame([(f"g{j}", j in (3, 7), 1.0 if j == 7 else 2.0) for j in range(12)], "gene string, highly_variable boolean, highly_variable_rank double")
    config = Config(levels=3, n_genes=2, hvg_n_top=2, coord_keys=["X_umap", "X_pca"], default_key="X_pca", dataset_id="one")
    preprocess(spark, two_systems | {"genes": marked}, f"{tmp_path}/out", config)
    cells = spark.read.parquet(f"{tmp_path}/out/cells")
    assert cells.count() == 40 and cells.select("cell_id").distinct().count() == 40
    places = spark.read.parquet(f"{tmp_path}/out/places")
    assert places.count() == 80
    own = places.where("coord_key = 'X_pca'").select("cell_id", "x_normalized", "bin_z2_x")
    assert cells.select("cell_id", "x_normalized", "bin_z2_x").exceptAll(own).count() == 0
    # The marked genes are selected, by their marks and not by variance.
    genes = spark.read.parquet(f"{tmp_path}/out/genes")
    assert {r["gene"] for r in genes.where("is_selected").collect()} == {"g3", "g7"}
    about = {r["coord_key"]: r for r in spark.read.parquet(f"{tmp_path}/out/datasets").collect()}
    assert about["X_pca"]["is_default"] and not about["X_umap"]["is_default"] and about["X_pca"]["categories"] == ["kind"] and about["X_pca"]["dataset_id"] == "one"
    # A second run with other levels goes on with what is stored.
    again = stored_config(spark, f"{tmp_path}/out", Config(levels=5, tile_size=512, reuse=True))
    assert (again.levels, again.tile_size) == (3, 256)
    assert stored_config(spark, f"{tmp_path}/none", Config(levels=5, reuse=True)).levels == 5
    preprocess(spark, two_systems | {"genes": marked}, f"{tmp_path}/out", Config(levels=5, n_genes=2, reuse=True))
    assert spark.read.parquet(f"{tmp_path}/out/bins").agg(F.max("zoom")).first()[0] == 2


def test_ranked_genes(spark, two_systems):
    flags = spark.createDataFrame([("a", True, 2), ("b", True, None), ("c", False, 1), ("d", True, 1)], "gene string, highly_variable boolean, highly_variable_rank int")
    assert [r["gene"] for r in G.ranked_genes(flags, two_systems["expr"], two_systems["cells"]).orderBy(F.desc("score"), "gene").collect()] == ["d", "a", "b"]
    none = flags.withColumn("highly_variable", F.lit(False))
    assert G.ranked_genes(none, two_systems["expr"], two_systems["cells"]).count() == 12
    assert [r["gene"] for r in G.flagged_genes(flags, 2).collect()] == ["d", "a"]
    some = G.select_genes(two_systems["expr"], two_systems["cells"], 4, 1, ["g5"], hvg=spark.createDataFrame([("g9", 2.0), ("g4", 1.0)], "gene string, score double"))
    assert {"g9", "g5"} <= {r["gene"] for r in some.collect()} and some.count() == 4
    everything = G.select_genes(two_systems["expr"], two_systems["cells"], use_all_expressed=True, min_cells=1)
    assert everything.count() == 12


def test_variable_genes_against_a_direct_fit(spark):
    rng = np.random.default_rng(2)
    n, genes = 300, 400
    mean = np.exp(rng.uniform(-1.5, 3, genes))
    odd = rng.random(genes) < 0.1
    x = rng.poisson(mean[:, None] * np.where(odd[:, None], rng.gamma(0.5, 2, (genes, n)), 1.0)).astype(float)
    x = np.minimum(x, 100)
    rows = [(int(i), f"g{g}", float(x[g, i])) for g in range(genes) for i in np.flatnonzero(x[g])]
    expr = spark.createDataFrame(rows, "cell_id long, gene string, value double")
    got = {r["gene"]: r["score"] for r in G.variable_genes(expr, spark.range(n).withColumnRenamed("id", "cell_id")).collect()}
    m, v = x.mean(axis=1), x.var(axis=1, ddof=1)
    live = (m > 0) & (v > 0)
    lx, ly = np.log10(m[live]), np.log10(v[live])
    fit, k = np.empty(live.sum()), int(0.3 * live.sum() + 1e-5)
    for i, at in enumerate(lx):  # local quadratic fit at every gene
        d = np.abs(lx - at)
        h = np.sort(d)[k - 1]
        w = np.sqrt(np.clip(1 - (d / h) ** 3, 0, None) ** 3)
        fit[i] = np.polyfit(lx - at, ly, 2, w=w)[-1]
    std = 10 ** (fit / 2)
    clip = np.minimum(x[live], (std * np.sqrt(n) + m[live])[:, None])
    want = (n * m[live] ** 2 + (clip**2).sum(axis=1) - 2 * clip.sum(axis=1) * m[live]) / ((n - 1) * std**2)
    names = [f"g{g}" for g in np.flatnonzero(live)]
    mine = np.array([got[g] for g in names])
    assert np.abs(mine / want - 1).max() < 2.5e-3 and np.median(np.abs(mine / want - 1)) < 3e-4
    same = {f"g{g}" for g in range(genes) if x[g].any()} - set(names)
    assert set(got) - set(names) == same and all(got[g] == 0 for g in same)
    high = expr.withColumn("value", F.col("value") * 50)  # above 100: normalised first
    assert G.variable_genes(high, spark.range(n).withColumnRenamed("id", "cell_id")).count() > 300
    assert G.variable_genes(expr.where("false"), spark.range(3).withColumnRenamed("id", "cell_id")).count() == 0


def test_variable_genes_sample_and_fallback(spark):
    cells = spark.range(500).withColumnRenamed("id", "cell_id")
    some = {r[0] for r in G.sample_cells(cells, 120, 3).collect()}
    assert len(some) == 120 and some == {r[0] for r in G.sample_cells(cells.repartition(9), 120, 3).collect()} != {r[0] for r in G.sample_cells(cells, 120, 4).collect()}
    assert G.sample_cells(cells, 500).count() == 500
    expr = cells.crossJoin(spark.range(40).withColumnRenamed("id", "g")).select("cell_id", F.concat(F.lit("g"), "g").alias("gene"), ((F.col("cell_id") * (F.col("g") + 3)) % (F.col("g") + 2)).cast("double").alias("value")).where("value > 0")
    kept = spark.createDataFrame([(i,) for i in some], "cell_id long")
    sampled = {r["gene"]: r["score"] for r in G.variable_genes(expr, cells, max_cells=120, seed=3).collect()}
    assert sampled == pytest.approx({r["gene"]: r["score"] for r in G.variable_genes(expr.join(kept, "cell_id", "left_semi"), kept).collect()})
    # Two genes that vary carry no curve: plain variances over all cells.
    two = expr.where("gene in ('g1', 'g9')").unionByName(cells.select("cell_id", F.lit("flat").alias("gene"), F.lit(2.0).alias("value")))
    got = {r["gene"]: r["score"] for r in G.variable_genes(two, cells, max_cells=50).collect()}
    assert got == {r["gene"]: r["variance"] for r in G.gene_totals(two, cells).collect()} and got["flat"] == 0


def test_rank_sum_over_ranges(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=70).round(1), rng.normal(0.4, 1, size=50).round(1)
    cells = spark.createDataFrame([(i, "a" if i < 70 else "b") for i in range(120)], "cell_id long, g string")
    v = np.concatenate((a, b))
    v[::5] = 0
    expr = spark.createDataFrame([(i, "x", float(y)) for i, y in enumerate(v) if y] + [(0, "one", 1e300), (1, "one", -1e300)], "cell_id long, gene string, value double")
    genes, labels = spark.createDataFrame([("x",), ("none",), ("one",)], "gene string"), D.label_groups(cells, "g", ["a"])
    got = {r["gene"]: r for r in D.rank_sum(expr, labels, genes).collect()}
    rank = np.array([(v < y).sum() + ((v == y).sum() + 1) / 2 for y in v])
    assert got["x"]["r1"] == pytest.approx(rank[:70].sum()) and got["x"]["ties"] == sum(int((v == y).sum()) ** 3 - int((v == y).sum()) for y in set(v))
    both = D.rank_moments(expr, labels, genes).orderBy("gene").select("gene", "n1", "n2", F.round("sum1", 9).alias("sum1"), F.round("sum2", 9).alias("sum2"), "nnz1", "nnz2").collect()
    assert both == D.moments(expr, labels, genes).orderBy("gene").select("gene", "n1", "n2", F.round("sum1", 9).alias("sum1"), F.round("sum2", 9).alias("sum2"), "nnz1", "nnz2").collect()
    assert got["none"]["z"] is None and got["one"]["r1"] == pytest.approx(70 * 60.5)


def test_false_discovery_rates_keep_nulls(spark):
    rows = [(c, g, p) for c in "mn" for g, p in zip("abcdef", [0.01, None, 0.04, 0.03, None, 0.20], strict=True)]
    got = {(r["comparison_id"], r["gene"]): r["q"] for r in D.bh(spark.createDataFrame(rows, "comparison_id string, gene string, p double"), "p", "q").collect()}
    for c in "mn":
        assert [got[c, g] for g in "acdf"] == pytest.approx([0.04, 0.16 / 3, 0.16 / 3, 0.2]) and got[c, "b"] is None and got[c, "e"] is None


def test_result_pages_and_volcano(spark):
    rows = [("0", f"g{i}", 1.0, 0.0, 0.5 * (i % 2), 0.0, lfc, p, p, f, f) for i, (lfc, p, f) in enumerate([(2.0, 0.001, 0.01), (-1.5, 0.002, 0.02), (0.2, 0.001, 0.01), (3.0, None, None), (1.0, 0.05, 0.05)])]
    df = spark.createDataFrame(rows, "comparison_id string, gene string, mean1 double, mean2 double, pct1 double, pct2 double, log2fc double, p_ttest double, fdr_ttest double, p_ranksum double, fdr_ranksum double")
    names = lambda d: [r["gene"] for r in d.collect()]
    assert names(D.page(df)) == ["g0", "g2", "g1", "g4", "g3"]
    assert names(D.page(df, "abs_log2fc", 1, 2)) == ["g0", "g1"]
    assert names(D.page(df, "nonsense", -3, 1)) == ["g0"]
    got = {r["gene"]: r for r in D.volcano(df).collect()}
    assert [got[f"g{i}"]["class"] for i in range(5)] == ["up", "down", "ns", "ns", "up"] and got["g0"]["y"] == pytest.approx(2)
    assert set(names(D.volcano(df, drop_absent=True))) == {"g1", "g3"}


def test_results_are_kept_for_days(spark, tmp_path):
    df = spark.createDataFrame([("a", "g", 0.5)], "comparison_id string, gene string, p double")
    sinks.append_results(df, f"{tmp_path}/r", "2024-01-01 00:00:00")
    sinks.append_results(df.withColumn("comparison_id", F.lit("b")), f"{tmp_path}/r", "2024-01-09 00:00:00")
    sinks.drop_old_results(spark, f"{tmp_path}/r", f"{tmp_path}/kept", "2024-01-10 00:00:00", 7)
    assert [r["comparison_id"] for r in spark.read.parquet(f"{tmp_path}/kept").collect()] == ["b"] and spark.read.parquet(f"{tmp_path}/r").count() == 2


def test_catalog(spark, two_systems):
    sets = spark.createDataFrame([("d1", 0, "u", ["t", "u"]), ("d2", 1, "zz", ["p"]), ("d3", 2, None, [])], "dataset_id string, position int, default_coord string, coord_keys array<string>")
    got = lambda asked: {r["dataset_id"]: r["coord_key"] for r in catalog.resolve_coord(sets, asked).collect()}
    assert got("t") == {"d1": "t", "d2": "p", "d3": None} and got("none") == {"d1": "u", "d2": "p", "d3": None}
    assert catalog.default_dataset(sets, "d2").first()["dataset_id"] == "d2" and catalog.default_dataset(sets).first()["dataset_id"] == "d1" and catalog.default_dataset(sets, "nope").first()["dataset_id"] == "d1"
    one = catalog.summary(two_systems["cells"], two_systems["expr"].select("gene").distinct(), two_systems["expr"], ["kind"]).first()
    assert (one["n_cells"], one["n_genes"], one["nnz"], one["columns"]) == (40, 12, 240, ["kind"])
    assert '"position":1' in catalog.metadata_json(sets).where("dataset_id = 'd2'").first()["metadata"]


def test_sources_of_an_atlas(spark, two_systems, tmp_path):
    genes = two_systems["expr"].select("gene").distinct()
    for name, df in (two_systems | {"genes": genes}).items():
        df.withColumn("value", F.when(F.col("cell_id") == 3, 0.0).otherwise(F.col("value"))).write.parquet(f"{tmp_path}/a/{name}") if name == "expr" else df.write.parquet(f"{tmp_path}/a/{name}")
    got = atlas.load_atlas(spark, f"{tmp_path}/a")
    assert got["expr"].where("cell_id = 3").count() == 0 and got["expr"].count() == 234 and atlas.columns(got["cells"]) == ["kind"]
    genes.select(F.lit(1).alias("other")).write.parquet(f"{tmp_path}/b/cells")
    with pytest.raises(ValueError):
        atlas.load_atlas(spark, f"{tmp_path}/b")
    (tmp_path / "umap.csv").write_text("cell,u1,u2\n" + "".join(f"c{i},{i},{2 * i}\n" for i in range(19)))
    cells = spark.createDataFrame([(i, f"c{i}") for i in range(20)], "cell_id long, cell_name string")
    rows = {r["cell_id"]: r for r in atlas.attach_embedding(spark, cells, f"file://{tmp_path}/umap.csv", "UMAP").collect()}
    assert (rows[4]["coord_key"], rows[4]["x"], rows[4]["y"]) == ("X_umap", 4.0, 8.0) and rows[19]["x"] is None
    (tmp_path / "few.csv").write_text("cell,u1,u2\nc1,1,1\n")
    assert atlas.attach_embedding(spark, cells, f"file://{tmp_path}/few.csv", "other") is None
    (tmp_path / "hvg.txt").write_text("g1\n\ng3\n")
    marks = {r["gene"]: r["highly_variable"] for r in atlas.mark_variable(spark, genes, f"file://{tmp_path}/hvg.txt").collect()}
    assert sorted(g for g, x in marks.items() if x) == ["g1", "g3"]


def test_colours_and_grids(spark):
    df = spark.createDataFrame([(0.0,), (0.05,), (1.0,), (7.0,), (-1.0,)], "t double")
    rgb = [tuple(r[0]) for r in df.select(colors.ramp(F.col("t"))).collect()]
    assert rgb == [(68, 1, 84), (70, 18, 100), (253, 231, 37), (253, 231, 37), (68, 1, 84)]
    assert [tuple(r[0]) for r in spark.range(1).select(colors.ramp(F.lit(0.5), "seurat")).collect()] == [(233, 105, 105)]
    hexes = [r[0] for r in spark.createDataFrame([(0,), (21,), (None,)], "i int").select(colors.category(F.col("i"))).collect()]
    assert hexes == ["#1f77b4", "#ff7f0e", "#808080"]
    assert L.tile_grid(spark, 256.0, 2).count() == 16 and L.tile_grid(spark, 100.0, 0).count() == 1 and L.tile_grid(spark, 300.0, 1).count() == 9
    assert C.grow_box((0, 0, 10, 20)) == (-3, -6, 13, 26) and C.box_holds((0, 0, 9, 9), (0, 1, 9, 8)) and not C.box_holds((0, 0, 9, 9), (0, 1, 10, 8))
    assert [C.row_limit(z, 3) for z in (1, 3, 4, 9)] == [1250, 5000, 10000, 20000]


def test_polygons_as_a_table(spark):
    rng = np.random.default_rng(4)
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 60, (400, 2)))], "cell_id long, nx double, ny double")
    shapes = {1: [(0.0, 0.0), (40.0, 5.0), (30.0, 50.0), (15.0, 20.0)], 2: [(20.0, 20.0), (59.0, 20.0), (40.0, 59.0)], 3: [(1.0, 1.0), (2.0, 2.0)]}
    regions = spark.createDataFrame([(k, [{"x": x, "y": y} for x, y in v]) for k, v in shapes.items()], "region_id int, vertices array<struct<x:double,y:double>>")
    got = {(r["region_id"], r["cell_id"]) for r in K.join_polygons(points, regions).collect()}
    want = {(k, r["cell_id"]) for k in (1, 2) for r in K.in_region(points, shapes[k]).collect()}
    assert got == want and len(want) > 50
