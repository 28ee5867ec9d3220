"""Small cases that can be worked out by hand, and properties of the pyramid."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.functions import coords as C
from quadrille.functions import stats
from quadrille.operators import cells as K
from quadrille.operators import de as D
from quadrille.operators import pyramid as B
from quadrille.plans.preprocess import Config, preprocess
from quadrille.sources import atlas


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(0)
    rows = [("u", i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(size=(500, 2)))]
    return spark.createDataFrame([*rows, ("u", 500, float("nan"), 1.0), ("u", 501, None, 1.0)], "coord_key string, cell_id long, x double, y double")


def test_normalize(spark):
    df = spark.createDataFrame([("a", 0, 0.0, 0.0), ("a", 1, 10.0, 5.0), ("b", 2, 3.0, 3.0)], "coord_key string, cell_id long, x double, y double")
    p = C.transform_params(df)
    r = p.where("coord_key = 'a'").first()
    assert (r["range_x"], r["range_y"]) == pytest.approx((10.4, 5.2)) and r["scale"] == pytest.approx(255.999 / 10.4) and r["origin_y"] == pytest.approx(-0.1 - 2.6)
    n = C.normalize(df, p)
    assert n.where("cell_id = 2").first()["nx"] == pytest.approx(255.999 / 2)
    back = C.denormalize(n.drop("x", "y"), p).where("cell_id = 1").first()
    assert (back["x"], back["y"]) == pytest.approx((10.0, 5.0))


def test_bins_nest(spark, points):
    n = C.normalize(points, C.transform_params(points))
    assert n.count() == 500
    both = C.assign_bins(n, 6).withColumn("up", C.parent("bin_x")).drop("bin_x", "bin_y")
    assert both.where(C.bin_of("nx", 5) != F.col("up")).count() == 0
    counts = B.bin_counts(C.assign_bins(n, 6), 6)
    assert {r["s"] for r in counts.groupBy("zoom").agg(F.sum("cell_count").alias("s")).collect()} == {500}
    edge = spark.createDataFrame([(0.0,), (128.0,), (255.999,)], "nx double")
    assert [r[0] for r in edge.select(C.bin_of("nx", 1)).collect()] == [0, 1, 1]


def test_tile_and_polygon(spark):
    assert C.source_zoom(2, 11, 256) == 10
    assert C.coord_names(["X_umap", "X umap", "!"]) == {"X_umap": "X_umap", "X umap": "X_umap_2", "!": "coord"}
    df = spark.createDataFrame([(2.0, 2.0), (5.0, 2.0)], "x double, y double")
    assert [r[0] for r in df.select(C.in_polygon([(0, 0), (4, 0), (4, 4), (0, 4)])).collect()] == [True, False]
    with pytest.raises(ValueError):
        C.check_tile(2, 4, 0)


@pytest.mark.parametrize(("given", "want"), [(None, None), ("T,B", ["T", "B"]), ('["T","B"]', ["T", "B"]), ("[]", []), ("", []), (["T", "B"], ["T", "B"]), ({"categories": ["T"]}, ["T"])])
def test_category_filter(given, want):
    assert K.parse_filter(given) == want


def test_sampling_is_stable(spark):
    df = spark.range(1000).withColumnRenamed("id", "cell_id")
    a = [r[0] for r in K.sample(df, 50, 1).collect()]
    assert a == [r[0] for r in K.sample(df.repartition(7), 50, 1).collect()] and len(set(a)) == 50
    assert a != [r[0] for r in K.sample(df, 50, 2).collect()] and K.sample(df, 0).count() == 0 and K.sample(df, 5000).count() == 1000


def test_tests(spark):
    cells = spark.createDataFrame([(i, "a" if i < 3 else "b") for i in range(6)], "cell_id long, g string")
    expr = spark.createDataFrame([(i, "x", float(i + 1)) for i in range(6)] + [(0, "z", 5.0)], "cell_id long, gene string, value double")
    genes = spark.createDataFrame([("x",), ("z",), ("none",)], "gene string")
    labels = D.label_groups(cells, "g", ["a"])
    m = D.welch(D.effect(D.moments(expr, labels, genes)))
    x = m.where("gene = 'x'").first()
    assert x["t"] == pytest.approx(-3.674235, abs=1e-6) and x["df"] == pytest.approx(4)
    r = {y["gene"]: y for y in D.rank_sum(expr, labels, m).collect()}
    assert (r["x"]["r1"], r["x"]["u"], r["z"]["ties"]) == (6, 0, 120) and r["x"]["z"] == pytest.approx(-1.745743, abs=1e-6)
    out = {y["gene"]: y for y in D.differential(cells, expr, genes, "g", ["a"]).collect()}
    assert out["none"]["p_ttest"] == 1 and out["none"]["log2fc"] == 0 and out["x"]["p_ttest"] == pytest.approx(0.0213, abs=1e-4)
    with pytest.raises(ValueError):
        D.label_groups(cells, "g", ["a"], ["a", "b"])
    tiny = expr.withColumn("value", 5 + F.col("value") * 1e-4)
    p = [{y["gene"]: y["p_ttest"] for y in D.differential(cells, tiny, genes, "g", ["a"], guard=g).collect()}["x"] for g in (0.0, 1e-15)]
    assert p[0] == pytest.approx(out["x"]["p_ttest"], rel=1e-4) and p[1] == 1


def test_tails(spark):
    t = [0.0, 2.0, 12.7062047, -1.0, 1.7, 1.75, 3.0, 30.0, None, 5.0]
    df = [5.0, 10.0, 1.0, 3.0, 200.0, 200.0, 1e6, 1e4, 2.0, None]
    rows = spark.createDataFrame(list(enumerate(t)), "i int, t double").join(spark.createDataFrame(list(enumerate(df)), "i int, df double"), "i")
    got = {r["i"]: r["p"] for r in rows.select("i", stats.t_p("t", "df").alias("p")).collect()}

    def direct(t, df, n=200_000):
        """By Simpson's rule over the angle whose tangent is t / sqrt(df)."""
        at = np.linspace(math.atan(abs(t) / math.sqrt(df)), math.pi / 2, n + 1)
        y = np.exp((df - 1) * np.log(np.maximum(np.cos(at), 1e-300)))
        area = (y[0] + y[-1] + 4 * y[1::2].sum() + 2 * y[2:-1:2].sum()) * (at[1] - at[0]) / 3
        return 2 * area * math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)

    assert got[0] == 1 and got[8] is None and got[9] is None
    for i in (1, 3, 4, 5):
        assert got[i] == pytest.approx(direct(t[i], df[i]), rel=1e-10)
    assert got[2] == pytest.approx(0.05, abs=1e-9) and got[6] == pytest.approx(0.0026998624, rel=1e-7) and got[7] == pytest.approx(2.04432704e-189, rel=1e-7)
    z = [0.0, 1e-9, 0.3, 1.0, 1.959964, 2.82842, 2.82843, 5.0, -10.0, 30.0, 39.0]
    got = [r["p"] for r in spark.createDataFrame(list(enumerate(z)), "i int, z double").orderBy("i").select(stats.normal_p("z").alias("p")).collect()]
    assert got == pytest.approx([math.erfc(abs(v) / math.sqrt(2)) for v in z], rel=1e-11, abs=1e-320)
    assert "ArrowEvalPython" not in rows.select(stats.t_p("t", "df"), stats.normal_p("t"))._jdf.queryExecution().executedPlan().toString()


def test_bh(spark):
    df = spark.createDataFrame([("c", g, p) for g, p in zip("abcde", [0.01, 0.04, 0.03, 0.20, None], strict=True)], "comparison_id string, gene string, p double")
    got = {r["gene"]: r["q"] for r in D.bh(df, "p", "q").collect()}
    assert [got[g] for g in "abcd"] == pytest.approx([0.04, 0.16 / 3, 0.16 / 3, 0.2]) and got["e"] is None


def test_sources(spark, tmp_path):
    (tmp_path / "m.mtx").write_text("%%MatrixMarket\n% note\n2 3 3\n1 1 5\n2 3 1.5\n1 2 0\n")
    (tmp_path / "m.rows").write_text("g1\ng2\n")
    (tmp_path / "m.cols").write_text("c1\nc2\nc3\n")
    got = {(r["cell_name"], r["gene"], r["value"]) for r in atlas.read_matrix_market(spark, f"file://{tmp_path}/m").collect()}
    assert got == {("c1", "g1", 5.0), ("c3", "g2", 1.5)}
    (tmp_path / "meta.csv").write_text("barcode,kind\nc1,A\nc3,B\n")
    cells = spark.createDataFrame([("c1",), ("c2",), ("c3",)], "cell_name string")
    assert {r["cell_name"]: r["kind"] for r in atlas.attach_metadata(spark, cells, f"file://{tmp_path}/meta.csv").collect()} == {"c1": "A", "c2": None, "c3": "B"}
    (tmp_path / "hits.tsv").write_text("g1\t90.5\t100\t1e-5\t200\n\nshort\t1\n")
    assert atlas.read_hits(spark, f"file://{tmp_path}/hits.tsv").count() == 1
    genes = spark.createDataFrame([("e1", "A"), ("e2", "A"), ("e3", "A-1"), ("e4", "B")], "gene string, name string")
    names = {r["gene_original"]: r["gene"] for r in atlas.rename_genes(genes, "name").collect()}
    assert len(set(names.values())) == 4 and names["e1"] == "A" and names["e3"] == "A-1"


def test_preprocess(spark, points, tmp_path):
    cells = spark.range(502).select(F.col("id").alias("cell_id"), F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("kind"), F.rand(1).alias("score"))
    expr = cells.select("cell_id", F.concat(F.lit("g"), F.col("cell_id") % 7).alias("gene"), F.lit(1.0).alias("value"))
    data = {"cells": cells, "expr": expr, "genes": expr.select("gene").distinct(), "coords": points}
    preprocess(spark, data, f"{tmp_path}/out", Config(levels=4, n_genes=5, numeric=["score"], cell_lists=True))
    be = spark.read.parquet(f"{tmp_path}/out/bin_expr")
    assert be.select("gene").distinct().count() == 5
    assert spark.read.parquet(f"{tmp_path}/out/genes").where("is_selected").count() == 5
    top = be.where("zoom = 0").agg(F.sum(F.col("mean") * F.col("cell_count"))).first()[0]
    assert math.isclose(top, be.where("zoom = 3").agg(F.sum("sum")).first()[0])
    with pytest.raises(ValueError):
        Config(levels=13)
