"""The written store: resumed commits, added cells, retention, the catalog of what is written, and its values."""

import os
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille import sinks
from quadrille.operators import profile
from quadrille.plans.preprocess import Config, Store, add_cells, preprocess
from quadrille.sources import catalog


def make(spark, ids, folder):
    """An atlas on a 16 x 16 grid of points; the four corners are cells 0 to 3, so the bounds do not depend on the rest."""
    rng = np.random.default_rng(9)
    at = rng.uniform(0, 15, (400, 2))
    at[:4] = [(0, 0), (0, 15), (15, 0), (15, 15)]
    value = rng.poisson(0.6, (400, 6))
    kinds = ["A", "B", None, "C"]
    score = rng.normal(size=400).round(3)
    data = {
        "cells": ([(i, kinds[i % 4] if i < 300 else "D", None if i % 9 == 0 else float(score[i])) for i in ids], "cell_id long, kind string, score double"),
        "expr": ([(i, f"g{j}", float(value[i, j])) for i in ids for j in range(6) if value[i, j]], "cell_id long, gene string, value double"),
        "coords": ([(k, i, float(x) * s, float(y) * s) for k, s in (("X_umap", 1), ("X_pca", 3)) for i, (x, y) in enumerate(at.tolist()) if i in ids], "coord_key string, cell_id long, x double, y double"),
        "genes": ([(f"g{j}",) for j in range(6)], "gene string"),
    }
    for name, (rows, kinds) in data.items():
        spark.createDataFrame(rows, kinds).write.parquet(f"{folder}/{name}")
    return {name: spark.read.parquet(f"{folder}/{name}") for name in data}


CONFIG = {"levels": 4, "use_all_expressed": True, "numeric": ["score"], "cell_lists": True, "default_key": "X_umap", "dataset_id": "one"}


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("store")
    atlas = make(spark, range(300), f"{top}/in")
    preprocess(spark, atlas, f"{top}/out", Config(**CONFIG))
    return atlas, f"{top}/out"


def files(path):
    return {f"{d}/{x}": os.stat(f"{d}/{x}").st_mtime_ns for d, _, names in os.walk(path) for x in names if x.endswith(".parquet")}


def test_values_of_written_tables(spark, store):
    atlas, path = store
    cells = {r["cell_id"]: r for r in atlas["cells"].collect()}
    lists = spark.read.parquet(f"{path}/bin_cells").where("coord_key = 'X_umap'").collect()
    own = {(r["bin_x"], r["bin_y"]): r["cell_ids"] for r in lists}
    assert sorted(i for ids in own.values() for i in ids) == list(range(300)) and all(ids == sorted(ids) for ids in own.values())
    at = {(r["bin_x"], r["bin_y"], r["category"]): r["n"] for r in spark.read.parquet(f"{path}/bin_cat/kind").where("coord_key = 'X_umap' and zoom = 3").collect()}
    num = {(r["bin_x"], r["bin_y"]): (r["n"], r["mean"]) for r in spark.read.parquet(f"{path}/bin_num/score").where("coord_key = 'X_umap' and zoom = 3").collect()}
    for b, ids in own.items():
        kinds = [cells[i]["kind"] or "nan" for i in ids]
        assert {k: at[*b, k] for k in set(kinds)} == {k: kinds.count(k) for k in set(kinds)}
        scores = [cells[i]["score"] for i in ids if cells[i]["score"] is not None]
        assert num[b][0] == len(scores) and (num[b][1] is None if not scores else num[b][1] == pytest.approx(np.mean(scores)))
    assert {(r["cell_id"], r["gene"], r["value"]) for r in spark.read.parquet(f"{path}/expr").collect()} == {tuple(r) for r in atlas["expr"].select("cell_id", "gene", "value").collect()}
    blocks = spark.read.parquet(f"{path}/expr_by_gene").collect()
    assert {(i, r["gene"], v) for r in blocks for i, v in zip(r["cell_ids"], r["values"], strict=True)} == {tuple(r) for r in atlas["expr"].select("cell_id", "gene", "value").collect()}


def test_columns_that_are_chosen(spark):
    df = spark.createDataFrame([(1, "a", True, 2.5, "x", 7)], "cell_id long, kind string, flag boolean, score double, `my.name` string, n int")
    assert profile.choose_columns(df) == (["kind", "flag", "my.name"], [])
    assert profile.choose_columns(df, ["n", "none", "score"], ["my_name", "score"]) == (["kind", "flag"], ["n"])
    many = spark.range(30).select("id", F.col("id").alias("cell_id"), F.col("id").cast("string").alias("many"), F.lit("a").alias("few"))
    assert profile.guard(many.select("cell_id", "many", "few"), None, 20) == ["few"]
    with pytest.raises(ValueError, match="many"):
        profile.guard(many, ["many"], 20)


def test_catalog_reads_what_is_written(spark, store):
    _, path = store
    sets, genes = catalog.read_datasets(spark, [path]), catalog.read_genes(spark, [path])
    row = sets.first()
    assert (row["dataset_id"], row["position"], row["default_coord"], row["coord_keys"], row["levels"], row["categories"]) == ("one", 0, "X_umap", ["X_pca", "X_umap"], 4, ["kind"])
    found = lambda asked: catalog.resolve_coord(sets, asked).first()["coord_key"]
    assert (found("X_pca"), found("other"), found(None)) == ("X_pca", "X_umap", "X_umap")
    assert [r["dataset_id"] for r in catalog.datasets_with(sets, genes, "g3").collect()] == ["one"] and catalog.datasets_with(sets, genes, "g99").count() == 0
    assert catalog.default_dataset(sets).first()["dataset_id"] == "one" and '"default_coord":"X_umap"' in catalog.metadata_json(sets).first()["metadata"]
    box = spark.read.parquet(f"{path}/cells").where("z_key is not null")
    assert box.count() == 300


def test_a_killed_write_is_done_again(spark, store, tmp_path):
    atlas, path = store
    copy = f"{tmp_path}/out"
    shutil.copytree(path, copy)
    whole = {n: {tuple(r) for r in spark.read.parquet(f"{copy}/{n}").collect()} for n in ("bins", "bin_cat/kind")}
    before = files(copy)
    # bins lost a file before its manifest was written, bin_cat a manifest.
    os.remove(sorted(f for f in before if "/bins/" in f)[0])
    shutil.rmtree(f"{copy}/manifests/bins")
    shutil.rmtree(f"{copy}/manifests/bin_cat/kind")
    preprocess(spark, atlas, copy, Config(**CONFIG, reuse=True))
    for n, rows in whole.items():
        assert {tuple(r) for r in spark.read.parquet(f"{copy}/{n}").collect()} == rows
    after, new = files(copy), ("/bins/", "/bin_cat/", "/manifests/")
    kept = {f: t for f, t in before.items() if not any(x in f for x in new)}
    assert kept and all(after.get(f) == t for f, t in kept.items())
    # Another input is not taken for the stored one.
    other = atlas | {"expr": atlas["expr"].where("gene <> 'g5'")}
    preprocess(spark, other, copy, Config(**CONFIG, reuse=True))
    assert spark.read.parquet(f"{copy}/bin_expr").where("gene = 'g5'").count() == 0
    assert Store(spark, copy, "", True).stored("none") is None


def test_added_cells(spark, store, tmp_path):
    _, path = store
    every, more = make(spark, range(400), f"{tmp_path}/all"), make(spark, range(300, 400), f"{tmp_path}/more")
    preprocess(spark, every, f"{tmp_path}/want", Config(**CONFIG))
    add_cells(spark, path, more, f"{tmp_path}/got")
    for name in ("bins", "bin_expr", "bin_cat/kind", "categories/kind", "bin_num/score", "expr", "places", "cells", "expr_by_gene"):
        rows = []
        for side in ("got", "want"):
            df = spark.read.parquet(f"{tmp_path}/{side}/{name}")
            names = sorted(df.columns)
            rows.append(sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*names).collect()), key=repr))
        assert rows[0] == rows[1], name


def test_old_days_go_as_folders(spark, tmp_path):
    path = f"{tmp_path}/r"
    for day, hour, comparison in (("2024-01-01", "08", "a"), ("2024-01-03", "06", "b"), ("2024-01-03", "18", "c"), ("2024-01-03", "06", "d"), ("2024-01-03", "18", "d"), ("2024-01-05", "01", "a"), ("2024-01-09", "01", "e")):
        sinks.append_results(spark.createDataFrame([(comparison, "g", 0.5)], "comparison_id string, gene string, p double"), path, f"{day} {hour}:00:00")
    before = files(path)
    assert sinks.expire_results(spark, path, "2024-01-10 12:00:00", 7) == ["2024-01-01"]
    after = files(path)
    later = {f: t for f, t in before.items() if "finished_day=2024-01-05" in f or "finished_day=2024-01-09" in f or "comparison_id=c" in f}
    assert later and all(after.get(f) == t for f, t in later.items())
    got = sorted((r["comparison_id"], str(r["finished_at"])[:13]) for r in spark.read.parquet(path).collect())
    assert got == [("a", "2024-01-05 01"), ("c", "2024-01-03 18"), ("d", "2024-01-03 18"), ("e", "2024-01-09 01")]
    assert sinks.expire_results(spark, path, "2024-01-10 12:00:00", 7) == [] and files(path) == after
