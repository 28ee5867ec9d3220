"""Readers of atlas tables and of the text formats that atlases come in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrille.functions.coords import finite
from quadrille.operators.index import number_parts, row_in_task
from quadrille.sinks.scratch import written

TABLES = {"cells": {"cell_id"}, "genes": {"gene"}, "expr": {"cell_id", "gene", "value"}, "coords": {"coord_key", "cell_id", "x", "y"}}
#: Usual names of the cell key in metadata files. Fixed values.
KEY_NAMES = ("barcode", "cell", "cell_id", "cells", "cellid", "cell_name", "barcodes")
#: Embedding files and the names they get. Fixed values.
EMBEDDINGS = {"pca": "X_pca", "umap": "X_umap", "tsne": "X_tsne"}
OVERLAP = 0.9


def load_atlas(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The four tables of an atlas folder, with their columns checked; stored zeros and values that are not finite are dropped."""
    out = {}
    for name, needed in TABLES.items():
        df = spark.read.parquet(f"{path}/{name}")
        if missing := needed - set(df.columns):
            raise ValueError(f"{name} lacks {', '.join(sorted(missing))}")
        out[name] = df
    out["expr"] = out["expr"].where((F.col("value") != 0) & finite("value"))
    return out


def rename_genes(genes: DataFrame, column: str) -> DataFrame:
    """Name genes by another column; the old name stays as gene_original. Repeated names get -1, -2, ...

    Missing names are an error. A suffixed name that clashes with a given one gets the next free number."""
    if genes.where(F.col(column).isNull()).limit(1).count():
        raise ValueError(f"{column} has missing values")
    named = genes.withColumn("gene_original", F.col("gene")).withColumn("gene", F.col(column).cast("string"))
    named = named.withColumn("k", F.row_number().over(Window.partitionBy("gene").orderBy("gene_original")) - 1)
    given = named.select("gene").distinct()
    # Of the numbers that a repeated name could get, those that make a given name are left out before they are dealt.
    taken = given.select(F.regexp_extract("gene", r"(?s)^(.*)-[0-9]+$", 1).alias("gene")).groupBy("gene").agg(F.count("*").alias("taken"))
    bases = named.groupBy("gene").agg(F.max("k").alias("most")).where("most > 0").join(taken, "gene", "left")
    numbers = bases.select("gene", F.explode(F.sequence(F.lit(1), (F.col("most") + F.coalesce("taken", F.lit(0))).cast("int"))).alias("number")).withColumn("free_name", F.concat_ws("-", "gene", F.col("number").cast("string")))
    free = numbers.join(given.withColumnRenamed("gene", "free_name"), "free_name", "left_anti").withColumn("k", F.row_number().over(Window.partitionBy("gene").orderBy("number")))
    named = named.join(free.select("gene", "k", "free_name"), ["gene", "k"], "left")
    return named.select(F.coalesce("free_name", "gene").alias("gene"), *[x for x in genes.columns if x != "gene"], "gene_original")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """value, block (the byte where its part of the file starts), line (grows by one inside a block)."""
    return spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("block"), row_in_task().alias("line"))


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """A line a name: position from 0, name. Lines are counted by blocks of the file, and each block behind those before it."""
    return number_parts(written(_lines(spark, path), "names"), "block", "line", [], "position").select("position", F.col("value").alias("name"))


def read_matrix_market(spark: SparkSession, prefix: str) -> DataFrame:
    """<prefix>.mtx (genes by cells, from 1; also .gz) with .rows and .cols. Returns cell_id (position), cell_name, gene, value.

    Values that are zero or not finite are dropped."""
    from pyspark.errors import AnalysisException

    try:
        lines = _lines(spark, f"{prefix}.mtx")
    except AnalysisException:
        lines = _lines(spark, f"{prefix}.mtx.gz")
    rows = lines.where(~F.col("value").startswith("%") & (F.trim("value") != "")).withColumn("p", F.split(F.trim("value"), r"\s+"))
    head = rows.orderBy("block", "line").limit(1).first()
    size = [int(x) for x in head["p"][:3]]
    genes, cells = read_names(spark, f"{prefix}.rows"), read_names(spark, f"{prefix}.cols")
    if (genes.count(), cells.count()) != (size[0], size[1]):
        raise ValueError(f"the matrix is {size[0]} x {size[1]}, but the name files differ")
    coo = rows.where((F.col("block") != head["block"]) | (F.col("line") != head["line"]))
    coo = coo.select((F.element_at("p", 1).cast("long") - 1).alias("g"), (F.element_at("p", 2).cast("long") - 1).alias("cell_id"), F.element_at("p", 3).cast("double").alias("value"))
    out = coo.where((F.col("value") != 0) & finite("value")).join(genes.select(F.col("position").alias("g"), F.col("name").alias("gene")), "g")
    return out.join(cells.select(F.col("position").alias("cell_id"), F.col("name").alias("cell_name")), "cell_id").select("cell_id", "cell_name", "gene", "value")


def match_ratios(table: DataFrame, columns: list[str], cells: DataFrame) -> dict[str, float]:
    """Share of the cells that each column names, in one job: all columns as rows, one join."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("cell_name")) for c in columns])
    named = table.select(F.inline(pairs)).where("cell_name is not null").distinct()
    every = cells.select(F.lit(None).cast("string").alias("column"), "cell_name")
    rows = named.join(cells.select("cell_name"), "cell_name").select("column", "cell_name").unionByName(every)
    found = {r["column"]: r["n"] for r in rows.groupBy("column").agg(F.count("*").alias("n")).collect()}  # a row a column
    total = found.get(None, 0)
    return {c: found.get(c, 0) / total if total else 0.0 for c in columns}


def attach_metadata(spark: SparkSession, cells: DataFrame, path: str, key: str | None = None) -> DataFrame:
    """Left join a metadata CSV: on the given column, a usual name, or the first column that names over 90 % of the cells."""
    table = spark.read.csv(path, header=True)
    usual = [c for c in table.columns if c.lower() in KEY_NAMES]
    if key is None and usual:
        key = usual[0]
    elif key is None:
        ratios = match_ratios(table, table.columns, cells)
        key = next((c for c in table.columns if ratios[c] > OVERLAP), None)
    if key is None or key not in table.columns:
        raise ValueError("no column names the cells")
    rest = [c for c in table.columns if c != key and c not in cells.columns]
    named = table.select(F.col(f"`{key}`").alias("cell_name"), *[F.col(f"`{c}`") for c in rest])
    return cells.join(named.dropDuplicates(["cell_name"]), "cell_name", "left")


def attach_embedding(spark: SparkSession, cells: DataFrame, path: str, name: str) -> DataFrame | None:
    """coord_key, cell_id, x, y from a CSV (cell, two or more numbers); None if under 90 % of the cells are in it."""
    table = spark.read.csv(path, header=True)
    key, x, y = table.columns[:3]
    if match_ratios(table, [key], cells)[key] < OVERLAP:
        return None
    found = table.select(F.col(key).alias("cell_name"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    label = EMBEDDINGS.get(name.lower(), f"X_{name}")
    return cells.join(found, "cell_name", "left").select(F.lit(label).alias("coord_key"), "cell_id", "x", "y")


def mark_variable(spark: SparkSession, genes: DataFrame, path: str) -> DataFrame:
    """highly_variable: whether a gene stands in the list."""
    names = spark.read.text(path).select(F.trim("value").alias("gene")).where("gene <> ''").distinct().withColumn("hit", F.lit(True))
    return genes.join(names, "gene", "left").withColumn("highly_variable", F.col("hit").isNotNull()).drop("hit")


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated gene, pident, length, evalue, bitscore; blank and short lines are skipped."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).where(F.trim("value") != "").select(parts.alias("p")).where(F.size("p") >= 5)
    kinds = (("gene", "string"), ("pident", "double"), ("length", "int"), ("evalue", "double"), ("bitscore", "double"))
    return rows.select(*[F.element_at("p", i + 1).try_cast(k).alias(n) for i, (n, k) in enumerate(kinds)])


def columns(cells: DataFrame) -> list[str]:
    return [c for c in cells.columns if c != "cell_id"]
