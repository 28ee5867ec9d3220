"""Datasets, their coordinate systems, genes and categories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_datasets(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The stored datasets, in the order of their paths: a row a dataset, as the functions below take them."""
    rows = reduce(DataFrame.unionByName, [spark.read.parquet(f"{p}/datasets").withColumn("position", F.lit(i)) for i, p in enumerate(paths)])
    default = F.min(F.when(F.col("is_default"), F.col("coord_key"))).alias("default_coord")
    same = [F.first(x).alias(x) for x in ("levels", "tile_size", "n_genes", "categories", "numeric")]
    return rows.groupBy("dataset_id", "position").agg(default, F.sort_array(F.collect_set("coord_key")).alias("coord_keys"), *same)


def read_genes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """dataset_id, gene, is_selected, selected_index of all stored datasets."""
    names = ["dataset_id", "gene", "is_selected", "selected_index"]
    return reduce(DataFrame.unionByName, [spark.read.parquet(f"{p}/genes").select(*names) for p in paths])


def resolve_coord(datasets: DataFrame, asked: str | None = None) -> DataFrame:
    """datasets: dataset_id, position, default_coord, coord_keys. Adds coord_key: the asked one if there, else the default, else any."""
    has = lambda c: F.when(F.array_contains("coord_keys", c), c)
    return datasets.withColumn("coord_key", F.coalesce(has(F.lit(asked).cast("string")), has(F.col("default_coord")), F.get("coord_keys", F.lit(0))))


def default_dataset(datasets: DataFrame, asked: str | None = None) -> DataFrame:
    hit = (F.col("dataset_id") == asked) if asked else F.lit(False)
    return datasets.orderBy(hit.desc(), "position").limit(1)


def datasets_with(datasets: DataFrame, genes: DataFrame, gene: str) -> DataFrame:
    """The datasets that have a gene, in their order."""
    return datasets.join(genes.where(F.col("gene") == gene).select("dataset_id"), "dataset_id", "left_semi").orderBy("position")


def summary(cells: DataFrame, genes: DataFrame, expr: DataFrame, columns: list[str]) -> DataFrame:
    """One row: n_cells, n_genes, nnz and the category columns."""
    one = cells.agg(F.count("*").alias("n_cells")).crossJoin(genes.agg(F.count("*").alias("n_genes"))).crossJoin(expr.agg(F.count("*").alias("nnz")))  # rows of one
    return one.withColumn("columns", F.array(*[F.lit(c) for c in columns]).cast("array<string>"))


def metadata_json(datasets: DataFrame) -> DataFrame:
    return datasets.select("dataset_id", F.to_json(F.struct(*datasets.columns)).alias("metadata"))
