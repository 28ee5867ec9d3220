"""Sequence hits: from databases to the datasets that use them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ORDERS = {
    "bitscore": [F.desc, ("bitscore",), F.asc, ("evalue",)],
    "evalue": [F.asc, ("evalue",)],
    "pident": [F.desc, ("pident",)],
    "length": [F.desc, ("length",)],
}


def _keys(order_by: str):
    spec = ORDERS.get(order_by, ORDERS["bitscore"])
    return [f(c) for f, cols in zip(spec[::2], spec[1::2], strict=True) for c in cols]


def top_hits(hits: DataFrame, max_hits: int, order_by: str = "bitscore") -> DataFrame:
    """The best max_hits of each database."""
    order = Window.partitionBy("db_path").orderBy(*_keys(order_by), "gene", "pident", "length", "evalue")
    return hits.withColumn("k", F.row_number().over(order)).where(F.col("k") <= max_hits).drop("k")


def expand(hits: DataFrame, databases: DataFrame, genes: DataFrame) -> DataFrame:
    """databases: db_path, dataset_id. genes: dataset_id, gene. Hits of each dataset whose gene it has."""
    return hits.join(databases, "db_path").join(genes.select("dataset_id", "gene").distinct(), ["dataset_id", "gene"], "left_semi")


def page(hits: DataFrame, order_by: str = "bitscore", offset: int = 0, limit: int = 50) -> DataFrame:
    return hits.orderBy(*_keys(order_by), "dataset_id", "gene", "pident", "length", "evalue").offset(offset).limit(limit)


def distinct_databases(databases: DataFrame) -> DataFrame:
    return databases.select("db_path").distinct()
