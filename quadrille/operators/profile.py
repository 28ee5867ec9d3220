"""Profiles of an atlas: shapes, cardinalities, ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.operators.quantiles import percentiles


def gene_profile(expr: DataFrame, cells: DataFrame) -> DataFrame:
    """For each gene over the given cells: nnz, min, mean and max of all values, zeros included."""
    n = F.broadcast(cells.agg(F.count("*").alias("n")))  # one row
    got = expr.join(cells.select("cell_id"), "cell_id", "left_semi").groupBy("gene").agg(F.count("*").alias("nnz"), F.sum("value").alias("s"), F.min("value").alias("lo"), F.max("value").alias("hi")).crossJoin(n)
    absent = F.col("nnz") < F.col("n")
    zero = F.lit(0.0)
    return got.select("gene", "nnz", F.when(absent, F.least("lo", zero)).otherwise(F.col("lo")).alias("min"), (F.col("s") / F.col("n")).alias("mean"), F.when(absent, F.greatest("hi", zero)).otherwise(F.col("hi")).alias("max"))


def value_counts(cells: DataFrame, column: str, k: int | None = None) -> DataFrame:
    out = cells.groupBy(F.col(column).cast("string").alias("category")).agg(F.count("*").alias("n"))
    return out if k is None else out.orderBy(F.desc("n"), "category").limit(k)


def percentile_range(bin_expr: DataFrame, how: str = "mean", low: float = 0.0, high: float = 0.99) -> DataFrame:
    """For each gene the interpolated percentiles of its bin values over all zooms."""
    return percentiles(bin_expr, ["gene"], how, {"low": low, "high": high})


def cardinality(cells: DataFrame, columns: list[str], most: int = 2000) -> DataFrame:
    """column, n_values, allowed: distinct values of each column, all in one pass."""
    one = cells.agg(*[F.count_distinct(F.col(c).cast("string")).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_values")) for c in columns])
    return one.select(F.inline(pairs)).withColumn("allowed", F.col("n_values") <= most)


def guard(cells: DataFrame, asked: list[str] | None, most: int = 2000) -> list[str]:
    """Category columns to use. A column that was asked for and has too many values is an error; others are left out."""
    auto = [f.name for f in cells.schema if f.name != "cell_id" and not isinstance(f.dataType, T.NumericType)]
    columns = asked if asked is not None else auto
    found = {r["column"]: r["allowed"] for r in cardinality(cells, columns, most).collect()} if columns else {}
    bad = [c for c in columns if not found[c]]
    if asked and bad:
        raise ValueError(f"more than {most} values: {', '.join(bad)}")
    return [c for c in columns if found[c]]


def choose_columns(cells: DataFrame, numeric: list[str] | None = None, exclude: list[str] | None = None) -> tuple[list[str], list[str]]:
    """(category columns, numeric columns that were asked for and exist), without excluded ones, by raw or safe name."""
    out = {x for x in exclude or []}
    keep = lambda n: n not in out and n.replace(".", "_") not in out and n != "cell_id"
    text = [f.name for f in cells.schema if keep(f.name) and not isinstance(f.dataType, T.NumericType)]
    return text, [n for n in numeric or [] if n in cells.columns and keep(n)]
