"""Writers of the pyramid, the full store and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions.coords import parent, z_key
from quadrille.operators.cells import BLOCK_CELLS
from quadrille.sinks.scratch import scratch_path, written

#: Parts of tables that are read by place or by gene, small enough for statistics to leave most out: bytes of a row group, rows of a page.
FINE_PARTS = {"parquet.block.size": 4 << 20, "parquet.page.row.count.limit": 2000}


def write_pyramid(df: DataFrame, path: str, sort: list[str], reuse: bool = False) -> None:
    """Any pyramid table, a folder a coordinate system and zoom, in ranges of its sort keys, so that Parquet statistics
    prune; the number of ranges follows the size. reuse: keep what is there."""
    tidy = df.repartitionByRange("coord_key", "zoom", *sort).sortWithinPartitions("coord_key", "zoom", *sort)
    tidy.write.mode("ignore" if reuse else "overwrite").partitionBy("coord_key", "zoom").parquet(path)


def write_matrix(expr: DataFrame, path: str, reuse: bool = False) -> None:
    """The full matrix, in ranges of cells."""
    expr.repartitionByRange("cell_id").sortWithinPartitions("cell_id", "gene").write.mode("ignore" if reuse else "overwrite").parquet(path)


def write_gene_blocks(expr: DataFrame, path: str, reuse: bool = False, cells: int = BLOCK_CELLS) -> None:
    """The full matrix once more, by genes: a row holds a gene's values for a range of cell ids, as arrays in their order. A Bloom
    filter and the order of genes let a reader of one gene leave the rest of the table out."""
    pairs = F.sort_array(F.collect_list(F.struct("cell_id", "value")))  # a cell has one value a gene, so at most `cells`
    blocks = expr.groupBy("gene", F.floor(F.col("cell_id") / cells).alias("block")).agg(pairs.alias("pairs"))
    blocks = blocks.select("gene", "block", F.col("pairs.cell_id").alias("cell_ids"), F.col("pairs.value").alias("values"))
    blocks = blocks.repartitionByRange("gene", "block").sortWithinPartitions("gene", "block")
    fine = FINE_PARTS | {"parquet.page.row.count.limit": 20, "parquet.bloom.filter.enabled#gene": "true"}
    blocks.write.options(**fine).mode("ignore" if reuse else "overwrite").parquet(path)


def write_cells(cells: DataFrame, binned: DataFrame, finest: int, path: str, reuse: bool = False, default_key: str | None = None) -> None:
    """Cells with normalised coordinates and their bin at every zoom, in the default coordinate system: a row a cell, laid out by place.

    Without a default, it is the first in the order of names. Cells without a place come first."""
    key = F.lit(default_key) if default_key is not None else F.col("first_key")
    one = binned.agg(F.min("coord_key").alias("first_key"))  # one row
    own = binned.crossJoin(F.broadcast(one)).where(F.col("coord_key") == key)
    lay_out(cells.join(places(own, finest).drop("coord_key"), "cell_id", "left"), path, reuse=reuse)


def write_places(binned: DataFrame, finest: int, path: str, reuse: bool = False) -> None:
    """The same places of the cells in all coordinate systems: a row a cell and system, laid out by place."""
    lay_out(places(binned, finest), path, ["coord_key"], reuse)


def places(binned: DataFrame, finest: int) -> DataFrame:
    """Normalised coordinates, z_key, and the bins at every zoom."""
    zooms = [c for z in range(finest + 1) for c in (parent("bin_x", finest - z).alias(f"bin_z{z}_x"), parent("bin_y", finest - z).alias(f"bin_z{z}_y"))]
    return binned.select("coord_key", "cell_id", F.col("nx").alias("x_normalized"), F.col("ny").alias("y_normalized"), z_key().alias("z_key"), *zooms)


def lay_out(rows: DataFrame, path: str, folders: list[str] | None = None, reuse: bool = False) -> None:
    """Write rows in ranges of z_key, in small row groups, so that a box is a few ranges of the table; a folder for each value of `folders`."""
    keys = [*(folders or []), "z_key", "cell_id"]
    rows.repartitionByRange(*keys).sortWithinPartitions(*keys).write.options(**FINE_PARTS).mode("ignore" if reuse else "overwrite").partitionBy(*(folders or [])).parquet(path)


def write_genes(genes: DataFrame, selected: DataFrame, path: str, reuse: bool = False) -> None:
    """Genes with is_selected and selected_index (-1 if not)."""
    out = genes.join(selected, "gene", "left").withColumn("is_selected", F.col("selected_index").isNotNull()).withColumn("selected_index", F.coalesce("selected_index", F.lit(-1)))
    out.write.mode("ignore" if reuse else "overwrite").parquet(path)


def append_results(result: DataFrame, path: str, finished_at: str) -> None:
    """Results lie in a folder a day and comparison, so that old days can be dropped as folders."""
    at = F.lit(finished_at).cast("timestamp")
    result.withColumns({"finished_at": at, "finished_day": at.cast("date")}).write.mode("append").partitionBy("finished_day", "comparison_id").parquet(path)


def drop_old_results(spark: SparkSession, path: str, to: str, now: str, days: int) -> None:
    """Write the results of the last `days` days to a new folder; the old one stays as it is."""
    old = spark.read.parquet(path)
    old.where(F.col("finished_at") >= F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days))).write.mode("overwrite").partitionBy("finished_day", "comparison_id").parquet(to)


def expire_results(spark: SparkSession, path: str, now: str, days: int) -> list[str]:
    """Drop results older than `days` days where they lie. Folders of older days go, the day that the limit falls on is written
    anew, and files of later days are not touched. Returns the days that went."""
    limit = spark.range(1).select((F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days))).alias("t")).select("t", F.col("t").cast("date").cast("string").alias("day")).first()
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    folders = {f.getPath().getName().partition("=")[2]: f.getPath() for f in fs.listStatus(top) if f.getPath().getName().startswith("finished_day=")}
    gone = sorted(day for day in folders if day < limit["day"])
    for day in gone:
        fs.delete(folders[day], True)
    if limit["day"] in folders:
        rows = spark.read.option("basePath", path).parquet(folders[limit["day"]].toString())
        late = F.col("finished_at") >= F.lit(limit["t"])
        if not rows.where(~late).isEmpty():
            # By comparison, as these are the folders that change. They are read to the end before they are replaced.
            old = [r[0] for r in rows.where(~late).select("comparison_id").distinct().collect()]
            if scratch_path(spark, "results") is None:
                raise ValueError("spark.checkpoint.dir must name a shared folder, where rows of the day of the limit wait")
            kept = written(rows.where(late & F.col("comparison_id").isin(*old)), "results")
            left = {r[0] for r in kept.select("comparison_id").distinct().collect()}
            kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("finished_day", "comparison_id").parquet(path)
            for f in fs.listStatus(folders[limit["day"]]):
                name = f.getPath().getName().partition("=")[2]
                if name in map(str, old) and name not in map(str, left):
                    fs.delete(f.getPath(), True)
    return gone
