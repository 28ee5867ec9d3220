"""From atlas tables to a written pyramid, store and catalog."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille import sinks
from quadrille.functions import coords as C
from quadrille.operators import genes as G
from quadrille.operators import profile, pyramid


@dataclass
class Config:
    levels: int = 8
    n_genes: int = 500
    hvg_n_top: int = 300
    min_cells: int = 1
    tile_size: int = 256
    side: float = C.SIDE
    coord_keys: list[str] = field(default_factory=list)
    default_key: str | None = None
    categories: list[str] | None = None
    numeric: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    markers: list[str] = field(default_factory=list)
    use_all_expressed: bool = False
    cell_lists: bool = False
    reuse: bool = False
    dataset_id: str = "atlas"

    def __post_init__(self):
        if not 1 <= self.levels <= 12:
            raise ValueError("levels must be 1 to 12")
        if self.n_genes < 1 or self.min_cells < 1:
            raise ValueError("n_genes and min_cells must be at least 1")
        if self.tile_size not in (128, 256, 512):
            raise ValueError("tile_size must be 128, 256 or 512")
        self.coord_keys = list(dict.fromkeys(self.coord_keys))
        if self.default_key is not None and self.coord_keys and self.default_key not in self.coord_keys:
            raise ValueError("default_key is not one of coord_keys")


class Store:
    """A folder of tables. A table counts as there when its manifest is: a fingerprint of input and configuration, written after the table.

    With reuse, tables whose fingerprint is the wanted one stay; others, half-written ones among them, are made and written anew."""

    def __init__(self, spark: SparkSession, path: str, inputs: str, reuse: bool):
        self.spark, self.path, self.inputs, self.reuse = spark, path, inputs, reuse

    def _fingerprint(self, about: dict) -> str:
        return hashlib.sha256(json.dumps([self.inputs, about], sort_keys=True, default=str).encode()).hexdigest()

    def stored(self, name: str) -> str | None:
        """The fingerprint in a table's manifest."""
        try:
            return self.spark.read.schema("fingerprint string").parquet(f"{self.path}/manifests/{name}").first()["fingerprint"]
        except (AnalysisException, TypeError):  # there is none, or it is empty
            return None

    def table(self, name: str, about: dict, write: Callable[[str], None]) -> str:
        """The table's path, after write(path) unless it is reused. about: what the table depends on beside the input."""
        path, mark = f"{self.path}/{name}", self._fingerprint(about)
        if not (self.reuse and self.stored(name) == mark):
            _delete(self.spark, f"{self.path}/manifests/{name}")
            write(path)
            self.commit(name, mark)
        return path

    def commit(self, name: str, mark: str) -> None:
        self.spark.createDataFrame([(mark,)], "fingerprint string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifests/{name}")


def _delete(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def fingerprint(atlas: dict[str, DataFrame]) -> str:
    """Of all rows of all tables, in any order: their number and the sum and xor of their hashes."""
    out = []
    for name in sorted(atlas):
        df = atlas[name]
        h = F.xxhash64(*[F.struct(F.col(f"`{c}`"), F.col(f"`{c}`").isNull()) for c in sorted(df.columns)])
        out.append((name, sorted(df.dtypes), list(df.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).first())))
    return hashlib.sha256(json.dumps(out, default=str).encode()).hexdigest()


def preprocess(spark: SparkSession, atlas: dict, path: str, config: Config) -> None:
    """atlas: cells, genes, expr, coords, as load_atlas gives them."""
    config = stored_config(spark, path, config)
    store = Store(spark, path, fingerprint(atlas), config.reuse)
    points, finest = atlas["coords"], config.levels - 1
    if config.coord_keys:
        points = points.where(F.col("coord_key").isin(*config.coord_keys))
    cells, expr = atlas["cells"], atlas["expr"]
    text, numeric = profile.choose_columns(cells, config.numeric, config.exclude)
    grid = {"levels": config.levels, "side": config.side, "coord_keys": config.coord_keys}
    chosen = {x: getattr(config, x) for x in ("n_genes", "hvg_n_top", "markers", "use_all_expressed", "min_cells")}

    params = spark.read.parquet(store.table("params", grid, lambda to: C.transform_params(points, config.side).write.mode("overwrite").parquet(to)))
    default = config.default_key or (config.coord_keys[0] if config.coord_keys else params.agg(F.min("coord_key")).first()[0])
    binned = C.assign_bins(C.normalize(points, params), finest, config.side)
    at = binned.select("coord_key", "cell_id", "bin_x", "bin_y")

    def select(to: str) -> None:
        hvg = None if config.use_all_expressed else G.ranked_genes(atlas["genes"], expr, cells)
        G.select_genes(expr, cells, config.n_genes, config.hvg_n_top, config.markers, config.use_all_expressed, config.min_cells, hvg).write.mode("overwrite").parquet(to)

    def columns(to: str) -> None:
        names = profile.guard(cells.select("cell_id", *text), config.categories)
        spark.createDataFrame([(i, c) for i, c in enumerate(names)], "position int, column string").write.mode("overwrite").parquet(to)

    selected = spark.read.parquet(store.table("selection", chosen, select))
    used = [r["column"] for r in spark.read.parquet(store.table("columns", {"asked": config.categories, "text": text}, columns)).orderBy("position").collect()]
    counts = spark.read.parquet(store.table("bins", grid, lambda to: sinks.write_pyramid(pyramid.bin_counts(at, finest), to, ["bin_x", "bin_y"]))).select(*pyramid.BIN, "cell_count")
    store.table("bin_expr", grid | chosen, lambda to: sinks.write_pyramid(pyramid.bin_expression(expr, at, finest, counts, selected), to, ["gene", "bin_x", "bin_y"]))
    for c in used:
        store.table(f"bin_cat/{C.column_name(c)}", grid | {"column": c}, lambda to, c=c: sinks.write_pyramid(pyramid.bin_categories(cells, at, finest, c), to, ["bin_x", "bin_y"]))
        store.table(f"categories/{C.column_name(c)}", {"column": c}, lambda to, c=c: pyramid.category_dictionary(cells, c).write.mode("overwrite").parquet(to))
    for c in numeric:
        store.table(f"bin_num/{C.column_name(c)}", grid | {"column": c}, lambda to, c=c: sinks.write_pyramid(pyramid.bin_numbers(cells, at, finest, c), to, ["bin_x", "bin_y"]))
    if config.cell_lists:
        store.table("bin_cells", grid, lambda to: sinks.write_pyramid(pyramid.bin_cells(at, finest, finest), to, ["bin_x", "bin_y"]))
    store.table("expr", {}, lambda to: sinks.write_matrix(expr, to))
    store.table("expr_by_gene", {}, lambda to: sinks.write_gene_blocks(expr, to))
    store.table("genes", chosen | {"dataset_id": config.dataset_id}, lambda to: sinks.write_genes(atlas["genes"].withColumn("dataset_id", F.lit(config.dataset_id)), selected, to))
    store.table("cells", grid | {"default": default}, lambda to: sinks.write_cells(cells, binned, finest, to, default_key=default))
    store.table("places", grid, lambda to: sinks.write_places(binned, finest, to))
    texts = lambda names: F.array(*[F.lit(x) for x in names]).cast("array<string>")
    about = {"dataset_id": F.lit(config.dataset_id), "is_default": F.col("coord_key") == F.lit(default), "levels": F.lit(config.levels), "tile_size": F.lit(config.tile_size), "n_genes": F.lit(config.n_genes), "categories": texts(used), "numeric": texts(numeric)}
    known = grid | {"id": config.dataset_id, "default": default, "tile_size": config.tile_size, "n_genes": config.n_genes, "categories": used, "numeric": numeric}
    store.table("datasets", known, lambda to: params.withColumns(about).write.mode("overwrite").parquet(to))


def add_cells(spark: SparkSession, path: str, more: dict, to: str) -> None:
    """Writes to another folder what is stored at path with the cells of `more` (cells, expr, coords) added: their sums are added to the stored
    ones, and stored cells are not binned again. Bounds, zooms and chosen genes stay as they are stored; points beyond the bounds go to
    the map's sides, and genes that are new to the atlas are in the matrix alone. New cells must have new ids."""
    old = lambda name: spark.read.parquet(f"{path}/{name}")
    about = old("datasets")
    row = about.first()
    finest, side, used, numeric = row["levels"] - 1, row["side"], row["categories"], row["numeric"]
    params, cells, expr = old("params"), more["cells"], more["expr"]
    binned = C.assign_bins(C.normalize(more["coords"], params), finest, side)
    at = binned.select("coord_key", "cell_id", "bin_x", "bin_y")

    def merged(stored: DataFrame, new: DataFrame, keys: list[str], sums: dict) -> DataFrame:
        names = [*pyramid.BIN, *keys, *sums]
        return stored.select(*names).unionByName(new.select(*names)).groupBy(*pyramid.BIN, *keys).agg(*[f(x).alias(x) for x, f in sums.items()])

    sinks.write_pyramid(merged(old("bins"), pyramid.bin_counts(at, finest), [], {"cell_count": F.sum}), f"{to}/bins", ["bin_x", "bin_y"])
    counts = spark.read.parquet(f"{to}/bins").select(*pyramid.BIN, "cell_count")
    sums = pyramid.bin_sums(expr, at, finest, old("selection"))
    sinks.write_pyramid(pyramid.with_means(merged(old("bin_expr"), sums, ["gene"], {"sum": F.sum, "max": F.max}), counts), f"{to}/bin_expr", ["gene", "bin_x", "bin_y"])
    for c in used:
        name = f"bin_cat/{C.column_name(c)}"
        sinks.write_pyramid(merged(old(name), pyramid.bin_categories(cells, at, finest, c), ["category", "column"], {"n": F.sum}), f"{to}/{name}", ["bin_x", "bin_y"])
        every = old(f"categories/{C.column_name(c)}").select(F.col("category").alias(c)).unionByName(cells.select(F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias(c)))
        pyramid.category_dictionary(every, c).write.mode("overwrite").parquet(f"{to}/categories/{C.column_name(c)}")
    for c in numeric:
        name = f"bin_num/{C.column_name(c)}"
        both = merged(old(name), pyramid.bin_numbers(cells, at, finest, c), ["column"], {"sum": F.sum, "n": F.sum})
        sinks.write_pyramid(both.withColumn("mean", F.try_divide("sum", "n")), f"{to}/{name}", ["bin_x", "bin_y"])
    matrix = old("expr").unionByName(expr.select(*old("expr").columns))
    sinks.write_matrix(matrix, f"{to}/expr")
    sinks.write_gene_blocks(matrix, f"{to}/expr_by_gene")
    default = about.where("is_default").first()["coord_key"]
    sinks.write_cells(cells, binned, finest, f"{to}/new_cells", default_key=default)
    sinks.lay_out(old("cells").unionByName(spark.read.parquet(f"{to}/new_cells"), allowMissingColumns=True), f"{to}/cells")
    _delete(spark, f"{to}/new_cells")
    sinks.lay_out(old("places").unionByName(sinks.places(binned, finest)), f"{to}/places", ["coord_key"])
    for name in ("params", "selection", "columns", "genes", "datasets"):
        old(name).write.mode("overwrite").parquet(f"{to}/{name}")


def stored_config(spark: SparkSession, path: str, config: Config) -> Config:
    """The configuration to go on with where output is reused: levels, tile size and side are those of what is stored."""
    if not config.reuse:
        return config
    try:
        row = spark.read.parquet(f"{path}/datasets").select("levels", "tile_size", "side").first()
    except AnalysisException:  # nothing is stored yet
        return config
    return replace(config, **row.asDict()) if row else config
