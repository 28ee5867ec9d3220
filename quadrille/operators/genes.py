"""Gene totals, selection and search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.functions.coords import finite
from quadrille.operators.cells import sample, sample_key
from quadrille.operators.quantiles import order_statistics
from quadrille.sinks.scratch import written

#: Leaves of the tree on which the mean-variance curve is fitted, by shares of the genes and by lengths each.
LEAVES = 128
#: Cells that variable genes are computed from at most, and the value above which they are taken for raw counts, unless told otherwise.
HVG_CELLS, RAW_ABOVE = 200_000, 100.0


def gene_totals(expr: DataFrame, cells: DataFrame) -> DataFrame:
    """gene, total, variance over all cells (zeros included), n_cells with a value above 0."""
    n = cells.agg(F.count("*").alias("n"))
    got = expr.groupBy("gene").agg(F.sum("value").alias("total"), F.sum(F.col("value") * F.col("value")).alias("sq"), F.count_if(F.col("value") > 0).alias("n_cells"), F.max("value").alias("top"))
    got = got.crossJoin(F.broadcast(n))  # one row
    mean = F.col("total") / F.col("n")
    return got.select("gene", "total", (F.col("sq") / F.col("n") - mean * mean).alias("variance"), "n_cells", "top")


def normalize_log1p(expr: DataFrame, target: float = 1e4) -> DataFrame:
    """log(1 + value * target / the cell's sum)."""
    total = expr.groupBy("cell_id").agg(F.sum("value").alias("cell_sum"))
    return expr.join(total, "cell_id").select("cell_id", "gene", F.log1p(F.col("value") / F.col("cell_sum") * target).alias("value"))


def top_by_variance(totals: DataFrame, n: int) -> DataFrame:
    return totals.orderBy(F.desc("variance"), "gene").limit(n)


def top_by_total(totals: DataFrame, n: int) -> DataFrame:
    return totals.orderBy(F.desc("total"), "gene").limit(n)


def random_genes(genes: DataFrame, n: int, seed: int = 0) -> DataFrame:
    return sample(genes, n, seed, "gene")


def _vertices(points: DataFrame) -> DataFrame:
    """v: the ends of the leaves of a tree over x, which is cut at equal shares of the points and at equal lengths."""
    one = points.agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    at = one.where("n > 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(LEAVES))))
    ranks = at.select(F.lit(0).alias("all"), F.col("i").cast("string").alias("name"), F.floor(F.col("i") * (F.col("n") - 1) / LEAVES).alias("rank"))
    shares = order_statistics(points.withColumn("all", F.lit(0)), ["all"], "x", ranks).select(F.col("value").alias("v"))
    return shares.unionByName(at.select((F.col("lo") + F.col("i") * (F.col("hi") - F.col("lo")) / LEAVES).alias("v"))).distinct()


def _solved(s: list[Column], t: list[Column]) -> tuple[Column, Column]:
    """Value and slope at 0 of the weighted quadratic with moments s and t; a line or a mean where points are too few."""
    det = lambda a, b, c: a[0] * (b[1] * c[2] - b[2] * c[1]) - a[1] * (b[0] * c[2] - b[2] * c[0]) + a[2] * (b[0] * c[1] - b[1] * c[0])
    full, line = det(s[0:3], s[1:4], s[2:5]), s[0] * s[2] - s[1] * s[1]
    if_full, if_line = F.abs(full) > 1e-10 * s[0] * s[2] * s[4], F.abs(line) > 1e-10 * s[0] * s[2]
    value = F.when(if_full, det([t[0], s[1], s[2]], [t[1], s[2], s[3]], [t[2], s[3], s[4]]) / full).when(if_line, (t[0] * s[2] - t[1] * s[1]) / line).otherwise(F.try_divide(t[0], s[0]))
    slope = F.when(if_full, det([s[0], t[0], s[2]], [s[1], t[1], s[3]], [s[2], t[2], s[4]]) / full).when(if_line, (s[0] * t[1] - s[1] * t[0]) / line).otherwise(F.lit(0.0))
    return value, slope


def _curve(live: DataFrame, span: float) -> DataFrame:
    """live: gene, n, mean, var. Adds std, from a local quadratic fit of log variance on log mean.

    The fit is made at the vertices of a tree: each weighs the nearest share `span` of the genes (tricube) by grouped sums and gets a value and a
    slope. Between two vertices the curve is the cubic that has both. A row a gene and vertex is counted, none is sorted in one task."""
    points = written(live.select("*", F.log10("mean").alias("x"), F.log10("var").alias("y")), "log_means")
    vertices = written(_vertices(points), "vertices")
    near = points.crossJoin(F.broadcast(vertices)).select("v", "y", (F.col("x") - F.col("v")).alias("d"))  # 2 * LEAVES + 2 rows at most
    wanted = F.greatest(F.floor(F.lit(span) * F.col("n_live") + 1e-5), F.lit(1)) - 1
    ranks = vertices.crossJoin(F.broadcast(points.agg(F.count("*").alias("n_live")))).select("v", F.lit("h").alias("name"), wanted.alias("rank"))  # one row
    width = order_statistics(near.withColumn("far", F.abs("d")), ["v"], "far", ranks).select("v", F.greatest("value", F.lit(1e-12)).alias("h"))
    u = F.col("d") / F.col("h")
    w = F.pow(1 - F.pow(F.abs(u), F.lit(3.0)), F.lit(3.0))
    near = near.join(F.broadcast(width), "v").where(F.abs("d") <= F.col("h"))
    powers = [F.lit(1.0), u, u * u, u * u * u, u * u * u * u]
    sums = near.groupBy("v", "h").agg(*[F.sum(w * k).alias(f"s{i}") for i, k in enumerate(powers)], *[F.sum(w * k * F.col("y")).alias(f"t{i}") for i, k in enumerate(powers[:3])])
    value, slope = _solved([F.col(f"s{i}") for i in range(5)], [F.col(f"t{i}") for i in range(3)])
    fit = sums.select("v", value.alias("f"), (slope / F.col("h")).alias("g"))
    after = Window.orderBy("v")  # a row a vertex
    cells = fit.select(F.col("v").alias("v0"), F.col("f").alias("f0"), F.col("g").alias("g0"), *[F.lead(x).over(after).alias(f"{x}1") for x in ("v", "f", "g")])
    got = points.join(F.broadcast(cells), (F.col("x") >= F.col("v0")) & (F.col("v1").isNull() | (F.col("x") < F.col("v1"))))
    length = F.col("v1") - F.col("v0")
    z = (F.col("x") - F.col("v0")) / length
    cubic = (1 + 2 * z) * (1 - z) * (1 - z) * F.col("f0") + z * (1 - z) * (1 - z) * length * F.col("g0") + z * z * (3 - 2 * z) * F.col("f1") + z * z * (z - 1) * length * F.col("g1")
    return got.select(*live.columns, F.pow(F.lit(10.0), F.coalesce(cubic, F.col("f0")) / 2).alias("std"))


def sample_cells(cells: DataFrame, most: int = HVG_CELLS, seed: int = 0) -> DataFrame:
    """cell_id of `most` cells, those with the least keys; all cells if there are no more. The key that bounds them is selected, not sorted for."""
    ids = cells.select("cell_id")
    if ids.count() <= most:
        return ids
    key = F.conv(F.substring(sample_key(seed), 1, 13), 16, 10).cast("double")
    keyed = written(ids.select(F.lit(0).alias("all"), "cell_id", key.alias("key")), "keys")
    bound = order_statistics(keyed, ["all"], "key", keyed.sparkSession.createDataFrame([(0, "last", most - 1)], "all int, name string, rank long"))
    return keyed.crossJoin(F.broadcast(bound.select("value"))).where(F.col("key") <= F.col("value")).select("cell_id")  # one row


def variable_genes(expr: DataFrame, cells: DataFrame, span: float = 0.3, max_cells: int | None = HVG_CELLS, seed: int = 0, raw_above: float | None = RAW_ABOVE) -> DataFrame:
    """gene, score: variance of values standardised by the fitted mean-variance curve, clipped at sqrt(n); 0 for a gene that does not vary.

    Over max_cells cells, a seeded sample of them is used; None takes every cell. If the largest value is over raw_above, values are first
    normalised to 1e4 a cell and log1p; None takes them as they are.
    If no curve can be fitted (under three genes vary, or a fitted value is not finite), the score is the variance over all cells."""
    used, own = cells, expr
    if max_cells is not None:
        used = sample_cells(cells, max_cells, seed)
        own = expr.join(used, "cell_id", "left_semi")
    if raw_above is not None:
        top = own.agg(F.max("value")).first()[0]
        if top is not None and top > raw_above:
            own = normalize_log1p(own)
    n = F.broadcast(used.agg(F.count("*").cast("double").alias("n")))  # one row
    sums = own.groupBy("gene").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q")).crossJoin(n)
    stats = written(sums.select("gene", "n", (F.col("s") / F.col("n")).alias("mean"), F.try_divide(F.col("q") - F.col("s") * F.col("s") / F.col("n"), F.col("n") - 1).alias("var")), "gene_sums")
    live = stats.where((F.col("mean") > 0) & (F.col("var") > 1e-12 * F.col("mean") * F.col("mean")))
    fitted = written(_curve(live, span).select("gene", "n", "mean", "std"), "curve")
    n_live, n_fit = live.count(), fitted.where(finite("std") & (F.col("std") > 0)).count()
    if n_live < 3 or n_fit < n_live:
        return gene_totals(expr, cells).select("gene", F.col("variance").alias("score"))
    rows = own.join(fitted, "gene")
    clipped = F.least(F.col("value"), F.col("std") * F.sqrt("n") + F.col("mean"))
    agg = rows.groupBy("gene", "n", "mean", "std").agg(F.sum(clipped * clipped).alias("q"), F.sum(clipped).alias("s"))
    score = (F.col("n") * F.col("mean") * F.col("mean") + F.col("q") - 2 * F.col("s") * F.col("mean")) / ((F.col("n") - 1) * F.col("std") * F.col("std"))
    return stats.select("gene").join(agg.select("gene", score.alias("score")), "gene", "left").na.fill(0.0, ["score"])


def ranked_genes(genes: DataFrame, expr: DataFrame, cells: DataFrame) -> DataFrame:
    """gene, score, by which variable genes are chosen: the given marks if any gene has one, else the computed scores."""
    if "highly_variable" in genes.columns and not genes.where("highly_variable").isEmpty():
        rank = F.col("highly_variable_rank").cast("double") if "highly_variable_rank" in genes.columns else F.lit(0.0)
        return genes.where("highly_variable").select("gene", F.coalesce(-rank, F.lit(float("-inf"))).alias("score"))
    return variable_genes(expr, cells)


def flagged_genes(genes: DataFrame, n: int) -> DataFrame:
    """Genes marked as highly variable, by their rank if there is one."""
    rank = F.col("highly_variable_rank").asc_nulls_last() if "highly_variable_rank" in genes.columns else F.col("gene")
    return genes.where("highly_variable").orderBy(rank, "gene").limit(n)


def select_genes(expr: DataFrame, cells: DataFrame, n_genes: int = 500, hvg_n_top: int = 300, markers: list[str] | None = None, use_all_expressed: bool = False, min_cells: int = 1, hvg: DataFrame | None = None) -> DataFrame:
    """gene, selected_index. Variable genes first, then markers, then the largest totals, up to n_genes; or all expressed and the markers."""
    totals = gene_totals(expr, cells)
    if use_all_expressed:
        wanted = totals.where(F.col("gene").isin(*markers)) if markers else totals.where(F.lit(False))
        chosen = totals.where(F.col("n_cells") >= min_cells).select("gene").union(wanted.select("gene")).distinct()
    else:
        # A row a gene is ranked in one go; the matrix is summed once.
        rows = totals.withColumn("score", F.col("variance")) if hvg is None else totals.join(hvg.select("gene", "score"), "gene", "left")
        rows = rows.withColumn("k", F.row_number().over(Window.orderBy(F.desc_nulls_last("score"), "gene"))).withColumn("t", F.row_number().over(Window.orderBy(F.desc("total"), "gene")))
        marked = F.col("gene").isin(*markers) if markers else F.lit(False)
        priority = F.when((F.col("k") <= hvg_n_top) & F.col("score").isNotNull(), 0).when(marked, 1).when(F.col("t") <= n_genes, 2)
        rows = rows.withColumn("priority", priority).where("priority is not null").withColumn("size", F.when(F.col("priority") == 0, F.col("score")).otherwise(F.col("total")))
        chosen = rows.orderBy("priority", F.desc("size"), "gene").limit(n_genes)
    from quadrille.operators.pyramid import category_dictionary

    index = category_dictionary(chosen.select("gene"), "gene")
    return index.select(F.col("category").alias("gene"), F.col("category_index").alias("selected_index"))


def search(genes: DataFrame, text: str, limit: int = 20) -> DataFrame:
    return genes.where(F.lower("gene").contains(text.lower())).orderBy("gene").limit(limit)


def gene_range(genes: DataFrame) -> DataFrame:
    """Non-empty genes: how many, and the least and largest id."""
    return genes.where(F.col("gene") != "").agg(F.count("*").alias("n"), F.min("gene_id").alias("low"), F.max("gene_id").alias("high"))
