"""Two-group differential expression over all genes.

Absent values are zeros, and never made into rows: a rank test sees them as one counted value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.functions.stats import normal_p, t_p
from quadrille.operators.cells import sample_groups


#: Ranges that a doubling of the value is cut into; the values of a range are ranked apart.
RANGES = 16


def label_groups(cells: DataFrame, groupby: str, group1: list[str], group2: list[str] | None = None, max_cells: int | None = None, seed: int = 0) -> DataFrame:
    """cell_id, group 1 or 2. Without group2, it is every other non-empty value."""
    one, two = sorted(set(group1)), sorted(set(group2)) if group2 else None
    if two and set(one) & set(two):
        raise ValueError("the groups overlap")
    value = F.col(groupby).cast("string")
    rest = value.isin(*two) if two else (value != "")
    rows = cells.select("cell_id", F.when(value.isin(*one), 1).when(rest, 2).alias("group")).where("group is not null")
    return sample_groups(rows, "group", max_cells, seed)


def group_sizes(labels: DataFrame) -> DataFrame:
    return labels.agg(F.count_if(F.col("group") == 1).alias("n1"), F.count_if(F.col("group") == 2).alias("n2"))


def _moments(rows: DataFrame) -> list[Column]:
    out = []
    for g in (1, 2):
        v = F.when(F.col("group") == g, F.col("value"))
        out += [F.coalesce(F.sum(v), F.lit(0.0)).alias(f"sum{g}"), F.coalesce(F.sum(v * v), F.lit(0.0)).alias(f"sumsq{g}"), F.count(v).alias(f"nnz{g}")]
    return out


def moments(expr: DataFrame, labels: DataFrame, genes: DataFrame) -> DataFrame:
    """For each gene: sums, sums of squares and stored values of both groups, in one pass over the matrix."""
    rows = expr.where(F.col("value") != 0).join(labels, "cell_id")
    got = rows.groupBy("gene").agg(*_moments(rows))
    out = genes.select("gene").join(got, "gene", "left").na.fill(0)
    return out.crossJoin(F.broadcast(group_sizes(labels)))  # one row


def effect(m: DataFrame) -> DataFrame:
    """mean, pct, var of both groups, log2fc."""
    for g in (1, 2):
        n, mean = F.col(f"n{g}"), F.try_divide(f"sum{g}", f"n{g}")
        m = m.withColumn(f"mean{g}", F.coalesce(mean, F.lit(0.0))).withColumn(f"pct{g}", F.coalesce(F.try_divide(f"nnz{g}", f"n{g}"), F.lit(0.0)))
        var = (F.col(f"sumsq{g}") / n - F.col(f"mean{g}") * F.col(f"mean{g}")) * n / (n - 1)
        m = m.withColumn(f"var{g}", F.when(n > 1, F.greatest(var, F.lit(0.0))).otherwise(0.0))
    e = 1e-9
    fc = F.when((F.col("mean1") <= e) & (F.col("mean2") <= e), 0.0).otherwise(F.log2((F.col("mean1") + e) / (F.col("mean2") + e)))
    return m.withColumn("log2fc", fc)


def welch(m: DataFrame) -> DataFrame:
    """t and df; null where a group has under two cells, nothing is stored, or nothing varies."""
    a, b = F.col("var1") / F.col("n1"), F.col("var2") / F.col("n2")
    ok = (F.col("n1") > 1) & (F.col("n2") > 1) & (F.col("nnz1") + F.col("nnz2") > 0) & ((F.col("var1") > 0) | (F.col("var2") > 0))
    m = m.withColumn("t", F.when(ok, (F.col("mean1") - F.col("mean2")) / F.sqrt(a + b)))
    df = (a + b) * (a + b) / (a * a / (F.col("n1") - 1) + b * b / (F.col("n2") - 1))
    return m.withColumn("df", F.when(ok, F.greatest(df, F.lit(1.0))))


def rank_moments(expr: DataFrame, labels: DataFrame, genes: DataFrame) -> DataFrame:
    """The moments of each gene, and r1 and ties (sum of t^3 - t) of average ranks over counted values, in one pass over the matrix.

    Values are ranked inside ranges, then each range behind the counts of those before it, so no task has to
    order all values of a gene. Zeros, which are not stored, stand as one counted value between the signs."""
    rows = expr.where(F.col("value") != 0).join(labels, "cell_id")
    counts = rows.groupBy("gene", "value").agg(F.count_if(F.col("group") == 1).alias("t1"), F.count_if(F.col("group") == 2).alias("t2"))
    v, t = F.col("value"), F.col("t")
    part = F.signum(v) * (F.floor(F.least(F.log2(F.abs(v)), F.lit(2000.0)) * RANGES) + 2000 * RANGES)
    counts = counts.withColumn("t", (F.col("t1") + F.col("t2")).cast("double")).withColumn("part", part)
    before = Window.partitionBy("gene", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("rank", F.coalesce(F.sum("t").over(before), F.lit(0.0)) + (t + 1) / 2)
    sums = [F.sum(F.col(f"t{g}") * x).alias(f"{n}{g}") for g in (1, 2) for x, n in ((v, "sum"), (v * v, "sumsq"))]
    parts = counts.groupBy("gene", "part").agg(F.sum(F.col("t1") * F.col("rank")).alias("r1"), F.sum(t * t * t - t).alias("ties"), F.sum("t1").alias("t1"), F.sum("t2").alias("t2"), F.sum("t").alias("t"), *sums)
    below = F.coalesce(F.sum("t").over(Window.partitionBy("gene").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))  # a row a range
    parts = parts.withColumn("r1", F.col("r1") + F.col("t1") * below)
    total = [F.sum(x).alias(x) for x in ("sum1", "sumsq1", "sum2", "sumsq2", "r1", "ties")]
    got = parts.groupBy("gene").agg(F.sum("t1").alias("nnz1"), F.sum("t2").alias("nnz2"), F.sum(F.when(F.col("part") > 0, F.col("t1")).otherwise(0)).alias("above1"), F.sum(F.when(F.col("part") < 0, t).otherwise(0.0)).alias("under"), *total)
    out = genes.select("gene").join(got, "gene", "left").na.fill(0).crossJoin(F.broadcast(group_sizes(labels)))  # one row
    zeros1, zeros = F.col("n1") - F.col("nnz1"), (F.col("n1") + F.col("n2") - F.col("nnz1") - F.col("nnz2")).cast("double")
    r1 = F.col("r1") + F.col("above1") * zeros + zeros1 * (F.col("under") + (zeros + 1) / 2)
    return out.withColumns({"r1": r1, "ties": F.col("ties") + zeros * zeros * zeros - zeros}).drop("above1", "under")


def _mann_whitney(m: DataFrame) -> DataFrame:
    """Adds u and z from r1 and ties; z is null where nothing varies."""
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    m = m.withColumn("u1", F.col("r1") - n1 * (n1 + 1) / 2).withColumn("u", F.least("u1", n1 * n2 - F.col("u1"))).drop("u1")
    var = n1 * n2 / 12 * ((n + 1) - F.try_divide(F.col("ties"), n * (n - 1)))
    sigma = F.sqrt(F.greatest(F.coalesce(var, F.lit(0.0)), F.lit(0.0)))
    return m.withColumn("z", F.when(sigma >= 1e-10, (F.col("u") + 0.5 - n1 * n2 / 2) / sigma))


def rank_sum(expr: DataFrame, labels: DataFrame, genes: DataFrame) -> DataFrame:
    """gene, r1, ties (sum of t^3 - t), u, z: Mann-Whitney with average ranks."""
    return _mann_whitney(rank_moments(expr, labels, genes)).select("gene", "r1", "ties", "u", "z")


def bh(rows: DataFrame, p: str, out: str, group: str = "comparison_id") -> DataFrame:
    """Benjamini-Hochberg within each comparison (a row a gene); null p stay null. Null and other rows are parts of one window."""
    part = [F.col(group), F.col(p).isNull()]
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy(*part).orderBy(p, "gene"))).withColumn("n", F.count("*").over(Window.partitionBy(*part)))
    down = Window.partitionBy(*part).orderBy(F.desc("r")).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.min(F.col(p) * F.col("n") / F.col("r")).over(down), F.lit(1.0)))).drop("r", "n")


def differential(cells: DataFrame, expr: DataFrame, genes: DataFrame, groupby: str, group1: list[str], group2: list[str] | None = None, tests=("ttest", "ranksum"), max_cells: int | None = 2000, seed: int = 0, comparison_id: str = "0", guard: float = 0.0) -> DataFrame:
    """gene, means, pcts, log2fc, p and FDR of the asked tests (null for others). max_cells None takes every cell.

    guard: p_ttest is 1 where the denominator of the degrees of freedom is below it; 1e-15 gives what the surveyed system gives for
    small variances of large groups, although their t is valid. 0 computes them."""
    if max_cells is not None:
        max_cells = max(1, min(max_cells, 20_000))
    labels = label_groups(cells, groupby, group1, group2, max_cells, seed)
    ranks = "ranksum" in tests
    m = welch(effect((rank_moments if ranks else moments)(expr, labels, genes)))
    # The tails are long expressions over few rows: these go to all cores.
    m = m.repartition(cells.sparkSession.sparkContext.defaultParallelism, "gene")
    flat = F.when((F.col("n1") < 2) | (F.col("n2") < 2) | (F.col("nnz1") + F.col("nnz2") == 0), 1.0).when(F.col("mean1") == F.col("mean2"), 1.0).otherwise(0.0)
    null = F.lit(None).cast("double")
    a, b = F.col("var1") / F.col("n1"), F.col("var2") / F.col("n2")
    small = F.coalesce(F.try_divide(a * a, F.col("n1") - 1) + F.try_divide(b * b, F.col("n2") - 1) < guard, F.lit(False))
    p = F.when(F.col("t").isNull(), flat).when(small, 1.0).otherwise(t_p("t", "df"))
    m = m.withColumn("p_ttest", p if "ttest" in tests else null)
    if ranks:
        m = _mann_whitney(m).withColumn("p_ranksum", F.when(F.col("z").isNull(), 1.0).otherwise(normal_p("z")))
    else:
        m = m.withColumn("p_ranksum", null)
    m = m.withColumn("comparison_id", F.lit(comparison_id))
    m = bh(bh(m, "p_ttest", "fdr_ttest"), "p_ranksum", "fdr_ranksum")
    return m.select("comparison_id", "gene", "mean1", "mean2", "pct1", "pct2", "log2fc", "p_ttest", "fdr_ttest", "p_ranksum", "fdr_ranksum")


ORDERS = ("fdr_ranksum", "fdr_ttest", "p_ranksum", "p_ttest", "abs_log2fc")


def page(result: DataFrame, order_by: str = "fdr_ranksum", offset: int = 0, limit: int = 50) -> DataFrame:
    order_by = order_by if order_by in ORDERS else "fdr_ranksum"
    limit = 50 if limit <= 0 else min(limit, 500)
    size = F.abs("log2fc").desc()
    keys = [size, F.col("fdr_ranksum").asc_nulls_last()] if order_by == "abs_log2fc" else [F.col(order_by).asc_nulls_last(), size]
    return result.orderBy(*keys, "gene").offset(max(offset, 0)).limit(limit)


def volcano(result: DataFrame, metric: str = "fdr_ranksum", fc: float = 1.0, cut: float = 0.05, drop_absent: bool = False) -> DataFrame:
    """gene, x, y, class: up, down or ns, also where the metric is null."""
    import math

    rows = result.where((F.col("pct1") > 0) | (F.col("pct2") > 0)) if drop_absent else result
    y = F.when(F.col(metric).isNotNull(), -F.log10(F.least(F.greatest(metric, F.lit(1e-300)), F.lit(1.0))))
    rows = rows.select("gene", F.col("log2fc").alias("x"), y.alias("y"))
    sig = F.col("y") >= -math.log10(cut)
    return rows.withColumn("class", F.when(sig & (F.col("x") >= fc), "up").when(sig & (F.col("x") <= -fc), "down").otherwise("ns"))
