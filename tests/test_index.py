"""Places in an order, over many tasks, and the readers that count lines or columns."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from quadrille.operators import index
from quadrille.operators import pyramid as B
from quadrille.sources import atlas


def test_dense_index(spark):
    rows = spark.range(5000).select((F.col("id") % 3).alias("g"), (F.hash("id") % 100_000).alias("x"), "id").repartition(7)
    got = index.dense_index(rows, ["x", "id"], ["g"], "at").collect()
    assert len(got) == 5000
    for g in range(3):
        own = sorted((r["x"], r["id"], r["at"]) for r in got if r["g"] == g)
        assert [r[2] for r in own] == list(range(len(own)))
    one = index.dense_index(rows, ["x", "id"], name="at")
    assert [r["at"] for r in one.orderBy("x", "id").collect()] == list(range(5000))
    assert index.dense_index(rows.where("false"), ["x"]).count() == 0


def test_dense_index_orders_nothing_in_one_task(spark):
    bins = spark.range(3000).select(F.lit("u").alias("coord_key"), (F.col("id") % 2).cast("int").alias("zoom"), F.col("id").cast("int").alias("bin_x"), F.lit(0).alias("bin_y"))
    plan = B.bin_index(bins)._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan and "n_in_part" in plan  # the only window is over a row a range
    cells = spark.createDataFrame([("b",), (None,), ("a",), ("b",), ("Z",)], "kind string")
    assert {(r["category"], r["category_index"]) for r in B.category_dictionary(cells, "kind").collect()} == {("Z", 0), ("a", 1), ("b", 2), ("nan", 3)}


@pytest.mark.parametrize("zipped", [False, True])
def test_names_of_a_file_in_many_blocks(spark, tmp_path, zipped):
    names = [f"n{random.Random(i).randrange(10**9)}-{i}" for i in range(4000)]
    text = "\n".join(names) + "\n"
    path = tmp_path / ("x.cols.gz" if zipped else "x.cols")
    path.write_bytes(gzip.compress(text.encode())) if zipped else path.write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        got = {r["position"]: r["name"] for r in atlas.read_names(spark, f"file://{path}").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == dict(enumerate(names))


def test_matrix_market_in_many_blocks(spark, tmp_path):
    rng = random.Random(2)
    cells = {(rng.randrange(50), rng.randrange(70)): float(rng.randrange(1, 9)) for _ in range(1500)} | {(49, 69): float(1501)}
    lines = [f"{g + 1} {c + 1} {v}" for (g, c), v in cells.items()]
    # An entry that reads like the header stays; zeros and values that are not finite go.
    lines = ["50 70 1500", *lines[:-1], "50 70 1500", "3 4 0", "3 5 NaN", "3 6 Infinity"]
    cells[(49, 69)] = 1500.0
    for g, c in ((2, 3), (2, 4), (2, 5)):
        cells.pop((g, c), None)
    lines = [x for x in lines if x.split()[:2] not in (["3", "4"], ["3", "5"], ["3", "6"]) or x.endswith((" 0", "NaN", "Infinity"))]
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix\n% a note\n" + "\n".join(lines) + "\n")
    (tmp_path / "m.rows").write_text("".join(f"g{i}\n" for i in range(50)))
    (tmp_path / "m.cols").write_text("".join(f"c{i}\n" for i in range(70)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = {(r["gene"], r["cell_name"]): r["value"] for r in atlas.read_matrix_market(spark, f"file://{tmp_path}/m").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {(f"g{g}", f"c{c}"): v for (g, c), v in cells.items()}


def test_key_columns_in_one_job(spark, tmp_path):
    cells = spark.createDataFrame([(f"c{i}", i) for i in range(40)], "cell_name string, cell_id int")
    (tmp_path / "meta.csv").write_text("kind,half,name.x,last\n" + "".join(f"A,{'c' + str(i) if i % 2 else 'none'},c{i},{i}\n" for i in range(40)))
    table = spark.read.csv(f"file://{tmp_path}/meta.csv", header=True)
    tracker, sc = spark.sparkContext.statusTracker(), spark.sparkContext
    sc.setJobGroup("ratios", "ratios")
    got = atlas.match_ratios(table, table.columns, cells)
    n_jobs = len(tracker.getJobIdsForGroup("ratios"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert got == {"kind": 0.0, "half": 0.5, "name.x": 1.0, "last": 0.0}
    sc.setJobGroup("one", "one")
    atlas.match_ratios(table, ["half"], cells)
    assert n_jobs == len(tracker.getJobIdsForGroup("one"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert atlas.match_ratios(table, ["kind"], cells.limit(0)) == {"kind": 0.0}
