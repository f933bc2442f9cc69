"""Row numbers by prefix counts, and done-cell bitmaps, against plain versions."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from gaugeworks.operators import cells, ordinals
from gaugeworks.operators.ordinals import numbered, numbered_by


def test_numbers_follow_the_order(spark):
    rng = random.Random(1)
    rows = [(rng.choice(("a", "b", None)), rng.randrange(5000), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, x int, i int").repartition(7)
    got = numbered(df, ["g", F.desc("x"), "i"], "n").orderBy("n").collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", -r[1], r[2]))
    assert [tuple(r)[:3] for r in got] == want and [r.n for r in got] == list(range(3000))


def test_equal_rows_and_none(spark):
    df = spark.createDataFrame([(1,)] * 500, "x int")
    assert sorted(r.ordinal for r in numbered(df, ["x"]).collect()) == list(range(500))
    assert numbered(df.limit(0), ["x"]).count() == 0 and numbered_by(df.limit(0), ["x"], ["x"]).columns == ["x", "ordinal"]


def test_numbers_in_groups_of_any_size(spark):
    rng = random.Random(3)
    rows = [(rng.choice(("hot", "hot", "hot", "b", None)) if i % 50 else f"only {i}", i % 3, rng.randrange(100), i) for i in range(6000)]
    df = spark.createDataFrame(rows, "g string, h int, x int, i int").repartition(5)
    got = numbered_by(df, ["g", "h"], ["x", "i"], "n")
    want = df.withColumn("n", (F.row_number().over(Window.partitionBy("g", "h").orderBy("x", "i")) - 1).cast("long"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_no_task_holds_a_hot_group(spark):
    items = spark.range(40_000).select(F.col("id").cast("string").alias("item_id"))
    grid = cells.sweep_grid(items, spark.createDataFrame([("only",)], "model string"), 5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one partition
    try:
        kept = ordinals._placed(grid, ["model", "item_id", "sample_k"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r[0] for r in kept.groupBy("_part").agg(F.count("*")).select("count(1)").collect()]
    assert sum(sizes) == 200_000 and len(sizes) == 4 and max(sizes) < 2 * 50_000
    split = cells.budget_split(grid, ["model", "item_id", "sample_k"], 70_001)
    assert split.where("run").count() == 70_001
    last = grid.orderBy("model", "item_id", "sample_k").limit(70_001).agg(F.max(F.struct("model", "item_id", "sample_k"))).first()[0]
    assert tuple(split.where("run").agg(F.max(F.struct("model", "item_id", "sample_k"))).first()[0]) == tuple(last)
    top = cells.waves(grid, ["item_id", "sample_k"], 1000).groupBy("wave").count()
    assert top.count() == 200 and top.where("count <> 1000").count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(samples=st.sampled_from([1, 2, 63, 64, 65, 130]), done=st.lists(st.tuples(st.sampled_from(["m", "n", "other"]), st.sampled_from(["i", "j", "k"]), st.integers(-2, 140)), max_size=40))
def test_bitmaps_equal_the_grid(spark, samples, done):
    items = spark.createDataFrame([("i",), ("j",)], "item_id string")
    roster = spark.createDataFrame([("m",), ("n",)], "model string")
    rows = spark.createDataFrame(done, "model string, item_id string, sample_k int")
    grid = {(m, i, k) for m in "mn" for i in "ij" for k in range(samples)}
    assert sorted(map(tuple, cells.pending_cells(items, roster, samples, rows).collect())) == sorted(grid - set(done))
    assert sorted(map(tuple, cells.completed_cells(items, roster, samples, rows).collect())) == sorted(grid & set(done))


def test_only_pairs_travel(spark):
    """The rows meet pairs of model and item, so no exploded grid is shuffled."""
    items = spark.createDataFrame([("i",)], "item_id string")
    roster = spark.createDataFrame([("m",)], "model string")
    rows = spark.createDataFrame([("m", "i", 3)], "model string, item_id string, sample_k int")
    plan = cells.pending_cells(items, roster, 1000, rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan[: plan.index("Generate explode(")] and "Join" in plan


def test_bad_sizes(spark):
    from gaugeworks.errors import RunError

    items, roster = spark.createDataFrame([("i",)], "item_id string"), spark.createDataFrame([("m",)], "model string")
    with pytest.raises(RunError):
        cells.pending_cells(items, roster, 0, spark.createDataFrame([], "model string, item_id string, sample_k int"))
    with pytest.raises(RunError):
        cells.budget_split(cells.sweep_grid(items, roster, 1), ["model"], 0)
