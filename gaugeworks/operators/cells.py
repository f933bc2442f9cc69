"""The cell grid: sweep, resume, budget, waves, gold look-up and row building."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.errors import RunError
from gaugeworks.operators.ordinals import numbered, numbered_by
from gaugeworks.schemas import CELL, NO_RESPONSE


#: A roster is a run's configuration; more models than this are refused.
MOST_MODELS = 10_000


def sweep_grid(items: DataFrame, roster: DataFrame, samples: int) -> DataFrame:
    """Every (model, item_id, sample_k): each item is exploded in place, without a join."""
    return _pairs(items, roster, samples).select("model", "item_id", F.explode(_samples(samples)).alias("sample_k"))


def _samples(samples: int) -> Column:
    return F.sequence(F.lit(0), F.lit(samples - 1))


def _pairs(items: DataFrame, roster: DataFrame, samples: int) -> DataFrame:
    if samples < 1:
        raise RunError("samples per cell must be at least 1")
    models = sorted(r[0] for r in roster.select("model").distinct().limit(MOST_MODELS + 1).collect())
    if len(models) > MOST_MODELS:
        raise RunError(f"a roster of over {MOST_MODELS} models")
    return items.select("item_id", F.explode(F.array(*map(F.lit, models)).cast("array<string>")).alias("model"))


def done_bitmaps(rows: DataFrame) -> DataFrame:
    """(model, item_id, done): the samples that have a row, as words of 64 bits by sample_k div 64."""
    bit = F.expr("shiftleft(cast(1 as bigint), sample_k % 64)")
    words = rows.where("sample_k >= 0").groupBy("model", "item_id", F.expr("cast(sample_k div 64 as int)").alias("word")).agg(F.bit_or(bit).alias("bits"))
    return words.groupBy("model", "item_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("done"))


def _marked(items: DataFrame, roster: DataFrame, samples: int, rows: DataFrame, done: bool) -> DataFrame:
    known = _pairs(items, roster, samples).join(done_bitmaps(rows), ["model", "item_id"], "inner" if done else "left").withColumn("_k", _samples(samples))
    has = "coalesce((try_element_at(done, cast(k div 64 as int)) & shiftleft(cast(1 as bigint), k % 64)) <> 0, false)"
    return known.select("model", "item_id", F.explode(F.expr(f"filter(_k, k -> {'' if done else 'not '}{has})")).alias("sample_k"))


def pending_cells(items: DataFrame, roster: DataFrame, samples: int, rows: DataFrame) -> DataFrame:
    """Cells of the grid without a row: pairs meet bitmaps of their samples, and only what is pending is ever exploded."""
    return _marked(items, roster, samples, rows, done=False)


def completed_cells(items: DataFrame, roster: DataFrame, samples: int, rows: DataFrame) -> DataFrame:
    return _marked(items, roster, samples, rows, done=True)


def pending(grid: DataFrame, rows: DataFrame) -> DataFrame:
    return grid.join(rows.select(*CELL), CELL, "left_anti")


def completed(grid: DataFrame, rows: DataFrame) -> DataFrame:
    return grid.join(rows.select(*CELL), CELL, "left_semi")


def budget_split(cells: DataFrame, order: list[str], budget: int) -> DataFrame:
    """Cells with ``run``: the first ``budget`` in sweep order.

    Cells are numbered by prefix counts, so a budget of any size is spread over all tasks.
    """
    if budget < 1:
        raise RunError("the budget must be at least 1")
    return numbered(cells, order, "_number").withColumn("run", F.col("_number") < budget).drop("_number")


def waves(cells: DataFrame, order: list[str], pool: int) -> DataFrame:
    """Wave numbers of cells run ``pool`` at a time, model by model."""
    return numbered_by(cells, ["model"], order, "_number").withColumn("wave", F.floor(F.col("_number") / F.lit(pool)).cast("int")).drop("_number")


def with_gold(rows: DataFrame, items: DataFrame) -> DataFrame:
    return rows.join(items.select("item_id", "expected"), "item_id")


def orphans(rows: DataFrame, items: DataFrame) -> DataFrame:
    """Rows whose item is not in the suite; a run with any is refused."""
    return rows.join(items.select("item_id"), "item_id", "left_anti")


def check_no_orphans(rows: DataFrame, items: DataFrame) -> None:
    found = orphans(rows, items).select("item_id").take(3)
    if found:
        raise RunError(f"rows name items outside the suite: {[r[0] for r in found]}")


def build_rows(calls: DataFrame, parsed: Column, score: Column, scorer: str) -> DataFrame:
    """Rows of classified calls(state, response_raw, reason): errors are unscored, no response scores 0."""
    ok, silent = F.col("state") == "success", F.col("state") == "no_response"
    return calls.select(
        "*",
        F.when(ok, parsed).alias("parsed"),
        F.when(silent, 0.0).when(ok, score).alias("score"),
        F.when(silent, NO_RESPONSE).when(ok, scorer).alias("scorer"),
        F.when(~ok & ~silent, F.col("reason")).alias("error"),
    )


def rescore(rows: DataFrame, parsed: Column, score: Column, scorer: str) -> DataFrame:
    """Rows scored anew; errors and no-response rows keep what they have."""
    fixed = F.col("error").isNotNull() | F.coalesce(F.col("scorer") == NO_RESPONSE, F.lit(False))
    return rows.withColumns(
        {
            "parsed": F.when(fixed, F.col("parsed")).otherwise(parsed),
            "score": F.when(fixed, F.col("score")).otherwise(score),
            "scorer": F.when(fixed, F.col("scorer")).otherwise(F.lit(scorer)),
        }
    )
