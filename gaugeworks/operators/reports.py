"""Roll-ups of runs: model reports, totals, gates, comparison, leaderboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.errors import ReportError
from gaugeworks.schemas import NO_RESPONSE, PARSE_FAIL



def score() -> Column:
    """100 times the mean of the scored rows."""
    return F.lit(100.0) * F.avg("score")


def measures() -> list[Column]:
    return [
        F.count("*").alias("n_cells"),
        F.count("score").alias("n_scored"),
        F.count_distinct("item_id").alias("n_items"),
        F.round(score(), 6).alias("suite_score"),
        F.count_if(F.col("scorer") == NO_RESPONSE).alias("n_no_response"),
        F.count_if(F.col("parsed") == PARSE_FAIL).alias("n_parse_fail"),
        F.count("error").alias("n_error"),
    ]


def suite_score(rows: DataFrame) -> DataFrame:
    return rows.agg(F.round(score(), 6).alias("suite_score"))


def model_report(rows: DataFrame) -> DataFrame:
    """One row per model; error rows count as cells and items, not as scores."""
    return rows.groupBy("model").agg(*measures())


def run_totals(report: DataFrame) -> DataFrame:
    names = ("n_cells", "n_scored", "n_no_response", "n_parse_fail", "n_error")
    return report.agg(F.count("*").alias("n_models"), *(F.sum(n).alias(n) for n in names))


def roster_report(report: DataFrame, roster: DataFrame) -> DataFrame:
    """Models of the roster in its order, with or without rows; others after them by name."""
    joined = roster.select("model", "ordinal").join(report, "model", "full_outer")
    zeros = {n: F.coalesce(n, F.lit(0)) for n in ("n_cells", "n_scored", "n_items", "n_no_response", "n_parse_fail", "n_error")}
    return joined.withColumns(zeros).withColumn("listed", F.col("ordinal").isNotNull())


def score_summary(rows: DataFrame) -> DataFrame:
    silent = F.coalesce(F.col("scorer") == NO_RESPONSE, F.lit(False))
    return rows.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("score").isNotNull() & F.col("error").isNull() & ~silent).alias("scored"),
        F.count_if(silent).alias("no_response"),
    )


def smoke_gate(report: DataFrame) -> DataFrame:
    """Models that fail: any error, no response or parse failure, or nothing scored."""
    reasons = [("error", F.col("n_error") > 0), ("no_response", F.col("n_no_response") > 0), ("parse_fail", F.col("n_parse_fail") > 0), ("unscored", F.col("n_scored") == 0)]
    out = report.select("model", F.array_join(F.array_compact(F.array(*(F.when(c, n) for n, c in reasons))), ",").alias("reasons"))
    return out.withColumn("passed", F.col("reasons") == "")


def parse_fail_rate(rows: DataFrame) -> DataFrame:
    judged = rows.where("scorer = 'verdict'")
    return judged.groupBy("model").agg(F.round(F.avg((F.coalesce(F.col("parsed"), F.lit("")) == PARSE_FAIL).cast("double")), 6).alias("parse_fail_rate"))


def compare_runs(rows: DataFrame, run_ids: list[str]) -> DataFrame:
    """Models against runs: score cells, null where a model has no score or no rows, with presence flags."""
    cells = rows.where(F.col("run_id").isin(run_ids)).groupBy("model").pivot("run_id", run_ids)
    wide = cells.agg(F.round(score(), 6).alias("score"), F.count(F.lit(1)).alias("n"))
    return wide.select("model", *(F.col(f"{r}_score").alias(r) for r in run_ids), *((F.coalesce(F.col(f"{r}_n"), F.lit(0)) > 0).alias(f"has_{r}") for r in run_ids))


def hash_mismatches(runs: DataFrame) -> DataFrame:
    """Models whose runs do not share one instrument."""
    return runs.groupBy("model").agg(F.count_distinct("suite_hash").alias("n_hashes")).where("n_hashes > 1")


def check_same_instrument(manifests: DataFrame) -> None:
    hashes = [r[0] for r in manifests.select("suite_hash").distinct().take(2)]
    if len(hashes) > 1:
        raise ReportError(f"runs of different instruments cannot be compared: {sorted(hashes)}")


def latest_runs(runs: DataFrame, keys: list[str] = ["suite_hash", "model"]) -> DataFrame:
    at = Window.partitionBy(*keys).orderBy(F.desc("started"), F.desc("run_id"))
    return runs.withColumn("_n", F.row_number().over(at)).where("_n = 1").drop("_n")


def leaderboard(scores: DataFrame) -> DataFrame:
    """Dense ranks by score among runs of one instrument and fingerprint."""
    group = Window.partitionBy("suite_hash", "fingerprint").orderBy(F.desc("score"))
    return scores.withColumn("rank", F.dense_rank().over(group))


def confusion_matrix(rows: DataFrame) -> DataFrame:
    return rows.groupBy("parsed", "expected").agg(F.count("*").alias("n"))


def latest_names(rows: DataFrame) -> DataFrame:
    """Union of the models of several runs, by name."""
    return rows.select("model").distinct().orderBy("model")
