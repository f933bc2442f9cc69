"""Rubric scoring: per-judge medians, item scores, parse statistics and the gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.errors import JudgeParseError
from gaugeworks.functions.text import judge_score
from gaugeworks.schemas import PARSE_FAIL

GATE = 0.5


def parsed_samples(samples: DataFrame) -> DataFrame:
    """samples(judge, item_id, ok, response_raw) with ``value``, null for failures and errors."""
    return samples.withColumn("value", F.when(F.col("ok"), judge_score(F.col("response_raw"))))


def medians(samples: DataFrame) -> DataFrame:
    """(item_id, judge, median) over a judge's parsed samples; even counts average the middle two."""
    return samples.where("value is not null").groupBy("item_id", "judge").agg(F.median("value").alias("median"))


def item_scores(samples: DataFrame) -> DataFrame:
    """A tenth of the mean of the judges' medians, which ``parsed`` tells; without any parsed sample 0 and a parse failure."""
    scored = medians(samples).groupBy("item_id").agg(F.avg("median").alias("m"))
    items = samples.select("item_id").distinct().join(scored, "item_id", "left")
    return items.select("item_id", F.round(F.coalesce(F.col("m") / 10, F.lit(0.0)), 6).alias("score"), F.coalesce(F.col("m").cast("string"), F.lit(PARSE_FAIL)).alias("parsed"))


def parse_stats(samples: DataFrame) -> DataFrame:
    """(judge, fail, attempts); replies that never came count in neither."""
    return samples.groupBy("judge").agg(F.count_if(F.col("ok") & F.col("value").isNull()).alias("fail"), F.count_if("ok").alias("attempts"))


def offenders(stats: DataFrame, gate: float = GATE) -> DataFrame:
    """Judges over the gate (strictly), each for itself."""
    rate = F.col("fail") / F.col("attempts")
    return stats.where(F.col("attempts") > 0).withColumn("rate", F.round(rate, 6)).where(rate > gate)


def check_gate(stats: DataFrame, gate: float = GATE) -> None:
    """Raise before anything is written; the judges are a run's configuration, so few."""
    found = offenders(stats, gate).orderBy(F.desc("rate"), "judge").collect()
    if found:
        raise JudgeParseError("; ".join(f"{r['judge']}: {r['fail']} of {r['attempts']} replies do not parse" for r in found))
