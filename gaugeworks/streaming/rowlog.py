"""Extension: live views of a growing row log.

``running_report`` is a plain streaming aggregate.  ``follow`` keeps a report
that equals the batch report of the distinct cells, whatever arrives twice and
whatever fails on the way:

* Cells are told apart by a stateful dedup.  Its time is that of arrival, so no
  row is ever too late to count; a repeat is known for ``remember`` after the
  first one, and state is dropped after that.
* Each batch is reduced to one row of sums per (model, item) and written under
  its own number.  A batch that runs again after a failure replaces its own
  rows and nothing else, so each counts once.
* ``live_report`` adds up the batches that are whole.  Every ``FOLD`` batches
  become one, so neither reading nor listing grows with the age of a stream.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gaugeworks.operators.reports import score
from gaugeworks.schemas import CELL, NO_RESPONSE, PARSE_FAIL, ROW
from gaugeworks.sources.tables import remove
from gaugeworks.sources.versions import names

SUMS = "model string, item_id string, n_cells long, n_scored long, score_sum double, n_no_response long, n_parse_fail long, n_error long"
#: Batches that are added up to one; how long a repeated cell is known.
FOLD, REMEMBER = 100, "7 days"


def row_stream(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    return spark.readStream.schema(ROW).options(**options).parquet(folder)


def running_report(stream: DataFrame) -> DataFrame:
    """Counts and score of each model so far; for complete or update mode."""
    return stream.groupBy("model").agg(F.count("*").alias("n_cells"), F.count("score").alias("n_scored"), score().alias("suite_score"), F.count("error").alias("n_error"))


def item_sums(rows: DataFrame) -> DataFrame:
    """Sums of rows by (model, item), which add up over disjoint sets of rows."""
    measures = [
        F.count("*").alias("n_cells"), F.count("score").alias("n_scored"), F.coalesce(F.sum("score"), F.lit(0.0)).alias("score_sum"), F.count_if(F.col("scorer") == NO_RESPONSE).alias("n_no_response"),
        F.count_if(F.col("parsed") == PARSE_FAIL).alias("n_parse_fail"), F.count("error").alias("n_error"),
    ]
    return rows.groupBy("model", "item_id").agg(*measures)


def _added(sums: DataFrame, *by: str) -> DataFrame:
    return sums.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("n_cells", "n_scored", "score_sum", "n_no_response", "n_parse_fail", "n_error")), F.count_distinct("item_id").alias("n_items"))


def report_of_sums(sums: DataFrame) -> DataFrame:
    """The columns of the batch report, from sums by (model, item) in any number of parts."""
    mean = F.round(F.lit(100.0) * F.col("score_sum") / F.nullif("n_scored", F.lit(0)), 6)
    return _added(sums, "model").select("model", "n_cells", "n_scored", "n_items", mean.alias("suite_score"), "n_no_response", "n_parse_fail", "n_error")


def _whole(spark: SparkSession, folder: str) -> list[tuple[int, int]]:
    """(first, last) of the ranges of batches that stand for all: a fold makes those within it void."""
    ranges = [tuple(map(int, x[8:].split("-"))) for x in names(spark, folder) if x.startswith("batches_") and "_SUCCESS" in names(spark, f"{folder}/{x}")]
    out: list[tuple[int, int]] = []
    for first, last in sorted(ranges, key=lambda r: (r[0], -r[1])):
        if not out or first > out[-1][1]:
            out.append((first, last))
    return out


def _path(folder: str, first: int, last: int) -> str:
    return f"{folder}/batches_{first:012d}-{last:012d}"


def _read(spark: SparkSession, folder: str, ranges: list[tuple[int, int]]) -> DataFrame:
    return spark.read.schema(SUMS).parquet(*(_path(folder, *r) for r in ranges)) if ranges else spark.createDataFrame([], SUMS)


def _merge(folder: str, fold: int) -> Callable[[DataFrame, int], None]:
    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        item_sums(batch).write.mode("overwrite").parquet(_path(folder, number, number))
        ended = [(a, b) for a, b in _whole(spark, folder) if a == b and b < number]
        if len(ended) >= fold:  # not the newest, which may run again
            first, last = ended[0][0], ended[-1][1]
            old = [r for r in _whole(spark, folder) if r[1] <= last]
            _added(_read(spark, folder, old), "model", "item_id").drop("n_items").write.mode("overwrite").parquet(_path(folder, min(a for a, _ in old), last))
            # ranges that the fold before this one made void; those of this one may still be read
            for x in names(spark, folder):
                a, b = map(int, x[8:].split("-")) if x.startswith("batches_") else (0, number)
                if b < first and (a, b) not in old:
                    remove(spark, _path(folder, a, b))

    return merge


def follow(stream: DataFrame, folder: str, checkpoint: str, remember: str = REMEMBER, fold: int = FOLD, **trigger) -> StreamingQuery:
    """Keep the sums of ``stream`` (ROW) below ``folder``; ``trigger`` is as for ``writeStream``."""
    arrived = stream.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", remember)
    cells = arrived.dropDuplicatesWithinWatermark(["run_id", *CELL]).drop("_arrived")
    writer = cells.writeStream.foreachBatch(_merge(folder, fold)).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def live_report(spark: SparkSession, folder: str) -> DataFrame:
    """The report of all that ``follow`` has counted so far."""
    return report_of_sums(_read(spark, folder, _whole(spark, folder)))
