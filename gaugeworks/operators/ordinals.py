"""Row numbers without a window over all rows: distributed prefix counts.

Rows are range partitioned by their order, sorted and written once with their
place; only a count for each partition (and for groups, one for each group that a partition
holds) is summed up.  No task holds more than its range, whatever the
size of a group, and every later read sees the same numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.sources.tables import written

#: A row's number within its partition has the low bits of monotonically_increasing_id.
_PLACE = (1 << 33) - 1
Order = list[str | Column]


def _placed(df: DataFrame, order: Order) -> DataFrame:
    """``df`` in order, with _part and _place; rows equal in ``order`` are told apart by where they stand in the input."""
    rows = df.withColumn("_row", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*order, F.col("_row")).sortWithinPartitions(*order, F.col("_row")).drop("_row")
    at = F.monotonically_increasing_id()
    kept = written(rows.withColumn("_at", at))
    return kept.withColumns({"_part": F.shiftright("_at", 33).cast("int"), "_place": F.col("_at").bitwiseAND(_PLACE)}).drop("_at")


def numbered(df: DataFrame, order: Order, name: str = "ordinal") -> DataFrame:
    """``df`` with its row number from 0 in ``order``."""
    kept = _placed(df, order)
    before, total = [], 0
    for part, n in sorted(map(tuple, kept.groupBy("_part").agg(F.count("*")).collect())):  # a row a partition
        before.append((part, total))
        total += n
    starts = df.sparkSession.createDataFrame(before, "_part int, _before long")
    return kept.join(F.broadcast(starts), "_part").withColumn(name, F.col("_before") + F.col("_place")).drop("_part", "_place", "_before")


def numbered_by(df: DataFrame, group: list[str], order: Order, name: str = "ordinal") -> DataFrame:
    """``df`` with its row number from 0 in ``order`` within each ``group``; nulls are a group.

    A group may span partitions: its rows in earlier ones are summed up by
    group over one row for each partition that has some.
    """
    kept = _placed(df, [*group, *order])
    runs = kept.groupBy("_part", *group).agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*(F.col(c).alias(f"_by_{c}") for c in group), F.col("_part").alias("_of"), "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    same = F.col("_part") == F.col("_of")
    for c in group:
        same = same & kept[c].eqNullSafe(F.col(f"_by_{c}"))
    found = kept.join(runs, same).withColumn(name, F.col("_before") + F.col("_place") - F.col("_first"))
    return found.drop("_part", "_place", "_of", "_first", "_before", *(f"_by_{c}" for c in group))
