"""What earlier harvests have accepted: a bucketed index of contents that later harvests are held against.

The index is a Parquet table in a folder, in ``BUCKETS`` buckets by the hash of
the content and sorted within each, so it is never shuffled.  A harvest is cut
down first: copies are combined before they are shuffled, so a content that a
third of all rows share is one row a task, and only the columns that are asked
for travel, not the content.  What is left goes into the buckets of the index.

Harvests are the commits of a log (``sources.versions``): one that another
harvest has overtaken looks at what that one has accepted and tries again, so a
content is accepted once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.sources import versions
from gaugeworks.sources.tables import written

BUCKETS = 64
INDEX = "content string, harvest string"


def _hash(key: list[str]):
    """One value for one content; nulls and field borders count."""
    return F.sha2(F.to_json(F.struct(*key), {"ignoreNullFields": "false"}), 256)


class Accepted:
    """The index below ``folder``, with ``buckets`` as they were when it was made."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS) -> None:
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    def _bucketed(self, part: str) -> str:
        """The name of a bucketed table of this session over one part, made if there is none."""
        name = f"accepted_{part.partition('=')[2]}"
        if not self.spark.catalog.tableExists(name):
            path = f"{self.folder}/parts/{part}".replace("'", "\\'")
            self.spark.sql(f"create table {name} ({INDEX}) using parquet clustered by (content) sorted by (content) into {self.buckets} buckets location '{path}'")
        return name

    def forget(self) -> None:
        """Drop the names that this session has given to parts of the index; the index itself stays."""
        for part in versions.names(self.spark, f"{self.folder}/parts"):
            self.spark.sql(f"drop table if exists accepted_{part.partition('=')[2]}")

    def contents(self) -> DataFrame:
        """(content, harvest) of all that has been accepted."""
        return self._of(versions.current(self.spark, self.folder).parts)

    def _of(self, parts: tuple[str, ...]) -> DataFrame:
        out = self.spark.createDataFrame([], INDEX)
        for part in parts:
            out = out.unionByName(self.spark.table(self._bucketed(part)))
        return out

    def accept(self, candidates: DataFrame, key: list[str], order: list[str], harvest: str, give: list[str] | None = None) -> DataFrame:
        """The first candidate of each content that no harvest has accepted yet, now accepted by this one.

        ``order`` must break all ties.  Rows have the columns ``give``, or all;
        their types must have an order.  Null fields are equal to each other
        only.  A harvest that is run again gives none of its rows anew.
        """
        give = give or candidates.columns
        row = F.struct(*(F.col(c).alias(f"order{i}") for i, c in enumerate(order)), *(F.col(c).alias(f"give{i}") for i, c in enumerate(give)))
        first = candidates.select(_hash(key).alias("_content"), row.alias("_row")).groupBy("_content").agg(F.min("_row").alias("_row"))
        fresh = first.select("_content", *(F.col(f"_row.give{i}").alias(c) for i, c in enumerate(give))).repartition(self.buckets, "_content")
        known = ()
        while True:
            now = versions.current(self.spark, self.folder)
            for part in now.parts:
                if part not in known:  # bucket by bucket: no shuffle of either side
                    fresh = fresh.join(self.spark.table(self._bucketed(part)), F.col("_content") == F.col("content"), "left_anti")
            known = now.parts
            fresh = written(fresh)
            part = f"part={uuid.uuid4().hex}"
            name = self._bucketed(part)
            fresh.select(F.col("_content").alias("content"), F.lit(harvest).alias("harvest")).write.insertInto(name)
            try:
                versions.commit(self.spark, self.folder, now, part)
            except versions.Conflict:
                self.spark.sql(f"drop table {name}")
                continue
            return fresh.drop("_content")
