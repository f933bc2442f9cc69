"""Operator 1, sharding: a reproducible global shuffle with computable shard and slot.

Rows get dense numbers in a fixed order; a keyed Feistel permutation with
cycle walking maps number r to place p; ``shard = p % n_shards`` and
``slot = p // n_shards``.  So shard sizes differ by one row at most, slots
have no gaps, and both directions are arithmetic: no shuffle by shard is
needed to know where a row goes or which row a place holds.

Nulls: a null text has size 1 and CRC 0, as an empty one; a null key sorts
first.  Equal rows take neighbouring numbers and are interchangeable.  An
empty table gives an empty result.  Extra input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.feistel import Feistel
from gaugeworks.llm.spark_tools import documents, number_rows, stored

N_SHARDS, KEY = 8, 20240607


def place(numbered: DataFrame, n_rows: int, n_shards: int, key: int, number: str = "row_number") -> DataFrame:
    """Add ``shard`` and ``slot`` to rows that carry dense numbers below ``n_rows``."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = Feistel(n_rows, key)
        for batch in batches:
            spot = order.permute(batch.column(number).to_numpy())
            columns = [pa.array(spot % n_shards, pa.int32()), pa.array(spot // n_shards)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "shard", "slot"])

    schema = numbered.select("*", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot")).schema
    return numbered.mapInArrow(placed, schema)


def row_at(shard: int, slot: int, n_rows: int, n_shards: int, key: int) -> int:
    """The row number that a place holds."""
    return int(Feistel(n_rows, key).inverse([slot * n_shards + shard])[0])


def shard(df: DataFrame, order: list[str], n_shards: int = N_SHARDS, key: int = KEY) -> DataFrame:
    """``df`` with row_number, shard and slot; rows are numbered in the order of ``order``."""
    numbered, n_rows = number_rows(df, order)
    return place(numbered, n_rows, n_shards, key)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    small = documents(spark, sf_dir).select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"), F.xxhash64("text").alias("tie")
    )
    placed = shard(stored(small), ["doc_id", "tie"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
