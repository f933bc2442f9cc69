"""From raw documents to token shards: five stages, each written as Parquet and read again.

Every stage works on all rows that its predecessor kept.  All but the last
return the columns of documents, extra ones included, whatever their names; the
last returns the sequences of the token shards.  SQL cannot express a trained
classifier or a BPE tokeniser, so there is no ORACLE_SQL; tests hold the stages
against brute force.

Null and empty texts pass the first three stages (they hold nothing toxic, link
with nothing and match no item) and end in mixing, which takes words only.  A
null doc_id is a value like any other and stands last within a near-duplicate
group, first in training order.  Of rows that repeat doc_id and text one stays;
of ties in a group, the least doc_id and then the least hash of the text.
Without usable labels the first stage keeps all; without benchmark items the
third does; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gaugeworks.llm import decontaminate, mixing, near_dedup, token_shards, toxicity
from gaugeworks.llm.spark_tools import documents, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that the classifier flags go."""
    return toxicity.stage(docs, documents(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: one document of each group of near copies stays."""
    return near_dedup.stage(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that hold a benchmark item go."""
    return decontaminate.stage(docs, documents(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: each document as often as the mix takes it."""
    return mixing.stage(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: token sequences in training order."""
    return token_shards.materialise(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_shards", write_tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), free=(docs,))
    return STAGES[-1][1](spark, docs, sf_dir)
