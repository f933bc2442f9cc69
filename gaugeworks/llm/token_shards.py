"""Operator 6, token-ID / binary output: training-order materialisation.

Documents become token IDs and an end mark, cut into sequences of ``LENGTH``
IDs; a last one is filled with the end mark.  Sequences are numbered densely
in (doc_id, text) order, and a keyed Feistel permutation with cycle walking
gives each its slot in training order.  A shard is a range of slots, each of
``LENGTH`` little-endian 16-bit IDs, so a slot's place is arithmetic:
shard = slot // per_shard, byte = slot % per_shard * stride.  A reader goes
through shards in order and can resume at any slot; the inverse permutation
names the sequence that a slot holds.

One pass tokenises the texts in range partitions of (doc_id, text) order and
keeps the packed sequences; with the counts of its partitions every sequence
has its number, and so its slot.  The sequences then go to range partitions of
slots, dealt by arithmetic without sampling, a whole number of shards each.
``write_shards`` writes one file a shard and an index of what each slot holds;
``ShardReader`` reads from any slot on.  The query returns what
``read_back`` finds in those files: tasks seek to the bytes that the index
names, so nothing is shuffled again.

Null and empty texts give one sequence of end marks with n_tokens 1 (the end
mark).  Equal rows take neighbouring numbers, each its own sequences.  A null
doc_id sorts first.  Extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
import uuid
from array import array
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.feistel import Feistel
from gaugeworks.llm.spark_tools import documents, own_path, release, stored, tidied, writing

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the splitting pattern of the vocabulary in its possessive form, which parts every text as the plain one does but without backtracking.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
END, LENGTH, PER_SHARD, KEY = 50256, 512, 8192, 424242


#: A vocabulary travels to the executors; larger files are refused.
MOST_BYTES = 64 << 20


def vocabulary_file(path: str) -> bytes:
    """The file on the driver."""
    if (size := Path(path).stat().st_size) > MOST_BYTES:
        raise ValueError(f"{path} has {size} bytes, over {MOST_BYTES}")
    return Path(path).read_bytes()


@lru_cache(maxsize=4)
def encoding(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def tokenizer(path: str):
    return encoding(vocabulary_file(path))


def n_sequences(n_tokens: int, length: int) -> int:
    return -(-(n_tokens + 1) // length)


def pack(ids: list[int], length: int) -> list[bytes]:
    """Sequences of 16-bit IDs, the end mark after the text and as filling."""
    row = array("H", ids)
    row.extend([END] * (n_sequences(len(ids), length) * length - len(ids)))
    if sys.byteorder == "big":
        row.byteswap()
    raw, stride = row.tobytes(), 2 * length
    return [raw[at : at + stride] for at in range(0, len(raw), stride)]


#: Bytes of sequences that a task remembers, so that copies of a text are tokenised once.
REMEMBERED = 16 << 20
#: Bytes of sequences that a range partition is to hold, about, and the most partitions; one shard at least each.
PARTITION, MOST_RANGES = 16 << 20, 100_000

#: What the index of written shards says of each sequence.
INDEX = ["slot", "shard", "byte_offset", "doc_id", "part", "n_tokens"]
INDEXED = "slot long, shard int, byte_offset long, doc_id long, part int, n_tokens int, sha256 string"
PACKED = "at long, doc_id long, part int, n_tokens int, tokens binary"


def _packed(rows: DataFrame, length: int, vocabulary: str) -> DataFrame:
    """Sequences of rows(doc_id, text) with ``at``, their place among those of a task."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary_file(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, at = encoding(shared.value).encode_ordinary, 0
        known: dict[str, tuple[int, list[bytes]]] = {}
        held = 0
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                batch = whole.slice(k, 500)
                doc, part, size, blobs = [], [], [], []
                for doc_id, item in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                    text = item.as_py()
                    found = known.get(text)
                    if found is None:
                        ids = encode(text)
                        found = len(ids), pack(ids, length)
                        held += len(text) + 2 * length * len(found[1])
                        if held > REMEMBERED:
                            known.clear()
                            held = 0
                        known[text] = found
                    n, packed = found
                    doc += [doc_id] * len(packed)
                    part += range(len(packed))
                    size += [length] * (len(packed) - 1) + [n + 1 - (len(packed) - 1) * length]
                    blobs += packed
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(at, at + len(blobs)), pa.int64()), pa.array(doc, pa.int64()), pa.array(part, pa.int32()), pa.array(size, pa.int32()), pa.array(blobs, pa.binary())],
                    names=["at", "doc_id", "part", "n_tokens", "tokens"],
                )
                at += len(blobs)

    return rows.mapInArrow(tidied(run), PACKED)


def materialise(docs: DataFrame, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY, vocabulary: str = VOCABULARY) -> DataFrame:
    """(slot, shard, byte_offset, doc_id, part, n_tokens, tokens): every sequence, in partitions of whole shards, sorted by slot."""
    return _placed(docs, length, per_shard, key, vocabulary)[0]


def _placed(docs: DataFrame, length: int, per_shard: int, key: int, vocabulary: str) -> tuple[DataFrame, DataFrame, int]:
    """(what ``materialise`` gives, the stored sequences it is made from, the number of shards)."""
    spark = docs.sparkSession
    order = ["doc_id", "tie", "row"]  # the place in the input spreads equal rows over partitions
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    packed = stored(_packed(rows, length, vocabulary).withColumn("task", F.spark_partition_id()), "zstd")
    total, before = 0, []
    for task, n in sorted(tuple(r) for r in packed.groupBy("task").agg(F.count("*")).collect()):
        before.append((task, total))
        total += n
    offsets = F.broadcast(spark.createDataFrame(before, "task int, before long"))  # one row a partition

    @F.pandas_udf("long")
    def slot_of(number: pd.Series) -> pd.Series:
        return pd.Series(Feistel(total, key).permute(number.to_numpy()))

    shards = -(-total // per_shard)
    ranges = max(1, min(shards, MOST_RANGES, max(spark.sparkContext.defaultParallelism, total * 2 * length // PARTITION)))
    placed = packed.join(offsets, "task").withColumn("slot", slot_of(F.col("before") + F.col("at")))
    placed = placed.withColumn("shard", F.expr(f"cast(slot div {per_shard} as int)")).withColumn("byte_offset", F.col("slot") % per_shard * (2 * length))
    dealt = placed.repartitionById(ranges, F.expr(f"cast(shard * {ranges}L div {max(1, shards)} as int)")).sortWithinPartitions("slot")
    return dealt.select(*INDEX, "tokens"), packed, shards


def _store(folder: str):
    """(file system, path) of an address as Spark writes it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"\Afile:/(?!/)", "file:///", folder))


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


#: Turns in which shards are written: the shuffle files of one are gone before the next begins.
TURNS = 4


def write_shards(sequences: DataFrame, folder: str, length: int = LENGTH, per_shard: int = PER_SHARD, shards: int = 1) -> DataFrame:
    """Write one file a shard to an absolute path or address; gives (shard, first_slot, n_sequences, sha256).

    ``sequences`` are as ``materialise`` gives them.  A file is written beside
    its place and then moved there, so a task that runs again does no harm and
    a reader never sees half a shard.  ``index`` in the folder keeps what every
    slot holds and the digest of its shard; it is there once all shards are.
    Of ``shards`` in all, a quarter is written at a time.
    """
    stride = 2 * length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        store.create_dir(root, recursive=True)

        def write(shard: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            data = b"".join(x.as_buffer() for x in whole["tokens"])
            beside = f"{root}/.{shard_name(shard)}-{uuid.uuid4().hex}"
            with store.open_output_stream(beside) as out:
                out.write(data)
            store.move(beside, f"{root}/{shard_name(shard)}")
            index = whole.drop_columns(["tokens"]).append_column("sha256", pa.array([hashlib.sha256(data).hexdigest()] * len(whole)))
            return index.to_batches()[0]

        now, held, n = None, [], 0
        for batch in batches:
            slot, size = batch.column("slot").to_numpy(), pa.compute.binary_length(batch.column("tokens")).to_numpy()
            shards = slot // per_shard
            cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1), len(slot)] if len(slot) else []
            for a, b in zip(cuts[:-1], cuts[1:]):
                if shards[a] != now:
                    if held:
                        yield write(now, held)
                    now, held, n = int(shards[a]), [], 0
                if (slot[a:b] != now * per_shard + n + np.arange(b - a)).any() or (size[a:b] != stride).any():
                    raise ValueError(f"shard {now} has gaps: sequences are not sorted or of another length")
                held.append(batch.slice(a, b - a))
                n += b - a
        if held:
            yield write(now, held)

    spark = sequences.sparkSession
    turns = max(1, min(TURNS, shards))
    for k in range(turns):
        some = sequences if turns == 1 else sequences.where(F.col("shard").between(shards * k // turns, shards * (k + 1) // turns - 1))
        with writing(spark):
            some.select(*INDEX, "tokens").mapInArrow(tidied(run), INDEXED).write.mode("overwrite").parquet(f"{folder}/index/turn={k}")
    index = spark.read.schema(INDEXED).parquet(f"{folder}/index")
    return index.groupBy("shard").agg(F.min("slot").alias("first_slot"), F.count("*").alias("n_sequences"), F.first("sha256").alias("sha256"))


def read_back(spark: SparkSession, folder: str, length: int = LENGTH) -> DataFrame:
    """What ``materialise`` gave, from the files that ``write_shards`` made of it: each task reads the bytes that its rows of the index name."""
    stride = 2 * length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        open_, file = None, None
        for batch in batches:
            slot, shard, at = (batch.column(c).to_numpy() for c in ("slot", "shard", "byte_offset"))
            cuts = [0, *(np.flatnonzero((np.diff(slot) != 1) | (np.diff(shard) != 0)) + 1), len(slot)] if len(slot) else []
            blobs = []
            for a, b in zip(cuts[:-1], cuts[1:]):  # neighbours in a shard are read at once
                if shard[a] != open_:
                    if file:
                        file.close()
                    open_, file = shard[a], store.open_input_file(f"{root}/{shard_name(int(shard[a]))}")
                file.seek(int(at[a]))
                raw = file.read((b - a) * stride)
                if len(raw) != (b - a) * stride:
                    raise ValueError(f"shard {open_} ends before slot {slot[b - 1]}")
                blobs += [raw[k : k + stride] for k in range(0, len(raw), stride)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(blobs, pa.binary())], names=[*batch.schema.names, "tokens"])
        if file:
            file.close()

    index = spark.read.schema(INDEXED).parquet(f"{folder}/index").select(*INDEX)
    return index.mapInArrow(tidied(run), INDEXED.replace("sha256 string", "tokens binary"))


class ShardReader:
    """Reads sequences in training order from any slot on, one seek and then straight through."""

    def __init__(self, folder: str, length: int = LENGTH, per_shard: int = PER_SHARD):
        self.store, self.root = _store(folder)
        self.stride, self.per_shard = 2 * length, per_shard

    def read(self, slot: int = 0) -> Iterator[tuple[int, np.ndarray]]:
        """(slot, IDs) from ``slot`` to the last one."""
        from pyarrow import fs

        while True:
            path = f"{self.root}/{shard_name(slot // self.per_shard)}"
            if self.store.get_file_info(path).type == fs.FileType.NotFound:
                return
            with self.store.open_input_file(path) as file:
                file.seek(slot % self.per_shard * self.stride)
                while raw := file.read(self.stride):
                    yield slot, np.frombuffer(raw, dtype="<u2")
                    slot += 1
            if slot % self.per_shard:
                return


def stage(docs: DataFrame) -> DataFrame:
    """Write all shards below the shared folder; gives every sequence as it is read back from them."""
    spark, folder = docs.sparkSession, own_path(docs.sparkSession)
    sequences, packed, shards = _placed(docs, LENGTH, PER_SHARD, KEY, VOCABULARY)
    write_shards(sequences, folder, shards=shards)
    release(packed)
    return read_back(spark, folder)


def op6_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(documents(spark, sf_dir))
