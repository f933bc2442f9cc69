"""Shared Spark plumbing of the operators: written tables, hot keys, numbering, components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import itertools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only in local mode where none is configured, as in tests."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not hasattr(shared_dir, "own"):
        shared_dir.own = tempfile.mkdtemp(prefix="gaugeworks-")
    return f"file://{shared_dir.own}"


_written: dict[str, SparkSession] = {}
#: Written tables so far; after every fourth the driver's memory is settled.
_tables = itertools.count(1)


def _delete(path: str) -> None:
    spark = _written.pop(path)
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is gone: the folder is the cluster's to clear
        return


def _clean() -> None:
    for path in list(_written):
        _delete(path)


atexit.register(_clean)


#: Settings while a table is written: shuffle files go with the query, and workers get 1,000 texts at a time.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def own_path(spark: SparkSession) -> str:
    """A new path below the shared folder; what is written there goes when the driver ends."""
    path = f"{shared_dir(spark)}/gaugeworks/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    _written[path] = spark
    return path


@contextlib.contextmanager
def writing(spark: SparkSession) -> Iterator[None]:
    """The settings of ``WRITING`` for a while, but for those that the session has of its own."""
    ours = {k: v for k, v in WRITING.items() if spark.conf.get(k, None) is None}
    try:
        for k, v in ours.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k in ours:
            spark.conf.unset(k)


def stored(df: DataFrame, codec: str = "snappy", free: tuple[DataFrame, ...] = ()) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet below the shared folder and read it back.

    The table survives lost executors, is computed once however often it is
    read, and goes when the driver ends; Spark removes the shuffle files of the
    write when it ends.  ``free`` names stored tables whose last reader this
    is; they go at once.  Settings that the session has of its own stay.
    """
    spark, path = df.sparkSession, own_path(df.sparkSession)
    with writing(spark):
        df.write.option("compression", codec).parquet(path)
    release(*free)
    if next(_tables) % 4 == 0:
        settle(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def settle(spark: SparkSession) -> None:
    """Collect the driver's garbage in a long chain of queries, before its heap grows: their plans, generated classes and broadcasts."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    _trim()


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def release(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for table in tables:
        path = getattr(table, "_stored_path", None)
        if path in _written:
            _delete(path)


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hot_join(rows: DataFrame, table: DataFrame, key: str, counts: DataFrame, hot: int = 256, salts: int = 64) -> DataFrame:
    """Left join of ``rows`` to ``table`` (unique in ``key``), safe for hot keys.

    ``counts`` has (key, cnt): rows by key.  At most ``hot`` keys can hold a
    share of over 1 / hot of all rows.  Their rows are dealt over ``salts`` by
    a hash of the row and their entries in ``table`` repeated for each salt;
    every other key keeps its one place.
    """
    total = counts.agg(F.sum("cnt")).first()[0] or 0
    heavy = [r[0] for r in counts.where((F.col("cnt") * hot > total) & F.col(key).isNotNull()).select(key).collect()]
    if not heavy:
        return rows.join(table, key, "left")
    is_hot = F.coalesce(F.col(key).isin(heavy), F.lit(False))
    dealt = rows.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int")).otherwise(0))
    spread = table.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(spread, [key, "_salt"], "left").drop("_salt")


def number_rows(df: DataFrame, order: list[str], name: str = "row_number") -> tuple[DataFrame, int]:
    """Add dense global row numbers from 0 in the order of ``order``; also gives the total.

    Range partitions are sorted and written once; the number of a row is its
    place in its partition plus the rows of the partitions before it.  Rows that are equal in ``order`` are told apart by where they stand in the
    input, so that many of them are spread over partitions too.
    Only one count per partition reaches the driver.
    """
    spark = df.sparkSession
    spread = df.withColumn("_row", F.monotonically_increasing_id())
    spread = spread.repartitionByRange(*order, "_row").sortWithinPartitions(*order, "_row").drop("_row")
    kept = stored(spread.withColumn("_at", F.monotonically_increasing_id())).withColumn("_p", F.shiftright("_at", 33))
    total, before = 0, []
    for p, n in sorted(tuple(r) for r in kept.groupBy("_p").agg(F.count("*")).collect()):
        before.append((p, total))
        total += n
    offsets = spark.createDataFrame(before, "_p long, _before long")
    numbered = kept.join(F.broadcast(offsets), "_p")
    return numbered.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_p", "_before", "_at"), total


Work = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidied(work: Work) -> Work:
    """``work`` on the batches of a task, after which the worker gives its free memory back: Spark keeps workers for later tasks."""

    @wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            _trim()

    return run


def by_group(df: DataFrame, key: str, work: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Run ``work`` on runs of whole groups of a long, non-null key.

    ``work`` gets a table sorted by key and the row bounds of its groups, so
    small groups are handled many at a time instead of one Python call each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(table: pa.Table) -> Iterator[pa.RecordBatch]:
            if table.num_rows:
                keys = table.column(key).to_numpy()
                bounds = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
                yield from work(table.combine_chunks(), bounds)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(batch.schema.get_field_index(key)).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1], side="left"))
            if held and (cut or held[-1].column(batch.schema.get_field_index(key))[-1].as_py() != keys[-1]):
                yield from flush(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            elif cut:
                yield from flush(pa.Table.from_batches([batch.slice(0, cut)]))
            held.append(batch.slice(cut))
        if held:
            yield from flush(pa.Table.from_batches(held))

    return df.repartition(key).sortWithinPartitions(key).mapInArrow(tidied(run), schema)


def _roots(batches: Iterator[pa.RecordBatch]) -> dict[int, int]:
    """The least node that the edges of one partition connect each of their nodes to."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while up[root] != root:
            root = up[root]
        while up[x] != root:
            up[x], x = root, up[x]
        return root

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            up.setdefault(u, u)
            up.setdefault(v, v)
            a, b = find(u), find(v)
            if a != b:
                up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def _pairs(nodes: list[int], roots: dict[int, int], names: list[str]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(nodes), 100_000):
        part = nodes[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([roots[x] for x in part], pa.int64())], names=names)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning star forest of the edges of one partition: repeats and cycles go before the shuffle."""
    roots = _roots(batches)
    yield from _pairs([x for x in roots if roots[x] != x], roots, ["u", "v"])


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every node with its root, where one partition has all edges."""
    roots = _roots(batches)
    yield from _pairs(list(roots), roots, ["node", "root"])


def components(edges: DataFrame, hub: int = 20_000) -> DataFrame:
    """(node, root): connected components of (u, v) long edges, root the least node.

    Alternating large-star and small-star steps; every round is two grouped
    minima and two joins, and ends in a written table.  The minima of nodes
    with over ``hub`` edges and over a 256th of all edges are broadcast, so
    that the edges of a hub stay where they are; there can be some hundreds.
    Up to ``hub`` edges, which one task settles at once, need no round.
    """
    now, seen = stored(edges.select("u", "v").mapInArrow(tidied(_forest), "u long, v long")), None
    total = now.count()
    if total > hub:  # forests of several tasks, about ``hub`` edges together, make one
        now = stored(now.coalesce(-(-total // hub)).mapInArrow(tidied(_forest), "u long, v long"), free=(now,))
        total = now.count()
    if total > hub:
        now = stored(now.distinct(), free=(now,))
    while total > hub:
        many = max(hub, total // 128)
        degrees = now.groupBy("v").agg(F.count("*").alias("c"), F.expr("bit_xor(xxhash64(u, v))").alias("x"))
        *state, hubs = degrees.agg(F.sum("c"), F.bit_xor("x"), F.collect_list(F.when(F.col("c") > many, F.col("v")))).first()
        if state == seen:
            settle(now.sparkSession)
            roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
        seen, total, before = state, state[0], now
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_least(both, both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), hubs)
        # dealt by u once: its distinct edges, their minima and the join of both need no other exchange
        large = large.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).repartition("u").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), free=(before,))
    return now.coalesce(1).mapInArrow(tidied(_labels), "node long, root long")


def _to_least(both: DataFrame, least: DataFrame, hubs: list[int]) -> DataFrame:
    """Edges (u, v) with the least neighbour m of u; edges of hubs are not moved."""
    if not hubs:
        return both.join(least, "u")
    is_hub = F.col("u").isin(hubs)
    return both.where(is_hub).join(F.broadcast(least.where(is_hub)), "u").unionByName(both.where(~is_hub).join(least.where(~is_hub), "u"))
