"""Operator 11, conversation prefix trie by LCP-aware external mergesort.

A conversation is its turns in order; a turn is known by the 128-bit digest of
its role and text and by the UTF-8 bytes of its text, so texts never travel.

1. Equal conversations become one sequence with its number of members, the
   least member and the SHA-256 of all members' ids; the ids pass through as a
   sorted stream, so a group of copies is never held.
2. Sorted runs: each map task sorts its sequences, ``RUN_TURNS`` turns at a time, and gives
   every sequence the length of the longest common prefix (LCP, in turns) with
   the one before it in its run.
3. Sequences, no two of them equal, are range partitioned into parts of about
   ``PART_TURNS`` turns, so memory does not grow with the input; Spark's
   shuffle is the external store.  A part merges the pieces of the runs by a
   loser tree that keeps each run's LCP with the last sequence given: unequal
   LCPs decide without a look at the turns, equal ones compare from there on.
4. The merged stream drives a stack, the open path of the trie.  An LCP below
   the path's length closes the nodes beyond it; a closed node is complete and
   leaves with its counts folded into its parent.
5. Only nodes on the paths of a part's first and last sequence can go on in
   another part.  They leave with what is known of them, at most two paths a
   part, and are added up in one task.

Null roles and texts are empty.  Turns are ordered by turn, null first, then by
digest; repeated rows are turns of their own.  Rows without conv_id belong to
no conversation.  A conversation without turns is a member of the root alone;
an empty table has no nodes.  Texts of any length count by digest and bytes.  Extra
columns are ignored.  One conversation's digests (24 bytes a turn) must fit a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.spark_tools import documents, hot_join, release, stored, tidied

RUN_TURNS, PART_TURNS, ROWS = 500_000, 1_000_000, 10_000
DIGEST = 16

MEMBERS = "h1 long, h2 long, n long, conv long, ends string"
SORTED = "run long, place long, lcp int, turns array<binary>, bytes array<long>, n long, conv long, ends string"
NODE = "node binary, parent binary, depth long, n_convs long, conv_id long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
OPEN = NODE + ", bytes long, border boolean"
EMPTY = hashlib.sha256(b"").hexdigest()
ROOT = bytes(DIGEST)


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): arrays of struct (digest, bytes), in order; ``turns`` has conv_id, turn, role and text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat_ws(":", F.octet_length(role), F.concat(role, text)).cast("binary")))
    one = F.struct(F.col("turn").alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), one.alias("t"))
    # sort_array puts a null field of a struct first
    listed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return listed.select("conv_id", F.transform("t", lambda x: F.struct(x["digest"].alias("digest"), x["bytes"].alias("bytes"))).alias("turns"))


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h1, h2, n, conv, ends) of runs of equal (h1, h2), whose ids come in ascending order."""
    out: list[tuple[Any, ...]] = []
    key: tuple[int, int] | None = None
    n = least = 0
    ids = hashlib.sha256()
    for batch in batches:
        for h1, h2, conv in zip(*(batch.column(c).to_pylist() for c in ("h1", "h2", "conv_id"))):
            if key != (h1, h2):
                if key:
                    out.append((*key, n, least, ids.hexdigest()))
                key, n, least, ids = (h1, h2), 0, conv, hashlib.sha256()
            ids.update(b",%d" % conv if n else b"%d" % conv)
            n += 1
        if len(out) >= ROWS:
            yield _batch(out, MEMBERS)
            out = []
    if key:
        yield _batch([*out, (*key, n, least, ids.hexdigest())], MEMBERS)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<binary>": pa.list_(pa.binary()), "array<long>": pa.list_(pa.int64())}


def _batch(rows: list[tuple[Any, ...]], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split(" ") for x in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[k]) for c, k in zip(zip(*rows), kinds)], names=list(names))


def lcp(a: list[bytes], b: list[bytes], start: int = 0) -> int:
    """Equal turns at the front of ``a`` and ``b``, of which ``start`` are known."""
    most = min(len(a), len(b))
    while start < most and a[start] == b[start]:
        start += 1
    return start


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs of a task with their LCPs."""
    from pyspark import TaskContext

    number, held, size = TaskContext.get().partitionId() << 32, [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        held.sort(key=lambda r: r[0])
        out, before = [], []
        for place, (turns, *rest) in enumerate(held):
            out.append((number, place, lcp(before, turns), turns, *rest))
            before = turns
            if len(out) == ROWS:
                yield _batch(out, SORTED)
                out = []
        if out:
            yield _batch(out, SORTED)

    for batch in batches:
        held += zip(*(batch.column(c).to_pylist() for c in ("digests", "bytes", "n", "conv", "ends")))
        size += len(batch.column("digests").flatten())
        if size >= RUN_TURNS:
            yield from flush()
            number, held, size = number + 1, [], 0
    yield from flush()


def merged(runs: list[list[tuple[int, list[bytes], Any]]]) -> Iterator[tuple[int, list[bytes], Any]]:
    """Merge sorted runs of (LCP with the one before, turns, rest) by a loser tree; gives the same of the merged order.

    Every player holds its LCP with the last sequence given.  Of two players
    the one with the longer LCP is smaller; where both are equal the turns from
    there on decide, and the loser keeps its LCP with the winner.
    """
    width = 1 << max(0, (len(runs) - 1).bit_length())
    at, shared = [0] * width, [0] * width  # next of each run, and its LCP with the last one given
    ends = [len(r) for r in runs] + [0] * (width - len(runs))

    def play(x: int, y: int) -> tuple[int, int]:
        """(winner, loser)"""
        if at[x] >= ends[x]:
            return y, x
        if at[y] >= ends[y] or shared[x] > shared[y]:
            return x, y
        if shared[x] < shared[y]:
            return y, x
        a, b = runs[x][at[x]][1], runs[y][at[y]][1]
        h = lcp(a, b, shared[x])
        less = h == len(a) or (h < len(b) and a[h] < b[h])
        x, y = (x, y) if less else (y, x)
        shared[y] = h
        return x, y

    losers = [0] * width
    level = list(range(width))
    node = width
    while len(level) > 1:  # the first round, from the leaves up
        node >>= 1
        games = [play(level[k], level[k + 1]) for k in range(0, len(level), 2)]
        for k, (_, loser) in enumerate(games):
            losers[node + k] = loser
        level = [winner for winner, _ in games]
    top = level[0]
    while at[top] < ends[top]:
        _, turns, rest = runs[top][at[top]]
        yield shared[top], turns, rest
        at[top] += 1
        if at[top] < ends[top]:
            shared[top] = runs[top][at[top]][0]
        k = (top + width) >> 1
        while k:
            top, losers[k] = play(top, losers[k])
            k >>= 1


def _nodes(stream: Iterator[tuple[int, list[bytes], Any]]) -> Iterator[tuple[Any, ...]]:
    """Rows of OPEN from a merged stream of distinct sequences; rest is (bytes of each turn, n, least member, ends)."""
    # an open node: [id, parent id, n, least member, children, leaves, saved, ends, bytes, border]
    path: list[list[Any]] = [[ROOT, None, 0, None, 0, 0, 0, None, 0, True]]

    def close() -> tuple[Any, ...]:
        node, parent, n, conv, children, leaves, saved, ends, size, border = path.pop()
        if not border:
            leaves, saved = leaves if children else 1, saved + (n - 1) * size
        if path:
            up = path[-1]
            up[2] += n
            up[3] = conv if up[3] is None else min(up[3], conv)
            if not border:
                up[4] += 1
                up[5] += leaves
                up[6] += saved
        return node, parent, len(path), n, conv, children, leaves, saved, ends or (None if border else EMPTY), size, border

    first = True
    for shared, turns, (sizes, n, conv, ends) in stream:
        while len(path) > shared + 1:
            yield close()
        for d in range(shared, len(turns)):
            node = hashlib.md5(path[-1][0] + turns[d]).digest()
            path.append([node, path[-1][0], 0, None, 0, 0, 0, None, sizes[d], first])
        end = path[-1]
        end[2] += n
        end[3] = conv if end[3] is None else min(end[3], conv)
        end[7] = ends
        first = False
    if not first:
        for node in path:
            node[9] = True
        while path:
            yield close()


def _part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of a part, whose rows come by run and place."""
    runs: dict[int, list[tuple[int, list[bytes], Any]]] = {}
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("run", "lcp", "turns", "bytes", "n", "conv", "ends"))
        for run, shared, turns, *rest in zip(*columns):
            mine = runs.setdefault(run, [])
            mine.append((shared if mine else 0, turns, rest))  # what stood before the first is in another part
    out = []
    for row in _nodes(merged(list(runs.values()))) if runs else ():
        out.append(row)
        if len(out) == ROWS:
            yield _batch(out, OPEN)
            out = []
    if out:
        yield _batch(out, OPEN)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Border nodes, deepest first and each once: fold their numbers into their parents."""
    more: dict[bytes, list[int]] = {}
    for batch in batches:
        out = []
        for node, parent, depth, n, conv, children, leaves, saved, ends, size in zip(*(c.to_pylist() for c in batch.columns)):
            below = more.pop(node, [0, 0, 0])
            children += below[0]
            leaves = leaves + below[1] if children else 1
            saved += below[2] + (n - 1) * size
            out.append((node, parent, depth, n, conv, children, leaves, saved, ends or EMPTY))
            if parent is not None:
                up = more.setdefault(parent, [0, 0, 0])
                up[0] += 1
                up[1] += leaves
                up[2] += saved
        if out:
            yield _batch(out, NODE)


def prefix_trie(convs: DataFrame) -> DataFrame:
    """The nodes of the trie of ``convs`` (conv_id, turns as of ``conversations``)."""
    rows = stored(convs.select("conv_id", F.xxhash64("turns").alias("h1"), F.xxhash64(F.lit(1), F.size("turns"), F.col("turns")).alias("h2"), "turns"))
    groups = rows.select("h1", "h2", "conv_id").repartition("h1", "h2").sortWithinPartitions("h1", "h2", "conv_id").mapInArrow(tidied(_members), MEMBERS)
    groups = stored(groups)
    one = rows.join(groups.withColumnRenamed("conv", "conv_id"), ["conv_id", "h1", "h2"])
    one = one.select(F.col("turns.digest").alias("digests"), F.col("turns.bytes").alias("bytes"), "n", F.col("conv_id").alias("conv"), "ends")
    runs = stored(one.mapInArrow(tidied(_runs), SORTED), free=(rows, groups))
    turns = runs.agg(F.sum(F.size("turns"))).first()[0] or 0
    parts = max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-turns // PART_TURNS))
    found = stored(runs.repartitionByRange(parts, "turns").sortWithinPartitions("run", "place").mapInArrow(tidied(_part), OPEN))
    sums = {c: F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")}
    border = found.where("border").groupBy("node", "parent", "depth").agg(sums["n_convs"], F.min("conv_id").alias("conv_id"), sums["n_children"], sums["n_leaves"], sums["saved_tokens"], F.max("ends_sha256").alias("ends_sha256"), F.max("bytes").alias("bytes"))
    border = border.repartition(1).sortWithinPartitions(F.desc("depth")).mapInArrow(tidied(_meet), NODE)
    nodes = stored(found.where("not border").drop("border", "bytes").unionByName(border), free=(runs, found))
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    counts = nodes.where("n_children > 0").select(F.col("node").alias("parent"), F.col("n_children").alias("cnt"))
    out = stored(hot_join(nodes, parents, "parent", counts).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"))
    release(nodes)
    return out


def rebuilt(convs: DataFrame) -> DataFrame:
    """Every conversation c behind the first h turns of conversation c - c % 5 instead of its own; h = crc32(c) % 9."""
    own = convs.withColumns({"h": F.expr("cast(crc32(cast(cast(conv_id as string) as binary)) % 9 as int)"), "base": F.expr("conv_id - conv_id % 5")})
    bases = convs.where("conv_id % 5 = 0").select(F.col("conv_id").alias("base"), F.slice("turns", 1, 8).alias("lead"))
    none = F.expr("cast(array() as array<struct<digest: binary, bytes: bigint>>)")
    lead = F.coalesce(F.slice("lead", F.lit(1), F.col("h")), none)
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return own.join(bases, "base", "left").select("conv_id", F.concat(lead, rest).alias("turns"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(conversations(documents(spark, sf_dir, "conversations"))))


#: CRC-32 of the decimal digits of c, bit by bit: 0xEDB88320 is the reversed polynomial.
_CRC = (
    "xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(c::varchar, ''), lambda x: ascii(x)::bigint)),"
    " lambda a, b: list_reduce(list_concat([xor(a, b)], [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda p, q: xor(p >> 1, 3988292384 * (p & 1)))), 4294967295)"
)
ORACLE = f"""
with t as (select conv_id as c, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
digests as (select c, turn, md5(concat(octet_length(encode(role)), ':', role, text)) as d, octet_length(encode(text)) as b from t),
convs as (select c, list(d order by turn nulls first, d) as ds, list(b order by turn nulls first, d) as bs from digests group by c),
h as (select c, ds, bs, {_CRC} % 9 as h from convs),
built as (select o.c, list_concat(coalesce(b.ds[1:o.h], []), o.ds[o.h + 1:]) as ds, list_concat(coalesce(b.bs[1:o.h], []), o.bs[o.h + 1:]) as bs from h o left join convs b on b.c = o.c - o.c % 5),
steps as (select c, len(ds) as size, unnest(range(0, len(ds) + 1)) as depth, ds, bs from built),
nodes as (select depth, ds[1:depth] as k, count(*) as n_convs, min(c) as conv_id, coalesce(max(bs[depth]), 0) as b, coalesce(string_agg(c::varchar, ',' order by c) filter (where size = depth), '') as ends from steps group by 1, 2),
children as (select depth - 1 as depth, k[1:depth - 1] as k, count(*) as n_children from nodes where depth > 0 group by 1, 2),
up as (select n.*, coalesce(x.n_children, 0) as n_children from nodes n left join children x on x.depth = n.depth and x.k = n.k),
lines as (select unnest(range(0, depth + 1)) as depth, k, n_children, (n_convs - 1) * b as saved from up),
below as (select depth, k[1:depth] as k, count(*) filter (where n_children = 0) as n_leaves, sum(saved) as saved from lines group by 1, 2)
select u.conv_id, cast(u.depth as bigint) as depth, p.conv_id as parent_conv_id, u.n_convs, u.n_children, s.n_leaves, cast(s.saved as bigint) as saved_tokens, sha256(u.ends) as ends_sha256
from up u join below s on s.depth = u.depth and s.k = u.k left join up p on p.depth = u.depth - 1 and p.k = u.k[1:u.depth - 1]"""
