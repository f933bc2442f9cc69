"""Operator 2, MinHash near-dedup by a chosen-path set similarity join.

A document is the set of its distinct 5-word shingles (ASCII lower case).
Documents whose sets are equal collapse to one class first.  Classes then go
down ``TREES`` independent trees: a node picks one or two minhash positions at
random (4/3 on average, the inverse of the similarity bound), and a class
moves to a child for each picked position, named by its minimum there.  Pairs
at the bound survive a level about as often as not, unlike pairs die out.
Nodes of up to ``LEAF`` classes are compared exhaustively by 128 one-byte
minima; larger ones branch again, each tree by itself.  What the trees propose
is grouped, and each group is decided exactly, on full shingle sets; nothing is
linked by estimate.

Cost: one pass over the texts for signatures, one shuffle of the texts that
have a candidate partner, and narrow shuffles of (node, class) rows.  A group
too large for one task, and a node that stays above ``LEAF`` at the greatest
depth, is handled in blocks: every member against the classes nearest the
consensus signature, then members still outside the largest component against
all blocks, or first against leaders drawn among them where they are very many.
No pair is capped or dropped.

Every row is a document.  Nulls and texts without words have an empty set, link
with nothing and form their own component, named by their doc_id.  A null
doc_id is above every id: a component of null ids only has a null component_id,
and all its rows are kept by the frame, one by the stage.  Rows that repeat a
doc_id get results by their texts; equal rows get equal results, so the frame
keeps them alike and the stage keeps one.  Extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.llm import words as W
from gaugeworks.llm.spark_tools import by_group, components, documents, hot_join, stored, tidied

SHINGLE, TREES, MINIMA, LEAF, DEPTH = 5, 16, 128, 2048, 6
#: Estimates at or above this are candidates: 3.9 standard deviations below a similarity of 0.75.
CANDIDATE = 0.60
GROUP_SETS, GROUP_SHINGLES, BLOCK, LEADERS = 512, 2_000_000, 256, 16
#: Blocks of members apart from a group's leaders that meet the whole group; while there are more, leaders are drawn among them.
MOST_PARTS = 64
#: Groups whose bytes a task counts before it sends the counts on; 256 KB each.
TALLIES = 128

_MULTIPLIERS = W.mix(np.arange(1, MINIMA + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def _picks(seed: int) -> list[int]:
    """One or two positions, 4/3 on average."""
    rng = np.random.default_rng(seed)
    return rng.choice(MINIMA, size=1 + int(rng.integers(3) == 0), replace=False).tolist()


_ROOTS = [(tree, at) for tree in range(TREES) for at in _picks(tree)]


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row0, values, first): sorted distinct shingles of consecutive rows."""
    for w in W.scan(column, lower=True):
        values, first, _ = W.grams(w, SHINGLE, short=True)
        sets = [np.unique(values[a:b]) for a, b in zip(first[:-1], first[1:])]
        yield w.row0, np.concatenate(sets) if sets else values, np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def signatures(values: np.ndarray, first: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """(sets, MINIMA) of 32-bit minima; zeros for empty sets."""
    out = np.zeros((len(first) - 1, MINIMA), dtype=np.uint32)
    full = np.flatnonzero(np.diff(first))
    if not len(full):
        return out
    a = 0
    while a < len(full):
        b = max(a + 1, int(np.searchsorted(first[full], first[full[a]] + block)))
        rows = full[a:b]
        part = values[first[rows[0]] : first[rows[-1] + 1]]
        cuts = first[rows] - first[rows[0]]
        for k in range(MINIMA):
            out[rows, k] = np.minimum.reduceat(part * _MULTIPLIERS[k], cuts) >> np.uint64(32)
        a = b
    return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, ties = batch.column("doc_id"), batch.column("tie")
        for row0, values, first in shingle_sets(batch.column("text")):
            n = np.diff(first)
            sums = np.concatenate([[0], np.cumsum(W.mix(values))]).astype(np.uint64)
            whole = W.mix((sums[first[1:]] - sums[first[:-1]]) ^ (n.astype(np.uint64) << np.uint64(40)))
            sig = signatures(values, first)
            keys = np.stack([W.mix(sig[:, at].astype(np.uint64) + np.uint64((tree * MINIMA + at) << 32)) for tree, at in _ROOTS], axis=1)
            flat = pa.array(keys.reshape(-1).view(np.int64))
            width = np.arange(len(n) + 1, dtype=np.int32)
            sk = pa.array(whole.view(np.int64), mask=n == 0)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(row0, len(n)),
                    ties.slice(row0, len(n)),
                    pa.array(n.astype(np.int64)),
                    sk,
                    pa.ListArray.from_arrays(pa.array(width * len(_ROOTS)), flat),
                    pa.array([x.tobytes() for x in sig], pa.binary()),
                ],
                names=["doc_id", "tie", "n_shingles", "sk", "keys", "sig"],
            )

PROFILE = "doc_id long, tie long, n_shingles long, sk long, keys array<long>, sig binary"


FLOOR = (CANDIDATE + (1 - CANDIDATE) / 256) * MINIMA


def _bytes_of(column: pa.Array) -> np.ndarray:
    """(classes, MINIMA) of the low byte of each minimum."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(len(column), MINIMA).astype(np.uint8)


def _alike(sig: np.ndarray, n: np.ndarray, i: int, others: np.ndarray) -> np.ndarray:
    """Which of ``others`` may reach the bound with class i, by size and by estimate."""
    ok = 100 * np.minimum(n[i], n[others]) >= 75 * np.maximum(n[i], n[others])
    ok[ok] = (sig[others[ok]] == sig[i]).sum(1) >= FLOOR
    return ok


def _leaves(table: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Edges that connect, inside each node, classes linked by candidate pairs."""
    sk = table.column("sk").to_numpy()
    n = table.column("n_shingles").to_numpy()
    sig = _bytes_of(table.column("sig"))
    size = np.diff(bounds)
    a = bounds[:-1][size == 2]
    ok = ((sig[a] == sig[a + 1]).sum(1) >= FLOOR) & (100 * np.minimum(n[a], n[a + 1]) >= 75 * np.maximum(n[a], n[a + 1]))
    out = [(sk[a[ok]], sk[a[ok] + 1])]
    for s, e in zip(bounds[:-1][size > 2], bounds[1:][size > 2]):
        left = np.arange(s, e)
        while len(left):
            first, left, frontier = left[0], left[1:], [left[0]]
            while frontier and len(left):
                hit = _alike(sig, n, frontier.pop(), left)
                found, left = left[hit], left[~hit]
                frontier += found.tolist()
                out.append((sk[found], np.full(len(found), sk[first])))
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[i] for x in out])) for i in (0, 1)], names=["u", "v"])


def _block_alike(table: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Edges by estimate between ``lead`` rows and all rows of a block."""
    sk, n, sig, lead = table.column("sk").to_numpy(), table.column("n_shingles").to_numpy(), _bytes_of(table.column("sig")), table.column("lead").to_numpy()
    for s, e in zip(bounds[:-1], bounds[1:]):
        at = s + _once(sk[s:e], lead[s:e])
        union = _Union(len(at))
        for i in np.flatnonzero(lead[at]).tolist():
            for j in np.flatnonzero(_alike(sig, n, at[i], at)):
                union.join(i, int(j))
        yield _led(union, sk[at], lead[at])


def _once(sk: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """Rows of a block, each class once, by its highest lead."""
    at = np.lexsort((-lead, sk))
    return at[np.concatenate([[True], sk[at][1:] != sk[at][:-1]])]


def _led(union: "_Union", sk: np.ndarray, lead: np.ndarray) -> pa.RecordBatch:
    """Edges from each linked class to one of its block's component: to the first leader (lead 2) where that is in it."""
    root = np.array([union.find(i) for i in range(len(sk))])
    head = np.arange(len(sk))
    first = np.flatnonzero(lead == 2)
    head[root[first]] = first
    to = head[root]
    keep = to != np.arange(len(sk))
    return pa.RecordBatch.from_arrays([pa.array(sk[keep]), pa.array(sk[to[keep]])], names=["u", "v"])


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)


def exact_links(sets: list[np.ndarray], union: _Union, rows: np.ndarray | None = None) -> None:
    """Join in ``union`` every pair of sets with 100 * intersection >= 75 * union.

    Intersections are counted through the postings of each set's shingles.
    With ``rows``, only pairs that hold one of those sets are looked at.
    """
    k = len(sets)
    size = np.array([len(s) for s in sets])
    if k == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        if 100 * both >= 75 * (size.sum() - both):
            union.join(0, 1)
        return
    owner = np.repeat(np.arange(k), size)
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(ids, kind="stable")
    df = np.bincount(ids)
    begin = np.cumsum(df) - df
    holders = owner[order]
    first = np.concatenate([[0], np.cumsum(size)])
    for i in range(k) if rows is None else rows:
        mine = ids[first[i] : first[i + 1]]
        both = np.bincount(holders[W.spans(begin[mine], df[mine])], minlength=k)
        for j in np.flatnonzero(100 * both >= 75 * (size[i] + size - both)):
            if j != i:
                union.join(int(i), int(j))


def _sets_of(texts: pa.Array) -> list[np.ndarray]:
    return [values[a:b] for _, values, first in shingle_sets(texts) for a, b in zip(first[:-1], first[1:])]


def _decide(table: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Exact components inside whole groups: (sk, label)."""
    sks = table.column("sk").to_numpy()
    texts = W.text_array(table.column("text"))
    for s, e in zip(bounds[:-1], bounds[1:]):
        _, at = np.unique(sks[s:e], return_index=True)
        sk = sks[s:e][at]
        sets = _sets_of(texts.slice(s, e - s).take(pa.array(at)))
        union = _Union(len(sk))
        if len(sk) > 1:
            exact_links(sets, union)
        yield pa.RecordBatch.from_arrays([pa.array(sk), pa.array(sk[[union.find(i) for i in range(len(sk))]])], names=["node", "root"])


def _block_links(table: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Exact edges between ``lead`` rows and all rows of a block."""
    sk, lead, texts = table.column("sk").to_numpy(), table.column("lead").to_numpy(), W.text_array(table.column("text"))
    for s, e in zip(bounds[:-1], bounds[1:]):
        at = _once(sk[s:e], lead[s:e])
        union = _Union(len(at))
        if len(at) > 1:
            exact_links(_sets_of(texts.slice(s, e - s).take(pa.array(at))), union, np.flatnonzero(lead[s:e][at]))
        yield _led(union, sk[s:e][at], lead[s:e][at])


def _consensus(large: DataFrame) -> DataFrame:
    """(cc, sk, lead) of the LEADERS classes of each large group that agree most with its modal signature; lead is 2 for the first, else 1."""
    large = stored(large.select("cc", "sk", "sig"))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for g, c in counts.items():
                at, byte = np.nonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), g)), pa.array(at), pa.array(byte), pa.array(c[at, byte])], names=["cc", "at", "byte", "c"])
            counts.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            cc = batch.column("cc").to_numpy()
            sig = _bytes_of(batch.column("sig"))
            for g in np.unique(cc).tolist():
                if g not in counts and len(counts) == TALLIES:
                    yield from flush()
                np.add.at(counts.setdefault(g, np.zeros((MINIMA, 256), dtype=np.int64)), (np.arange(MINIMA)[None, :], sig[cc == g]), 1)
        yield from flush()

    # dealt by (cc, at) once for the sums and for the greatest of them
    votes = large.select("cc", "sig").mapInArrow(tidied(tally), "cc long, at long, byte long, c long").repartition("cc", "at").groupBy("cc", "at", "byte").agg(F.sum("c").alias("c"))
    modal = votes.groupBy("cc", "at").agg(F.max(F.struct("c", "byte")).alias("m")).groupBy("cc")
    modal = modal.agg(F.expr("transform(array_sort(collect_list(struct(at, m.byte as byte))), x -> x.byte)").alias("modal"))

    @F.pandas_udf("long")
    def agreement(sig, mode):
        return sig.combine(mode, lambda s, m: int((np.frombuffer(s, dtype=np.uint32).astype(np.uint8) == np.asarray(m)).sum()))

    scored = large.join(modal, "cc").select("cc", "sk", agreement("sig", "modal").alias("score"))
    # a rank filter over row_number is pushed below the exchange, so a large group is cut to its leaders first
    rank = F.row_number().over(Window.partitionBy("cc").orderBy(F.desc("score"), "sk"))
    ranked = scored.withColumn("rank", rank).where(F.col("rank") <= LEADERS)
    return stored(ranked.select("cc", "sk", F.when(F.col("rank") == 1, 2).otherwise(1).alias("lead")), free=(large,))


def _in_blocks(members: DataFrame, leaders: DataFrame, payload: list[str], links, nodes: DataFrame | None = None) -> DataFrame:
    """Edges that connect what is linked inside groups too large for one task, members(cc, sk, blocks, payload).

    The members of a group are dealt to blocks, and its leaders meet every
    block.  Then members that no block connects to the first leader, and only
    they, meet every block too: any link has such a member or lies within the
    first leader's component.

    With ``nodes`` (key, sk), leaders are drawn among members apart as long as
    those fill over ``MOST_PARTS`` blocks, twice as many each round.  They meet
    every block, which settles the families they stand in; the last ones apart
    meet every block as above.  Members that a drawn leader has settled are
    connected to their family, and what else they link with is looked for among
    the members of their nodes.  No member travels more often than MOST_PARTS,
    than it has nodes and, where it leads, than there are blocks.
    """
    members = members.withColumn("block", F.expr("cast(pmod(xxhash64(sk, 1), blocks) as int)"))
    everywhere = F.explode(F.expr("sequence(0, blocks - 1)"))

    def met(leaders: DataFrame) -> DataFrame:
        spread = members.drop("block").join(leaders, ["cc", "sk"]).withColumn("block", everywhere)
        task = F.xxhash64("cc", "block").alias("task")
        rows = members.select(task, "sk", *payload, F.lit(0).alias("lead")).unionByName(spread.select(task, "sk", *payload, "lead"))
        return stored(by_group(rows, "task", links, "u long, v long"))

    def parted(apart: DataFrame) -> DataFrame:
        apart = stored(apart.select("cc", "sk"))
        if apart.isEmpty():
            return apart.withColumn("parts", F.lit(0))
        minor = apart.groupBy("cc").agg(F.expr(f"cast(ceil(count(*) / {BLOCK}) as int)").alias("parts"))
        return stored(apart.join(F.broadcast(minor), "cc"), free=(apart,))

    found = met(leaders)
    first = leaders.where("lead = 2").select("cc", F.col("sk").alias("first"))
    apart = members.select("cc", "sk").join(F.broadcast(first), "cc").where("sk <> first")
    apart = parted(apart.join(found.select(F.col("u").alias("sk"), F.col("v").alias("first")), ["sk", "first"], "left_anti").select("cc", "sk", "first").distinct())
    drawn, settled = LEADERS, None
    while nodes is not None and not apart.where(F.col("parts") > MOST_PARTS).isEmpty():
        many = apart.where(F.col("parts") > MOST_PARTS)
        drawn *= 2
        turn = F.row_number().over(Window.partitionBy("cc").orderBy(F.xxhash64("sk", F.lit(drawn)), "sk"))
        leaders = stored(many.select("cc", "sk", turn.alias("rank")).where(F.col("rank") <= drawn).select("cc", "sk", F.lit(1).alias("lead")))
        edges = met(leaders)
        done = edges.select(F.col("u").alias("sk")).unionByName(edges.select(F.col("v").alias("sk"))).unionByName(leaders.select("sk")).distinct()
        found, before = found.unionByName(edges), apart
        new = many.join(done, "sk", "left_semi").select("sk")
        settled = stored(new if settled is None else settled.unionByName(new))
        apart = parted(many.join(done, "sk", "left_anti").unionByName(before.where(F.col("parts") <= MOST_PARTS)))
    if settled is not None:
        mine = nodes.join(settled, "sk").select("key", F.col("sk").alias("_late"))
        around = nodes.join(mine.select("key").distinct(), "key").join(mine.select("key", F.col("_late").alias("sk"), F.lit(1).alias("lead")), ["key", "sk"], "left")
        rows = around.join(members.select("sk", *payload), "sk").select(F.col("key").alias("task"), "sk", *payload, F.coalesce("lead", F.lit(0)).alias("lead"))
        found = found.unionByName(by_group(rows, "task", links, "u long, v long"))
    if apart.isEmpty():
        return found
    apart = apart.withColumn("part", F.expr("cast(pmod(xxhash64(sk, 2), parts) as int)"))
    task = F.xxhash64("cc", "part", "block").alias("task")
    firsts = members.drop("block").join(apart, ["cc", "sk"]).withColumn("block", everywhere)
    others = members.join(apart.select("cc", "parts").distinct(), "cc").withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
    rows = firsts.select(task, "sk", *payload, F.lit(1).alias("lead")).unionByName(others.select(task, "sk", *payload, F.lit(0).alias("lead")))
    return found.unionByName(by_group(rows, "task", links, "u long, v long"))


def _large_groups(texts: DataFrame, members: DataFrame, big: DataFrame, sigs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, root) for groups too large for one task; exact, on full sets."""
    blocks = F.greatest(F.ceil(F.col("cnt") / BLOCK), F.ceil(F.col("shingles") / F.lit(GROUP_SHINGLES))).cast("int")
    big = F.broadcast(big.select("cc", blocks.alias("blocks")))
    leaders = _consensus(members.select("cc", "sk").join(big, "cc").join(sigs, "sk"))
    return components(_in_blocks(texts.join(big, "cc"), leaders, ["text"], _block_links, nodes))


def _nodes(classes: DataFrame, sigs: DataFrame | None = None) -> list[DataFrame]:
    """Tables (key, sk, cnt) of the nodes to compare, of two classes or more; classes(sk, keys), sigs(sk, sig) or else sig of classes.

    Nodes of over ``LEAF`` classes branch until ``DEPTH``; only the last table
    can hold larger ones.  Leaves of equal members are compared once.  Nodes
    that still branch are never merged, so that trees stay independent.
    """

    def counted(rows: DataFrame) -> DataFrame:
        # a fingerprint of the members: two 64-bit exclusive ors, which cannot overflow, and a sum
        prints = [F.expr("sum(cast(xxhash64(sk) >> 24 as long))").alias("print"), F.expr("bit_xor(xxhash64(sk))").alias("print1"), F.expr("bit_xor(xxhash64(sk, 1))").alias("print2")]
        return rows.groupBy("key").agg(F.count("*").alias("cnt"), *prints).where("cnt > 1")

    rows = classes.select("sk", F.explode(F.array_distinct("keys")).alias("key"))
    tables, level = [], 0
    while True:
        counts, deepest = counted(rows), level == DEPTH
        leaf = F.lit(True) if deepest else F.col("cnt") <= LEAF
        own = F.when(~leaf, F.col("key")).alias("own")  # null for leaves
        wanted = counts.groupBy("cnt", "print", "print1", "print2", own).agg(F.min("key").alias("key")).select("key", "cnt")
        kept = stored(rows.join(wanted, "key").select("key", "sk", "cnt"), free=(rows,))
        tables.append(kept.where(leaf))
        tables[-1]._stored_path = kept._stored_path
        large = kept.where(~leaf)
        if deepest or large.isEmpty():
            return tables
        level += 1
        if level == 1:
            deep = large.select("sk").distinct()
            sigs = stored((classes if sigs is None else sigs).select("sk", "sig").join(deep, "sk", "left_semi"))
        ats = F.expr(f"array(pmod(xxhash64(key, {level}, 1), {MINIMA}), if(pmod(xxhash64(key, {level}, 2), 3) = 0, pmod(xxhash64(key, {level}, 3), {MINIMA}), null))")
        child = F.expr("xxhash64(key, at, substring(sig, cast(4 * at + 1 as int), 4))").alias("key")
        rows = stored(large.join(sigs, "sk").select("sk", "key", "sig", F.explode(F.array_compact(ats)).alias("at")).select("sk", child).distinct())


def _candidates(tables: list[DataFrame], sigs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sk, cc): classes that a candidate pair connects to others, by group; and the nodes (key, sk) of a size to compare."""
    nodes = tables[0]
    for more in tables[1:]:
        nodes = nodes.unionByName(more)
    few = nodes.where(F.col("cnt") <= 2 * LEAF)
    edges = by_group(few.join(sigs, "sk").select("key", "sk", "n_shingles", "sig"), "key", _leaves, "u long, v long")
    many = tables[-1].where(F.col("cnt") > 2 * LEAF)
    if len(tables) > DEPTH and not many.isEmpty():
        members = many.join(sigs, "sk").select(F.col("key").alias("cc"), "sk", F.ceil(F.col("cnt") / LEAF).cast("int").alias("blocks"), "n_shingles", "sig")
        leaders = _consensus(members)
        edges = edges.unionByName(_in_blocks(members, leaders, ["n_shingles", "sig"], _block_alike))
    groups = components(edges)
    return groups.select(F.col("node").alias("sk"), F.col("root").alias("cc")), few.select("key", "sk")


def _named(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The profile of docs(doc_id, text), and its classes with the root of their component."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    profile = stored(source.mapInArrow(tidied(_profile), PROFILE))
    alike = profile.where("sk is not null")
    sigs = alike.select("sk", "n_shingles", "sig").dropDuplicates(["sk"])
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")).alias("doc")
    classes = stored(alike.groupBy("sk").agg(least, F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.count("*").alias("cnt"), F.first("keys").alias("keys")))
    tables = _nodes(classes, sigs)
    classes = classes.drop("keys")
    groups, nodes = _candidates(tables, sigs)
    members = stored(groups.join(classes, "sk").select("cc", "sk", F.col("doc.doc_id").alias("doc_id"), F.col("doc.tie").alias("tie"), "n"))
    # always by a shuffle, so that what a run costs at one size tells what it costs at another
    texts = stored(source.join(members.hint("merge"), source.doc_id.eqNullSafe(members.doc_id) & (source.tie == members.tie)).select("cc", "sk", "text"), "zstd")
    sizes = stored(members.groupBy("cc").agg(F.count("*").alias("cnt"), F.sum("n").alias("shingles")))
    # a row for several hundred classes or 2,000,000 shingles at least, so few enough to broadcast
    big = sizes.where((F.col("cnt") > GROUP_SETS) | ((F.col("shingles") > GROUP_SHINGLES) & (F.col("cnt") > 2)))
    if big.isEmpty():
        labels = by_group(texts, "cc", _decide, "node long, root long")
    else:
        labels = by_group(texts.join(F.broadcast(big), "cc", "left_anti"), "cc", _decide, "node long, root long")
        labels = labels.unionByName(_large_groups(texts, members, big, sigs.select("sk", "sig"), nodes))
    labels = stored(labels, free=(texts, members, sizes, *tables))
    return profile, classes.join(labels.withColumnRenamed("node", "sk").distinct(), "sk", "left").withColumn("root", F.coalesce("root", "sk"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, n_shingles, component_id, kept) for each row of docs(doc_id, text)."""
    profile, named = _named(docs)
    named = stored(named.select("sk", "doc_id", "cnt", "root"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    table = stored(named.join(least, "root").select("sk", "component_id", "cnt"))
    rows = profile.select("doc_id", "tie", "n_shingles", "sk")
    found = hot_join(rows.where("sk is not null"), table.select("sk", "component_id"), "sk", table.select("sk", "cnt"))
    alone = rows.where("sk is null").withColumn("component_id", F.col("doc_id"))
    return found.unionByName(alone).select("doc_id", "tie", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "kept")


def stage(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: one row of each component, and every text without words.

    Rows travel whole, so that no column name can clash.  Of rows that repeat
    both doc_id and text, one stays.
    """
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    profile, named = _named(rows)
    first = named.groupBy("root").agg(F.min("doc").alias("doc")).select("doc.doc_id", "doc.tie")
    alone = profile.where("sk is null").select("doc_id", "tie").distinct()
    counts = profile.where("sk is not null").groupBy("doc_id", "tie").agg(F.count("*").alias("n"))
    repeated = stored(counts.where("n > 1").select("doc_id", "tie"))

    def of(kept: DataFrame) -> DataFrame:
        kept = kept.select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"))
        return rows.join(kept, rows["doc_id"].eqNullSafe(kept._id) & (rows["tie"] == kept._tie), "left_semi")

    if repeated.isEmpty():
        return of(first.unionByName(alone)).select("_row.*")
    first = stored(first)
    again = lambda how: first.join(repeated.withColumnsRenamed({"doc_id": "_id", "tie": "_tie"}), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie")), how)
    whole = of(again("left_anti").unionByName(alone))
    rank = F.row_number().over(Window.partitionBy("doc_id", "tie").orderBy(F.lit(0)))
    one = of(again("left_semi")).withColumn("_rank", rank).where("_rank = 1")
    return whole.select("_row").unionByName(one.select("_row")).select("_row.*")
