"""Operator 3, benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

1. Every ``SEED`` neighbouring words of a benchmark item are a seed, however
   common: a seed left out for being common would lose the edited copies of an
   item that has leaked often.
2. Documents are scanned once for seeds.  A hit gives a window as wide as any
   alignment through it that reaches ``MIN_SCORE``; windows that meet are one.
3. A window whose words cannot reach ``MIN_SCORE`` in any order is left out.
4. Each other window is aligned with its item word by word: local alignment,
   match +2, mismatch -1, gap -1.  ``score`` is the best score over the highest
   an item can reach; at ``MIN_SCORE`` or more the document is contaminated.

So each alignment of that score with ``SEED`` unchanged words in a row is found.
The join of seeds is a broadcast hash join in the workers: items come in blocks
of at most ``BLOCK_BYTES`` (and one item), each block is broadcast and joined to
all documents in place.  No text and no seed of a document is shuffled, so a
seed that half of all documents hold costs no more than its windows.

Texts are whole, in lower case, and words are runs of letters and digits, so
shouting and marks around words do not hide a copy.  Null or empty texts match
nothing; items of fewer than three words have no seed and match nothing
(``unseeded`` names them).  Rows with equal doc_ids are scored by themselves;
equal rows give equal results; the stage adds no column, so no name can clash;
an empty table or benchmark gives no hits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from gaugeworks.llm import words as W
from gaugeworks.llm.spark_tools import documents, tidied

SEED, MIN_SCORE, BLOCK_BYTES = 3, 0.5, 16 << 20
MATCH, MISMATCH, GAP = 2, -1, -1
#: Seed hits, or words of windows, that are looked at together.
TOGETHER = 1 << 20


def align(item: np.ndarray, part: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of two word sequences: (score, start, end) in ``part``."""
    n = len(part)
    ramp = -GAP * np.arange(n + 1)
    row, origin = np.zeros(n + 1, dtype=np.int64), np.arange(n + 1)
    best = (0, 0, 0)
    for word in item:
        step = np.where(part == word, MATCH, MISMATCH)
        diagonal, up = row[:-1] + step, row[1:] + GAP
        score, start = np.zeros(n + 1, dtype=np.int64), np.arange(n + 1)
        take = diagonal >= up
        score[1:] = np.where(take, diagonal, up)
        start[1:] = np.where(take, origin[:-1], origin[1:])
        dead = score <= 0
        score[dead], start[dead] = 0, np.arange(n + 1)[dead]
        # gaps along the row: a running maximum of score plus the gap cost so far
        lifted = score + ramp
        peak = np.maximum.accumulate(lifted)
        at = np.maximum.accumulate(np.where(lifted == peak, np.arange(n + 1), 0))
        score, start = peak - ramp, start[at]
        k = int(score.argmax())
        if score[k] > best[0]:
            best = (int(score[k]), int(start[k]), k)
        row, origin = score, start
    return best


class Items:
    """A block of benchmark items with their word values."""

    def __init__(self, ids: list, texts: list[str | None]):
        values = []
        for w in W.scan(pa.array(texts, pa.string()), letters=True):
            values += [w.value[a:b] for a, b in zip(w.first[:-1], w.first[1:])]
        self.ids, self.values = ids, values
        self.vocabulary = np.unique(np.concatenate(values)) if values else np.zeros(0, dtype=np.uint64)

    def seeds(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sorted seed values, item, place) of every place of every item."""
        flat = np.concatenate(self.values) if self.values else self.vocabulary
        first = np.concatenate([[0], np.cumsum([len(v) for v in self.values])]).astype(np.int64)
        value, first, _ = W.grams(W.Words(0, np.zeros(0, np.uint8), first, flat, flat, flat), SEED)
        item = np.repeat(np.arange(len(first) - 1), np.diff(first))
        place = np.arange(len(value)) - first[item]
        order = np.lexsort((place, item, value))
        return value[order], item[order], place[order]


class _Filter:
    """Membership of 64-bit values in a sorted table, behind a bit table of their top bits."""

    def __init__(self, table: np.ndarray, bits: int = 20):
        self.table, self.shift = table, np.uint64(64 - bits)
        self.seen = np.zeros(1 << bits, dtype=bool)
        self.seen[(table >> self.shift).astype(np.int64)] = True

    def hits(self, values: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(self.seen[(values >> self.shift).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.table, values[maybe]), len(self.table) - 1)
        return maybe[self.table[at] == values[maybe]]


def _pieces(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of entries of about ``TOGETHER`` in all, one entry at least."""
    sums, a = np.concatenate([[0], np.cumsum(sizes)]), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(sums, sums[a] + TOGETHER, side="right")) - 1)
        yield a, b
        a = b


def _reach(shared: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The most an alignment of each window can score: words of the item match, each other word in between costs."""
    step = np.where(shared, MATCH, max(MISMATCH, GAP))
    sums = np.cumsum(step)
    # a running minimum that starts anew in each window
    lower = np.repeat(np.arange(len(first) - 1), np.diff(first)) * (2 * MATCH * len(step) + 1)
    low = np.minimum.accumulate(sums - step - lower) + lower
    return np.maximum.reduceat(sums - low, first[:-1])


def _matcher(items: Items):
    """A function of a text column that gives (row, item, score, start, end, seeds) of each aligned pair."""
    value, item, place = items.seeds()
    known, words, width = _Filter(np.unique(value)), _Filter(items.vocabulary), len(items.vocabulary)
    length = np.array([len(v) for v in items.values], dtype=np.int64)
    owned = np.unique(np.concatenate([i * width + np.searchsorted(items.vocabulary, v) for i, v in enumerate(items.values)]))

    def match(column: pa.Array) -> list[tuple[int, int, float, int, int, int]]:
        out = []
        for w in W.scan(column, letters=True) if len(value) else ():
            grams, first, at = W.grams(w, SEED)
            hits = known.hits(grams)
            if not len(hits):
                continue
            named = np.full(len(w.value), -1)
            mine = words.hits(w.value)
            named[mine] = np.searchsorted(items.vocabulary, w.value[mine])
            lows, highs = np.searchsorted(value, grams[hits], "left"), np.searchsorted(value, grams[hits], "right")
            rows = np.searchsorted(first, hits, "right") - 1
            # whole rows together
            change = np.concatenate([[0], np.flatnonzero(np.diff(rows)) + 1])
            ends = np.append(change[1:], len(rows))
            for x, y in _pieces(np.add.reduceat(highs - lows, change)):
                part = slice(change[x], ends[y - 1])
                out += windows(w, named, rows[part], at[hits[part]], lows[part], highs[part])
        return out

    def windows(w: W.Words, named: np.ndarray, row: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list:
        entry = W.spans(lo, hi - lo)
        row, at = np.repeat(row, hi - lo), np.repeat(at, hi - lo)
        it, diagonal = item[entry], at - w.first[row] - place[entry]
        order = np.lexsort((diagonal, it, row))
        row, it, diagonal = row[order], it[order], diagonal[order]
        cut = np.concatenate([[True], (np.diff(row) != 0) | (np.diff(it) != 0) | (np.diff(diagonal) >= 3 * length[it[1:]])])
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(row))
        row, it, seeds = row[starts], it[starts], ends - starts
        # at MIN_SCORE, gaps are no more than the item's words
        lo = w.first[row] + np.maximum(0, diagonal[starts] - length[it])
        hi = np.minimum(w.first[row + 1], w.first[row] + diagonal[ends - 1] + 2 * length[it])
        best: dict[tuple[int, int], tuple[float, int, int, int]] = {}
        for x, y in _pieces(hi - lo):
            size = hi[x:y] - lo[x:y]
            word = named[W.spans(lo[x:y], size)]
            code = np.repeat(it[x:y], size) * width + word
            shared = (word >= 0) & (owned[np.minimum(np.searchsorted(owned, code), len(owned) - 1)] == code)
            reach = _reach(shared, np.concatenate([[0], np.cumsum(size)]))
            for k in x + np.flatnonzero(reach >= MIN_SCORE * MATCH * length[it[x:y]]):
                r, i = int(row[k]), int(it[k])
                score, start, end = align(items.values[i], w.value[lo[k] : hi[k]])
                before = int(lo[k] - w.first[r])
                found = (score / (MATCH * int(length[i])), before + start, before + end, int(seeds[k]))
                if found[0] >= MIN_SCORE and ((r, i) not in best or found > best[r, i]):
                    best[r, i] = found
        return [(w.row0 + r, i, *found) for (r, i), found in best.items()]

    return match


def _blocks(benchmark: DataFrame) -> Iterator[Items]:
    """Items in blocks of bounded bytes, in the order of item_id."""
    ids, texts, size = [], [], 0
    for row in benchmark.select("item_id", F.lower("text").alias("text")).orderBy("item_id", "text").toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        size += len(row[1] or "")
        if size >= BLOCK_BYTES:
            yield Items(ids, texts)
            ids, texts, size = [], [], 0
    if ids:
        yield Items(ids, texts)


def unseeded(benchmark: DataFrame) -> DataFrame:
    """The items that are too short for a seed, or null: no document can match them."""
    words = F.expr("regexp_count(lower(coalesce(text, '')), '[a-z0-9\\\\x{80}-\\\\x{10FFFF}]+')")
    return benchmark.where(words < SEED)


def _shared(spark: SparkSession, benchmark: DataFrame) -> list:
    """Each block of items as a broadcast."""
    return [spark.sparkContext.broadcast(items) for items in _blocks(benchmark) if len(items.vocabulary)]


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, doc_start, doc_end, n_seeds): documents that hold a copy of an item.

    One row per document row and item, with the word span of the best alignment.
    """
    item_type = benchmark.schema["item_id"].dataType.simpleString()
    item_arrow = to_arrow_type(benchmark.schema["item_id"].dataType)
    schema = f"doc_id long, item_id {item_type}, score double, doc_start long, doc_end long, n_seeds long"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text"))
    out = docs.sparkSession.createDataFrame([], schema)
    for shared in _shared(docs.sparkSession, benchmark):

        def hits(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            match = _matcher(items)
            for batch in batches:
                found = match(batch.column("text"))
                if found:
                    row, it, score, start, end, n = zip(*found)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(pa.array(row)), pa.array([items.ids[i] for i in it], item_arrow), pa.array(score), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(n, pa.int64())],
                        names=["doc_id", "item_id", "score", "doc_start", "doc_end", "n_seeds"],
                    )

        out = out.unionByName(rows.mapInArrow(tidied(hits), schema))
    return out


def _holds(shared) -> Callable[[Column], Column]:
    """Whether a text holds a copy of an item of a block."""

    @F.arrow_udf("boolean")
    @tidied
    def holds(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        match = _matcher(shared.value)
        for column in columns:
            found = np.zeros(len(column), dtype=bool)
            found[[f[0] for f in match(column)]] = True
            yield pa.array(found)

    return holds


def stage(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no copy of an item, in place: no shuffle, and only texts go to the workers."""
    for shared in _shared(docs.sparkSession, benchmark):
        docs = docs.where(~_holds(shared)(F.lower("text")))
    return docs


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
