"""Operator 7, substring dedup by relative Lempel-Ziv parsing.

Every document is a block of the reference, which indexes each 20-word sequence
at its first place in (doc_id, start) order.  A document is parsed greedily from
left to right: where the next 20 words have an earlier place, a factor copies
from there and runs as long as the source runs along in the index; the parse
goes on behind it.  A sequence has one place, so no choice between sources is
left, and factors do not overlap.  At a boundary, where the next 20 words have
no earlier place, the windows across it are looked up too: if one that began
within the factors before reaches further, its rest is a factor, which may be
shorter than 20 words.  So factors cover the words of all repeated windows, and
no others.  Words of factors go.

The index: of the thirteen 8-word sequences in a 20-word window the least hash
is its seed, so equal windows have equal seeds, and about one word in seven
starts a seed.  Seeds that occur once end there.  If all runs of windows around
a seed are equal, the first run is the source of the others as a whole; at the
boundaries, where they differ, each 20-word window is looked up by hash.

Order and ties: a null doc_id comes first; rows that share a doc_id but not
the text are ordered by a 64-bit hash of the text; rows equal in both are one
document and get the same result.  Null and empty texts have no words.  Extra
columns are ignored; an empty table gives an empty result.  Equality of word
sequences is equality of 64-bit hashes.

Hot passages: first places are found by a grouped minimum, which combines
before the shuffle.  Seeds and windows that hold over a 256th of all rows, of
which there are at most 256, are dealt over salted keys for the look-up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm import words as W
from gaugeworks.llm.spark_tools import documents, hot_join, stored, tidied

WINDOW, SEED = 20, 8
SPREAD = WINDOW - SEED + 1
_PLACE = 28  # low bits that hold a place within a slice
NO_ID = -(2**63)


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum over each run of ``width`` values, by doubling."""
    span = 1
    while 2 * span <= width:
        v = np.minimum(v[:-span], v[span:])
        span *= 2
    return np.minimum(v[: len(v) - (width - span)], v[width - span :]) if width > span else v


def window_seeds(w: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, seed place, seed value) of every window of a slice.

    ``start`` and ``seed place`` are word positions within the row.
    """
    many = np.maximum(w.counts - WINDOW + 1, 0)
    if not many.sum():
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none.astype(np.uint64)
    values, first, at = W.grams(w, SEED)
    low = np.uint64((1 << _PLACE) - 1)
    least = _sliding_min((values & ~low) | np.arange(len(values), dtype=np.uint64), SPREAD)
    row = np.repeat(np.arange(len(many)), many)
    window = W.spans(first[:-1], many)
    seed = (least[window] & low).astype(np.int64)
    return row, window - first[row], at[seed] - w.first[row], values[seed]


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Slices of batches, so that what is built per row stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def runs_of(w: W.Words) -> tuple[np.ndarray, ...]:
    """(row, seed place, seed value, span value, first start, windows) of each seed's run of windows.

    The span value stands for all words of the run's windows and for where the
    seed is in them: runs of equal seed and span hold the same windows.
    """
    row, start, place, value = window_seeds(w)
    if not len(row):
        return row, place, value, value, start, start
    head = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (place[1:] != place[:-1])]))
    many = np.diff(np.append(head, len(row)))
    row, place, value, start = row[head], place[head], value[head], start[head]
    n = len(w.value)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(w.value * W._powers(W._BASE, n), out=sums[1:])
    a = w.first[row] + start
    span = (sums[a + many + WINDOW - 1] - sums[a]) * W._powers(W._INVERSE, n + 1)[a]
    span = W.mix(span + (many * 64 + place - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return row, place, value, span, start, many


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, ties = batch.column("doc_id").to_numpy(), batch.column("tie").to_numpy()
        for w in W.scan(batch.column("text")):
            row, place, value, span, _, _ = runs_of(w)
            if len(row):
                row = row + w.row0
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(span.view(np.int64)), pa.array(ids[row]), pa.array(ties[row]), pa.array(place.astype(np.int32))], names=["seed", "span", "doc_id", "tie", "at"])


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of documents whose repeated seeds all have one source; the others pass, with their list."""
    for batch in pieces(batches):
        texts, listed = W.text_array(batch.column("text")), batch.column("places")
        passed, rows = [], []
        for i in range(batch.num_rows):
            mine = listed[i].values if listed[i].is_valid else None
            ready = mine is None or not mine.field("source").null_count
            passed.append(None if ready else texts[i].as_py())
            rows.append(_digest(texts[i].as_py(), mine, None) if ready else (None, None, None, None))
        n, removed, digest, found = zip(*rows)
        kept = pa.array([x is None for x in passed])
        lists = listed.filter(pc.invert(kept)).to_pylist()
        lists = pa.array([None if k else lists.pop(0) for k in kept.to_pylist()], listed.type)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("tie"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string()), pa.array(found, _FACTORS), pa.array(passed, pa.string()), lists],
            names=["doc_id", "tie", "n_words", "n_removed", "kept_sha256", "factors", "text", "places"],
        )


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of the seeds whose sources are open."""
    for batch in batches:
        ids, ties, places = batch.column("doc_id").to_numpy(), batch.column("tie").to_numpy(), batch.column("places")
        counts = np.diff(places.offsets.to_numpy())
        owner = np.repeat(np.arange(len(counts)), counts)
        flat = places.flatten()
        open_ = flat.field("source").is_null().to_numpy(zero_copy_only=False)
        wanted = np.sort(owner[open_] << np.int64(40) | flat.field("place").to_numpy()[open_])
        for w in W.scan(batch.column("text")):
            row, start, place, _ = window_seeds(w)
            if not len(row):
                continue
            key = (row + w.row0) << np.int64(40) | place
            repeated = wanted[np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)] == key
            values, first, _ = W.grams(w, WINDOW)
            row, start = row[repeated], start[repeated]
            value = values[first[row] + start].view(np.int64)
            row = row + w.row0
            yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(ids[row]), pa.array(ties[row]), pa.array(start.astype(np.int32))], names=["value", "doc_id", "tie", "at"])


def factors(start: np.ndarray, source: np.ndarray, source_tie: np.ndarray, source_at: np.ndarray) -> list[tuple[int, int, int, int]]:
    """The parse of a document from its repeated windows, sorted by distinct start: (start, words, source doc, source start)."""
    if not len(start):
        return []
    new = np.concatenate([[True], (np.diff(start) != 1) | (np.diff(source) != 0) | (np.diff(source_tie) != 0) | (np.diff(source_at) != 1)])
    a = np.flatnonzero(new)
    ends = np.repeat(start[np.append(a[1:], len(start)) - 1] + WINDOW, np.diff(np.append(a, len(start))))  # of each window's run
    parse, at, n = [], int(start[0]), len(start)
    while True:
        i = int(np.searchsorted(start, at))
        if i < n and start[i] == at:
            end, k = int(ends[i]), i
        elif i and start[i - 1] + WINDOW > at:
            end, k = int(start[i - 1]) + WINDOW, i - 1
        elif i < n:
            at = int(start[i])
            continue
        else:
            return parse
        parse.append((at, end - at, int(source[k]), int(source_at[k]) + at - int(start[k])))
        at = end


_FACTORS = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64()), ("source", pa.int64()), ("source_start", pa.int64())]))
_LIST = "array<struct<start:long,words:long,source:long,source_start:long>>"
_PLACES = "array<struct<place:int,source:long,source_tie:long,source_at:int>>"


def _digest(text: str, listed: pa.StructArray | None, found: pa.StructArray | None) -> tuple[int, int, str, list[dict]]:
    """(words, removed, sha256, factors) of a text.

    ``listed`` has the seeds whose runs are known whole, ``found`` windows one by one.
    """
    words = text.encode().split()
    start, source, source_tie, source_at = [], [], [], []
    if listed is not None:
        known = listed.filter(listed.field("source").is_valid())
        for w in W.scan(pa.array([text], pa.string())):
            _, place, _, _, first, many = runs_of(w)
            at = np.searchsorted(place, known.field("place").to_numpy())
            start.append(W.spans(first[at], many[at]))
            source.append(np.repeat(known.field("source").to_numpy(), many[at]))
            source_tie.append(np.repeat(known.field("source_tie").to_numpy(), many[at]))
            source_at.append(start[-1] + np.repeat(known.field("source_at").to_numpy() - place[at], many[at]))
    if found is not None:
        start.append(found.field("start").to_numpy())
        source.append(found.field("source").to_numpy())
        source_tie.append(found.field("source_tie").to_numpy())
        source_at.append(found.field("source_at").to_numpy())
    parsed: list[tuple[int, int, int, int]] = []
    keep = np.ones(len(words), dtype=bool)
    if start:
        begin, order = np.unique(np.concatenate(start), return_index=True)  # equal rows list their windows twice
        parsed = factors(begin, *(np.concatenate(x)[order] for x in (source, source_tie, source_at)))
        for a, length, _, _ in parsed:
            keep[a : a + length] = False
    kept = words if keep.all() else [words[k] for k in np.flatnonzero(keep)]
    return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), [dict(zip(("start", "words", "source", "source_start"), f)) for f in parsed]


PARSED = f"doc_id long, tie long, n_words long, n_removed long, kept_sha256 string, factors {_LIST}"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        texts, rows = W.text_array(batch.column("text")), []
        for i in range(batch.num_rows):
            listed, found = (batch.column(c)[i] for c in ("places", "found"))
            rows.append(_digest(texts[i].as_py(), listed.values, found.values if found.is_valid else None))
        n, removed, digest, named = zip(*rows)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest), pa.array(named, _FACTORS)], names=["doc_id", "tie", "n_words", "n_removed", "kept_sha256", "factors"])


def substring_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, n_words, n_removed, kept_sha256, factors) for each row of docs(doc_id, text).

    Rows equal in doc_id and text are one document: it is parsed once, and each row gets its digest.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    named = ["doc_id", "tie"]
    again = stored(rows.groupBy(*named).agg(F.count("*").alias("cnt")).where("cnt > 1"))
    if again.isEmpty():
        return _parsed(rows)
    one = rows.join(again, named, "left_semi").groupBy(*named).agg(F.first("text").alias("text"))
    parsed = stored(_parsed(stored(rows.join(again, named, "left_anti").unionByName(one), "zstd")))
    key = F.xxhash64(F.coalesce("doc_id", F.lit(NO_ID)), "tie").alias("_key")
    each = rows.select(*named).join(again, named, "left_semi").select(key)
    digests = parsed.join(again.withColumn("doc_id", F.nullif(F.col("doc_id"), F.lit(NO_ID))).select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie")), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie")), "left_semi")
    back = hot_join(each, digests.select(key, "*"), "_key", again.select(key, "cnt")).drop("_key")
    whole = parsed.join(digests.select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie")), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie")), "left_anti")
    return whole.unionByName(back)


def _parsed(rows: DataFrame) -> DataFrame:
    """``substring_duplicates`` of rows(doc_id, tie, text), no two of them equal."""
    seeds = rows.mapInArrow(tidied(_seeds), "seed long, span long, doc_id long, tie long, at int")
    counts = stored(seeds.groupBy("seed").agg(F.count("*").alias("cnt")).where("cnt > 1"))
    repeated = stored(hot_join(seeds, counts.withColumn("again", F.lit(True)).drop("cnt"), "seed", counts).where("again").drop("again"))
    # where all runs of a seed are equal, the first is the source of all; elsewhere windows decide
    first = stored(repeated.groupBy("seed").agg((F.min("span") == F.max("span")).alias("one"), F.min(F.struct("doc_id", "tie", "at")).alias("f")))
    runs = hot_join(repeated.select("seed", "doc_id", "tie", "at"), first, "seed", counts).where("not one or f.doc_id <> doc_id or f.tie <> tie or f.at <> at")
    place = F.struct(F.col("at").alias("place"), *(F.expr(f"if(one, f.{x}, null)").alias(y) for x, y in (("doc_id", "source"), ("tie", "source_tie"), ("at", "source_at"))))
    places = runs.groupBy("doc_id", "tie").agg(F.collect_list(place).alias("places"))
    split = rows.join(places, ["doc_id", "tie"], "left").mapInArrow(tidied(_split), f"{PARSED}, text string, places {_PLACES}")
    split = stored(split, "zstd", free=(repeated, first, counts))
    open_ = split.where("places is not null").select("doc_id", "tie", "text", "places")
    windows = open_.mapInArrow(tidied(_windows), "value long, doc_id long, tie long, at int")
    first = windows.groupBy("value").agg(F.min(F.struct("doc_id", "tie", "at")).alias("f"), F.count("*").alias("cnt")).where("cnt > 1")
    first = stored(first.select("value", F.col("f.doc_id").alias("source"), F.col("f.tie").alias("source_tie"), F.col("f.at").alias("source_at"), "cnt"))
    known = hot_join(windows, first.drop("cnt"), "value", first.select("value", "cnt"))
    later = known.where("doc_id <> source or tie <> source_tie or at <> source_at")
    window = F.struct(F.col("at").alias("start"), "source", "source_tie", "source_at")
    found = stored(later.groupBy("doc_id", "tie").agg(F.collect_list(window).alias("found")), free=(first,))
    parsed = open_.join(found, ["doc_id", "tie"], "left").mapInArrow(tidied(_parse), PARSED)
    ready = split.where("places is null").drop("text", "places")
    return parsed.unionByName(ready).withColumn("doc_id", F.nullif(F.col("doc_id"), F.lit(NO_ID)))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_duplicates(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")
