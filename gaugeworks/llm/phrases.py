"""Operator 13, phrase collocation mining by pivot partitioning, as in MG-FSM.

Texts are lower-cased (A-Z), cut into pieces at ``. , ; : ! ?`` and the line
breaks 10 to 13, and pieces into words at spaces and tabs.  A phrase's pivot
is its rarest word, the leftmost one if it stands there repeatedly.

1. Words are counted by language, summed up by slice before they travel.
2. Every word occurrence that can be a pivot sends one fragment to its word's
   place: itself with up to four words on either side, as far as those are
   frequent and more frequent than it (to the right: or the same word).  So
   each occurrence of each phrase of 2 to 5 frequent words lies in one fragment
   around one pivot, and in no other.  Equal fragments of a slice travel once.
3. A place counts the phrases around its pivot and gives those that stand
   ``least`` times.  A pivot of over ``PER_PLACE`` occurrences is dealt over
   more places by a hash of the fragment; these give all their sums, which are
   added up before the limit is applied.
4. Cuts, scores, the rule on longer phrases and the ranking are joins and
   windows over the phrases found.

What orders words by frequency is a table of 2**bits sums: the occurrences of
the frequent words of each hash bucket.  bits grows with the number of frequent
words up to ``MOST_BITS`` (128 MB), whatever the vocabulary: any fixed order of
words gives the same phrases, and buckets shared by words cost only time.  A
word whose bucket is empty is rare for certain.

Rows with null text have no words; a null language is ``und`` and joins a
language of that name.  Repeated rows count as often as they stand.  Long texts
are read whole, and no piece is ever cut; words next to each other
are equal by their bytes, and within a task sequences are equal by a 64-bit
hash.  Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.llm import words as W
from gaugeworks.llm.spark_tools import documents, hot_join, release, stored, tidied

LEAST, LONGEST, TOP = 100, 5, 2000
MOST_BITS, PER_PLACE = 24, 1 << 18
SLICE_BYTES, CHUNK_ROWS = 1 << 21, 100_000
#: First places of the ranking by language, so that a hot language is not one task.
SALTS = 64

_BREAK = np.zeros(256, dtype=bool)
_BREAK[[*b".,;:!?", *range(10, 14)]] = True
_PARTING = _BREAK.copy()
_PARTING[[32, 9]] = True
_SPACE = np.zeros(256, dtype=bool)
_SPACE[32] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
COUNTED = "lang string, word string, key long, n long"
FRAGMENT = "lang string, place long, left_words int, fragment string, n long, split boolean"
FOUND = "lang string, phrase string, n_words int, a long, split boolean"


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[W.Words, np.ndarray, pa.Array, np.ndarray]]:
    """(words, key of each, language codes' names, code of each word's language)."""
    coded = batch.column("lang").dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)
    seeds = batch.column("seed").to_numpy().view(np.uint64)
    for w in W.scan(batch.column("text"), lower=True, size=SLICE_BYTES, parting=_PARTING):
        if len(w.value):
            rows = np.repeat(np.arange(w.row0, w.row0 + len(w.counts)), w.counts)
            yield w, W.mix(w.value + seeds[rows]), coded.dictionary, codes[rows]


def _texts(docs: DataFrame) -> DataFrame:
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    return docs.where("text is not null").select(lang.alias("lang"), F.xxhash64(lang).alias("seed"), "text")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for w, keys, langs, codes in _slices(batch):
            found, at, n = np.unique(keys, return_index=True, return_counts=True)
            words = pa.array(W.strings(w, at), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(codes[at])), words, pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "word", "key", "n"])


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, key, n) of all words of (text, lang)."""
    return _texts(docs).mapInArrow(tidied(_counted), COUNTED).groupBy("lang", "word", "key").agg(F.sum("n").alias("n"))


def _order(frequent: DataFrame) -> np.ndarray:
    """Occurrences of the frequent words of each bucket; the number of buckets is bounded by MOST_BITS."""
    bits = min(MOST_BITS, max(10, int(frequent.count() * 8).bit_length()))
    bucket = F.shiftrightunsigned("key", 64 - bits).alias("bucket")
    sums = frequent.groupBy(bucket).agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(1 << bits, dtype=np.int64)
    table[sums.column("bucket").to_numpy()] = sums.column("n").to_numpy()
    return table


def _contexts(keys: np.ndarray, share: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many words to the left and right of each word its fragment has; 0 and 0 for words that are rare."""
    n = len(keys)
    left, right = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    go_left, go_right = share > 0, share > 0
    for d in range(1, min(LONGEST, n)):
        a, b = slice(None, -d), slice(d, None)  # a stands d words before b
        same = (piece[a] == piece[b]) & (share[a] > 0)
        more = (share[a] > share[b]) | ((share[a] == share[b]) & (keys[a] > keys[b]))  # a is the more frequent one
        go_left[:d] = False
        go_left[d:] &= same & more
        go_right[n - d :] = False
        go_right[: n - d] &= same & ~more & (share[b] > 0)
        left += go_left
        right += go_right
    return left, right


def _joined(w: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of a slice behind each other, a space after each, and their new bounds."""
    size = w.end - w.start
    start = np.cumsum(size + 1) - (size + 1)
    data = np.full(int((size + 1).sum()), 32, dtype=np.uint8)
    data[W.spans(start, size)] = w.data[W.spans(w.start, size)]
    return data, start, start + size


def _substrings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    size = end - start
    body = data[W.spans(start, size)]
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(size), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(body.tobytes())])


def fragments(docs: DataFrame, table: np.ndarray) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = shared.value
        shift = np.uint64(64 - (len(sums).bit_length() - 1))
        for batch in batches:
            for w, keys, langs, codes in _slices(batch):
                share = sums[(keys >> shift).astype(np.int64)]
                breaks = np.concatenate([[0], np.cumsum(_BREAK[w.data])])
                new = np.ones(len(keys), dtype=bool)
                new[1:] = breaks[w.start[1:]] > breaks[w.end[:-1]]
                new[w.first[:-1][w.counts > 0]] = True
                left, right = _contexts(keys, share, np.cumsum(new))
                at = np.flatnonzero(left + right)
                if not len(at):
                    continue
                lo, hi = at - left[at], at + right[at]
                value = W.mix(W.runs(w, lo, hi - lo + 1) + keys[at] * np.uint64(2) + left[at].astype(np.uint64))
                value, first, n = np.unique(value, return_index=True, return_counts=True)
                at, lo, hi = at[first], lo[first], hi[first]
                places = 1 + share[at] // PER_PLACE
                place = W.mix(keys[at] + (value % places.astype(np.uint64)) * _ODD)
                data, start, end = _joined(w)
                columns = [langs.take(pa.array(codes[at])), pa.array(place.view(np.int64)), pa.array(left[at].astype(np.int32)), _substrings(data, start[lo], end[hi]), pa.array(n.astype(np.int64)), pa.array(places > 1)]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "place", "left_words", "fragment", "n", "split"])

    return _texts(docs).mapInArrow(tidied(cut), FRAGMENT)


def _mine(rows: pa.Table, least: int) -> Iterator[pa.RecordBatch]:
    """Phrases around the pivots of whole places."""
    rows = rows.combine_chunks()
    coded = rows.column("lang").combine_chunks().dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.uint64)
    n, split = rows.column("n").to_numpy(), rows.column("split").to_numpy(zero_copy_only=False)
    w = next(W.scan(rows.column("fragment").combine_chunks(), size=1 << 40, parting=_SPACE))
    left = rows.column("left_words").to_numpy().astype(np.int64)
    right, pivot = w.counts - 1 - left, w.first[:-1] + left
    for a in range(LONGEST):
        for b in range(LONGEST - a):
            mine = np.flatnonzero((left >= a) & (right >= b)) if a + b else []
            if not len(mine):
                continue
            size = np.full(len(mine), a + b + 1)
            value = W.mix(W.runs(w, pivot[mine] - a, size) + (codes[mine] * np.uint64(2) + split[mine]) * _ODD)
            order = np.argsort(value, kind="stable")
            value = value[order]
            begin = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
            total, some = np.add.reduceat(n[mine][order], begin), mine[order[begin]]
            kept = (total >= least) | split[some]
            total, some = total[kept], some[kept]
            if len(some):
                phrase = _substrings(w.data, w.start[pivot[some] - a], w.end[pivot[some] + b])
                columns = [coded.dictionary.take(pa.array(codes[some].astype(np.int64))), phrase, pa.array(np.full(len(some), a + b + 1, np.int32)), pa.array(total), pa.array(split[some])]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "n_words", "a", "split"])


def frequent_phrases(docs: DataFrame, words: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, phrase, n_words, a): phrases of 2 to LONGEST words that stand ``least`` times; ``words`` as of ``word_counts``."""

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= CHUNK_ROWS:
                table = pa.Table.from_batches(held)
                places = table.column("place").to_numpy()
                cut = int(np.searchsorted(places, places[-1], side="left"))
                if cut:
                    yield from _mine(table.slice(0, cut), least)
                    held = table.slice(cut).to_batches()
                    rows -= cut
        if rows:
            yield from _mine(pa.Table.from_batches(held), least)

    table = _order(words.where(F.col("n") >= least))
    found = fragments(docs, table).repartition("place").sortWithinPartitions("place").mapInArrow(tidied(mine), FOUND)
    found = stored(found)
    parts = found.where("split").groupBy("lang", "phrase", "n_words").agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    whole = stored(found.where("not split").drop("split").unionByName(parts), free=(found,))
    return whole


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases that no longer one stands for."""
    words = stored(word_counts(docs))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    phrases = frequent_phrases(docs, words, least)
    # a longer phrase that stands as often passes this on to all its parts, so one word more is enough
    longer = phrases.where("n_words > 2").select("lang", "a", F.explode(F.array(F.expr("substring_index(phrase, ' ', n_words - 1)"), F.expr("substring_index(phrase, ' ', 1 - n_words)"))).alias("phrase"))
    kept = phrases.join(longer.distinct(), ["lang", "phrase", "a"], "left_anti")
    known = words.where(F.col("n") >= least).select("lang", F.col("word").alias("part"), F.col("n").alias("f"))
    known = known.unionByName(phrases.where(F.col("n_words") < LONGEST).select("lang", F.col("phrase").alias("part"), F.col("a").alias("f")))
    cuts = kept.select("lang", "phrase", "a", "n_words", F.explode(F.expr("sequence(1, n_words - 1)")).alias("k"))
    cuts = cuts.withColumns({"first": F.expr("substring_index(phrase, ' ', k)"), "rest": F.expr("substring_index(phrase, ' ', k - n_words)")})
    cuts = cuts.join(known.select("lang", F.col("part").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(known.select("lang", F.col("part").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    cuts = hot_join(cuts.select("lang", "phrase", "a", "k", "l", "r"), totals, "lang", cuts.groupBy("lang").agg(F.count("*").alias("cnt")))
    wide = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "l", "r", "n")}
    score = F.expr("(cast(1000 as decimal(4,0)) * wide_a * wide_n) div (wide_l * wide_r)")
    scored = cuts.withColumns({f"wide_{c}": v for c, v in wide.items()}).withColumn("score", score)
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    best = best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    by = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    first = best.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = first.withColumn("_place", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*by))).where(F.col("_place") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by)).cast("long")).where(F.col("rank") <= top)
    out = stored(ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
    release(words, phrases)
    return out


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


ORACLE = r"""
with texts as (select row_number() over () as id, coalesce(lang, 'und') as lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents where text is not null),
pieces as (select lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') as w from (select lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) as p from texts)),
starts as (select lang, w, unnest(range(1, len(w) + 1)) as s from pieces),
grams as (select lang, m, array_to_string(w[s:s + m - 1], ' ') as phrase, w[s:s + m - 1] as words from (select lang, w, s, unnest(range(1, least(5, len(w) - s + 1) + 1)) as m from starts)),
f as (select lang, m, phrase, any_value(words) as words, count(*) as a from grams group by lang, m, phrase),
n as (select lang, sum(a) as n from f where m = 1 group by lang),
often as (select * from f where a >= 100),
longer as (select distinct lang, a, unnest([array_to_string(words[1:m - 1], ' '), array_to_string(words[2:m], ' ')]) as phrase from often where m > 2),
cuts as (select lang, phrase, a, k, array_to_string(words[1:k], ' ') as head, array_to_string(words[k + 1:m], ' ') as rest
 from (select *, unnest(range(1, m)) as k from often where m > 1) c where not exists (select 1 from longer g where g.lang = c.lang and g.phrase = c.phrase and g.a >= c.a)),
scored as (select c.lang, c.phrase, c.a, c.k, l.a as l, r.a as r, n.n, (1000::hugeint * c.a * n.n) // (l.a::hugeint * r.a) as score
 from cuts c join often l on l.lang = c.lang and l.phrase = c.head join often r on r.lang = c.lang and r.phrase = c.rest join n on n.lang = c.lang),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1)
select lang, cast(row_number() over (partition by lang order by score desc, a desc, phrase) as bigint) as rank, phrase, cast(a as bigint) as a, cast(l as bigint) as l, cast(r as bigint) as r, cast(n as bigint) as n, cast(score as bigint) as score
from best qualify rank <= 2000"""
