"""Operator 12, language ID: multinomial naive Bayes over hashed character n-grams.

A text is read as lower-case letters and marks; every other run of characters
is one space, and one space stands before the text.  Its features are all
n-grams of 1 to ``ORDERS`` of these characters, hashed to ``BUCKETS`` buckets
for each order's own multiplier.

Training covers every labelled document that is not held out: a task adds up
its documents in one dense row of counts a language and gives the buckets that
are not zero, Spark sums them, and the model is a matrix of log probabilities
(additive smoothing ``SMOOTH``) and the log shares of the languages.  What reaches the driver,
and is broadcast, is languages x BUCKETS numbers: 128 KB a learned language,
however large the input.

Scoring: a slice of documents becomes a sparse count matrix (document, bucket,
by sorting), which is multiplied with the log probabilities.  ``score`` is the posterior
probability of the predicted language.

doc_id, lang and source are never inputs of a prediction.  A text that is null or has no
letter is ``und`` with score 0, and so is every text where nothing was learned.  A null doc_id counts as crc32 of an empty text.
In training, texts without a letter name no new language, and add nothing to one but
their n-grams (a space).
Equal texts have equal predictions; repeated rows count as often as they stand;
ties go to the first language by code point.  Very long texts are read whole,
``PIECE`` bytes at a time, and n-grams across pieces count too.  Extra columns
are ignored by the query and kept by ``predict``.
"""

from __future__ import annotations

import sys
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm import words as W
from gaugeworks.llm.spark_tools import documents, tidied

ORDERS, BITS, SMOOTH = 3, 15, 0.5
BUCKETS = 1 << BITS
#: Bytes of text, and documents, that are in work at a time; row * BUCKETS fits 31 bits.
PIECE, SLICE_ROWS = 1 << 19, 1 << 14
UNKNOWN = "und"
#: No plane above the third has letters.
LAST_LETTER = 0x3FFFF
_MULTIPLIER = (W.mix(np.arange(1, ORDERS + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


@cache
def _folds() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: what it is read as (lower case, or a space), and whether it is a letter."""
    read, letter = np.full(sys.maxunicode + 1, 32, dtype=np.uint32), np.zeros(sys.maxunicode + 1, dtype=bool)
    for c in range(LAST_LETTER + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LM":
            low = chr(c).lower()
            read[c], letter[c] = ord(low) if len(low) == 1 else c, kind == "L"
    return read, letter


def _codes(raw: np.ndarray) -> np.ndarray:
    return np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)


def _grams(codes: np.ndarray, owner: np.ndarray, fresh: int = 0) -> np.ndarray:
    """owner * BUCKETS + bucket of all n-grams that end at ``fresh`` or later."""
    sums, found = codes * _MULTIPLIER[0], []
    for n in range(1, ORDERS + 1):
        if n > 1:
            sums = sums[:-1] * _MULTIPLIER[n] + codes[n - 1 :]
        inside = owner[n - 1 :] == owner[: len(owner) - n + 1]
        if fresh:
            inside &= np.arange(n - 1, len(owner)) >= fresh
        found.append((owner[n - 1 :] * np.int32(BUCKETS) + ((sums * _MULTIPLIER[ORDERS]) >> np.uint32(32 - BITS)).astype(np.int32))[inside])
    return np.concatenate(found)


def _read(codes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Drop the spaces that follow a space of the same text."""
    kept = np.ones(len(codes), dtype=bool)
    kept[1:] = (codes[1:] != 32) | (codes[:-1] != 32) | (owner[1:] != owner[:-1])
    return codes[kept], owner[kept]


def _long(raw: np.ndarray) -> Iterator[tuple[np.ndarray, bool]]:
    """(buckets, has a letter) of one text, piece by piece."""
    tail, fresh, at = np.array([32], dtype=np.uint32), 0, 0  # the space before the text counts
    read, letter = _folds()
    while at < len(raw):
        end = min(at + PIECE, len(raw))
        while end < len(raw) and raw[end] & 0xC0 == 0x80:
            end += 1
        new = _codes(raw[at:end])
        codes = np.concatenate([tail, read[new]])
        codes, owner = _read(codes, np.zeros(len(codes), dtype=np.int32))
        yield _grams(codes, owner, fresh), bool(letter[new].any())
        tail = codes[-(ORDERS - 1) :]
        fresh, at = len(tail), end


def features(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, row * BUCKETS + bucket of every n-gram, for each row whether it has a letter) of slices of a string column.

    Null is empty.  A text of over PIECE bytes stands alone and comes in pieces.
    """
    column = W.text_array(column)
    if not len(column):
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    edges = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = column.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8) if held is not None and held.size else np.zeros(0, dtype=np.uint8)
    read, letter = _folds()
    row = 0
    while row < len(column):
        stop = int(np.searchsorted(edges, edges[row] + PIECE, side="right")) - 1
        stop = min(max(stop, row + 1), row + SLICE_ROWS, len(column))
        part = data[edges[row] : edges[stop]]
        n = stop - row
        if len(part) > PIECE:
            for grams, has_letter in _long(part):
                yield row, grams, np.array([has_letter])
        else:
            leads = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])[edges[row : stop + 1] - edges[row]]
            source = np.repeat(np.arange(n, dtype=np.int32), np.diff(leads))
            raw = _codes(part)
            codes, owner = np.full(len(raw) + n, 32, dtype=np.uint32), np.repeat(np.arange(n, dtype=np.int32), np.diff(leads) + 1)
            codes[np.arange(len(raw)) + source + 1] = read[raw]
            yield row, _grams(*_read(codes, owner)), np.bincount(source[letter[raw]], minlength=n) > 0
        row = stop


@dataclass
class Model:
    langs: list[str]
    log_probability: np.ndarray  # (languages, BUCKETS)
    log_share: np.ndarray

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of the language, -1 where there is none; posterior) of every text."""
        best, score = np.full(len(column), -1, dtype=np.int64), np.zeros(len(column))
        if not self.langs:
            return best, score
        logits, lettered = np.tile(self.log_share, (len(column), 1)), np.zeros(len(column), dtype=bool)
        for row, grams, has_letter in features(column):
            grams.sort()
            ends = np.append(np.flatnonzero(grams[1:] != grams[:-1]), len(grams) - 1) if len(grams) else np.zeros(0, dtype=np.int64)
            who, bucket, counts = grams[ends] >> BITS, grams[ends] & (BUCKETS - 1), np.diff(ends, prepend=-1).astype(np.float64)
            here = slice(row, row + len(has_letter))
            for k in range(len(self.langs)):
                logits[here, k] += np.bincount(who, weights=counts * self.log_probability[k][bucket], minlength=len(has_letter))
            lettered[here] |= has_letter
        top = logits.argmax(1)
        chance = 1 / np.exp(logits - logits[np.arange(len(top)), top][:, None]).sum(1)
        return np.where(lettered, top, -1), np.where(lettered, chance, 0.0)


COUNTS = "lang string, bucket int, n long, docs long"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task by language and bucket; a row of bucket -1 has the documents."""
    sums: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(BUCKETS, dtype=np.int64))
    docs: dict[str, int] = defaultdict(int)
    for batch in batches:
        codes = batch.column("lang").dictionary_encode()
        langs, code = codes.dictionary.to_pylist(), codes.indices.to_numpy().astype(np.int32)
        total, lettered = np.zeros(len(langs) * BUCKETS, dtype=np.int64), np.zeros(batch.num_rows, dtype=bool)
        for row, grams, has_letter in features(batch.column("text")):
            mine = code[row : row + len(has_letter)]
            total += np.bincount(mine[grams >> BITS] * np.int64(BUCKETS) + (grams & (BUCKETS - 1)), minlength=len(total))
            lettered[row : row + len(has_letter)] |= has_letter
        for k, n in enumerate(np.bincount(code[lettered], minlength=len(langs)).tolist()):
            sums[langs[k]] += total[k * BUCKETS : (k + 1) * BUCKETS]
            docs[langs[k]] += n
    for lang, total in sums.items():
        if docs[lang]:
            bucket = np.flatnonzero(total)
            columns = [pa.array([lang] * (len(bucket) + 1)), pa.array(np.append(bucket, -1).astype(np.int32)), pa.array(np.append(total[bucket], 0)), pa.array(np.append(np.zeros(len(bucket), np.int64), docs[lang]))]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "bucket", "n", "docs"])


def learn(labelled: DataFrame) -> Model:
    """A model of (text, lang); rows without a language or without a letter teach nothing."""
    rows = labelled.where("lang is not null and text is not null").select("text", F.col("lang").cast("string").alias("lang"))
    sums = rows.mapInArrow(tidied(_counted), COUNTS).groupBy("lang", "bucket").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).toArrow()
    lang, bucket, n, docs = (sums.column(c).to_numpy(zero_copy_only=False) for c in ("lang", "bucket", "n", "docs"))
    langs = sorted(set(lang))
    number = np.searchsorted(np.array(langs, dtype=object), lang) if langs else np.zeros(0, dtype=np.int64)
    counts, share = np.zeros((len(langs), BUCKETS)), np.zeros(len(langs))
    real = bucket >= 0
    counts[number[real], bucket[real]] = n[real]
    share[number[~real]] = docs[~real]
    log_probability = np.log(counts + SMOOTH) - np.log(counts.sum(1, keepdims=True) + SMOOTH * BUCKETS)
    return Model(langs, log_probability.astype(np.float32), np.log(share / max(1.0, share.sum())))


def predict(docs: DataFrame, model: Model, column: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score, in place of columns of these names; no shuffle, and only the text goes to the workers."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    @tidied
    def judged(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = shared.value
        names = pa.array([*known.langs, UNKNOWN])
        for texts in columns:
            best, score = known.predict(texts)
            yield pa.StructArray.from_arrays([names.take(pa.array(np.where(best < 0, len(known.langs), best))), pa.array(score)], names=["lang_pred", "score"])

    found = docs.withColumn("_judged", judged(F.col(column)))
    return found.withColumns({"lang_pred": F.col("_judged.lang_pred"), "score": F.col("_judged.score")}).drop("_judged")


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held = F.expr("pmod(crc32(cast(coalesce(cast(doc_id as string), '') as binary)), 3) = 1")
    model = learn(docs.where(~held))
    return predict(docs.select("doc_id", held.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
