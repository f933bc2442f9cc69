"""Repeated rows, large families and very long texts, where shortcuts would show."""

import random
import re
import time

import numpy as np
from pyspark.sql import functions as F

from gaugeworks.llm import mixing, near_dedup, substring_dedup, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def families(rng, sizes, words=300, shared=0.83, edits=1):
    """Texts of families that share most of their words: alike inside at about 0.95, across below the bound."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for f, size in enumerate(sizes):
        mine = [*base[: int(words * shared)], *(f"f{f}.{rng.randrange(10**6)}" for _ in range(words - int(words * shared)))]
        for _ in range(size):
            text = list(mine)
            for _ in range(edits):
                text[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
            out.append((f, " ".join(text)))
    return out


def test_two_large_families_stay_two_components(spark, monkeypatch):
    rows = families(random.Random(4), (400, 320))
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string").repartition(4)
    for name, value in (("LEAF", 16), ("DEPTH", 3), ("GROUP_SETS", 64), ("BLOCK", 32)):
        monkeypatch.setattr(near_dedup, name, value)
    for parts in (64, 2):
        monkeypatch.setattr(near_dedup, "MOST_PARTS", parts)
        found = near_dedup.near_duplicates(docs).collect()
        assert {(rows[r["doc_id"]][0], r["component_id"]) for r in found} == {(0, 0), (1, 400)}, parts


def test_one_long_text_leaves_a_model(spark):
    rng = random.Random(6)
    words = [f"{a}{b}" for a in "ka lo mi nu pe".split() for b in "ban den fil gor".split()]
    rows = [(i, " ".join([*(rng.choice(words) for _ in range(20)), "zwirk" if i % 3 == 0 else ""]), "en") for i in range(300)]
    order = toxicity.hash_order(np.arange(300, dtype=np.int64))
    long = next(int(i) for i in np.argsort(order) if rows[int(i)][0] % 3)
    rows[long] = (long, " ".join(rng.choice(words) for _ in range(6000)), "en")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, max_words=5000)
    assert model is not None
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert np.mean([(scores[i] >= 0.7) == (i % 3 == 0) for i in range(300)]) > 0.95
    sizes = {1: 10, 2: 100, 3: 5, 4: 40}
    assert toxicity._fitting(np.array([2, 1, 4, 3]), sizes, 50).tolist() == [1, 4] and toxicity._fitting(np.array([2]), sizes, 50).tolist() == []


def test_repeated_rows_are_mixed_one_by_one(spark):
    """800 rows without an id, half of them one text: the words taken come near the target."""
    rng = random.Random(9)
    text = lambda: " ".join(f"w{rng.randrange(1000)}" for _ in range(100))
    same = text()
    rows = [(None, same, "b") for _ in range(400)] + [(None, text(), "b") for _ in range(400)] + [(i, text(), "a") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    for _ in range(2):
        found = mixing.copies(docs).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.max("target").alias("target"), F.max("copies").alias("most"), F.count("*").alias("n")).collect()
        assert {r["source"]: r["n"] for r in found} == {"a": 300, "b": 800}
        assert all(abs(r["taken"] - r["target"]) <= 100 and r["most"] <= 2 for r in found)
    counts = [r["copies"] for r in mixing.copies(docs).where(F.col("text") == same).collect()]
    assert len(set(counts)) == 2  # some of the copies are taken once more than others


def plain_removed(rows):
    """{(doc_id, text): words kept} by a table of first places; rows of one id and text are one document."""
    documents = sorted({(d is not None, d or 0, t) for d, t in rows}, key=lambda r: r[:2])  # null ids first
    assert len({r[:2] for r in documents}) == len(documents)
    first, kept = {}, {}
    for some, d, t in documents:
        w = WORD.findall(t)
        gone = set()
        for k in range(len(w) - 19):
            window = tuple(w[k : k + 20])
            if first.setdefault(window, (some, d, k)) != (some, d, k):
                gone.update(range(k, k + 20))
        kept[d if some else None, t] = len(gone)
    return kept


def test_repeats_of_a_text_are_parsed_once(spark):
    rng = random.Random(3)
    text = lambda n: " ".join(f"w{rng.randrange(10**5)}" for _ in range(n))
    a, b = text(300), text(120)
    rows = [(None, a)] * 40 + [(1, b + " " + a[:700]), (2, b)] + [(5, b)] * 30 + [(6, text(50))]
    got = substring_dedup.substring_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    want = plain_removed(rows)
    by_id = {d: n for (d, _), n in want.items()}
    assert len(got) == len(rows) and all(r["n_removed"] == by_id[r["doc_id"]] for r in got) and by_id[5] == 120

    def seconds(n):
        docs = spark.createDataFrame([(None, a)] * n + [(i, text(40)) for i in range(20)], "doc_id long, text string").repartition(4)
        began = time.monotonic()
        assert substring_dedup.substring_duplicates(docs).count() == n + 20
        return time.monotonic() - began

    seconds(10)
    assert seconds(4000) < 3 * seconds(250) + 5
