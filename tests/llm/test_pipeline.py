"""The corpus pipeline, stage by stage, against brute force on what each stage was given."""

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from gaugeworks.llm import token_shards

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def write_tables(spark, folder):
    rng = random.Random(11)
    words = [f"{a}{b}" for a in "ka lo mi nu pe ra si to".split() for b in "ban den fil gor hum jat".split()]
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    items = [" ".join(rng.choice([f"quiz{k}" for k in range(300)]) for _ in range(40)) for _ in range(3)]
    texts = []
    for i in range(600):
        w = prose(rng.choice((20, 60, 200)))
        if i % 4 == 0:
            w[rng.randrange(len(w))] = "zwirk" + rng.choice(words)
        texts.append(" ".join(w))
    texts += [texts[4 * i + 1] + " " + rng.choice(words) for i in range(20)]
    texts += [" ".join([*prose(30), items[i % 3], *prose(30)]) for i in range(10)]
    texts += [None, "", "short"]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)], "doc_id long, toxic int").withColumn("quality", F.lit(1)).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, items


def least_of_groups(rows):
    sets = []
    for _, text in rows:
        w = WORD.findall((text or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))})
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return set(least.values())


def test_every_stage(spark, tmp_path, monkeypatch):
    rows, items = write_tables(spark, tmp_path)
    given = []

    def spied(f):
        return lambda s, docs, d: (given.append((sorted(docs.columns), [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])), f(s, docs, d))[1]

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(name, spied(f)) for name, f in corpus_pipeline.STAGES])
    tokens = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert all(columns == ["doc_id", "lang", "n_chars", "source", "text"] for columns, _ in given)
    start, clean, single, decontaminated, mixed = (found for _, found in given)
    assert {doc: text for doc, text in start} == {r[0]: r[1] for r in rows} and len(start) == len(rows)

    harmless = {r[0] for r in rows if "zwirk" not in (r[1] or "")}
    left = {doc for doc, _ in clean}
    assert len(harmless & left) >= 0.99 * len(harmless) and len(left - harmless) <= 0.05 * 150

    assert sorted(doc for doc, _ in single) == sorted(least_of_groups(clean))

    leaked = {doc for doc, text in single if any(x in (text or "") for x in items)}
    assert leaked and {doc for doc, _ in decontaminated} == {doc for doc, _ in single} - leaked

    copies = Counter(doc for doc, _ in mixed)
    assert max(copies.values()) <= 2 and set(mixed) <= set(decontaminated)

    assert sorted(r["slot"] for r in tokens) == list(range(len(tokens)))
    parts = {}
    for r in tokens:
        parts.setdefault((r["doc_id"], r["part"]), []).append(np.frombuffer(r["tokens"], dtype="<u2")[: r["n_tokens"]].tolist())
    assert {k: len(v) for k, v in parts.items()} == {k: copies[k[0]] for k in parts} and {doc for doc, _ in parts} == set(copies)
    decode, ids = token_shards.tokenizer(token_shards.VOCABULARY), {}
    for (doc, _), found in sorted(parts.items()):
        assert all(x == found[0] for x in found)
        ids.setdefault(doc, []).extend(found[0])
    assert {doc: decode.decode(x[:-1]) for doc, x in ids.items()} == {doc: text or "" for doc, text in mixed}


def test_odd_rows(spark, tmp_path):
    """Nulls in any column, repeated rows, ties, a long text, extra columns with the names that stages use; and empty tables."""
    rng = random.Random(5)
    prose = lambda n: " ".join(rng.choice("ka lo mi nu pe ra si to".split()) + str(rng.randrange(90)) for _ in range(n))
    long, one, two = prose(20_000), prose(50), prose(40)
    texts = [(1, one), (1, one), (1, one + " tail"), (2, one), (None, one), (None, two), (None, two), (3, None), (None, None), (4, ""), (5, long), (6, long + " more"), (7, two), (8, prose(30)), (8, prose(30))]
    names = ["_row", "_lower", "_lang", "_copy", "_own", "size", "tie", "sk", "score", "threshold", "u", "copies", "slot"]
    rows = [(i, t, None if k % 3 else "en", None if k % 4 else "s", None, *range(len(names))) for k, (i, t) in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names)
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame([(1, None, None), (None, 1, 1), (8, 1, 0), (8, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/a/labels.parquet")
    spark.createDataFrame([(1, None), (None, "words that stand nowhere at all")], "item_id long, text string").write.parquet(f"{tmp_path}/a/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/a/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, f"{tmp_path}/a")
        assert docs.columns == [x.split()[0] for x in schema.split(", ")] and docs.schema == spark.read.parquet(f"{tmp_path}/a/documents.parquet").schema
        kept.append([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert len(kept[0]) == len(texts)
    first = set(kept[1]) - {(7, two), (5, long), (3, None), (None, None), (4, ""), *texts[-2:]}
    assert len(kept[1]) == 8 and len(first) == 1 and first <= {(1, one), (1, one + " tail")}
    assert kept[2] != [] and sorted(map(str, kept[2])) == sorted(map(str, kept[1])) and all(text for _, text in kept[3])
    tokens = corpus_pipeline.run(spark, f"{tmp_path}/a").collect()
    assert sorted(r["slot"] for r in tokens) == list(range(len(tokens))) and tokens
    for table, columns in (("documents", schema), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], columns).write.parquet(f"{tmp_path}/b/{table}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0
