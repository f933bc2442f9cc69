"""The training-data operators against brute force, on small tables with nulls, ties, repeats, long texts and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import decontaminate, html_text, media, mixing, near_dedup, sharding, substring_dedup, token_shards, toxicity, warc
from gaugeworks.llm.feistel import Feistel
from gaugeworks.llm.spark_tools import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, tie string, score string"


def corpus(n=60, seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" if i % 9 == 0 else f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice((3, 30, 80, 160)))) for _ in range(n)]
    base = texts[7] = " ".join(rng.choice(vocabulary) for _ in range(200))
    for i in range(10, 16):  # near copies, some beyond the bound
        words = base.split()
        for _ in range(i - 9):
            words[rng.randrange(len(words))] = "edited"
        texts[i] = " ".join(words)
    shared = " ".join(rng.choice(vocabulary) for _ in range(25))
    for i in (20, 21, 22):
        texts[i] += "\n" + shared + " tail" + str(i)
    texts[30] = texts[31] = texts[7]
    texts[32] = texts[7].upper()
    texts += [None, "", " \t\n", "one", "One", "a a a a a " * 30, "x" * 300_000]
    rows = [(i, t, "en", f"s{i % 4}", None, "size", "tie", "score") for i, t in enumerate(texts)]
    return [*rows, rows[5], (None, "no id at all", None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("n", [1, 2, 5, 16, 17, 1000, 4097])
def test_feistel_is_a_keyed_permutation(n):
    f = Feistel(n, 9)
    image = f.permute(np.arange(n))
    assert sorted(image) == list(range(n)) and (f.inverse(image) == np.arange(n)).all()
    assert n < 16 or list(image) != list(Feistel(n, 10).permute(np.arange(n)))


def test_sharding(spark, docs, none):
    small = lambda d: d.select("doc_id", F.xxhash64("text").alias("tie"))
    rows = sharding.shard(small(docs), ["doc_id", "tie"], 8).collect()
    places = sorted((r["shard"], r["slot"]) for r in rows)
    sizes = [sum(s == k for s, _ in places) for k in range(8)]
    assert max(sizes) - min(sizes) <= 1 and places == [(k, i) for k in range(8) for i in range(sizes[k])]
    for r in rows[:20]:
        assert sharding.row_at(r["shard"], r["slot"], len(rows), 8, sharding.KEY) == r["row_number"]
    again = sharding.shard(small(docs.repartition(5)), ["doc_id", "tie"], 8).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert sharding.shard(small(none), ["doc_id", "tie"]).count() == 0


def shingles(text):
    w = WORD.findall((text or "").translate(LOW))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows):
    sets = [shingles(r[1]) for r in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                up[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted((str(r[0]), len(sets[i]), str(least.get(find(i)))) for i, r in enumerate(rows))


def test_near_duplicates(docs, none):
    rows = near_dedup.near_duplicates(docs).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in rows) == brute_components(corpus())
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    assert near_dedup.near_duplicates(none).count() == 0
    clash = docs.withColumns({x: F.lit(1) for x in ("_row", "_own", "sk", "_id", "_tie")})
    assert near_dedup.stage(clash).columns == clash.columns and near_dedup.stage(clash).count() == near_dedup.stage(docs).count()
    assert near_dedup.stage(none).count() == 0


def test_stage_keeps_one_row_of_each_group(spark):
    rng = random.Random(8)
    text = lambda: " ".join(rng.choice([f"w{i}" for i in range(400)]) for _ in range(60))
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(1, a), (1, a), (1, a), (2, a), (3, b), (3, b + " more"), (4, b), (None, c), (None, c), (None, c + " more"), (None, d), (9, d), (3, e), (7, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = [(r["doc_id"], r["text"]) for r in near_dedup.stage(docs).collect()]
    groups = {a: a, b: b, b + " more": b, c: c, c + " more": c, d: d, e: e, None: None, "": ""}
    assert len(kept) == 7 and {(i, groups[t]) for i, t in kept} == {(1, a), (3, b), (None, c), (9, d), (3, e), (7, None), (8, "")}


@pytest.mark.parametrize("parts", [64, 0])
def test_large_groups_are_decided_in_blocks(spark, docs, monkeypatch, parts):
    monkeypatch.setattr(near_dedup, "MOST_PARTS", parts)
    monkeypatch.setattr(near_dedup, "GROUP_SETS", 2)
    monkeypatch.setattr(near_dedup, "BLOCK", 2)
    monkeypatch.setattr(near_dedup, "LEADERS", 1)
    rows = near_dedup.near_duplicates(docs).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in rows) == brute_components(corpus())


@pytest.mark.parametrize("parts", [64, 0])
def test_large_group_with_many_apart(spark, monkeypatch, parts):
    """Candidates that fall short of the bound, in a chain: most of the group lies outside the first leader's component."""
    rng = random.Random(13)
    words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    texts = []
    for k in range(60):
        for _ in range(2 if k % 3 else 5):  # every third step is too far for a link, but not for the estimate
            words[rng.randrange(120)] = f"edit{k}.{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    for name, value in (("GROUP_SETS", 3), ("BLOCK", 4), ("LEADERS", 2), ("MOST_PARTS", parts)):
        monkeypatch.setattr(near_dedup, name, value)
    rows = [(i, t) for i, t in enumerate(texts)]
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute_components(rows)
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in found) == want and 3 < len({x[2] for x in want}) < 60


def test_nodes_of_different_members_are_all_compared(spark):
    hashes = np.array([r[0] for r in spark.range(4000).selectExpr("xxhash64(id) >> 24").collect()])
    a, b = np.triu_indices(4000, 1)
    sums = hashes[a] + hashes[b]
    order = np.argsort(sums, kind="stable")
    at = next(k for k in np.flatnonzero(np.diff(sums[order]) == 0) if len({a[order[k]], b[order[k]], a[order[k + 1]], b[order[k + 1]]}) == 4)
    pairs = [sorted((int(a[k]), int(b[k]))) for k in order[at : at + 2]]
    rows = [(sk, [key, key + 10], b"") for key, pair in enumerate(pairs) for sk in pair]
    (nodes,) = near_dedup._nodes(spark.createDataFrame(rows, "sk long, keys array<long>, sig binary"))
    assert sorted(r["sk"] for r in nodes.collect()) == sorted(sum(pairs, []))


def planted_pairs(n=150, seed=6):
    """(documents, pairs) with shingle sets at a similarity of 0.75 to 0.80."""
    rng, docs, pairs = random.Random(seed), [], []
    while len(pairs) < n:
        words = [f"w{rng.randrange(10**6)}" for _ in range(160)]
        other = list(words)
        for at in rng.sample(range(160), 4):
            other[at] = "edited"
        a, b = shingles(" ".join(words)), shingles(" ".join(other))
        if 0.75 <= len(a & b) / len(a | b) <= 0.80:
            pairs.append((len(docs), len(docs) + 1))
            docs += [" ".join(words), " ".join(other)]
    return docs, pairs


@pytest.mark.parametrize("leaf", [2048, 1])
def test_recall_near_the_bound_with_and_without_branching(spark, monkeypatch, leaf):
    monkeypatch.setattr(near_dedup, "LEAF", leaf)
    texts, pairs = planted_pairs()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs).collect()}
    recall = sum(found[b] == a for a, b in pairs) / len(pairs)
    assert recall >= 0.97 and all(found[a] == a for a, _ in pairs)


def test_large_nodes_that_no_branching_parts(spark, monkeypatch):
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    families = []
    for f in range(2):
        base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        for k in range(30):
            words = list(base)
            words[rng.randrange(400)] = f"edit{f}.{k}"
            families.append(" ".join(words))
    for name, value in (("LEAF", 4), ("DEPTH", 2), ("BLOCK", 4), ("LEADERS", 1)):
        monkeypatch.setattr(near_dedup, name, value)
    docs = spark.createDataFrame(list(enumerate(families)), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs).collect()} == {i: i // 30 * 30 for i in range(60)}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        up[max(find(a), find(b))] = min(find(a), find(b))
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long").repartition(7)).collect()))
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)} | {x: find(x) for x in got}


def brute_substrings(rows):
    """{(doc_id, text): (words, removed, sha256)} by every window's first place."""
    seen, want = {}, {}
    for doc, tie, text in rows:
        w = WORD.findall(text or "")
        keep = [True] * len(w)
        for k in range(len(w) - 19):
            place = seen.setdefault(tuple(w[k : k + 20]), (doc, tie, k))
            if place != (doc, tie, k):
                keep[k : k + 20] = [False] * 20
        kept = [x for x, y in zip(w, keep) if y]
        want[doc, tie] = (len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return want


def in_order(frame):
    """(doc_id, hash of text, text) of distinct rows: null ids first, then by id and hash."""
    rows = {(r[0], r[1]): r[2] for r in frame.select("doc_id", F.xxhash64("text"), "text").collect()}
    return [(*k, rows[k]) for k in sorted(rows, key=lambda k: (k[0] is not None, k[0] or 0, k[1]))]


def test_substring_duplicates(spark, docs, none):
    found = substring_dedup.substring_duplicates(docs).collect()
    assert {(r["doc_id"], r["tie"]): (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found} == brute_substrings(in_order(docs)) and len(found) == len(corpus())
    assert any(f["words"] >= 25 for r in found for f in r["factors"])
    assert substring_dedup.substring_duplicates(none).count() == 0


def test_factors_are_a_greedy_parse(spark):
    rng = random.Random(21)
    words = [f"w{i}" for i in range(3000)]
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    texts = [prose(80) for _ in range(6)]
    texts.append(texts[0][10:50] + texts[1][5:60] + prose(9) + texts[2][:30])  # two sources side by side
    texts.append(prose(5) + texts[6] + texts[3][40:])  # a copy of a copy
    texts.append(texts[4][:25] + texts[4][20:45])  # sources that overlap in the document's own windows
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: r for r in substring_dedup.substring_duplicates(docs).collect()}
    place = {}  # of every 20-word sequence, its first
    for i, w in enumerate(texts):
        for k in range(len(w) - 19):
            place.setdefault(tuple(w[k : k + 20]), (i, k))
    for i, w in enumerate(texts):
        repeated = {k: place[tuple(w[k : k + 20])] for k in range(len(w) - 19) if place[tuple(w[k : k + 20])] != (i, k)}
        want, at = [], 0
        while at < len(w):
            across = [k for k in range(max(0, at - 19), at) if k in repeated]
            if at in repeated:
                (source, k), n = repeated[at], 20  # as long as the source runs along in the reference
                while repeated.get(at + n - 19) == (source, k + n - 19):
                    n += 1
                want.append((at, n, source, k))
            elif across:
                source, k = repeated[across[-1]]
                n = across[-1] + 20 - at
                want.append((at, n, source, k + at - across[-1]))
            else:
                n = 1
            at += n
        assert [tuple(f) for f in found[i]["factors"]] == want
        assert sum(f[1] for f in want) == found[i]["n_removed"]
        assert all(w[a : a + n] == texts[s][k : k + n] for a, n, s, k in want)
    assert [f["source"] for f in found[6]["factors"]] == [0, 1, 2] and [f["source"] for f in found[7]["factors"]] == [0, 1, 6, 2, 3]
    assert any(f["words"] < 20 for f in found[7]["factors"])


def test_substrings_of_rows_that_share_a_doc_id(spark):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(5000)]
    shared = " ".join(rng.choice(words) for _ in range(45))
    texts = [f"{rng.choice(words)} {i} {shared} {rng.choice(words)} {i}" for i in range(1000)]
    long = " ".join(rng.choice(words) for _ in range(60_000))
    rows = [(None, t) for t in texts] + [(3, t + " more") for t in texts[:500]] + [(4, long), (5, long[100_000:] + " tail")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = {(r["doc_id"], r["tie"]): (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.substring_duplicates(docs).collect()}
    assert found == brute_substrings(in_order(docs)) and sum(r[1] > 0 for r in found.values()) == 1500


def test_decontamination(spark, docs, none):
    item = "the quick brown fox jumps over a lazy dog while seven wizards brew tea"
    edited = item.replace("brown", "red").replace("wizards", "witches")
    texts = {900: f"before {item} after", 901: f"x {edited.upper()}!! y", 902: "THE! QUICK!! " + item, 903: "seven wizards brew nothing", 904: None}
    more = spark.createDataFrame([(i, t, "en", "s", None, None, None, None) for i, t in texts.items()], SCHEMA)
    bench = spark.createDataFrame([(1, item), (2, None), (3, "too short"), (4, "")], "item_id int, text string")
    hits = decontaminate.contaminated(docs.unionByName(more), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in hits} == {(900, 1), (901, 1), (902, 1)}
    assert {r["doc_id"]: r["score"] for r in hits}[900] == 1.0 and all(0.5 <= r["score"] <= 1 for r in hits)
    assert {r["item_id"] for r in decontaminate.unseeded(bench).collect()} == {2, 3, 4}
    clash = docs.withColumns({"_lower": F.lit(1), "_row": F.lit(2)})
    assert decontaminate.stage(clash, bench).columns == clash.columns and decontaminate.stage(clash, bench).count() == docs.count()
    clean = decontaminate.stage(docs.unionByName(more), bench)
    assert clean.count() == docs.count() + 2 and clean.columns == docs.columns
    assert decontaminate.contaminated(none, bench).count() == 0 and decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_edited_copies_of_an_item_that_fills_the_corpus():
    import pyarrow as pa

    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    item = [rng.choice(words) for _ in range(40)]
    fifth = [f"new{k}" if k % 5 == 4 else x for k, x in enumerate(item)]
    apart = [y for k, x in enumerate(item) for y in ((x, "in", "between", "here") if k % 4 == 3 else (x,))]
    texts = [" ".join(item)] * 60 + [" ".join(fifth), " ".join(apart)] + [" ".join(rng.choice(words) for _ in range(200)) for _ in range(40)] + ["", " ".join([*item[:3], *words[:80]])]
    texts += [" ".join([*item[:13], *["far"] * 16, *item[13:26], *["off"] * 16, *item[26:]])]
    items = decontaminate.Items([7], [" ".join(item)])
    found = {r: f for r, _, *f in decontaminate._matcher(items)(pa.array(texts))}
    scores = [decontaminate.align(items.values[0], w.value[a:b])[0] / 80 for w in decontaminate.W.scan(pa.array(texts), letters=True) for a, b in zip(w.first[:-1], w.first[1:])]
    assert {60, 61, 104} <= set(found) and 102 not in found and 103 not in found
    assert {r: f[0] for r, f in found.items()} == {r: s for r, s in enumerate(scores) if s >= 0.5}


def test_edited_copies_stay_found_as_the_corpus_grows(spark):
    rng = random.Random(9)
    item = rng.sample([f"w{i}" for i in range(300)], 40)
    edited = " ".join("changed" if k % 5 == 4 else x for k, x in enumerate(item))
    texts = [" ".join(item)] * 2000 + [edited] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id int, text string")
    assert {r["doc_id"] for r in decontaminate.contaminated(docs, bench).collect()} == set(range(2003))
    assert decontaminate.stage(docs, bench).count() == 0


def test_alignment_equals_full_table():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = rng.integers(0, 6, 9), rng.integers(0, 6, 14)
        h = np.zeros((10, 15), dtype=int)
        for i in range(1, 10):
            for j in range(1, 15):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert decontaminate.align(a, b)[0] == h.max()


def test_warc_round_trip(spark, tmp_path):
    url, page = "http://a.example/x", "<html><title>T &amp; x</title><body><nav>menu</nav><p>Hello <a href='/y'>you</a></p></body></html>"
    record = warc.response(url, page.encode())
    for zipped in (False, True):
        raw = b"".join(warc.serialise(*r, compress=zipped) for r in (record, *warc.derive_one(*record)))
        back = list(warc.parse(raw))
        assert [b for _, b in back] == [record[1], *(b for _, b in warc.derive_one(*record))]
        (tmp_path / f"{zipped}.warc{'.gz' * zipped}").write_bytes(raw)
    with pytest.raises(ValueError):
        list(warc.parse(warc.serialise(*record)[:-30]))
    assert [warc.read_warc(spark, str(tmp_path / x)).count() for x in ("False.warc", "True.warc.gz")] == [3, 3]
    records = warc.read_warc(spark, str(tmp_path / "True.warc.gz"))
    made = warc.derive(records).collect()
    assert {r["record_type"] for r in made} == {"conversion", "metadata"} and {r["refers_to"] for r in made} == {record[0]["WARC-Record-ID"]}
    assert bytes(next(r["block"] for r in made if r["record_type"] == "conversion")).decode().split("\n") == ["menu", "Hello you"]
    notes = bytes(next(r["block"] for r in made if r["record_type"] == "metadata")).decode()
    assert "title: T & x\r\n" in notes and "outlink: /y\r\n" in notes and record[0]["WARC-Payload-Digest"] in notes
    members = warc.members(warc.derive(records)).orderBy("record_id").collect()
    assert sorted(h["WARC-Record-ID"] for h, _ in warc.parse(b"".join(bytes(m["member"]) for m in members))) == [m["record_id"] for m in members]
    pages = spark.createDataFrame([(1, None, None), (2, url, ""), (2, url, "")], "page_id long, url string, html string")
    assert warc.page_derivatives(pages).count() == 6 and warc.page_derivatives(pages.limit(0)).count() == 0


def test_no_value_starts_a_line_of_its_own(spark):
    page = '<title>T\r\nhttp-status: 500</title><a href="x&#13;&#10;http-status: 500">y</a><a href=/ok>z</a>'
    pages = spark.createDataFrame([(1, "http://a/\r\nWARC-Type: warcinfo", page)], "page_id long, url string, html string")
    for r in warc.page_derivatives(pages).collect():
        raw = warc.serialise(r["headers"], bytes(r["block"]))
        (headers, block), *rest = warc.parse(raw)
        assert not rest and headers["WARC-Type"] == r["record_type"] and headers["WARC-Target-URI"] == "http://a/%0D%0AWARC-Type: warcinfo"
        if r["record_type"] == "metadata":
            lines = block.decode().split("\r\n")
            assert [x for x in lines if x.startswith("http-status")] == ["http-status: HTTP/1.1 200 OK"] and "outlink: x%0D%0Ahttp-status: 500" in lines and "outlink: /ok" in lines


def test_bad_records_become_rows(spark, tmp_path):
    good, odd = warc.response("http://a/1", b"one\r\n\r\nWARC/1.1 in the text \xff\xfe"), warc.response("http://a/2", b"two")
    unnamed = {k: v for k, v in odd[0].items() if k != "WARC-Record-ID"}
    unsized = warc.serialise(*odd).replace(b"Content-Length: ", b"Content-Size: ")
    (tmp_path / "a.warc").write_bytes(warc.serialise(*good) + unsized + warc.serialise(unnamed, odd[1]) + warc.serialise(*good)[:-20])
    (tmp_path / "b.warc").write_bytes(warc.serialise(*good))
    (tmp_path / "c.warc").write_bytes(b"")
    rows = warc.read_warc(spark, str(tmp_path)).collect()
    whole = [r for r in rows if r["error"] is None]
    assert len(rows) == 5 and sorted(bytes(r["block"]) for r in whole) == sorted([good[1], odd[1], good[1]])
    assert sorted(r["error"].split(":")[0] for r in rows if r["error"]) == ["a record has no valid Content-Length", "a record is cut off"]
    made = warc.derive(warc.read_warc(spark, str(tmp_path))).collect()
    assert sorted(str(r["error"]) for r in made) == ["None"] * 4 + ["a response has no WARC-Record-ID"]


def test_hostile_pages_take_linear_time():
    import time

    began = time.monotonic()
    for page in ("<a " * 350_000, "<a href='" * 110_000, "<a '\">" * 140_000 + ">", "<div class=menu>t " * 50_000, "<nav>" * 200_000, "<div><" * 100_000):
        html_text.main_text(page)
        warc.derive_one(*warc.response("u", page.encode()))
    assert time.monotonic() - began < 30


PAGES = [
    (None, ""), ("", ""), ("<p>&amp;am", "&am"),
    ("<nav><a href=x>Menu</a></nav><article><h1>Head</h1><p>One\n two&nbsp;&lt;b&gt;<p>Three <b>x</b>y</article><footer>F</footer>", "Head One two <b> Three xy"),
    ("<article><p>Ti.<div class='ad'>Buy</div><p>End<section class=comments><p>First!</p></section></article>", "Ti. End"),
    ("<body><div id=cookie-notice>We use</div><main><form>Name <input></form><p>Body text</main><aside>Side</aside>", "Body text"),
    ("<article><p>cut off here <b>now</arti", "cut off here now"), ("<script>var t='<p>no</p>';</script><article><p>yes<!-- <p>no --></article>", "yes"),
    ("<div><a href=1>Home</a></div><div><a href=2>More</a></div><p>" + "long text " * 20 + "</p><p>" + "goes on " * 20 + "</p><div></div>", ("long text " * 20 + "goes on " * 20).strip()),
]


@pytest.mark.parametrize(("page", "want"), PAGES)
def test_main_text(page, want):
    assert html_text.main_text(page).replace("&am" if want == "&am" else "\0", "&am" if want == "&am" else "\0") in (want, "" if want == "&am" else want)


def test_surge_and_dive_choose_on_framed_pages():
    body = [f"Paragraph {k} of the main text, " + "which goes on for a while " * 8 for k in range(4)]
    main = "".join(f"<p>{x}</p>" for x in body)
    text = " ".join(x.strip() for x in body)
    teasers = "".join(f"<article><a href=/{k}>Teaser {k} of some other page with a long title</a></article>" for k in range(5))
    assert html_text.main_text(f"<div>{main}</div><div>{teasers}</div>") == text
    assert html_text.main_text(f"<article><h2>Short one</h2><p>Few words.</article><div>{main}</div>").endswith(text)
    # a real article stays whole, and short lines around it stay out
    assert html_text.main_text(f"<p>Skip to text</p><article><h1><a href=/>Head</a></h1>{main}<p>End.</article><p>Copyright, all rights</p>") == f"Head {text} End."
    assert html_text.main_text(f"<article>{main}<div class=ad><p>a<p>b<p>c<p>d</div><p>End.</article>") == f"{text} End."


@pytest.mark.parametrize("name", ["page with-sidebar", "no-ads", "comments-enabled", "related"])
def test_marked_wrappers_hold_the_page(name):
    text = "The main text goes on for a while. " * 9
    side, wrapped = "<div class=sidebar><p>" + "Side story. " * 5 + "</div>", text.strip()
    talk = "<section class=comments><p>" + "A long reply. " * 90 + "</section>"
    for inner in (f"<article><p>{text}</article>", f"<main><div class={name.split()[0]}></div><p>{text}</main>{talk}", f"<p>{text}</p>"):
        assert html_text.main_text(f"<nav>menu</nav><div class='{name}'>{inner}{side}</div><footer>end</footer>") == wrapped
    assert html_text.main_text(f"<div class='{name}'><div id=no-ads><p>{text}</p></div>{side}</div>") == wrapped
    teasers = "".join(f"<article><p>Teaser {k} with some words of its own</article>" for k in range(6))
    assert html_text.main_text(f"<p>{text}</p><div class=related>{teasers}</div>") == wrapped
    # marks of smaller parts and hidden elements stay
    assert html_text.main_text(f"<p>{text}</p><div class=related><p>Buy this</div>") == wrapped
    assert html_text.main_text(f"<div class='{name}' hidden><article><p>{text}</article></div>") == ""


def test_extract_frame(spark):
    pages = spark.createDataFrame([(1, "u", PAGES[3][0], 1), (None, None, None, 2)], "page_id long, url string, html string, text int")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.extract(pages).collect()}
    assert got == {1: (PAGES[3][1], len(PAGES[3][1])), None: ("", 0)}
    assert html_text.extract(pages.limit(0)).count() == 0


def test_splitting_pattern_equals_the_plain_one():
    import tiktoken

    ours = token_shards.tokenizer(token_shards.VOCABULARY)
    plain = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    other = tiktoken.Encoding("plain", pat_str=plain, mergeable_ranks=ours._mergeable_ranks, special_tokens={})
    rng, signs = random.Random(5), "aZé9 \t\n\r\u00a0\u3000'sdmtlvre!?_-漢😀½\x00\x0b"
    for _ in range(20_000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 24)))
        assert ours.encode_ordinary(text) == other.encode_ordinary(text)


def test_token_shards(docs, none, tmp_path):
    rows = token_shards.materialise(docs, length=64, per_shard=16).collect()
    assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    assert all(len(r["tokens"]) == 128 and (r["shard"], r["byte_offset"]) == (r["slot"] // 16, r["slot"] % 16 * 128) for r in rows)
    decode, texts = token_shards.tokenizer(token_shards.VOCABULARY), {}
    parts = {}
    for r in sorted(rows, key=lambda r: r["part"]):
        parts.setdefault((r["doc_id"], r["part"]), []).append(np.frombuffer(r["tokens"], dtype="<u2")[: r["n_tokens"]])
    for (doc, _), found in parts.items():
        assert all((x == found[0]).all() for x in found)
        texts.setdefault(doc, []).extend(found[0].tolist())
    want = {r[0]: r[1] or "" for r in corpus()}
    assert {k: decode.decode(v[:-1]) for k, v in texts.items()} == want and all(v[-1] == token_shards.END for v in texts.values())
    again = token_shards.materialise(docs.repartition(7), length=64, per_shard=16).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    folder = f"file://{tmp_path}/shards"
    made = token_shards.write_shards(token_shards.materialise(docs, 64, 16), folder, 64, 16, -(-len(rows) // 16)).collect()
    assert sum(m["n_sequences"] for m in made) == len(rows) and len(made) == -(-len(rows) // 16)
    tokens = [bytes(r["tokens"]) for r in sorted(rows, key=lambda r: r["slot"])]
    for start in (0, 5, 16, 37, len(rows) - 1, len(rows)):
        read = list(token_shards.ShardReader(folder, 64, 16).read(start))
        assert [s for s, _ in read] == list(range(start, len(rows))) and [x.tobytes() for _, x in read] == tokens[start:]
    back = token_shards.read_back(docs.sparkSession, folder.replace("file:///", "file:/"), 64)
    assert sorted(map(str, back.collect())) == sorted(map(str, rows)) and back.columns == token_shards.materialise(docs, 64, 16).columns
    digests = {m["shard"]: m["sha256"] for m in made}
    for path in tmp_path.glob("shards/shard-*.bin"):
        assert digests[int(path.name[6:14])] == hashlib.sha256(path.read_bytes()).hexdigest()
    last = max(tmp_path.glob("shards/shard-*.bin"))
    last.write_bytes(last.read_bytes()[:-1])
    with pytest.raises(Exception, match="ends before slot"):
        back.collect()
    assert token_shards.stage(none).count() == 0
    shards = token_shards.materialise(docs, 64, 16).select("shard", F.spark_partition_id().alias("p")).distinct().collect()
    assert len({r["shard"] for r in shards}) == len(shards)  # a shard lies in one partition
    assert token_shards.materialise(none).count() == 0


def test_toxicity_learns_stems(spark, none):
    rng = random.Random(5)
    words = [f"{a}{b}" for a in "ka lo mi nu pe ra si to".split() for b in "ban den fil gor hum jat".split()]
    rows, labels = [], []
    for i in range(700):
        w = [rng.choice(words) for _ in range(rng.choice((20, 60, 300)))]
        if i % 4 == 0:
            w[rng.randrange(len(w))] = "zwirk" + rng.choice(words)
        rows.append((i, " ".join(w) if i else None, "en", "s", None, None, None, None))
        labels.append((i, int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([*labels, (3, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.score(docs.select("doc_id", "text", "lang"), toxicity.fit(docs, labels)).collect()
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 and r["doc_id"]]
    right = sum((r["score"] >= 0.7) == (r["doc_id"] % 4 == 0) for r in held)
    assert right >= 0.97 * len(held) and all(0 <= r["score"] <= 1 for r in got)
    clash = docs.withColumns({"_lower": F.lit("x"), "_row": F.lit(1), "threshold": F.lit(2), "_whole": F.lit(3)})
    assert toxicity.stage(clash, labels).columns == clash.columns
    kept = toxicity.stage(docs, labels)
    assert kept.columns == docs.columns and 500 <= kept.count() <= 560
    assert toxicity.stage(none, labels).count() == 0 and toxicity.stage(docs, labels.limit(0)).count() == 700


def test_convolution_equals_plain_loops():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    texts = ["", "one", "one two", "a b c d e f g " * 9, "zwirk " + "plain words " * 40]
    docs = [next(iter(toxicity.W.scan(pa.array([x]), letters=True))) for x in texts]
    ids = [toxicity.pieces(w) for w in docs]
    model = toxicity.train(ids * 8, np.array([0, 0, 1, 0, 1] * 8))
    model.bias[:] = rng.standard_normal(len(model.bias)) * 0.1
    got = model.scores(pa.array(texts))
    for text, mine, p in zip(texts, ids, got):
        v = [model.table[w].astype(float).sum(0) for w in mine] + [np.zeros(toxicity.DIM)] * 4
        z, k = model.offset, 0
        for n, weights in zip(toxicity.WIDTHS, model.filters):
            for f in range(toxicity.FILTERS):
                sums = [sum((v[at + j] * weights[j, :, f]).sum() for j in range(n)) for at in range(len(mine) + 1)]
                z += max(0.0, max(sums) + model.bias[k]) * model.weight[k]
                k += 1
        assert p == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-4)


def test_every_language_has_a_threshold():
    model = toxicity.Model(*[None] * 4, 0.0)
    p = np.array([0.9] * 40 + [0.1] * 40 + [0.62, 0.45] * 15)
    y = np.array([1] * 40 + [0] * 40 + [1, 0] * 15)
    toxicity.calibrate(model, p, y, ["en"] * 80 + ["fr"] * 29 + ["xx"], np.ones(110))
    assert set(model.thresholds) == {"en", "fr", "xx"} and all(0.3 < x < 0.95 for x in model.thresholds.values())
    z = np.log(p / (1 - p)) + model.shift
    assert ((toxicity.chance(z) >= toxicity.BOUND) == (y == 1)).all()


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 4096, 4097, 40_000, 2_100_000])
def test_media_round_trip(n):
    payload = media.pad(np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes())
    raw = media.mux(payload)
    found = media.parse(raw)
    assert b"".join(raw[p.start : p.end] for p in found.packets) == payload and len(payload) % 64 == 0 and payload
    assert [c for _, _, c in found.cues] == found.clusters and found.codecs == {1: "A_PCM/INT/LIT"}


@pytest.mark.parametrize("mode", media.LACING)
@pytest.mark.parametrize("sizes", [[5, 300, 7, 256], [4, 4, 4], [9]])
def test_lacing(mode, sizes):
    if mode == "none" and len(sizes) > 1 or mode == "fixed" and len(set(sizes)) > 1:
        return
    frames = [bytes([k]) * n for k, n in enumerate(sizes)]
    body = media.lace(frames, mode)
    assert [body[a:b] for a, b in media._unlace(memoryview(body), 0, len(body), mode)] == frames


def test_media_frame(docs, none):
    rows = media.digest(media.encode(docs).join(docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")).distinct(), "doc_id")).collect()
    texts = {r[0]: r[1] or "" for r in corpus()}
    assert all(r["payload_sha256"] == hashlib.sha256(media.pad(texts[r["doc_id"]].encode())).hexdigest() for r in rows)
    assert media.packet_table(media.encode(docs.where("doc_id = 7"))).count() >= 1 and media.encode(none).count() == 0
    bad = media.encode(docs.where("doc_id = 7")).selectExpr("explode(array(doc_id, doc_id + 1, doc_id + 2)) as doc_id", "media")
    bad = bad.selectExpr("doc_id", "case doc_id when 7 then substring(media, 1, 300) when 8 then binary('no media') end as media")
    assert {r["doc_id"]: r["error"] is not None for r in media.packet_table(bad).collect()} == {7: True, 8: True}


def test_laced_frames_have_times_of_their_own():
    found = media.parse(media.mux(media.pad(b"x" * 60_000)))
    assert [p.timestamp_ms for p in found.packets] == [64.0 * k for k in range(len(found.packets))] and len(found.packets) == 15
    unknown = b"\x01" + b"\xff" * 7
    group = media.element(media.BLOCK_GROUP, media.element(media.BLOCK, media.vint(2) + b"\0\5\2" + media.lace([b"a", b"bb"], "xiph")) + media.number(media.BLOCK_DURATION, 10))
    bare = media.block(3, 7, [b"c", b"d"], "fixed")
    clusters = b"".join(media.CLUSTER.to_bytes(4, "big") + unknown + media.number(media.TIMESTAMP, 100 * k) + group + bare for k in range(2000))
    raw = media.element(media.EBML, b"") + media.SEGMENT.to_bytes(4, "big") + unknown + clusters + media.element(media.CUES, b"")
    found = media.parse(raw)
    assert len(found.clusters) == 2000
    assert [(p.track, p.timestamp_ms, p.key) for p in found.packets[-4:]] == [(2, 199905.0, True), (2, 199910.0, True), (3, 199907.0, True), (3, None, True)]


def test_mixing(docs, none):
    rows = mixing.copies(docs.select("doc_id", "text", "source")).collect()
    sizes = {}
    for r in rows:
        assert r["size"] == len(WORD.findall(r["text"] or "")) and 0 <= r["copies"] <= 2
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    taken = {s: sum(r["size"] * r["copies"] for r in rows if r["source"] == s) for s in sizes}
    goal, weights, caps = {}, {}, {s: 2.0 * n for s, n in sizes.items()}
    for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or ""))):
        weights[s] = (5, 2, 1)[k % 3]
    total, left = 1.5 * sum(sizes.values()), set(sizes)
    while True:
        level = (total - sum(goal.values())) / sum(weights[s] for s in left)
        over = {s for s in left if weights[s] * level > caps[s]}
        if not over:
            break
        goal |= {s: caps[s] for s in over}
        left -= over
    goal |= {s: weights[s] * level for s in left}
    assert {r["source"]: pytest.approx(r["target"]) for r in rows} == goal
    assert all(abs(taken[s] - goal[s]) <= max(r["size"] for r in rows if r["source"] == s) for s in sizes)
    least = {}  # expected copies grow with the digits of the size, up to the cap
    for r in rows:
        if r["size"]:
            least.setdefault(r["source"], set()).add((r["size"].bit_length(), round(r["e"], 9)))
            assert r["copies"] in (int(r["e"]), int(r["e"]) + 1)
    for s, found in least.items():
        scale = max(e / k for k, e in found)
        assert len({k for k, _ in found}) == len(found) and all(e == pytest.approx(min(2.0, scale * k)) for k, e in found)
        assert sum(r["size"] * r["e"] for r in rows if r["source"] == s) == pytest.approx(goal[s])
    assert any(len({e for _, e in found}) > 1 for found in least.values())
    assert mixing.stage(docs).columns == docs.columns and mixing.stage(docs).count() == sum(r["copies"] for r in rows)
    assert mixing.stage(none).count() == 0


def test_inclusion_is_as_likely_as_it_should_be(spark):
    rng = random.Random(2)
    sizes = [rng.choice((3, 20, 100, 400)) for _ in range(60)]
    reps = 150
    rows = [(rep * 1000 + i, " ".join(["w"] * n), f"s{rep:03}") for rep in range(reps) for i, n in enumerate(sizes)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    drawn = mixing._drawn(docs)
    small = drawn.select("source", "size", "weight", "u", "doc_id")
    words = sum(sizes)
    goal = small.groupBy("source").agg(F.sum("size").alias("source_size"), F.lit(0.6 * words).alias("target"))
    table = mixing.cuts(small, mixing.scales(small, goal))
    found = mixing._taken(small, table).selectExpr("doc_id % 1000 as i", "e", "copies", "size", "source").collect()
    expected, taken = {}, {}
    for r in found:
        expected[r["size"]] = r["e"]
        taken.setdefault(r["size"], []).append(r["copies"])
    assert len(set(expected.values())) == 4
    for n, e in expected.items():
        spread = (0.25 / len(taken[n])) ** 0.5
        assert abs(np.mean(taken[n]) - e) < 4 * spread + 0.01
    for s in {r["source"] for r in found}:
        assert abs(sum(r["size"] * r["copies"] for r in found if r["source"] == s) - 0.6 * words) <= 200


def test_hubs_stay_where_they_are(spark):
    rng = random.Random(7)
    edges = [(5000 + i, 3) for i in range(900)] + [(5000 + i, 4000 + rng.randrange(40)) for i in range(0, 900, 9)] + [(9000 + i, 9001 + i) for i in range(20)] + [(3, 1)]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        up[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long").repartition(5), hub=10).collect()}
    assert got == {x: find(x) for x in up}
