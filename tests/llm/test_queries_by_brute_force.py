"""Every registered training-data query, run over small tables, against a slow plain version."""

import base64
import hashlib
import html.parser
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import decontaminate, media, mixing, sharding, token_shards
from gaugeworks.llm.registry import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {c: c + 32 for c in range(65, 91)}
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ITEM = "the quick brown fox jumps over a lazy dog while seven wizards brew tea and nobody minds the noise"
MASK = 2**64 - 1


def documents():
    rng = random.Random(17)
    words = [f"{a}{b}" for a in "ka lo mi nu pe ra si to é".split() for b in "ban den fil gor hum jat wex".split()]
    prose = lambda n: [rng.choice(words) + str(rng.randrange(40)) for _ in range(n)]
    rows, toxic = [], {}
    shared = " ".join(prose(60))
    for i in range(420):
        w = prose(rng.choice((1, 4, 19, 20, 60, 150)))
        toxic[i] = int(i % 4 == 0 and len(w) > 4)
        if toxic[i]:
            w[rng.randrange(len(w))] = "zwirk" + rng.choice(words)
        rows.append([i, " ".join(w)])
    for i in range(10, 40, 3):  # near copies
        w = rows[i][1].split()
        if len(w) > 20:
            w[len(w) // 2] = "edited"
        rows[i + 100][1] = "\n".join(w)
        toxic[i + 100] = toxic[i]
    for i in range(200, 220):
        rows[i][1] += "\t" + shared + " end" + str(i)
    for i, text in ((300, ITEM), (301, ITEM.replace("fox", "cat").replace("brew", "drink").upper()), (302, " ".join(ITEM.split()[:7])), (303, ITEM[:50] + " so " + ITEM[50:])):
        rows[i][1] = " ".join([*prose(40), text, *prose(25)])
    rows[310][1], rows[311][1], rows[312][1], rows[313][1] = None, "", " \t\n", "One"
    rows[314][1] = rows[315][1] = rows[5][1]
    rows[316][1] = " ".join(prose(20_000))
    rows[317][1] = "\n".join(rows[316][1].split()[5_000:9_000])
    rows[318][1] = "x" * 200_000
    out = [(i, t, ("en", "fr", None)[i % 3], (f"s{i % 5}" if i % 11 else None), len(t or "")) for i, t in rows]
    out += [out[7], out[7], (8, "another text of the same id", "en", "s1", 0), (None, "no id " + shared, None, None, None), (None, rows[9][1], "en", "s2", 1)]
    return out, toxic


def pages():
    rng = random.Random(3)
    word = lambda: rng.choice("alpha beta gamma délta &amp; eps zeta".split())
    out = [(None, None, None), (1, "http://a/empty", ""), (2, None, "<p>bare text that is long enough to be kept by every rule there is</p>")]
    for i in range(3, 60):
        body = [" ".join(word() for _ in range(rng.randrange(30, 80))) for _ in range(rng.randrange(1, 5))]
        main = "".join(f"<p>{x}</p>\n" + ("<div class='ad'>Buy <b>now</b></div>" if rng.random() < 0.3 else "") for x in body)
        head = f"<html><head><title>T {i}</title><script>var x='<p>no</p>'</script></head><body><nav><a href='/n{i}'>Home</a> <a href=/m>More</a></nav>"
        out.append((i, f"http://a/{i}", f"{head}<article><h1>Head {i}</h1>{main}</article><footer>All rights</footer></body></html>"))
    return out, {i: None for i, *_ in out}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    docs, toxic = documents()
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([*((k, 1, v) for k, v in toxic.items()), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(pages()[0], "page_id long, url string, html string").repartition(2).write.parquet(f"{at}/pages.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "two words"), (4, "not in any of these documents at all")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


@pytest.fixture(scope="module")
def rows(spark, folder):
    """(doc_id, tie, text, source), nulls first, then by id and hash."""
    found = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", F.xxhash64("text"), "text", "source").collect()
    return sorted(map(tuple, found), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def plain_mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & MASK
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def plain_feistel(n, key, x):
    half = next(h for h in range(1, 40) if 4**h >= n)
    keys = [plain_mix(i * 0x9E3779B97F4A7C15 + key & MASK) for i in range(1, 7)]
    while True:
        left, right = x >> half, x & 2**half - 1
        for k in keys:
            left, right = right, left ^ plain_mix(right + k & MASK) & 2**half - 1
        x = left << half | right
        if x < n:
            return x


def test_op1(spark, folder, rows):
    got = sorted(map(str, QUERIES["op1_sharding"](spark, folder).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard").collect()))
    want = []
    for k, (doc, _, text, _) in enumerate(rows):
        raw, place = (text or "").encode(), plain_feistel(len(rows), sharding.KEY, k)
        want.append(f"Row(doc_id={doc}, size={len(raw) + 1}, text_crc32={zlib.crc32(raw)}, law='rows', shard={place % 8}, slot={place // 8}, grown_shard=None)")
    assert got == sorted(want)


def test_op2(spark, folder, rows):
    sets = []
    for _, _, text, _ in rows:
        w = WORD.findall((text or "").translate(LOW))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
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
    want = [(r[0], len(sets[i]), least.get(find(i)), r[0] == least.get(find(i))) for i, r in enumerate(rows)]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in QUERIES["op2_near_dedup"](spark, folder).select("doc_id", "n_shingles", "component_id", "kept").collect())


def plain_align(a, b):
    """The best score of a full alignment table."""
    before, best = [0] * (len(b) + 1), 0
    for x in a:
        now = [0]
        for j, y in enumerate(b):
            now.append(max(0, before[j] + (2 if x == y else -1), before[j + 1] - 1, now[j] - 1))
        best, before = max(best, *now), now
    return best


def test_op3(spark, folder, rows):
    words = lambda text: re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())
    item = words(ITEM)
    seeds = {tuple(item[k : k + 3]) for k in range(len(item) - 2)}
    want = {}
    for doc, _, text, _ in rows:
        w = words(text)
        if seeds & {tuple(w[k : k + 3]) for k in range(len(w) - 2)}:
            score = plain_align(item, w) / (2 * len(item))
            if score >= decontaminate.MIN_SCORE:
                want[doc] = score
    found = QUERIES["op3_decontamination"](spark, folder).collect()
    assert {r["doc_id"]: r["score"] for r in found} == want and {r["item_id"] for r in found} == {1} and {300, 301, 303} <= set(want) and 302 not in want


class Links(html.parser.HTMLParser):
    def __init__(self, page):
        super().__init__()
        self.title, self.links, self.text, self.within = "", [], [], []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.within.append(tag)
        self.links += [v for k, v in attrs if tag == "a" and k == "href"]

    def handle_endtag(self, tag):
        while self.within and self.within.pop() != tag:
            pass

    def handle_data(self, data):
        if "title" in self.within:
            self.title += data
        elif "script" not in self.within:
            self.text.append(data)


def test_op4(spark, folder):
    found = QUERIES["op4_warc"](spark, folder).collect()
    made = {}
    for r in found:
        made.setdefault(r["page_id"], {})[r["record_type"]] = r
    assert len(found) == 2 * len(pages()[0]) and {frozenset(v) for v in made.values()} == {frozenset(("conversion", "metadata"))}
    for page_id, url, page in pages()[0]:
        plain, body = Links(page or ""), (page or "").encode()
        digest = "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
        conversion, metadata = made[page_id]["conversion"], made[page_id]["metadata"]
        assert conversion["text"].split() == " ".join(plain.text).split()
        lines = metadata["text"].split("\r\n")
        assert f"title: {plain.title}".strip() in [x.strip() for x in lines] and [x for x in lines if x.startswith("outlink")] == [f"outlink: {x}" for x in dict.fromkeys(plain.links)]
        for r in (conversion, metadata):
            raw = r["text"].encode()
            assert r["source_payload_digest"] == digest and r["target_uri"] == (url or "") and r["refers_to"] == conversion["refers_to"] and r["error"] is None
            assert r["content_length"] == len(raw) and r["block_digest"] == "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()


def test_op5(spark, folder):
    found = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in QUERIES["op5_html_extraction"](spark, folder).collect()}
    assert len(found) == len(pages()[0])
    for page_id, url, page in pages()[0]:
        article = re.search(r"<article>(.*)</article>", page or "", re.S)
        text = re.sub(r"<div class='ad'>.*?</div>", "", article[1]) if article else page or ""
        text = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", text)).split())
        assert found[page_id] == (url, text, len(text))


def test_op6(spark, folder, rows):
    encode = token_shards.tokenizer(token_shards.VOCABULARY).encode_ordinary
    packed = []
    for doc, _, text, _ in rows:
        ids = [*encode(text or ""), token_shards.END]
        for part, at in enumerate(range(0, len(ids), 512)):
            mine = ids[at : at + 512]
            packed.append((doc, part, len(mine), np.array(mine + [token_shards.END] * (512 - len(mine)), dtype="<u2").tobytes()))
    want = {}
    for k, row in enumerate(packed):
        slot = plain_feistel(len(packed), token_shards.KEY, k)
        want[slot] = (slot // 8192, slot % 8192 * 1024, *row)
    found = QUERIES["op6_token_shards"](spark, folder).collect()
    assert {r["slot"]: (r["shard"], r["byte_offset"], r["doc_id"], r["part"], r["n_tokens"], bytes(r["tokens"])) for r in found} == want and len(found) == len(packed)


def test_op7(spark, folder, rows):
    seen, want = {}, []
    for doc, tie, text, _ in rows:
        w = WORD.findall(text or "")
        keep = [True] * len(w)
        for k in range(len(w) - 19):
            place = seen.setdefault(tuple(w[k : k + 20]), (doc, tie, k))
            if place != (doc, tie, k):
                keep[k : k + 20] = [False] * 20
        kept = [x for x, y in zip(w, keep) if y]
        want.append((doc, len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in QUERIES["op7_substring_dedup"](spark, folder).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())


def test_op8(spark, folder, rows):
    found = QUERIES["op8_toxicity"](spark, folder).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in found)
    assert all(r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 3 == 1) for r in found)
    toxic = documents()[1]
    held = [r for r in found if r["held_out"] and r["doc_id"] is not None]
    assert sum(r["predicted"] == toxic[r["doc_id"]] for r in held) >= 0.95 * len(held) and sum(toxic[r["doc_id"]] for r in held) > 20
    scores = {}
    for r, text in ((r, t) for r in found for d, _, t, _ in rows if d == r["doc_id"] and d not in (8, None)):
        assert scores.setdefault(text, r["score"]) == r["score"]


def test_op9(spark, folder, rows):
    found = QUERIES["op9_media"](spark, folder).drop("feature").collect()
    want = []
    for doc, _, text, _ in rows:
        raw = (text or "").encode()
        payload = raw + b"\0" * (64 * max(1, -(-len(raw) // 64)) - len(raw))
        stored = media.mux(payload)
        want.append((doc, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest()))
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"]
    assert sorted(map(str, want)) == sorted(str(tuple(r[n] for n in names)) for r in found)


def plain_mix_of(rows):
    """(doc_id, size, source size, target, taken) by loops: filling by hand, and one sort a source."""
    sized = [(doc, text, source, len(WORD.findall(text or ""))) for doc, _, text, source in rows]
    total = {}
    for _, _, s, n in sized:
        total[s] = total.get(s, 0) + n
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(total, key=lambda s: (s is None, s or "")))}
    goal, left, rest = {}, set(total), 1.5 * sum(total.values())
    while True:
        level = rest / sum(weights[s] for s in left)
        over = {s for s in left if weights[s] * level > 2 * total[s]}
        if not over:
            break
        goal |= {s: 2.0 * total[s] for s in over}
        rest -= sum(2.0 * total[s] for s in over)
        left -= over
    goal |= {s: weights[s] * level for s in left}
    out = []
    for s in total:
        mine = [(d, t, n) for d, t, x, n in sized if x == s]
        low, high = 0.0, 1e6
        for _ in range(200):
            c = (low + high) / 2
            low, high = (c, high) if sum(n * min(2.0, c * n.bit_length()) for _, _, n in mine) < goal[s] else (low, c)
        words, drawn, seen = goal[s], [], {}
        for d, t, n in mine:
            e = min(2.0, high * n.bit_length()) if n else 0.0
            sure = 2 if e > 2 - 1e-9 else int(e)
            words -= sure * n
            u = (int(hashlib.md5(f"{mixing.SEED}|{'' if d is None else d}|{t or ''}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            k = seen[u, n] = seen.get((u, n), -1) + 1  # repeated rows are drawn one by one
            u = (u + k * 0.6180339887498949) % 1
            p = e - sure
            drawn.append(((u / (1 - u)) / (p / (1 - p)) if 0 < p < 1 else float("inf"), d, n, sure))
        drawn.sort(key=lambda x: x[0])
        k = 0
        while k < len(drawn):
            same = [x for x in drawn[k:] if x[0] == drawn[k][0]]
            size = sum(x[2] for x in same)
            take = drawn[k][0] < float("inf") and size / 2 <= words
            out += [(d, n, total[s], goal[s], n * (sure + (take and n > 0))) for _, d, n, sure in same]
            words = words - size if take else -float("inf")
            k += len(same)
    return out


def test_op10(spark, folder, rows):
    found = QUERIES["op10_mixing"](spark, folder).select("doc_id", "size", "source_size", "target", "taken").collect()
    key = lambda r: (str(r[0]), r[1], r[4])
    for got, want in zip(sorted(map(tuple, found), key=key), sorted(plain_mix_of(rows), key=key), strict=True):
        assert got[:3] == want[:3] and got[3] == pytest.approx(want[3]) and got[4] == want[4]
