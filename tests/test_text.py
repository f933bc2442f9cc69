import hashlib

import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import text as X

LABELS = ["flag", "pass"]
VERDICTS = [
    ('{"verdict": "flag"}', "flag"), ('{"Verdict": "FLAG"}', "flag"), ('{"label": "flag"}', "flag"), ('So: {"verdict": "flag"} it is.', "flag"),
    ("flag", "flag"), ("  FLAG\n", "flag"), ("flag.", "flag"), ("VERDICT: flag", "flag"), ("verdict = flag", "flag"),
    ("VERDICT: flag\nRATIONALE: this is not a pass.", "flag"), ("I would flag this.", "flag"), ("nothing here", None), ("flags go unflagged", None),
    ("flag or pass", None), ('{"verdict": "maybe"}', None), ("", None), ("{{{ not json }}}", None), ('{"flag": true, "verdict": "unclear"}', None),
    ('Metadata {"note": "pass"} - my verdict is flag.', "flag"), ('{"verdict": "flag"} {"verdict": "pass"}', None), ("VERDICT: pass\nANSWER: flag", None),
    ('{"verdict": "flag"} {"label": "flag"}', "flag"), ('{"verdict": "pass", "verdict": "flag"}', "flag"), ("{\"a\":" * 3000 + "1" + "}" * 3000, None),
]


def test_verdict_ladder(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(VERDICTS)], "i int, t string")
    got = dict(rows.select("i", X.verdict_label(F.col("t"), LABELS)).collect())
    assert {i: got[i] for i in got} == {i: e for i, (_, e) in enumerate(VERDICTS)}


SCORES = [("SCORE: 7", 7.0), ("  score:7.5", 7.5), ("final SCORE: 8 ok", 8.0), ("SCORE: 7 out of 10", 7.0), ("SCORE: 11", 10.0), ("SCORE: -3", 0.0), ("SCORE: 1e9", None), ("SCORE: 7abc", None), ("SCORE: 7.5.2", None), ("SCORE: <n>", None), ("SCORE: <n>\nSCORE: 4", 4.0), ("SCORE: 7é", None), ("SCORE: " + "9" * 400, 10.0), ("", None)]


def test_judge_score(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SCORES)], "i int, t string")
    got = dict(rows.select("i", X.judge_score(F.col("t"))).collect())
    assert got == {i: e for i, (_, e) in enumerate(SCORES)}


@pytest.mark.parametrize(("a", "b", "equal"), [("straße", "STRASSE", True), (" x　", "X", True), ("yes!", "yes", False), ("", " ", True)])
def test_folded_equal(spark, a, b, equal):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(X.folded_equal(F.col("a"), F.col("b"))).first()
    assert row[0] is equal


def test_quote_hash_matches_splitlines(spark):
    texts = ["a\nb\nc", "a\r\nb\rc", "one two\x85three", "tail\n", "x\x0by\x1cz\n\n"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for first, last in ((1, 1), (1, 2), (2, 3), (4, 4)):
        got = dict(rows.select("i", X.quote_hash(F.col("t"), F.lit(first), F.lit(last))).collect())
        for i, t in enumerate(texts):
            lines = t.splitlines()
            want = hashlib.sha256("\n".join(lines[first - 1 : last]).encode()).hexdigest() if last <= len(lines) else None
            assert got[i] == want


def test_canonical_hash_orders_keys_and_floats():
    a = [{"id": "x", "difficulty_prior": 1}]
    assert X.canonical_hash(a) == X.canonical_hash([{"difficulty_prior": 1.0, "id": "x"}])
    assert X.canonical_hash([{"id": "é"}]) == hashlib.sha256(b'[{"id":"\\u00e9"}]').hexdigest()


def test_regex_and_names(spark):
    row = spark.createDataFrame([(" 418\n", "[45]\\d\\d", "A b/c..", "k=1|x\\\ny", "a, ,b")], "r string, p string, n string, m string, c string").select(
        X.exact_regex_score(F.col("r"), F.col("p")), X.slug(F.col("n")), X.markdown_cell(F.col("m")), X.csv_names(F.col("c"))
    ).first()
    assert tuple(row) == (1.0, "A-b-c", "k=1\\|x\\\\ y", ["a", "b"])
    assert (X.score_text(0.25), X.score_text(None)) == ("0.2", "n/a")
