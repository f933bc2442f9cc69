import hashlib
import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gaugeworks.errors import JudgeParseError, LedgerError, RunError, SuiteError
from gaugeworks.operators import calibration as C
from gaugeworks.operators import cells, evidence, judging, reports
from gaugeworks.schemas import CLAIM, ROW
from gaugeworks.sources import ledger, runs, suites


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "model string, item_id string, score double, scorer string, parsed string, error string")


def test_model_report(spark):
    rows = rows_of(spark, [("a", "1", 1.0, "verdict", "flag", None), ("a", "2", 0.0, "verdict", "parse_fail", None), ("b", "1", 0.0, "no_response", None, None), ("b", "2", None, None, None, "timeout")])
    got = {r["model"]: r for r in reports.model_report(rows).collect()}
    assert (got["a"]["suite_score"], got["a"]["n_parse_fail"], got["a"]["n_cells"]) == (50.0, 1, 2)
    assert (got["b"]["suite_score"], got["b"]["n_scored"], got["b"]["n_no_response"], got["b"]["n_error"], got["b"]["n_items"]) == (0.0, 1, 1, 1, 2)


def samples(spark, rows):
    return judging.parsed_samples(spark.createDataFrame(rows, "judge string, item_id string, ok boolean, response_raw string"))


def test_medians_and_gate(spark):
    s = samples(spark, [("A", "1", True, "SCORE: 6"), ("A", "1", True, "none"), ("A", "1", True, "SCORE: 8"), ("B", "1", False, ""), ("B", "1", True, "SCORE: 8"), ("B", "1", True, "SCORE: 6"), ("C", "1", True, "x"), ("C", "1", True, "y"), ("D", "2", False, "")])
    assert {r["judge"]: r["median"] for r in judging.medians(s).collect()} == {"A": 7.0, "B": 7.0}
    assert {r["item_id"]: (r["score"], r["parsed"]) for r in judging.item_scores(s).collect()} == {"1": (0.7, "7.0"), "2": (0.0, "parse_fail")}
    stats = judging.parse_stats(s)
    assert {r["judge"]: (r["fail"], r["attempts"]) for r in stats.collect()} == {"A": (1, 3), "B": (0, 2), "C": (2, 2), "D": (0, 0)}
    with pytest.raises(JudgeParseError, match="^C"):
        judging.check_gate(stats)
    judging.check_gate(stats.where("judge <> 'C'"))


def test_resume_any_split(spark):
    items = spark.createDataFrame([("i1",), ("i2",), ("i3",)], "item_id string")
    grid = cells.sweep_grid(items, spark.createDataFrame([("m",), ("n",), ("m",)], "model string"), 2)
    assert grid.count() == 12
    done = grid.where("item_id < 'i3' and sample_k = 0")
    left, had = cells.pending(grid, done), cells.completed(grid, done)
    assert left.count() == 8 and left.unionByName(had).exceptAll(grid).count() == 0
    split = cells.budget_split(left, ["model", "item_id", "sample_k"], 3)
    assert [tuple(r)[:3] for r in split.where("run").orderBy("model", "item_id", "sample_k").collect()] == [tuple(r) for r in left.orderBy("model", "item_id", "sample_k").take(3)]
    with pytest.raises(RunError):
        cells.check_no_orphans(done, items.limit(0))


def test_rescore_is_idempotent(spark):
    rows = rows_of(spark, [("a", "1", 1.0, "verdict", "flag", None), ("b", "1", 0.0, "no_response", None, None), ("b", "2", None, None, None, "timeout")])
    once = cells.rescore(rows, F.lit("pass"), F.lit(0.0), "verdict")
    assert sorted(map(str, once.collect())) == sorted(map(str, cells.rescore(once, F.lit("pass"), F.lit(0.0), "verdict").collect()))
    assert once.where("scorer = 'no_response' or error is not null").exceptAll(rows).count() == 0


def test_cluster_bootstrap_equals_brute_force(spark):
    data = [(t, t % 5, k, (t * 7 + k) % 3 % 2, (t * 5 + k) % 2) for t in range(23) for k in (1, 2)]
    arms = spark.createDataFrame(data, "task_id int, cluster_id int, sample_k int, a_pass int, b_pass int")
    got = [r["delta"] for r in C.cluster_bootstrap(arms, "s", 50).orderBy("i").collect()]
    tasks = {}
    for t, c, _, a, b in data:
        tasks.setdefault((c, t), []).append(a - b)
    for i in range(50):
        drawn = [int(hashlib.sha256(f"bootstrap-v1\0s\0{i}\0{d}".encode()).hexdigest(), 16) % 5 for d in range(5)]
        picked = [sum(v) / len(v) for c in drawn for (k, _), v in tasks.items() if k == c]
        assert got[i] == pytest.approx(100 * sum(picked) / len(picked), abs=1e-9)
    assert (C.ranks(10_000, 1), C.ranks(10_000, 4)) == ((249, 9749), (61, 9937))


def test_block_schedule_is_balanced(spark):
    tasks = spark.createDataFrame([("f", f"t{i}", 1) for i in range(7)], "family string, task_id string, sample_k int")
    rows = C.block_schedule(tasks, spark.createDataFrame([("a",), ("b",), ("c",)], "model string"), "z").collect()
    counts = Counter((r["model"], r["position"]) for r in rows)
    assert len(rows) == 21 and max(counts.values()) - min(counts.values()) <= 1


def test_audit_is_one_way(spark):
    claims = spark.createDataFrame([("c1", "MEASURED"), ("c2", "STALE"), ("c3", "PARTIAL")], "claim_id string, status string")
    issues = spark.createDataFrame([("c1", "x"), ("c1", "y"), ("c2", "x")], "claim_id string, reason string")
    got = {r["claim_id"]: (r["status"], r["newly_stale"]) for r in evidence.audit(claims, issues).collect()}
    assert got == {"c1": ("STALE", True), "c2": ("STALE", False), "c3": ("PARTIAL", False)}


def item(**change):
    return {"id": "i1", "tags": ["t"], "prompt": "p", "expected": "flag", "difficulty_prior": 1, "provenance": "x"} | change


def suite(**change):
    return {"suite": "s", "version": 1, "description": "d", "domain": "m", "scoring": {"type": "verdict", "labels": ["flag", "pass"]}, "items": [item()]} | change


@pytest.mark.parametrize("bad", [
    suite(version=True), suite(version=0), suite(extra=1), suite(items=[]), suite(items=[item(), item()]), suite(items=[item(difficulty_prior=1.5)]), suite(items=[item(difficulty_prior=float("nan"))]),
    suite(items=[item(id="a/b")]), suite(items=[item(id="...")]), suite(items=[item(prompt="")]), suite(items=[item(prompt="\ud800")]), suite(scoring={"type": "verdict", "labels": ["a", "A"]}),
    suite(scoring={"type": "verdict", "regex": True}), suite(scoring={"type": "exact", "regex": True}, items=[item(expected="(")]), suite(scoring={"type": "other"}),
])
def test_bad_suites(bad):
    with pytest.raises(SuiteError):
        suites.validate_suite(bad)


def test_suite_round_trip(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps(suite()))
    loaded = suites.load_suite(spark, str(tmp_path / "s.json"))
    assert suites.suite_hash(loaded) == suites.suite_hash(suites.validate_suite(suite(description="other")))
    assert suites.item_frame(spark, loaded).first()["difficulty_prior"] == 1.0


def row(**change):
    return dict.fromkeys(ROW.fieldNames()) | {"run_id": "r", "model": "m", "model_id_resolved": "m", "item_id": "i", "sample_k": 0, "response_raw": "x", "elapsed_s": 1.5} | change


@pytest.mark.parametrize(("tail", "n"), [("", 2), ('{"run_id": "r', 2)])
def test_rows_tolerate_a_torn_tail(spark, tmp_path, tail, n):
    (tmp_path / "rows.jsonl").write_text("".join(json.dumps(row(sample_k=k, score=k / 2)) + "\n" for k in range(2)) + tail)
    assert runs.read_rows(spark, str(tmp_path / "rows.jsonl")).count() == n


@pytest.mark.parametrize("bad", ["oops", json.dumps(row(sample_k="0")), json.dumps({"run_id": "r"})])
def test_rows_refuse_a_bad_middle(spark, tmp_path, bad):
    (tmp_path / "rows.jsonl").write_text(bad + "\n" + json.dumps(row()) + "\n")
    with pytest.raises(RunError):
        runs.read_rows(spark, str(tmp_path / "rows.jsonl"))


def claim(**change):
    return {"claim_id": "c1", "statement": "s", "decision_surface": "d", "sources": [{"file": "a/b.md", "lines": "1-2", "quote_sha256": "0" * 64}], "status": "PARTIAL", "evidence": [], "verdict": None, "preregistration": None, "last_verified_utc": "2026-01-01T00:00:00Z"} | change


def test_ledger_round_trip(spark, tmp_path):
    claims = spark.createDataFrame([claim(), claim(claim_id="c2")], CLAIM)
    ledger.write_ledger(claims, str(tmp_path / "out"))
    assert ledger.load_ledger(spark, str(tmp_path / "out")).count() == 2
    assert "PARTIAL (2)" in ledger.render(claims)


@pytest.mark.parametrize("bad", [claim(status="MEASURED"), claim(sources=[]), claim(last_verified_utc="2026-01-01"), claim(statement="　"), claim(evidence=["a", "a"]), claim(sources=[{"file": "../x", "lines": "1", "quote_sha256": "0" * 64}]), claim(sources=[{"file": "x", "lines": "2-1", "quote_sha256": "0" * 64}])])
def test_ledger_rules(spark, tmp_path, bad):
    with pytest.raises(LedgerError):
        ledger.write_ledger(spark.createDataFrame([bad], CLAIM), str(tmp_path / "out"))
