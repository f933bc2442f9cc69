"""Whole runs: sweep, budget, resume, scoring, reports and the command line."""

import hashlib
import json

import pytest

from gaugeworks.__main__ import main
from gaugeworks.errors import JudgeParseError, RunError
from gaugeworks.plans import lifecycle as L
from gaugeworks.sources import ledger, runs, suites
from gaugeworks.schemas import CLAIM


def suite(kind="verdict", **scoring):
    scoring = {"type": kind} | scoring | ({"labels": ["flag", "pass"]} if kind == "verdict" else {})
    items = [{"id": f"i{i}", "tags": ["t"], "prompt": f"p{i}", "expected": "flag" if i else "pass", "difficulty_prior": 0.5, "provenance": "x"} for i in range(3)]
    return suites.validate_suite({"suite": "s", "version": 1, "description": "d", "domain": "m", "scoring": scoring, "items": items})


def caller():
    def answer(model, prompt):  # local, so that it travels to the workers by value
        if model == "silent":
            return "no_response", "ignored", None, None
        return ("error", "", "timeout", None) if prompt == "p2" else ("success", "VERDICT: flag", None, "m-1")

    return answer


def test_sweep_stops_at_the_budget_and_resumes(spark, tmp_path):
    folder = L.start(spark, str(tmp_path), suite(), ["m", "silent", "m"], samples=2, budget=5)
    assert L.report(spark, folder)[1][0]["suite_score"] is None
    first = L.sweep(spark, folder, L.called(caller()))
    assert (first["executed"], first["pending"], first["aborted"]) == (5, 7, True)
    assert {r["model"] for r in L.rows(spark, folder).collect()} == {"m"}
    assert [L.sweep(spark, folder, L.called(caller()))["pending"] for _ in range(3)] == [2, 0, 0]
    manifest, models = L.report(spark, folder)
    m, silent = models
    assert (m["model"], m["n_cells"], m["n_error"], m["n_scored"], m["suite_score"]) == ("m", 6, 2, 4, 50.0)
    assert (silent["n_no_response"], silent["suite_score"]) == (6, 0.0)
    assert "| m | 50.0 | 3 | 4 | 0 | 0 | 2 |" in L.render(manifest, models)
    before = sorted(map(str, L.rows(spark, folder).collect()))
    assert L.score(spark, folder) == {"total": 12, "scored": 4, "no_response": 6}
    assert L.newest(spark, folder) == 1 and sorted(map(str, L.rows(spark, folder).collect())) == before


def test_rubric_scoring_gates_before_it_writes(spark, tmp_path):
    folder = L.start(spark, str(tmp_path), suite("rubric"), ["m"], judges=["A", "B"])
    L.sweep(spark, folder, L.called(caller()))
    cols = "model string, item_id string, sample_k int, judge string, ok boolean, response_raw string"
    good = [("m", i, 0, j, True, f"SCORE: {s}") for i, j, s in (("i0", "A", 4), ("i0", "B", 8), ("i1", "A", 10), ("i1", "B", 10))]
    with pytest.raises(JudgeParseError):
        L.score(spark, folder, spark.createDataFrame([(*g[:5], "none") for g in good], cols))
    assert L.newest(spark, folder) == 0
    L.score(spark, folder, spark.createDataFrame(good, cols))
    got = {r["item_id"]: (r["score"], r["judge_scores"], r["scorer"]) for r in L.rows(spark, folder).collect()}
    assert got == {"i0": (0.6, [4.0, 8.0], "rubric"), "i1": (1.0, [10.0, 10.0], "rubric"), "i2": (None, None, None)}


def test_bad_parameters_write_nothing(spark, tmp_path):
    for bad in ({"roster": []}, {"roster": ["a/b"]}, {"roster": ["m"], "samples": 0}, {"roster": ["m"], "budget": 0}):
        with pytest.raises(RunError):
            L.start(spark, str(tmp_path), suite(), **bad)
    assert not list(tmp_path.iterdir())


def test_command_line(spark, tmp_path, capsys):
    plain = suite() | {"scoring": {"type": "verdict", "labels": ["flag", "pass"]}}
    (tmp_path / "s.json").write_text(json.dumps(plain))
    spark.createDataFrame([("m", f"i{i}", 0, "success", "flag", None, "m", 0.1) for i in range(3)], "model string, item_id string, sample_k int, " + L.REPLY).write.parquet(f"{tmp_path}/replies")
    do = lambda *a: (main([str(x) for x in a], spark), capsys.readouterr().out)
    assert do("validate", tmp_path / "s.json")[0] == 0
    assert do("validate", tmp_path / "none.json")[0] == 2
    common = ("--suite", tmp_path / "s.json", "--replies", tmp_path / "replies", "--out", tmp_path / "out")
    code, said = do("run", *common, "--models", "m, n")
    run_id = json.loads(said)["run_id"]
    assert code == 0 and runs.RUN_ID.match(run_id)
    assert do("run", *common, "--resume", run_id)[0] == 0
    assert do("score", run_id, "--out", tmp_path / "out")[0] == 0
    assert "| m | 66.7 | 3 |" in do("report", run_id, "--out", tmp_path / "out")[1]
    assert [json.loads(x)["model"] for x in do("report", run_id, "--jsonl", "--out", tmp_path / "out")[1].split("\n") if x] == ["m", "n"]
    assert "| m | 66.7 | 66.7 |" in do("report", run_id, "--compare", run_id, "--out", tmp_path / "out")[1]
    assert do("report", "../x", "--out", tmp_path / "out")[0] == 2
    assert do("smoke", *common, "--models", "m")[0] == 0 and do("smoke", *common, "--models", "n")[0] == 1
    assert do("author", "stub", "--write", tmp_path / "stub")[0] == 0 and do("validate", tmp_path / "stub")[0] == 0


def test_claims_audit(spark, tmp_path, capsys):
    (tmp_path / "files" / "a b").mkdir(parents=True)
    (tmp_path / "files" / "a b" / "x.txt").write_text("one\ntwo\nthree\n")
    claim = dict.fromkeys(CLAIM.fieldNames()) | {"statement": "s", "decision_surface": "d", "status": "ASSERTED", "evidence": [], "last_verified_utc": "2026-01-01T00:00:00Z"}
    source = {"file": "a b/x.txt", "lines": "1-2", "quote_sha256": hashlib.sha256(b"one\ntwo").hexdigest()}
    lines = [claim | {"claim_id": "c1", "sources": [source]}, claim | {"claim_id": "c2", "sources": [source | {"lines": "3"}]}]
    (tmp_path / "ok.jsonl").write_text(json.dumps(lines[0]) + "\n")
    (tmp_path / "bad.jsonl").write_text("".join(json.dumps(x) + "\n" for x in lines))
    audit = lambda name, *more: main(["claims", "audit", "--ledger", f"{tmp_path}/{name}", "--files", f"{tmp_path}/files", *more], spark)
    assert audit("ok.jsonl") == 0
    capsys.readouterr()
    assert audit("bad.jsonl", "--write", f"{tmp_path}/new") == 1
    assert capsys.readouterr().out.split() == ["c2", "a", "b/x.txt", "quote_changed"]
    assert main(["claims", "list", "--ledger", f"{tmp_path}/new"], spark) == 0
    assert [x.split("\t")[1] for x in capsys.readouterr().out.splitlines()] == ["ASSERTED", "STALE"]


def test_audit_with_an_index_reads_what_changed(spark, tmp_path, monkeypatch, capsys):
    (tmp_path / "files" / "a+b [é]").mkdir(parents=True)
    names = ["a+b [é]/x.txt", "y.txt", "empty.txt"]
    for name, text in zip(names, ("one\ntwo\n", "three\n", "")):
        (tmp_path / "files" / name).write_text(text)
    quote = lambda text: hashlib.sha256(text.encode()).hexdigest()
    claim = dict.fromkeys(CLAIM.fieldNames()) | {"statement": "s", "decision_surface": "d", "status": "ASSERTED", "evidence": [], "last_verified_utc": "2026-01-01T00:00:00Z"}
    cites = [(names[0], "1-2", quote("one\ntwo")), (names[0], "2", quote("two")), (names[1], "1", quote("three")), (names[2], "1", quote("")), ("gone.txt", "1", quote("x"))]
    lines = [claim | {"claim_id": f"c{i}", "sources": [{"file": f, "lines": n, "quote_sha256": q}]} for i, (f, n, q) in enumerate(cites)]
    (tmp_path / "ledger").write_text("".join(json.dumps(x) + "\n" for x in lines))
    read, real = [], ledger.file_texts

    def noting(spark, folder, wanted):
        read.append(sorted(r[0] for r in wanted.select("file").distinct().collect()))
        return real(spark, folder, wanted)

    monkeypatch.setattr(ledger, "file_texts", noting)

    def audit():
        read.clear()
        main(["claims", "audit", "--ledger", f"{tmp_path}/ledger", "--files", f"{tmp_path}/files", "--index", f"{tmp_path}/index"], spark)
        return [x.split("\t")[::2] for x in capsys.readouterr().out.splitlines()], read[0]

    bad = [["c3", "bad_lines"], ["c4", "missing_file"]]
    assert audit() == (bad, sorted(names))
    assert audit() == (bad, [])
    (tmp_path / "files" / "y.txt").write_text("three and more\n")
    assert audit() == ([["c2", "quote_changed"], *bad], ["y.txt"])
    (tmp_path / "files" / "y.txt").unlink()
    assert audit() == ([["c2", "missing_file"], *bad], [])
