"""Commits of several writers, refreshes and their plans."""

import json
import threading

import pytest

from gaugeworks.__main__ import main
from gaugeworks.errors import ReportError, RunError
from gaugeworks.plans import lifecycle as L
from gaugeworks.plans import refresh, surfaces
from gaugeworks.sources import runs, suites, versions

SCHEMA = "k int, m string, v string"


def suite(n=3, name="s", **scoring):
    items = [{"id": f"i{i}", "tags": ["t"], "prompt": f"p{i}", "expected": "flag" if i else "pass", "difficulty_prior": 0.5, "provenance": "x"} for i in range(n)]
    return {"suite": name, "version": 1, "description": "about it", "domain": "m", "scoring": {"type": "verdict", "labels": ["flag", "pass"]} | scoring, "items": items}


def answers():
    return L.called(lambda model, prompt: ("success", "flag", None, None))


def frame(spark, *rows):
    return spark.createDataFrame(rows, SCHEMA)


def got(spark, folder, version=None):
    return sorted(tuple(r) for r in versions.read(spark, folder, frame(spark, (1, "m", "a")).schema, version).collect())


def test_a_file_is_made_once(spark, tmp_path):
    made, path = [], f"{tmp_path}/a b/x.json"
    gate = threading.Barrier(6)

    def make(i):
        gate.wait()
        made.append((versions.create_once(spark, path, f"{i}" * 1000), i))

    threads = [threading.Thread(target=make, args=(i,)) for i in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    winners = [i for won, i in made if won]
    assert len(made) == 6 and len(winners) == 1 and (tmp_path / "a b" / "x.json").read_text() == f"{winners[0]}" * 1000
    assert [x.name for x in (tmp_path / "a b").iterdir() if not x.name.endswith(".crc")] == ["x.json"]


def test_of_two_writers_one_wins_and_the_other_leaves_its_cells(spark, tmp_path):
    folder = str(tmp_path / "t")
    start = versions.current(spark, folder)
    assert versions.append(frame(spark, (1, "a", "x"), (2, "a", "x")), folder, set(), ["k"], ["m"])[1:] == (2, 0)
    one = versions.current(spark, folder)
    part = versions.write(frame(spark, (9, "a", "late")), folder, ["m"])
    for replace in (False, True):
        with pytest.raises(versions.Conflict):
            versions.commit(spark, folder, start, part, replace)
    assert got(spark, folder) == [(1, "a", "x"), (2, "a", "x")]  # what no entry names is not seen
    assert versions.append(frame(spark, (2, "a", "y"), (3, "a=b/c", "y")), folder, set(), ["k"], ["m"])[1:] == (1, 1)
    both = [(1, "a", "x"), (2, "a", "x"), (3, "a=b/c", "y")]
    assert got(spark, folder) == both
    assert versions.append(frame(spark, (1, "a", "z")), folder, set(), ["k"], ["m"])[1:] == (0, 1) and got(spark, folder) == both
    new = versions.commit(spark, folder, versions.current(spark, folder), versions.write(frame(spark, (7, "c", "new")), folder, ["m"]), replace=True)
    assert new.generation == 1 and got(spark, folder) == [(7, "c", "new")]
    assert got(spark, folder, one) == [(1, "a", "x"), (2, "a", "x")]  # a reader that has begun keeps its version


def test_a_commit_that_comes_between_is_looked_at(spark, tmp_path, monkeypatch):
    folder, real, rounds = str(tmp_path / "t"), versions.commit, []

    def late(spark, at, after, part, replace=False):
        if not rounds:
            rounds.append(1)
            real(spark, at, after, versions.write(frame(spark, (2, "a", "theirs")), at, ["m"]))
        return real(spark, at, after, part, replace)

    monkeypatch.setattr(versions, "commit", late)
    assert versions.append(frame(spark, (1, "a", "x"), (2, "a", "x")), folder, set(), ["k"], ["m"])[1:] == (1, 1)
    assert got(spark, folder) == [(1, "a", "x"), (2, "a", "theirs")]


def test_entries_name_all_parts_now_and_then(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versions, "WHOLE", 3)
    folder, at = str(tmp_path / "t"), versions.Version()
    for k in range(8):
        at = versions.commit(spark, folder, at, f"part={k}")
        found = versions.current(spark, folder)
        assert found == at and found.parts == tuple(f"part={i}" for i in range(k + 1)) and found.number - found.since < 3


def test_two_sweeps_of_one_run(spark, tmp_path):
    folder, inner = L.start(spark, str(tmp_path), suites.validate_suite(suite()), ["m"], samples=2), []
    recorded = spark.createDataFrame([("m", f"i{i}", k, "success", "flag", None, "m", 0.1) for i in range(3) for k in range(2)], "model string, item_id string, sample_k int, " + L.REPLY)

    def slow(todo):
        if not inner:
            inner.append(None)
            inner[0] = L.sweep(spark, folder, L.recorded(recorded))
        return L.recorded(recorded)(todo)

    assert L.sweep(spark, folder, slow, wave=4) == {"run_id": folder.rpartition("/")[2], "executed": 0, "pending": 0, "aborted": False}
    assert inner[0]["executed"] == 6
    cells = [tuple(r) for r in L.rows(spark, folder).select("model", "item_id", "sample_k").collect()]
    assert len(cells) == len(set(cells)) == 6


def test_scores_that_were_overtaken_are_refused(spark, tmp_path, monkeypatch):
    folder = L.start(spark, str(tmp_path), suites.validate_suite(suite()), ["m"], budget=2)
    L.sweep(spark, folder, answers())
    real = runs.check_same_rows

    def meanwhile(before, after):
        real(before, after)
        L.sweep(spark, folder, answers())

    monkeypatch.setattr(runs, "check_same_rows", meanwhile)
    with pytest.raises(versions.Conflict):
        L.score(spark, folder)
    assert L.rows(spark, folder).count() == 3 and L.newest(spark, folder) == 0
    monkeypatch.undo()
    assert L.score(spark, folder)["total"] == 3 and L.newest(spark, folder) == 1
    with pytest.raises(RunError):
        runs.write_once(spark, {}, f"{folder}/manifest.json")


def test_refresh_shows_then_runs(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "suites").mkdir()
    path, out = tmp_path / "suites" / "one.json", str(tmp_path / "out")
    path.write_text(json.dumps(suite()))
    first = refresh.plan(spark, str(path), out, ["m", "n"], 4)
    assert (first.resumes, first.pending, first.last) == (None, 6, ()) and "at most 4 calls" in first.render() and not (tmp_path / "out").exists()
    assert refresh.execute(spark, first, answers())["executed"] == 4
    second = refresh.plan(spark, str(path), out, ["m", "n"], 10)
    assert second.pending == 2 and second.resumes and [x[0] for x in second.last] == ["m", "n"]
    assert refresh.plan(spark, str(path), out, ["m"], 10).resumes is None
    third = refresh.plan(spark, str(path), out, ["m", "n"], 1)
    assert refresh.execute(spark, third, answers())["executed"] == 1
    with pytest.raises(RunError, match="rows since"):
        refresh.execute(spark, second, answers())
    late = refresh.plan(spark, str(path), out, ["m", "n"], 10)
    path.write_text(json.dumps(suite(labels=["flag", "pass", "maybe"])))
    with pytest.raises(RunError, match="changed"):
        refresh.execute(spark, late, answers())
    assert refresh.plan(spark, str(path), out, ["m", "n"], 10).last == ()  # another way of scoring
    for bad in ({"roster": []}, {"budget": 0}, {"samples": 0}):
        with pytest.raises(RunError):
            refresh.plan(spark, str(path), out, **({"roster": ["m"], "budget": 1} | bad))


def test_refresh_on_the_command_line(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "suites").mkdir()
    (tmp_path / "suites" / "one.json").write_text(json.dumps(suite()))
    (tmp_path / "suites" / "odd.json").write_text("{}")
    spark.createDataFrame([("m", f"i{i}", 0, "success", "flag", None, "m", 0.1) for i in range(3)], "model string, item_id string, sample_k int, " + L.REPLY).write.parquet(f"{tmp_path}/replies")
    said = []
    monkeypatch.setattr("builtins.input", lambda q: said.pop(0))
    do = lambda *a: (main(["refresh", "--suites", f"{tmp_path}/suites", "--models", "m", "--replies", f"{tmp_path}/replies", "--out", f"{tmp_path}/out", *a], spark), capsys.readouterr().out)
    for said[:] in (["1", "no"], ["2"], [""], ["1", ""]):
        code, shown = do()
        assert code == 0 and shown.endswith("cancelled\n") and not (tmp_path / "out").exists()
    said[:] = ["1", "yes"]
    code, shown = do()
    assert code == 0 and json.loads(shown.splitlines()[-1])["executed"] == 3 and "about it" in shown
    assert do("--suite", "none")[0] == 2
    code, shown = do("--suite", "s", "--yes")
    assert code == 0 and "| m | run_" in shown


def test_runs_without_a_fingerprint_have_no_rank(spark, tmp_path):
    for i, (scoring, models) in enumerate([({}, ["m", "n"]), ({}, ["m"]), ({"labels": ["flag", "pass", "maybe"]}, ["m"])]):
        folder = L.start(spark, str(tmp_path), suites.validate_suite(suite(**scoring)), models)
        L.sweep(spark, folder, answers())
        if i == 1:
            at = tmp_path / folder.rpartition("/")[2]
            (at / ".manifest.json.crc").unlink(missing_ok=True)
            old = json.loads((at / "manifest.json").read_text())
            del old["fingerprint"]
            (at / "manifest.json").write_text(json.dumps(old))
    board = surfaces.leaderboard(spark, surfaces.stored_runs(spark, str(tmp_path)))
    assert sorted((r["rank"] or 0, r["model"], r["refused"]) for r in board if r["refused"] is None) == [(1, "m", None), (1, "m", None), (1, "n", None)]
    assert [(r["rank"], r["refused"]) for r in board[3:]] == [(None, surfaces.LEGACY)]
    assert "| - | m |" in surfaces.render_leaderboard(board)
    mine = surfaces.stored_runs(spark, str(tmp_path))
    ways = {runs.read_manifest(spark, f)["fingerprint"]: f for f in mine}
    with pytest.raises(ReportError):
        L.compare(spark, [f for k, f in ways.items() if k])
    assert "| m |" in L.compare(spark, [ways[None], next(f for k, f in ways.items() if k)])
