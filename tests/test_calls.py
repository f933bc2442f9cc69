"""Live calls: the journal of replies and the budget that tasks share."""

import json
import os
import threading
from concurrent.futures import ThreadPoolExecutor

import pytest

from gaugeworks.errors import AdapterError, BudgetExhausted, RunError
from gaugeworks.plans import lifecycle as L
from gaugeworks.sources import suites
from gaugeworks.sources.calls import Budget, Calls


def suite(n=6, kind="verdict"):
    scoring = {"type": kind} | ({"labels": ["flag", "pass"]} if kind == "verdict" else {})
    items = [{"id": f"i{i}", "tags": ["t"], "prompt": f"p{i}", "expected": "pass", "difficulty_prior": 0.5, "provenance": "x"} for i in range(n)]
    return suites.validate_suite({"suite": "s", "version": 1, "description": "d", "domain": "m", "scoring": scoring, "items": items})


def caller(log, bad=(), kill=(), boom=()):
    """Notes every call in a folder; misbehaves for some prompts while ``log``/mended is missing."""

    def answer(model, prompt):
        import os
        import signal
        import uuid

        open(f"{log}/{prompt[-3:].strip()}-{uuid.uuid4().hex}", "w").close()
        broken = not os.path.exists(f"{log}/mended")
        if prompt in kill and broken:
            os.kill(os.getpid(), signal.SIGKILL)
        if prompt in boom:
            raise ValueError("boom")
        if prompt in bad and broken:
            return "error", "", "no such reason", None
        return "success", "SCORE: 7" if "RUBRIC" in prompt else "VERDICT: pass", None, "m-1"

    return answer


def made(log):
    return sorted(x.split("-")[0] for x in os.listdir(log) if "-" in x)


@pytest.fixture
def log(tmp_path):
    os.makedirs(tmp_path / "log")
    return str(tmp_path / "log")


def test_a_failed_wave_calls_no_answered_cell_again(spark, tmp_path, log):
    folder = L.start(spark, str(tmp_path), suite(), ["m"])
    with pytest.raises(AdapterError, match="no such reason"):
        L.sweep(spark, folder, L.called(caller(log, bad=("p4",)), pool=2))
    assert made(log) == [f"p{i}" for i in range(6)] and L.rows(spark, folder).count() == 0
    open(f"{log}/mended", "w").close()
    assert L.sweep(spark, folder, L.called(caller(log, bad=("p4",)), pool=2))["pending"] == 0
    assert made(log) == sorted([*(f"p{i}" for i in range(6)), "p4"]) and L.rows(spark, folder).count() == 6
    assert not os.path.exists(f"{folder}/calls/journal")


def test_a_task_killed_half_way_loses_its_open_call_alone(spark, tmp_path, log):
    folder = L.start(spark, str(tmp_path), suite(), ["m"])
    with pytest.raises(Exception, match="(?s)crash|Connection|Job aborted|EOF"):
        L.sweep(spark, folder, L.called(caller(log, kill=("p3",)), pool=1))
    before = made(log)
    assert "p3" in before
    answered = set(before) - {"p3"}
    open(f"{log}/mended", "w").close()
    assert L.sweep(spark, folder, L.called(caller(log, kill=("p3",)), pool=1))["pending"] == 0
    again = made(log)
    assert all(again.count(p) == 1 for p in answered) and again.count("p3") == 2 and len(set(again)) == 6
    assert L.rows(spark, folder).select("item_id").distinct().count() == 6


def test_an_exception_is_an_error_row_and_its_neighbours_stay(spark, tmp_path, log):
    folder = L.start(spark, str(tmp_path), suite(2), ["m"])
    L.sweep(spark, folder, L.called(caller(log, boom=("p1",))))
    assert {r["item_id"]: (r["error"], r["score"]) for r in L.rows(spark, folder).collect()} == {"i0": (None, 1.0), "i1": ("os_error", None)}


def test_model_and_judge_calls_stop_at_the_shared_budget(spark, tmp_path, log):
    folder = L.start(spark, str(tmp_path), suite(4, "rubric"), ["m"], judges=["a", "b"])
    budget = Budget.deal(f"{folder}/calls", 9)
    assert L.sweep(spark, folder, L.called(caller(log)), budget=budget)["executed"] == 4
    with pytest.raises(BudgetExhausted, match="3 gradings"):
        L.judged(spark, folder, ["a", "b"], 1, L.called(caller(log), pool=2), budget=budget)
    assert len(made(log)) == 9 and budget.reclaim() == 0
    samples = L.judged(spark, folder, ["a", "b"], 1, L.called(caller(log), pool=2), budget=Budget.deal(f"{folder}/calls", 3))
    assert samples.count() == 8 and samples.columns == ["model", "item_id", "sample_k", "judge", "ok", "response_raw"] and len(made(log)) == 12
    L.score(spark, folder, samples)
    assert {r["score"] for r in L.rows(spark, folder).collect()} == {0.7}


def test_a_wave_beyond_the_budget_leaves_cells_pending(spark, tmp_path, log):
    """Two tasks, one call left: one cell is called, the other waits for the next sweep."""
    folder = L.start(spark, str(tmp_path), suite(2), ["m"])
    first = L.sweep(spark, folder, L.called(caller(log), pool=2), budget=Budget.deal(f"{folder}/calls", 1))
    assert (first["executed"], first["pending"], first["aborted"]) == (1, 1, True) and len(made(log)) == 1
    assert L.sweep(spark, folder, L.called(caller(log), pool=2))["pending"] == 0 and made(log) == ["p0", "p1"]


@pytest.mark.parametrize("total, tasks", [(1, 4), (7, 3), (300, 5), (1000, 8)])
def test_tasks_make_exactly_the_calls_dealt(tmp_path, total, tasks):
    budget, lock, count = Budget.deal(f"file://{tmp_path}", total), threading.Lock(), [0]

    def task(k):
        while True:  # a task that ends early gives its lease back, and the next one takes it up
            with Calls(f"{tmp_path}/journal", budget).desk() as desk:
                for _ in range(3 + k):
                    if not desk.granted():
                        return
                    with lock:
                        count[0] += 1

    with ThreadPoolExecutor(tasks) as pool:
        list(pool.map(task, range(tasks)))
    while budget.reclaim():  # what was in a lease while others looked
        task(0)
    assert count[0] == total


def test_a_lost_task_costs_the_calls_it_began(tmp_path):
    budget = Budget.deal(str(tmp_path), 2560)  # leases of ten
    lost = Calls(f"{tmp_path}/journal", budget).desk()
    assert all(lost.granted() for _ in range(4)) and budget.left() == 2550
    assert budget.reclaim() == 2556 and budget.reclaim() == 2556
    assert lost.granted() and budget.left() < 2556  # still at work after all: it takes another lease
    with pytest.raises(RunError):
        Budget.deal(str(tmp_path), 0)


def test_journal_keeps_any_reply(tmp_path):
    calls = Calls(f"{tmp_path}/journal")
    desk = calls.desk()
    for key, reply in (("ab", ["success", "é\n\"", None, 1.5]), ("cd", [None, "timeout", 0.0])):
        assert desk.known(key) is None
        desk.keep(key, reply)
        desk.keep(key, reply)
        assert calls.desk().known(key) == json.loads(json.dumps(reply))
    assert sorted(calls.answered()) == ["ab", "cd"] and list(Calls(f"{tmp_path}/none").answered()) == []
