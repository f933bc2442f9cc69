"""Live services, row logs, harvest sources and what stored runs say together."""

import hashlib
import http.server
import json
import subprocess
import sys
import threading

import pytest

from gaugeworks.__main__ import main
from gaugeworks.errors import AdapterError, AuthorError, LedgerError, RunError
from gaugeworks.functions import text as X
from gaugeworks.plans import lifecycle as L
from gaugeworks.plans import surfaces
from gaugeworks.schemas import ITEM, ROW
from gaugeworks.sources import harvest, ledger, runs, services, suites


def suite(name="s", kind="verdict", n=3, tags=("t",), expected=None, **scoring):
    scoring = {"type": kind} | scoring | ({"labels": ["flag", "pass"]} if kind == "verdict" else {})
    items = [{"id": f"i{i}", "tags": list(tags), "prompt": f"p{i}", "expected": expected or ("flag" if i else "pass"), "difficulty_prior": 0.5, "provenance": "x"} for i in range(n)]
    return {"suite": name, "version": 1, "description": "d", "domain": "m", "scoring": scoring, "items": items}


class Service(http.server.BaseHTTPRequestHandler):
    def do_POST(self):
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        text = asked["messages"][0]["content"]
        body = {"p1": "no json", "p2": json.dumps({"choices": [{"message": {"content": " "}}]})}.get(text) or json.dumps({"model": "m-1", "choices": [{"message": {"content": "SCORE: 8" if "RUBRIC" in text else "VERDICT: pass"}, "finish_reason": "stop"}]})
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body.encode())

    def log_message(self, *a):
        pass


@pytest.fixture(scope="module")
def url():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/v1"
    server.shutdown()


def states(spark, folder):
    return {r["item_id"]: (r["score"], r["scorer"], r["error"], r["model_id_resolved"]) for r in L.rows(spark, folder).collect()}


def test_chat_service(spark, tmp_path, url):
    assert services.reachable(url) and not services.reachable("http://127.0.0.1:9/v1")
    folder = L.start(spark, str(tmp_path), suites.validate_suite(suite()), ["m"])
    L.sweep(spark, folder, services.chat(url, timeout=5.0))
    assert states(spark, folder) == {"i0": (1.0, "verdict", None, "m-1"), "i1": (None, None, "non_json_body", "m"), "i2": (0.0, "no_response", None, "m")}
    other = L.start(spark, str(tmp_path), suites.validate_suite(suite()), ["m"])
    L.sweep(spark, other, services.chat("http://127.0.0.1:9/v1", timeout=5.0))
    assert {s[2] for s in states(spark, other).values()} == {"unreachable"}


def test_command_service(spark, tmp_path):
    program = "import sys,json,time; p=sys.stdin.read(); time.sleep(60 if p=='p2' else 0); print(json.dumps({'result':'pass','model':sys.argv[1]}) if p=='p0' else 'x'); sys.exit(p=='p1')"
    folder = L.start(spark, str(tmp_path), suites.validate_suite(suite()), ["m"])
    L.sweep(spark, folder, services.command([sys.executable, "-c", program, "{model}-x"], timeout=3.0))
    assert states(spark, folder) == {"i0": (1.0, "verdict", None, "m-x"), "i1": (None, None, "os_error", "m"), "i2": (None, None, "timeout", "m")}
    absent = L.start(spark, str(tmp_path), suites.validate_suite(suite()), ["m"])
    L.sweep(spark, absent, services.command(["no-such-program"]))
    assert {s[2] for s in states(spark, absent).values()} == {"unreachable"}


def test_rubric_run_is_judged_live(spark, tmp_path, url):
    folder = L.start(spark, str(tmp_path), suites.validate_suite(suite(kind="rubric")), ["m"], judges=["a", "b", "a"])
    L.sweep(spark, folder, services.chat(url, timeout=5.0))
    samples = L.judged(spark, folder, ["a", "b", "a"], 3, services.chat(url, timeout=5.0))
    assert samples.count() == 6 and samples.where("ok").count() == 6  # one row has a text
    L.score(spark, folder, samples)
    assert {r["item_id"]: (r["score"], r["parsed"], r["judge_scores"]) for r in L.rows(spark, folder).collect()} == {"i0": (0.8, "8.0", [8.0, 8.0]), "i1": (None, None, None), "i2": (0.0, None, None)}


def test_replies_are_kept_wave_by_wave(spark, tmp_path):
    def broken(todo):
        def call(model, prompt):
            if prompt == "p2":
                raise ValueError("the caller fails")
            return "success", "pass", None, None

        return L.called(call, 1)(todo)

    folder = L.start(spark, str(tmp_path), suites.validate_suite(suite()), ["m"])
    with pytest.raises(Exception, match="the caller fails"):
        L.sweep(spark, folder, broken, wave=1)
    assert L.rows(spark, folder).count() == 2
    done = L.sweep(spark, folder, L.called(lambda m, p: ("success", "pass", None, None)), wave=2)
    assert (done["executed"], done["pending"]) == (1, 0) and L.rows(spark, folder).count() == 3


@pytest.mark.parametrize("reply", [("error", "", "odd", None), ("error", "", None, None), ("success", " \n", None, None), ("other", "x", None, None)])
def test_replies_that_break_the_contract(spark, tmp_path, reply):
    folder = L.start(spark, str(tmp_path), suites.validate_suite(suite()), ["m"])
    with pytest.raises(AdapterError):
        L.sweep(spark, folder, L.called(lambda m, p: reply))
    assert L.rows(spark, folder).count() == 0


def test_a_failed_check_leaves_the_old_version(spark, tmp_path, monkeypatch):
    folder = L.start(spark, str(tmp_path), suites.validate_suite(suite()), ["m"])
    L.sweep(spark, folder, L.called(lambda m, p: ("success", "pass", None, None)))
    monkeypatch.setattr(L.cells, "rescore", lambda rows, *a: rows.limit(1))
    with pytest.raises(RunError):
        L.score(spark, folder)
    assert L.newest(spark, folder) == 0 and L.rows(spark, folder).count() == 3


def test_patterns_of_python_alone(spark, tmp_path):
    pattern = r"(?P<n>a)b(?P=n)\Z"
    assert not X.portable(pattern) and X.portable(r"[45]\d\d") and not X.portable("(?i)a") and not X.portable("[[a]") and not X.portable("a++")
    folder = L.start(spark, str(tmp_path), suites.validate_suite(suite(kind="exact", regex=True, expected=pattern)), ["m"])
    L.sweep(spark, folder, L.called(lambda m, p: ("success", " ABA\n" if p == "p0" else "abab", None, None)))
    assert {k: v[0] for k, v in states(spark, folder).items()} == {"i0": 1.0, "i1": 0.0, "i2": 0.0}


def row(k):
    return json.dumps(dict.fromkeys(ROW.fieldNames()) | {"run_id": "r", "model": "m", "model_id_resolved": "m", "item_id": "i", "sample_k": k, "response_raw": "x y", "elapsed_s": 1.5}, ensure_ascii=False)


def test_logs_in_many_splits(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        for name, tail, n in (("a", "", 300), ("b", '{"run_id', 300), ("c", row(300), 301)):
            (tmp_path / name).write_text("".join(row(k) + "\n" for k in range(300)) + tail)
            found = runs.read_rows(spark, str(tmp_path / name))
            assert found.rdd.getNumPartitions() > 4 and found.select("sample_k").distinct().count() == n
        (tmp_path / "d").write_text("".join((row(k) if k != 150 else "oops") + "\n" for k in range(300)))
        (tmp_path / "e").write_text(row(0) + "\noops\n")
        for name in "de":
            with pytest.raises(RunError):
                runs.read_rows(spark, str(tmp_path / name))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "blank").write_text(" \n\n")
    assert ledger.load_ledger(spark, str(tmp_path / "blank")).count() == 0
    (tmp_path / "gap").write_text("{}\n\n{}\n")
    with pytest.raises(LedgerError):
        ledger.load_ledger(spark, str(tmp_path / "gap"))


def digest(raw):
    return hashlib.sha256(raw).hexdigest()


def test_golden_manifests(spark, tmp_path):
    for name in ("good.md", "bad.md", "other.md"):
        (tmp_path / name).write_text(name)
    put = lambda bads: (tmp_path / "manifest.json").write_text(json.dumps({"bads": bads}))
    put([{"file": "bad.md", "verified_fails": True, "note": "x"}, {"file": "other.md", "verified_fails": False}])
    found = {r["expected"]: r for r in harvest.goldens(spark, str(tmp_path)).collect()}
    assert set(found) == {"pass", "flag"} and "\ngood.md\n" in found["pass"]["prompt"] and "\nbad.md\n" in found["flag"]["prompt"]
    for bad in ([{"file": "../x.md", "verified_fails": True}], [{"file": "", "verified_fails": True}], [{"file": "bad.md", "verified_fails": 1}], [{"verified_fails": True}], ["bad.md"], "none", [{"file": "absent.md", "verified_fails": True}]):
        put(bad)
        with pytest.raises(AuthorError):
            harvest.goldens(spark, str(tmp_path))


@pytest.fixture
def skills(tmp_path):
    for skill in ("plan it", "review"):
        at = tmp_path / "skills" / skill / "evals" / "golden"
        at.mkdir(parents=True)
        (at / "good.md").write_text(f"good é {skill}")
        (at / "bad.one.md").write_text("the same bad text")
        (at / "maybe.md").write_text("unverified")
        (at / "manifest.json").write_text(json.dumps({"bads": [{"file": "bad.one.md", "verified_fails": True}, {"file": "maybe.md", "verified_fails": False}]}))
    return tmp_path / "skills"


def test_goldens_of_all_skills_are_items(spark, skills, tmp_path, capsys):
    found = harvest.goldens(spark, str(skills)).collect()
    assert len(found) == 4 and found[0].__fields__ == ITEM.fieldNames()
    raw = "good é plan it".encode()
    (one,) = [r for r in found if r["id"] == f"golden-plan-it-good-{digest(raw)[:12]}"]
    assert one["tags"] == ["golden", "skill-eval", "skill-plan-it", "pass"] and one["difficulty_prior"] == 0.5
    assert one["provenance"] == f"harvested:plan it/evals/golden/good.md;sha256={digest(raw)}"
    assert one["prompt"] == f"Review the following skill-evaluation artifact. Return `pass` only if it meets the stated skill contract; otherwise return `flag`.\n\n--- artifact ---\n{raw.decode()}\n--- end artifact ---"
    do = lambda *a: (main([str(x) for x in a], spark), capsys.readouterr().out)
    code, said = do("author", "harvest", "--goldens", skills, "--suite", "draft", "--write", tmp_path / "draft")
    assert code == 0 and json.loads(said) == {"dropped": 1, "items": 3}  # two skills have one bad text
    assert do("validate", tmp_path / "draft")[0] == 0
    folder = L.start(spark, str(tmp_path / "runs"), suites.load_suite(spark, str(tmp_path / "draft")), ["m"])
    L.sweep(spark, folder, L.called(lambda model, prompt: ("success", "pass" if "--- artifact ---\ngood" in prompt else "flag", None, None)))
    assert {s[0] for s in states(spark, folder).values()} == {1.0}
    assert do("author", "harvest", "--goldens", skills, "--write", tmp_path / "lines")[0] == 0
    assert set(json.loads(spark.read.text(str(tmp_path / "lines")).first()[0])) == set(ITEM.fieldNames())


def test_sources_that_are_refused(spark, skills, tmp_path):
    at = skills / "review" / "evals" / "golden"
    with pytest.raises(AuthorError, match="no folder"):
        harvest.goldens(spark, str(tmp_path / "none"))
    (tmp_path / "empty").mkdir()
    for read in (harvest.goldens, harvest.reviews):
        with pytest.raises(AuthorError, match="no item"):
            read(spark, str(tmp_path / "empty"))
    (at / "good.md").unlink()
    (at / "good.md").symlink_to(at / "bad.one.md")
    with pytest.raises(AuthorError, match="is a link"):
        harvest.goldens(spark, str(skills))
    (at / "good.md").unlink()
    (at / "good.md").write_bytes(b"\xff\xfe")
    with pytest.raises(AuthorError, match="not UTF-8"):
        harvest.goldens(spark, str(skills))
    (at / "good.md").write_bytes(b"x" * (harvest.MAX_FILE + 1))
    with pytest.raises(AuthorError, match="bytes"):
        harvest.goldens(spark, str(skills))
    (at / "good.md").unlink()
    (skills / "linked").symlink_to(skills / "plan it")
    with pytest.raises(AuthorError, match="is a link"):
        harvest.goldens(spark, str(skills))


def test_review_fixtures(spark, tmp_path):
    lens = lambda name, verdict, **more: {"lens_id": name, "overall_verdict": verdict, "authority": "é", "findings": [{"b": 1, "a": [2]}], "secret": "x"} | more
    value = {"lens_verdicts": [lens("correctness", "PASS"), lens("style", "NEEDS-WORK", coverage_claim=None), lens("style", "SKIPPED"), lens("other", "unknown")]}
    raw = json.dumps(value, ensure_ascii=False)
    (tmp_path / "one two.json").write_text(raw)
    found = sorted(harvest.reviews(spark, str(tmp_path)).collect(), key=lambda r: r["tags"][2])
    assert [(r["tags"], r["expected"]) for r in found] == [(["review-deep", "review", "correctness", "pass"], "pass"), (["review-deep", "review", "style", "flag"], "flag")]
    assert [r["id"] for r in found] == [f"review-one-two-{x}-{digest((raw + x).encode())[:12]}" for x in ("correctness", "style")]
    assert all(r["provenance"] == f"harvested:one two.json;sha256={digest(raw.encode())}" and "overall_verdict" not in r["prompt"] and "secret" not in r["prompt"] for r in found)
    shown = {"authority": "é", "findings": [{"b": 1, "a": [2]}], "lens_id": "correctness"}
    assert f"--- correctness evidence ---\n{json.dumps(shown, indent=2, sort_keys=True)}\n--- end evidence ---" in found[0]["prompt"]
    for bad in ("[]", "{}", '{"lens_verdicts": [1]}', "no json", json.dumps({"lens_verdicts": [lens("style", "MAYBE")]}), json.dumps({"lens_verdicts": [lens("style", 3)]})):
        (tmp_path / "two.json").write_text(bad)
        with pytest.raises(AuthorError, match="two.json"):
            harvest.reviews(spark, str(tmp_path))


def test_git_patches(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True).stdout.decode()
    git("init", "-q")
    for k in range(3):
        (tmp_path / "f").write_text(f"line {k}\n")
        git("add", "f")
        git("commit", "-qm", f"c{k}")
    git("commit", "-qm", "nothing", "--allow-empty")
    found = harvest.patches(harvest.git_commits(spark, str(tmp_path), 3), 3).collect()
    assert len(found) == 2 and all(r["expected"] == "CURATE" for r in found) and {x for r in found for x in ("+line 1", "+line 2") if x in r["prompt"]} == {"+line 1", "+line 2"}
    for r in found:
        sha = r["provenance"].split(":")[2].split(";")[0]
        patch = git("show", "--format=", "--no-ext-diff", "--unified=0", "--no-renames", sha)
        assert r["id"] == f"git-{sha[:12]}-{digest(patch.encode())[:12]}" and r["provenance"] == f"harvested:git:{sha};sha256={digest(patch.encode())}"
        assert f"commit: {sha}\n--- patch ---\n{patch}\n--- end patch ---" in r["prompt"] and r["tags"] == ["git-history", "needs-gold", "candidate-only"]
    with pytest.raises(AuthorError, match="needs a verdict"):
        harvest.draft_suite(harvest.patches(harvest.git_commits(spark, str(tmp_path))), "s")
    with pytest.raises(AuthorError, match="no item"):
        harvest.patches(harvest.git_commits(spark, str(tmp_path), 1), 1)  # its patch is empty
    for bad in (0, 21):
        with pytest.raises(AuthorError):
            harvest.git_commits(spark, str(tmp_path), bad)
    with pytest.raises(AuthorError):
        harvest.git_commits(spark, str(tmp_path / "none"), 1)


def test_surfaces(spark, tmp_path, capsys):
    out, folder = tmp_path / "out", tmp_path / "suites"
    folder.mkdir()
    one, two = suite(n=9, tags=("a", "b")), suite("two", n=2)
    (folder / "one.json").write_text(json.dumps(one))
    (folder / "two.json").write_text(json.dumps(two))
    (folder / "odd.json").write_text("{}")

    def answers(model, prompt):
        return "success", "flag" if model == "good" or prompt in ("p0", "p1", "p2") else "pass", None, None

    for value in (one, one | {"scoring": {"type": "verdict", "labels": ["flag", "pass", "maybe"]}}, two):
        run = L.start(spark, str(out), suites.validate_suite(value), ["good", "poor"])
        L.sweep(spark, run, L.called(answers))
    mine = surfaces.stored_runs(spark, str(out))
    assert len(mine) == 3
    wanted = suites.suite_hash(suites.validate_suite(one))
    found = surfaces.calibrate(spark, mine, wanted, "poor")
    assert found["saturated"] == ["i0", "i1", "i2"] and found["histogram"] == {0: 1, 2: 6, 3: 2} and found["accepted"] and found["kill"]["halt"]
    tags, gaps = surfaces.profile(spark, mine, "good", wanted)
    assert [(t["tag"], t["n_items"]) for t in tags] == [("a", 9), ("b", 9)] and len(gaps) == 2 and gaps[0]["gap"] == pytest.approx(6 / 9, abs=1e-6)
    board = surfaces.leaderboard(spark, mine)
    groups = {(r["suite_hash"], r["fingerprint"]) for r in board}
    assert len(groups) == 3 and [(r["rank"], r["model"]) for r in board if r["suite_hash"] == wanted] == [(1, "good"), (2, "poor")] * 2
    do = lambda *a: (main([str(x) for x in a], spark), capsys.readouterr().out)
    assert {s["file"]: s["valid"] for s in json.loads(do("catalog", "--suites", folder)[1])} == {"odd.json": False, "one.json": True, "two.json": True}
    assert do("catalog", "--suites", folder, "--show", "none")[0] == 2
    code, said = do("calibrate", "--suite", folder / "one.json", "--out", out, "--reference", "poor")
    assert code == 1 and json.loads(said)["saturated"] == ["i0", "i1", "i2"]
    assert "| a | 9 |" in do("profile", "good", "--suite", folder / "one.json", "--out", out)[1]
    assert "| 1 | good |" in do("leaderboard", "--out", out)[1]
    assert do("export", "--suites", folder, "--out", out, "--write", tmp_path / "export")[0] == 0
    assert json.loads(spark.read.text(str(tmp_path / "export")).first()[0])["contract"] == 1
