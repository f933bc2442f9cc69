"""Command line: validate, run, smoke, score, report, calibrate, profile, leaderboard, catalog, export, refresh, claims, author.

Replies come from a Parquet table of recorded ones, from a command or from the
chat service of the configuration; judge samples likewise.  Data errors go to the error
stream with exit code 2; a failed gate or a stale claim gives 1.
"""

from __future__ import annotations

import argparse
import json
import shlex
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.config import RunConfig, load_config
from gaugeworks.errors import GaugeError
from gaugeworks.operators import evidence, reports
from gaugeworks.plans import lifecycle, refresh, surfaces
from gaugeworks.schemas import ITEM
from gaugeworks.sources import harvest, ledger, runs, services, suites


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="gaugeworks")
    sub = top.add_subparsers(dest="action", required=True)
    sub.add_parser("validate").add_argument("suite")
    for name in ("run", "smoke", "refresh"):
        p = sub.add_parser(name)
        if name == "refresh":
            p.add_argument("--suites", required=True, help="folder of suite files")
            p.add_argument("--yes", action="store_true", help="carry the plan out without asking")
        p.add_argument("--suite", required=name != "refresh", help="suite file; for refresh its name or file in the folder, else it is asked for")
        p.add_argument("--models")
        source = p.add_mutually_exclusive_group(required=True)
        source.add_argument("--replies", help="Parquet table of recorded replies")
        source.add_argument("--command", help="command that reads a prompt and prints a JSON envelope; {model} is the model")
        source.add_argument("--chat", action="store_true", help="chat service of the configuration")
        p.add_argument("--wave", type=int, default=lifecycle.WAVE, help="cells whose replies are kept together")
        p.add_argument("--samples", type=int)
        p.add_argument("--judges")
        p.add_argument("--budget", type=int)
        if name != "refresh":
            p.add_argument("--resume", metavar="RUN_ID")
        p.add_argument("--out", default="data")
        p.add_argument("--config")
        p.add_argument("--preregister")
    p = sub.add_parser("score")
    p.add_argument("run_id")
    p.add_argument("--judge-samples", help="Parquet table of recorded judge samples")
    p.add_argument("--command", help="command that grades, as for run")
    p.add_argument("--chat", action="store_true", help="judges of the chat service")
    p.add_argument("--samples", type=int, default=3, help="gradings by each judge")
    p.add_argument("--config")
    p.add_argument("--out", default="data")
    p = sub.add_parser("report")
    p.add_argument("run_id")
    p.add_argument("--compare", nargs="+", default=[])
    p.add_argument("--jsonl", action="store_true")
    p.add_argument("--out", default="data")
    for name in ("calibrate", "profile", "leaderboard"):
        p = sub.add_parser(name)
        p.add_argument("--out", default="data")
        p.add_argument("--json", action="store_true")
        if name == "profile":
            p.add_argument("model")
        if name != "leaderboard":
            p.add_argument("--suite", help="suite file; else the suite of the newest run")
            p.add_argument("--runs", nargs="+", help="run ids; else all")
        if name == "calibrate":
            p.add_argument("--reference", help="model that no other may lead by more than the margin")
    for name in ("catalog", "export"):
        p = sub.add_parser(name)
        p.add_argument("--suites", required=True, help="folder of suite files")
        p.add_argument("--show", help="one suite")
        p.add_argument("--out", default="data")
        if name == "export":
            p.add_argument("--write", required=True)
    p = sub.add_parser("claims")
    p.add_argument("what", choices=("list", "audit", "render"))
    p.add_argument("--ledger", required=True)
    p.add_argument("--files", help="folder of the cited files")
    p.add_argument("--index", help="folder of what earlier audits found; files that have not changed since are not read")
    p.add_argument("--write", help="new ledger with the audited statuses")
    p = sub.add_parser("author")
    p.add_argument("what", choices=("harvest", "stub"))
    p.add_argument("--goldens", help="golden folder, or the folder of skills that have one")
    p.add_argument("--reviews", help="folder of review fixtures")
    p.add_argument("--suite", help="write a draft suite of this name instead of items as JSON lines")
    p.add_argument("--patches", help="Parquet table (sha, committed_at, patch)")
    p.add_argument("--git", help="repository whose newest commits are read")
    p.add_argument("--limit", type=int, default=harvest.MAX_COMMITS, help="commits to read")
    p.add_argument("--name", default="stub")
    p.add_argument("--write", required=True)
    return top


def _names(value: str | None, default: tuple[str, ...]) -> list[str]:
    return [x.strip() for x in value.split(",") if x.strip()] if value is not None else list(default)


def _live(a: argparse.Namespace, config: RunConfig) -> lifecycle.Replies:
    """Replies of a command or of the configured service."""
    if a.command:
        return services.command(shlex.split(a.command), pool=config.cli_pool)
    return services.chat(config.local_base_url, config.local_max_tokens, config.local_timeout_s)


def _score(spark: SparkSession, a: argparse.Namespace) -> int:
    folder, samples = runs.run_dir(a.out, a.run_id), None
    if a.judge_samples:
        samples = spark.read.parquet(a.judge_samples)
    elif a.command or a.chat:
        config = load_config(a.config)
        manifest, suite = runs.open_run(spark, folder)
        samples = lifecycle.judged(spark, folder, manifest["judges"] or list(config.judges), a.samples, _live(a, config))
    print(json.dumps(lifecycle.score(spark, folder, samples), sort_keys=True))
    return 0


def _surfaces(spark: SparkSession, a: argparse.Namespace) -> int:
    if a.action in ("catalog", "export"):
        if a.action == "export":
            runs.write_once(spark, surfaces.export(spark, a.suites, a.out), a.write)
            return 0
        found = [s for s in surfaces.catalog(spark, a.suites) if a.show in (None, s.get("suite"), s["file"])]
        if a.show and not found:
            raise GaugeError(f"{a.suites} has no suite {a.show}")
        print(json.dumps(found, sort_keys=True))
        return 0
    if a.action == "leaderboard":
        rows = surfaces.leaderboard(spark, surfaces.stored_runs(spark, a.out))
        print(json.dumps(rows, sort_keys=True) if a.json else surfaces.render_leaderboard(rows))
        return 0
    folders = [runs.run_dir(a.out, x) for x in a.runs] if a.runs else surfaces.stored_runs(spark, a.out)
    wanted = suites.suite_hash(suites.load_suite(spark, a.suite)) if a.suite else None
    if a.action == "profile":
        tags, gaps = surfaces.profile(spark, folders, a.model, wanted)
        print(json.dumps({"tags": tags, "gaps": gaps}, sort_keys=True) if a.json else surfaces.render_profile(a.model, tags, gaps))
        return 0
    found = surfaces.calibrate(spark, folders, wanted, a.reference)
    print(json.dumps(found, sort_keys=True))
    return int(bool(found["kill"] and found["kill"]["halt"]))


def _run(spark: SparkSession, a: argparse.Namespace) -> int:
    suite, config = suites.load_suite(spark, a.suite), load_config(a.config)
    if a.resume:
        folder = runs.run_dir(a.out, a.resume)
        if runs.read_manifest(spark, folder)["suite_hash"] != suites.suite_hash(suite):
            raise GaugeError(f"{a.resume} was started with another suite")
    else:
        samples, budget = config.samples_per_cell if a.samples is None else a.samples, config.max_calls if a.budget is None else a.budget
        folder = lifecycle.start(spark, a.out, suite, _names(a.models, config.roster), samples, _names(a.judges, config.judges), budget, config.config_source, a.preregister)
    if a.chat and a.action == "smoke" and not services.reachable(config.local_base_url):
        raise GaugeError(f"{config.local_base_url} takes no connection")
    replies = lifecycle.recorded(spark.read.parquet(a.replies)) if a.replies else _live(a, config)
    print(json.dumps(lifecycle.sweep(spark, folder, replies, a.wave), sort_keys=True))
    if a.action == "run":
        return 0
    failed = reports.smoke_gate(reports.model_report(lifecycle.rows(spark, folder))).where("not passed").orderBy("model").collect()
    print(lifecycle.render(*lifecycle.report(spark, folder)))
    for r in failed:
        print(f"{r['model']}: {r['reasons']}", file=sys.stderr)
    left = lifecycle.rows(spark, folder).limit(1).count() == 0
    return int(bool(failed) or left)


def _asked(question: str) -> str:
    """An answer from the terminal; none at the end of the input."""
    try:
        return input(question).strip()
    except EOFError:
        return ""


def _refresh(spark: SparkSession, a: argparse.Namespace) -> int:
    config, found = load_config(a.config), refresh.choices(spark, a.suites)
    if a.suite:
        chosen = [x for x in found if a.suite in (x["suite"], x["file"])]
        if len(chosen) != 1:
            raise GaugeError(f"{a.suites} has {len(chosen)} valid suites {a.suite}")
    else:
        for i, x in enumerate(found, 1):
            print(f"{i}\t{x['suite']}\t{x['n_items']} items\t{x['suite_hash'][:12]}\t{x['description']}")
        answer = _asked("suite: ")
        chosen = [found[int(answer) - 1]] if answer.isascii() and answer.isdigit() and 1 <= int(answer) <= len(found) else []
    if not chosen:
        print("cancelled")
        return 0
    samples, budget = config.samples_per_cell if a.samples is None else a.samples, config.max_calls if a.budget is None else a.budget
    plan = refresh.plan(spark, f"{a.suites.rstrip('/')}/{chosen[0]['file']}", a.out, _names(a.models, config.roster), budget, samples, _names(a.judges, config.judges))
    print(plan.render())
    if not a.yes and _asked("carry this out (yes or no)? ") != "yes":
        print("cancelled")
        return 0
    replies = lifecycle.recorded(spark.read.parquet(a.replies)) if a.replies else _live(a, config)
    print(json.dumps(refresh.execute(spark, plan, replies, a.wave, config.config_source, a.preregister), sort_keys=True))
    return 0


def _report(spark: SparkSession, a: argparse.Namespace) -> int:
    folders = [runs.run_dir(a.out, x) for x in (a.run_id, *a.compare)]
    if a.compare:
        print(lifecycle.compare(spark, folders))
    else:
        print((lifecycle.jsonl if a.jsonl else lifecycle.render)(*lifecycle.report(spark, folders[0])))
    return 0


def _claims(spark: SparkSession, a: argparse.Namespace) -> int:
    claims = ledger.load_ledger(spark, a.ledger)
    if a.what == "render":
        print(ledger.render(claims))
        return 0
    if a.what == "list":
        for r in claims.select("claim_id", "status", "statement").orderBy("claim_id").collect():
            print(f"{r['claim_id']}\t{r['status']}\t{r['statement']}")
        return 0
    if not a.files:
        raise GaugeError("an audit needs --files")
    cited = evidence.sources(claims)
    if a.index:
        checked, fresh = evidence.audit_changed(cited, ledger.file_versions(spark, a.files, cited), ledger.load_index(spark, a.index), lambda wanted: ledger.file_texts(spark, a.files, wanted))
        found = checked.where("reason is not null")
        fresh.write.mode("append").parquet(a.index)
    else:
        found = evidence.issues(cited, ledger.file_texts(spark, a.files, cited))
    audited = evidence.audit(claims, found)
    for r in found.select("claim_id", "file", "reason").orderBy("claim_id", "file").collect():
        print(f"{r['claim_id']}\t{r['file']}\t{r['reason']}")
    if a.write and audited.where("newly_stale").take(1):
        ledger.write_ledger(audited.drop("newly_stale"), a.write)
    return int(bool(audited.where("status = 'STALE'").take(1)))


def _author(spark: SparkSession, a: argparse.Namespace) -> int:
    if a.what == "stub":
        item = {"id": "replace-me", "tags": ["replace-me"], "prompt": "replace me", "expected": "pass", "difficulty_prior": 0.5, "provenance": "authored:stub"}
        stub = {"suite": a.name, "version": 1, "description": "replace me", "domain": "replace-me", "scoring": {"type": "verdict", "labels": ["pass", "flag"]}, "items": [item]}
        suites.validate_suite(stub)
        runs.write_once(spark, stub, a.write)
        return 0
    parts = [harvest.goldens(spark, a.goldens)] if a.goldens else []
    parts += [harvest.reviews(spark, a.reviews)] if a.reviews else []
    parts += [harvest.patches(spark.read.parquet(a.patches), a.limit)] if a.patches else []
    parts += [harvest.patches(harvest.git_commits(spark, a.git, a.limit), a.limit)] if a.git else []
    if not parts:
        raise GaugeError("name a source: --goldens, --reviews, --patches or --git")
    everything = evidence.union_sources(parts)
    kept = evidence.dedup(everything, ["prompt", "expected"], ["source_ordinal", "id"])
    if a.suite:
        suite = harvest.draft_suite(kept, a.suite)
        suites.validate_suite(suite)
        runs.write_once(spark, suite, a.write)
        wrote = len(suite["items"])
    else:
        kept.select(F.to_json(F.struct(*sorted(ITEM.fieldNames()))).alias("value")).write.mode("errorifexists").text(a.write)
        wrote = spark.read.text(a.write).count()
    print(json.dumps({"dropped": everything.count() - wrote, "items": wrote}))
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("gaugeworks").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        if a.action == "validate":
            suite = suites.load_suite(spark, a.suite)
            print(f"{suite['suite']} {len(suite['items'])} items {suites.suite_hash(suite)}")
            return 0
        done = {"run": _run, "smoke": _run, "refresh": _refresh, "score": _score, "report": _report, "claims": _claims, "author": _author}
        return done.get(a.action, _surfaces)(spark, a)
    except GaugeError as e:
        print(f"gaugeworks: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
