"""Runs from start to report: start, sweep or resume, score, report, compare.

A run's folder holds ``manifest.json`` and ``suite.json``, written once, and
``rows``, a log of commits (``sources.versions``) of Parquet, partitioned by run
and model.  A sweep commits wave by wave; live replies are journaled below
``calls`` as they come (``sources.calls``), so neither a lost executor nor a
failed wave loses one.  Scoring replaces all rows by one commit once they are
checked.  Several sweeps may fill one run: a cell counts once.  Scores that
another commit has overtaken are refused, and the run is to be scored again.
Replies come from a table of recorded ones, from a service or a command line
(``sources.services``) or from a caller in Python that runs within the executors.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.errors import AdapterError, BudgetExhausted, ReportError, RunError, ScoringError
from gaugeworks.functions import text as X
from gaugeworks.operators import cells, judging, reports
from gaugeworks.operators.ordinals import numbered
from gaugeworks.schemas import CELL, NO_RESPONSE, PARSE_FAIL, REASONS, ROW
from gaugeworks.sources import runs, services, suites, versions
from gaugeworks.sources.calls import Budget, Calls
from gaugeworks.sources.tables import remove

#: (model, prompt) -> (state, text, reason, resolved model); state is success, no_response or error.
Caller = Callable[[str, str], tuple[str, str, str | None, str | None]]
Replies = services.Replies

#: Rows lie by run and model, so that reports prune and never read replies they do not need.
BY = ["run_id", "model"]
REPLY = "state string, response_raw string, reason string, model_id_resolved string, elapsed_s double"


def newest(spark: SparkSession, folder: str) -> int:
    """How often the rows of a run have been replaced by newly scored ones."""
    return versions.current(spark, f"{folder}/rows").generation


def rows(spark: SparkSession, folder: str) -> DataFrame:
    return versions.read(spark, f"{folder}/rows", ROW)


def checked(roster: list[str], samples: int, judges: list[str], budget: int) -> tuple[list[str], list[str]]:
    """(roster, judges), each name once, if they and the numbers keep the rules."""
    roster, judges = list(dict.fromkeys(roster)), list(dict.fromkeys(judges))
    if not roster:
        raise RunError("the roster is empty")
    for name in (*roster, *judges):
        suites.safe_name(name, "model", RunError)
    suites.whole(samples, 1, "samples", RunError)
    suites.whole(budget, 1, "budget", RunError)
    return roster, judges


def start(spark: SparkSession, root: str, suite: dict, roster: list[str], samples: int = 1, judges: list[str] = (), budget: int = 500, config_source: str = "defaults", preregistration: str | None = None, now: datetime | None = None) -> str:
    """The folder of a new run; every parameter is checked before anything is written."""
    roster, judges = checked(roster, samples, judges, budget)
    now = now or datetime.now(timezone.utc)
    run_id = runs.mint_run_id(now)
    folder = runs.run_dir(root, run_id)
    manifest = {
        "run_id": run_id, "suite": suite["suite"], "suite_hash": suites.suite_hash(suite), "roster": roster, "samples_per_cell": samples, "judges": judges,
        "started_utc": f"{now:%Y-%m-%dT%H:%M:%SZ}", "config_source": config_source, "budgets": {"max_calls": budget}, "preregistration": preregistration,
        "fingerprint": suites.fingerprint(suite),
    }
    runs.write_once(spark, manifest, f"{folder}/manifest.json")
    runs.write_once(spark, {**suite, "scoring": {k: v for k, v in suite["scoring"].items() if v is not None and (v or k != "regex")}}, f"{folder}/suite.json")
    return folder


def scorer(suite: dict) -> tuple[Column, Column, str | None]:
    """(parsed, score, name) over response_raw and expected; rubric suites are only collected by a sweep."""
    kind, reply, expected = suite["scoring"]["type"], F.col("response_raw"), F.col("expected")
    if kind == "rubric":
        return F.lit(None).cast("string"), F.lit(None).cast("double"), None
    if kind == "exact":
        same = all(X.portable(x["expected"].strip()) for x in suite["items"])
        score = X.exact_regex_score(reply, expected, same) if suite["scoring"]["regex"] else X.exact_score(reply, expected)
        return X.exact_parsed(score), score, "exact"
    labels = suite["scoring"]["labels"]
    if not labels or PARSE_FAIL in {x.casefold() for x in labels}:
        raise ScoringError("a verdict suite needs labels, none of them parse_fail")
    label = X.verdict_label(reply, labels)
    return F.coalesce(label, F.lit(PARSE_FAIL)), X.verdict_score(label, expected), "verdict"


def recorded(table: DataFrame) -> Replies:
    """Replies of table(model, item_id, sample_k, state, response_raw, reason, model_id_resolved, elapsed_s); cells without one are errors."""
    names = [x.split()[0] for x in REPLY.split(", ")]

    def replies(todo: DataFrame) -> DataFrame:
        found = todo.join(table.select(*CELL, *names), CELL, "left")
        return found.withColumns({"state": F.coalesce("state", F.lit("error")), "reason": F.when(F.col("state").isNull(), "unreachable").otherwise(F.col("reason")), "response_raw": F.coalesce("response_raw", F.lit(""))})

    return replies


def _sound(reply: tuple) -> bool:
    """Whether a caller's reply keeps the contract that ``_checked`` holds it to."""
    state, text, reason = reply[:3]
    return state == "no_response" or (state == "success" and isinstance(text, str) and bool(text.strip())) or (state == "error" and reason in REASONS)


def called(call: Caller, pool: int = 2) -> Replies:
    """Replies of a caller, at most ``pool`` at a time; an exception is an error of the operating system."""
    fields = REPLY.rpartition(", ")[0]

    def replies(todo: DataFrame, calls: Calls | None = None) -> DataFrame:
        return services.each(todo, call, ("error", "", "os_error", None), fields, pool, calls, _sound)

    return services.live(replies)


#: Cells whose replies are kept together.
WAVE = 1000
_BAD_REPLY = "a reply breaks the contract"


def _checked(done: DataFrame) -> DataFrame:
    """Rows whose reply keeps the contract: a known reason for an error, a text that is not blank for a success."""
    known = F.coalesce(F.col("reason").isin(*REASONS), F.lit(False))
    spoken = F.coalesce(X.strip(F.col("response_raw")) != "", F.lit(False))
    bad = (F.col("state") == "error") & ~known | (F.col("state") == "success") & ~spoken | ~F.coalesce(F.col("state").isin("success", "no_response", "error"), F.lit(False))
    told = F.concat(F.lit(f"{_BAD_REPLY}: "), F.coalesce("state", F.lit("no state")), F.lit(" "), F.coalesce("reason", F.lit("without reason")))
    # written with the rows, so the check cannot be left out
    return done.withColumn("error", F.when(bad, F.raise_error(told)).when(F.col("state") == "error", F.col("reason")))


def sweep(spark: SparkSession, folder: str, replies: Replies, wave: int = WAVE, budget: Budget | None = None, most: int | None = None) -> dict:
    """Fill pending cells in sweep order, ``wave`` cells at a time, until none is left or the calls are spent.

    Pending cells are numbered once; a wave is a range of numbers.  ``budget``
    may be shared with other steps; else ``most`` calls, or the run's number of
    them, are dealt anew, so that another sweep resumes with a fresh one.  Live replies are
    journaled until their wave is committed; cells that found no call left stay pending.
    """
    suites.whole(wave, 1, "wave", RunError)
    manifest, suite = runs.open_run(spark, folder)
    items = suites.item_frame(spark, suite)
    places = spark.createDataFrame([(x["id"], i) for i, x in enumerate(suite["items"])], "item_id string, _item int")
    models = spark.createDataFrame(list(enumerate(manifest["roster"])), "_model int, model string")
    cells.check_no_orphans(rows(spark, folder), items)
    parsed, score, name = scorer(suite)
    most, target = most or manifest["budgets"]["max_calls"], f"{folder}/rows"
    live = getattr(replies, "live", False)
    calls = Calls(f"{folder}/calls/journal", budget or Budget.deal(f"{folder}/calls", most)) if live else None
    executed, waiting, refused, at = 0, None, True, 0
    while refused:  # what one task gave back may be enough for cells that another had to leave
        seen = versions.current(spark, target)
        known = set(seen.parts)
        left = cells.pending_cells(items, models, manifest["samples_per_cell"], versions.read(spark, target, ROW, seen)).join(places, "item_id").join(models, "model")
        left = numbered(left, ["_model", "_item", "sample_k"], "_number").drop("_model", "_item")
        count, at, refused = left.count(), 0, False
        waiting = count if waiting is None else waiting
        while at < count:
            room = calls.budget.reclaim() + sum(1 for _ in calls.answered()) if calls else most - executed
            if not (size := min(wave, count - at, room)):
                break
            todo = left.where((F.col("_number") >= at) & (F.col("_number") < at + size)).drop("_number").join(items.select("item_id", "prompt", "expected"), "item_id")
            found = replies(todo, calls) if live else replies(todo).withColumn("refused", F.lit(False))
            done = _checked(cells.build_rows(found.where("not refused").drop("refused"), parsed, score, name))
            silent = F.col("error").isNotNull() | (F.coalesce(F.col("scorer"), F.lit("")) == NO_RESPONSE)
            full = done.withColumns({
                "run_id": F.lit(manifest["run_id"]), "model_id_resolved": F.coalesce("model_id_resolved", "model"), "judge_scores": F.lit(None).cast("array<double>"),
                "elapsed_s": F.coalesce("elapsed_s", F.lit(0.0)), "response_raw": F.when(silent, "").otherwise(F.col("response_raw")),
            })
            try:
                part, added, others = versions.append(full.select(*ROW.fieldNames()), target, known, CELL, BY)
            except PySparkException as e:
                if _BAD_REPLY in str(e):
                    raise AdapterError(str(e)[str(e).index(_BAD_REPLY) :].split("\n")[0]) from e
                raise
            if calls:
                calls.forget(spark)
            known.add(part)
            executed, waiting, at, refused = executed + added, waiting - others, at + size, refused or added + others < size
        refused = refused and bool(calls and calls.budget.reclaim())
    return {"run_id": manifest["run_id"], "executed": executed, "pending": waiting - executed, "aborted": waiting > executed}


def score(spark: SparkSession, folder: str, samples: DataFrame | None = None) -> dict:
    """Score a run anew; rubric suites need judge samples(model, item_id, sample_k, judge, ok, response_raw), whose ``reply`` is the judge's text.

    Orphan rows and the judges' gate raise before anything is written.
    """
    _, suite = runs.open_run(spark, folder)
    seen = versions.current(spark, f"{folder}/rows")
    items, now = suites.item_frame(spark, suite), versions.read(spark, f"{folder}/rows", ROW, seen)
    cells.check_no_orphans(now, items)
    if suite["scoring"]["type"] == "rubric":
        if samples is None:
            raise ScoringError("a rubric suite is scored from judge samples")
        cell = F.to_json(F.struct(*CELL))
        read = judging.parsed_samples(samples.select("judge", cell.alias("item_id"), "ok", "response_raw"))
        judging.check_gate(judging.parse_stats(read))
        per_judge = judging.medians(read).groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("judge", F.col("median").alias("m")))).alias("_j"))
        scored = judging.item_scores(read).join(per_judge, "item_id", "left").select(F.col("item_id").alias("_cell"), F.col("score").alias("_score"), F.col("parsed").alias("_parsed"), F.transform("_j", lambda x: x["m"]).alias("_judges"))
        joined = now.withColumn("_cell", cell).join(scored, "_cell", "left")
        out = cells.rescore(joined, F.col("_parsed"), F.coalesce("_score", F.lit(0.0)), "rubric")
        judged = F.col("error").isNull() & (F.coalesce("scorer", F.lit("")) != NO_RESPONSE)
        out = out.withColumn("judge_scores", F.when(judged, F.coalesce("_judges", F.array().cast("array<double>"))).otherwise(F.col("judge_scores")))
    else:
        parsed, value, name = scorer(suite)
        out = cells.rescore(now.join(items.select("item_id", "expected"), "item_id"), parsed, value, name)
    part = versions.write(out.select(*ROW.fieldNames()), f"{folder}/rows", BY)
    made = versions.Version(parts=(part,))
    runs.check_same_rows(now, versions.read(spark, f"{folder}/rows", ROW, made))
    done = versions.commit(spark, f"{folder}/rows", seen, part, replace=True)
    return reports.score_summary(versions.read(spark, f"{folder}/rows", ROW, done)).first().asDict()


def judged(spark: SparkSession, folder: str, judges: list[str], samples: int, replies: Replies, budget: Budget | None = None) -> DataFrame:
    """Judge samples of a run, written below its folder before they are read, so that no judge is called twice.

    Gradings spend ``budget``, or the run's number of calls dealt anew.  Where
    they do not do, BudgetExhausted is raised; what was answered is journaled, and the next try goes on from there.
    """
    if not judges:
        raise ScoringError("a rubric run needs judges")
    for name in judges:
        suites.safe_name(name, "judge", ScoringError)
    suites.whole(samples, 1, "samples", ScoringError)
    manifest, suite = runs.open_run(spark, folder)
    if suite["scoring"]["type"] != "rubric":
        raise ScoringError("only rubric suites have judges")
    target = f"{folder}/judged/v{newest(spark, folder):06d}"
    live = getattr(replies, "live", False)
    calls = Calls(f"{folder}/calls/judges", budget or Budget.deal(f"{folder}/calls", manifest["budgets"]["max_calls"])) if live else None
    while True:
        made = services.judge_samples(rows(spark, folder), suites.item_frame(spark, suite), judges, samples, replies, calls)
        made.write.mode("overwrite").parquet(target)
        found = spark.read.schema(made.schema).parquet(target)
        if not (missing := found.where("refused").count()):
            break
        if not calls.budget.reclaim():
            remove(spark, target)
            raise BudgetExhausted(f"{missing} gradings found no call left")
    if calls:
        calls.forget(spark)
    return found.drop("refused")


def report(spark: SparkSession, folder: str) -> tuple[dict, list[dict]]:
    """(manifest, roll-ups): models in roster order, with or without rows, others after them by name."""
    manifest = runs.read_manifest(spark, folder)
    roster = spark.createDataFrame([(m, i) for i, m in enumerate(manifest["roster"])], "model string, ordinal int")
    found = reports.roster_report(reports.model_report(rows(spark, folder)), roster)
    return manifest, [r.asDict() for r in found.orderBy(F.asc_nulls_last("ordinal"), "model").collect()]


def render(manifest: dict, models: list[dict]) -> str:
    """Markdown that depends on the run alone."""
    table = [f"| {m['model']} | {X.score_text(m['suite_score'])} | {m['n_items']} | {m['n_scored']} | {m['n_no_response']} | {m['n_parse_fail']} | {m['n_error']} |" for m in models]
    head = [f"# Run {manifest['run_id']}", "", f"Suite {manifest['suite']} ({manifest['suite_hash']}), started {manifest['started_utc']}", ""]
    return "\n".join([*head, "| model | score | items | scored | no response | parse fail | error |", "|-|-|-|-|-|-|-|", *table, ""])


def jsonl(manifest: dict, models: list[dict]) -> str:
    same = {k: manifest[k] for k in ("run_id", "suite", "suite_hash")}
    drop = ("ordinal", "listed")
    return "\n".join(json.dumps(same | {k: v for k, v in m.items() if k not in drop}, sort_keys=True) for m in models)


def compare(spark: SparkSession, folders: list[str]) -> str:
    """Models against runs of one instrument: ``-`` where a model was not run, n/a where it has no score."""
    if not folders:
        raise ReportError("nothing to compare")
    built = [report(spark, f) for f in folders]
    reports.check_same_instrument(spark.createDataFrame([(m["suite_hash"],) for m, _ in built], "suite_hash string"))
    if len({m["fingerprint"] for m, _ in built if m["fingerprint"]}) > 1:
        raise ReportError("runs that were scored in different ways cannot be compared")
    scores = [{m["model"]: m["suite_score"] for m in models} for _, models in built]
    lines = [f"| {name} | " + " | ".join(X.score_text(s[name]) if name in s else "-" for s in scores) + " |" for name in sorted(set().union(*scores))]
    return "\n".join(["| model | " + " | ".join(m["run_id"] for m, _ in built) + " |", "|-" * (len(built) + 1) + "|", *lines, ""])
