"""Refresh of a benchmark in two steps: a plan that is looked at, and its execution.

A plan writes nothing and may simply be dropped.  It names the suite, the last
comparable result of each model (same items, same way of scoring), the cells to
fill and the most calls, and whether an unfinished run is taken up again.  It
is bound to what was shown: a suite that has changed since, or a run that
somebody else has filled or started, makes the execution refuse.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.errors import RunError
from gaugeworks.functions.text import score_text
from gaugeworks.operators import cells, reports
from gaugeworks.plans import lifecycle, surfaces
from gaugeworks.sources import runs, suites, versions


@dataclass(frozen=True)
class Refresh:
    path: str
    root: str
    suite: dict
    suite_hash: str
    fingerprint: str
    roster: tuple[str, ...]
    judges: tuple[str, ...]
    samples: int
    budget: int
    #: Newest comparable result of each model: (model, run_id, started_utc, score, scored cells).
    last: tuple[tuple[str, str, str, float | None, int], ...]
    #: Folder of the unfinished run that is taken up again, and the commit of its rows that was looked at.
    resumes: str | None
    version: int
    pending: int

    def render(self) -> str:
        """What there is to decide on, as Markdown."""
        known = {m: (run, started, score, n) for m, run, started, score, n in self.last}
        line = lambda m: f"| {m} | {known[m][0]} | {known[m][1]} | {score_text(known[m][2])} | {known[m][3]} |" if m in known else f"| {m} | - | - | - | 0 |"
        cells = len(self.suite["items"]) * self.samples * len(self.roster)
        how = f"takes up {self.resumes.rpartition('/')[2]} again" if self.resumes else "starts a new run"
        return "\n".join([
            f"# Refresh of {self.suite['suite']}", "", self.suite["description"], "", f"Items {self.suite_hash}, scoring {self.fingerprint}", "",
            "| model | last run | started | score | scored |", "|-|-|-|-|-|", *map(line, self.roster), "",
            f"{how[0].upper()}{how[1:]}: {self.pending} of {cells} cells, at most {min(self.budget, self.pending)} calls (budget {self.budget}).", "",
        ])


def choices(spark: SparkSession, suite_folder: str) -> list[dict]:
    """Catalog entries that can be refreshed."""
    return [x for x in surfaces.catalog(spark, suite_folder) if x["valid"]]


def _comparable(spark: SparkSession, root: str, suite: dict) -> list[tuple[str, dict]]:
    """(folder, manifest) of the runs of this instrument, newest first; runs without a fingerprint are not comparable."""
    mine = []
    for folder in surfaces.stored_runs(spark, root):
        manifest = runs.read_manifest(spark, folder)
        if (manifest["suite_hash"], manifest["fingerprint"]) == (suites.suite_hash(suite), suites.fingerprint(suite)):
            mine.append((folder, manifest))
    return sorted(mine, key=lambda x: (x[1]["started_utc"], x[1]["run_id"]), reverse=True)


def _pending(spark: SparkSession, suite: dict, roster: list[str], samples: int, done: DataFrame) -> int:
    models = spark.createDataFrame([(m,) for m in roster], "model string")
    return cells.pending_cells(suites.item_frame(spark, suite), models, samples, done).count()


def plan(spark: SparkSession, path: str, root: str, roster: list[str], budget: int, samples: int = 1, judges: list[str] = ()) -> Refresh:
    """What a refresh of the suite at ``path`` would do; every parameter is checked, nothing is written."""
    suite = suites.load_suite(spark, path)
    roster, judges = lifecycle.checked(roster, samples, judges, budget)
    lifecycle.scorer(suite)
    mine = _comparable(spark, root, suite)
    entries = [(*key, m["model"], m["suite_score"], m["n_scored"]) for f, x in mine for key in [(x["run_id"], x["started_utc"])] for m in lifecycle.report(spark, f)[1] if m["n_cells"]]
    table = spark.createDataFrame(entries, "run_id string, started string, model string, score double, n_scored long")
    last = reports.latest_runs(table.where("score is not null"), ["model"]).orderBy("model").select("model", "run_id", "started", "score", "n_scored").collect()
    same = [(f, x) for f, x in mine if (x["roster"], x["samples_per_cell"], x["judges"]) == (roster, samples, judges)]
    resumes, version, pending = None, -1, len(suite["items"]) * samples * len(roster)
    if same:  # only the newest: an older one that was left has been overtaken
        seen = versions.current(spark, f"{same[0][0]}/rows")
        left = _pending(spark, suite, roster, samples, versions.read(spark, f"{same[0][0]}/rows", lifecycle.ROW, seen))
        if left:
            resumes, version, pending = same[0][0], seen.number, left
    return Refresh(path, root, suite, suites.suite_hash(suite), suites.fingerprint(suite), tuple(roster), tuple(judges), samples, budget, tuple(map(tuple, last)), resumes, version, pending)


def execute(spark: SparkSession, refresh: Refresh, replies: lifecycle.Replies, wave: int = lifecycle.WAVE, config_source: str = "defaults", preregistration: str | None = None) -> dict:
    """Carry a plan out, at most ``budget`` calls; gives the summary of the sweep."""
    suite = suites.load_suite(spark, refresh.path)
    if (suites.suite_hash(suite), suites.fingerprint(suite)) != (refresh.suite_hash, refresh.fingerprint):
        raise RunError(f"{refresh.path} has changed since the refresh was planned")
    if refresh.resumes and versions.current(spark, f"{refresh.resumes}/rows").number != refresh.version:
        raise RunError(f"{refresh.resumes} has got rows since the refresh was planned")
    folder = refresh.resumes or lifecycle.start(spark, refresh.root, suite, list(refresh.roster), refresh.samples, list(refresh.judges), refresh.budget, config_source, preregistration)
    return lifecycle.sweep(spark, folder, replies, wave, most=refresh.budget)
