"""What stored runs say together: calibration, profiles, leaderboards, the suite catalog and their export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.errors import GaugeError, ReportError
from gaugeworks.functions.text import score_text
from gaugeworks.operators import calibration as C
from gaugeworks.operators import reports
from gaugeworks.plans import lifecycle
from gaugeworks.sources import runs, suites, versions

CONTRACT = 1


def stored_runs(spark: SparkSession, root: str) -> list[str]:
    """Folders of the runs below ``root``, by name."""
    return [f"{root.rstrip('/')}/{x}" for x in versions.names(spark, root) if runs.RUN_ID.match(x)]


def _of_suite(spark: SparkSession, folders: list[str], wanted: str | None = None) -> tuple[dict, list[str]]:
    """(suite, folders) of the runs of one instrument: the one of hash ``wanted``, else of the newest run."""
    opened = [(f, *runs.open_run(spark, f)) for f in folders]
    if not opened:
        raise ReportError("there are no runs")
    wanted = wanted or max(opened, key=lambda x: (x[1]["started_utc"], x[1]["run_id"]))[1]["suite_hash"]
    mine = [(f, s) for f, m, s in opened if m["suite_hash"] == wanted]
    if not mine:
        raise ReportError(f"no run of the suite {wanted}")
    return mine[0][1], [f for f, _ in mine]


def all_rows(spark: SparkSession, folders: list[str]) -> DataFrame:
    out = lifecycle.rows(spark, folders[0])
    for f in folders[1:]:
        out = out.unionByName(lifecycle.rows(spark, f))
    return out


def calibrate(spark: SparkSession, folders: list[str], suite_hash: str | None = None, reference: str | None = None, low: float = 5.0, high: float = 95.0) -> dict:
    """Difficulty histogram, saturated items, acceptance band and kill criterion of a suite's runs."""
    suite, mine = _of_suite(spark, folders, suite_hash)
    rows = all_rows(spark, mine)
    items = C.item_difficulty(rows).select("item_id", F.col("difficulty").alias("difficulty_prior"), "saturated")
    report = reports.model_report(rows)
    band = [r.asDict() for r in C.acceptance_band(report, low, high).orderBy("model").collect()]
    kill = C.kill_criterion(report, reference).first().asDict() if reference else None
    return {
        "suite": suite["suite"], "suite_hash": suites.suite_hash(suite), "histogram": {r["bucket"]: r["n"] for r in C.histogram(items).orderBy("bucket").collect()},
        "saturated": [r[0] for r in items.where("saturated").orderBy("item_id").select("item_id").collect()], "band": band, "accepted": all(b["in_band"] for b in band), "kill": kill,
    }


def profile(spark: SparkSession, folders: list[str], model: str, suite_hash: str | None = None, least: int = 8) -> tuple[list[dict], list[dict]]:
    """(tags of a model from strongest to weakest, gaps between models by tag) over the runs of one suite."""
    suite, mine = _of_suite(spark, folders, suite_hash)
    tags = suites.item_frame(spark, suite).select("item_id", F.explode("tags").alias("tag"))
    rows = all_rows(spark, mine).where("score is not null").join(tags, "item_id")
    ranked = C.tag_profile(rows, least).where(F.col("model") == model).orderBy("rank", "tag")
    gaps = C.tag_gap(rows.join(C.tag_profile(rows, least).select("tag").distinct(), "tag", "left_semi")).orderBy(F.desc("gap"), "tag")
    return [r.asDict() for r in ranked.collect()], [r.asDict() for r in gaps.collect()]


def render_profile(model: str, tags: list[dict], gaps: list[dict]) -> str:
    lines = [f"| {t['tag']} | {t['n_items']} | {t['accuracy']:.3f} | {t['delta']:+.3f} | {t['rank']} |" for t in tags]
    widest = [f"| {g['tag']} | {g['gap']:.3f} |" for g in gaps]
    return "\n".join([f"# {model}", "", "| tag | items | accuracy | to the mean | rank |", "|-|-|-|-|-|", *lines, "", "| tag | gap between models |", "|-|-|", *widest, ""])


#: Why an entry has no rank: its run was started before fingerprints were kept.
LEGACY = "incomparable_legacy"


def leaderboard(spark: SparkSession, folders: list[str]) -> list[dict]:
    """Models of the newest run of each (suite, way of scoring, model), ranked within comparable groups only.

    Entries of runs without a fingerprint come last, each by itself, without a rank and with the reason as ``refused``.
    """
    entries = []
    for folder in folders:
        manifest, suite = runs.open_run(spark, folder)
        models = lifecycle.report(spark, folder)[1]
        same = {"suite": suite["suite"], "suite_hash": manifest["suite_hash"], "fingerprint": manifest["fingerprint"], "run_id": manifest["run_id"], "started": manifest["started_utc"]}
        entries += [same | {k: m[k] for k in ("model", "suite_score", "n_items", "n_scored", "n_parse_fail")} for m in models if m["n_cells"]]
    if not entries:
        return []
    schema = "suite string, suite_hash string, fingerprint string, run_id string, started string, model string, score double, n_items long, n_scored long, n_parse_fail long"
    table = spark.createDataFrame([tuple(e.values()) for e in entries], schema).where("score is not null")
    latest = reports.latest_runs(table.where("fingerprint is not null"), ["suite_hash", "fingerprint", "model"])
    ranked = reports.leaderboard(latest).withColumn("refused", F.lit(None).cast("string"))
    legacy = table.where("fingerprint is null").withColumns({"rank": F.lit(None).cast("int"), "refused": F.lit(LEGACY)})
    order = [F.col("refused").asc_nulls_first(), "suite", "suite_hash", "fingerprint", "rank", "model", "started", "run_id"]
    return [r.asDict() for r in ranked.unionByName(legacy).orderBy(*order).collect()]


def render_leaderboard(rows: list[dict]) -> str:
    out, now = [], None
    for r in rows:
        group = (r["suite"], r["suite_hash"], r["fingerprint"])
        if group != now:
            out += ["", f"## {r['suite']} ({r['suite_hash'][:12]}, scoring {(r['fingerprint'] or r['refused'])[:20]})", "", "| rank | model | score | items | scored | parse fail | run |", "|-|-|-|-|-|-|-|"]
            now = group
        out.append(f"| {'-' if r['rank'] is None else r['rank']} | {r['model']} | {score_text(r['score'])} | {r['n_items']} | {r['n_scored']} | {r['n_parse_fail']} | {r['run_id']} |")
    return "\n".join(["# Leaderboard", *out, ""])


def catalog(spark: SparkSession, folder: str) -> list[dict]:
    """The suites of a folder; one that breaks a rule stays in the list as invalid, with the reason."""
    out = []
    for name in versions.names(spark, folder):
        if not name.endswith(".json"):
            continue
        try:
            suite = suites.load_suite(spark, f"{folder.rstrip('/')}/{name}")
        except GaugeError as e:
            out.append({"file": name, "valid": False, "reason": str(e)})
            continue
        tags = sorted({t for item in suite["items"] for t in item["tags"]})
        provenance = sorted({item["provenance"].split(";")[0] for item in suite["items"]})
        about = {k: suite[k] for k in ("suite", "version", "description", "domain", "scoring")}
        out.append({"file": name, "valid": True, **about, "n_items": len(suite["items"]), "tags": tags, "provenance": provenance, "suite_hash": suites.suite_hash(suite), "fingerprint": suites.fingerprint(suite)})
    return out


def export(spark: SparkSession, suite_folder: str, root: str) -> dict:
    """One versioned object of the catalog and the leaderboard."""
    return {"contract": CONTRACT, "catalog": catalog(spark, suite_folder), "leaderboard": leaderboard(spark, stored_runs(spark, root))}
