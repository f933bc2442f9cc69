"""The evidence ledger: strict JSON lines."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.errors import LedgerError
from gaugeworks.functions.text import BLANKS
from gaugeworks.operators.evidence import QUOTE_INDEX, line_range
from gaugeworks.schemas import CLAIM, STATUSES
from gaugeworks.sources.runs import log_lines
from gaugeworks.sources.suites import literal_paths

_REQUIRED = {"claim_id", "statement", "decision_surface", "sources", "status", "evidence", "last_verified_utc"}


def violations(claims: DataFrame) -> DataFrame:
    """(claim_id, reason) of every rule that a claim breaks."""
    blank = lambda c: F.coalesce(F.btrim(F.col(c), F.lit(BLANKS)) == "", F.lit(True))
    source = lambda rule: F.exists("sources", lambda x: ~F.coalesce(rule(x), F.lit(False)))
    path = lambda x: x["file"].rlike(r"\A[^\\:/][^\\:]*\z") & ~F.exists(F.split(x["file"], "/"), lambda p: p.isin("", ".", ".."))
    when = F.col("last_verified_utc")
    rules = {
        "blank text": blank("claim_id") | blank("statement") | blank("decision_surface"),
        "no source": F.coalesce(F.size("sources"), F.lit(0)) < 1,
        "bad lines": source(lambda x: line_range(x["lines"])[0].isNotNull()),
        "unsafe path": source(path),
        "bad hash": source(lambda x: x["quote_sha256"].rlike(r"\A[0-9a-f]{64}\z")),
        "unknown status": ~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)),
        "bad evidence": F.exists("evidence", lambda e: F.coalesce(e == "", F.lit(True))) | (F.size(F.array_distinct("evidence")) < F.size("evidence")),
        "bad time": ~F.coalesce(when.endswith("Z") & F.try_to_timestamp(when).isNotNull(), F.lit(False)),
        "measured without proof": (F.col("status") == "MEASURED") & ((F.coalesce(F.size("evidence"), F.lit(0)) < 1) | F.col("preregistration").isNull()),
    }
    found = F.array_compact(F.array(*(F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items())))
    twice = claims.groupBy("claim_id").agg(F.count("*").alias("n")).where("n > 1").select("claim_id", F.lit("repeated id").alias("reason"))
    return claims.select("claim_id", F.explode(found).alias("reason")).unionByName(twice)


def load_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Claims; any blank or broken line, unknown or missing key, or broken rule is fatal."""
    lines = log_lines(spark, path)
    if not lines.where(F.btrim("line", F.lit(BLANKS)) != "").take(1):
        return spark.createDataFrame([], CLAIM)
    keys, names = F.json_object_keys("line"), CLAIM.fieldNames()
    unknown = F.size(F.array_except(keys, F.array(*map(F.lit, names)))) > 0
    missing = F.size(F.array_except(F.array(*map(F.lit, sorted(_REQUIRED))), keys)) > 0
    bad = lines.where(F.try_parse_json("line").isNull() | F.coalesce(unknown | missing, F.lit(True))).take(3)
    if bad:
        raise LedgerError(f"bad ledger lines: {[r['line'][:60] for r in bad]}")
    claims = lines.select(F.from_json("line", CLAIM).alias("c")).select("c.*")
    broken = violations(claims).take(5)
    if broken:
        raise LedgerError(f"claims break rules: {[tuple(r) for r in broken]}")
    return claims


def _relative(spark: SparkSession, folder: str) -> Column:
    """The path of a file below ``folder``."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    root = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).toUri().getPath().rstrip("/")
    path = F.url_decode(F.regexp_replace(F.regexp_replace("path", r"\A[a-z0-9]+:(?://[^/]*)?", ""), r"\+", "%2B"))
    return F.substring(path, len(root) + 2, 1 << 20)


def _empty(spark: SparkSession, folder: str, names: DataFrame) -> DataFrame:
    """(file): those of ``names`` that are files without a byte, which Spark's readers pass over."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    store = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = []
    for (name,) in names.select("file").distinct().collect():
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root, name)
        if store.exists(path) and store.getFileStatus(path).isFile() and not store.getFileStatus(path).getLen():
            found.append((name,))
    return spark.createDataFrame(found, "file string")


def file_versions(spark: SparkSession, folder: str, cited: DataFrame) -> DataFrame:
    """(file, version) below a folder: length and time of change, from the listing alone.

    Of the files that ``cited`` names and Spark does not list, the empty ones are looked up one by one.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    found = found.select(_relative(spark, folder).alias("file"), F.concat_ws("/", "length", F.unix_micros("modificationTime")).alias("version"))
    return found.unionByName(_empty(spark, folder, cited.join(found, "file", "left_anti")).withColumn("version", F.lit("0")))


def file_texts(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """(file, text) of ``wanted`` (file, ..) below a folder, as far as they are there.

    A ledger is curated by hand, so the files that it cites are few enough to be named one by one.
    """
    file = _relative(spark, folder)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", file.alias("file"))
    paths = [r[0] for r in listed.join(wanted.select("file").distinct(), "file", "left_semi").select("path").collect()]
    empty = _empty(spark, folder, wanted.join(listed, "file", "left_anti")).withColumn("text", F.lit(""))
    if not paths:
        return empty
    return spark.read.format("binaryFile").load(literal_paths(paths)).select(file.alias("file"), F.decode("content", "UTF-8").alias("text")).unionByName(empty)


def load_index(spark: SparkSession, folder: str) -> DataFrame:
    """What audits with this index have found; none before the first."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(QUOTE_INDEX).parquet(folder).distinct() if there else spark.createDataFrame([], QUOTE_INDEX)


def write_ledger(claims: DataFrame, path: str) -> None:
    """Validated before anything is written; keys in a fixed order, rows by id."""
    broken = violations(claims).take(5)
    if broken:
        raise LedgerError(f"claims break rules: {[tuple(r) for r in broken]}")
    claims.orderBy("claim_id").select(F.to_json(F.struct(*sorted(CLAIM.fieldNames())), {"ignoreNullFields": "false"}).alias("value")).write.mode("errorifexists").text(path)


def render(claims: DataFrame) -> str:
    """A Markdown table by status; a ledger is curated by hand, so it is small."""
    rows = claims.select("status", "claim_id", "statement").orderBy("claim_id").collect()
    cell = lambda x: re.sub(r"[\r\n]", " ", x.replace("\\", "\\\\").replace("|", "\\|"))
    out = []
    for status in STATUSES:
        mine = [r for r in rows if r["status"] == status]
        out += [f"## {status} ({len(mine)})", "", "| claim | statement |", "|-|-|", *(f"| {cell(r['claim_id'])} | {cell(r['statement'])} |" for r in mine), ""]
    return "\n".join(out)
