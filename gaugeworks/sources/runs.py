"""Run stores: manifest, suite snapshot and row log, as JSON lines in and out and as Parquet inside."""

from __future__ import annotations

import json
import re
import secrets
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.errors import RunError
from gaugeworks.schemas import MANIFEST, ROW
from gaugeworks.sources.suites import check_keys, read_bytes, strict_json, suite_hash, validate_suite
from gaugeworks.sources.versions import create_once

RUN_ID = re.compile(r"\Arun_\d{8}T\d{6}Z_[0-9a-f]{6}\Z")


def mint_run_id(now: datetime | None = None) -> str:
    return f"run_{(now or datetime.now(timezone.utc)):%Y%m%dT%H%M%SZ}_{secrets.token_hex(3)}"


def run_dir(root: str, run_id: str) -> str:
    if not RUN_ID.match(run_id):
        raise RunError(f"{run_id!r} is no run id")
    return f"{root.rstrip('/')}/{run_id}"


def read_manifest(spark: SparkSession, folder: str) -> dict:
    """The manifest; runs from before fingerprints were kept have none."""
    value = strict_json(read_bytes(spark, f"{folder}/manifest.json", RunError), "manifest", RunError)
    check_keys(value, set(MANIFEST.fieldNames()) - {"fingerprint"}, {"fingerprint"}, "manifest", RunError)
    return {"fingerprint": None} | value


def open_run(spark: SparkSession, folder: str) -> tuple[dict, dict]:
    """(manifest, suite); the snapshot must be the suite that the manifest names."""
    manifest = read_manifest(spark, folder)
    suite = validate_suite(strict_json(read_bytes(spark, f"{folder}/suite.json", RunError), "suite snapshot", RunError))
    if suite_hash(suite) != manifest["suite_hash"]:
        raise RunError("the suite snapshot is not the one of the manifest")
    return manifest, suite


_TYPES = {"string": "STRING", "double": "DOUBLE|DECIMAL.*|BIGINT", "int": "BIGINT", "array<double>": "ARRAY.*"}
_NULLABLE = {"parsed", "score", "scorer", "judge_scores", "error"}


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, last, torn) of JSON-lines logs: ``torn`` marks a last line without its newline.

    Files are split between tasks as any text.  The bytes of a file's lines,
    each with a newline, make one more than its size where the last one has none.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("_size"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("_at"), F.col("value").alias("line")
    )
    files = lines.groupBy("file").agg(F.max("_at").alias("_last"), (F.sum(F.octet_length("line") + 1) > F.max("_size")).alias("_open"))
    last = F.col("_at") == F.col("_last")
    return lines.join(files, "file").select("file", "line", last.alias("last"), (last & F.col("_open")).alias("torn"))


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON-lines log, tolerant of one torn tail.

    A line is bad if it is no object, lacks or adds a key, or has a value of
    another type.  A bad last line that lacks its newline is dropped; any
    other bad line is fatal, and the check runs before rows are given out.
    """
    lines = log_lines(spark, path)
    doc = F.try_parse_json("line")
    keys = F.json_object_keys("line")
    names = ROW.fieldNames()
    good = doc.isNotNull() & F.coalesce(F.size(F.array_except(keys, F.array(*map(F.lit, names)))) == 0, F.lit(False)) & F.coalesce(F.size(keys) == len(names), F.lit(False))
    for f in ROW.fields:
        kind = F.schema_of_variant(F.try_variant_get(doc, f"$.{f.name}", "variant"))
        fits = kind.rlike(rf"\A(?:{_TYPES[f.dataType.simpleString()]})\z")
        good = good & F.coalesce(fits | (kind == "VOID") if f.name in _NULLABLE else fits, F.lit(f.name in _NULLABLE))
    marked = lines.withColumn("good", good)
    broken = marked.where("not good and not torn").select("file", F.substring("line", 1, 60).alias("line")).take(3)
    if broken:
        raise RunError(f"bad rows before the tail: {[tuple(r) for r in broken]}")
    return marked.where("good").select(F.from_json("line", ROW).alias("r")).select("r.*")


def write_once(spark: SparkSession, value: dict, path: str) -> None:
    """A control object as a JSON file; refuses to overwrite, also what another writer has just made."""
    if not create_once(spark, path, json.dumps(value, sort_keys=True) + "\n"):
        raise RunError(f"{path} is there already")


def check_same_rows(before: DataFrame, after: DataFrame) -> None:
    if before.count() != after.count():
        raise RunError("a run scorer must give one row per row")
