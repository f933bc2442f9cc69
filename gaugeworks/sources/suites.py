"""Suites: strict JSON, never inferred, one error family."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.errors import SuiteError
from gaugeworks.functions.text import canonical_hash
from gaugeworks.schemas import ITEM, SCORING_TYPES

SUITE_KEYS = {"suite", "version", "description", "domain", "scoring", "items"}
_NAME = re.compile(r"[A-Za-z0-9._\-]+\Z")


def read_bytes(spark: SparkSession, path: str, error: type[ValueError]) -> bytes:
    """A small control file, through Spark so that any store will do."""
    try:
        row = spark.read.format("binaryFile").load(path).select("content").first()
    except Exception as e:
        raise error(f"{path} cannot be read: {str(e)[:200]}") from e
    if row is None:
        raise error(f"{path} is missing")
    return bytes(row[0])


def literal_paths(paths: list[str]) -> list[str]:
    """Paths that a reader takes as they are, whatever signs of patterns are in them."""
    return [re.sub(r"([\\{}\[\]*?])", r"\\\1", p) for p in paths]


def strict_json(raw: bytes, where: str, error: type[ValueError]) -> dict:
    try:
        value = json.loads(raw.decode("utf-8"))
    except (UnicodeDecodeError, ValueError, RecursionError) as e:
        raise error(f"{where} is not JSON: {e}") from e
    if not isinstance(value, dict):
        raise error(f"{where} is not an object")
    return value


def check_keys(value: dict, required: set[str], optional: set[str], where: str, error: type[ValueError]) -> None:
    unknown, missing = set(value) - required - optional, required - set(value)
    if unknown:
        raise error(f"{where} has unknown keys {sorted(unknown)}")
    if missing:
        raise error(f"{where} lacks keys {sorted(missing)}")


def safe_name(value: object, where: str, error: type[ValueError]) -> str:
    if not isinstance(value, str) or not _NAME.match(value) or not any(c.isalnum() for c in value):
        raise error(f"{where} is no safe name: {value!r}")
    return value


def text(value: object, where: str, error: type[ValueError]) -> str:
    if not isinstance(value, str) or not value:
        raise error(f"{where} must be a non-empty text")
    try:
        value.encode("utf-8")
    except UnicodeEncodeError as e:
        raise error(f"{where} holds a lone surrogate") from e
    return value


def whole(value: object, least: int, where: str, error: type[ValueError]) -> int:
    if type(value) is not int or value < least:
        raise error(f"{where} must be a whole number of at least {least}")
    return value


def share(value: object, where: str, error: type[ValueError]) -> float:
    if type(value) not in (int, float) or not 0 <= value <= 1:  # NaN fails the comparison
        raise error(f"{where} must be a number from 0 to 1")
    return float(value)


def texts(value: object, where: str, error: type[ValueError]) -> list[str]:
    if not isinstance(value, list):
        raise error(f"{where} must be a list")
    return [text(x, where, error) for x in value]


def validate_suite(value: dict, where: str = "suite") -> dict:
    """The suite with priors as floats; raises SuiteError, never gives part of one."""
    check_keys(value, SUITE_KEYS, set(), where, SuiteError)
    scoring = value["scoring"]
    if not isinstance(scoring, dict):
        raise SuiteError(f"{where} scoring must be an object")
    check_keys(scoring, {"type"}, {"labels", "regex"}, f"{where} scoring", SuiteError)
    if scoring["type"] not in SCORING_TYPES:
        raise SuiteError(f"{where} scoring type {scoring['type']!r} is unknown")
    regex = scoring.get("regex", False)
    if type(regex) is not bool or regex and scoring["type"] != "exact":
        raise SuiteError(f"{where} regex is a flag of exact scoring only")
    labels = scoring.get("labels")
    if labels is not None:
        labels = texts(labels, f"{where} labels", SuiteError)
        if len({x.casefold() for x in labels}) < len(labels):
            raise SuiteError(f"{where} labels differ in case only")
    if not isinstance(value["items"], list) or not value["items"]:
        raise SuiteError(f"{where} needs at least one item")
    items = []
    for i, item in enumerate(value["items"]):
        here = f"{where} item {i}"
        if not isinstance(item, dict):
            raise SuiteError(f"{here} must be an object")
        check_keys(item, set(ITEM.fieldNames()), set(), here, SuiteError)
        out = {k: text(item[k], f"{here} {k}", SuiteError) for k in ("prompt", "expected", "provenance")}
        out |= {"id": safe_name(item["id"], f"{here} id", SuiteError), "tags": texts(item["tags"], f"{here} tags", SuiteError), "difficulty_prior": share(item["difficulty_prior"], f"{here} difficulty_prior", SuiteError)}
        if regex:
            try:
                re.compile(out["expected"])
            except (re.error, RecursionError) as e:
                raise SuiteError(f"{here} pattern does not compile: {e}") from e
        items.append(out)
    if len({x["id"] for x in items}) < len(items):
        raise SuiteError(f"{where} repeats an item id")
    return {
        "suite": safe_name(value["suite"], f"{where} name", SuiteError),
        "version": whole(value["version"], 1, f"{where} version", SuiteError),
        "description": text(value["description"], f"{where} description", SuiteError),
        "domain": text(value["domain"], f"{where} domain", SuiteError),
        "scoring": {"type": scoring["type"], "labels": labels, "regex": regex},
        "items": items,
    }


def load_suite(spark: SparkSession, path: str) -> dict:
    return validate_suite(strict_json(read_bytes(spark, path, SuiteError), path, SuiteError), path)


def item_frame(spark: SparkSession, suite: dict) -> DataFrame:
    rows = [tuple(x[f] for f in ITEM.fieldNames()) for x in suite["items"]]
    return spark.createDataFrame(rows, ITEM).withColumn("item_id", F.col("id"))


def suite_hash(suite: dict) -> str:
    return canonical_hash(suite["items"])


#: To be raised with every change of how replies become scores.
SCORING_VERSION = 1


def fingerprint(suite: dict) -> str:
    """How a suite is scored, by its rules and by this version; runs with another one are not comparable even over the same items."""
    rules = {k: v for k, v in suite["scoring"].items() if v is not None and (v or k != "regex")}
    return hashlib.sha256(json.dumps({"scoring": rules, "version": SCORING_VERSION}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
