"""The evidence ledger and the harvest of candidate items."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.text import let, quote_hash
from gaugeworks.schemas import STATUSES
from gaugeworks.sources.tables import written

REVIEW = {"PASS": "pass", "DEFERRED-TO-UAT": "pass", "FAILED": "flag", "NEEDS-WORK": "flag", "NO-EVIDENCE": "flag"}


def line_range(lines: Column) -> tuple[Column, Column]:
    """Bounds of ``N`` or ``N-M``; null if malformed or empty."""
    first = F.nullif(F.regexp_extract(lines, r"\A([1-9]\d*)(?:-([1-9]\d*))?\z", 1), F.lit("")).try_cast("int")
    last = F.coalesce(F.nullif(F.regexp_extract(lines, r"\A([1-9]\d*)(?:-([1-9]\d*))?\z", 2), F.lit("")).try_cast("int"), first)
    good = last >= first
    return F.when(good, first), F.when(good, last)


def sources(claims: DataFrame) -> DataFrame:
    """One row per cited source of nested claims."""
    cited = claims.select("claim_id", "status", F.posexplode("sources").alias("ordinal", "source"))
    first, last = line_range(F.col("source.lines"))
    return cited.select("claim_id", "status", "ordinal", F.col("source.file").alias("file"), first.alias("line_from"), last.alias("line_to"), F.col("source.quote_sha256").alias("quote_sha256"))


def issues(cited: DataFrame, files: DataFrame) -> DataFrame:
    """Sources whose file is missing, whose lines are not there or whose quote has changed."""
    joined = cited.join(files.select("file", "text"), "file", "left")
    live = quote_hash(F.col("text"), F.col("line_from"), F.col("line_to"))
    reason = let(live, lambda now: F.when(F.col("text").isNull(), "missing_file").when(now.isNull(), "bad_lines").when(now != F.col("quote_sha256"), "quote_changed"))
    # exploding a list of none or one keeps the hash out of a filter, where it would be computed again
    return joined.select(*cited.columns, F.explode(F.array_compact(F.array(reason))).alias("reason"))


#: Quotes of versions of files, as an audit has found them: null where the lines are not there.
QUOTE_INDEX = "file string, version string, line_from int, line_to int, quote_now string"


def audit_changed(cited: DataFrame, state: DataFrame, index: DataFrame, read: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(cited with reason, null where all is well, and was_read; new entries of the index).

    ``state`` has (file, version) of all files there are, ``index`` what earlier
    audits found.  Only quotes that no audit has seen in this version of their
    file are looked up, and ``read`` gets (file, version) of just those files,
    to give (file, text).  Entries are found by file, version and lines, so a
    changed file needs a new version and nothing else.
    """
    key = ["file", "version", "line_from", "line_to"]
    live = cited.join(state.select("file", "version"), "file", "left")
    asked = live.where("version is not null and line_from is not null and line_to is not null").select(*key).distinct()
    unknown = asked.join(index.select(*key), key, "left_anti")
    texts = read(unknown.select("file", "version").distinct()).select("file", "text")
    now = quote_hash(F.col("text"), F.col("line_from"), F.col("line_to"))
    fresh = written(unknown.join(texts, "file").select(*key, now.alias("quote_now")))
    known = index.select(*key, "quote_now").withColumn("was_read", F.lit(False)).unionByName(fresh.withColumn("was_read", F.lit(True)))
    found = live.join(known, key, "left").withColumn("was_read", F.coalesce("was_read", F.lit(False)))
    stale = F.when(F.col("version").isNull(), "missing_file").when(F.col("quote_now").isNull(), "bad_lines").when(F.col("quote_now") != F.col("quote_sha256"), "quote_changed")
    return found.withColumn("reason", stale).select(*cited.columns, "reason", "was_read"), fresh


def audit(claims: DataFrame, found: DataFrame) -> DataFrame:
    """Claims with any issue become STALE and never come back; ``newly_stale`` marks the change."""
    bad = found.select("claim_id").distinct().withColumn("_bad", F.lit(True))
    marked = claims.join(bad, "claim_id", "left").withColumn("_bad", F.coalesce("_bad", F.lit(False)))
    return marked.withColumn("newly_stale", F.col("_bad") & (F.col("status") != "STALE")).withColumn("status", F.when(F.col("_bad"), "STALE").otherwise(F.col("status"))).drop("_bad")


def by_status(claims: DataFrame) -> DataFrame:
    """Counts in the fixed order of statuses, zeros included."""
    dim = claims.sparkSession.createDataFrame(list(enumerate(STATUSES)), "ordinal int, status string")
    counts = claims.groupBy("status").agg(F.count("*").alias("n"))
    return dim.join(counts, "status", "left").select("ordinal", "status", F.coalesce("n", F.lit(0)).alias("n"))


def measured_violations(claims: DataFrame) -> DataFrame:
    """MEASURED claims without evidence or preregistration."""
    return claims.where("status = 'MEASURED' and (coalesce(size(evidence), 0) < 1 or preregistration is null)")


def dedup(candidates: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first candidate of each content; ``order`` must break all ties."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return candidates.withColumn("_n", first).where("_n = 1").drop("_n")


def approved(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Bad examples that the manifest has verified to fail."""
    return files.join(manifest.where("verified_fails").select("file"), "file", "left_semi")


def review_gold(verdict: Column) -> Column:
    """pass or flag; null for a skipped lens; anything else is an error upstream."""
    table = F.create_map(*(F.lit(x) for pair in REVIEW.items() for x in pair))
    return F.try_element_at(table, verdict)


def union_sources(parts: list[DataFrame]) -> DataFrame:
    """All candidates, in the order of their sources."""
    numbered = [p.withColumn("source_ordinal", F.lit(i)) for i, p in enumerate(parts)]
    out = numbered[0]
    for p in numbered[1:]:
        out = out.unionByName(p)
    return out
