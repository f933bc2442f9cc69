"""Text functions: stripping, folding, hashing, label and score extraction, as Columns where Spark can say it."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from itertools import accumulate, pairwise

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 29 code points that Unicode text stripping removes.
BLANKS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def casefold(c: Column, ascii_only: bool = False) -> Column:
    """Full case folding.  ASCII text needs only ``lower``, which stays in the JVM; ``ascii_only`` promises it."""
    if ascii_only:
        return F.lower(c)

    @F.pandas_udf("string")
    def full(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None else x.casefold())

    return full(c)


def folded_equal(a: Column, b: Column, ascii_only: bool = False) -> Column:
    return casefold(strip(a), ascii_only) == casefold(strip(b), ascii_only)


def exact_score(response: Column, expected: Column, ascii_only: bool = False) -> Column:
    return F.when(folded_equal(response, expected, ascii_only), 1.0).otherwise(0.0)


#: What means the same to Java and to Python: literals, classes, groups, bounded repeats and the usual escapes.
_PORTABLE = re.compile(r"(?:[^\\()\[\]]|\\[dswDSWbBnrt.*+?()\[\]{}|^$/\\\-]|\(\?[:=!]|\((?!\?)|\)|\[\^?(?:[^\\\[\]&~|]|\\[dswDSWnrt.*+?()\[\]{}|^$/\\\-])+\])*", re.S)


def portable(pattern: str) -> bool:
    """Whether Spark matches a pattern as Python does; named groups, conditions and inner flags are Python's own."""
    return _PORTABLE.fullmatch(pattern) is not None and not re.search(r"[*+?}]\+", pattern)


def exact_regex_score(response: Column, pattern: Column, portable_only: bool = True) -> Column:
    """Full match of the stripped response, any case, dot matching line ends.

    ``portable_only`` promises that every pattern is ``portable``; without it
    patterns are matched in Python.
    """
    if portable_only:
        return F.when(F.rlike(strip(response), F.concat(F.lit("(?isuU)\\A(?:"), strip(pattern), F.lit(")\\z"))), 1.0).otherwise(0.0)

    @F.pandas_udf("double")
    def matched(texts: pd.Series, patterns: pd.Series) -> pd.Series:
        known = {p: re.compile(p.strip(), re.I | re.S) for p in patterns.dropna().unique()}
        return pd.Series([None if x is None or p is None else float(known[p].fullmatch(x.strip()) is not None) for x, p in zip(texts, patterns)], dtype="float64")

    return F.coalesce(matched(response, pattern), F.lit(0.0))


def exact_parsed(score: Column) -> Column:
    return F.when(score == 1.0, "match").otherwise("no_match")


# --- verdict ladder -------------------------------------------------------------------------

# Keys of a verdict, first wins.
VERDICT_KEYS = ("verdict", "label", "answer", "classification")


def labels_present(text: Column, labels: list[str]) -> Column:
    """Labels that stand in the text between non-alphanumerics (underscore parts words), in suite order."""
    found = [F.when(text.rlike(f"(?iu)(?<![A-Za-z0-9])\\Q{x}\\E(?![A-Za-z0-9])"), F.lit(x)) for x in labels]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def unique_label(text: Column, labels: list[str]) -> Column:
    found = labels_present(text, labels)
    return F.when(F.size(found) == 1, F.element_at(found, 1))


#: A quoted string, closed or running to the end, or a brace outside of strings.
_QUOTED_OR_BRACE = re.compile(r'"(?:[^"\\]|\\.?)*+"?|[{}]', re.S)


def json_spans(text: str) -> list[tuple[int, int]]:
    """Bounds of top-level {...} spans; a quote opens a string wherever it stands."""
    braces = [(m.start(), m[0]) for m in _QUOTED_OR_BRACE.finditer(text) if m[0] in "{}"]
    depths = pairwise(accumulate((1 if brace == "{" else -1 for _, brace in braces), lambda depth, step: max(depth + step, 0), initial=0))
    borders = [(at, step) for (at, _), step in zip(braces, depths) if step in ((0, 1), (1, 0))]
    return [(a, b + 1) for (a, _), (b, _) in zip(borders[::2], borders[1::2])]


def _json_objects(text: str) -> list[tuple[int, int, dict]]:
    """The top-level spans that are well-formed JSON, with their values."""
    found = []
    for a, b in json_spans(text):
        try:
            found.append((a, b, json.loads(text[a:b])))
        except (ValueError, RecursionError):
            pass
    return found


def _only_label(text: object, labels: list[str]) -> str | None:
    """The one label that a text has between non-alphanumerics."""
    if not isinstance(text, str):
        return None
    named = {x for x in labels if re.search(f"(?<![A-Za-z0-9]){re.escape(x)}(?![A-Za-z0-9])", text, re.I)}
    return named.pop() if len(named) == 1 else None


def json_tier(text: str, labels: list[str]) -> tuple[list[str], str]:
    """(labels told by JSON objects, the text with well-formed JSON blanked)."""
    objects = _json_objects(text)
    edges = [0, *(x for a, b, _ in objects for x in (a, b)), len(text)]
    rest = " ".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
    told = []
    for *_, value in objects:
        folded = {k.casefold(): v for k, v in value.items()}
        answers = (_only_label(folded.get(key), labels) for key in VERDICT_KEYS)
        told += [x for x in answers if x][:1]
    return told, rest


def verdict_label(text: Column, labels: list[str]) -> Column:
    """The label of a reply, or null: JSON verdicts, then labelled lines, then prose.

    Two different labels in the first or second tier end the search.  Only
    texts with a brace go through Python.
    """
    if not labels:
        return F.lit(None).cast("string")

    @F.pandas_udf("told array<string>, rest string")
    def objects(s: pd.Series) -> pd.DataFrame:
        rows = [json_tier(x, labels) if x and "{" in x else ([], x) for x in s]
        return pd.DataFrame(rows, columns=["told", "rest"])

    told = objects(text)
    first = F.array_distinct(told["told"])
    lines = F.regexp_extract_all(text, F.lit(r"(?imd)^[^\S\n]*(?:verdict|label|answer|classification)[^\S\n]*[:=][^\S\n]*(.*?)[^\S\n]*$"), F.lit(1))
    second = F.array_distinct(F.array_compact(F.transform(lines, lambda x: unique_label(x, labels))))
    ladder = F.when(F.size(first) > 1, F.lit(None)).when(F.size(first) == 1, F.element_at(first, 1))
    ladder = ladder.when(F.size(second) > 1, F.lit(None)).when(F.size(second) == 1, F.element_at(second, 1))
    return ladder.otherwise(unique_label(told["rest"], labels))


def verdict_score(label: Column, expected: Column, ascii_only: bool = False) -> Column:
    return F.when(label.isNull(), 0.0).when(folded_equal(label, expected, ascii_only), 1.0).otherwise(0.0)


# --- judges ---------------------------------------------------------------------------------

# The grading prompt.
JUDGE_PROMPT = (
    "You are grading a model's response against a rubric. Score the response on a 0-10 scale per the rubric below.\n\n"
    "RUBRIC:\n", "\n\nPROMPT GIVEN TO THE MODEL:\n", "\n\nMODEL RESPONSE TO GRADE:\n",
    "\n\nReply with EXACTLY these two lines and nothing else:\nSCORE: <an integer or decimal from 0 to 10>\nRATIONALE: <one or two sentences explaining the score>\n",
)


def judge_prompt(prompt: Column, response: Column, rubric: Column) -> Column:
    a, b, c, d = map(F.lit, JUDGE_PROMPT)
    return F.concat(a, rubric, b, prompt, c, response, d)


def judge_score(text: Column) -> Column:
    """The first well-formed SCORE of a reply, clamped to 0..10; null if there is none."""
    found = F.regexp_extract(text, r"(?iuU)SCORE\s*:\s*(-?\d+(?:\.\d+)?)(?![\w.])", 1)
    value = F.nullif(found, F.lit("")).try_cast("double")
    return F.when(value.isNotNull(), F.least(F.lit(10.0), F.greatest(F.lit(0.0), value)))


# --- hashing and names ----------------------------------------------------------------------


def canonical_hash(items: list[dict]) -> str:
    """sha256 of items as JSON with sorted keys, no blanks, ASCII; the priors as floats."""
    rows = [{**x, "difficulty_prior": float(x["difficulty_prior"])} if "difficulty_prior" in x else x for x in items]
    return hashlib.sha256(json.dumps(rows, sort_keys=True, separators=(",", ":"), ensure_ascii=True).encode()).hexdigest()


def content_hash(prompt: Column, expected: Column) -> Column:
    """Canonical hash of a candidate."""

    @F.pandas_udf("string")
    def run(p: pd.Series, e: pd.Series) -> pd.Series:
        return pd.Series([hashlib.sha256(json.dumps({"expected": y, "prompt": x}, sort_keys=True, separators=(",", ":"), ensure_ascii=True).encode()).hexdigest() for x, y in zip(p, e)])

    return run(prompt, expected)


def slug(c: Column) -> Column:
    out = F.btrim(F.regexp_replace(c, "[^A-Za-z0-9._-]+", "-"), F.lit(".-_"))
    return F.when(out == "", "artifact").otherwise(out)


def item_id(prefix: Column, name: Column, content: Column) -> Column:
    return F.concat_ws("-", prefix, slug(name), F.substring(F.sha2(content, 256), 1, 12))


def provenance(path: Column, content: Column) -> Column:
    return F.concat(F.lit("harvested:"), path, F.lit(";sha256="), F.sha2(content, 256))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_lines(text: Column) -> Column:
    """Lines at every Unicode line end; a last empty one does not count."""
    return let(F.split(text, LINE_ENDS), lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts))


def quote_hash(text: Column, first: Column, last: Column | None = None) -> Column:
    """sha256 of lines first..last (from 1; to the end without ``last``), joined by newlines; null outside the text."""

    def quoted(lines: Column) -> Column:
        end = F.size(lines) if last is None else last
        return F.when((first >= 1) & (first <= end) & (end <= F.size(lines)), F.array_join(F.slice(lines, first, end - first + 1), "\n"))

    return F.sha2(let(text_lines(text), quoted), 256)


def csv_names(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), strip), lambda x: x != "")


def markdown_cell(c: Column) -> Column:
    return F.regexp_replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")), "[\r\n]", " ")


def score_text(x: float | None) -> str:
    return "n/a" if x is None else f"{x:.1f}"
