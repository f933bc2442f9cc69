"""Evaluation tables derived from the driver tables; each SQL text runs in Spark and DuckDB alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()

RUN_ROWS = """
select event_type as model, user_id as item_id, event_id,
  cast(row_number() over (partition by event_type, user_id order by ts, event_id) - 1 as int) as sample_k,
  case when event_type = 'error' then 'os_error' end as error,
  case when event_type = 'error' then cast(null as double) when value >= 35 then cast(1 as double) else cast(0 as double) end as score,
  case when event_type = 'error' then null when value < 5 then 'no_response' else 'verdict' end as scorer,
  case when event_type = 'error' or value < 5 then null when value < 10 then 'parse_fail' when value < 35 then 'pass' else 'flag' end as parsed
from events"""
VERDICT_ROWS = """
select event_id, v as expected, case cast(event_id % 10 as int)
   when 0 then '{"verdict": "' || v || '"}' when 1 then 'VERDICT: ' || v || chr(10) || 'RATIONALE: this is not a pass.'
   when 2 then '  ' || upper(v) || chr(10) when 3 then 'After reviewing the diff I would ' || v || ' this change.'
   when 4 then 'It could be flag or pass, hard to tell.' when 5 then '{"verdict": "maybe"}'
   when 6 then '{"verdict": "flag"} then {"verdict": "pass"}' when 7 then 'VERDICT: flag' || chr(10) || 'ANSWER: pass'
   when 8 then 'flags are raised all over unflagged code' else '{"needs_flag": false, "verdict": "unclear"}' end as response_raw,
  case when event_id % 10 < 4 then v end as truth
from (select event_id, case when value >= 35 then 'flag' else 'pass' end as v from events) t"""
JUDGE_SAMPLES = """
select event_type as judge, user_id as item_id, event_id, event_id % 7 <> 5 as ok,
  case cast(event_id % 7 as int) when 4 then 'no score in here' when 5 then '' when 6 then 'SCORE: 1e9'
    else 'SCORE: ' || cast(n as varchar(9)) || chr(10) || 'RATIONALE: x' end as response_raw,
  case when event_id % 7 < 4 then cast(least(n, 10) as double) end as truth
from (select *, cast(floor(value / 10) as int) as n from events) t"""
#: Columns of a claim per document: it cites two or three lines, which the document may not have.
CLAIM_COLUMNS = (
    "'c' || cast(doc_id as varchar(20)) as claim_id", "doc_id", "case when doc_id % 10 = 0 then 'MEASURED' when doc_id % 10 < 3 then 'PARTIAL' else 'ASSERTED' end as status",
    "cast(1 + doc_id % 3 as int) as line_from", "cast(2 + doc_id % 3 + doc_id % 2 as int) as line_to", "doc_id % 7 = 0 as mutated",
)
CLAIMS = f"select {', '.join(CLAIM_COLUMNS)} from documents"
ITEMS = """
select d.doc_id as item_id, d.lang, d.source, case when l.quality = 1 then 'pass' else 'flag' end as expected,
  cast(least(greatest(d.n_chars / 20000.0, 0), 1) as double) as difficulty_prior
from documents d join labels l on d.doc_id = l.doc_id"""
#: A run per order: a model of one of two suites, started on the order's date.
RUNS = """
select 'run_' || cast(o_orderkey as varchar(20)) as run_id, 'm' || cast(o_custkey % 7 as varchar(9)) as model,
  's' || cast(o_orderkey % 3 as varchar(9)) as suite_hash, 'f' || cast(o_custkey % 2 as varchar(9)) as fingerprint,
  cast(o_orderdate as date) as started, o_orderkey
from orders"""
#: Recorded replies of two services, by constructed truth.
ENVELOPES = """
select event_id, cast(event_id % 8 as int) as kind,
  case cast(event_id % 8 as int) when 0 then '{"model": "m1", "choices": [{"message": {"content": "hello"}, "finish_reason": "stop"}]}'
   when 1 then '{"model": "", "choices": [{"message": {"content": "hello"}, "finish_reason": "stop"}]}' when 2 then '{"choices": [{"message": {"content": "  "}, "finish_reason": "length"}]}'
   when 3 then '{"model": "m1", "choices": [{"message": {"content": "cut"}, "finish_reason": "length"}]}' when 4 then 'not json at all'
   when 5 then '{"choices": []}' when 6 then '{"model": "m1", "choices": [{"message": {"content": 7}}]}' else null end as body,
  case when event_id % 8 = 7 then 'timeout' end as transport,
  case cast(event_id % 8 as int) when 0 then '{"result": "fine", "is_error": false, "model": "m2"}' when 1 then '{"result": "late", "is_error": true, "subtype": "error_max_turns"}'
   when 2 then '{"result": "bad", "is_error": true, "subtype": "other"}' when 3 then '{"is_error": false}' when 4 then 'oops' when 5 then '[1]' when 6 then '{"result": "  "}' else '{"result": "x"}' end as stdout,
  case when event_id % 8 = 7 then 1 else 0 end as returncode
from events"""
#: Two arms per (task, sample): tasks are customers in the clusters of nations.
ARMS = """
select c_custkey as task_id, c_nationkey as cluster_id, k as sample_k,
  case when (c_custkey * 7 + k * 3) % 10 < 6 then 1 else 0 end as a_pass, case when (c_custkey * 11 + k * 5) % 10 < 5 then 1 else 0 end as b_pass
from customer cross join (select 1 as k union all select 2) s"""

VIEWS = {"run_rows": RUN_ROWS, "verdict_rows": VERDICT_ROWS, "judge_samples": JUDGE_SAMPLES, "claims": CLAIMS, "items": ITEMS, "runs": RUNS, "envelopes": ENVELOPES, "arms": ARMS}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table as a DataFrame; no name is registered in the session."""
    text = VIEWS[name]
    used = [t for t in TABLES if any(f"{w} {t}" in text for w in ("from", "join"))]
    for t in used:
        for w in ("from", "join"):
            text = text.replace(f"{w} {t}", f"{w} {{{t}}}")
    if "{" in VIEWS[name]:  # braces in string literals are text
        text = VIEWS[name].replace("{", "{{").replace("}", "}}")
        for t in used:
            for w in ("from", "join"):
                text = text.replace(f"{w} {t}", f"{w} {{{t}}}")
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in used})


def oracle(sql: str) -> str:
    """``sql`` with the derived tables it names as common table expressions."""
    used = [f"{n} as ({t.strip()})" for n, t in VIEWS.items() if any(f"{w} {n}" in sql for w in ("from", "join"))]
    return f"with {', '.join(used)}\n{sql.strip()}" if used and not sql.lstrip().startswith("with ") else (f"with {', '.join(used)}, {sql.lstrip()[5:]}" if used else sql.strip())
