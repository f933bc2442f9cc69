"""Queries of the evaluation operators and the same in plain SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.functions import text as X
from gaugeworks.functions.views import CLAIM_COLUMNS, oracle, table, view
from gaugeworks.operators import calibration as C
from gaugeworks.operators import cells, evidence, judging, replies, reports
from gaugeworks.sources import accepted, harvest
from gaugeworks.sources.tables import own_path
from gaugeworks.streaming import rowlog

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
LABELS = ["flag", "pass"]
ROSTER = ["view", "click", "purchase", "absent"]


def query(sql: str = "") -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = oracle(sql)
        return f

    return add


def rows(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "run_rows")


_REPORT = """select model, count(*) as n_cells, count(score) as n_scored, count(distinct item_id) as n_items, round(100 * avg(score), 6) as suite_score,
 count(*) filter (where scorer = 'no_response') as n_no_response, count(*) filter (where parsed = 'parse_fail') as n_parse_fail, count(error) as n_error
 from run_rows group by model"""


@query(_REPORT)
def model_report(s, d):
    return reports.model_report(rows(s, d))


@query(_REPORT)
def report_of_item_sums(s, d):
    """The report as a live one adds it up: from sums by (model, item)."""
    return rowlog.report_of_sums(rowlog.item_sums(rows(s, d)))


@query(f"with report as ({_REPORT}) select count(*) as n_models, cast(sum(n_cells) as bigint) as n_cells, cast(sum(n_scored) as bigint) as n_scored, cast(sum(n_no_response) as bigint) as n_no_response, cast(sum(n_parse_fail) as bigint) as n_parse_fail, cast(sum(n_error) as bigint) as n_error from report")
def run_totals(s, d):
    return reports.run_totals(model_report(s, d))


@query("select round(100 * avg(score), 6) as suite_score from run_rows")
def suite_score(s, d):
    return reports.suite_score(rows(s, d))


@query("select count(*) as total, count(*) filter (where score is not null and error is null and coalesce(scorer, '') <> 'no_response') as scored, count(*) filter (where scorer = 'no_response') as no_response from run_rows")
def score_summary(s, d):
    return reports.score_summary(rows(s, d))


@query(f"with report as ({_REPORT}) select model, concat_ws(',', case when n_error > 0 then 'error' end, case when n_no_response > 0 then 'no_response' end, case when n_parse_fail > 0 then 'parse_fail' end, case when n_scored = 0 then 'unscored' end) as reasons, n_error = 0 and n_no_response = 0 and n_parse_fail = 0 and n_scored > 0 as passed from report")
def smoke_gate(s, d):
    return reports.smoke_gate(model_report(s, d))


@query("select model, round(avg(case when parsed = 'parse_fail' then 1.0 else 0.0 end), 6) as parse_fail_rate from run_rows where scorer = 'verdict' group by model")
def parse_fail_rate(s, d):
    return reports.parse_fail_rate(rows(s, d))


@query(f"""with report as ({_REPORT}), roster as (select * from (values ('view', 0), ('click', 1), ('purchase', 2), ('absent', 3)) t(model, ordinal))
select coalesce(r.model, o.model) as model, o.ordinal, coalesce(n_cells, 0) as n_cells, coalesce(n_scored, 0) as n_scored, coalesce(n_items, 0) as n_items, suite_score,
 coalesce(n_no_response, 0) as n_no_response, coalesce(n_parse_fail, 0) as n_parse_fail, coalesce(n_error, 0) as n_error, o.ordinal is not null as listed from report r full outer join roster o on r.model = o.model""")
def report_roster_complete(s, d):
    roster = s.createDataFrame([(m, i) for i, m in enumerate(ROSTER)], "model string, ordinal int")
    return reports.roster_report(model_report(s, d), roster)


def _sweep(s, d):
    """Three samples of every item for four models, one of which has no rows."""
    return rows(s, d).select("item_id").distinct(), s.createDataFrame([(m,) for m in ROSTER], "model string"), 3


def _grid(s, d):
    return cells.sweep_grid(*_sweep(s, d))


_GRID = "grid as (select m.model, i.item_id, k.sample_k from (select distinct item_id from run_rows) i cross join (values ('view'), ('click'), ('purchase'), ('absent')) m(model) cross join (values (0), (1), (2)) k(sample_k))"
_KEYS = "g.model = r.model and g.item_id = r.item_id and g.sample_k = r.sample_k"


@query(f"with {_GRID} select * from grid")
def sweep_grid(s, d):
    return _grid(s, d)


@query(f"with {_GRID} select g.* from grid g where not exists (select 1 from run_rows r where {_KEYS})")
def resume_pending(s, d):
    return cells.pending_cells(*_sweep(s, d), rows(s, d))


@query(f"with {_GRID} select g.* from grid g where exists (select 1 from run_rows r where {_KEYS})")
def resume_completed(s, d):
    return cells.completed_cells(*_sweep(s, d), rows(s, d))


@query(f"with {_GRID} select *, row_number() over (order by model, item_id, sample_k) <= 500 as run from grid")
def budget_split(s, d):
    return cells.budget_split(_grid(s, d), ["model", "item_id", "sample_k"], 500)


@query(f"with {_GRID} select *, cast((row_number() over (partition by model order by item_id, sample_k) - 1) // 2 as int) as wave from grid")
def waves(s, d):
    return cells.waves(_grid(s, d), ["item_id", "sample_k"], 2)


@query("select r.event_id, r.item_id from run_rows r where not exists (select 1 from items i where i.item_id = r.item_id)")
def orphan_rows(s, d):
    return cells.orphans(rows(s, d), view(s, d, "items")).select("event_id", "item_id")


@query("select r.event_id, r.item_id, i.expected from run_rows r join items i on r.item_id = i.item_id")
def rows_with_gold(s, d):
    return cells.with_gold(rows(s, d), view(s, d, "items")).select("event_id", "item_id", "expected")


@query("""select event_id, case when state = 'success' then 'match' end as parsed, case when state = 'no_response' then cast(0 as double) when state = 'success' then cast(1 as double) end as score,
 case when state = 'no_response' then 'no_response' when state = 'success' then 'exact' end as scorer, case when state = 'error' then 'timeout' end as error
 from (select event_id, case cast(event_id % 3 as int) when 0 then 'success' when 1 then 'no_response' else 'error' end as state from events) t""")
def build_rows(s, d):
    state = F.when(F.col("event_id") % 3 == 0, "success").when(F.col("event_id") % 3 == 1, "no_response").otherwise("error")
    calls = table(s, d, "events").select("event_id", state.alias("state"), F.when(state == "error", "timeout").alias("reason"), F.lit("yes").alias("response_raw"))
    score = X.exact_score(F.col("response_raw"), F.lit("YES "), ascii_only=True)
    return cells.build_rows(calls, X.exact_parsed(score), score, "exact").select("event_id", "parsed", "score", "scorer", "error")


@query("select model, " + ", ".join(f"round(100 * avg(score) filter (where event_id % 3 = {i}), 6) as r{i}, count(*) filter (where event_id % 3 = {i}) > 0 as has_r{i}" for i in range(3)) + " from run_rows group by model")
def compare_runs(s, d):
    return reports.compare_runs(rows(s, d).withColumn("run_id", F.concat(F.lit("r"), F.col("event_id") % 3)), ["r0", "r1", "r2"])


@query("select model, count(distinct suite_hash) as n_hashes from runs group by model having count(distinct suite_hash) > 1")
def hash_mismatch(s, d):
    return reports.hash_mismatches(view(s, d, "runs"))


@query("select suite_hash, model, run_id, started from (select *, row_number() over (partition by suite_hash, model order by started desc, run_id desc) as n from runs) t where n = 1")
def latest_run_per_model(s, d):
    return reports.latest_runs(view(s, d, "runs")).select("suite_hash", "model", "run_id", "started")


@query("select *, dense_rank() over (partition by suite_hash, fingerprint order by score desc) as rank from (select suite_hash, fingerprint, model, count(*) as score from runs group by all) t")
def leaderboard(s, d):
    scores = view(s, d, "runs").groupBy("suite_hash", "fingerprint", "model").agg(F.count("*").alias("score"))
    return reports.leaderboard(scores)


@query("select p_partkey, case when p_partkey % 3 < 2 then cast(1 as double) else cast(0 as double) end as score, case when p_partkey % 3 < 2 then 'match' else 'no_match' end as parsed from part")
def exact_score(s, d):
    name = F.col("p_name")
    reply = F.when(F.col("p_partkey") % 3 == 0, F.upper(name)).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit(" \t"), name, F.lit("\n"))).otherwise(F.concat(name, F.lit("!")))
    score = X.exact_score(reply, name)
    return table(s, d, "part").select("p_partkey", score.alias("score"), X.exact_parsed(score).alias("parsed"))


@query("select c_custkey, case when regexp_full_match(cast(c_custkey as varchar), '[1-4]\\d*') then cast(1 as double) else cast(0 as double) end as score from customer")
def exact_regex_score(s, d):
    return table(s, d, "customer").select("c_custkey", X.exact_regex_score(F.concat(F.lit(" "), F.col("c_custkey"), F.lit("\n")), F.lit("[1-4]\\d*")).alias("score"))


@query("select event_id, case when error is not null then parsed when scorer = 'no_response' then parsed else 'match' end as parsed, case when error is not null or scorer = 'no_response' then score else cast(1 as double) end as score from run_rows")
def rescore_idempotent(s, d):
    once = cells.rescore(rows(s, d), F.lit("match"), F.lit(1.0), "exact")
    return cells.rescore(once, F.lit("match"), F.lit(1.0), "exact").select("event_id", "parsed", "score")


@query("select event_id, truth as label from verdict_rows")
def verdict_extract(s, d):
    return view(s, d, "verdict_rows").select("event_id", X.verdict_label(F.col("response_raw"), LABELS).alias("label"))


@query("select event_id, coalesce(truth, 'parse_fail') as parsed, case when truth = expected then cast(1 as double) else cast(0 as double) end as score from verdict_rows")
def verdict_score(s, d):
    told = view(s, d, "verdict_rows").withColumn("label", X.verdict_label(F.col("response_raw"), LABELS))
    return told.select("event_id", F.coalesce("label", F.lit("parse_fail")).alias("parsed"), X.verdict_score(F.col("label"), F.col("expected"), ascii_only=True).alias("score"))


@query("select coalesce(truth, 'parse_fail') as parsed, expected, count(*) as n from verdict_rows group by 1, 2")
def confusion_matrix(s, d):
    told = view(s, d, "verdict_rows").select("expected", F.coalesce(X.verdict_label(F.col("response_raw"), LABELS), F.lit("parse_fail")).alias("parsed"))
    return reports.confusion_matrix(told)


@query("select item_id, sha256('" + "' || item_text || '".join(x.replace("'", "''") for x in X.JUDGE_PROMPT) + "') as prompt_sha256 from (select item_id, text as item_text from benchmark) t")
def judge_prompts(s, d):
    t = F.col("text")
    return table(s, d, "benchmark").select("item_id", F.sha2(X.judge_prompt(t, t, t), 256).alias("prompt_sha256"))


def _samples(s, d):
    return judging.parsed_samples(view(s, d, "judge_samples"))


@query("select event_id, case when ok then truth end as value from judge_samples")
def judge_score_parse(s, d):
    return _samples(s, d).select("event_id", "value")


@query("select item_id, judge, median(truth) as median from judge_samples where ok and truth is not null group by all")
def judge_median(s, d):
    return judging.medians(_samples(s, d))


@query("""with m as (select item_id, judge, median(truth) as median from judge_samples where ok and truth is not null group by all), t as (select item_id, avg(median) as m from m group by 1)
select i.item_id, round(coalesce(t.m / 10, 0), 6) as score, coalesce(cast(t.m as varchar), 'parse_fail') as parsed from (select distinct item_id from judge_samples) i left join t on i.item_id = t.item_id""")
def rubric_item_score(s, d):
    return judging.item_scores(_samples(s, d))


_STATS = "select judge, count(*) filter (where ok and truth is null) as fail, count(*) filter (where ok) as attempts from judge_samples group by judge"


@query(_STATS)
def judge_parse_stats(s, d):
    return judging.parse_stats(_samples(s, d))


@query(f"select *, round(fail / attempts, 6) as rate from ({_STATS}) where attempts > 0 and fail / attempts > 0.3")
def judge_gate(s, d):
    return judging.offenders(judge_parse_stats(s, d), 0.3)


@query("""select event_id, case kind when 0 then 'm1' when 3 then 'm1' when 6 then 'm1' else 'alias' end as model_id_resolved, case when kind < 2 then 'success' when kind in (2, 6) then 'no_response' else 'error' end as state,
 case kind when 3 then 'truncated' when 4 then 'non_json_body' when 5 then 'bad_envelope' when 7 then 'timeout' end as reason, case when kind < 2 then 'hello' else '' end as response_raw from envelopes""")
def envelope_openai(s, d):
    return replies.chat_reply(view(s, d, "envelopes"), F.lit("alias")).select("event_id", "model_id_resolved", "state", "reason", "response_raw")


@query("""select event_id, case kind when 0 then 'm2' else 'alias' end as model_id_resolved, case kind when 0 then 'success' when 6 then 'no_response' else 'error' end as state,
 case kind when 1 then 'truncated' when 2 then 'os_error' when 3 then 'bad_envelope' when 4 then 'non_json_body' when 5 then 'bad_envelope' when 7 then 'os_error' end as reason, case when kind = 0 then 'fine' else '' end as response_raw from envelopes""")
def envelope_cli(s, d):
    return replies.cli_reply(view(s, d, "envelopes").drop("transport"), F.lit("alias")).select("event_id", "model_id_resolved", "state", "reason", "response_raw")


@query("""select state, reason, count(*) as n from (select case when kind < 2 then 'success' when kind in (2, 6) then 'no_response' else 'error' end as state,
 case kind when 3 then 'truncated' when 4 then 'non_json_body' when 5 then 'bad_envelope' when 7 then 'timeout' end as reason from envelopes) t group by all""")
def classify_responses(s, d):
    return envelope_openai(s, d).groupBy("state", "reason").agg(F.count("*").alias("n"))


_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
#: Lines of every document; a last empty one does not count.
_LINES = f"lined as (select doc_id, case when parts[-1] = '' then parts[:-2] else parts end as lines from (select doc_id, string_split_regex(text, '{_ENDS}') as parts from documents where text is not null) t)"


@query(f"with {_LINES} select doc_id, case when 1 + doc_id % 3 <= len(lines) then sha256(array_to_string(lines[1 + doc_id % 3:], chr(10))) end as quote_sha256 from lined")
def quote_sha256(s, d):
    """From the first, second or third line to the last one; null where the document is shorter."""
    quote = X.quote_hash(F.col("text"), (1 + F.col("doc_id") % 3).cast("int"))
    return table(s, d, "documents").where("text is not null").select("doc_id", quote.alias("quote_sha256"))


def _cited(s, d):
    """(claims, their citations, the cited files): a citation's hash is the file's at the time, or another."""
    docs = table(s, d, "documents")
    first = X.quote_hash(F.col("text"), F.col("line_from"), F.col("line_to"))
    stored_hash = F.when(F.col("mutated"), F.sha2(F.lit("changed"), 256)).otherwise(first).alias("quote_sha256")
    cited = docs.selectExpr(*CLAIM_COLUMNS, "text").select("claim_id", "status", F.col("doc_id").cast("string").alias("file"), "line_from", "line_to", stored_hash)
    return view(s, d, "claims"), cited, docs.where("text is not null").select(F.col("doc_id").cast("string").alias("file"), "text")


_ISSUES = f"{_LINES}, checked as (select claim_id, status, case when lines is null then 'missing_file' when line_to > len(lines) then 'bad_lines' when mutated then 'quote_changed' end as reason from claims c left join lined l on c.doc_id = l.doc_id)"


@query(f"with {_ISSUES} select claim_id, case when reason is not null then 'STALE' else status end as status, reason is not null as newly_stale from checked")
def ledger_audit(s, d):
    claims, cited, docs = _cited(s, d)
    return evidence.audit(claims, evidence.issues(cited, docs)).select("claim_id", "status", "newly_stale")


@query(f"with {_ISSUES} select claim_id, reason from checked where reason is not null")
def audit_issues(s, d):
    _, cited, docs = _cited(s, d)
    return evidence.issues(cited, docs).select("claim_id", "reason")


#: Some time later: every fifth document has a new first line, every eleventh is gone.
_LATER = "case when doc_id % 5 = 0 then 'new' || chr(10) || text else text end"


@query(f"""with {_LINES.replace("string_split_regex(text", f"string_split_regex({_LATER}").replace("where text is not null", "where text is not null and doc_id % 11 <> 0")},
before as (select doc_id, case when parts[-1] = '' then parts[:-2] else parts end as old from (select doc_id, string_split_regex(text, '{_ENDS}') as parts from documents where text is not null) t)
select claim_id, case when lines is null then 'missing_file' when line_to > len(lines) then 'bad_lines' when mutated or line_to > len(old) or array_to_string(lines[line_from:line_to], chr(10)) <> array_to_string(old[line_from:line_to], chr(10)) then 'quote_changed' end as reason, lines is not null and c.doc_id % 5 = 0 as was_read
from claims c left join lined l on c.doc_id = l.doc_id left join before b on c.doc_id = b.doc_id""")
def incremental_audit(s, d):
    """The second of two audits: files that have not changed since the first are not read again."""
    _, cited, first = _cited(s, d)
    # a citation without a hash stands for lines that were not there
    cited = cited.withColumn("quote_sha256", F.coalesce("quote_sha256", F.lit("none")))
    doc_id = F.col("file").cast("long")
    later = first.where(doc_id % 11 != 0).withColumn("text", F.expr(_LATER.replace("doc_id", "cast(file as bigint)")))
    empty = s.createDataFrame([], evidence.QUOTE_INDEX)
    version = lambda files: files.select("file", F.sha2("text", 256).alias("version"))
    reader = lambda files: lambda wanted: files.join(wanted.select("file"), "file", "left_semi")
    _, index = evidence.audit_changed(cited, version(first), empty, reader(first))
    found, _ = evidence.audit_changed(cited, version(later), index, reader(later))
    return found.select("claim_id", "reason", "was_read")


@query("select s.ordinal, s.status, count(c.claim_id) as n from (values (0, 'MEASURED'), (1, 'PARTIAL'), (2, 'ASSERTED'), (3, 'STALE')) s(ordinal, status) left join claims c on c.status = s.status group by 1, 2")
def claims_by_status(s, d):
    return evidence.by_status(view(s, d, "claims"))


@query("select claim_id from claims where status = 'MEASURED' and (doc_id % 20 = 0 or doc_id % 30 = 0)")
def claims_measured_violations(s, d):
    proof = F.when(F.col("doc_id") % 20 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("run")))
    plan = F.when(F.col("doc_id") % 30 != 0, "plan.md")
    return evidence.measured_violations(view(s, d, "claims").withColumns({"evidence": proof, "preregistration": plan})).select("claim_id")


_SLUG = "trim(regexp_replace(lang || '/' || source, '[^A-Za-z0-9._-]+', '-', 'g'), '.-_')"


@query(f"select doc_id, 'doc-' || {_SLUG} || '-' || substr(sha256(text), 1, 12) as item_id from documents where text is not null")
def item_ids(s, d):
    name = F.concat_ws("/", "lang", "source")
    return table(s, d, "documents").where("text is not null").select("doc_id", X.item_id(F.lit("doc"), name, F.col("text")).alias("item_id"))


_FRAMED = "'" + "' || text || '".join(x.replace("'", "''") for x in harvest.GOLDEN_FRAME) + "'"


@query(f"""select doc_id, 'golden-' || trim(regexp_replace(source || '-' || doc_id, '[^A-Za-z0-9._-]+', '-', 'g'), '.-_') || '-' || substr(sha256(text), 1, 12) as id,
 'golden,skill-eval,skill-' || trim(regexp_replace(source, '[^A-Za-z0-9._-]+', '-', 'g'), '.-_') || ',' || expected as tags, {_FRAMED} as prompt, expected, 0.5::double as difficulty_prior,
 'harvested:' || source || '/' || doc_id || '.md;sha256=' || sha256(text) as provenance
 from (select d.doc_id, d.source, d.text, case when l.quality = 1 then 'pass' else 'flag' end as expected from documents d join labels l on d.doc_id = l.doc_id where l.quality is not null) t""")
def harvested_items(s, d):
    """Labelled documents as golden artifacts: whole items, as any source of a harvest gives them."""
    labels = table(s, d, "labels").where("quality is not null").select("doc_id", F.when(F.col("quality") == 1, "pass").otherwise("flag").alias("expected"))
    stem = F.col("doc_id").cast("string")
    rows = table(s, d, "documents").join(labels, "doc_id").select("doc_id", F.concat("source", F.lit("/"), stem, F.lit(".md")).alias("source"), F.col("source").alias("skill"), stem.alias("stem"), "text", "expected")
    return harvest.golden_items(rows).withColumn("tags", F.array_join("tags", ","))


@query("select min(doc_id) as doc_id from documents group by sha256(text)")
def dedup_candidates(s, d):
    hashed = table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return evidence.dedup(hashed, ["h"], ["doc_id"]).select("doc_id")


@query("select min(doc_id) as doc_id from documents group by sha256(text) having count(case when doc_id in (select doc_id from labels) then 1 end) = 0 and max(text) is not null")
def second_harvest(s, d):
    """Labelled documents are accepted by a first harvest; a second one of all documents gives what is new in it, the first of each text."""
    docs = table(s, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("h"))
    index = accepted.Accepted(s, own_path(s))
    index.accept(docs.join(table(s, d, "labels").select("doc_id").distinct(), "doc_id", "left_semi"), ["h"], ["doc_id"], "labelled", ["doc_id"])
    fresh = index.accept(docs, ["h"], ["doc_id"], "all", ["doc_id"])
    index.forget()
    return fresh


@query("select d.doc_id from documents d where exists (select 1 from labels l where l.doc_id = d.doc_id and l.quality = 0)")
def approved_bads(s, d):
    manifest = table(s, d, "labels").select(F.col("doc_id").alias("file"), (F.col("quality") == 0).alias("verified_fails"))
    return evidence.approved(table(s, d, "documents").select(F.col("doc_id").alias("file")), manifest).select(F.col("file").alias("doc_id"))


@query("select event_id, case cast(event_id % 6 as int) when 0 then 'pass' when 1 then 'pass' when 2 then 'flag' when 3 then 'flag' when 4 then 'flag' end as gold from events")
def review_gold(s, d):
    told = F.element_at(F.array(*map(F.lit, (*evidence.REVIEW, "SKIPPED"))), (F.col("event_id") % 6 + 1).cast("int"))
    return table(s, d, "events").select("event_id", evidence.review_gold(told).alias("gold"))


@query("select item_id, round(avg(case when score = 1 then 1.0 else 0.0 end), 6) as difficulty, count(*) as n, round(avg(case when score = 1 then 1.0 else 0.0 end), 6) in (0.0, 1.0) as saturated from run_rows where score is not null group by 1")
def item_difficulty(s, d):
    return C.item_difficulty(rows(s, d))


@query("""with m as (select model, ntile(2) over (order by m desc, model) as half from (select model, avg(score) as m from run_rows where score is not null group by 1) t)
select item_id, round(avg(case when half = 1 then case when score = 1 then 1.0 else 0.0 end end) - avg(case when half = 2 then case when score = 1 then 1.0 else 0.0 end end), 6) as discrimination
from run_rows r join m on r.model = m.model where score is not null group by 1""")
def item_discrimination(s, d):
    return C.item_discrimination(rows(s, d))


@query(f"with report as ({_REPORT}) select model, suite_score, suite_score between 5 and 95 as in_band from report")
def acceptance_band(s, d):
    return C.acceptance_band(model_report(s, d))


@query(f"with report as ({_REPORT}), t as (select max(suite_score) filter (where model <> 'view') as best, max(suite_score) filter (where model = 'view') as reference from report) select best, reference, round(best - reference, 6) as lead, round(best - reference, 6) > 10 as halt from t")
def kill_criterion(s, d):
    return C.kill_criterion(model_report(s, d), "view")


@query("select cast(least(floor(difficulty_prior * 4), 3) as int) as bucket, count(*) as n from items group by 1")
def difficulty_histogram(s, d):
    return C.histogram(view(s, d, "items"))


@query("""with tagged as (select item_id, 'lang-' || lang as tag, source from items union all select item_id, 'gold-' || expected, source from items)
select * from (select min(n) as min_per_tag from (select tag, count(distinct item_id) as n from tagged group by 1) t) a, (select max(n) as max_per_source, cast(sum(n) as bigint) as n_items from (select source, count(distinct item_id) as n from tagged group by 1) t) b""")
def suite_coverage(s, d):
    return C.suite_coverage(_tagged(s, d))


def _tagged(s, d):
    tags = F.explode(F.array(F.concat(F.lit("lang-"), "lang"), F.concat(F.lit("gold-"), "expected"))).alias("tag")
    return view(s, d, "items").select("item_id", "source", tags)


def _tag_rows(s, d):
    return rows(s, d).where("score is not null").join(_tagged(s, d).select("item_id", "tag"), "item_id")


_TAG_ROWS = "tag_rows as (select r.model, r.score, i.item_id, i.tag from run_rows r join (select item_id, 'lang-' || lang as tag from items union all select item_id, 'gold-' || expected from items) i on r.item_id = i.item_id where score is not null)"


@query(f"""with {_TAG_ROWS}, acc as (select tag, model, avg(score) as a from tag_rows group by all), wide as (select tag, count(distinct item_id) as n_items from tag_rows group by 1 having count(distinct item_id) >= 8),
roster as (select acc.tag, model, n_items, round(a, 6) as accuracy, round(a - avg(a) over (partition by acc.tag), 6) as delta from acc join wide on acc.tag = wide.tag)
select *, rank() over (partition by model order by delta desc, tag) as rank from roster""")
def tag_profile(s, d):
    return C.tag_profile(_tag_rows(s, d))


@query(f"with {_TAG_ROWS}, acc as (select tag, model, avg(score) as a from tag_rows group by all) select tag, round(max(a) - min(a), 6) as gap from acc group by 1")
def tag_gap(s, d):
    return C.tag_gap(_tag_rows(s, d))


@query("select count(*) as n, count(*) filter (where a <> b) as n_disagree, round(count(*) filter (where a <> b) / count(*), 6) as disagreement, count(*) filter (where a <> b) / count(*) > 0.2 as kill from (select case when l.quality = 1 then 'pass' else 'flag' end as a, case when d.doc_id % 9 = 0 then 'DEFER' when d.n_chars > 300 then 'pass' else 'flag' end as b from documents d join labels l on d.doc_id = l.doc_id) t where b <> 'DEFER'")
def agreement_kill(s, d):
    docs, labels = table(s, d, "documents"), table(s, d, "labels")
    b = F.when(F.col("doc_id") % 9 == 0, "DEFER").when(F.col("n_chars") > 300, "pass").otherwise("flag")
    return C.agreement(docs.join(labels, "doc_id").select(F.when(F.col("quality") == 1, "pass").otherwise("flag").alias("a"), b.alias("b")))


@query("select arm, round(100 * avg(rate), 6) as macro_score, count(*) as n_tasks from (select arm, task_id, avg(passed) as rate from (select 'a' as arm, task_id, a_pass as passed from arms union all select 'b', task_id, b_pass from arms) t group by all) u group by 1")
def macro_score(s, d):
    arms = view(s, d, "arms")
    return C.macro_score(arms.selectExpr("'a' as arm", "task_id", "a_pass as passed").unionByName(arms.selectExpr("'b' as arm", "task_id", "b_pass as passed")))


@query('select count(*) filter (where a_pass = 1 and b_pass = 1) as "both", count(*) filter (where a_pass = 0 and b_pass = 0) as neither, count(*) filter (where a_pass = 1 and b_pass = 0) as left_only, count(*) filter (where a_pass = 0 and b_pass = 1) as right_only from arms')
def pair_outcomes(s, d):
    return C.pair_outcomes(view(s, d, "arms"))


@query("select model, coalesce(error, scorer) as outcome, count(*) as n from run_rows group by all")
def failure_breakdown(s, d):
    return C.failure_breakdown(rows(s, d))


@query("select cast(task_id % 5 as int) as scope, count(distinct cluster_id) as n_clusters, count(distinct cluster_id) >= 8 as interval, 'EXPLORATORY' as label from arms group by 1")
def scope_min_n(s, d):
    return C.scope_min_n(view(s, d, "arms").withColumn("scope", (F.col("task_id") % 5).cast("int")), "scope")


_BOUNDS = "select n_nationkey, cast(n_nationkey - 12 as double) as low, cast(n_nationkey - 10 as double) as high from nation"


@query(f"select *, case when low > 5 then 'CANDIDATE_ADVANTAGE' when high < -5 then 'REFERENCE_ADVANTAGE' else 'INCONCLUSIVE' end as decision from ({_BOUNDS})")
def decision(s, d):
    return C.superiority(_bounds(s, d))


def _bounds(s, d):
    return table(s, d, "nation").selectExpr("n_nationkey", "cast(n_nationkey - 12 as double) as low", "cast(n_nationkey - 10 as double) as high")


@query(f"select *, case when low > -5 then 'CANDIDATE_ELIGIBLE' when high < -5 then 'REFERENCE_REQUIRED' else 'UNRESOLVED' end as decision from ({_BOUNDS})")
def non_inferiority(s, d):
    return C.non_inferiority(_bounds(s, d))


_Z = "chr(0)"


@query(f"""with tasks as (select cast(n_regionkey as varchar) as family, cast(c_custkey as varchar) as task_id, 1 as sample_k from customer join nation on c_nationkey = n_nationkey), models as (select * from (values ('m1'), ('m2'), ('m3')) t(model)),
blocks as (select *, sha256('schedule-block-v1' || {_Z} || 'seed' || {_Z} || family || {_Z} || task_id || {_Z} || sample_k) as digest from tasks),
placed as (select *, row_number() over (partition by family order by digest, family, task_id, sample_k) - 1 as family_ordinal from blocks),
base as (select *, row_number() over (partition by family order by m, model) - 1 as at_ from (select family, model, sha256('schedule-model-v1' || {_Z} || 'seed' || {_Z} || family || {_Z} || model) as m from (select distinct family from tasks) f cross join models) t)
select b.family, task_id, sample_k, digest, family_ordinal, model, cast((at_ - family_ordinal % 3 + 3) % 3 as int) as position from placed b join base on b.family = base.family""")
def block_schedule(s, d):
    customer, nation = table(s, d, "customer"), table(s, d, "nation")
    tasks = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").cast("string").alias("family"), F.col("c_custkey").cast("string").alias("task_id"), F.lit(1).alias("sample_k"))
    return C.block_schedule(tasks, s.createDataFrame([("m1",), ("m2",), ("m3",)], "model string"), "seed")


_PICK = "0"
for _at in range(8):
    _PICK = f"(({_PICK}) * 4294967296 + cast('0x' || substr(h, {8 * _at + 1}, 8) as bigint)) % k"


@query(f"""with tasks as (select cluster_id, task_id, avg(a_pass) - avg(b_pass) as delta from arms group by all), clusters as (select cluster_id, sum(delta) as delta, count(*) as n, row_number() over (order by cluster_id) - 1 as pick from tasks group by 1),
hashed as (select i, k, sha256('bootstrap-v1' || {_Z} || 'analysis' || {_Z} || i || {_Z} || d) as h from (select count(*) as k from clusters) t, range(10000) a(i), range((select count(*) from clusters)) b(d)),
picked as (select i, {_PICK} as pick from hashed), deltas as (select i, 100 * sum(delta) / sum(n) as delta from picked p join clusters c on p.pick = c.pick group by 1), sorted as (select list_sort(list(delta)) as s from deltas)
select round(s[250], 6) as low, round(s[9750], 6) as high from sorted""")
def cluster_bootstrap(s, d):
    return C.interval(C.cluster_bootstrap(view(s, d, "arms"), "analysis"))


@query(f"""with tasks as (select cast(task_id % 4 as int) as scope, cluster_id, task_id, avg(a_pass) - avg(b_pass) as delta from arms group by all), clusters as (select scope, cluster_id, sum(delta) as delta, count(*) as n, row_number() over (partition by scope order by cluster_id) - 1 as pick from tasks group by 1, 2),
sizes as (select scope, count(*) as k from clusters group by 1), hashed as (select scope, i, k, sha256('bootstrap-v1' || {_Z} || 'analysis/' || scope || {_Z} || i || {_Z} || d) as h from sizes, range(1000) a(i), lateral (select unnest(range(k)) as d) b),
picked as (select scope, i, {_PICK} as pick from hashed), deltas as (select p.scope, i, 100 * sum(delta) / sum(n) as delta from picked p join clusters c on p.scope = c.scope and p.pick = c.pick group by 1, 2), sorted as (select scope, list_sort(list(delta)) as s from deltas group by 1)
select scope, round(s[6], 6) as low, round(s[994], 6) as high, case when round(s[6], 6) > -5 then 'CANDIDATE_ELIGIBLE' when round(s[994], 6) < -5 then 'REFERENCE_REQUIRED' else 'UNRESOLVED' end as decision from sorted""")
def scope_decisions(s, d):
    """Four scopes share the error of their intervals."""
    return C.scope_decisions(view(s, d, "arms").withColumn("scope", (F.col("task_id") % 4).cast("int")), "analysis", 4, iterations=1000)


_TAGS = "case when cluster_id < 4 then 'rare' else 'tag' || cast(task_id % 6 as varchar(9)) end"


@query(f"""with tasks as (select {_TAGS} as scope, cluster_id, task_id, avg(a_pass) - avg(b_pass) as delta from arms group by all), clusters as (select scope, cluster_id, sum(delta) as delta, count(*) as n, row_number() over (partition by scope order by cluster_id) - 1 as pick from tasks group by 1, 2),
sizes as (select scope, count(*) as k from clusters group by 1 having count(*) >= 8), hashed as (select scope, i, k, sha256('bootstrap-v1' || {_Z} || 'analysis/' || scope || {_Z} || i || {_Z} || d) as h from sizes, range(400) a(i), lateral (select unnest(range(k)) as d) b),
picked as (select scope, i, {_PICK} as pick from hashed), deltas as (select p.scope, i, 100 * sum(delta) / sum(n) as delta from picked p join clusters c on p.scope = c.scope and p.pick = c.pick group by 1, 2), sorted as (select scope, list_sort(list(delta)) as s from deltas group by 1)
select scope, k as n_clusters, round(s[10], 6) as low, round(s[390], 6) as high, 'EXPLORATORY' as label from sorted join sizes using (scope)""")
def scope_intervals(s, d):
    """Every tag with at least eight clusters has an interval; all are resampled in one pass."""
    return C.scope_intervals(view(s, d, "arms").withColumn("scope", F.expr(_TAGS)), "analysis", iterations=400)
