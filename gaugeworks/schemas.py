"""Fixed schemas; nothing is ever inferred."""

from __future__ import annotations

from pyspark.sql import types as T

S, D, I = T.StringType(), T.DoubleType(), T.IntegerType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


ITEM = _struct(id=S, tags=T.ArrayType(S), prompt=S, expected=S, difficulty_prior=D, provenance=S)
ROW = _struct(
    run_id=S, model=S, model_id_resolved=S, item_id=S, sample_k=I, response_raw=S, parsed=S, score=D, scorer=S, judge_scores=T.ArrayType(D), elapsed_s=D, error=S
)
MANIFEST = _struct(
    run_id=S, suite=S, suite_hash=S, roster=T.ArrayType(S), samples_per_cell=I, judges=T.ArrayType(S), started_utc=S, config_source=S, budgets=_struct(max_calls=I), preregistration=S, fingerprint=S
)
CLAIM = _struct(
    claim_id=S, statement=S, decision_surface=S, sources=T.ArrayType(_struct(file=S, lines=S, quote_sha256=S)), status=S, evidence=T.ArrayType(S), verdict=S, preregistration=S, last_verified_utc=S
)

# The vocabularies of the data model.
SCORING_TYPES = ("verdict", "exact", "rubric")
STATUSES = ("MEASURED", "PARTIAL", "ASSERTED", "STALE")
REASONS = ("unreachable", "timeout", "os_error", "non_json_body", "bad_envelope", "truncated", "bad_verdict")
PARSE_FAIL, MATCH, NO_MATCH, NO_RESPONSE = "parse_fail", "match", "no_match", "no_response"
CELL = ["model", "item_id", "sample_k"]
