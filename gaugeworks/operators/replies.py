"""Classification of recorded replies of two kinds of service."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.text import strip

# Error subtypes that mean a cut-off answer.
CUT_OFF = ("max_turns", "max_tokens", "length")


def _text(doc: str, path: str) -> Column:
    """A JSON string at a path; null for other types."""
    value = F.try_variant_get(doc, path, "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(doc, path, "string"))


def _parsed(rows: DataFrame, body: str, fields: dict[str, Column]) -> DataFrame:
    """``rows`` with the document ``_doc`` and fields of it, each parsed once.

    Columns that several others name stay in a projection of their own.
    """
    return rows.withColumn("_doc", F.try_parse_json(body)).withColumns({"_json": F.col("_doc").isNotNull(), "_model": _text("_doc", "$.model"), **fields}).drop("_doc")


def chat_reply(rows: DataFrame, alias: Column) -> DataFrame:
    """rows(body, transport) with state, reason, response_raw and model_id_resolved.

    In order: transport error, no JSON, no message object, blank or no text, cut-off, success.
    """
    message = F.schema_of_variant(F.try_variant_get("_doc", "$.choices[0].message", "variant")).startswith("OBJECT")
    fields = {"_ok": F.coalesce(message, F.lit(False)), "_text": F.coalesce(_text("_doc", "$.choices[0].message.content"), F.lit("")), "_cut": F.coalesce(_text("_doc", "$.choices[0].finish_reason") == "length", F.lit(False))}
    found = _parsed(rows, "body", fields).withColumn("_blank", strip(F.col("_text")) == "")
    reason = F.when(F.col("transport").isNotNull(), F.col("transport")).when(~F.col("_json"), "non_json_body").when(~F.col("_ok"), "bad_envelope")
    return _outcome(found, reason.when(F.col("_blank"), F.lit(None)).when(F.col("_cut"), "truncated"), alias)


def cli_reply(rows: DataFrame, alias: Column) -> DataFrame:
    """rows(stdout, returncode) with the same columns; a ``transport`` word, if there is one, comes first.

    In order: return code, no JSON, no object, error flag (cut-off or other), no text, blank text, success.
    """
    subtype = F.lower(F.coalesce(_text("_doc", "$.subtype"), F.lit("")))
    cut = F.lit(False)
    for mark in CUT_OFF:
        cut = cut | subtype.contains(mark)
    flag = F.try_variant_get("_doc", "$.is_error", "boolean") & (F.schema_of_variant(F.try_variant_get("_doc", "$.is_error", "variant")) == "BOOLEAN")
    fields = {"_ok": F.coalesce(F.schema_of_variant("_doc").startswith("OBJECT"), F.lit(False)), "_failed": F.coalesce(flag, F.lit(False)), "_cut": cut, "_text": _text("_doc", "$.result")}
    found = _parsed(rows, "stdout", fields).withColumn("_blank", F.coalesce(strip(F.col("_text")) == "", F.lit(False)))
    transport = F.col("transport") if "transport" in rows.columns else F.lit(None).cast("string")
    reason = F.when(transport.isNotNull(), transport).when(F.col("returncode") != 0, "os_error").when(~F.col("_json"), "non_json_body").when(~F.col("_ok"), "bad_envelope")
    return _outcome(found, reason.when(F.col("_failed") & F.col("_cut"), "truncated").when(F.col("_failed"), "os_error").when(F.col("_text").isNull(), "bad_envelope"), alias)


def _outcome(found: DataFrame, reason: Column, alias: Column) -> DataFrame:
    told = found.withColumn("reason", reason)
    state = F.when(F.col("reason").isNotNull(), "error").when(F.col("_blank"), "no_response").otherwise("success")
    told = told.withColumn("state", state).withColumns({"response_raw": F.when(F.col("state") == "success", F.col("_text")).otherwise(""), "model_id_resolved": F.coalesce(F.nullif("_model", F.lit("")), alias)})
    return told.drop("_json", "_model", "_ok", "_text", "_cut", "_blank", "_failed")
