"""Text columns: decision lines, prompts, model responses, names, paths and durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from modelwarden.functions.numbers import pct

# Texts that consumers compare literally.
PARSE_ERROR_OBSERVATION = "Failed to parse LLM response"
PARSE_ERROR_CONCLUSION = "Parse error - manual review required"
STATIC_MODEL = "static-reasoner"
STATIC_ALTERNATIVE = "No alternatives evaluated (static reasoner)"

REASONING_TYPE = (
    "struct<observations:array<string>,analysis:string,conclusion:string,confidence:double,"
    "alternatives_considered:array<string>,model_used:string>"
)
_NO_STRINGS = "array<string>"


def go_label(approved: Column) -> Column:
    return F.when(approved, F.lit("GO")).otherwise(F.lit("NO-GO"))


def display_label(approved: Column, escalated: Column) -> Column:
    """An escalation is shown before the outcome."""
    return F.when(escalated, F.lit("ESCALATED")).otherwise(go_label(approved))


def decision_line(agent: Column, action: Column, approved: Column, confidence: Column, escalated: Column) -> Column:
    return F.concat(
        F.lit("["), agent, F.lit("] "), action, F.lit(" -> "), go_label(approved),
        F.lit(" (confidence: "), pct(confidence), F.lit(")"),
        F.when(escalated, F.lit(" [ESCALATED]")).otherwise(F.lit("")),
    )


def memory_title(action: Column, approved: Column, confidence: Column) -> Column:
    return F.concat(action, F.lit(": "), go_label(approved), F.lit(" ("), pct(confidence), F.lit(")"))


def escalation_reason(confidence: Column, threshold: Column, agent: Column) -> Column:
    return F.concat(
        F.lit("Confidence "), pct(confidence), F.lit(" below threshold "), pct(threshold),
        F.lit(" for stage '"), agent, F.lit("'"),
    )


def result_event_type(action: Column, approved: Column, escalated: Column) -> Column:
    return (
        F.when(escalated, F.lit("human.escalation"))
        .when(approved, F.concat(action, F.lit(".approved")))
        .otherwise(F.concat(action, F.lit(".rejected")))
    )


def compact(*messages: Column) -> Column:
    """Array of the messages that are present, in order."""
    return F.array_compact(F.array(*messages))


def reasoning_prompt(observations: Column, context_json: Column, agent: Column, action: Column) -> Column:
    """Prompt text of one decision: names, observation bullets and the context as JSON."""
    bullets = F.array_join(F.transform(observations, lambda o: F.concat(F.lit("- "), o)), "\n")
    return F.concat(
        F.lit("Agent: "), agent, F.lit("\nAction: "), action,
        F.lit("\n\nObservations:\n"), bullets,
        F.lit("\n\nContext:\n"), context_json,
        F.lit("\n\nAnalyze these observations and produce your reasoning."),
    )


def static_reasoning(
    observations: Column, agent: Column, action: Column, proceed: bool = True, confidence: float = 0.9
) -> Column:
    """Reasoning for dry runs: fixed texts and a fixed confidence."""
    verb = "Proceed" if proceed else "Block"
    return F.struct(
        observations.alias("observations"),
        F.concat(F.lit("Static analysis for "), agent, F.lit("/"), action,
                 F.lit(": all observations within bounds.")).alias("analysis"),
        F.concat(F.lit(f"{verb} with "), action, F.lit(".")).alias("conclusion"),
        F.lit(float(confidence)).alias("confidence"),
        F.array(F.lit(STATIC_ALTERNATIVE)).alias("alternatives_considered"),
        F.lit(STATIC_MODEL).alias("model_used"),
    )


def strip_fences(text: Column) -> Column:
    """Drop code-fence lines from a response that starts with a fence."""
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    lines = F.filter(F.split(trimmed, "\n", -1), lambda line: ~F.startswith(F.ltrim(line), F.lit("```")))
    return F.when(F.startswith(trimmed, F.lit("```")), F.array_join(lines, "\n")).otherwise(trimmed)


def parse_response(text: Column, model: Column) -> Column:
    """Model response text to reasoning; unreadable JSON gives confidence 0 and a review note."""
    doc = F.try_parse_json(strip_fences(text))

    def part(path: str, kind: str) -> Column:
        return F.try_variant_get(doc, path, kind)

    confidence = F.when(
        F.try_variant_get(doc, "$.confidence", "variant").isNull(), F.lit(0.5)
    ).otherwise(part("$.confidence", "double"))
    empty = F.array().cast(_NO_STRINGS)
    good = F.struct(
        F.coalesce(part("$.observations", _NO_STRINGS), empty).alias("observations"),
        F.coalesce(part("$.analysis", "string"), F.lit("")).alias("analysis"),
        F.coalesce(part("$.conclusion", "string"), F.lit("")).alias("conclusion"),
        confidence.alias("confidence"),
        F.coalesce(part("$.alternatives_considered", _NO_STRINGS), empty).alias("alternatives_considered"),
        model.alias("model_used"),
    )
    bad = F.struct(
        F.array(F.lit(PARSE_ERROR_OBSERVATION)).alias("observations"),
        F.substring(text, 1, 500).alias("analysis"),
        F.lit(PARSE_ERROR_CONCLUSION).alias("conclusion"),
        F.lit(0.0).alias("confidence"),
        empty.alias("alternatives_considered"),
        model.alias("model_used"),
    )
    readable = F.coalesce(F.startswith(F.schema_of_variant(doc), F.lit("OBJECT")), F.lit(False))
    return F.when(readable, good).otherwise(bad)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    """Last extension with its dot; hidden files without a second dot have none."""
    return F.regexp_extract(basename(path), r"(?<=.)(\.[^.]+)$", 1)


def uri_bucket(uri: Column) -> Column:
    return F.regexp_extract(uri, r"^[A-Za-z0-9+.-]+://([^/]+)", 1)


def uri_key(uri: Column) -> Column:
    return F.regexp_extract(uri, r"^[A-Za-z0-9+.-]+://[^/]+/(.*)$", 1)


def service_name(name: Column, max_length: int = 40) -> Column:
    return F.substring(F.lower(F.translate(name, "_", "-")), 1, max_length)


def short_id(*parts: Column, length: int = 12, prefix: str = "") -> Column:
    """Short identifier from a key, so a retried task writes the same id again."""
    digest = F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, length)
    return F.concat(F.lit(prefix), digest)


def duration_seconds(text: Column) -> Column:
    """`30s`, `15m`, `1h`, `7d` to seconds; anything else is NULL."""
    n = F.regexp_extract(text, r"^\s*(\d+)\s*[smhd]\s*$", 1).try_cast("bigint")
    unit = F.regexp_extract(text, r"^\s*\d+\s*([smhd])\s*$", 1)
    return n * F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400)


def percent_fraction(text: Column) -> Column:
    """`5%` to 0.05; anything else is NULL."""
    return F.regexp_extract(text, r"^\s*(\d+(?:\.\d+)?)\s*%\s*$", 1).try_cast("double") / 100


