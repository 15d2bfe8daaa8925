"""Response bodies of three layouts as one struct, in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where each layout keeps its text and token counts.
TEXT_PATHS = ("$.choices[0].message.content", "$.content[0].text", "$.output[0].content[0].text")
INPUT_PATHS = ("$.usage.prompt_tokens", "$.usage.input_tokens")
OUTPUT_PATHS = ("$.usage.completion_tokens", "$.usage.output_tokens")
REASONING_PATHS = ("$.usage.completion_tokens_details.reasoning_tokens", "$.usage.output_tokens_details.reasoning_tokens", "$.usage.output_tokens_details.thinking_tokens")
STOP_PATHS = ("$.choices[0].finish_reason", "$.stop_reason", "$.status")
#: What a stop means.
LIMIT, NORMAL, REFUSED = ("length", "max_tokens"), ("stop", "end_turn", "completed"), ("content_filter", "refusal")
#: Markers in the text of an HTTP error.
QUOTA_MARKERS = ("insufficient_quota", "insufficient_credits", "credit balance is too low", "insufficient balance", "this request requires more credits", "fewer max_tokens")
MODEL_MARKERS = ("model_not_found", "invalid_model", "unknown_model", "no endpoints found")
MODEL_TERMS = ("invalid", "not found", "unknown", "not exist")


def _first(body: Column, paths: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.get_json_object(body, p) for p in paths])


def normalize_response(body: Column) -> Column:
    """struct(text, input_tokens, output_tokens, outcome); an empty text is null, counts that are not numbers are null."""
    text = F.nullif(_first(body, TEXT_PATHS), F.lit(""))
    stop, cut = _first(body, STOP_PATHS), F.get_json_object(body, "$.incomplete_details.reason") == "max_output_tokens"
    thought = F.coalesce(_first(body, REASONING_PATHS).try_cast("bigint"), F.lit(0)) > 0
    outcome = (
        F.when(stop.isin(*REFUSED), "refusal").when(text.isNotNull() & (F.trim(text) != ""), "completed").when(stop.isin(*LIMIT) | cut, "output_limit_exhausted")
        .when(stop.isin(*NORMAL), F.when(thought, "reasoning_without_answer").otherwise("empty_completion")).when(stop == "incomplete", "incomplete_response").when(stop == "failed", "failed_provider_response")
        .otherwise("invalid_provider_response")
    )
    return F.struct(text.alias("text"), _first(body, INPUT_PATHS).try_cast("bigint").alias("input_tokens"), _first(body, OUTPUT_PATHS).try_cast("bigint").alias("output_tokens"), outcome.alias("outcome"))


def _any(text: Column, markers: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for m in markers:
        found = found | F.contains(text, F.lit(m))
    return found


def classify_http(status: Column, message: Column) -> Column:
    """struct(error_type, retryable, model_scoped) of a failed call."""
    low = F.lower(F.coalesce(message, F.lit("")))
    quota = (status == 402) | _any(low, QUOTA_MARKERS) | (F.contains(low, F.lit("quota exceeded")) & _any(low, ("limit: 0", "billing", "current quota")))
    unknown = (status == 404) | _any(low, MODEL_MARKERS) | (F.contains(low, F.lit("model")) & _any(low, MODEL_TERMS))
    kind = (
        F.when(status.isin(401, 403), "authentication_error").when(quota, "quota_or_billing_error").when(unknown, "invalid_model_error").when(status.isin(400, 413, 422), "invalid_parameter_error")
        .when(status.isin(408, 409, 425, 429) | status.between(500, 599), "transient_provider_error").otherwise("provider_error")
    )
    return F.struct(kind.alias("error_type"), (kind == "transient_provider_error").alias("retryable"), (kind == "invalid_model_error").alias("model_scoped"))
