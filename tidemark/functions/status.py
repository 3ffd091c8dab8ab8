"""Status codes, error vocabularies, retry timing, ratios and costs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed vocabularies.
PROVIDER_CODES = ("invalid_api_key", "invalid_request_error", "model_not_found", "insufficient_quota", "rate_limit_exceeded", "context_length_exceeded", "server_error", "service_unavailable", "access_terminated", "billing_not_active", "authentication_error", "permission_error", "not_found_error", "request_too_large", "rate_limit_error", "api_error", "overloaded_error", "timeout_error", "billing_error")
RETRYABLE_SOURCE = ("rate_limit", "timeout", "network", "provider_unavailable", "revision_changed")
RETRYABLE_PROVIDER = ("rate_limit", "timeout", "network", "provider_unavailable")
GITHUB_CODES = {
    "authentication": "GITHUB_AUTHENTICATION_FAILED",
    "authorization": "GITHUB_AUTHORIZATION_FAILED",
    "not_found": "GITHUB_NOT_FOUND",
    "rate_limit": "GITHUB_RATE_LIMIT",
    "provider_unavailable": "GITHUB_PROVIDER_UNAVAILABLE",
    "invalid_response": "GITHUB_INVALID_RESPONSE",
    "revision_changed": "GITHUB_REVISION_CHANGED",
    "coverage_incomplete": "GITHUB_COVERAGE_INCOMPLETE",
}
SECONDARY_LIMIT_MS = 60_000
MAX_DETAIL_CHARS = 160


def kind_of_status(status: Column) -> Column:
    """The kind of a model or embedding provider's HTTP failure."""
    return (
        F.when(status.isNull(), "unknown")
        .when(status.isin(401, 403), "authentication")
        .when(status == 404, "unsupported_model")
        .when(status == 408, "timeout")
        .when(status == 429, "rate_limit")
        .when((status == 409) | (status >= 500), "provider_unavailable")
        .when(status >= 400, "invalid_request")
        .otherwise("unknown")
    )


def kind_of_source_response(status: Column, remaining: Column, retry_after_ms: Column, message: Column) -> Column:
    """A 403 is a rate limit only with evidence: no quota left, a retry time, or words that say so."""
    limited = (remaining == "0") | retry_after_ms.isNotNull() | F.coalesce(F.rlike(message, F.lit("(?i)rate limit|abuse")), F.lit(False))
    return (
        F.when((status == 429) | ((status == 403) & F.coalesce(limited, F.lit(False))), "rate_limit")
        .when(status == 401, "authentication")
        .when(status == 403, "authorization")
        .when(status == 404, "not_found")
        .when(status == 408, "timeout")
        .when(status >= 500, "provider_unavailable")
        .otherwise("unknown")
    )


def retry_after_ms(header: Column, now_ms: Column) -> Column:
    """Delay-seconds or an HTTP date, else null."""
    t = F.btrim(header)
    date = F.try_to_timestamp(F.regexp_extract(t, r"^[A-Za-z]{3}, (\d{2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    return F.when(F.rlike(t, F.lit(r"^\d+$")), t.try_cast("long") * 1000).when(date.isNotNull(), F.greatest(F.lit(0), F.unix_millis(date) - now_ms)).cast("long")


def source_wait_ms(kind: Column, status: Column, after_ms: Column, remaining: Column, reset_seconds: Column, now_ms: Column) -> Column:
    reset = F.when((remaining == "0") & (reset_seconds > 0), F.greatest(F.lit(0), reset_seconds.cast("long") * 1000 - now_ms))
    return F.when(kind == "rate_limit", F.coalesce(after_ms, reset, F.when(status == 403, SECONDARY_LIMIT_MS))).cast("long")


def retry_delay_ms(attempt: Column, base: int, most: int, after_ms: Column, random: Column) -> Column:
    """A retry time as asked for, capped; else exponential with the upper half jittered."""
    step = F.least(F.lit(base) * F.pow(F.lit(2.0), F.least(attempt - 1, F.lit(30))), F.lit(float(most)))
    r = F.least(F.lit(1.0), F.greatest(F.lit(0.0), random))
    return F.when(after_ms > 0, F.least(F.ceil(after_ms), F.lit(most))).otherwise(F.floor(step / 2 + r * step / 2)).cast("long")


def model_backoff_ms(attempt: Column, after_ms: Column, most: int = 10_000) -> Column:
    return F.when(after_ms > 0, F.least(after_ms, F.lit(most))).otherwise(F.least(F.lit(250) * F.pow(F.lit(2.0), attempt - 1), F.lit(2000.0))).cast("long")


def safe_provider_code(code: Column) -> Column:
    return F.when(code.isin(*PROVIDER_CODES), code)


def source_error_code(kind: Column, source: Column, code: Column) -> Column:
    hub = None
    for k, v in GITHUB_CODES.items():
        hub = (F if hub is None else hub).when(kind == k, v)
    git = F.when(code == "not_a_repository", "GIT_NOT_A_REPOSITORY").when(code.isin("invalid_ref", "no_merge_base"), "GIT_INVALID_REF").when(kind == "configuration", "SOURCE_CONFIGURATION").otherwise("GIT_COMMAND_FAILED")
    return F.when(kind == "aborted", "REVIEW_ABORTED").when(kind == "timeout", "SOURCE_TIMEOUT").when(kind == "network", "SOURCE_NETWORK").when(source == "git", git).when(kind == "configuration", "SOURCE_CONFIGURATION").otherwise(F.coalesce(hub, F.lit("SOURCE_FAILED")))


def prefixed_code(prefix: str, kind: Column) -> Column:
    """MODEL_... or EMBEDDING_... of a kind."""
    return F.concat(F.lit(prefix + "_"), F.upper(kind))


def documented_message(body: Column, redact) -> Column:
    t = redact(F.get_json_object(body, "$.message"))
    t = F.btrim(F.regexp_replace(F.regexp_replace(t, r"[\x00-\x1f\x7f]+", " "), r"\s+", " "))
    return F.nullif(F.substring(t, 1, MAX_DETAIL_CHARS), F.lit(""))


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def f1(precision: Column, recall: Column) -> Column:
    return F.try_divide(2 * precision * recall, precision + recall)


def cost(input_tokens: Column, output_tokens: Column, estimated: Column, per_input: float | None, per_output: float | None) -> Column:
    """By the operator's own prices, of measured tokens only."""
    if per_input is None or per_output is None:
        return F.lit(None).cast("double")
    return F.when(~estimated, (input_tokens * float(per_input) + output_tokens * float(per_output)) / 1e6)


def context_allowance(mandatory: Column, usable: int, cap: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(cap), F.lit(usable) - mandatory)).cast("long")


def exit_code(status: Column, any_at_threshold: Column) -> Column:
    return F.when(status != "complete", 2).when(any_at_threshold, 1).otherwise(0)


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "high", 3).when(severity == "medium", 2).when(severity == "low", 1)
