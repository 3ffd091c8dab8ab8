"""Adapters of hosted models over an injected transport; there is no network here, so tests inject answers.

A transport is post(url, headers, body) -> (status, headers, answer); it raises OSError if the connection fails. Only known
codes and statuses of a provider reach an error's message: free text can echo the request."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from tidemark.functions import status as S
from tidemark.operators.evidence import CATEGORIES, MAX_EVIDENCE, MAX_FINDINGS
from tidemark.plans.ports import ProviderError, checked_batch

Post = Callable[[str, dict, dict], tuple[int, dict, dict]]
_LEVELS = ["high", "medium", "low"]


def _object(**props) -> dict:
    return {"type": "object", "additionalProperties": False, "required": list(props), "properties": props}


_EVIDENCE = _object(path={"type": "string"}, startLine={"type": "integer"}, endLine={"type": "integer"}, contextId={"type": ["string", "null"]})
_FINDING = _object(severity={"enum": _LEVELS}, category={"enum": list(CATEGORIES)}, confidence={"enum": _LEVELS}, title={"type": "string"}, explanation={"type": "string"}, evidence={"type": "array", "minItems": 1, "maxItems": MAX_EVIDENCE, "items": _EVIDENCE}, suggestion={"type": ["string", "null"]})
RESPONSE_SCHEMA = _object(findings={"type": "array", "maxItems": MAX_FINDINGS, "items": _FINDING}, summary={"type": "string"}, abstained={"type": "boolean"}, abstentionReason={"type": ["string", "null"]})


def plain_schema(schema):
    """A JSON schema without array bounds, and with unions of types as alternatives."""
    if isinstance(schema, list):
        return [plain_schema(x) for x in schema]
    if not isinstance(schema, dict):
        return schema
    out = {k: plain_schema(v) for k, v in schema.items() if k not in ("minItems", "maxItems")}
    if isinstance(schema.get("type"), list) and len(schema["type"]) > 1:
        out["anyOf"] = [{"type": t} for t in out.pop("type")]
    return out


def status_kind(status: int) -> str:
    if status in (401, 403):
        return "authentication"
    fixed = {404: "unsupported_model", 408: "timeout", 429: "rate_limit", 409: "provider_unavailable"}
    return fixed.get(status, "provider_unavailable" if status >= 500 else "invalid_request" if status >= 400 else "unknown")


def _number(text) -> float | None:
    try:
        return float(text) if float(text) > 0 else None
    except (TypeError, ValueError):
        return None


def send(post: Post, url: str, headers: dict, body: dict) -> dict:
    try:
        status, got, answer = post(url, headers, body)
    except OSError as e:
        raise ProviderError("timeout" if isinstance(e, TimeoutError) else "network") from e
    if 200 <= status < 300:
        return answer
    error = answer.get("error") if isinstance(answer, dict) else None
    code = next((c for c in ((error or {}).get("code"), (error or {}).get("type")) if c in S.PROVIDER_CODES), None)
    ms, seconds = _number(got.get("retry-after-ms")), _number(got.get("retry-after"))
    raise ProviderError(status_kind(status), f"error {status}" + (f" ({code})" if code else ""), ms or (seconds and seconds * 1000))


def _structured(text: str) -> dict:
    try:
        got = json.loads(text)
    except ValueError as e:
        raise ProviderError("malformed_response", "the answer is not JSON") from e
    if not isinstance(got, dict) or not isinstance(got.get("findings"), list):
        raise ProviderError("malformed_response", "the answer has another shape")
    return got


@dataclass
class ChatModel:
    """Structured output through a chat-completions answer."""

    post: Post
    model: str
    key: str
    url: str = "https://api.openai.com/v1/chat/completions"
    provider: str = "openai"

    @property
    def identity(self) -> str:
        return f"{self.provider}:{self.model}"

    def review(self, system: str, user: str, max_output_tokens: int) -> dict:
        if not self.key:
            raise ProviderError("authentication", "the key is missing")
        form = {"type": "json_schema", "json_schema": {"name": "review", "strict": True, "schema": RESPONSE_SCHEMA}}
        got = send(self.post, self.url, {"authorization": f"Bearer {self.key}"}, {"model": self.model, "max_completion_tokens": max_output_tokens, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}], "response_format": form})
        choice = got["choices"][0]
        if choice["message"].get("refusal"):
            raise ProviderError("refused")
        if choice.get("finish_reason") == "length":
            raise ProviderError("response_truncated")
        use = got.get("usage") or {}
        return {"response": _structured(choice["message"].get("content") or ""), "input_tokens": use.get("prompt_tokens", 0), "output_tokens": use.get("completion_tokens", 0), "actual": bool(use)}


@dataclass
class MessagesModel:
    """Structured output through a messages answer."""

    post: Post
    model: str
    key: str
    url: str = "https://api.anthropic.com/v1/messages"
    provider: str = "anthropic"

    @property
    def identity(self) -> str:
        return f"{self.provider}:{self.model}"

    def review(self, system: str, user: str, max_output_tokens: int) -> dict:
        if not self.key:
            raise ProviderError("authentication", "the key is missing")
        got = send(self.post, self.url, {"x-api-key": self.key, "anthropic-version": "2023-06-01"}, {"model": self.model, "max_tokens": max_output_tokens, "system": system, "messages": [{"role": "user", "content": user}], "output_config": {"format": {"type": "json_schema", "schema": plain_schema(RESPONSE_SCHEMA)}}})
        if got.get("stop_reason") == "refusal":
            raise ProviderError("refused")
        if got.get("stop_reason") == "max_tokens":
            raise ProviderError("response_truncated")
        use = got.get("usage") or {}
        text = "".join(x["text"] for x in got.get("content", []) if x.get("type") == "text")
        return {"response": _structured(text), "input_tokens": use.get("input_tokens", 0), "output_tokens": use.get("output_tokens", 0), "actual": bool(use)}


@dataclass
class HostedEmbedding:
    """Vectors of a batch, put back in the order of their explicit index."""

    post: Post
    model: str
    key: str
    dimensions: int | None = None
    url: str = "https://api.openai.com/v1/embeddings"
    provider: str = "openai"
    version: str = "v1"

    def embed(self, texts: list[str]) -> list[list[float]]:
        body = {"model": self.model, "input": texts} | ({} if self.dimensions is None else {"dimensions": self.dimensions})
        data = send(self.post, self.url, {"authorization": f"Bearer {self.key}"}, body).get("data") or []
        if sorted(x.get("index", -1) for x in data) != list(range(len(texts))):
            raise ProviderError("malformed_response", "the vectors' indexes are not those of the texts")
        return checked_batch([x["embedding"] for x in sorted(data, key=lambda x: x["index"])], len(texts), self.dimensions)
