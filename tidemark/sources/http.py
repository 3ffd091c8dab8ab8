"""A GET connector for pull requests: typed errors, bounded error bodies, retries within a deadline."""

from __future__ import annotations

import base64
import email.utils
import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field

from tidemark.functions import status as S
from tidemark.sources.changes import SourceError

API, MAX_ERROR_BYTES = "https://api.github.com", 4096
#: (status, headers by lower-case name, body)
Answer = tuple[int, dict[str, str], bytes]


def fetch(url: str, headers: dict[str, str], timeout: float) -> Answer:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout) as r:  # noqa: S310
            return r.status, {k.lower(): v for k, v in r.headers.items()}, r.read()
    except urllib.error.HTTPError as e:
        return e.code, {k.lower(): v for k, v in e.headers.items()}, e.read(MAX_ERROR_BYTES)
    except TimeoutError as e:
        raise SourceError("timeout", "the request timed out") from e
    except OSError as e:
        raise SourceError("network", "the connection failed") from e


def retry_after_ms(value: str | None, now_ms: float) -> float | None:
    text = (value or "").strip()
    if text.isdigit():
        return int(text) * 1000
    try:
        return max(0.0, email.utils.parsedate_to_datetime(text).timestamp() * 1000 - now_ms) if text[:1].isalpha() else None
    except ValueError:
        return None


def documented(body: bytes) -> str | None:
    """The service's own short message, bounded; never the body."""
    try:
        message = json.loads(body).get("message")
    except (ValueError, AttributeError):
        return None
    return re.sub(r"\s+", " ", re.sub(r"[\x00-\x1f\x7f]+", " ", message)).strip()[: S.MAX_DETAIL_CHARS] or None if isinstance(message, str) else None


def failure(status: int, headers: dict[str, str], body: bytes, now_ms: float) -> SourceError:
    """The typed error of an answer that is not a success, with retry_after_ms if it says when to come back."""
    said, after, spent = documented(body), retry_after_ms(headers.get("retry-after"), now_ms), headers.get("x-ratelimit-remaining") == "0"
    if status == 429 or (status == 403 and (spent or after is not None or re.search("rate limit|abuse", said or "", re.I))):
        if after is None and spent and (reset := headers.get("x-ratelimit-reset", "")).isdigit():
            after = max(0.0, int(reset) * 1000 - now_ms)
        e = SourceError("rate_limit", f"rate limited (HTTP {status})")
        e.retry_after_ms = after if after is not None else S.SECONDARY_LIMIT_MS if status == 403 else None
        return e
    kind = {401: "authentication", 403: "authorization", 404: "not_found", 408: "timeout"}.get(status, "provider_unavailable" if status >= 500 else "unknown")
    return SourceError(kind, f"HTTP {status}" + (f" ({said})" if said and status < 500 else ""))


@dataclass
class Requester:
    """request(path) for changes.pull_source: the text of a JSON answer."""

    token: str | None
    fetch: Callable[[str, dict[str, str], float], Answer] = fetch
    attempts: int = 3
    base_ms: float = 250
    max_ms: float = 10_000
    timeout_s: float = 30
    deadline: float | None = None
    sleep: Callable[[float], None] = time.sleep
    events: list[dict] = field(default_factory=list)

    def __call__(self, path: str) -> str:
        if not self.token:
            raise SourceError("configuration", "Missing token", code="missing_token")
        headers = {"Accept": "application/vnd.github+json", "Authorization": f"Bearer {self.token}", "X-GitHub-Api-Version": "2022-11-28"}
        for n in range(1, self.attempts + 1):
            try:
                status, got, body = self.fetch(API + path, headers, self.timeout_s)
                if not 200 <= status < 300:
                    raise failure(status, got, body, time.time() * 1000)
                try:
                    json.loads(body)
                except ValueError as e:
                    raise SourceError("invalid_response", "the answer was not valid JSON") from e
                return body.decode()
            except SourceError as e:
                wait = getattr(e, "retry_after_ms", None)
                wait = min(self.base_ms * 2 ** (n - 1), self.max_ms) if wait is None else wait
                late = self.deadline is not None and time.time() + wait / 1000 >= self.deadline
                self.events.append({"attempt": n, "kind": e.kind})
                if e.kind not in S.RETRYABLE_SOURCE or n == self.attempts or wait > self.max_ms or late:
                    raise
                self.sleep(wait / 1000)
        raise AssertionError


def trusted_rules(owner: str, repo: str, base_sha: str, request: Callable[[str], str], name: str = ".tidemark-ignore") -> str | None:
    """The ignore file at the base revision: what a pull request itself brings cannot change it. Only a 404 is its absence."""
    try:
        got = json.loads(request(f"/repos/{owner}/{repo}/contents/{name}?ref={base_sha}"))
    except SourceError as e:
        if e.kind == "not_found":
            return None
        raise
    text = got.get("content") if isinstance(got, dict) and got.get("encoding") == "base64" else None
    if text is None or not re.fullmatch(r"[A-Za-z0-9+/=\r\n]*", text):
        raise SourceError("invalid_response", "the ignore file is not base64")
    return base64.b64decode(text).decode(errors="replace") or None
