"""What a review calls outside: models and embedders, their retries and the cap on calls.

Adapters are plain picklable objects, called on executors a batch at a time. The cap is reserved on the driver before
anything is sent out, as executors share no counter."""

from __future__ import annotations

import hashlib
import json
import math
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

from tidemark.functions import status as S


class ProviderError(Exception):
    def __init__(self, kind: str, message: str = "", retry_after_ms: float | None = None) -> None:
        super().__init__(message or kind)
        self.kind, self.retry_after_ms = kind, retry_after_ms

    @property
    def retryable(self) -> bool:
        return self.kind in S.RETRYABLE_PROVIDER


class ReviewModel(Protocol):
    provider: str
    identity: str

    def review(self, system: str, user: str, max_output_tokens: int) -> dict:
        """{"response": the structured answer, "input_tokens", "output_tokens", "actual"}"""


class EmbeddingAdapter(Protocol):
    provider: str
    model: str
    version: str
    dimensions: int | None

    def embed(self, texts: list[str]) -> list[list[float]]: ...


@dataclass
class Retry:
    attempts: int = 3
    base_ms: int = 250
    max_ms: int = 10_000
    sleep: Callable[[float], None] = time.sleep

    def call(self, f: Callable[[], object], before: Callable[[], None] | None = None) -> tuple[object, int]:
        """(result, attempts). Failures that may pass are tried again; the last one is raised."""
        for n in range(1, self.attempts + 1):
            if before:
                before()
            try:
                return f(), n
            except ProviderError as e:
                if not e.retryable or n == self.attempts:
                    raise
                wait = min(math.ceil(e.retry_after_ms), self.max_ms) if e.retry_after_ms else min(self.base_ms * 2 ** (n - 1), self.max_ms)
                self.sleep(wait / 1000)
        raise AssertionError


class BudgetError(Exception):
    code = "REQUEST_BUDGET_EXHAUSTED"


@dataclass
class RequestBudget:
    """One cap for all calls of a run, and how much of it embeddings may use."""

    limit: int
    embedding_limit: float = math.inf
    used: dict[str, int] = field(default_factory=lambda: {"model": 0, "embedding": 0})

    def cap_embeddings(self, allowance: int) -> None:
        self.embedding_limit = min(self.embedding_limit, max(0, int(allowance)))

    def reserve(self, kind: str) -> None:
        if kind == "embedding" and self.used[kind] >= self.embedding_limit:
            raise BudgetError(f"Embedding allowance {self.embedding_limit} exhausted; the rest is reserved for model review")
        if self.consumed >= self.limit:
            raise BudgetError(f"External request budget {self.limit} exhausted before {kind} call")
        self.used[kind] += 1

    @property
    def consumed(self) -> int:
        return sum(self.used.values())

    @property
    def remaining(self) -> int:
        return max(0, self.limit - self.consumed)


def checked_batch(vectors: list[list[float]], n: int, dimensions: int | None) -> list[list[float]]:
    if len(vectors) != n:
        raise ProviderError("malformed_response", f"{len(vectors)} vectors for {n} texts")
    for v in vectors:
        if not v or (dimensions is not None and len(v) != dimensions) or len(v) != len(vectors[0]):
            raise ProviderError("dimension_mismatch")
        if not all(math.isfinite(x) for x in v):
            raise ProviderError("malformed_response", "a vector is not finite")
    return vectors


class HashEmbedding:
    """Deterministic: tokens by the first byte of their SHA-256, as a unit vector."""

    provider, model, version, dimensions = "deterministic", "token-hash", "v1", 64

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.dimensions
            for token in re.findall(r"[a-z_$][\w$]*", t.lower(), re.ASCII):
                v[hashlib.sha256(token.encode()).digest()[0] % self.dimensions] += 1
            norm = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / norm for x in v])
        return out


class RuleModel:
    """Deterministic: a finding for each rule (label, pattern) that the request's text fits, at its last added line."""

    provider, identity = "deterministic", "rules-v1"

    def __init__(self, rules: list[tuple[str, str]]) -> None:
        self.rules = rules

    def review(self, system: str, user: str, max_output_tokens: int) -> dict:
        added = re.findall(r'"kind":"addition"[^}]*"newLine":(\d+)[^}]*"complete":true', user)
        name = json.loads(re.search(r"\[about this change[^\n]*\n([^\n]+)", user)[1])["filename"]
        at = int(added[-1]) if added else 1
        ev = [{"path": name, "startLine": at, "endLine": at, "contextId": None}]
        found = [{"severity": "high", "category": "correctness", "confidence": "high", "title": label, "explanation": "A rule fits.", "evidence": ev, "suggestion": None} for label, p in self.rules if re.search(p, user)]
        return {"response": {"findings": found, "summary": "", "abstained": False, "abstentionReason": None}, "input_tokens": 0, "output_tokens": 0, "actual": False}


def embed(texts: DataFrame, adapter: EmbeddingAdapter, batch: int = 32, retry: Retry | None = None) -> DataFrame:
    """(key, values) of texts(key long, text), called in batches on the executors; a failure fails the job."""
    retry = retry or Retry()

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            for k in range(0, len(p), batch):
                part = p.iloc[k : k + batch]
                vectors, _ = retry.call(lambda part=part: checked_batch(adapter.embed(part["text"].tolist()), len(part), adapter.dimensions))
                yield pd.DataFrame({"key": part["key"], "values": vectors})

    return texts.select("key", "text").mapInPandas(run, "key long, values array<double>")


ANSWERS = "filename string, seg_no int, response string, input_tokens long, output_tokens long, estimated boolean, attempts int, code string"


def ask(requests: DataFrame, model: ReviewModel, max_output_tokens: int, retry: Retry | None = None) -> DataFrame:
    """ANSWERS of requests(filename, seg_no, system, user). A failure is a row with its code and no response."""
    retry = retry or Retry()

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            rows = []
            for r in p.itertuples():
                try:
                    got, n = retry.call(lambda r=r: model.review(r.system, r.user, max_output_tokens))
                    rows.append((r.filename, r.seg_no, json.dumps(got["response"]), got["input_tokens"], got["output_tokens"], not got["actual"], n, None))
                except ProviderError as e:
                    rows.append((r.filename, r.seg_no, None, 0, 0, True, retry.attempts if e.retryable else 1, f"MODEL_{e.kind.upper()}"))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ANSWERS.split(", ")])

    return requests.select("filename", "seg_no", "system", "user").mapInPandas(run, ANSWERS)
