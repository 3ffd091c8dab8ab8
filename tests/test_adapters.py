"""Connectors, adapters and the evaluation, over injected answers."""

import base64
import json

import pytest

from tidemark.plans import adapters, evaluate, ports
from tidemark.sources import http
from tidemark.sources.changes import SourceError


def answers(*got):
    it = iter(got)

    def fetch(url, headers, timeout):
        x = next(it)
        if isinstance(x, Exception):
            raise x
        return x

    return fetch


def requester(*got):
    waits = []
    return http.Requester("t", answers(*got), sleep=waits.append), waits


def test_requester():
    r, waits = requester((500, {}, b""), SourceError("network", "x"), (200, {}, b"[1]"))
    assert r("/x") == "[1]" and waits == [0.25, 0.5]
    r, waits = requester((403, {"retry-after": "7"}, b""), (200, {}, b"{}"))
    assert r("/x") == "{}" and waits == [7.0]
    for answer, kind in (((403, {}, b""), "authorization"), ((401, {}, b""), "authentication"), ((404, {}, b""), "not_found"), ((200, {}, b"<"), "invalid_response"), ((403, {}, b'{"message": "secondary rate limit"}'), "rate_limit"), ((418, {}, b""), "unknown")):
        r, waits = requester(answer)
        with pytest.raises(SourceError) as e:
            r("/x")
        assert e.value.kind == kind and waits == []  # a wait over the cap is not waited for
    with pytest.raises(SourceError) as e:
        http.Requester(None)("/x")
    assert e.value.kind == "configuration"


def test_retry_after():
    assert http.retry_after_ms("3", 0) == 3000 and http.retry_after_ms("-4", 0) is None and http.retry_after_ms(None, 0) is None
    assert http.retry_after_ms("Thu, 01 Jan 1970 00:01:00 GMT", 10_000) == 50_000


def test_trusted_rules():
    body = json.dumps({"encoding": "base64", "content": base64.b64encode(b"*.log\n").decode()}).encode()
    assert http.trusted_rules("o", "r", "s", requester((200, {}, body))[0]) == "*.log\n"
    assert http.trusted_rules("o", "r", "s", requester((404, {}, b""))[0]) is None
    with pytest.raises(SourceError):
        http.trusted_rules("o", "r", "s", requester((200, {}, b'{"encoding": "x", "content": ""}'))[0])


def test_schema():
    got = adapters.plain_schema(adapters.RESPONSE_SCHEMA)
    assert "maxItems" not in json.dumps(got) and got["properties"]["abstentionReason"] == {"anyOf": [{"type": "string"}, {"type": "null"}]}


EMPTY = json.dumps({"findings": [], "summary": "", "abstained": False, "abstentionReason": None})


def test_models():
    chat = lambda got, status=200, head=None: adapters.ChatModel(lambda u, h, b: (status, head or {}, got), "m", "k")
    ok = chat({"choices": [{"message": {"content": EMPTY}, "finish_reason": "stop"}], "usage": {"prompt_tokens": 3, "completion_tokens": 2}}).review("s", "u", 9)
    assert ok == {"response": json.loads(EMPTY), "input_tokens": 3, "output_tokens": 2, "actual": True}
    bad = {"response_truncated": {"choices": [{"message": {"content": "{"}, "finish_reason": "length"}]}, "malformed_response": {"choices": [{"message": {"content": "{"}}]}, "refused": {"choices": [{"message": {"refusal": "no"}}]}}
    for kind, got in bad.items():
        with pytest.raises(ports.ProviderError) as e:
            chat(got).review("s", "u", 9)
        assert e.value.kind == kind
    with pytest.raises(ports.ProviderError) as e:
        chat({"error": {"code": "rate_limit_exceeded", "message": "source code"}}, 429, {"retry-after": "2"}).review("s", "u", 9)
    assert (e.value.kind, e.value.retry_after_ms, str(e.value)) == ("rate_limit", 2000, "error 429 (rate_limit_exceeded)")
    m = adapters.MessagesModel(lambda u, h, b: (200, {}, {"content": [{"type": "text", "text": EMPTY}], "stop_reason": "end_turn"}), "m", "k")
    assert m.review("s", "u", 9)["response"]["findings"] == []
    with pytest.raises(ports.ProviderError):
        adapters.MessagesModel(None, "m", "").review("s", "u", 9)


def test_embedding():
    e = adapters.HostedEmbedding(lambda u, h, b: (200, {}, {"data": [{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}]}), "m", "k", 1)
    assert e.embed(["a", "b"]) == [[1.0], [2.0]]
    with pytest.raises(ports.ProviderError):
        e.embed(["a"])

    def down(u, h, b):
        raise ConnectionError

    with pytest.raises(ports.ProviderError) as x:
        adapters.HostedEmbedding(down, "m", "k").embed(["a"])
    assert x.value.kind == "network"


def test_evaluate(spark):
    docs = [{"path": "src/user.ts", "content": "export function profileOf(user) {\n  return user.profile;\n}\n"}, {"path": "src/other.ts", "content": "export const zebra = 1;\n"}]
    bad = {"id": "bad", "changedPath": "src/a.ts", "patch": "@@ -1 +1 @@\n+return profileOf(user).id;", "documents": docs, "relevantPaths": ["src/user.ts"], "expectedFindings": ["deref", "missed"], "clean": False}
    good = {"id": "good", "changedPath": "src/b.ts", "patch": "@@ -1 +1 @@\n+let x = 1;", "documents": docs, "relevantPaths": [], "expectedFindings": [], "clean": True}
    model = ports.RuleModel([("deref", r"profileOf\(user\)\.id")])
    got = evaluate.evaluate(spark, [bad, good], "lexical", model)
    assert got == {"retrieval_recall": 1.0, "mrr": 1.0, "precision": 1.0, "recall": 0.5, "tp": 1, "fp": 0, "fn": 1, "clean_false_positive_rate": 0.0, "coverage": 1.0, "statuses": {"complete": 2, "partial": 0, "failed": 0}}
