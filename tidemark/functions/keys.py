"""Content-addressed identities. Parts are joined by NUL or in hand-built JSON of fixed key order."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import text as T

CHUNKER_VERSION = "tidemark-scan-v2"
PROVIDER_DEFAULT = "provider-default"
NUL = chr(0)


def sha(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def joined(*parts: Column) -> Column:
    return F.concat_ws(NUL, *[p.cast("string") for p in parts])


def chunk_id(repository: Column, revision: Column, path: Column, start: Column, end: Column, content_hash: Column, version: str = CHUNKER_VERSION) -> Column:
    return F.substring(sha(joined(repository, revision, path, start, end, content_hash, F.lit(version))), 1, 24)


def embedding_input(path: Column, signature: Column, content: Column) -> Column:
    return F.concat(T.slashes(path), F.lit("\n"), F.coalesce(signature, F.lit("")), F.lit("\n"), T.unix_lines(content))


def input_hash(path: Column, signature: Column, content: Column) -> Column:
    return sha(embedding_input(path, signature, content))


def cache_key(input_hash: Column, provider: str, model: str, version: str, dimensions: int | None, max_chunk_tokens: int, chunker: str = CHUNKER_VERSION) -> Column:
    rest = {"provider": provider, "model": model, "version": version, "dimensions": PROVIDER_DEFAULT if dimensions is None else dimensions, "chunkerVersion": chunker, "maxChunkTokens": max_chunk_tokens}
    tail = json.dumps(rest, separators=(",", ":"), ensure_ascii=False)[1:]
    return sha(F.concat(F.lit('{"inputHash":"'), input_hash, F.lit('",' + tail)))


def dimension_identity(dimensions: Column) -> Column:
    return F.coalesce(dimensions.cast("string"), F.lit(PROVIDER_DEFAULT))


def excerpt_hash(path: Column, start: Column, end: Column, source: Column) -> Column:
    return F.substring(sha(F.concat_ws(":", path, start.cast("string"), end.cast("string"), source)), 1, 16)


#: What a finding's id begins with (fixed value).
FINDING_PREFIX = "acr-"


def finding_id(filename: Column, category: Column, title: Column, spans: Column) -> Column:
    """spans: array of path:start:end strings in order."""
    return F.concat(F.lit(FINDING_PREFIX), F.substring(sha(joined(filename, category, T.normal_title(title), F.array_join(spans, "|"))), 1, 16))


def review_cache_key(request: dict, provider: str, identity: str, versions: dict) -> str:
    return hashlib.sha256(json.dumps({"request": request, "provider": provider, "identity": identity, **versions}, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def snapshot_id(base: str, head: str) -> str:
    return hashlib.sha256(f"{base}:{head}".encode()).hexdigest()


def is_source_scoped(repository_id: Column) -> Column:
    """Whether an id names a hosted repository, `owner/name` in lower case, as indexes once did; a checkout's is a digest."""
    part = "[a-z0-9_.-]+"
    return F.rlike(repository_id, F.lit(rf"\A{part}/{part}\z"))
