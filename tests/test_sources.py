"""Sources, sinks, ignore rules and guards."""

import json
import os
import subprocess

import pytest

from pyspark.sql import functions as F

from tidemark.functions import policy
from tidemark.sources import changes, guard, ignore, repository, store


def test_records():
    text = "M\0a.ts\0R100\0old.ts\0new.ts\0C75\0x\0y\0A\0z\0D\0gone\0"
    assert list(changes.records(text)) == [("modified", None, "a.ts"), ("renamed", "old.ts", "new.ts"), ("copied", "x", "y"), ("added", None, "z"), ("removed", None, "gone")]
    assert list(changes.records("")) == []


def test_name_status(spark):
    df = spark.createDataFrame([("s", "M\ta.ts\nR90\told\tnew\nA\tb\n\nX\tc")], "source string, output string")
    got = [(r.status, r.previous_filename, r.filename) for r in changes.parse_lines(df).orderBy("ord").collect()]
    assert got == [("modified", None, "a.ts"), ("renamed", "old", "new"), ("added", None, "b"), ("modified", None, "c")]
    z = spark.createDataFrame([("s", "D\0a\0R1\0b\0c\0")], "source string, output string")
    assert [(r.status, r.filename) for r in changes.parse_records(z).orderBy("ord").collect()] == [("removed", "a"), ("renamed", "c")]


def test_tree(spark):
    df = spark.createDataFrame([("100644 blob abc123     42\tsrc/a b.ts\x00120000 blob fff     3\tlink\x00160000 commit eee       -\tsub\x00",)], "output string")
    got = {tuple(r) for r in changes.tree_entries(df).collect()}
    assert got == {("src/a b.ts", "abc123", 42, False), ("link", "fff", 3, True)}


def test_pull(spark):
    files = [{"filename": f"f{i}.ts", "status": "modified", "additions": 1, "deletions": 0, "changes": 1, "patch": "@@ -1 +1 @@\n+x"} for i in range(130)]
    meta = {"title": "t", "body": None, "changed_files": 130, "base": {"sha": "b"}, "head": {"sha": "h"}}
    calls = []

    def request(path):
        calls.append(path)
        if "files" in path:
            k = int(path.rsplit("=", 1)[1]) - 1
            return json.dumps(files[100 * k : 100 * k + 100])
        return json.dumps(meta)

    snapshot, df = changes.pull_source(spark, "O", "r", 3, request)
    assert df.count() == 130 and snapshot["repository_id"] == "o/r" and len(calls) == 4
    with pytest.raises(changes.SourceError) as e:
        changes.pull_files(spark, [json.dumps(files[:3])], 4)
    assert e.value.kind == "coverage_incomplete"
    with pytest.raises(changes.SourceError) as e:
        changes.pull_files(spark, [json.dumps(files[:1] * 2)], 2)
    assert e.value.kind == "revision_changed"
    with pytest.raises(changes.SourceError) as e:
        changes.pull_files(spark, ['{"message": "no"}'], 1)
    assert e.value.kind == "invalid_response"


RULES = ignore.parse("# c\n*.log\n!keep.log\n/build\ndocs/*.md\n**/tmp/\nsrc/**/gen\n\nlogs/\n!logs/a.txt\r\n")
CASES = {"a.log": True, "x/y.log": True, "keep.log": False, "build/x.ts": True, "src/build/x.ts": False, "docs/a.md": True, "docs/x/a.md": False, "q/tmp/z": True, "tmp": False, "src/a/b/gen": True, "src/gen/x": True, "logs/a.txt": True, "ok.ts": False, "\\a.log": True}


def test_ignore(spark):
    assert {p: ignore.is_ignored(p, RULES) for p in CASES} == CASES
    df = spark.createDataFrame([(p,) for p in CASES], "p string")
    assert dict(map(tuple, df.select("p", ignore.ignored(F.col("p"), RULES)).collect())) == CASES


def test_guard(tmp_path):
    (tmp_path / "a.ts").write_text("x")
    os.symlink(tmp_path / "a.ts", tmp_path / "l.ts")
    assert guard.inspect_regular_file(str(tmp_path), "a.ts")[0] == 1
    for bad in ("../x", "l.ts", "."):
        with pytest.raises((ValueError, OSError)):
            guard.inspect_regular_file(str(tmp_path), bad)
    with pytest.raises(ValueError):
        guard.cache_dir(str(tmp_path), str(tmp_path / "c"), "x")


def test_guard_agrees_with_columns(spark):
    paths = [".env", "a/.env.local", "x.pem", "a/.ssh/k", "a/.aws/credentials", ".aws/x/credentials", "src/env.ts", "ID_RSA", "a\\.kube\\config", "key.ts"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert dict(map(tuple, df.select("p", policy.is_sensitive_path(F.col("p"))).collect())) == {p: guard.is_sensitive(p) for p in paths}


def test_store(spark, tmp_path):
    root = f"file://{tmp_path}/index"
    assert store.open_index(spark, root).status == "missing"
    g1 = store.publish(spark, root, {"t": spark.range(5)}, {"repository_id": "r", "revision": "1"})
    g2 = store.publish(spark, root, {"t": spark.range(7)}, {"repository_id": "r", "revision": "2"})
    assert store.open_index(spark, root).tables["t"].count() == 7
    assert store.open_index(spark, root, {"revision": "9"}).status == "stale"
    assert store.open_index(spark, root, {"repository_id": "q"}).status == "incompatible"
    assert store.vacuum(spark, root, -1) == [g1] and store.open_index(spark, root).status == "valid"
    store.Files(spark, root).delete(g2)
    assert store.open_index(spark, root).status == "corrupt"
    store.Files(spark, root).replace(store.MANIFEST, "{")
    assert store.open_index(spark, root).status == "corrupt"


def test_checkpoint_and_cache(spark, tmp_path):
    root = f"file://{tmp_path}"
    store.save_checkpoint(spark, root, spark.range(3))
    store.save_checkpoint(spark, root, spark.range(4))
    assert store.load_checkpoint(spark, root).tables["vectors"].count() == 4
    store.clear_checkpoint(spark, root)
    assert store.load_checkpoint(spark, root).status == "missing"
    cache = spark.createDataFrame([("a", "1", 1), ("a", "2", 2)], "key string, value string, put_at long")
    got = store.cache_get(cache, spark.createDataFrame([("a",), ("b",)], "key string")).orderBy("key").collect()
    assert [(r.value, r.hit) for r in got] == [("2", True), (None, False)]


def test_blob():
    data = store.encode_blob(b"\x00" * 16, 2)
    assert store.decode_blob(data) == (2, b"\x00" * 16)
    for bad in (data[:-1], data[:20], b"X" + data[1:], data[:-1] + b"\x01"):
        with pytest.raises(ValueError):
            store.decode_blob(bad)


def test_legacy(spark, tmp_path):
    v = {"cacheKey": "k", "inputHash": "h", "provider": "p", "model": "m", "version": "1", "dimensionIdentity": "2", "dimensions": 2, "values": [1.0, 2.0]}
    body = {"repositoryId": "r", "revision": "1", "chunkerVersion": "c", "maxChunkTokens": 5, "vectors": {"k": v, "other": v, "bad": v | {"cacheKey": "bad", "values": [1.0]}}}
    (tmp_path / "i.json").write_text(json.dumps(body, indent=1))
    assert [r.cache_key for r in store.legacy_vectors(spark, f"file://{tmp_path}/i.json").collect()] == ["k"]


@pytest.fixture
def checkout(tmp_path):
    root = tmp_path / "repo"
    root.mkdir()
    run = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", *a], cwd=root, check=True, capture_output=True)
    run("init", "-q")
    (root / "user.ts").write_text("export function id(user) {\n  return user.id;\n}\n")
    (root / "lib.ts").write_text('import { id } from "./user";\nexport const profile = (u) => id(u);\n')
    (root / "a.log").write_text("x")
    run("add", ".")
    run("commit", "-qm", "one")
    (root / "user.ts").write_text("export function id(user) {\n  return user.profile.id;\n}\n")
    (root / "new.ts").write_text("export const secret = 1;\n")
    (root / ".env").write_text("PASSWORD=1")
    (root / ".tidemark-ignore").write_text("*.log\n")
    return root


def test_local_and_scan(spark, checkout):
    snapshot, files = changes.local_source(spark, str(checkout))
    got = {r.filename: r for r in files.collect()}
    assert set(got) == {"user.ts", "new.ts", ".env", ".tidemark-ignore"}
    assert (got["user.ts"].additions, got["user.ts"].deletions) == (1, 1) and got[".env"].patch is None and got["new.ts"].additions == 1
    assert len(snapshot["snapshot_id"]) == 64
    scanned = {r.path for r in repository.scan(spark, f"file://{checkout}", ignore.parse("new.ts")).collect()}
    assert scanned == {"user.ts", "lib.ts"}
    with pytest.raises(changes.SourceError):
        changes.local_source(spark, str(checkout.parent))


def test_review_end_to_end(spark, checkout, capsys):
    from tidemark import cli
    from tidemark.plans import ports

    model = ports.RuleModel([("null-deref", r"(?m)^\+  return user\.profile\.id"), ("never", "zzz")])
    code = cli.main(["--local", "--repo", str(checkout), "--format", "json"], model)
    out = json.loads(capsys.readouterr().out)
    assert code == 1 and out["status"] == "complete", out
    assert [(f["filename"], f["title"], f["evidence"][0]["start_line"]) for f in out["findings"]] == [("user.ts", "null-deref", 2)]
    assert out["coverage"]["discovered"] == 4 and out["coverage"]["reviewed"] == 2 and out["coverage"]["skipped"] == 2
    assert cli.main(["--local", "--repo", str(checkout), "--format", "sarif", "--context", "hybrid"], model) == 1
    sarif = json.loads(capsys.readouterr().out)
    assert sarif["runs"][0]["results"][0]["level"] == "error"
    assert cli.main(["--local", "--repo", str(checkout), "--dry-run", "--context", "diff"], model) == 2
    assert cli.main(["--local", "--repo", str(checkout), "--index"]) == 0
    assert cli.main(["a", "b"]) == 64 and cli.main(["--local", "--context", "x"]) == 64


def test_review_failures(spark):
    from tidemark.plans import ports, review

    class Lying(ports.RuleModel):
        def review(self, system, user, n):
            got = super().review(system, user, n)
            for f in got["response"]["findings"]:
                f["evidence"][0]["endLine"] = 99
            return got

    class Broken(ports.RuleModel):
        def review(self, system, user, n):
            raise ports.ProviderError("authentication")

    files = spark.createDataFrame([(0, "a.ts", None, "modified", 1, 0, 1, "@@ -1 +1 @@\n+x"), (1, "b.ts", None, "modified", 1, 0, 1, "@@ -1 +1 @@\n+y")], "ord long, filename string, previous_filename string, status string, additions long, deletions long, changes long, patch string")
    got = review.review(spark, {}, files, Lying([("x", r"\+x")]), mode="diff")
    assert got["status"] == "partial" and got["errors"][0]["code"] == "MODEL_INVALID_EVIDENCE" and got["coverage"]["failed"] == 1
    got = review.review(spark, {}, files, Broken([]), mode="diff")
    assert got["status"] == "failed" and {e["code"] for e in got["errors"]} == {"MODEL_AUTHENTICATION"}
    got = review.review(spark, {}, files, ports.RuleModel([]), mode="diff", config=review.Config(max_requests=1))
    assert got["coverage"]["failed"] == 1 and got["errors"][0]["code"] == "REQUEST_BUDGET_EXHAUSTED"
    assert review.review(spark, {}, files.limit(0), ports.RuleModel([]), mode="diff")["status"] == "complete"
    assert review.review(spark, {}, files, None, config=review.Config(max_output_tokens=16_000))["status"] == "failed"


def test_budget_and_retry():
    from tidemark.plans import ports

    b = ports.RequestBudget(3)
    b.cap_embeddings(1)
    b.reserve("embedding")
    with pytest.raises(ports.BudgetError):
        b.reserve("embedding")
    b.reserve("model")
    b.reserve("model")
    with pytest.raises(ports.BudgetError):
        b.reserve("model")
    waits = []
    r = ports.Retry(3, 250, 1000, waits.append)
    tries = iter([ports.ProviderError("network"), ports.ProviderError("rate_limit", "", 5000), None])

    def f():
        e = next(tries)
        if e:
            raise e
        return 1

    assert r.call(f) == (1, 3) and waits == [0.25, 1.0]
    with pytest.raises(ports.ProviderError):
        ports.checked_batch([[1.0]], 2, None)


def test_stream(spark, tmp_path):
    from tidemark.streaming import refresh

    src, root = tmp_path / "in", f"file://{tmp_path}/index"
    schema = "path string, content string, at long"
    for k, rows in enumerate([[("a", "1", 1), ("b", "1", 1)], [("a", "2", 2), ("b", None, 2), ("c", "3", 2)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        refresh.start(spark.readStream.schema(schema).parquet(str(src)), root, f"{tmp_path}/cp", once=True).awaitTermination()
        got = {r.path: r.content for r in store.open_index(spark, root).tables["files"].collect()}
        assert got == [{"a": "1", "b": "1"}, {"a": "2", "c": "3"}][k]


def test_answers_are_cached(spark, tmp_path):
    from tidemark.plans import ports, review

    files = spark.createDataFrame([(0, "a.ts", None, "modified", 1, 0, 1, "@@ -1 +1 @@\n+x")], changes.FILES)
    seen = []
    run = lambda m: review.review(spark, {}, files, m, mode="diff", cache=f"file://{tmp_path}/cache", events=seen.append)
    model = ports.RuleModel([("x", r"\+x")])
    first, again = run(model), run(model)
    assert (first["usage"]["cache_hits"], again["usage"]["cache_hits"]) == (0, 1)
    assert first["findings"] == again["findings"] and len(first["findings"]) == 1
    assert {e["stage"] for e in seen} == {"analyze", "finalize"}


def test_refresh(spark, tmp_path):
    from tidemark.plans import indexing, ports

    root = f"file://{tmp_path}/index"
    scan = lambda rows: spark.createDataFrame([(p, len(c), 1, c) for p, c in rows.items()], "path string, size long, mtime_ms long, content string")
    one = {f"f{i}.py": f"line {i}\n" * 5 for i in range(12)} | {"same.py": "line 3\n" * 5, "s.ts": "export function f() {\n  return 1;\n}\n"}
    a = ports.HashEmbedding()
    got = indexing.refresh(spark, scan(one), root, "repo", "r1", 40, a)
    assert (got["previous"], got["files_added"], got["vectors_created"]) == ("none", 14, store.open_index(spark, root).tables["vectors"].count())
    two = {k: v for k, v in one.items() if k != "f0.py"} | {"f1.py": "changed\n", "g.py": "new\n"}
    got = indexing.refresh(spark, scan(two), root, "repo", "r2", 40, a)
    assert (got["previous"], got["files_unchanged"], got["files_modified"], got["files_added"], got["files_deleted"]) == ("reused", 12, 1, 1, 1)
    assert (got["vectors_created"], got["chunks_created"]) == (2, 2)
    opened = store.open_index(spark, root)
    assert {r.revision for r in opened.tables["chunks"].collect()} == {"r2"}
    again = indexing.refresh(spark, scan(two), root, "repo", "r3", 40, a)
    assert again["vectors_created"] == 0 and again["files_unchanged"] == 14
    numbered = indexing.context_chunks(store.open_index(spark, root))
    assert sorted(r.ordinal for r in numbered.collect()) == list(range(numbered.count()))
    files, chunks = indexing.adopt(opened.tables["files"], opened.tables["chunks"], "other", "r2")
    from tidemark.operators import reconcile

    assert reconcile.structure_issues(files, chunks, "other", "r2").count() == 0


def test_refresh_keeps_paid_vectors(spark, tmp_path):
    from tidemark.plans import indexing, ports

    root, limit = f"file://{tmp_path}/index", indexing.BATCH * indexing.SLICE_BATCHES

    class Failing(ports.HashEmbedding):
        def embed(self, texts):
            if any("line 777" in t for t in texts):
                raise ports.ProviderError("authentication")
            return super().embed(texts)

    rows = [(f"f{i}.py", 10, 1, f"line {i}\n") for i in range(limit * 3)]
    df = spark.createDataFrame(rows[:1], "path string, size long, mtime_ms long, content string")
    df = df.unionByName(spark.createDataFrame(rows[1:], df.schema))
    with pytest.raises(Exception, match="authentication"):
        indexing.refresh(spark, df.withColumn("content", F.when(F.col("path") == "f1.py", "line 777").otherwise(F.col("content"))), root, "repo", "r", 40, Failing())
    saved = indexing.saved_slices(spark, root)
    n_saved = saved.count() if saved is not None else 0
    got = indexing.refresh(spark, df, root, "repo", "r", 40, ports.HashEmbedding())
    assert got["vectors_from_checkpoint"] == n_saved
    assert got["vectors_from_checkpoint"] + got["vectors_created"] == limit * 3
    assert indexing.saved_slices(spark, root) is None


def test_settings():
    from tidemark import cli
    from tidemark.plans import review

    assert review.Config.of({}) == review.Config()
    assert review.Config.of({"max_files": "7", "threshold": "0.5", "top_k": "1000"}) == review.Config(max_files=7, threshold=0.5, top_k=1000)
    for name, value in (("max_files", "0"), ("max_files", "1.5"), ("max_files", ""), ("threshold", "nan"), ("threshold", "1.1"), ("top_k", "1001"), ("colour", "1")):
        with pytest.raises(ValueError):
            review.Config.of({name: value})
    assert cli.main(["--local", "--set", "max_files=none"]) == 64
