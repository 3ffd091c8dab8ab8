"""Privacy, ignore and file-type policy as column expressions.

Word boundaries are ASCII look-arounds: in Java, \\b also sees letters beyond ASCII."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import text as T

# Fixed values of the policy.
SENSITIVE_NAMES = (".env", ".npmrc", ".pypirc", "credentials", "credentials.json", "service-account.json", "id_rsa", "id_dsa", "id_ecdsa", "id_ed25519", "secrets.yml", "secrets.yaml", "terraform.tfstate", ".netrc", "auth.json", "secret.json", "secrets.json")
SENSITIVE_SUFFIXES = (".pem", ".key", ".p12", ".pfx", ".jks", ".keystore")
SENSITIVE_FOLDERS = (".ssh", ".gnupg")
SENSITIVE_PAIRS = ((".aws", "credentials"), (".kube", "config"))
GENERATED_FOLDERS = ("node_modules", "bower_components", "vendor", "dist", "build", ".next", "coverage")
LOCKFILES = ("package-lock.json", "pnpm-lock.yaml", "yarn.lock")
TEST_MARKS = (".test.", ".spec.", "__tests__/", "/test/", "/tests/")
CONFIG_NAMES = ("tsconfig.json", "package.json", "eslint.config.js", ".eslintrc", "vite.config.ts", "vitest.config.ts", "jest.config.js", "next.config.js", "docker-compose.yml", "Dockerfile")
CONFIG_EXTENSIONS = (".json", ".yml", ".yaml", ".toml", ".ini", ".env")
DOC_EXTENSIONS = (".md", ".mdx", ".txt", ".rst", ".adoc")
BINARY_EXTENSIONS = (".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg", ".pdf", ".zip", ".gz", ".mp4", ".mp3")
SOURCE_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py", ".rb", ".go", ".rs", ".java", ".kt", ".swift", ".cs", ".cpp", ".cc", ".c", ".h", ".hpp", ".php")
REVIEWABLE = ("source", "test", "config")
MAX_FILE_BYTES = 1 << 20
_LEFT, _RIGHT = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
#: (name, pattern), in the order in which they are tried.
SECRETS = (
    ("private key", r"(?i)-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----"),
    ("AWS access key", rf"{_LEFT}AKIA[0-9A-Z]{{16}}{_RIGHT}"),
    ("GitHub token", rf"{_LEFT}gh[pousr]_[A-Za-z0-9_]{{20,}}{_RIGHT}"),
    ("generic credential assignment", _LEFT + r"""(?i)(?:api[_-]?key|secret|password|token)\s*[:=]\s*["']?[A-Za-z0-9_\-/.+=]{16,}"""),
)


def _parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def is_sensitive_path(path: Column) -> Column:
    p = F.lower(F.regexp_replace(T.slashes(path), r"^\./", ""))
    base = T.basename(p)
    out = F.startswith(base, F.lit(".env")) | base.isin(*SENSITIVE_NAMES)
    for s in SENSITIVE_SUFFIXES:
        out |= F.endswith(base, F.lit(s))
    parts = _parts(p)
    out |= F.arrays_overlap(parts, F.array(*map(F.lit, SENSITIVE_FOLDERS)))
    joined = F.concat(F.lit("/"), F.array_join(parts, "/"), F.lit("/"))
    for a, b in SENSITIVE_PAIRS:
        out |= F.contains(joined, F.lit(f"/{a}/{b}/"))
    return out


def sensitive_content(c: Column) -> Column:
    """The first pattern that a text matches, else null."""
    out = None
    for name, pattern in SECRETS:
        out = (F if out is None else out).when(F.rlike(c, F.lit(pattern)), name)
    return out


def redact(c: Column) -> Column:
    for name, pattern in SECRETS:
        c = F.regexp_replace(c, pattern, f"[REDACTED:{name}]")
    return c


def is_generated(path: Column) -> Column:
    parts = _parts(F.lower(T.slashes(path)))
    folders = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    name = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    return F.arrays_overlap(folders, F.array(*map(F.lit, GENERATED_FOLDERS))) | F.rlike(name, F.lit(r"(?i)\.min\.[cm]?js$"))


def classify(path: Column) -> Column:
    """The type of a file: the first rule that its path fits."""
    p = T.slashes(path)
    base, ext = T.basename(p), T.extension(p)
    any_of = lambda test, values: reduce(or_, (test(p, F.lit(v)) for v in values))
    return (
        F.when(any_of(F.endswith, LOCKFILES), "lockfile")
        .when(is_generated(p) | F.rlike(base, F.lit(r"(?i)\.snap$")), "generated")
        .when(any_of(F.contains, TEST_MARKS), "test")
        .when(base.isin(*CONFIG_NAMES) | ext.isin(*CONFIG_EXTENSIONS), "config")
        .when(ext.isin(*DOC_EXTENSIONS), "docs")
        .when(ext.isin(*BINARY_EXTENSIONS), "binary")
        .when(ext.isin(*SOURCE_EXTENSIONS), "source")
        .otherwise("unknown")
    )


def is_reviewable(kind: Column) -> Column:
    return kind.isin(*REVIEWABLE)


def is_indexable(path: Column) -> Column:
    return F.rlike(path, F.lit(r"(?i)\.(?:[cm]?[jt]sx?|py|rb|go|rs|java|kt|swift|cs|cpp|cc|c|h|hpp|php)$"))


def is_probably_binary(content: Column) -> Column:
    """A NUL, or more than a tenth of the bytes control bytes other than tab, feeds and return."""
    h = F.hex(content)
    # pairs of hex digits, aligned, with a separator before each
    pairs = F.regexp_replace(h, "(..)", ",$1")
    odd = F.regexp_count(pairs, F.lit(",(?:0[0-8BEF]|1[0-9A-F])"))
    n = F.octet_length(content)
    return F.coalesce((n > 0) & (F.contains(pairs, F.lit(",00")) | (odd > n * 0.1)), F.lit(False))


def privacy(filename: Column, previous: Column, patch: Column) -> Column:
    """struct(reason, details) of the first refusal, else null."""
    found = sensitive_content(patch)
    why = lambda reason, details: F.struct(F.lit(reason).alias("reason"), details.alias("details"))
    return (
        F.when(is_sensitive_path(filename), why("sensitive_path", F.lit("a path that may hold secrets; no ignore rule can let it in")))
        .when(F.coalesce(is_sensitive_path(previous), F.lit(False)), why("sensitive_path", F.lit("came from a path that may hold secrets; no ignore rule can let it in")))
        .when(found.isNotNull(), why("sensitive_content", F.concat(F.lit("the diff looks like a secret: "), found)))
    )
