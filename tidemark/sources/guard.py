"""Driver-side guards of paths: containment, links, regular files, sensitive names."""

from __future__ import annotations

import os
import stat

from tidemark.functions import policy as P


def inspect_regular_file(root: str, name: str) -> tuple[int, float]:
    """(size, mtime in ms) of a regular file inside root; raises ValueError otherwise."""
    top = os.path.realpath(root)
    path = os.path.normpath(os.path.join(top, name))
    if os.path.commonpath([top, path]) != top:
        raise ValueError(f"Path escapes repository root: {name}")
    s = os.lstat(path)
    if stat.S_ISLNK(s.st_mode):
        raise ValueError(f"Symlink is not eligible for review: {name}")
    if os.path.commonpath([top, os.path.realpath(path)]) != top:
        raise ValueError(f"Resolved path escapes repository root: {name}")
    if not stat.S_ISREG(s.st_mode):
        raise ValueError(f"Not a regular file: {name}")
    return s.st_size, s.st_mtime * 1000


def is_sensitive(path: str) -> bool:
    p = path.replace("\\", "/").removeprefix("./").lower()
    parts = [x for x in p.split("/") if x]
    base = p.split("/")[-1]
    pairs = set(zip(parts, parts[1:], strict=False))
    return base.startswith(".env") or base in P.SENSITIVE_NAMES or base.endswith(P.SENSITIVE_SUFFIXES) or bool(set(parts) & set(P.SENSITIVE_FOLDERS)) or bool(pairs & set(P.SENSITIVE_PAIRS))


def cache_dir(root: str, base: str, label: str) -> str:
    """A cache folder of one checkout, outside it."""
    import hashlib

    out = os.path.join(base, hashlib.sha256(f"{os.path.realpath(root)}\0{label}".encode()).hexdigest()[:32])
    top = os.path.realpath(root)
    if os.path.commonpath([top, os.path.realpath(out)]) == top:
        raise ValueError("The cache must be outside the repository")
    return out
