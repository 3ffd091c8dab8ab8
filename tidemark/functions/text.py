"""Text measures and tokens as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[a-z_$][\w$]{2,}"
MAX_PATCH_CHARS, MARKER_ROOM = 15_000, 80
TRUNCATED = "\n[TRUNCATED: patch exceeded review size limit]"


def estimate_tokens(c: Column) -> Column:
    """One token per UTF-8 byte."""
    return F.octet_length(c).cast("long")


def lexical_tokens(c: Column) -> Column:
    """Distinct lower-case identifiers of three or more characters."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0)))


def unix_lines(c: Column) -> Column:
    return F.replace(c, F.lit("\r\n"), F.lit("\n"))


def count_lines(c: Column) -> Column:
    """Lines of a text; an end-of-line at its end starts no further one, and the empty text has none."""
    t = unix_lines(F.coalesce(c, F.lit("")))
    breaks = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    return F.when(t == "", 0).otherwise(breaks + F.when(F.endswith(t, F.lit("\n")), 0).otherwise(1)).cast("long")


def truncate_patch(c: Column) -> Column:
    return F.when(F.length(c) <= MAX_PATCH_CHARS, c).otherwise(F.concat(F.substring(c, 1, MAX_PATCH_CHARS - MARKER_ROOM), F.lit(TRUNCATED)))


def normal_title(c: Column) -> Column:
    """Lower case, and every run of other than word characters one space."""
    return F.btrim(F.regexp_replace(F.lower(c), r"\W+", " "))


def slashes(c: Column) -> Column:
    return F.replace(c, F.lit("\\"), F.lit("/"))


def basename(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def extension(path: Column) -> Column:
    """The lower-case extension of the last component, with its dot; empty without one."""
    return F.lower(F.regexp_extract(basename(path), r"(\.[^.]*)$", 1))


def language(path: Column) -> Column:
    e = F.when(F.length(F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1)) > 0, extension(path)).otherwise(F.lit(""))
    return F.when(e.isin(".ts", ".tsx"), "typescript").when(e.isin(".js", ".jsx", ".mjs", ".cjs"), "javascript").otherwise("fallback")


def synthetic_add_patch(name: Column, content: Column) -> Column:
    """A new file's unified diff: one hunk of added lines."""
    t = unix_lines(F.coalesce(content, F.lit("")))
    bare = F.when(F.endswith(t, F.lit("\n")), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t)
    plus = F.when(bare == "", F.lit("")).otherwise(F.concat(F.lit("\n+"), F.replace(bare, F.lit("\n"), F.lit("\n+"))))
    head = F.concat(F.lit("diff --git a/"), name, F.lit(" b/"), name, F.lit("\nnew file mode 100644\n--- /dev/null\n+++ b/"), name, F.lit("\n@@ -0,0 +1,"), count_lines(content).cast("string"), F.lit(" @@"))
    return F.concat(head, plus)
