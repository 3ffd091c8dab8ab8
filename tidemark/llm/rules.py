"""Quality rules: a threshold table compiled into Spark projections, without user functions.

`measured` adds the counts as columns; THRESHOLDS names ratios of them with the least and greatest
value a document may have, some of them only for documents they can be read of (stop words are of languages in Latin
script, so the rule on them is for texts of at most 1.5 bytes a character, as other scripts take about 2 or 3); `apply_rules` compiles the table into one boolean and the list of the
rules that failed. Everything is a row-wise projection over the whole text: no shuffle at all.

Words that repeat: the hashes of the 3-word windows are sorted with their positions, a window equal
to a neighbour in that order is a repeat, and positions in ascending order give the words covered.
O(n log n) in the words of one text. The 64-bit hash stands for the window.

Defined results. Very long texts are measured whole. Null or empty text: no words, so the base check fails and the row is not kept.
Null ids, repeated rows and ties: judged each by its own text. Empty table: empty result. Other
columns pass through; those named like a measure are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common as C

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Frequent function words of English, German, French and Spanish (fixed values).
STOP_WORDS = (
    "the of and to in a is that it for on was as with be by are this at an from or not have "
    "der die das und den von zu mit sich auf für ist im nicht ein eine dem des als auch "
    "de la le les et un une en que qui pour dans est par sur au du des avec pas ce il "
    "el los las y se del una por con no su para es al lo como más"
).split()


@dataclass(frozen=True)
class Threshold:
    """A document passes if low <= numerator / denominator <= high; a zero denominator counts as 1."""

    name: str
    numerator: str
    denominator: str
    low: float | None = None
    high: float | None = None
    #: (numerator, denominator, least ratio): where it is less, the document passes.
    only_if: tuple[str, str, float] | None = None


THRESHOLDS = (
    Threshold("mean_word_length", "word_chars", "n_words", 2.0, 20.0),
    Threshold("symbols_per_word", "n_symbols", "n_words", None, 0.2),
    Threshold("exclamations_per_word", "n_exclamations", "n_words", None, 0.3),
    Threshold("stop_words_per_word", "n_stop_words", "n_words", 0.02, None, ("n_text_chars", "n_text_bytes", 2 / 3)),
    Threshold("duplicate_lines", "n_dup_lines", "n_text_lines", None, 0.5),
)
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURES = (*BASE, "n_exclamations", "n_stop_words", "n_text_lines", "n_text_chars", "n_text_bytes")


def _count_chars(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, f"[{chars}]+", ""))


def _repeat_words(windows: Column) -> Column:
    """windows: a column, sorted array of (h, i); a column, not an expression, so that it is computed once."""
    again = F.filter(windows, lambda x, j: (x["h"] == F.get(windows, j - 1)["h"]) | (x["h"] == F.get(windows, j + 1)["h"]))
    at = F.sort_array(F.transform(again, lambda x: x["i"]))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("total"))
    return F.aggregate(at, start, lambda acc, i: F.struct(i.alias("last"), (acc["total"] + F.least(F.lit(3), i - acc["last"])).alias("total")), lambda acc: acc["total"])


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with MEASURES (long) added."""
    ws = C.WS_CLASS
    d = docs.drop(*MEASURES).withColumn("__t", F.coalesce(F.col(text).cast("string"), F.lit("")))
    d = d.withColumn("__b", F.btrim("__t", F.lit(C.WS)))
    d = d.withColumn("__w", F.when(F.col("__b") == "", F.array().cast("array<string>")).otherwise(F.split("__b", f"{ws}+")))
    d = d.withColumn("__n", F.size("__w"))
    w, n = F.col("__w"), F.col("__n")
    window = lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))
    d = d.withColumn("__g", F.when(n >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), window))))
    d = d.withColumn("__l", F.filter(F.split("__t", "\n"), lambda x: F.btrim(x, F.lit(C.WS)) != ""))
    out = {
        "n_words": n,
        "word_chars": F.length(F.array_join(w, "")),
        "n_symbols": _count_chars(F.col("__t"), "#*$%&|<>"),
        "n_dup_lines": F.size("__l") - F.size(F.array_distinct("__l")),
        "n_repeat_words": F.coalesce(_repeat_words(F.col("__g")), F.lit(0)),
        "n_exclamations": _count_chars(F.col("__t"), "!"),
        "n_stop_words": F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))),
        "n_text_lines": F.size("__l"),
        "n_text_chars": F.length("__t"),
        "n_text_bytes": F.octet_length("__t"),
    }
    # inline() of one row: a filter on a measure stays above it. Pushed below, it would put the arrays'
    # expressions where each element computes them again
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in MEASURES]
    return d.select(*kept, F.inline(F.array(F.struct(*[v.cast("long").alias(k) for k, v in out.items()]))))


def _ratio(numerator: str, denominator: str) -> Column:
    return F.col(numerator) / F.greatest(F.col(denominator), F.lit(1))


def apply_rules(docs: DataFrame, table: tuple[Threshold, ...] = THRESHOLDS, text: str = "text") -> DataFrame:
    """docs with MEASURES, base_failed, failed_rules array<string> and kept added."""
    d = measured(docs.drop("base_failed", "failed_rules", "kept"), text)
    broken = []
    for t in table:
        bad = F.lit(False)
        ratio = _ratio(t.numerator, t.denominator)
        bad = bad if t.low is None else bad | (ratio < t.low)
        bad = bad if t.high is None else bad | (ratio > t.high)
        bad = bad if t.only_if is None else bad & (_ratio(*t.only_if[:2]) >= t.only_if[2])
        broken.append(F.when(bad, F.lit(t.name)))
    d = d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    d = d.withColumn("failed_rules", F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>"))
    return d.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = apply_rules(C.read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *BASE, "base_failed", "kept")


def _sql(table: tuple[Threshold, ...]) -> str:
    """The same table over the same measures, for DuckDB."""
    tests = []
    for t in table:
        ratio = lambda a, b: f"{a}::DOUBLE / greatest({b}, 1)"
        r = ratio(t.numerator, t.denominator)
        own = [f"{r} >= {t.low}"] * (t.low is not None) + [f"{r} <= {t.high}"] * (t.high is not None)
        tests += own if t.only_if is None else [f"({ratio(*t.only_if[:2])} < {t.only_if[2]} OR ({' AND '.join(own)}))"]
    stops = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
gg AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS c FROM g),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM gg WHERE c > 1) GROUP BY r),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
  coalesce(rep.n, 0)::BIGINT AS n_repeat_words, length(t) - length(replace(t, '!', '')) AS n_exclamations,
  len(list_filter(w, lambda x: lower(x) IN ({stops}))) AS n_stop_words, len(l) AS n_text_lines,
  length(t) AS n_text_chars, strlen(t) AS n_text_bytes FROM w LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {" AND ".join(tests) or "true"} AS kept FROM b
"""


SQL = _sql(THRESHOLDS)
