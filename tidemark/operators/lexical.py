"""Lexical retrieval: an inverted index and ranked candidates, for many queries in one plan.

chunks: (ordinal, path, content[, name, signature, imports]). queries: (query_id, query, changed_path).

Queries whose terms are few enough to broadcast meet the chunks where these are read: each task scores its chunks
against all queries and passes on the best `limit` of each query only, so what is shuffled does not grow with
queries times chunks. More queries are joined with the postings. Both give the same rows. A score is min(1, share of the query's terms + 0.2 for an import link + 0.35 for a symbol match + 0.05 for
the same file); ties keep the chunks' order."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators.sizes import BROADCAST_ROWS, few, small

#: Characters of a needle's end that are looked up among the parts of a path.
ANCHOR = 16
#: Chunks that a task scores at once.
SLICE_ROWS = 500
IMPORT_LINK, SYMBOL_MATCH, SAME_FILE = 0.2, 0.35, 0.05


def _or_empty(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def indexed_text(chunks: DataFrame) -> Column:
    """What of a chunk is searched: path, name, signature, imports and content."""
    name, sig, imports = _or_empty(chunks, "name"), _or_empty(chunks, "signature"), _or_empty(chunks, "imports", "array<string>")
    return F.concat(F.col("path"), F.lit(" "), F.coalesce(name, F.lit("")), F.lit(" "), F.coalesce(sig, F.lit("")), F.lit(" "), F.coalesce(F.array_join(imports, " "), F.lit("")), F.lit(" "), F.coalesce(F.col("content"), F.lit("")))


def postings(chunks: DataFrame) -> DataFrame:
    """(term, ordinal), one row per distinct term of a chunk."""
    return chunks.select(F.explode(T.lexical_tokens(indexed_text(chunks))).alias("term"), "ordinal")


def symbols(chunks: DataFrame) -> DataFrame:
    return chunks.where(_or_empty(chunks, "name") != "").select(F.lower(_or_empty(chunks, "name")).alias("term"), "ordinal")


def import_needles(chunks: DataFrame) -> DataFrame:
    """(needle, ordinal): distinct imports of a chunk without a leading ./"""
    needles = F.array_distinct(F.transform(_or_empty(chunks, "imports", "array<string>"), lambda x: F.regexp_replace(x, r"^\./", "")))
    return chunks.select(F.explode(needles).alias("needle"), "ordinal")


def posting_lists(chunks: DataFrame) -> DataFrame:
    """(term, ordinals): the inverted index in nested form."""
    return postings(chunks).groupBy("term").agg(F.array_sort(F.collect_list("ordinal")).alias("ordinals"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, n_terms)"""
    t = queries.select("query_id", T.lexical_tokens(F.col("query")).alias("terms"))
    return t.select("query_id", F.explode("terms").alias("term"), F.size("terms").alias("n_terms"))


def import_links(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """(needle, query_id): the needles that a query's changed path contains. The end of a needle is looked up by
    equality among the parts, of ANCHOR characters at most, of the distinct paths; what meets is compared whole."""
    paths = queries.select("changed_path").where("changed_path is not null").distinct()
    n = F.length("changed_path")
    parts = F.flatten(F.transform(F.sequence(F.lit(0), F.least(F.lit(ANCHOR), n)), lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substr("changed_path", i, k))))
    paths = paths.select("changed_path", F.explode(F.array_distinct(parts)).alias("anchor"))
    needles = import_needles(chunks).select("needle").where("needle is not null").distinct().withColumn("anchor", F.expr(f"right(needle, {ANCHOR})"))
    met = needles.join(paths, "anchor").where(F.contains("changed_path", "needle")).select("needle", "changed_path")
    return met.join(queries.select("query_id", "changed_path"), "changed_path").select("needle", "query_id")


def hits(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, ordinal, overlap, import_linked, symbol_matched, same_file) of every chunk that some list of the
    query's leads to. A hit is counted where its chunk is read: query terms travel to the postings."""
    terms = small(query_terms(queries).select("query_id", "term"))
    flags = lambda o, i, s, p: (F.lit(o).alias("o"), F.lit(i).alias("i"), F.lit(s).alias("s"), F.lit(p).alias("p"))
    found = [postings(chunks).join(terms, "term").select("query_id", "ordinal", *flags(1, 0, 0, 0))]
    if "name" in chunks.columns:
        found.append(symbols(chunks).join(terms, "term").select("query_id", "ordinal", *flags(0, 0, 1, 0)))
    paths = small(queries.select("query_id", F.col("changed_path").alias("path")))
    found.append(chunks.select("path", "ordinal").join(paths, "path").select("query_id", "ordinal", *flags(0, 0, 0, 1)))
    if "imports" in chunks.columns:
        linked = import_links(chunks, queries)
        found.append(import_needles(chunks).join(linked, "needle").select("query_id", "ordinal", *flags(0, 1, 0, 0)))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    as_flag = lambda c: (F.max(c) == 1)
    return out.groupBy("query_id", "ordinal").agg(F.sum("o").alias("overlap"), as_flag("i").alias("import_linked"), as_flag("s").alias("symbol_matched"), as_flag("p").alias("same_file"))


def score(n_terms: Column) -> Column:
    share = F.when(n_terms > 0, F.col("overlap") / n_terms).otherwise(0.0)
    add = lambda flag, x: F.when(F.col(flag), F.lit(x)).otherwise(F.lit(0.0))
    return F.least(F.lit(1.0), share + add("import_linked", IMPORT_LINK) + add("symbol_matched", SYMBOL_MATCH) + add("same_file", SAME_FILE))


def reasons() -> Column:
    """Why a chunk was found, in a fixed order."""
    return F.array_compact(F.array(F.when(F.col("overlap") > 0, F.concat(F.lit("keyword-overlap:"), F.col("overlap").cast("string"))), F.when(F.col("import_linked"), "import-link"), F.when(F.col("symbol_matched"), "symbol-match"), F.when(F.col("same_file"), "same-file")))


class Index:
    """Queries by what finds them: term, changed path and linked needle, each as (values, offsets, query numbers)."""

    def __init__(self, ids: list[int], n_terms: list[int], terms: list[tuple[str, int]], paths: list[tuple[str, int]], links: list[tuple[str, int]]) -> None:
        self.ids, self.n_terms = np.array(ids, np.int64), np.array(n_terms, np.float64)
        self.terms, self.paths, self.links = (self._by_value(x) for x in (terms, paths, links))

    @staticmethod
    def _by_value(pairs: list[tuple[str, int]]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        by = defaultdict(list)
        for value, q in pairs:
            by[value].append(q)
        n = [len(x) for x in by.values()]
        return pa.array(list(by), pa.string()), np.concatenate(([0], np.cumsum(n, dtype=np.int64))), np.array([q for x in by.values() for q in x], np.int64)

    def found(self, where: tuple, values: pa.Array, rows: np.ndarray) -> np.ndarray:
        """row * queries + query of every query that a row's value leads to."""
        known, offsets, queries = where
        if not len(known):
            return np.zeros(0, np.int64)
        at = pc.fill_null(pc.index_in(values, value_set=known), -1).to_numpy(zero_copy_only=False)
        hit = np.flatnonzero(at >= 0)
        at, rows = at[hit], rows[hit]
        n = offsets[at + 1] - offsets[at]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(offsets[at], n)
        return np.repeat(rows, n) * len(self.ids) + queries[place]

    def score(self, b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """(query number, ordinal, score, overlap, import_linked, symbol_matched, same_file) of the hits of some chunks."""

        def lists(name: str) -> tuple[pa.Array, np.ndarray]:
            c = b.column(name)
            return c.flatten(), np.repeat(np.arange(len(c)), pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False))

        every = np.arange(b.num_rows)
        terms, counts = np.unique(self.found(self.terms, *lists("terms")), return_counts=True)
        link = np.unique(self.found(self.links, *lists("needles")))
        symbol = np.unique(self.found(self.terms, b.column("symbol"), every))
        same = np.unique(self.found(self.paths, b.column("path"), every))
        pairs = np.unique(np.concatenate((terms, link, symbol, same)))
        overlap = np.zeros(len(pairs), np.int64)
        overlap[np.searchsorted(pairs, terms)] = counts
        link, symbol, same = (np.isin(pairs, x, assume_unique=True) for x in (link, symbol, same))
        row, q = np.divmod(pairs, max(1, len(self.ids)))
        share = np.divide(overlap, self.n_terms[q], out=np.zeros(len(q)), where=self.n_terms[q] > 0)
        score = np.minimum(1.0, share + np.where(link, IMPORT_LINK, 0.0) + np.where(symbol, SYMBOL_MATCH, 0.0) + np.where(same, SAME_FILE, 0.0))
        return q, b.column("ordinal").to_numpy()[row], score, overlap, link, symbol, same


def _best_of_task(shared, limit: int):
    names = ("query_id", "ordinal", "score", "overlap", "import_linked", "symbol_matched", "same_file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(*shared.value)
        held = None
        for b in batches:
            for k in range(0, b.num_rows, SLICE_ROWS):
                got = index.score(b.slice(k, SLICE_ROWS))
                held = got if held is None else tuple(np.concatenate(x) for x in zip(held, got, strict=True))
                order = np.lexsort((held[1], -held[2], held[0]))
                q = held[0][order]
                first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else q
                place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
                held = tuple(x[order[place < limit]] for x in held)
        if held is not None and len(held[0]):
            yield pa.RecordBatch.from_arrays([pa.array(index.ids[held[0]]), *map(pa.array, held[1:])], names)

    return run


def best_hits(chunks: DataFrame, queries: DataFrame, limit: int) -> DataFrame | None:
    """(query_id, ordinal, score, overlap, import_linked, symbol_matched, same_file): of each task's chunks the best
    `limit` hits of each query; None if the queries' terms, paths and links are too many to broadcast."""
    slim = queries.select(F.col("query_id").cast("long"), T.lexical_tokens(F.col("query")).alias("terms"), "changed_path")
    if query_terms(queries).limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS or (rows := few(slim, BROADCAST_ROWS)) is None:
        return None
    number = {r.query_id: k for k, r in enumerate(rows)}
    links = few(import_links(chunks, queries.withColumn("query_id", F.col("query_id").cast("long"))), BROADCAST_ROWS) if "imports" in chunks.columns else []
    if links is None or len(number) < len(rows):
        return None
    terms = [(t, k) for k, r in enumerate(rows) for t in r.terms or ()]
    paths = [(r.changed_path, k) for k, r in enumerate(rows) if r.changed_path is not None]
    parts = (list(number), [len(r.terms or ()) for r in rows], terms, paths, [(x.needle, number[x.query_id]) for x in links])
    shared = chunks.sparkSession.sparkContext.broadcast(parts)
    needles = F.array_distinct(F.transform(_or_empty(chunks, "imports", "array<string>"), lambda x: F.regexp_replace(x, r"^\./", "")))
    name = _or_empty(chunks, "name")
    c = chunks.select(F.col("ordinal").cast("long").alias("ordinal"), T.lexical_tokens(indexed_text(chunks)).alias("terms"), F.when(name != "", F.lower(name)).alias("symbol"), F.col("path"), needles.alias("needles"))
    out = c.mapInArrow(_best_of_task(shared, limit), "query_id long, ordinal long, score double, overlap long, import_linked boolean, symbol_matched boolean, same_file boolean")
    return out.select(F.col("query_id").cast(queries.schema["query_id"].dataType), F.col("ordinal").cast(chunks.schema["ordinal"].dataType), *out.columns[2:])


def rank_candidates(chunks: DataFrame, queries: DataFrame, limit: int, fill: bool = True) -> DataFrame:
    """(query_id, rank from 1, ordinal, score, reasons): the best `limit` chunks of each query. fill: a query with
    fewer hits is filled up with the first chunks that were not hit, at score 0."""
    scored = best_hits(chunks, queries, limit)
    if scored is None:
        n = query_terms(queries).select("query_id", "n_terms").distinct()
        scored = hits(chunks, queries).join(n, "query_id", "left").withColumn("score", score(F.coalesce("n_terms", F.lit(0))))
    found = scored.select("query_id", "ordinal", "score", reasons().alias("reasons"), F.lit(1).alias("hit"))
    best = Window.partitionBy("query_id").orderBy(F.desc("hit"), F.desc("score"), "ordinal")
    if fill:
        # limit chunks in order are enough: those of them that were hit leave room for as many others
        first = [r.ordinal for r in chunks.select("ordinal").orderBy("ordinal").limit(max(0, limit)).collect()]
        # a query that has lost hits to `limit` has no place to fill
        rest = queries.select("query_id", F.explode(F.array(*map(F.lit, first)).cast("array<long>")).alias("ordinal")).join(found.select("query_id", "ordinal"), ["query_id", "ordinal"], "left_anti")
        found = found.unionByName(rest.select("query_id", "ordinal", F.lit(0.0).alias("score"), F.array().cast("array<string>").alias("reasons"), F.lit(0).alias("hit")))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit).drop("hit")
