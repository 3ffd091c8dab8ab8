"""Findings: validation of cited evidence, identities, deduplication and report order.

findings: (filename, seg_no, pos, severity, category, confidence, title, explanation, suggestion, evidence array of
struct(path, start_line, end_line, context_id)). One bad citation drops its finding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from tidemark.functions import keys as K
from tidemark.functions import text as T

FINDING_KEY = ["filename", "seg_no", "pos"]
RESPONSE = "struct<findings:array<struct<severity:string,category:string,confidence:string,title:string,explanation:string,evidence:array<struct<path:string,startLine:long,endLine:long,contextId:string>>,suggestion:string>>,summary:string,abstained:boolean,abstentionReason:string>"
MAX_FINDINGS, MAX_EVIDENCE = 25, 5


def from_responses(responses: DataFrame) -> DataFrame:
    """Findings of responses(filename, seg_no, response JSON text). A response that does not parse, or is over the
    bounds, has none; `bad_responses` names it."""
    d = responses.withColumn("r", F.from_json("response", RESPONSE)).where(_sound(F.col("r")))
    d = d.select("filename", "seg_no", F.posexplode("r.findings").alias("pos", "f"))
    ev = F.transform("f.evidence", lambda e: F.struct(e["path"].alias("path"), e["startLine"].alias("start_line"), e["endLine"].alias("end_line"), e["contextId"].alias("context_id")))
    return d.select(*FINDING_KEY, *[f"f.{c}" for c in ("severity", "category", "confidence", "title", "explanation", "suggestion")], ev.alias("evidence"))


def bad_responses(responses: DataFrame) -> DataFrame:
    return responses.where(~_sound(F.from_json("response", RESPONSE))).select("filename", "seg_no")


#: Fixed vocabulary of categories.
CATEGORIES = ("correctness", "security", "performance", "type-safety", "error-handling", "maintainability")


def _sound(r: Column) -> Column:
    """Whether a parsed response keeps the schema's bounds; an abstention has no findings."""
    text = lambda c, most: F.length(c).between(1, most)
    cited = lambda e: F.length(e["path"]).between(1, 4096) & (e["startLine"] > 0) & (e["endLine"] >= e["startLine"])
    finding = lambda f: (
        f["severity"].isin("low", "medium", "high") & f["confidence"].isin("low", "medium", "high") & f["category"].isin(*CATEGORIES)
        & text(f["title"], 200) & text(f["explanation"], 2000) & F.coalesce(F.length(f["suggestion"]) <= 2000, F.lit(True))
        & F.size(f["evidence"]).between(1, MAX_EVIDENCE) & F.forall(f["evidence"], cited)
    )
    ok = r["findings"].isNotNull() & (F.size(r["findings"]) <= MAX_FINDINGS) & F.forall(r["findings"], finding) & r["abstained"].isNotNull()
    return F.coalesce(ok & (~r["abstained"] | (F.size(r["findings"]) == 0)), F.lit(False))


def citations(findings: DataFrame) -> DataFrame:
    return findings.select(*FINDING_KEY, F.posexplode("evidence").alias("ev_no", "e")).select(*FINDING_KEY, "ev_no", "e.*")


def valid_findings(findings: DataFrame, changed_ranges: DataFrame, contexts: DataFrame) -> DataFrame:
    """findings all of whose citations hold. changed_ranges: (filename, seg_no, start, end), maximal runs of complete added
    lines of a segment; contexts: (filename, seg_no, id, path, start_line, end_line, content_complete), as supplied."""
    c = citations(findings)
    given = contexts.select("filename", "seg_no", F.col("id").alias("context_id"), F.col("path").alias("c_path"), F.col("start_line").alias("c_start"), F.col("end_line").alias("c_end"), "content_complete").dropDuplicates(["filename", "seg_no", "context_id"])
    j = c.where(F.coalesce("context_id", F.lit("")) != "").join(given, ["filename", "seg_no", "context_id"], "left")
    in_context = F.coalesce(F.col("content_complete") & (F.col("c_path") == F.col("path")) & (F.col("start_line") >= F.col("c_start")) & (F.col("end_line") <= F.col("c_end")), F.lit(False))
    a = j.select(*FINDING_KEY, in_context.alias("ok"))
    own = c.where(F.coalesce("context_id", F.lit("")) == "")
    # a range lies in changed lines only if it lies in one maximal run of them
    k = own.join(changed_ranges, ["filename", "seg_no"], "left")
    inside = F.coalesce((F.col("path") == F.col("filename")) & (F.col("start_line") > 0) & (F.col("end_line") >= F.col("start_line")) & (F.col("start_line") >= F.col("start")) & (F.col("end_line") <= F.col("end")), F.lit(False))
    b = k.withColumn("ok", inside).groupBy(*FINDING_KEY, "ev_no").agg(F.bool_or("ok").alias("ok")).select(*FINDING_KEY, "ok")
    bad = a.unionByName(b).where(~F.col("ok")).select(*FINDING_KEY).distinct()
    return findings.join(bad, FINDING_KEY, "left_anti")


def spans(evidence: Column) -> Column:
    return F.transform(evidence, lambda e: F.concat_ws(":", e["path"], e["start_line"].cast("string"), e["end_line"].cast("string")))


def identified(findings: DataFrame, segment_id: Column | None = None) -> DataFrame:
    """findings with id, and an excerpt_hash on each citation; segment_id names the segment where no context is cited."""
    seg = segment_id if segment_id is not None else F.lit("")
    ev = F.transform("evidence", lambda e: F.struct(e["path"].alias("path"), e["start_line"].alias("start_line"), e["end_line"].alias("end_line"), e["context_id"].alias("context_id"), K.excerpt_hash(e["path"], e["start_line"], e["end_line"], F.coalesce(e["context_id"], seg)).alias("excerpt_hash")))
    return findings.withColumn("id", K.finding_id(F.col("filename"), F.col("category"), F.col("title"), spans(F.col("evidence")))).withColumn("evidence", ev)


def deduplicate(findings: DataFrame, order: list[str]) -> DataFrame:
    """The first, in `order`, of the findings with the same file, category, normal title and places."""
    key = F.concat_ws("|", "filename", "category", T.normal_title(F.col("title")), F.array_join(spans(F.col("evidence")), ","))
    w = Window.partitionBy("__key").orderBy(*order)
    return findings.withColumn("__key", F.sha2(key.cast("binary"), 256)).withColumn("__nth", F.row_number().over(w)).where("__nth = 1").drop("__key", "__nth")


def report_order() -> list[Column]:
    first = lambda c: F.coalesce(F.get(F.col("evidence"), F.lit(0))[c], F.lit(0))
    return [F.col("filename"), first("start_line"), first("end_line"), F.col("id")]


EVIDENCE_TYPE = ST.ArrayType(ST.StructType([ST.StructField("path", ST.StringType()), ST.StructField("start_line", ST.LongType()), ST.StructField("end_line", ST.LongType()), ST.StructField("context_id", ST.StringType())]))
