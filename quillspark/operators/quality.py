"""Deterministic review of report sections: citations, numbers, claims, style, and the gates over their counts.

Sections are rows (section_id, content_markdown); packs are rows of facts: ``pages`` (section_id, source_id, page),
``numbers`` (section_id, value) and ``statements`` (section_id, statement). Claims are rows (section_id, statement, claim_type,
verification_status), as ``report.claims`` finds them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import shared_dir
from .joins import jaccard_pairs
from .ordering import first_per_key

MAX_REVISIONS = 3
# What to do about an issue, by its type.
ADVICE = {
    "CITATION_MISMATCH": "Pack에 있는 source/page로 인용을 고치거나 해당 문장을 삭제",
    "UNSUPPORTED_CLAIM": "Evidence Pack 근거를 붙이거나 주장을 삭제/약화",
    "NUMERIC_MISMATCH": "Evidence Pack 수치만 사용하거나 해당 문장 삭제",
    "PROMOTIONAL_LANGUAGE": "객관적 서술로 재작성",
    "DUPLICATE_PARAGRAPH": "중복 문단 통합",
}
ANALYSIS_MARK = "【분석】"
#: Allowed stage moves, fixed values. Work can pause or fail at any stage, but for an exported project.
TRANSITIONS = {
    "CREATED": ("INGESTING", "FAILED"),
    "INGESTING": ("ANALYZING", "PAUSED", "FAILED"),
    "ANALYZING": ("PLANNING", "PAUSED", "FAILED"),
    "PLANNING": ("WAITING_FOR_OUTLINE_APPROVAL", "PAUSED", "FAILED"),
    "WAITING_FOR_OUTLINE_APPROVAL": ("PRODUCING", "PLANNING", "PAUSED", "FAILED"),
    "PRODUCING": ("REVIEWING", "PAUSED", "FAILED"),
    "REVIEWING": ("REVISING", "FINALIZING", "PRODUCING", "PAUSED", "FAILED"),
    "REVISING": ("REVIEWING", "PAUSED", "FAILED"),
    "FINALIZING": ("READY_FOR_EXPORT", "PAUSED", "FAILED"),
    "READY_FOR_EXPORT": ("EXPORTED", "PRODUCING", "INGESTING", "PAUSED", "FAILED"),
    "EXPORTED": ("INGESTING", "ANALYZING", "PRODUCING"),
    "PAUSED": (
        "INGESTING", "ANALYZING", "PLANNING", "WAITING_FOR_OUTLINE_APPROVAL", "PRODUCING", "REVIEWING", "REVISING",
        "FINALIZING", "READY_FOR_EXPORT", "FAILED",
    ),
    "FAILED": ("INGESTING", "ANALYZING", "PLANNING", "PRODUCING"),
}


def issue(rows: DataFrame, kind: str, severity: str, description: Column) -> DataFrame:
    """Issue rows (section_id, issue_type, severity, description, recommendation, status); they start OPEN."""
    return rows.select(
        "section_id", F.lit(kind).alias("issue_type"), F.lit(severity).alias("severity"), description.alias("description"),
        F.lit(ADVICE[kind]).alias("recommendation"), F.lit("OPEN").alias("status"),
    )


def paragraph_rows(sections: DataFrame) -> DataFrame:
    return sections.select("section_id", F.posexplode(T.paragraphs(F.col("content_markdown"))).alias("pos", "paragraph"))


def citation_mismatches(sections: DataFrame, pages: DataFrame) -> DataFrame:
    """Citations whose (source, page) the section's pack does not hold."""
    cited = sections.select("section_id", F.explode(T.citations(F.col("content_markdown"))).alias("c")).select("section_id", "c.source_id", "c.page")
    lost = cited.distinct().join(pages.select("section_id", "source_id", "page").distinct(), ["section_id", "source_id", "page"], "left_anti")
    return issue(lost, "CITATION_MISMATCH", "CRITICAL", T.citation(F.col("source_id"), F.col("page")))


def numeric_mismatches(sections: DataFrame, numbers: DataFrame, statements: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Percent values that neither a number of the pack (within the tolerance) nor its texts hold; each once."""
    said = sections.select("section_id", F.explode(T.percents(F.col("content_markdown"))).alias("value")).distinct()
    near = numbers.select(F.col("section_id").alias("_s"), F.col("value").alias("_v"))
    said = said.join(near, (F.col("section_id") == F.col("_s")) & (F.abs(F.col("value") - F.col("_v")) <= tolerance), "left_anti")
    whole = F.col("value") == F.floor("value")
    needle = F.when(whole, F.col("value").cast("long").cast("string")).otherwise(F.col("value").cast("string"))
    texts = statements.select(F.col("section_id").alias("_s"), "statement")
    said = said.withColumn("needle", needle)
    said = said.join(texts, (F.col("section_id") == F.col("_s")) & F.col("statement").contains(F.col("needle")), "left_anti")
    return issue(said, "NUMERIC_MISMATCH", "CRITICAL", F.concat("needle", F.lit("%")))


def unsupported_claims(sections: DataFrame, claims: DataFrame | None = None) -> DataFrame:
    """Major claims that nothing holds up, analysis aside; and paragraphs with a percent value and no citation."""
    rows = paragraph_rows(sections).where(~F.col("paragraph").contains(ANALYSIS_MARK) & ~F.col("paragraph").startswith("<!--"))
    measured = F.col("paragraph").rlike(r"\d+(?:\.\d+)?\s*(?:%|퍼센트)")
    bare = rows.where(measured & (F.size(T.citations(F.col("paragraph"))) == 0))
    found = issue(bare, "UNSUPPORTED_CLAIM", "CRITICAL", T.clip(F.col("paragraph"), 100))
    if claims is None:
        return found
    open_ = (F.col("verification_status") == "UNVERIFIED") | (F.col("claim_type") == "UNSUPPORTED")
    said = claims.where((F.col("claim_type") != "ANALYSIS") & F.coalesce(open_, F.lit(False)) & T.is_major_claim(F.coalesce("statement", F.lit(""))))
    said = said.join(sections.select("section_id"), "section_id", "left_semi")
    return issue(said, "UNSUPPORTED_CLAIM", "CRITICAL", F.substring("statement", 1, 120)).unionByName(found)


def promotional_language(sections: DataFrame) -> DataFrame:
    rows = sections.select("section_id", F.explode(T.promotional_phrases(F.col("content_markdown"))).alias("phrase"))
    return issue(rows, "PROMOTIONAL_LANGUAGE", "MAJOR", F.col("phrase"))


def _repeated(sections: DataFrame, least: int, above: float) -> tuple[DataFrame, DataFrame]:
    """Long paragraphs, and those of them that a later one of their section repeats."""
    rows = paragraph_rows(sections).where(F.length("paragraph") > least).withColumn("tokens", T.overlap_tokens(F.col("paragraph")))
    pairs = jaccard_pairs(rows.withColumn("at", F.struct("section_id", "pos")), "at", "tokens", above, within="section_id")
    first = pairs.select(F.col("a.section_id").alias("section_id"), F.col("a.pos").alias("pos")).distinct()
    return rows, rows.join(first, ["section_id", "pos"], "left_semi")


def duplicate_ratio(sections: DataFrame, least: int = 40, above: float = 0.85) -> DataFrame:
    """(section_id, ratio): share of paragraphs over 40 characters that a later one repeats."""
    rows, again = _repeated(sections, least, above)
    dups = again.groupBy("section_id").agg(F.count("*").alias("dups"))
    totals = rows.groupBy("section_id").agg(F.count("*").alias("total"))
    out = sections.select("section_id").join(totals, "section_id", "left").join(dups, "section_id", "left")
    return out.select("section_id", F.coalesce(F.col("dups") / F.col("total"), F.lit(0.0)).alias("ratio"))


def duplicate_paragraphs(sections: DataFrame, least: int = 40, above: float = 0.85) -> DataFrame:
    return issue(_repeated(sections, least, above)[1], "DUPLICATE_PARAGRAPH", "MINOR", T.clip(F.col("paragraph"), 60))


def technical_issues(sections: DataFrame, pages: DataFrame, numbers: DataFrame, statements: DataFrame, claims: DataFrame | None = None) -> DataFrame:
    found = citation_mismatches(sections, pages).unionByName(numeric_mismatches(sections, numbers, statements))
    return found.unionByName(unsupported_claims(sections, claims))


def technical_review(sections: DataFrame, pages: DataFrame, numbers: DataFrame, statements: DataFrame, claims: DataFrame | None = None) -> DataFrame:
    """(section_id, unsupported, citation_mismatch, numeric_mismatch, critical, coverage, decision); coverage is the verified share of
    the claims."""
    found = technical_issues(sections, pages, numbers, statements, claims)
    per = found.groupBy("section_id").agg(
        F.count_if(F.col("issue_type") == "UNSUPPORTED_CLAIM").alias("unsupported"),
        F.count_if(F.col("issue_type") == "CITATION_MISMATCH").alias("citation_mismatch"),
        F.count_if(F.col("issue_type") == "NUMERIC_MISMATCH").alias("numeric_mismatch"),
        F.count_if(F.col("severity") == "CRITICAL").alias("critical"),
    )
    out = sections.select("section_id").join(per, "section_id", "left").na.fill(0)
    if claims is None:
        out = out.withColumn("coverage", F.lit(0.0))
    else:
        held = claims.groupBy("section_id").agg(F.avg((F.col("verification_status") == "VERIFIED").cast("int")).alias("coverage"))
        out = out.join(held, "section_id", "left").na.fill(0.0, ["coverage"])
    return out.withColumn("decision", F.when(F.col("critical") > 0, "REVISE").otherwise("PASS"))


def editorial_review(sections: DataFrame) -> DataFrame:
    promo = promotional_language(sections).groupBy("section_id").agg(F.count("*").alias("promotional"))
    out = duplicate_ratio(sections).join(promo, "section_id", "left").na.fill(0, ["promotional"])
    return out.withColumn("decision", F.when((F.col("promotional") >= 2) | (F.col("ratio") > 0.1), "REVISE").otherwise("PASS"))


GATE_COUNTS = ("unsupported", "citation_mismatch", "numeric_mismatch", "critical_t", "critical_e", "unrendered")


def passes_gate() -> Column:
    """All blocker counts are zero (null counts as zero)."""
    out = F.lit(True)
    for name in GATE_COUNTS:
        out = out & (F.coalesce(F.col(name), F.lit(0)) == 0)
    return out


def needs_manual_review(max_revisions: int = MAX_REVISIONS, decisions: tuple[str, ...] = ()) -> Column:
    """The gate fails after the last revision, or a review (a column of ``decisions``) has decided so."""
    out = (F.col("revision") >= max_revisions) & ~passes_gate()
    for name in decisions:
        out = out | (F.coalesce(F.col(name), F.lit("")) == "MANUAL_REVIEW")
    return out


def transitions(spark) -> DataFrame:
    return spark.createDataFrame([(a, b) for a, to in TRANSITIONS.items() for b in to], "from_stage string, to_stage string")


def illegal_moves(moves: DataFrame) -> DataFrame:
    """Moves (from_stage, to_stage) that the table does not allow; checked for every move."""
    return moves.join(F.broadcast(transitions(moves.sparkSession)), ["from_stage", "to_stage"], "left_anti")


def _sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?。])\s+|\n")


def scrub(sections: DataFrame, pages: DataFrame, numbers: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Inherited sections without paragraphs whose percent values the pack lacks, and without citations it lacks."""
    packs = numbers.groupBy("section_id").agg(F.collect_set("value").alias("_nums"))
    known = pages.groupBy("section_id").agg(F.collect_set(T.citation(F.col("source_id"), F.col("page"))).alias("_cites"))
    rows = sections.join(packs, "section_id", "left").join(known, "section_id", "left")
    parts = F.split("content_markdown", r"\n\s*\n")

    def supported(p: Column) -> Column:
        return F.forall(T.percents(p), lambda v: F.exists(F.coalesce("_nums", F.array().cast("array<double>")), lambda n: F.abs(n - v) <= tolerance))

    def cited(p: Column) -> Column:
        marks = F.regexp_extract_all(p, F.lit(T.CITATION), F.lit(0))
        wrong = F.filter(marks, lambda m: ~F.array_contains(F.coalesce("_cites", F.array().cast("array<string>")), F.regexp_replace(m, r",\s*p\.", ", p.")))
        return F.aggregate(wrong, p, lambda acc, m: F.replace(acc, m, F.lit("")))

    kept = F.transform(F.filter(parts, supported), cited)
    return rows.withColumn("content_markdown", F.array_join(kept, "\n\n")).drop("_nums", "_cites")


def revise(sections: DataFrame, issues: DataFrame, pack_text: DataFrame) -> DataFrame:
    """One revision: sentences with a wrong number go, wrong citations go, promotional words go; what is left of less
    than 80 characters is replaced by the pack's text."""
    def gathered(kind: str, name: str) -> DataFrame:
        return issues.where(F.col("issue_type") == kind).groupBy("section_id").agg(F.collect_set("description").alias(name))

    rows = sections.join(gathered("NUMERIC_MISMATCH", "_nums"), "section_id", "left").join(gathered("CITATION_MISMATCH", "_cites"), "section_id", "left")
    rows = rows.join(pack_text.select("section_id", "pack_text"), "section_id", "left")
    none = F.array().cast("array<string>")
    clean = F.aggregate(F.coalesce("_cites", none), F.col("content_markdown"), lambda acc, c: F.replace(acc, c, F.lit("")))
    for phrase in T.PROMOTIONAL:
        clean = F.replace(clean, F.lit(phrase), F.lit(""))
    lines = F.split(clean, "\n", -1)

    def keep(sentence: Column) -> Column:
        return ~F.exists(F.coalesce("_nums", none), lambda n: F.regexp_replace(sentence, r"\s+%", "%").contains(n))

    text = F.array_join(F.transform(lines, lambda line: F.array_join(F.filter(_sentences(line), keep), " ")), "\n")
    rows = rows.withColumn("_text", text)
    short = F.length(F.trim("_text")) < 80
    rows = rows.withColumn("content_markdown", F.when(short & F.col("pack_text").isNotNull(), F.col("pack_text")).otherwise(F.col("_text")))
    return rows.withColumn("revision_count", F.col("revision_count") + 1).drop("_text", "_nums", "_cites", "pack_text")


def gate_counts(sections: DataFrame, pages: DataFrame, numbers: DataFrame, statements: DataFrame, claims: DataFrame | None = None) -> DataFrame:
    """Both reviews of all sections, as the counts that the gate looks at."""
    technical = technical_review(sections, pages, numbers, statements, claims).withColumnRenamed("critical", "critical_t").withColumnRenamed("decision", "technical")
    editorial = editorial_review(sections).select("section_id", "promotional", "ratio", F.col("decision").alias("editorial"))
    # Editorial issues are MAJOR at most; figures are judged where they are drawn.
    return technical.join(editorial, "section_id").withColumns({"critical_e": F.lit(0), "unrendered": F.lit(0)})


def review_loop(
    sections: DataFrame, pages: DataFrame, numbers: DataFrame, statements: DataFrame, pack_text: DataFrame, max_revisions: int = MAX_REVISIONS,
    find_claims: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Review, gate and revise all sections together; only those that the gate stops change, and each at most until its
    revision count is ``max_revisions``.

    ``find_claims`` makes the claims of sections anew in each round. Every round is written to the shared folder, which cuts
    the lineage and survives lost executors. The result has status PASSED or MANUAL_REVIEW.
    """
    folder = f"{shared_dir(sections.sparkSession)}/review-{uuid.uuid4().hex}"
    done, open_, spark = None, sections.drop("status"), sections.sparkSession
    for turn in range(max_revisions + 1):
        counts = gate_counts(open_, pages, numbers, statements, find_claims(open_) if find_claims else None)
        judged = open_.join(counts, "section_id").withColumn("revision", F.col("revision_count"))
        status = F.when(passes_gate(), "PASSED").when(needs_manual_review(max_revisions, ("technical", "editorial")), "MANUAL_REVIEW")
        judged.withColumn("status", status).select(*open_.columns, "status").write.parquet(f"{folder}/{turn}")
        rows = spark.read.parquet(f"{folder}/{turn}")
        ended = rows.where("status IS NOT NULL")
        done = ended if done is None else done.unionByName(ended)
        open_ = rows.where("status IS NULL").drop("status")
        if open_.isEmpty():
            break
        issues = citation_mismatches(open_, pages).unionByName(numeric_mismatches(open_, numbers, statements))
        open_ = revise(open_, issues, pack_text)
    return done


def issues_once(issues: DataFrame) -> DataFrame:
    """Numeric mismatches are one per description; other issues stay."""
    numeric = first_per_key(issues.where("issue_type = 'NUMERIC_MISMATCH'"), ["section_id", "description"], [F.col("severity")])
    return numeric.unionByName(issues.where("issue_type != 'NUMERIC_MISMATCH'"))
