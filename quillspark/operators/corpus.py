"""Corpus context and analysis of many projects at once: what their evidence sources say, by rule.

Sources are (project_id, source_id, role, status, created_at), pages (source_id, page, page_type), blocks (source_id, page, seq,
block_type, text), metrics (source_id, page_number, metric_id, name, ...).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .evidence import looks_technical, ready_sources
from .ordering import first_per_key

# How much of a page is kept and shown, and how many lines and terms of each kind.
PAGE_CHARS, DIGEST_CHARS, DIGEST_PAGES, TOPIC_CHARS = 4000, 1200, 40, 120
TERMS, ENTITIES, TECHNOLOGIES, DOMAIN_TERMS = 12, 10, 8, 3
#: Kinds of lines: the words that tell them, and how many are kept.
LINES = {
    "problems": (("문제", "한계", "부족", "미연계", "누락", "노후", "장애", "위험", "challenge", "issue"), 8),
    "components": (("구성", "아키텍처", "서버", "클라우드", "모듈", "노드", "VPN", "PDA", "시스템"), 8),
    "processes": (("절차", "프로세스", "흐름", "단계", "주문", "생산", "출하", "공정", "workflow"), 8),
    "qualitative": (("안정", "확장", "보안", "효과", "개선", "향상"), 6),
}
GAPS = ("다이어그램 페이지는 있으나 구성요소 텍스트 추출이 제한적임", "일부 정량 지표의 측정방법이 불명확함")
FOCUS = ("문제 배경과 도입 필요성", "시스템/기술 구성", "업무 또는 기술 프로세스 변화", "정량 성과와 측정 조건", "자료 한계와 확인 불가 사항")
DEFAULT_TOPIC, DEFAULT_DOMAIN = "기술자료 분석", "general-technical"


@dataclass
class Context:
    """sources and pages of all projects; digest: the first forty pages of each that say something, cut; metrics; page_types:
    (project_id, page_type, n)."""

    sources: DataFrame
    pages: DataFrame
    digest: DataFrame
    metrics: DataFrame
    page_types: DataFrame


def context(sources: DataFrame, pages: DataFrame, blocks: DataFrame, metrics: DataFrame) -> Context:
    """What there is of the ready evidence sources of every project; pages follow sources by time and id."""
    ready = ready_sources(sources).select("project_id", "source_id", "created_at")
    said = blocks.where((F.col("block_type") != "IMAGE") & (F.coalesce("text", F.lit("")) != ""))
    texts = said.groupBy("source_id", "page").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("b"))
    texts = texts.select("source_id", "page", F.substring(F.array_join(F.transform("b", lambda x: x["text"]), "\n"), 1, PAGE_CHARS).alias("text"))
    mine = pages.select("source_id", "page", "page_type").join(ready, "source_id").join(texts, ["source_id", "page"], "left").na.fill("", ["text"])
    heard = mine.where((F.trim(F.translate("text", "\n\t\r", "   ")) != "") | (F.col("page_type") != "TEXT"))
    place = F.row_number().over(Window.partitionBy("project_id").orderBy("created_at", "source_id", "page"))
    digest = heard.withColumn("pos", place).where(F.col("pos") <= DIGEST_PAGES).withColumn("text", F.substring("text", 1, DIGEST_CHARS))
    facts = metrics.join(ready.select("project_id", "source_id"), "source_id")
    return Context(ready, mine, digest, facts, mine.groupBy("project_id", "page_type").agg(F.count("*").alias("n")))


def _listed(rows: DataFrame, value: str, name: str, most: int, order: list[Column]) -> DataFrame:
    """(project_id, name): the first values of each project in order."""
    place = F.row_number().over(Window.partitionBy("project_id").orderBy(*order))
    kept = rows.withColumn("_k", place).where(F.col("_k") <= most)
    return kept.groupBy("project_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", value))), lambda x: x[value]).alias(name))


def analyze(found: Context) -> DataFrame:
    """One row per project: main_topic, technical_domain, key_entities, key_technologies, the kinds of lines, gaps and focus.

    Lines of 4 to 80 characters without bullets count, each once. Of equally frequent terms the alphabetically first leads.
    """
    lines = found.digest.select("project_id", F.col("pos").alias("at"), F.posexplode(F.split("text", "\r\n|\n|\r", -1)).alias("no", "raw"))
    order = [F.col("at"), F.col("no")]
    strip = F.regexp_replace("raw", r"(?U)^\s+|\s+$", "")
    topic = first_per_key(lines.withColumn("line", strip).where(F.length("line") >= 8).select("project_id", "at", "no", "line"), ["project_id"], order)
    out = found.sources.select("project_id").distinct().join(topic.select("project_id", F.substring("line", 1, TOPIC_CHARS).alias("main_topic")), "project_id", "left")
    told = lines.withColumn("line", F.regexp_replace("raw", r"^[ •\-\t]+|[ •\-\t]+$", "")).where(F.length("line").between(4, 80))
    for name, (words, most) in LINES.items():
        hit = F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.lower("line").contains(w))
        once = first_per_key(told.where(hit).select("project_id", F.regexp_replace("line", r"\s+", " ").alias("line"), "at", "no"), ["project_id", "line"], order)
        out = out.join(_listed(once, "line", name, most, order), "project_id", "left")
    terms = found.digest.select("project_id", F.explode(T.terms(F.col("text"))).alias("term")).where(~T.is_stop_word(F.col("term")))
    terms = terms.groupBy("project_id", "term").agg(F.count("*").alias("n"))
    out = out.join(_listed(terms, "term", "_terms", TERMS, [F.desc("n"), F.col("term")]), "project_id", "left")
    facts = found.metrics.groupBy("project_id").agg(F.count("*").alias("n_metrics"), F.count("measurement_method").alias("_methods"))
    drawn = found.page_types.groupBy("project_id").agg(F.sum(F.when(F.col("page_type") == "DIAGRAM", F.col("n"))).alias("_diagrams"), F.sum("n").alias("page_count"))
    out = out.join(facts, "project_id", "left").join(drawn, "project_id", "left").na.fill(0, ["n_metrics", "_methods", "_diagrams", "page_count"])
    none = F.array().cast("array<string>")
    out = out.withColumns({c: F.coalesce(c, none) for c in (*LINES, "_terms")})
    domain = F.array_join(F.slice("_terms", 1, DOMAIN_TERMS), " / ")
    some = {c: F.size(c) > 0 for c in LINES}
    gaps = [(F.col("_diagrams") > 0) & ~some["components"], (F.col("n_metrics") > 0) & (F.col("_methods") == 0)]
    focus = [some["problems"], some["components"] | (F.col("_diagrams") > 0), some["processes"], F.col("n_metrics") > 0, F.lit(True)]
    return out.select(
        "project_id", F.coalesce("main_topic", F.lit(DEFAULT_TOPIC)).alias("main_topic"), F.when(domain == "", DEFAULT_DOMAIN).otherwise(domain).alias("technical_domain"),
        F.slice("_terms", 1, ENTITIES).alias("key_entities"), F.slice(F.filter("_terms", looks_technical), 1, TECHNOLOGIES).alias("key_technologies"), *LINES,
        F.array_compact(F.array(*(F.when(c, g) for c, g in zip(gaps, GAPS, strict=True)))).alias("evidence_gaps"),
        F.array_compact(F.array(*(F.when(c, f) for c, f in zip(focus, FOCUS, strict=True)))).alias("recommended_focus"), "n_metrics", "page_count",
    )
