"""Report sections: corpus analysis, writing from evidence, claims, visuals and assembly, all sections in one job.

Evidence is rows (section_id, kind, seq, statement, source_id, page, evidence_id) with kind DEFINITION, FACT, METRIC,
LIMITATION or MISSING.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.ids import content_id
from .ordering import first_per_key

# Limits per kind, headings and sentences of the offline writer.
LIMITS = {"DEFINITION": 3, "FACT": 6, "MISSING": 4, "LIMITATION": 3}
HEADINGS = {"FACT": "확인된 사실", "METRIC": "정량 지표", "MISSING": "분석상 한계"}
ANALYSIS = "【분석】"
ANALYSIS_TEXT = f"{ANALYSIS} 위 사실에 근거해 기술·운영 함의를 해석한다. 자료에 없는 수치·구현 세부·확정적 인과는 단정하지 않는다."
NO_EVIDENCE = "이 절과 직접 연결되는 원문 근거가 충분하지 않다. 확인 가능한 범위와 한계만 명시한다."
DIRECTIONS = {"INCREASE": "증가", "DECREASE": "감소", "UNCHANGED": "유지"}


def keyword_lines(docs: DataFrame, id_col: str, keywords: tuple[str, ...], low: int = 4, high: int = 80) -> DataFrame:
    """(id, pos, line): lines of 4 to 80 characters that hold a keyword, without bullets, each once per document."""
    lines = docs.select(id_col, F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = lines.withColumn("line", F.regexp_replace("line", r"^[ •\-\t]+|[ •\-\t]+$", ""))
    hit = F.exists(F.array(*[F.lit(k.lower()) for k in keywords]), lambda k: F.lower("line").contains(k))
    lines = lines.where(F.length("line").between(low, high) & hit).withColumn("line", F.regexp_replace("line", r"\s+", " "))
    return first_per_key(lines, [id_col, "line"], [F.col("pos")]).select(id_col, "pos", "line")


def domain_label(docs: DataFrame, n: int = 5) -> str:
    """The three most frequent terms, or a default."""
    rows = docs.select(F.explode(T.terms(F.col("text"))).alias("term")).where(~T.is_stop_word(F.col("term")))
    top = rows.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(n).collect()
    return " / ".join(r["term"] for r in top[:3]) or "general-technical"


def outline(findings: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Outline nodes from findings (topic, seq, title): one parent per topic with findings, its first titles as children.

    Returns node_id, parent_id, level, title and order (from 1, depth first).
    """
    from pyspark.sql import Window

    cap = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in limits.items() for x in pair]), F.col("topic")), F.lit(4))
    w = Window.partitionBy("topic").orderBy("seq", "title")
    kids = findings.withColumn("k", F.row_number().over(w)).where(F.col("k") <= cap)
    child = kids.select(content_id("N", "topic", "title").alias("node_id"), content_id("N", "topic").alias("parent_id"), F.lit(2).alias("level"), "title", "topic", "k")
    parent = kids.select("topic").distinct().select(content_id("N", "topic").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(1).alias("level"), F.col("topic").alias("title"), "topic", F.lit(0).alias("k"))
    order = Window.orderBy("topic", "k")  # an outline has tens of nodes
    return parent.unionByName(child).withColumn("order", F.row_number().over(order)).drop("topic", "k")


def metric_statement() -> Column:
    """Sentence of a metric fact; absolute facts say their quantity."""
    word = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in DIRECTIONS.items() for x in pair]), F.col("direction")), F.lit(""))
    value = F.coalesce("change_value", "result_value").cast("string")
    said = F.rtrim(F.concat_ws(" ", "name", F.concat(value, F.coalesce("change_unit", F.lit(""))), F.when(F.col("change_value").isNotNull(), word)))
    return F.concat(said, F.lit("."), F.when(F.col("measurement_method").isNotNull(), F.concat(F.lit(" 측정방법: "), "measurement_method", F.lit("."))).otherwise(""))


def write_sections(sections: DataFrame, evidence: DataFrame, level: int = 2) -> DataFrame:
    """(section_id, title, content_markdown) of sections (section_id, title, objective) from their evidence.

    Every paragraph carries a mark and, where it states a fact, its citation.
    """
    from pyspark.sql import Window

    marks = "#" * level
    order = {"DEFINITION": 1, "FACT": 2, "METRIC": 3, "MISSING": 4, "LIMITATION": 5}
    rank = F.try_element_at(F.create_map(*[F.lit(x) for pair in order.items() for x in pair]), F.col("kind"))
    cap = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in LIMITS.items() for x in pair]), F.col("kind")), F.lit(1_000_000))
    rows = evidence.withColumns({"g": rank, "k": F.row_number().over(Window.partitionBy("section_id", "kind").orderBy("seq", "statement"))}).where(F.col("k") <= cap)
    cited = F.when(F.col("kind").isin("DEFINITION", "FACT", "METRIC"), F.concat(F.lit(" "), T.citation(F.col("source_id"), F.col("page")))).otherwise("")
    said = F.when(F.col("kind") == "MISSING", F.concat(F.lit("자료에서 확인되지 않음: "), "statement")).otherwise(F.col("statement"))
    body = rows.select("section_id", "g", "k", "kind", F.concat(F.rtrim(said), cited).alias("text"))
    intro = sections.select("section_id", F.lit(0).alias("g"), F.lit(1).cast("int").alias("k"), F.lit("INTRO").alias("kind"), F.concat(F.lit("본 절은 ‘"), "objective", F.lit("’을(를) 목표로 한다.")).alias("text"))
    facts = rows.where(F.col("g") <= 3).select("section_id").distinct()
    none = sections.join(facts, "section_id", "left_anti").select("section_id", F.lit(6).alias("g"), F.lit(1).alias("k"), F.lit("NONE").alias("kind"), F.lit(NO_EVIDENCE).alias("text"))
    some = rows.where("g IN (2, 3)").select("section_id").distinct().select("section_id", F.lit(7).alias("g"), F.lit(1).alias("k"), F.lit("ANALYSIS").alias("kind"), F.lit(ANALYSIS_TEXT).alias("text"))
    every = intro.unionByName(body).unionByName(none).unionByName(some)
    w = Window.partitionBy("section_id").orderBy("g", "k")
    limits = F.col("kind").isin("MISSING", "LIMITATION")
    first_limit = limits & (F.sum(limits.cast("int")).over(w) == 1)
    heading = F.when(first_limit, HEADINGS["MISSING"])
    for kind in ("FACT", "METRIC"):
        heading = heading.when((F.col("kind") == kind) & (F.col("k") == 1), HEADINGS[kind])
    numbered = every.withColumns({"no": F.row_number().over(w), "heading": heading})
    mark = F.format_string("<!-- P-%s-%02d -->", F.right("section_id", F.lit(6)), "no")
    part = F.concat(F.coalesce(F.concat(F.lit(f"{marks}# "), "heading", F.lit("\n\n")), F.lit("")), mark, F.lit("\n"), "text")
    parts = numbered.groupBy("section_id").agg(F.array_sort(F.collect_list(F.struct("no", part.alias("t")))).alias("p"))
    text = F.concat(F.lit(f"{marks} "), "title", F.lit("\n\n<!-- SECTION_OBJECTIVE: "), "objective", F.lit(" -->\n\n"), F.array_join(F.transform("p", lambda x: x["t"]), "\n\n"), F.lit("\n"))
    return sections.join(parts, "section_id").select("section_id", "title", text.alias("content_markdown"))


def claims(sections: DataFrame, evidence: DataFrame) -> DataFrame:
    """(claim_id, section_id, pos, statement, claim_type, verification_status, evidence_ids) of marked paragraphs.

    A body without marks but with citations gives one GENERAL claim.
    """
    pattern = r"(?s)<!--\s*P-[A-Za-z0-9\-]+\s*-->\s*\n?(.*?)(?=\n<!--|\n#|\z)"
    bodies = F.regexp_extract_all("content_markdown", F.lit(pattern), F.lit(1))
    rows = sections.withColumn("b", bodies)
    whole = F.when((F.size("b") == 0) & (F.size(T.citations(F.col("content_markdown"))) > 0), F.array("content_markdown"))
    rows = rows.select("section_id", (F.size("b") == 0).alias("general"), F.posexplode(F.coalesce(whole, F.col("b"))).alias("pos", "body"))
    body = F.regexp_replace("body", r"^\s+|\s+$", "")
    rows = rows.withColumn("body", body).where("body != ''").withColumns({"cites": T.citations(F.col("body")), "bare": F.trim(T.strip_citations(F.col("body")))})
    analysis = F.col("body").startswith(ANALYSIS)
    rows = rows.where(analysis | F.col("general") | (F.length("bare") >= 8))
    kind = F.when(F.col("general"), "GENERAL").when(analysis, "ANALYSIS").when(F.size("cites") > 0, "FACT").otherwise("UNSUPPORTED")
    rows = rows.withColumn("claim_type", kind)
    cited = rows.where(~analysis).select("section_id", "pos", F.posexplode("cites").alias("at", "c")).select("section_id", "pos", "at", "c.source_id", "c.page")
    held = evidence.where("evidence_id IS NOT NULL").select("section_id", "source_id", "page", "evidence_id", F.col("seq").alias("eseq"))
    met = cited.join(held, ["section_id", "source_id", "page"]).groupBy("section_id", "pos", "evidence_id").agg(F.min(F.struct("at", "eseq")).alias("o"))
    lists = met.groupBy("section_id", "pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "evidence_id"))), lambda x: x["evidence_id"]).alias("evidence_ids"))
    out = rows.join(lists, ["section_id", "pos"], "left").withColumn("evidence_ids", F.coalesce("evidence_ids", F.array().cast("array<string>")))
    status = F.when(F.col("claim_type") == "ANALYSIS", "ANALYSIS").when(F.size("evidence_ids") > 0, "VERIFIED").otherwise("UNVERIFIED")
    statement = F.when(F.col("claim_type").isin("ANALYSIS", "GENERAL"), T.clip(F.col("body"), 400)).otherwise(T.clip(F.col("bare"), 400))
    return out.select(content_id("CLM", "section_id", "pos", "body").alias("claim_id"), "section_id", "pos", statement.alias("statement"), "claim_type", status.alias("verification_status"), "evidence_ids")


def claim_ledger(found: DataFrame, evidence: DataFrame) -> DataFrame:
    """Claims with comma-joined evidence ids and places."""
    places = evidence.select("section_id", F.col("evidence_id").alias("e"), F.format_string("%s:p.%d", "source_id", "page").alias("place"))
    met = found.select("claim_id", "section_id", F.explode("evidence_ids").alias("e")).join(places, ["section_id", "e"])
    lists = met.groupBy("claim_id").agg(F.concat_ws(",", F.sort_array(F.collect_set("e"))).alias("evidence"), F.concat_ws(",", F.sort_array(F.collect_set("place"))).alias("places"))
    return found.drop("evidence_ids").join(lists, "claim_id", "left").na.fill("", ["evidence", "places"])


def coverage(found: DataFrame) -> DataFrame:
    """(section_id, ratio): verified share of all claims."""
    return found.groupBy("section_id").agg(F.coalesce(F.avg((F.col("verification_status") == "VERIFIED").cast("int")), F.lit(0.0)).alias("ratio"))


def number_figures(markdown: Column) -> Column:
    """Figures get running numbers in their captions."""
    pattern = r"!\[([^\]]*)\]\(([^)]+)\)"
    alts, paths = (F.regexp_extract_all(markdown, F.lit(pattern), F.lit(k)) for k in (1, 2))
    between = F.split(markdown, pattern, -1)
    figures = F.transform(F.arrays_zip(alts.alias("a"), paths.alias("p")), lambda x, i: F.concat(F.lit("![그림 "), (i + 1).cast("string"), F.lit(". "), x["a"], F.lit("]("), x["p"], F.lit(")")))
    return F.array_join(F.transform(between, lambda t, i: F.concat(t, F.coalesce(F.get(figures, i), F.lit("")))), "")


def markdown_table(header: Column, rows: Column) -> Column:
    """Markdown of array<string> header and array<array<string>> rows; short rows are padded."""
    n = F.size(header)

    def line(cells: Column) -> Column:
        padded = F.slice(F.concat(cells, F.array_repeat(F.lit(""), n)), 1, n)
        return F.concat(F.lit("| "), F.array_join(padded, " | "), F.lit(" |"))

    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), n), " | "), F.lit(" |"))
    return F.array_join(F.concat(F.array(line(header), rule), F.transform(rows, line)), "\n")


def mermaid(steps: Column) -> Column:
    """Flowchart source of array<string> steps."""
    boxes = F.transform(steps, lambda s, i: F.concat(F.lit("  S"), i.cast("string"), F.lit('["'), F.translate(s, '"', "'"), F.lit('"]')))
    arrows = F.transform(F.slice(steps, 2, F.greatest(F.size(steps), F.lit(1))), lambda _, i: F.concat(F.lit("  S"), i.cast("string"), F.lit(" --> S"), (i + 1).cast("string")))
    return F.concat(F.array_join(F.concat(F.array(F.lit("flowchart LR")), boxes, arrows), "\n"), F.lit("\n"))


def visual_requests(evidence: DataFrame, facts: DataFrame) -> DataFrame:
    """(section_id, visual_type) that a section can show: BAR_CHART and TABLE with metrics, flow or architecture with facts
    (section_id, fact_kind), else a SOURCE_FIGURE."""
    measured = evidence.where("kind = 'METRIC'").select("section_id").distinct()
    rows = measured.select("section_id", F.explode(F.array(F.lit("BAR_CHART"), F.lit("TABLE"))).alias("visual_type"))
    drawn = F.when(F.col("fact_kind") == "PROCESS", "PROCESS_DIAGRAM").when(F.col("fact_kind") == "ARCHITECTURE", "ARCHITECTURE_DIAGRAM")
    rows = rows.unionByName(facts.select("section_id", drawn.alias("visual_type")).where("visual_type IS NOT NULL").distinct())
    rest = evidence.select("section_id").distinct().join(rows.select("section_id").distinct(), "section_id", "left_anti")
    return rows.unionByName(rest.select("section_id", F.lit("SOURCE_FIGURE").alias("visual_type")))


def assemble(sections: DataFrame, title: str, subtitle: str | None = None) -> DataFrame:
    """One row ``report``: title, contents and the sections (title, content_markdown, seq) in order, figures numbered."""
    item = F.struct("seq", "title", F.regexp_replace(F.coalesce("content_markdown", F.lit("")), r"^\s+|\s+$", "").alias("body"))
    whole = sections.agg(F.array_sort(F.collect_list(item)).alias("s"))
    contents = F.array_join(F.transform("s", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["title"])), "\n")
    head = f"# {title}\n\n" + (f"*{subtitle}*\n\n" if subtitle else "") + "## 목차\n\n"
    text = F.concat(F.lit(head), contents, F.lit("\n\n"), F.array_join(F.transform("s", lambda x: x["body"]), "\n\n"), F.lit("\n"))
    return whole.withColumn("_r", text).select(number_figures(F.col("_r")).alias("report"))
