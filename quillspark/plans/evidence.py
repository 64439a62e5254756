"""Queries of evidence choice, stages and metrics: sections and facts derived from driver tables, and literal pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import editions, evidence, metrics, quality, retrieval
from .search import table


def _sections(spark, sf_dir):
    """Suppliers' nations as sections: titles of two words, every third one asks for metrics or processes."""
    rows = table(spark, sf_dir, "nation")
    words = F.array(*map(F.lit, ("cold widget", "small gear", "large bolt 지표", "업무 red nut", "시스템 steel pipe")))
    required = F.when(F.col("n_nationkey") % 3 == 0, F.array(F.lit("metric"), F.lit("Process"))).otherwise(F.array(F.lit("QUALITATIVE")))
    return rows.select(F.col("n_nationkey").alias("section_id"), F.get(words, F.col("n_nationkey") % 5).alias("title"), F.col("n_name").alias("objective"), required.alias("required"))


def metric_relevance(spark, sf_dir):
    """Parts as metrics of sections, eight each."""
    facts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("metric_id"), F.col("p_name").alias("name"), (F.col("p_size") / 50).alias("confidence"))
    return evidence.metric_relevance(_sections(spark, sf_dir), facts, []).select("section_id", "metric_id", F.col("pos").cast("long").alias("pos"))


def structure_relevance(spark, sf_dir):
    """Parts as processes and architectures of sections, four of a kind each."""
    kind = F.when(F.col("p_partkey") % 2 == 0, "process").otherwise("architecture")
    facts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("fact_id"), kind.alias("fact_kind"), F.col("p_type").alias("title"), F.split("p_name", " ").alias("labels"))
    return evidence.structure_relevance(_sections(spark, sf_dir), facts, []).select("section_id", "fact_kind", "fact_id", F.col("pos").cast("long").alias("pos"))


def section_packs(spark, sf_dir):
    """Whole packs: documents as hits of 26 sections, the last without any; parts as metrics and structures, some without edges."""
    docs, part = table(spark, sf_dir, "documents"), table(spark, sf_dir, "part")
    nations = _sections(spark, sf_dir)
    last = nations.where("section_id = 0").select(F.lit(25).alias("section_id"), F.lit("전체 개요").alias("title"), F.lit("").alias("objective"), F.array(F.lit("metric"), F.lit("architecture")).alias("required"))
    sections = nations.unionByName(last)
    found = docs.select((F.col("doc_id") % 25).cast("int").alias("section_id"), (F.col("doc_id") % 2).alias("qpos"), F.col("doc_id").alias("rank"), F.col("source").alias("source_id"), F.lit(1).alias("page"), "text")
    merged = retrieval.merge_queries(found)
    kind = retrieval.evidence_type(F.col("title"), F.col("text"), F.transform("required", lambda t: F.upper(t)))
    hits = merged.join(sections.select("section_id", "title", "required"), "section_id").withColumn("evidence_type", kind)
    measured = part.select(F.col("p_partkey").alias("metric_id"), F.col("p_name").alias("name"), (F.col("p_size") / 50).alias("confidence"))
    shape = F.when(F.col("p_partkey") % 2 == 0, "process").otherwise("architecture")
    drawn = part.select(
        F.col("p_partkey").alias("fact_id"), shape.alias("fact_kind"), F.col("p_type").alias("title"), F.split("p_name", " ").alias("labels"),
        F.col("p_size").alias("page"), (F.col("p_partkey") % 3).alias("n_edges"),
    )
    packs = evidence.section_packs(sections, hits, measured, drawn)
    ids = lambda c, key: F.concat_ws(",", F.transform(c, lambda e: e[key].cast("string")))
    return packs.select(
        "section_id", F.size("definitions").cast("long").alias("n_definitions"), F.concat_ws(",", "supporting_facts.type").alias("types"),
        F.aggregate("supporting_facts", F.lit(0).cast("long"), lambda n, e: n + F.length(e["statement"])).alias("n_chars"),
        ids("metrics", "metric_id").alias("metrics"), ids("process_facts", "fact_id").alias("processes"), ids("architecture_facts", "fact_id").alias("architectures"),
        F.concat_ws("|", "missing_evidence").alias("missing"), F.concat_ws("|", "limitations").alias("limitations"),
    )


def choose_evidence(spark, sf_dir):
    """Suppliers of a nation as items: some nations keep, drop or rank by ids, one drops all, one names unknown ids."""
    s = table(spark, sf_dir, "supplier")
    items = s.select(F.col("s_nationkey").alias("section_id"), F.col("s_suppkey").cast("string").alias("item_id"), F.col("s_suppkey").alias("pos"))
    ids = lambda cond: F.sort_array(F.collect_list(F.when(cond, F.col("s_suppkey").cast("string"))))
    k = F.col("s_nationkey") % 5
    picked = s.groupBy("s_nationkey").agg(
        ids((k == 1) & (F.col("s_suppkey") % 2 == 0)).alias("keep_ids"), ids((k == 4) | ((k == 2) & (F.col("s_acctbal") < 0))).alias("drop_ids"),
        F.reverse(ids((k == 3) | ((k == 1) & (F.col("s_suppkey") % 4 == 0)))).alias("ranking"),
    )
    unknown = F.when(F.col("s_nationkey") % 5 == 0, F.array(F.lit("x"))).otherwise(F.col("keep_ids"))
    choices = picked.select(F.col("s_nationkey").alias("section_id"), unknown.alias("keep_ids"), "drop_ids", "ranking")
    return evidence.choose(items, choices).select("section_id", "item_id", F.col("pos").cast("long").alias("pos"))


#: Stages that orders stand for, by their key.
STAGES = (
    "CREATED", "INGESTING", "ANALYZING", "PLANNING", "WAITING_FOR_OUTLINE_APPROVAL", "PRODUCING", "REVIEWING", "REVISING", "FINALIZING",
    "READY_FOR_EXPORT", "EXPORTED", "PAUSED", "FAILED",
)


def illegal_moves(spark, sf_dir):
    """Orders as stages of their customers' projects: moves from one to the next that are not allowed, counted."""
    stage = F.get(F.array(*map(F.lit, STAGES)), (F.col("o_orderkey") % 13).cast("int"))
    before = F.lag(stage).over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    moves = table(spark, sf_dir, "orders").select(before.alias("from_stage"), stage.alias("to_stage")).where("from_stage IS NOT NULL")
    return quality.illegal_moves(moves).groupBy("from_stage", "to_stage").agg(F.count("*").alias("n"))


def complete_sections(spark, sf_dir):
    """Documents as sections of a resumed run: which states and bodies count as finished."""
    states = F.array(*map(F.lit, ("writing", "PASSED", "REVISING", "Failed", "DRAFT", "pending", "MANUAL_REVIEW")))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.get(states, (F.col("doc_id") % 8).cast("int")).alias("status"), F.col("text").alias("content_markdown"))
    return docs.select("doc_id", editions.is_complete().alias("complete"))


def edition_outcomes(spark, sf_dir):
    """Orders as sections, customers as editions."""
    status = F.when(F.col("o_orderstatus") == "F", "PASSED").when(F.col("o_orderstatus") == "O", "MANUAL_REVIEW")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("edition_id"), F.when(F.col("o_orderpriority").startswith("1"), "KEEP").otherwise("REWRITE").alias("decision"), status.alias("status"))
    return evidence.outcomes(rows)


def evidence_blocks(spark, sf_dir):
    """Turns as blocks and conversations as evidence: named blocks, else the first three of the conversation."""
    turns = table(spark, sf_dir, "conversations")
    blocks = turns.select(F.lit("c").alias("source_id"), F.col("conv_id").alias("page"), F.col("turn").alias("seq"), F.concat_ws("-", "conv_id", "turn").alias("block_id"))
    named = F.when(F.col("conv_id") % 3 == 0, F.array(F.concat_ws("-", "conv_id", F.lit("1")), F.lit("gone"))).when(F.col("conv_id") % 3 == 1, F.array(F.lit("gone"))).otherwise(F.array().cast("array<string>"))
    found = turns.select("conv_id").distinct().select(F.col("conv_id").alias("evidence_id"), F.lit("c").alias("source_id"), F.col("conv_id").alias("page"), named.alias("block_ids"))
    return evidence.blocks_of(found, blocks)


def metric_facts(spark, sf_dir):
    """Orders as pages of a report: a titled change, with its method on odd keys, and on the next page a labelled amount."""
    titles, ways = ("시간당생산량", "납기준수율", "재공재고", "클레임 건수"), ("증가", "감소", "향상")
    key = F.col("o_orderkey")
    pick = lambda words: F.get(F.array(*map(F.lit, words)), (key % len(words)).cast("int"))
    method = F.when(key % 2 == 1, F.lit("측정방법: 월간 집계\n")).otherwise("")
    change = F.concat(F.lit("1. "), pick(titles), F.lit("\n효과\n기존 대비 "), (key % 90 + 1).cast("string"), F.lit("% "), pick(ways), F.lit("\n"), method)
    amount = F.concat(F.lit("상시 인원\n"), F.format_number(key, 0), F.lit("명"))
    pages = table(spark, sf_dir, "orders").select(key.alias("source_id"), F.posexplode(F.array(change, amount)).alias("page_number", "text"))
    facts = metrics.metric_facts(pages)
    value = F.coalesce("change_value", "result_value")
    return facts.select(F.col("source_id").cast("long").alias("o_orderkey"), F.col("page_number").cast("long").alias("page"), "name", value.alias("value"), "change_unit", "direction", "confidence", "verification_status")


def page_lines(spark, sf_dir):
    """Turns as pages: of five recognised lines of each, those that the turn's text and the lines before do not hold."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("source_id"), F.col("turn").alias("page"), "text").where("text IS NOT NULL")
    fresh = F.concat(F.lit("Qqzzkk 가나 "), F.col("page").cast("string"))
    said = F.array(F.concat(F.lit("- "), "text", F.lit(" -")), F.replace("text", F.lit(" "), F.lit("")), fresh, F.replace(F.lower(fresh), F.lit(" "), F.lit("--")), F.lit("x"))
    lines = turns.select("source_id", "page", F.posexplode(said).alias("seq", "text"))
    found = evidence.new_lines(lines, turns)
    return found.select(F.col("source_id").alias("conv_id"), F.col("page").alias("turn"), F.col("seq").cast("long").alias("seq"), "text")


def graph_pages(spark, sf_dir):
    """Conversations as pages, turns as blocks, orders' lines as drawings."""
    turns = table(spark, sf_dir, "conversations")
    kinds = F.array(*map(F.lit, ("TEXT", "OCR", "TEXT", "TABLE", "TEXT")))
    # Five conversations make a page.
    page = F.floor(F.col("conv_id") / 5)
    blocks = turns.select(F.lit("c").alias("source_id"), page.alias("page"), F.get(kinds, F.col("turn") % 5).alias("block_type"), "text")
    kind = F.get(F.array(*map(F.lit, ("DIAGRAM", "MIXED", "TEXT", "CHART"))), F.col("page") % 4)
    pages = blocks.select("source_id", "page").distinct().withColumn("page_type", kind)
    lines = table(spark, sf_dir, "lineitem")
    drawings = lines.select(F.lit("c").alias("source_id"), F.floor(F.col("l_orderkey") / 2).alias("page"), F.when(F.col("l_linenumber") != 2, "line").otherwise("rect").alias("kind"))
    return evidence.holds_graph(pages, blocks, drawings).select("page", "page_type", "holds_graph")


def unrendered_visuals(spark, sf_dir):
    """Orders as visuals of customers, order lines' sums as sizes of files."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("section_id"), F.col("o_orderkey").alias("asset_id"), F.col("o_orderkey").cast("string").alias("path"))
    files = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("path")).agg(F.sum("l_quantity").alias("n_bytes"))
    return evidence.unrendered(orders, files)


def titles(spark, sf_dir):
    """Documents' texts as titles, and whether their first word looks technical."""
    docs = table(spark, sf_dir, "documents")
    title = evidence.short_title(F.col("text"), F.lit("untitled"))
    word = F.substring_index(F.coalesce("text", F.lit("")), " ", 1)
    return docs.select("doc_id", title.alias("title"), evidence.looks_technical(word).alias("technical"))


def last_two_orders(spark, sf_dir):
    """Orders as editions of customers."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderkey").alias("number"))
    return evidence.last_two(orders, "o_custkey", "number", "o_orderkey")


def pack_indexes(spark, sf_dir):
    """Orders as packs of lines: their distinct (supplier, line number) pairs, and their numbers."""
    lines = table(spark, sf_dir, "lineitem")
    item = F.struct(F.col("l_suppkey").alias("source_id"), F.col("l_linenumber").alias("page"))
    packs = lines.groupBy(F.col("l_orderkey").alias("section_id")).agg(F.collect_list(item).alias("facts"))
    pages = evidence.pack_pages(packs, ["facts", "facts"]).groupBy("section_id").agg(F.count("*").alias("n_pages"), F.sum("source_id").alias("sources"))
    metric = F.struct(F.col("l_quantity").alias("change_value"), F.col("l_discount").alias("baseline_value"), F.when(F.col("l_tax") > 0, F.col("l_tax")).alias("result_value"))
    numbers = evidence.pack_numbers(evidence.pack_metrics(lines.groupBy(F.col("l_orderkey").alias("section_id")).agg(F.collect_list(metric).alias("metrics"))))
    return pages.join(numbers.groupBy("section_id").agg(F.count("*").alias("n_numbers"), F.round(F.sum("value"), 4).alias("total")), "section_id")


QUERIES = {f.__name__: f for f in (
    graph_pages, unrendered_visuals, titles, last_two_orders, pack_indexes, metric_relevance, structure_relevance, section_packs, choose_evidence, illegal_moves, complete_sections, edition_outcomes, evidence_blocks, metric_facts, page_lines,
)}

_SECTIONS = """
    sections AS (
        SELECT n_nationkey AS section_id, ['cold widget', 'small gear', 'large bolt 지표', '업무 red nut', '시스템 steel pipe'][n_nationkey % 5 + 1] AS title,
            n_name AS objective, CASE WHEN n_nationkey % 3 = 0 THEN ['METRIC', 'PROCESS'] ELSE ['QUALITATIVE'] END AS required FROM nation
    ),
    asked AS (SELECT *, regexp_extract_all(lower(title || ' ' || objective), '[a-z0-9]+|[가-힣]{2,}') AS toks FROM sections)
"""

ORACLE_SQL = {
    "graph_pages": """
        WITH b AS (SELECT conv_id // 5 AS page, ['TEXT', 'OCR', 'TEXT', 'TABLE', 'TEXT'][turn % 5 + 1] AS kind, text AS t FROM conversations),
        h AS (SELECT *, trim(string_split(t, chr(10))[1], ' ') AS head FROM b),
        c AS (SELECT page, ['DIAGRAM', 'MIXED', 'TEXT', 'CHART'][page % 4 + 1] AS page_type,
            count_if(kind IN ('TEXT', 'OCR') AND trim(coalesce(t, ''), ' ') <> '') AS texts, count_if(kind = 'TABLE') AS tables,
            count_if(kind IN ('TEXT', 'OCR') AND trim(coalesce(t, ''), ' ') <> '' AND length(head) BETWEEN 2 AND 22 AND NOT contains(head, '|')) AS short FROM h GROUP BY page),
        d AS (SELECT l_orderkey // 2 AS page, count_if(l_linenumber <> 2) AS lines FROM lineitem GROUP BY 1)
        SELECT page::BIGINT AS page, page_type, page_type <> 'TEXT' AND texts >= 5 AND tables < 5
            AND (coalesce(lines, 0) >= 6 OR short >= 10 OR (page_type = 'DIAGRAM' AND short >= 6 AND coalesce(lines, 0) >= 2)) AS holds_graph
        FROM c LEFT JOIN d USING (page)""",
    "unrendered_visuals": """
        WITH f AS (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING sum(l_quantity) >= 32)
        SELECT o_custkey AS section_id, count(*)::BIGINT AS unrendered FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM f) GROUP BY 1""",
    "titles": """
        WITH d AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'), ' ') AS t, string_split(coalesce(text, ''), ' ')[1] AS w FROM documents)
        SELECT doc_id, CASE WHEN length(t) > 40 THEN substr(t, 1, 37) || '...' WHEN t = '' THEN 'untitled' ELSE t END AS title,
            (regexp_matches(w, '[A-Za-z]') AND length(w) <= 24) OR regexp_matches(w, '시스템|클라우드|서버|네트워크|데이터|공정|모델|센서') AS technical FROM d""",
    "last_two_orders": """
        WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM orders)
        SELECT o_custkey, coalesce(max(CASE WHEN k = 2 THEN o_orderkey END), max(CASE WHEN k = 1 THEN o_orderkey END)) AS older, max(CASE WHEN k = 1 THEN o_orderkey END) AS newer
        FROM r WHERE k <= 2 GROUP BY o_custkey""",
    "pack_indexes": """
        WITH p AS (SELECT l_orderkey, count(*)::BIGINT AS n_pages, sum(l_suppkey)::BIGINT AS sources FROM (SELECT DISTINCT l_orderkey, l_suppkey, l_linenumber FROM lineitem) GROUP BY 1),
        v AS (SELECT DISTINCT l_orderkey, unnest([l_quantity::DOUBLE, l_discount::DOUBLE, CASE WHEN l_tax > 0 THEN l_tax::DOUBLE END]) AS value FROM lineitem)
        SELECT l_orderkey AS section_id, n_pages, sources, count(value)::BIGINT AS n_numbers, round(sum(value), 4) AS total FROM p JOIN v USING (l_orderkey)
        WHERE value IS NOT NULL GROUP BY ALL""",
    "metric_relevance": f"""
        WITH {_SECTIONS}, met AS (
            SELECT section_id, p_partkey, row_number() OVER (PARTITION BY section_id ORDER BY p_partkey) AS pos FROM asked, part
            WHERE len(list_intersect(toks, regexp_extract_all(lower(p_name), '[a-z0-9]+|[가-힣]{{2,}}'))) > 0
                OR ((list_contains(required, 'METRIC') OR contains(title, '지표')) AND (p_size / 50 >= 0.7 OR (SELECT count(*) FROM part) <= 6))
        )
        SELECT section_id, p_partkey AS metric_id, pos::BIGINT AS pos FROM met WHERE pos <= 8""",
    "structure_relevance": f"""
        WITH {_SECTIONS}, facts AS (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN 'PROCESS' ELSE 'ARCHITECTURE' END AS fact_kind FROM part),
        met AS (
            SELECT section_id, fact_kind, p_partkey, row_number() OVER (PARTITION BY section_id, fact_kind ORDER BY p_partkey) AS pos FROM asked, facts
            WHERE len(list_intersect(toks, regexp_extract_all(lower(p_type || ' ' || p_name), '[a-z0-9]+|[가-힣]{{2,}}'))) > 0
                OR list_contains(required, fact_kind) OR contains(title, CASE fact_kind WHEN 'PROCESS' THEN '업무' ELSE '시스템' END)
        )
        SELECT section_id, fact_kind, p_partkey AS fact_id, pos::BIGINT AS pos FROM met WHERE pos <= 4""",
    "section_packs": """
        WITH sections AS (
            SELECT n_nationkey AS section_id, ['cold widget', 'small gear', 'large bolt 지표', '업무 red nut', '시스템 steel pipe'][n_nationkey % 5 + 1] AS title,
                n_name AS objective, CASE WHEN n_nationkey % 3 = 0 THEN ['METRIC', 'PROCESS'] ELSE ['QUALITATIVE'] END AS required FROM nation
            UNION ALL SELECT 25, '전체 개요', '', ['METRIC', 'ARCHITECTURE']
        ),
        asked AS (SELECT *, regexp_extract_all(lower(title || ' ' || objective), '[a-z0-9]+|[가-힣]{2,}') AS toks FROM sections),
        once AS (
            SELECT doc_id % 25 AS section_id, doc_id % 2 AS qpos, doc_id, text FROM documents
            QUALIFY row_number() OVER (PARTITION BY doc_id % 25, source, substr(text, 1, 60) ORDER BY doc_id % 2, doc_id) = 1
        ),
        ten AS (SELECT *, row_number() OVER (PARTITION BY section_id ORDER BY qpos, doc_id) AS seq FROM once QUALIFY seq <= 10),
        hits AS (
            SELECT section_id, seq, lower(title || chr(10) || text) AS said, required[1] AS own,
                trim(regexp_replace(trim(text, ' '), '[\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g'), ' ') AS flat
            FROM ten JOIN sections USING (section_id) WHERE trim(text, ' ') NOT IN ('', '[IMAGE]')
        ),
        typed AS (
            SELECT section_id, seq, least(length(flat), 400) AS size, CASE
                WHEN regexp_matches(said, '%|증가|감소|향상|지표') THEN 'METRIC' WHEN regexp_matches(said, '구성|아키텍처|vpn|클라우드|노드|연결') THEN 'ARCHITECTURE'
                WHEN regexp_matches(said, '절차|프로세스|흐름|단계|주문|출하') THEN 'PROCESS' WHEN regexp_matches(said, '문제|한계|누락|미연계|노후') THEN 'PROBLEM'
                WHEN regexp_matches(said, '정의|이란|의미|측정방법') THEN 'DEFINITION' ELSE own END AS kind FROM hits
        ),
        cited AS (
            SELECT section_id, count_if(kind = 'DEFINITION') AS n_definitions, sum(size) FILTER (kind <> 'DEFINITION') AS n_chars,
                string_agg(kind, ',' ORDER BY seq) FILTER (kind <> 'DEFINITION') AS types FROM typed GROUP BY section_id
        ),
        met AS (
            SELECT section_id, p_partkey FROM asked, part
            WHERE len(list_intersect(toks, regexp_extract_all(lower(p_name), '[a-z0-9]+|[가-힣]{2,}'))) > 0
                OR ((list_contains(required, 'METRIC') OR contains(title, '지표')) AND (p_size / 50 >= 0.7 OR (SELECT count(*) FROM part) <= 6))
            QUALIFY row_number() OVER (PARTITION BY section_id ORDER BY p_partkey) <= 8
        ),
        counted AS (SELECT section_id, string_agg(p_partkey, ',' ORDER BY p_partkey) AS metrics FROM met GROUP BY section_id),
        facts AS (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN 'PROCESS' ELSE 'ARCHITECTURE' END AS fact_kind FROM part),
        shown AS (
            SELECT section_id, fact_kind, p_partkey, 'p' || p_size || CASE fact_kind WHEN 'PROCESS' THEN ' 흐름도: 단계 목록은 있으나 화살표 연결 미검증'
                ELSE ' 구성도: 노드 그룹은 확인했으나 연결선 미검증' END AS note FROM asked, facts
            WHERE len(list_intersect(toks, regexp_extract_all(lower(p_type || ' ' || p_name), '[a-z0-9]+|[가-힣]{2,}'))) > 0
                OR list_contains(required, fact_kind) OR contains(title, CASE fact_kind WHEN 'PROCESS' THEN '업무' ELSE '시스템' END)
            QUALIFY row_number() OVER (PARTITION BY section_id, fact_kind ORDER BY p_partkey) <= 4
        ),
        drawn AS (
            SELECT section_id, string_agg(p_partkey, ',' ORDER BY p_partkey) FILTER (fact_kind = 'PROCESS') AS processes,
                string_agg(p_partkey, ',' ORDER BY p_partkey) FILTER (fact_kind = 'ARCHITECTURE') AS architectures,
                string_agg(note, '|' ORDER BY fact_kind, p_partkey) FILTER (p_partkey % 3 = 0) AS notes FROM shown GROUP BY section_id
        ),
        packs AS (SELECT * FROM sections LEFT JOIN cited USING (section_id) LEFT JOIN counted USING (section_id) LEFT JOIN drawn USING (section_id)),
        judged AS (
            SELECT *, concat_ws('|',
                CASE WHEN list_contains(required, 'METRIC') AND metrics IS NULL THEN '정량 지표 근거가 부족함' END,
                CASE WHEN list_contains(required, 'ARCHITECTURE') AND architectures IS NULL AND NOT contains(coalesce(types, ''), 'ARCHITECTURE') THEN '아키텍처 근거가 부족함' END,
                CASE WHEN list_contains(required, 'PROCESS') AND processes IS NULL AND NOT contains(coalesce(types, ''), 'PROCESS') THEN '프로세스 근거가 부족함' END,
                CASE WHEN coalesce(types, metrics, processes, architectures) IS NULL THEN '관련 원문 근거를 충분히 찾지 못함' END) AS missing FROM packs
        )
        SELECT section_id::INTEGER AS section_id, coalesce(n_definitions, 0)::BIGINT AS n_definitions, coalesce(types, '') AS types, coalesce(n_chars, 0)::BIGINT AS n_chars,
            coalesce(metrics, '') AS metrics, coalesce(processes, '') AS processes, coalesce(architectures, '') AS architectures, missing,
            concat_ws('|', CASE WHEN missing <> '' THEN 'Evidence Pack에 없는 세부 사실은 단정하지 말 것' END, notes) AS limitations FROM judged""",
    "choose_evidence": """
        WITH s AS (SELECT *, s_nationkey % 5 AS k, s_suppkey::VARCHAR AS id FROM supplier),
        marked AS (
            SELECT *, CASE k WHEN 1 THEN s_suppkey % 2 = 0 ELSE true END AS kept,
                (k = 4 OR (k = 2 AND s_acctbal < 0)) AS dropped, (k = 3 OR (k = 1 AND s_suppkey % 4 = 0)) AS ranked FROM s
        ),
        chosen AS (SELECT *, CASE WHEN k = 1 AND NOT bool_or(kept) OVER w THEN true ELSE kept AND NOT dropped END AS stays,
            k = 1 AND bool_or(kept) OVER w AS by_keep FROM marked WINDOW w AS (PARTITION BY s_nationkey)),
        whole AS (SELECT *, NOT bool_or(stays) OVER (PARTITION BY s_nationkey) AS everything FROM chosen),
        places AS (SELECT *, CASE WHEN ranked THEN row_number() OVER (PARTITION BY s_nationkey, ranked ORDER BY id DESC) END AS rank_at,
            CASE WHEN by_keep AND kept THEN row_number() OVER (PARTITION BY s_nationkey, kept ORDER BY id) END AS keep_at FROM whole WHERE stays OR everything)
        SELECT s_nationkey AS section_id, id AS item_id, row_number() OVER (PARTITION BY s_nationkey ORDER BY
            rank_at NULLS LAST, keep_at NULLS LAST, s_suppkey)::BIGINT AS pos FROM places""",
    "illegal_moves": """
        WITH allowed(a, b) AS (VALUES
            ('CREATED', 'INGESTING'), ('CREATED', 'FAILED'),
            ('INGESTING', 'ANALYZING'), ('INGESTING', 'PAUSED'), ('INGESTING', 'FAILED'),
            ('ANALYZING', 'PLANNING'), ('ANALYZING', 'PAUSED'), ('ANALYZING', 'FAILED'),
            ('PLANNING', 'WAITING_FOR_OUTLINE_APPROVAL'), ('PLANNING', 'PAUSED'), ('PLANNING', 'FAILED'),
            ('WAITING_FOR_OUTLINE_APPROVAL', 'PRODUCING'), ('WAITING_FOR_OUTLINE_APPROVAL', 'PLANNING'), ('WAITING_FOR_OUTLINE_APPROVAL', 'PAUSED'), ('WAITING_FOR_OUTLINE_APPROVAL', 'FAILED'),
            ('PRODUCING', 'REVIEWING'), ('PRODUCING', 'PAUSED'), ('PRODUCING', 'FAILED'),
            ('REVIEWING', 'REVISING'), ('REVIEWING', 'FINALIZING'), ('REVIEWING', 'PRODUCING'), ('REVIEWING', 'PAUSED'), ('REVIEWING', 'FAILED'),
            ('REVISING', 'REVIEWING'), ('REVISING', 'PAUSED'), ('REVISING', 'FAILED'),
            ('FINALIZING', 'READY_FOR_EXPORT'), ('FINALIZING', 'PAUSED'), ('FINALIZING', 'FAILED'),
            ('READY_FOR_EXPORT', 'EXPORTED'), ('READY_FOR_EXPORT', 'PRODUCING'), ('READY_FOR_EXPORT', 'INGESTING'), ('READY_FOR_EXPORT', 'PAUSED'), ('READY_FOR_EXPORT', 'FAILED'),
            ('EXPORTED', 'INGESTING'), ('EXPORTED', 'ANALYZING'), ('EXPORTED', 'PRODUCING'),
            ('PAUSED', 'INGESTING'), ('PAUSED', 'ANALYZING'), ('PAUSED', 'PLANNING'), ('PAUSED', 'WAITING_FOR_OUTLINE_APPROVAL'), ('PAUSED', 'PRODUCING'), ('PAUSED', 'REVIEWING'), ('PAUSED', 'REVISING'), ('PAUSED', 'FINALIZING'), ('PAUSED', 'READY_FOR_EXPORT'), ('PAUSED', 'FAILED'),
            ('FAILED', 'INGESTING'), ('FAILED', 'ANALYZING'), ('FAILED', 'PLANNING'), ('FAILED', 'PRODUCING')
        ),
        named AS (SELECT *, ['CREATED', 'INGESTING', 'ANALYZING', 'PLANNING', 'WAITING_FOR_OUTLINE_APPROVAL', 'PRODUCING', 'REVIEWING', 'REVISING', 'FINALIZING',
            'READY_FOR_EXPORT', 'EXPORTED', 'PAUSED', 'FAILED'][o_orderkey % 13 + 1] AS stage FROM orders),
        moves AS (SELECT lag(stage) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS a, stage AS b FROM named)
        SELECT a AS from_stage, b AS to_stage, count(*)::BIGINT AS n FROM moves WHERE a IS NOT NULL AND (a, b) NOT IN (SELECT (a, b) FROM allowed) GROUP BY ALL""",
    "complete_sections": """
        WITH d AS (SELECT doc_id, ['WRITING', 'PASSED', 'REVISING', 'FAILED', 'DRAFT', 'PENDING', 'MANUAL_REVIEW'][doc_id % 8 + 1] AS status, text AS body FROM documents)
        SELECT doc_id, coalesce(status, '') NOT IN ('RESEARCHING', 'WRITING', 'REVISING', 'PENDING', 'FAILED')
            AND length(regexp_replace(coalesce(body, ''), '^\\s+|\\s+$', '', 'g')) >= 40 AS complete FROM d""",
    "edition_outcomes": """
        SELECT o_custkey AS edition_id, count_if(o_orderpriority LIKE '1%')::BIGINT AS kept, count_if(o_orderpriority NOT LIKE '1%')::BIGINT AS rewritten,
            bool_and(o_orderstatus = 'F') AS all_passed, bool_or(o_orderstatus = 'O') AS manual_review FROM orders GROUP BY o_custkey""",
    "evidence_blocks": """
        WITH b AS (SELECT conv_id, turn, conv_id || '-' || turn AS block_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k,
            bool_or(turn = 1) OVER (PARTITION BY conv_id) AS has_one FROM conversations)
        SELECT DISTINCT conv_id AS evidence_id, block_id FROM b WHERE CASE WHEN conv_id % 3 = 0 AND has_one THEN turn = 1 ELSE k <= 3 END""",
    "metric_facts": """
        SELECT o_orderkey, 0::BIGINT AS page, ['시간당생산량', '납기준수율', '재공재고', '클레임 건수'][o_orderkey % 4 + 1] AS name, (o_orderkey % 90 + 1)::DOUBLE AS value, '%' AS change_unit,
            CASE WHEN o_orderkey % 3 = 1 THEN 'DECREASE' ELSE 'INCREASE' END AS direction, CASE WHEN o_orderkey % 2 = 1 THEN 0.96 ELSE 0.93 END::DOUBLE AS confidence,
            CASE WHEN o_orderkey % 2 = 1 THEN 'VERIFIED' ELSE 'REQUIRES_VISUAL_CHECK' END AS verification_status FROM orders
        UNION ALL SELECT o_orderkey, 1, '상시 인원', o_orderkey::DOUBLE, '명', NULL, 0.84, 'VERIFIED' FROM orders""",
    "page_lines": """
        SELECT conv_id, turn, 2::BIGINT AS seq, 'Qqzzkk 가나 ' || turn AS text FROM conversations WHERE text IS NOT NULL""",
}
