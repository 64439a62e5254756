"""Queries of corpus analysis, claim locations, diagram specs, outlines, reviews, readers and written files."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import corpus, details, quality
from ..sources import readers, sink
from ..sources.shared import shared_dir
from .index import table


def corpus_analysis(spark, sf_dir):
    """Sources of documents as projects, documents as their sources of one page each: what the analysis says of each project."""
    docs = table(spark, sf_dir, "documents").where("source IS NOT NULL")
    key = F.col("doc_id").cast("string")
    state = F.when(F.col("doc_id") % 7 == 0, "FAILED").otherwise("READY")
    sources = docs.select(F.col("source").alias("project_id"), key.alias("source_id"), F.lit("EVIDENCE_SOURCE").alias("role"), state.alias("status"), F.lpad(key, 12, "0").alias("created_at"))
    pages = docs.select(key.alias("source_id"), F.lit(1).alias("page"), F.when(F.col("doc_id") % 5 == 0, "DIAGRAM").otherwise("TEXT").alias("page_type"))
    blocks = docs.select(key.alias("source_id"), F.lit(1).alias("page"), F.lit(0).alias("seq"), F.lit("TEXT").alias("block_type"), "text")
    method = F.when(F.col("doc_id") % 9 == 0, "weighed")
    metrics = docs.where("doc_id % 3 = 0").select(key.alias("source_id"), F.lit(1).alias("page_number"), key.alias("metric_id"), F.lit("m").alias("name"), method.alias("measurement_method"))
    found = corpus.analyze(corpus.context(sources, pages, blocks, metrics))
    lists = [F.array_join(c, "|").alias(c) for c in ("key_entities", "problems", "components", "processes", "qualitative")]
    sizes = [F.size(c).cast("long").alias(f"n_{c}") for c in ("evidence_gaps", "recommended_focus")]
    return found.select("project_id", "main_topic", "technical_domain", *lists, *sizes, "n_metrics", "page_count")


def claim_blocks(spark, sf_dir):
    """Customers as claims, their orders as evidence, order lines as blocks: where every claim stands."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    key = F.col("o_orderkey").cast("string")
    block = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    blocks = lines.select(F.col("l_orderkey").alias("source_id"), F.lit(1).alias("page"), F.col("l_linenumber").alias("seq"), block.alias("block_id"), F.col("l_returnflag").alias("text")).distinct()
    named = blocks.where("seq = 2 AND source_id % 3 = 0").groupBy("source_id").agg(F.collect_list("block_id").alias("block_ids"))
    evidence = orders.join(named, F.col("o_orderkey") == F.col("source_id"), "left").select(key.alias("evidence_id"), F.col("o_orderkey").alias("source_id"), F.lit(1).alias("page"), "block_ids")
    claims = orders.groupBy(F.col("o_custkey").alias("claim_id")).agg(F.collect_list(key).alias("evidence_ids"))
    found = details.claim_locations(claims, evidence, blocks).where("block_id IS NOT NULL")
    return found.select("claim_id", F.col("source_id").alias("o_orderkey"), F.col("nth").cast("long").alias("nth"), "block_id")


def process_specs(spark, sf_dir):
    """Orders as process facts of customers, their lines as nodes: the spec that is drawn."""
    label = F.when(F.col("l_linenumber") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("step "), F.col("l_partkey").cast("string")))
    node = F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.struct(F.lit(None).cast("string").alias("node_id"), label.alias("label"), F.lit(None).cast("string").alias("group")).alias("node"))
    nodes = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(node)), lambda x: x["node"]).alias("nodes"))
    facts = table(spark, sf_dir, "orders").join(nodes, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_custkey").alias("project_id"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("fact_id"), F.lit("PROCESS").alias("kind"), F.col("o_orderpriority").alias("title"),
        (F.col("o_orderkey") % 4).cast("int").alias("page"), (F.col("o_orderkey") % 3 / 2.0).alias("confidence"), "nodes",
    )
    found = details.process_specs(facts)
    return found.select(F.col("project_id").alias("o_custkey"), "title", F.array_join("steps", ",").alias("steps"), F.col("page").cast("long").alias("page"))


def outline_orders(spark, sf_dir):
    """Orders as outline nodes of customers after an edit: missing orders by place, then all renumbered."""
    orders = table(spark, sf_dir, "orders")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    nodes = orders.select(
        F.col("o_custkey").alias("plan_id"), place.alias("pos"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("node_id"),
        F.when(F.col("o_orderkey") % 2 == 0, 0).otherwise(F.col("o_orderkey") % 6 + 1).cast("int").alias("order"), F.col("o_orderpriority").alias("title"),
        F.when(F.col("o_orderstatus") == "F", F.array(F.lit("own"))).alias("source_scope"),
    )
    made = details.renumber(details.normalize_plan(nodes, F.array(F.lit("all"), F.lit("sources"))), "plan_id")
    return made.select(F.col("node_id").cast("long").alias("o_orderkey"), F.col("order").cast("long").alias("order_no"), F.array_join("source_scope", ",").alias("scope"))


def editorial_reviews(spark, sf_dir):
    """Documents as sections: share of repeated paragraphs, and the decision."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("section_id"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("content_markdown"))
    found = quality.editorial_review(docs)
    return found.select(F.col("section_id").alias("doc_id"), F.round("ratio", 6).alias("ratio"), "decision")


def sheet_files(spark, sf_dir):
    """Orders as CSV files of their lines, read by the format's decoder."""
    lines = table(spark, sf_dir, "lineitem")
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.concat_ws(",", "l_linenumber", "l_partkey", F.concat(F.lit('"'), "l_returnflag", F.lit(", \"\""), "l_linestatus", F.lit('"""'))).alias("r"))
    files = lines.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["r"]), "\n").alias("text"))
    files = files.select(F.format_string("sheets/%d.csv", "l_orderkey").alias("path"), F.encode("text", "UTF-8").alias("content"))
    found = readers.decode_files(files).where("block_type = 'TABLE'")
    name = F.regexp_extract("path", r"(\d+)\.csv$", 1).cast("long")
    return found.select(name.alias("l_orderkey"), F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"), F.col("page").cast("long").alias("page"))


def markdown_files(spark, sf_dir):
    """Customers by nation and segment as Markdown files, written and read back."""
    rows = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.sort_array(F.collect_list("c_name")).alias("names"))
    title = F.concat(F.lit("# "), F.col("c_nationkey").cast("string"), F.lit(" "), "c_mktsegment")
    text = F.concat(title, F.lit("\n\n"), F.array_join(F.transform("names", lambda n: F.concat(F.lit("- "), n)), "\n"), F.lit("\n"))
    path = f"{shared_dir(spark)}/markdown-{uuid.uuid4().hex}"
    sink.write_markdown(rows.select(F.format_string("%d/%s.md", "c_nationkey", "c_mktsegment").alias("file"), text.alias("content")), path)
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("p"), "value")
    nation, segment = (F.regexp_extract("p", r"/(\d+)/([^/]+)\.md$", k) for k in (1, 2))
    return files.select(nation.cast("long").alias("c_nationkey"), segment.alias("c_mktsegment"), F.length("value").cast("long").alias("n_chars"), F.md5("value").alias("text_md5"))


QUERIES = {f.__name__: f for f in (corpus_analysis, claim_blocks, process_specs, outline_orders, editorial_reviews, sheet_files, markdown_files)}

_STOP = "'그리고', '또는', '위한', '대한', '있는', '없는', '통해', '관련', '기반', '기존', '구축', '페이지', '소개', '개요', 'the', 'and', 'for', 'with'"
_KINDS = {
    "problems": ("문제|한계|부족|미연계|누락|노후|장애|위험|challenge|issue", 8),
    "components": ("구성|아키텍처|서버|클라우드|모듈|노드|vpn|pda|시스템", 8),
    "processes": ("절차|프로세스|흐름|단계|주문|생산|출하|공정|workflow", 8),
    "qualitative": ("안정|확장|보안|효과|개선|향상", 6),
}
_FOUND = ", ".join(
    f"""{name} AS (SELECT project_id, string_agg(line, '|' ORDER BY k) AS v FROM (
            SELECT project_id, line, row_number() OVER (PARTITION BY project_id ORDER BY place) AS k FROM (
                SELECT project_id, regexp_replace(line, '\\s+', ' ', 'g') AS line, min(place) AS place FROM told WHERE regexp_matches(lower(line), '{words}') GROUP BY 1, 2))
            WHERE k <= {most} GROUP BY project_id)"""
    for name, (words, most) in _KINDS.items()
)

ORACLE_SQL = {
    "corpus_analysis": f"""
        WITH ready AS (SELECT source AS project_id, doc_id, coalesce(substr(text, 1, 4000), '') AS t, CASE WHEN doc_id % 5 = 0 THEN 'DIAGRAM' ELSE 'TEXT' END AS kind
            FROM documents WHERE doc_id % 7 <> 0 AND source IS NOT NULL),
        projects AS (SELECT project_id, count(*)::BIGINT AS page_count, count_if(kind = 'DIAGRAM') AS diagrams, count_if(doc_id % 3 = 0)::BIGINT AS n_metrics, count_if(doc_id % 9 = 0) AS methods FROM ready GROUP BY 1),
        digest AS (SELECT project_id, doc_id, substr(t, 1, 1200) AS t FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY doc_id) AS pos FROM ready
            WHERE kind <> 'TEXT' OR regexp_matches(t, '[^ \\n\\t\\r]')) WHERE pos <= 40),
        lines AS (SELECT project_id, doc_id * 100000 + generate_subscripts(l, 1) AS place, unnest(l) AS raw FROM (SELECT project_id, doc_id, string_split_regex(t, '\\r\\n|\\n|\\r') AS l FROM digest)),
        topic AS (SELECT project_id, substr(arg_min(s, place), 1, 120) AS main_topic FROM (SELECT *, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS s FROM lines) WHERE length(s) >= 8 GROUP BY 1),
        told AS (SELECT project_id, place, line FROM (SELECT *, regexp_replace(raw, '^[ •\\-\\t]+|[ •\\-\\t]+$', '', 'g') AS line FROM lines) WHERE length(line) BETWEEN 4 AND 80),
        {_FOUND},
        terms AS (SELECT project_id, term, row_number() OVER (PARTITION BY project_id ORDER BY count(*) DESC, term) AS k FROM (
            SELECT project_id, unnest(regexp_extract_all(t, '[A-Za-z][A-Za-z0-9\\-_/]+|[가-힣]{{2,}}')) AS term FROM digest) WHERE lower(term) NOT IN ({_STOP}) GROUP BY project_id, term),
        named AS (SELECT project_id, string_agg(term, '|' ORDER BY k) FILTER (k <= 10) AS entities, string_agg(term, ' / ' ORDER BY k) FILTER (k <= 3) AS domain FROM terms WHERE k <= 12 GROUP BY 1)
        SELECT p.project_id, coalesce(main_topic, '기술자료 분석') AS main_topic, coalesce(domain, 'general-technical') AS technical_domain, coalesce(entities, '') AS key_entities,
            coalesce(problems.v, '') AS problems, coalesce(components.v, '') AS components, coalesce(processes.v, '') AS processes, coalesce(qualitative.v, '') AS qualitative,
            ((diagrams > 0 AND components.v IS NULL)::INT + (n_metrics > 0 AND methods = 0)::INT)::BIGINT AS n_evidence_gaps,
            ((problems.v IS NOT NULL)::INT + (components.v IS NOT NULL OR diagrams > 0)::INT + (processes.v IS NOT NULL)::INT + (n_metrics > 0)::INT + 1)::BIGINT AS n_recommended_focus, n_metrics, page_count
        FROM projects p LEFT JOIN topic USING (project_id) LEFT JOIN named USING (project_id) LEFT JOIN problems USING (project_id) LEFT JOIN components USING (project_id)
            LEFT JOIN processes USING (project_id) LEFT JOIN qualitative USING (project_id)""",
    "claim_blocks": """
        WITH b AS (SELECT DISTINCT l_orderkey, l_linenumber, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS block_id FROM lineitem),
        k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, block_id) AS k, l_orderkey % 3 = 0 AND bool_or(l_linenumber = 2) OVER (PARTITION BY l_orderkey) AS named FROM b),
        m AS (SELECT * FROM k WHERE CASE WHEN named THEN l_linenumber = 2 ELSE k <= 3 END)
        SELECT o_custkey AS claim_id, o_orderkey, row_number() OVER (PARTITION BY o_orderkey ORDER BY k) AS nth, block_id FROM orders JOIN m ON l_orderkey = o_orderkey""",
    "process_specs": """
        WITH s AS (SELECT l_orderkey, 'step ' || l_partkey AS label, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem WHERE l_linenumber % 3 <> 0),
        f AS (SELECT l_orderkey, count(*) AS n, string_agg(label, ',' ORDER BY k) FILTER (k <= 12) AS steps FROM s GROUP BY 1 HAVING count(*) >= 2),
        r AS (SELECT o_custkey, o_orderpriority AS title, steps, (o_orderkey % 4)::BIGINT AS page,
            row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 3 DESC, o_orderkey % 4, o_orderkey) AS k FROM orders JOIN f ON l_orderkey = o_orderkey)
        SELECT o_custkey, title, steps, page FROM r WHERE k = 1""",
    "outline_orders": """
        WITH n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos FROM orders)
        SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 2 = 0 THEN pos ELSE o_orderkey % 6 + 1 END, o_orderkey) AS order_no,
            CASE WHEN o_orderstatus = 'F' THEN 'own' ELSE 'all,sources' END AS scope FROM n""",
    "editorial_reviews": """
        WITH l AS (SELECT doc_id, string_split_regex(replace(text, chr(10), chr(10) || chr(10)), '\\n\\s*\\n') AS p FROM documents WHERE text IS NOT NULL),
        u AS (SELECT doc_id, generate_subscripts(p, 1) AS pos, regexp_replace(unnest(p), '^\\s+|\\s+$', '', 'g') AS t FROM l),
        k AS (SELECT doc_id, pos, list_distinct(regexp_extract_all(lower(t), '[a-z0-9]+|[가-힣]{2,}')) AS toks FROM u WHERE length(t) > 40 AND NOT starts_with(t, '#')),
        d AS (SELECT DISTINCT a.doc_id, a.pos FROM k a JOIN k b ON a.doc_id = b.doc_id AND a.pos < b.pos
            WHERE len(list_intersect(a.toks, b.toks)) > 0.85 * (len(a.toks) + len(b.toks) - len(list_intersect(a.toks, b.toks)))),
        r AS (SELECT doc_id, (SELECT count(*) FROM d WHERE d.doc_id = l.doc_id) / nullif((SELECT count(*) FROM k WHERE k.doc_id = l.doc_id), 0) AS ratio FROM l)
        SELECT doc_id, round(coalesce(ratio, 0)::DOUBLE, 6) AS ratio, CASE WHEN coalesce(ratio, 0) > 0.1 THEN 'REVISE' ELSE 'PASS' END AS decision FROM r""",
    "sheet_files": """
        WITH t AS (SELECT l_orderkey, string_agg(l_linenumber || ' | ' || l_partkey || ' | ' || l_returnflag || ', "' || l_linestatus || '"', chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey) AS text FROM lineitem GROUP BY 1)
        SELECT l_orderkey, length(text)::BIGINT AS n_chars, md5(text) AS text_md5, 1::BIGINT AS page FROM t""",
    "markdown_files": """
        WITH t AS (SELECT c_nationkey, c_mktsegment, '# ' || c_nationkey || ' ' || c_mktsegment || chr(10) || chr(10) || string_agg('- ' || c_name, chr(10) ORDER BY c_name) || chr(10) AS text FROM customer GROUP BY c_nationkey, c_mktsegment)
        SELECT c_nationkey::BIGINT AS c_nationkey, c_mktsegment, length(text)::BIGINT AS n_chars, md5(text) AS text_md5 FROM t""",
}
