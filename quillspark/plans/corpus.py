"""Corpus, table-maintenance, join and window queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import editions, joins, ordering, quality, tables
from .search import table


def page_type_counts(spark, sf_dir):
    """Page types of documents by the rules that need no geometry."""
    text = F.col("text")
    kind = F.when(T.looks_like_table(text), "TABLE").when(T.looks_like_chart(text), "CHART").otherwise("TEXT")
    return table(spark, sf_dir, "documents").groupBy(kind.alias("page_type")).agg(F.count("*").alias("n"))


def text_pages(spark, sf_dir):
    """Pages of every document: form feeds, else packs of blank-line paragraphs of about 3000 characters."""
    from ..sources.readers import split_pages

    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.posexplode(split_pages(F.col("text"))).alias("page", "page_text"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.sum(F.length("page_text")).cast("long").alias("n_chars"))


def label_coverage(spark, sf_dir):
    """Share of labelled, and of toxic among labelled, documents by source."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = docs.select("doc_id", "source").join(labels, "doc_id", "left")
    return rows.groupBy("source").agg(
        F.count("*").alias("n"), F.count("toxic").alias("labelled"), F.round(F.avg(F.col("toxic").isNotNull().cast("int")), 6).alias("coverage"),
        F.coalesce(F.round(F.avg("toxic"), 6), F.lit(0.0)).alias("toxic_share"),
    )


def unlabelled(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


def edition_diff(spark, sf_dir):
    """User turns against assistant turns of conversations, as two editions of sections."""
    turns = table(spark, sf_dir, "conversations").withColumn("title", F.concat_ws("-", "conv_id", F.floor(F.col("turn") / 2)))
    sections = turns.select("role", "title", F.col("text").alias("body"), F.col("turn").alias("seq"))
    found = editions.diff(sections.where("role = 'user'"), sections.where("role = 'assistant'"))
    return found.select("title", "status", F.col("numbers_added").cast("long").alias("numbers_added"), F.col("numbers_removed").cast("long").alias("numbers_removed"))


def latest_turn(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return ordering.latest_per_key(turns, ["conv_id"], [F.col("turn")]).select("conv_id", "turn", "role", F.length("text").cast("long").alias("n_chars"))


def context_window(spark, sf_dir):
    """Every turn with the role before and after it."""
    return ordering.with_neighbours(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id"], [F.col("turn")], "role")


def sequence_next(spark, sf_dir):
    return ordering.next_number(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey")


def quality_gate(spark, sf_dir):
    """Gate over documents as sections: digits or strong words without a citation block, repeated lines count as critical."""
    docs = table(spark, sf_dir, "documents")
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.length(x) > 40)
    rows = docs.select(
        "doc_id", T.is_major_claim(F.col("text")).cast("long").alias("unsupported"), F.lit(0).alias("citation_mismatch"), F.lit(0).alias("numeric_mismatch"),
        F.lit(0).alias("critical_t"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("critical_e"), F.lit(None).cast("int").alias("unrendered"),
        (F.col("doc_id") % 5).alias("revision"), F.when(F.col("doc_id") % 7 == 0, "MANUAL_REVIEW").alias("technical"), F.lit("PASS").alias("editorial"),
    )
    manual = quality.needs_manual_review(decisions=("technical", "editorial"))
    return rows.select("doc_id", "unsupported", "critical_e", quality.passes_gate().alias("passed"), manual.alias("manual"))


def html_page_blocks(spark, sf_dir):
    """Paragraph blocks of raw pages by pattern: count and characters per page."""
    pages = table(spark, sf_dir, "pages")
    found = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit("<p>([^<]*)"), F.lit(1))
    kept = F.filter(found, lambda x: F.trim(x) != "")
    return pages.select("page_id", F.size(kept).cast("long").alias("n_blocks"), F.length(F.array_join(kept, "")).cast("long").alias("n_chars"))


def upsert_pages(spark, sf_dir):
    """Pages of even id get a new url, and one page is new; the resulting state."""
    base = table(spark, sf_dir, "pages").select("page_id", "url")
    changes = base.where("page_id % 2 = 0").withColumn("url", F.concat("url", F.lit("?v=2")))
    added = base.where("page_id = 1").select((F.col("page_id") * 0 - 1).alias("page_id"), "url")
    return tables.upsert(base, changes.unionByName(added), ["page_id"])


def replace_source(spark, sf_dir):
    """Documents of two sources are replaced by every third one; counts after that."""
    base = table(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").cast("long").alias("n"))
    rows = base.where("source in ('src1', 'src2') and doc_id % 3 = 0")
    return tables.replace_groups(base, rows, "source").groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_chars"))


def partial_update(spark, sf_dir):
    """Customers with a patch of segment and balance; nulls of the patch are ignored."""
    base = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    changes = base.where("c_custkey % 3 = 0").select(
        "c_custkey", F.when(F.col("c_custkey") % 2 == 0, "PATCHED").alias("c_mktsegment"), F.when(F.col("c_custkey") % 2 == 1, 0.0).alias("c_acctbal")
    )
    return tables.patch(base, changes, "c_custkey", ["c_mktsegment", "c_acctbal"])


def insert_links(spark, sf_dir):
    """Document-to-item links, only for labelled documents, each pair once."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    base = docs.where("doc_id % 7 = 0").select("doc_id", F.lit("a").alias("link"))
    rows = docs.where("doc_id % 2 = 0").select("doc_id", F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("a"))).alias("link"))
    return tables.insert_or_ignore(base, rows, ["doc_id", "link"], labels, "doc_id")


def delete_cascade(spark, sf_dir):
    """Orders of customers whose key divides by 10 go, with their lines; what is left per status."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    gone = table(spark, sf_dir, "customer").where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("o_custkey"))
    kept, left = tables.delete_cascade(orders, lines, gone, "o_custkey", "o_orderkey")
    return kept.join(left, "o_orderkey").groupBy("o_orderstatus").agg(F.count("*").alias("n_lines"), F.countDistinct("o_orderkey").alias("n_orders"))


def claim_ledger(spark, sf_dir):
    """Bridge join: every order with its parts in line order, comma-joined."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    links = lines.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey"), "l_linenumber")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    found = joins.linked_lists(orders.select("o_orderkey"), links, parts, "o_orderkey", "p_partkey", F.col("p_name"), ["l_linenumber", "p_partkey"])
    return found.select("o_orderkey", F.concat_ws(",", "items").alias("parts"))


def near_number_gaps(spark, sf_dir):
    """Line prices without any account balance within 0.5 of them."""
    lines, customers = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "customer")
    rows = lines.select("l_orderkey", "l_linenumber", "l_extendedprice")
    return joins.near_anti(rows, customers, "l_extendedprice", "c_acctbal", 0.5)


def fallback_lookup(spark, sf_dir):
    """Suppliers' nation names by key, else by the region of the same number."""
    nations = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey"), (F.col("s_nationkey") % 5).alias("n_regionkey"))
    return joins.lookup_with_fallback(rows, nations.select("n_nationkey", "n_regionkey", "n_name"), "n_nationkey", "n_regionkey", "n_name")


def budget_digest(spark, sf_dir):
    """Documents of each source, in id order, until 4000 characters are full; what each contributes."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.length("text").cast("long").alias("n"))
    rows = ordering.within_budget(docs, "source", [F.col("doc_id")], F.col("n"), 4000)
    return rows.select("source", "doc_id", F.least("n", "room").alias("taken"))


def upper_median(spark, sf_dir):
    docs = table(spark, sf_dir, "conversations").groupBy("role").agg(F.collect_list(F.length("text").cast("long")).alias("sizes"))
    return docs.select("role", ordering.upper_median(F.col("sizes")).alias("upper_median"))


def percent_facts(spark, sf_dir):
    """Distinct percent values of every document that has one."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.sort_array(T.percents(F.col("text"))).alias("v")).where(F.size("v") > 0)
    return rows.select("doc_id", F.size("v").cast("long").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


def first_substantial_line(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = lines.withColumn("line", F.trim("line")).where(F.length("line") >= 8)
    return ordering.first_per_key(lines, ["doc_id"], [F.col("pos")]).select("doc_id", F.substring("line", 1, 40).alias("line"))


def priority_digest(spark, sf_dir):
    """Non-TEXT documents first, then by id: 18 of them in id order."""
    kind = F.when(T.looks_like_table(F.col("text")), "TABLE").otherwise("TEXT")
    docs = table(spark, sf_dir, "documents").select("doc_id", kind.alias("page_type"))
    return ordering.top(docs, 18, [(F.col("page_type") == "TEXT").asc(), F.asc("doc_id")])


def overlap_matrix(spark, sf_dir):
    """Jaccard of benchmark items with each other above 0.1."""
    items = table(spark, sf_dir, "benchmark").select("item_id", T.overlap_tokens(F.col("text")).alias("t"))
    return joins.jaccard_pairs(items, "item_id", "t", 0.1).select("a", "b", F.round("jaccard", 5).alias("jaccard")).where("jaccard > 0.1")


QUERIES = {f.__name__: f for f in (
    page_type_counts, text_pages, label_coverage, unlabelled, edition_diff, latest_turn, context_window, sequence_next, quality_gate,
    html_page_blocks, upsert_pages, replace_source, partial_update, insert_links, delete_cascade, claim_ledger,
    near_number_gaps, fallback_lookup, budget_digest, upper_median, percent_facts, first_substantial_line, priority_digest, overlap_matrix,
)}

_TABLE = """(len(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '')) >= 3 AND len(list_filter(
    list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> ''),
    lambda x: length(x) - length(replace(x, '|', '')) >= 2 OR length(x) - length(replace(x, chr(9), '')) >= 2)) >= 2)"""
_CHART = "(" + " + ".join(f"contains(lower(text), '{m}')::INT" for m in ("%", "증가", "감소", "향상", "baseline", "before", "after", "vs")) + " >= 2 AND regexp_matches(text, '[0-9]'))"
_STRONG = "|".join(T.STRONG_WORDS)
_TOK = "list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+|[가-힣]{2,}'))"
_PCT = "list_distinct(list_transform(regexp_extract_all({0}, '([0-9]+(?:\\.[0-9]+)?)\\s*%', 1), lambda x: x::DOUBLE))"

ORACLE_SQL = {
    "page_type_counts": f"SELECT CASE WHEN {_TABLE} THEN 'TABLE' WHEN {_CHART} THEN 'CHART' ELSE 'TEXT' END AS page_type, count(*)::BIGINT AS n FROM documents GROUP BY 1",
    "label_coverage": """
        SELECT source, count(*)::BIGINT AS n, count(toxic)::BIGINT AS labelled, round(avg((toxic IS NOT NULL)::INT), 6) AS coverage,
            coalesce(round(avg(toxic), 6), 0) AS toxic_share FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""",
    "unlabelled": "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "edition_diff": f"""
        WITH s AS (SELECT role, conv_id || '-' || (turn // 2) AS title, text, turn FROM conversations),
        o AS (SELECT title, arg_max(text, turn) AS was FROM s WHERE role = 'user' GROUP BY title), n AS (SELECT title, arg_max(text, turn) AS now FROM s WHERE role = 'assistant' GROUP BY title)
        SELECT coalesce(o.title, n.title) AS title, CASE WHEN was IS NULL THEN 'ADDED' WHEN now IS NULL THEN 'REMOVED' WHEN trim(was) = trim(now) THEN 'UNCHANGED' ELSE 'MODIFIED' END AS status,
            len(list_filter({_PCT.format("coalesce(now, '')")}, lambda x: NOT list_contains({_PCT.format("coalesce(was, '')")}, x)))::BIGINT AS numbers_added,
            len(list_filter({_PCT.format("coalesce(was, '')")}, lambda x: NOT list_contains({_PCT.format("coalesce(now, '')")}, x)))::BIGINT AS numbers_removed
        FROM o FULL JOIN n ON o.title = n.title""",
    "latest_turn": "SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role, length(arg_max(text, turn))::BIGINT AS n_chars FROM conversations GROUP BY conv_id",
    "context_window": """
        SELECT conv_id, turn, role, lag(role) OVER w AS previous_role, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
    "sequence_next": "SELECT o_custkey, (coalesce(max(o_orderkey), 0) + 1)::BIGINT AS next_number FROM orders GROUP BY o_custkey",
    "quality_gate": f"""
        WITH c AS (SELECT doc_id, regexp_matches(text, '[0-9]|{_STRONG}')::BIGINT AS unsupported,
            (len(list_filter(string_split(text, chr(10)), lambda x: length(x) > 40)) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: length(x) > 40))))::BIGINT AS critical_e FROM documents)
        SELECT *, unsupported = 0 AND critical_e = 0 AS passed, (doc_id % 5 >= 3 AND NOT (unsupported = 0 AND critical_e = 0)) OR doc_id % 7 = 0 AS manual FROM c""",
    "html_page_blocks": """
        WITH p AS (SELECT page_id, list_filter(regexp_extract_all(coalesce(html, ''), '<p>([^<]*)', 1), lambda x: trim(x, ' ') <> '') AS k FROM pages)
        SELECT page_id, len(k)::BIGINT AS n_blocks, length(array_to_string(k, ''))::BIGINT AS n_chars FROM p""",
    "upsert_pages": "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url || '?v=2' ELSE url END AS url FROM pages UNION ALL SELECT -1, url FROM pages WHERE page_id = 1",
    "replace_source": """
        SELECT source, count(*)::BIGINT AS n_docs, sum(length(text))::BIGINT AS n_chars FROM documents
        WHERE source NOT IN ('src1', 'src2') OR doc_id % 3 = 0 GROUP BY source""",
    "partial_update": """
        SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 'PATCHED' ELSE c_mktsegment END AS c_mktsegment,
            CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 1 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer""",
    "insert_links": """
        SELECT doc_id, 'a' AS link FROM documents WHERE doc_id % 7 = 0
        UNION ALL SELECT doc_id, link FROM documents, (VALUES ('a'), ('b')) v(link)
        WHERE doc_id % 2 = 0 AND doc_id IN (SELECT doc_id FROM labels) AND NOT (doc_id % 7 = 0 AND link = 'a')""",
    "delete_cascade": """
        SELECT o_orderstatus, count(*)::BIGINT AS n_lines, count(DISTINCT o_orderkey)::BIGINT AS n_orders FROM orders JOIN lineitem ON o_orderkey = l_orderkey
        WHERE NOT (o_custkey % 10 = 0 AND o_custkey IN (SELECT c_custkey FROM customer)) GROUP BY o_orderstatus""",
    "claim_ledger": """
        SELECT o_orderkey, coalesce(string_agg(p_name, ',' ORDER BY l_linenumber, p_partkey), '') AS parts FROM orders
        LEFT JOIN (SELECT * FROM lineitem JOIN part ON l_partkey = p_partkey) l ON o_orderkey = l_orderkey GROUP BY o_orderkey""",
    "near_number_gaps": """
        SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
        WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_acctbal BETWEEN l_extendedprice - 0.5 AND l_extendedprice + 0.5)""",
    "fallback_lookup": """
        WITH n AS (SELECT * FROM nation WHERE n_nationkey % 2 = 0), f AS (SELECT n_regionkey, min(n_name) AS other FROM n GROUP BY 1)
        SELECT s_suppkey, s_nationkey AS n_nationkey, (s_nationkey % 5) AS n_regionkey, coalesce(n.n_name, other) AS n_name
        FROM supplier LEFT JOIN n ON s_nationkey = n.n_nationkey LEFT JOIN f ON s_nationkey % 5 = f.n_regionkey""",
    "budget_digest": """
        WITH r AS (SELECT source, doc_id, length(text) AS n, 4000 - coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM documents)
        SELECT source, doc_id, least(n, room)::BIGINT AS taken FROM r WHERE room > 0""",
    "upper_median": "SELECT role, list_sort(list(length(text)))[(count(*) // 2) + 1]::BIGINT AS upper_median FROM conversations GROUP BY role",
    "percent_facts": f"WITH v AS (SELECT doc_id, {_PCT.format('text')} AS v FROM documents) SELECT doc_id, len(v)::BIGINT AS n, round(list_sum(v), 4) AS total FROM v WHERE len(v) > 0",
    "first_substantial_line": """
        WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10))), ' ') AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
        SELECT doc_id, substr(arg_min(line, pos), 1, 40) AS line FROM l WHERE length(line) >= 8 GROUP BY doc_id""",
    "priority_digest": f"""
        SELECT doc_id, CASE WHEN {_TABLE} THEN 'TABLE' ELSE 'TEXT' END AS page_type FROM documents ORDER BY (page_type = 'TEXT'), doc_id LIMIT 18""",
    "overlap_matrix": f"""
        WITH t AS (SELECT item_id, {_TOK} AS t FROM benchmark),
        j AS (SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))), 5) AS jaccard FROM t a JOIN t b ON a.item_id < b.item_id)
        SELECT * FROM j WHERE jaccard > 0.1""",
}
