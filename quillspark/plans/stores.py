"""Queries over stores that are filled from the driver tables: ingest, records, runs, payloads, impact and drawings.

Each run writes its tables into a folder of its own in the shared folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import graphs, impact, payload, records, report
from ..operators.postings import Postings
from ..operators.runs import EditionRun
from ..operators.vectors import VectorStore
from ..sources.shared import shared_dir
from ..sources.versioned import VersionedTables
from ..streaming.ingest import ingest_batch
from .index import table


def _tables(spark, name, buckets=8):
    return VersionedTables(spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", buckets)


def ingest_conversations(spark, sf_dir):
    """Conversations as text files, a page per turn: all rows of the ingest, counted by source."""
    turns = table(spark, sf_dir, "conversations")
    said = F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"))))
    files = turns.groupBy("conv_id").agg(F.array_join(F.transform(said, lambda t: t["text"]), "\f").alias("text"))
    files = files.select(F.format_string("conversations/%d/original.txt", "conv_id").alias("path"), F.encode("text", "UTF-8").alias("content"))
    tables = _tables(spark, "ingest")
    postings, store = Postings(tables), VectorStore(tables)
    ingest_batch(tables, postings, store, files, ("query", 0))

    def counted(name, column, count=F.count("*")):
        return tables.read(name).groupBy("source_id").agg(count.alias(column))

    out = tables.read("sources").select("source_id", "status", F.col("page_count").alias("n_pages"))
    parts = [counted("blocks", "n_blocks"), counted("chunks", "n_chunks"), counted(postings.name, "n_postings", F.sum(F.size("terms"))), counted(store.name, "n_vectors")]
    for part in parts:
        out = out.join(part, "source_id", "left")
    out = out.na.fill(0)
    return out.select(F.col("source_id").cast("long").alias("conv_id"), "status", "n_pages", "n_blocks", "n_chunks", "n_postings", "n_vectors")


def _node(order, title):
    return F.struct(
        F.col("o_orderkey").cast("string").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(1).alias("level"),
        order.cast("int").alias("order"), title.alias("title"), F.col("o_orderstatus").alias("objective"),
    )


def plan_records(spark, sf_dir):
    """Customers as plans with their orders as nodes; a third get other nodes, half are approved, a fifth get another title."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    nodes = orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(_node(F.col("o_orderkey"), F.col("o_orderpriority")))).alias("outline"))
    rows = customers.join(nodes, F.col("c_custkey") == F.col("o_custkey"))
    null = F.lit(None).cast("string")
    plans = rows.select(
        F.col("c_custkey").cast("string").alias("project_id"), F.lit("s").alias("snapshot_id"), F.col("c_name").alias("title"), null.alias("subtitle"),
        F.lit("why").alias("purpose"), null.alias("target_reader"), F.col("c_mktsegment").alias("report_summary"), F.lit("t0").alias("created_at"), "outline",
    )
    tables = _tables(spark, "plans")
    records.save_plans(tables, plans)
    ids = tables.read("outlines").join(tables.read("report_plans").select("plan_id", F.col("project_id").cast("long").alias("key")), "plan_id").select("outline_id", "plan_id", "key")
    kept = F.filter("outline", lambda n: n["objective"] == "F")
    new = ids.where("key % 3 = 0").join(rows.select(F.col("c_custkey").alias("key"), kept.alias("outline")), "key")
    records.replace_nodes(tables, new.select("outline_id", "outline"))
    records.approve(tables, ids.where("key % 2 = 0"), "t1")
    records.update_plans(tables, ids.where("key % 5 = 0").select("plan_id", F.concat(F.lit("new "), "key").alias("title"), null.alias("purpose")))
    count = tables.read("outline_nodes").groupBy("outline_id").agg(F.count("*").alias("n_nodes"), F.max("order").cast("long").alias("last_order"))
    out = tables.read("report_plans").join(tables.read("outlines"), "plan_id").join(count, "outline_id", "left").na.fill(0, ["n_nodes", "last_order"])
    said = payload.field(F.col("payload_json"), "$.title", "string")
    return out.select(F.col("project_id").cast("long").alias("c_custkey"), "title", said.alias("payload_title"), "purpose", "version", "approved", "approved_at", "n_nodes", "last_order")


def review_records(spark, sf_dir):
    """Orders as sections, their lines as review issues, of which those of even lines are resolved."""
    lines = table(spark, sf_dir, "lineitem")
    grave = F.when(F.col("l_discount") > 0.08, "CRITICAL").when(F.col("l_returnflag") == "R", "MAJOR").otherwise("MINOR")
    item = F.struct(
        F.col("l_linenumber").alias("line"), grave.alias("severity"), F.lit("LINE").alias("issue_type"), F.col("l_linenumber").cast("string").alias("paragraph_id"),
        F.col("l_returnflag").alias("description"), F.lit("check").alias("recommendation"),
    )
    found = lines.where("l_quantity > 10").groupBy(F.col("l_orderkey").cast("string").alias("section_id")).agg(F.array_sort(F.collect_list(item)).alias("issues"))
    reviews = found.select("section_id", F.lit("technical").alias("reviewer_type"), F.lit("REVISE").alias("decision"), F.lit("{}").alias("payload_json"), F.lit("t0").alias("created_at"), "issues")
    tables = _tables(spark, "reviews")
    records.save_reviews(tables, reviews)
    records.resolve_issues(tables, tables.read("review_issues").where("cast(paragraph_id as int) % 2 = 0").select("section_id", "issue_id"))
    worst = records.open_issues(tables).where("nth = 1").select("section_id", F.col("severity").alias("worst_open"))
    every = tables.read("review_issues").groupBy("section_id").agg(F.count("*").alias("n_issues"), F.count_if(F.col("status") == "OPEN").alias("n_open"))
    return every.join(worst, "section_id", "left").select(F.col("section_id").cast("long").alias("l_orderkey"), "n_issues", "n_open", "worst_open")


def edition_numbers(spark, sf_dir):
    """Orders as editions of customers, those of even keys first: numbers and parents."""
    orders = table(spark, sf_dir, "orders")
    at = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"))
    key = F.col("o_orderkey").cast("string")
    rows = orders.select(F.col("o_custkey").cast("string").alias("project_id"), key.alias("corpus_snapshot_id"), key.alias("report_plan_id"), key.alias("outline_id"), at.alias("created_at"), "o_orderkey")
    tables = _tables(spark, "editions")
    for rest in (0, 1):
        records.create_editions(tables, rows.where(F.col("o_orderkey") % 2 == rest).drop("o_orderkey"))
    made = tables.read("report_editions")
    parents = made.select(F.col("edition_id").alias("parent_edition_id"), F.col("corpus_snapshot_id").cast("long").alias("parent_orderkey"))
    out = made.join(parents, "parent_edition_id", "left").na.fill(0, ["parent_orderkey"])
    return out.select(F.col("corpus_snapshot_id").cast("long").alias("o_orderkey"), "edition_number", "parent_orderkey", "status")


def asset_counts(spark, sf_dir):
    """Lines as drawn assets of orders by their supplier, in two writes: what is rendered in the end."""
    lines = table(spark, sf_dir, "lineitem")
    status = F.when(F.col("l_returnflag") == "N", "RENDERED").when(F.col("l_returnflag") == "R", "FAILED").otherwise("PLANNED")
    rows = lines.select(
        F.col("l_orderkey").alias("section_id"), (F.col("l_suppkey") % 3).cast("string").alias("visual_type"), F.lit("t").alias("title"), F.lit("p").alias("path"), status.alias("status"), F.col("l_linenumber").alias("seq")
    )
    tables = _tables(spark, "assets")
    records.upsert_assets(tables, rows.where("seq <= 3"))
    return records.upsert_assets(tables, rows.where("seq > 3"))


def payload_updates(spark, sf_dir):
    """Orders as JSON inside of texts: recovered, changed in part, read with a schema."""
    orders = table(spark, sf_dir, "orders")
    made = F.to_json(F.struct(F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"), F.struct(F.year("o_orderdate").alias("year"), F.lit("} {").alias("mark")).alias("dates")))
    text = F.when(F.col("o_orderkey") % 3 == 0, made).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("Here it is:\n"), made, F.lit("\ndone"))).otherwise(F.concat(made, F.lit(" and {no json}")))
    rows = orders.select("o_orderkey", "o_orderpriority", text.alias("t")).select("o_orderkey", "o_orderpriority", payload.recover_object(F.col("t")).alias("p"))
    odd = F.col("o_orderkey") % 2 == 1
    rows = rows.withColumn("p", payload.with_fields(F.col("p"), {"status": F.when(odd, "X"), "note": F.when(odd, F.col("o_orderpriority"))}))
    read = {"status": "string", "note": "string", "total": "double"}
    out = [payload.field(F.col("p"), f"$.{c}", kind).alias(c) for c, kind in read.items()]
    return rows.select("o_orderkey", *out, payload.field(F.col("p"), "$.dates.year", "bigint").alias("year"), payload.field(F.col("p"), "$.dates.mark", "string").alias("mark"))


def _edition(spark, sf_dir):
    """Conversations as sections, assistant turns as claims, benchmark items as chunks and metrics of new sources."""
    turns, items = table(spark, sf_dir, "conversations"), table(spark, sf_dir, "benchmark")
    said = F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"))))
    sections = turns.groupBy("conv_id").agg(said.alias("s")).select(
        F.col("conv_id").alias("section_id"), F.get("s.text", F.lit(0)).alias("title"), F.lit("").alias("objective"), F.array_join("s.text", "\n\n").alias("content_markdown")
    )
    turn = F.col("turn")
    claims = turns.where("role = 'assistant'").select(
        F.col("conv_id").alias("section_id"), F.concat_ws("-", "conv_id", "turn").alias("claim_id"), F.col("text").alias("statement"), F.lit("FACT").alias("claim_type"),
        F.when((F.col("conv_id") + turn) % 4 == 3, "UNVERIFIED").otherwise("VERIFIED").alias("verification_status"),
        F.when((F.col("conv_id") + turn) % 9 == 5, F.array().cast("array<string>")).otherwise(F.array(F.lit("e"))).alias("evidence_ids"),
    )
    name = F.concat(F.lit("metric"), "item_id", F.lit(" "), F.regexp_extract("text", "[a-z]{9,}", 0))
    metrics = items.where("item_id % 5 = 0").select(F.col("item_id").alias("metric_id"), name.alias("name"), (F.col("item_id") % 30).cast("double").alias("change_value"))
    chunks = items.select(F.col("item_id").alias("chunk_id"), F.lit(1).alias("page"), F.col("item_id").alias("seq"), "text")
    return sections, claims, metrics, chunks


def impact_decision(spark, sf_dir):
    """What new sources do to every section."""
    found = impact.assess(*_edition(spark, sf_dir), least=6)
    return found.select("section_id", "decision", "replaces", "metric_hit", "chunk_hits", F.round("score", 4).alias("score"), "unsupported")


def claim_relations(spark, sf_dir):
    """Typed edges from claims to new metrics and texts."""
    _, claims, metrics, chunks = _edition(spark, sf_dir)
    return impact.relations(claims, metrics, chunks).na.fill(-1, ["metric_id"])


def section_run(spark, sf_dir):
    """A production run: customers as sections, their orders as facts; claims by section."""
    orders = table(spark, sf_dir, "orders")
    nodes = orders.select("o_custkey").distinct().join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    nodes = nodes.select(F.col("c_custkey").cast("string").alias("node_id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("objective"), F.col("c_custkey").alias("order"))
    key = F.col("o_orderkey").cast("string")
    facts = orders.where("o_orderstatus != 'F'").select(
        F.col("o_custkey").cast("string").alias("node_id"), F.lit("FACT").alias("kind"), F.col("o_orderkey").alias("seq"), F.concat(F.lit("order "), key, F.lit(" is "), "o_orderpriority").alias("statement"),
        F.concat(F.lit("SRC-"), key).alias("source_id"), F.lit(1).alias("page"), F.concat(F.lit("EV-"), key).alias("evidence_id"),
    )
    tables = _tables(spark, "run")
    EditionRun(tables, "E", wave_size=10_000_000).run(nodes, facts)
    found = tables.read("claims").groupBy("section_id").agg(F.count("*").alias("n_claims"), F.count_if(F.col("verification_status") == "VERIFIED").alias("n_verified"))
    version = tables.read("section_versions").select("section_id", "version")
    out = tables.read("sections").join(found, "section_id").join(version, "section_id")
    return out.select(F.col("node_id").cast("long").alias("c_custkey"), "status", "n_claims", "n_verified", "version")


def claim_places(spark, sf_dir):
    """The claim ledger: customers as claims that cite their orders, with evidence ids and places."""
    orders = table(spark, sf_dir, "orders")
    key = F.concat(F.lit("O"), F.col("o_orderkey").cast("string"))
    claims = table(spark, sf_dir, "customer").join(
        orders.where("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.collect_list(key).alias("evidence_ids")), F.col("c_custkey") == F.col("o_custkey"), "left"
    )
    claims = claims.select(F.col("c_custkey").alias("claim_id"), F.col("c_nationkey").alias("section_id"), F.coalesce("evidence_ids", F.array().cast("array<string>")).alias("evidence_ids"))
    owner = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("section_id"))
    evidence = orders.join(owner, "o_custkey").select("section_id", key.alias("evidence_id"), F.concat(F.lit("SRC"), F.col("o_custkey").cast("string")).alias("source_id"), (F.col("o_orderkey") % 7).cast("int").alias("page"))
    return report.claim_ledger(claims, evidence).select("claim_id", "evidence", "places")


def drawing_primitives(spark, sf_dir):
    """Lines as drawing operators of orders: what is left of them as lines and rectangles."""
    x0, y0 = F.col("l_quantity").cast("double"), F.pmod(F.col("l_partkey"), F.lit(50)).cast("double")
    x1, y1 = x0 + F.round(F.col("l_discount") * 100), y0 + F.round(F.col("l_tax") * 100)
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    op = F.get(F.array(*map(F.lit, ("l", "re", "c"))), (F.col("l_linenumber") % 4).cast("int"))
    points = F.when(op == "c", F.array(at(x1, y1), at(x0, x0), at(y1, y1), at(x0, y0))).otherwise(F.array(at(x0, y0), at(x1, y1)))
    items = F.when(op.isNull(), F.array().cast("array<struct<op:string,points:array<struct<x:double,y:double>>>>")).otherwise(F.array(F.struct(op.alias("op"), points.alias("points"))))
    path = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.struct(x0.alias("x0"), y0.alias("y0"), (x1 + 10).alias("x1"), (y1 + 10).alias("y1"), items.alias("items")).alias("p"))
    pages = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("source_id")).agg(F.array_sort(F.collect_list(path)).alias("p"))
    found = graphs.primitives(pages.select("source_id", F.lit(1).alias("page"), F.col("p.p").alias("paths")))
    size = F.when(F.col("kind") == "rect", (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).otherwise(F.col("px1") - F.col("px0"))
    return found.select(F.col("source_id").alias("l_orderkey"), F.col("seq").cast("long").alias("seq"), "kind", F.round(size, 4).alias("size"))


QUERIES = {f.__name__: f for f in (
    ingest_conversations, plan_records, review_records, edition_numbers, asset_counts, payload_updates, impact_decision, claim_relations, section_run,
    claim_places, drawing_primitives,
)}

_SAID = "string_agg(coalesce(text, ''), {0} ORDER BY turn, role, coalesce(text, ''))"
_TOK = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+|[가-힣]{{2,}}'))"
_EDITION = f"""
    sections AS (SELECT conv_id, first(coalesce(text, '') ORDER BY turn, role, coalesce(text, '')) AS title, {_SAID.format("chr(10) || chr(10)")} AS body FROM conversations GROUP BY conv_id),
    claims AS (SELECT conv_id, conv_id || '-' || turn AS claim_id, text, (conv_id + turn) % 4 = 3 OR (conv_id + turn) % 9 = 5 AS bare,
        list_transform(regexp_extract_all(coalesce(text, ''), '([0-9]+(?:\\.[0-9]+)?)\\s*%', 1), lambda x: x::DOUBLE) AS vals FROM conversations WHERE role = 'assistant'),
    metrics AS (SELECT item_id, 'metric' || item_id || ' ' || regexp_extract(text, '[a-z]{{9,}}', 0) AS name, (item_id % 30)::DOUBLE AS v FROM benchmark WHERE item_id % 5 = 0),
    mt AS (SELECT DISTINCT item_id, unnest({_TOK.format('name')}) AS t FROM metrics),
    ct AS (SELECT DISTINCT claim_id, unnest({_TOK.format('coalesce(text, chr(32))')}) AS t FROM claims),
    near AS (SELECT claim_id, min(item_id) AS item_id FROM ct JOIN mt USING (t) GROUP BY claim_id),
    head AS (SELECT DISTINCT unnest({_TOK.format('text')}) AS t FROM (SELECT text FROM benchmark ORDER BY item_id LIMIT 20)),
    backed AS (SELECT claim_id FROM ct JOIN head USING (t) GROUP BY claim_id HAVING count(*) >= 3),
    edges AS (
        SELECT conv_id AS section_id, c.claim_id, n.item_id AS metric_id, CASE WHEN n.item_id IS NULL THEN 'SUPPORTS'
            WHEN len(vals) > 0 AND NOT list_bool_or(list_transform(vals, lambda x: abs(x - v) < 0.01)) THEN 'REPLACES' ELSE 'EXTENDS' END AS relation
        FROM claims c LEFT JOIN near n USING (claim_id) LEFT JOIN metrics m ON m.item_id = n.item_id LEFT JOIN backed b ON b.claim_id = c.claim_id
        WHERE n.item_id IS NOT NULL OR b.claim_id IS NOT NULL
    )
"""

ORACLE_SQL = {
    "ingest_conversations": f"""
        WITH f AS (SELECT conv_id, string_split({_SAID.format("chr(12)")}, chr(12)) AS raw FROM conversations GROUP BY conv_id),
        p AS (SELECT conv_id, list_filter(list_transform(raw, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS parts FROM f)
        SELECT conv_id, 'READY' AS status, greatest(len(parts), 1)::BIGINT AS n_pages, len(parts)::BIGINT AS n_blocks, len(parts)::BIGINT AS n_chunks,
            coalesce(list_sum(list_transform(parts, lambda x: len(list_distinct(regexp_extract_all(lower(x), '[\\p{{L}}\\p{{N}}]+'))))), 0)::BIGINT AS n_postings, len(parts)::BIGINT AS n_vectors
        FROM p""",
    "plan_records": """
        WITH n AS (SELECT o_custkey, count(*) FILTER (o_custkey % 3 <> 0 OR o_orderstatus = 'F')::BIGINT AS n_nodes,
            coalesce(max(o_orderkey) FILTER (o_custkey % 3 <> 0 OR o_orderstatus = 'F'), 0) AS last_order FROM orders GROUP BY o_custkey)
        SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'new ' || c_custkey ELSE c_name END AS title, CASE WHEN c_custkey % 5 = 0 THEN 'new ' || c_custkey ELSE c_name END AS payload_title,
            'why' AS purpose, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS version, c_custkey % 2 = 0 AS approved, CASE WHEN c_custkey % 2 = 0 THEN 't1' END AS approved_at, n_nodes, last_order
        FROM customer JOIN n ON o_custkey = c_custkey""",
    "review_records": """
        WITH i AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0.08 THEN 1 WHEN l_returnflag = 'R' THEN 2 ELSE 3 END AS s FROM lineitem WHERE l_quantity > 10)
        SELECT l_orderkey, count(*)::BIGINT AS n_issues, count(*) FILTER (l_linenumber % 2 = 1)::BIGINT AS n_open,
            ['CRITICAL', 'MAJOR', 'MINOR'][min(s) FILTER (l_linenumber % 2 = 1)] AS worst_open FROM i GROUP BY l_orderkey""",
    "edition_numbers": """
        SELECT o_orderkey, row_number() OVER w AS edition_number, coalesce(lag(o_orderkey) OVER w, 0) AS parent_orderkey, 'PRODUCING' AS status FROM orders
        WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey % 2, o_orderdate::DATE, o_orderkey)""",
    "asset_counts": """
        WITH l AS (SELECT l_orderkey, l_suppkey % 3 AS kind, arg_max(CASE l_returnflag WHEN 'N' THEN 'RENDERED' WHEN 'R' THEN 'FAILED' ELSE 'PLANNED' END, (l_linenumber, CASE l_returnflag WHEN 'N' THEN 3 WHEN 'R' THEN 1 ELSE 2 END)) AS f FROM lineitem GROUP BY ALL)
        SELECT l_orderkey AS section_id, count(*)::BIGINT AS total, count_if(f = 'RENDERED')::BIGINT AS rendered, count_if(f = 'FAILED')::BIGINT AS failed FROM l GROUP BY 1""",
    "payload_updates": """
        WITH p AS (SELECT o_orderkey, json_object('status', o_orderstatus, 'total', o_totalprice, 'dates', json_object('year', year(o_orderdate), 'mark', '} {')) AS j, o_orderpriority AS note FROM orders),
        q AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 1 THEN json_merge_patch(j, json_object('status', 'X', 'note', note)) ELSE j END AS j FROM p)
        SELECT o_orderkey, j->>'$.status' AS status, j->>'$.note' AS note, (j->>'$.total')::DOUBLE AS total, (j->>'$.dates.year')::BIGINT AS year, j->>'$.dates.mark' AS mark FROM q""",
    "claim_relations": f"WITH {_EDITION} SELECT section_id, claim_id, relation, coalesce(metric_id, -1) AS metric_id FROM edges",
    "impact_decision": f"""
        WITH {_EDITION},
        src AS (SELECT conv_id AS doc_id, substr(body, 1, 4000) AS text FROM sections WHERE trim(substr(body, 1, 4000), ' ') <> ''
            UNION ALL SELECT -1, substr(string_agg(text, chr(10) ORDER BY item_id), 1, 4000) FROM benchmark),
        toks AS (
            SELECT doc_id, unnest(list_concat(regexp_extract_all(lower(text), '[a-z0-9]+|[가-힣]{{2,}}'),
                CASE WHEN length(head) > 1 THEN list_transform(range(1, length(head)), lambda i: substr(head, i, 2)) ELSE [] END)) AS t
            FROM (SELECT doc_id, text, substr(regexp_replace(text, '\\s', '', 'g'), 1, 201) AS head FROM src)
        ),
        weights AS (SELECT doc_id, ('0x' || substr(md5(t), 31, 2))::BIGINT AS dim, sum(CASE WHEN (('0x' || substr(md5(t), 30, 1))::BIGINT & 1) = 1 THEN 1 ELSE -1 END)::BIGINT AS w FROM toks GROUP BY ALL),
        cosines AS (SELECT a.doc_id, round(sum(a.w * coalesce(q.w, 0)) / sqrt(sum(a.w * a.w)::DOUBLE * (SELECT sum(w * w) FROM weights WHERE doc_id = -1)::DOUBLE), 6) AS c
            FROM weights a LEFT JOIN (SELECT * FROM weights WHERE doc_id = -1) q USING (dim) WHERE a.doc_id <> -1 GROUP BY a.doc_id HAVING sum(a.w * a.w) > 0),
        shared AS (
            SELECT conv_id, count(*) AS n, max(k) / 10.0 AS best FROM (
                SELECT conv_id, item_id, len(list_intersect({_TOK.format("s.title || chr(10)")}, {_TOK.format('b.text')})) AS k FROM sections s, benchmark b)
            WHERE k >= 6 GROUP BY conv_id),
        hit AS (SELECT DISTINCT conv_id FROM sections WHERE len(list_intersect({_TOK.format("title || ' ' || body")}, (SELECT list(DISTINCT t) FROM mt))) > 0),
        replaced AS (SELECT DISTINCT section_id FROM edges WHERE relation = 'REPLACES'),
        bare AS (SELECT conv_id, count(*) AS n FROM claims WHERE bare GROUP BY conv_id),
        facts AS (
            SELECT s.conv_id, r.section_id IS NOT NULL AS replaces, h.conv_id IS NOT NULL AS metric_hit, coalesce(o.n, 0) AS chunk_hits,
                greatest(coalesce(o.best, 0)::DOUBLE, coalesce(c, 0)::DOUBLE) AS score, coalesce(b.n, 0) AS unsupported
            FROM sections s LEFT JOIN replaced r ON r.section_id = s.conv_id LEFT JOIN hit h ON h.conv_id = s.conv_id LEFT JOIN shared o ON o.conv_id = s.conv_id
                LEFT JOIN cosines ON doc_id = s.conv_id LEFT JOIN bare b ON b.conv_id = s.conv_id
        ),
        rules AS (SELECT * FROM (VALUES (1, 'FULL_REWRITE'), (2, 'PARTIAL_REWRITE'), (3, 'LIGHT_EDIT'), (4, 'UPDATE_CITATION'), (5, 'KEEP')) AS t(rule, decision)),
        met AS (
            SELECT conv_id, min(rule) AS rule FROM facts, rules WHERE (rule = 1 AND replaces) OR (rule = 2 AND (metric_hit OR chunk_hits >= 2 OR score >= 0.35))
                OR (rule = 3 AND unsupported > 0) OR (rule = 4 AND (score >= 0.15 OR chunk_hits = 1)) OR rule = 5 GROUP BY conv_id
        )
        SELECT conv_id AS section_id, decision, replaces, metric_hit, chunk_hits::BIGINT AS chunk_hits, round(score, 4) AS score, unsupported::BIGINT AS unsupported
        FROM facts JOIN met USING (conv_id) JOIN rules USING (rule)""",
    "section_run": """
        SELECT c_custkey, 'DRAFT' AS status, (2 + least(count(*) FILTER (o_orderstatus <> 'F'), 6))::BIGINT AS n_claims,
            least(count(*) FILTER (o_orderstatus <> 'F'), 6)::BIGINT AS n_verified, 1::BIGINT AS version FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey""",
    "claim_places": """
        SELECT c_custkey AS claim_id, coalesce(string_agg(DISTINCT 'O' || o_orderkey, ',' ORDER BY 'O' || o_orderkey), '') AS evidence,
            coalesce(string_agg(DISTINCT 'SRC' || o_custkey || ':p.' || (o_orderkey % 7), ',' ORDER BY 'SRC' || o_custkey || ':p.' || (o_orderkey % 7)), '') AS places
        FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'O') ON o_custkey = c_custkey GROUP BY c_custkey""",
    "drawing_primitives": """
        WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_linenumber % 4 AS op, l_quantity::DOUBLE AS x0, (l_partkey % 50)::DOUBLE AS y0, round(l_discount * 100)::DOUBLE AS w, round(l_tax * 100)::DOUBLE AS h FROM lineitem),
        i AS (
            SELECT *, 0 AS part, 'line' AS kind, w AS size FROM b WHERE op = 0 AND w + h >= 8
            UNION ALL SELECT *, 0, 'rect', w * h FROM b WHERE op = 1 AND w * h >= 40
            UNION ALL SELECT *, 0, 'line', 0 - w FROM b WHERE op = 2
            UNION ALL SELECT *, 1, 'rect', (w + 10) * (h + 10) FROM b WHERE op <> 1 AND (w + 10) * (h + 10) >= 200
        )
        SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, part) - 1 AS seq, kind, round(size, 4) AS size FROM i""",
}
