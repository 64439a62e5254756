"""Assembly of what a reader looks at: pages, claim locations, specs of diagrams, outline nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import content_id

# Limits of a drawn diagram, and the sentences of a recommended node.
STEPS, STEP_CHARS, NODES, NODE_CHARS, EDGES = 12, 36, 16, 40, 24
FALLBACK_BLOCKS = 3
OBJECTIVE = (
    "에 대해 ", " 자료를 바탕으로, 근거 있는 사실과 그에 대한 전문 분석을 서술한다. 수치·구체 사실은 출처를 밝히고, 자료에서 확인되지 않은 내용은 한계·미확인으로 명시한다.",
)
QUESTIONS = ("에서 확인할 핵심 사실과 분석 포인트는 무엇인가?", " 관련 자료 공백·한계는 무엇인가?")


def page_details(pages: DataFrame, blocks: DataFrame, metrics: DataFrame, structures: DataFrame) -> DataFrame:
    """Pages (source_id, page, ...) with blocks in reading order, metrics and structure facts as lists, and their text."""
    key = ["source_id", "page"]
    held = blocks.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("seq", "block_id", "block_type", "text"))).alias("blocks"))
    facts = metrics.withColumnRenamed("page_number", "page").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("seq", "metric_id", "name"))).alias("metrics"))
    drawn = structures.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("fact_id", "kind", "confidence"))).alias("structures"))
    out = pages
    for part in (held, facts, drawn):
        out = out.join(part, key, "left")
    none = {"blocks": held, "metrics": facts, "structures": drawn}
    out = out.withColumns({c: F.coalesce(c, F.array().cast(part.schema[c].dataType)) for c, part in none.items()})
    said = F.filter("blocks", lambda b: b["block_type"] != "IMAGE")
    return out.withColumn("text", F.array_join(F.transform(said, lambda b: b["text"]), "\n"))


def claim_locations(claims: DataFrame, evidence: DataFrame, blocks: DataFrame) -> DataFrame:
    """(claim_id, evidence_id, source_id, page, nth, block_id, text): where the evidence (evidence_id, source_id, page, block_ids) of
    claims (claim_id, evidence_ids) stands: its blocks on that page, or the first three of the page where it names none."""
    cited = claims.select("claim_id", F.explode("evidence_ids").alias("evidence_id")).join(evidence, "evidence_id")
    page = blocks.withColumn("_k", F.row_number().over(Window.partitionBy("source_id", "page").orderBy("seq", "block_id")))
    named = F.size(F.coalesce("block_ids", F.array().cast("array<string>"))) > 0
    met = cited.join(page.select("source_id", "page", "_k", "block_id", "text"), ["source_id", "page"], "left")
    met = met.where(F.col("block_id").isNull() | F.when(named, F.array_contains("block_ids", F.col("block_id"))).otherwise(F.col("_k") <= FALLBACK_BLOCKS))
    nth = F.row_number().over(Window.partitionBy("claim_id", "evidence_id").orderBy("_k"))
    return met.select("claim_id", "evidence_id", "source_id", "page", nth.alias("nth"), "block_id", "text")


def citation_targets(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(claim_id, source_id, page, evidence_id) of all evidence of claims."""
    cited = claims.select("claim_id", F.explode("evidence_ids").alias("evidence_id"))
    return cited.join(evidence.select("evidence_id", "source_id", "page"), "evidence_id").select("claim_id", "source_id", "page", "evidence_id")


def _best(rows: DataFrame) -> DataFrame:
    """The first usable fact of a project: by falling confidence, then page, then id."""
    place = F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc_nulls_last("confidence"), "page", "fact_id"))
    return rows.withColumn("_k", place).where("_k = 1").drop("_k")


def process_specs(facts: DataFrame) -> DataFrame:
    """(project_id, title, steps, page) from the first PROCESS fact with two steps or more: labels of 2 to 36 characters, twelve at
    most. Facts are (project_id, fact_id, kind, title, page, confidence, nodes array<struct<node_id, label, group>>, edges)."""
    labels = F.transform(F.filter("nodes", lambda n: F.coalesce(n["label"], F.lit("")) != ""), lambda n: F.trim(n["label"]))
    steps = F.slice(F.filter(labels, lambda s: F.length(s).between(2, STEP_CHARS)), 1, STEPS)
    rows = facts.where("kind = 'PROCESS'").withColumn("steps", steps).where(F.size("steps") >= 2)
    return _best(rows).select("project_id", "title", "steps", "page")


def architecture_specs(facts: DataFrame) -> DataFrame:
    """(project_id, title, nodes, edges, page) from the first ARCHITECTURE fact with two labelled nodes or more. Edges between its
    labelled nodes stay, named by label or else medium; sixteen nodes and 24 edges are shown."""
    named = F.filter("nodes", lambda n: F.trim(F.coalesce(n["label"], F.lit(""))) != "")
    nodes = F.transform(named, lambda n, i: F.struct(F.coalesce(n["node_id"], F.concat(F.lit("N"), i.cast("string"))).alias("id"), F.substring(F.trim(n["label"]), 1, NODE_CHARS).alias("label"), n["group"].alias("group")))
    rows = facts.where("kind = 'ARCHITECTURE'").withColumn("_nodes", nodes).where(F.size("_nodes") >= 2)
    ids = F.transform("_nodes", lambda n: n["id"])
    linked = F.filter("edges", lambda e: F.array_contains(ids, e["src"]) & F.array_contains(ids, e["dst"]) & (e["src"] != e["dst"]))
    edges = F.transform(linked, lambda e: F.struct(e["src"].alias("src"), e["dst"].alias("dst"), F.coalesce(e["label"], e["medium"]).alias("label")))
    rows = rows.withColumn("_edges", F.coalesce(edges, F.array().cast("array<struct<src:string,dst:string,label:string>>")))
    return _best(rows).select("project_id", "title", F.slice("_nodes", 1, NODES).alias("nodes"), F.slice("_edges", 1, EDGES).alias("edges"), "page")


def recommend(nodes: DataFrame, analyses: DataFrame) -> DataFrame:
    """Outline nodes (project_id, node_id, title, analysis_questions) with the objective that follows from their project's main topic
    (project_id, main_topic), and two questions where they have none."""
    topic = F.when(F.coalesce("main_topic", F.lit("")) == "", "본").otherwise(F.col("main_topic"))
    objective = F.concat("title", F.lit(OBJECTIVE[0]), topic, F.lit(OBJECTIVE[1]))
    asked = F.array(*(F.concat("title", F.lit(q)) for q in QUESTIONS))
    have = F.size(F.coalesce("analysis_questions", F.array().cast("array<string>"))) > 0
    out = nodes.join(analyses.select("project_id", "main_topic"), "project_id")
    return out.withColumns({"objective": objective, "analysis_questions": F.when(have, F.col("analysis_questions")).otherwise(asked)}).drop("main_topic")


def normalize_plan(nodes: DataFrame, scope: Column) -> DataFrame:
    """Nodes (plan_id, pos, node_id, order, title, source_scope): ids from content and orders by place where they are missing, and
    the plan's sources where a node names none."""
    place = F.row_number().over(Window.partitionBy("plan_id").orderBy("pos"))
    empty = F.size(F.coalesce("source_scope", F.array().cast("array<string>"))) == 0
    rows = nodes.withColumn("_place", place)
    return rows.withColumns({
        "node_id": F.when(F.coalesce("node_id", F.lit("")) == "", content_id("N", "plan_id", "_place", "title")).otherwise(F.col("node_id")),
        "order": F.when(F.coalesce("order", F.lit(0)) <= 0, F.col("_place")).otherwise(F.col("order")),
        "source_scope": F.when(empty, scope).otherwise(F.col("source_scope")),
    }).drop("_place")


def renumber(nodes: DataFrame, key: str = "outline_id") -> DataFrame:
    """Orders 1, 2, 3 ... as the nodes stand; equal orders by node."""
    return nodes.withColumn("order", F.row_number().over(Window.partitionBy(key).orderBy("order", "node_id")))


def pixels_to_points(box: Column, dpi: int | None) -> Column:
    """A box (x0, y0, x1, y1) of a page image in points; a missing or zero resolution counts as 72."""
    scale = 72.0 / float(dpi or 72)
    return F.struct(*((box[c] * scale).alias(c) for c in ("x0", "y0", "x1", "y1")))


def lexicon_words(text: Column) -> Column:
    """array<string>: the parts of a text that may correct recognised lines, once each: split at line ends, bars, slashes and
    dashes, white space collapsed, 2 to 36 characters."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"[\n|/·\-–—]+"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))
    return F.array_distinct(F.filter(parts, lambda p: F.length(p).between(2, 36)))


def structure_payload(facts: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Structure facts with their nodes and edges as lists and as one JSON payload."""
    key = ["source_id", "page"]
    n = nodes.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("idx", "node_id", "label", F.lit(None).cast("string").alias("group")))).alias("_n"))
    e = edges.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("seq", "src", "dst", "label", "medium", "confidence"))).alias("_e"))
    out = facts.join(n, key, "left").join(e, key, "left")
    out = out.withColumns({"nodes": F.transform("_n", lambda x: x.dropFields("idx")), "edges": F.transform("_e", lambda x: x.dropFields("seq"))})
    return out.withColumn("payload_json", F.to_json(F.struct("kind", "nodes", "edges"))).drop("_n", "_e")
