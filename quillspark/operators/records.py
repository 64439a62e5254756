"""Records of plans, reviews, editions and visuals in versioned tables; many at a time, in one write per table.

Times are given by the caller, and ids follow from content, so that a repeated write gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import content_id
from ..sources.versioned import VersionedTables
from .payload import with_fields
from .tables import patch

PLAN_FIELDS = ["title", "subtitle", "purpose", "target_reader", "report_summary"]
SEVERITIES = ("CRITICAL", "MAJOR", "MINOR")


def _nodes(rows: DataFrame, outline_id: Column) -> DataFrame:
    """Outline nodes (node_id, parent_id, level, order, title, objective), with all of a node as payload."""
    node = rows.select(outline_id.alias("outline_id"), F.explode("outline").alias("n")).select("outline_id", "n.*", F.to_json("n").alias("payload_json"))
    return node.select("node_id", "outline_id", "parent_id", "level", "order", "title", "objective", "payload_json")


def save_plans(tables: VersionedTables, plans: DataFrame) -> None:
    """Plans (project_id, snapshot_id, title, subtitle, purpose, target_reader, report_summary, created_at, outline): a plan row
    with its payload, an outline of version 1 that is not approved, and its nodes."""
    rows = plans.withColumn("plan_id", content_id("PLN", "project_id", "snapshot_id", "title", "created_at"))
    rows = rows.withColumn("outline_id", content_id("OUT", "plan_id"))
    payload = F.to_json(F.struct(*PLAN_FIELDS, "outline"))
    tables.append("report_plans", rows.select("plan_id", "project_id", "snapshot_id", *PLAN_FIELDS, payload.alias("payload_json"), "created_at"), key="plan_id")
    outlines = rows.select("outline_id", "plan_id", F.lit(1).cast("long").alias("version"), F.lit(False).alias("approved"), F.lit(None).cast("string").alias("approved_at"))
    tables.append("outlines", outlines, key="outline_id")
    tables.append("outline_nodes", _nodes(rows, F.col("outline_id")), key="outline_id")


def replace_nodes(tables: VersionedTables, outlines: DataFrame) -> None:
    """New nodes of outlines (outline_id, outline): the old ones go, also where the new list is empty; the version rises by one."""
    old = tables.read("outlines")
    known = outlines.join(old.select("outline_id"), "outline_id", "left_semi")
    emptied = known.where(F.size("outline") == 0).select("outline_id")
    tables.replace_keys("outline_nodes", _nodes(known, F.col("outline_id")), "outline_id")
    if not emptied.isEmpty():
        tables.delete_keys("outline_nodes", emptied)
    bump = old.join(known.select("outline_id").distinct(), "outline_id", "left_semi").withColumn("version", F.col("version") + 1)
    tables.upsert("outlines", bump, ["outline_id"])


def approve(tables: VersionedTables, outline_ids: DataFrame, at: str) -> None:
    rows = tables.read("outlines").join(outline_ids.select("outline_id").distinct(), "outline_id", "left_semi")
    tables.upsert("outlines", rows.withColumns({"approved": F.lit(True), "approved_at": F.lit(at)}), ["outline_id"])


def update_plans(tables: VersionedTables, changes: DataFrame) -> None:
    """Partial update of plans (plan_id and some of the plan's fields; null leaves a field); the payload follows the columns."""
    fields = [c for c in PLAN_FIELDS if c in changes.columns]
    touched = tables.read("report_plans").join(changes.select("plan_id").distinct(), "plan_id", "left_semi")
    rows = patch(touched, changes, "plan_id", fields)
    synced = with_fields(F.col("payload_json"), {c: F.col(c) for c in fields})
    tables.upsert("report_plans", rows.withColumn("payload_json", synced), ["plan_id"])


def save_reviews(tables: VersionedTables, reviews: DataFrame) -> None:
    """Reviews (section_id, reviewer_type, decision, payload_json, created_at, issues) and their issues, which start OPEN."""
    rows = reviews.withColumn("review_id", content_id("RV", "section_id", "reviewer_type", "created_at"))
    tables.append("reviews", rows.select("review_id", "section_id", "reviewer_type", "decision", "payload_json", "created_at"), key="section_id")
    found = rows.select("review_id", "section_id", "reviewer_type", F.posexplode("issues").alias("pos", "i"))
    issues = found.select(
        content_id("ISS", "review_id", "pos").alias("issue_id"), "review_id", "section_id", "reviewer_type", "i.severity", "i.issue_type",
        "i.paragraph_id", "i.description", "i.recommendation", F.lit("OPEN").alias("status"),
    )
    tables.append("review_issues", issues, key="section_id")


def resolve_issues(tables: VersionedTables, issue_ids: DataFrame) -> None:
    """Mark issues (issue_id, section_id) RESOLVED; the section says which buckets hold them. Unknown ids mean nothing."""
    keys = [c for c in ("section_id", "issue_id") if c in issue_ids.columns]
    tables.set_values("review_issues", issue_ids.select(*keys), {"status": F.lit("RESOLVED")})


def open_issues(tables: VersionedTables) -> DataFrame:
    """Open issues with ``nth``: their place in their section by severity, the gravest first."""
    grave = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    order = Window.partitionBy("section_id").orderBy(F.when(grave == 0, 99).otherwise(grave), "issue_id")
    return tables.read("review_issues").where("status = 'OPEN'").withColumn("nth", F.row_number().over(order))


def _numbered(old: DataFrame | None, new: DataFrame, key: str, number: str, order: list[str]) -> DataFrame:
    """New rows with the numbers that follow the highest one of their key."""
    at = F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long")
    if old is None:
        return new.withColumn(number, at)
    last = old.groupBy(key).agg(F.max(number).alias("_last"))
    return new.withColumn("_at", at).join(last, key, "left").withColumn(number, F.coalesce("_last", F.lit(0)) + F.col("_at")).drop("_at", "_last")


def _append_numbered(tables: VersionedTables, name: str, rows: DataFrame, key: str, number: str, order: list[str]) -> None:
    """Numbers are taken from the very version that the rows are added to, so that two writers never give the same one."""

    def change(old: DataFrame | None) -> DataFrame:
        new = _numbered(old, rows, key, number, order)
        return new if old is None else old.unionByName(new)

    tables.transact(name, change, key=key)


def create_snapshots(tables: VersionedTables, corpora: DataFrame) -> None:
    """Snapshots of corpora (project_id, created_at, source_ids): numbered within a project, with a row per source."""
    rows = corpora.withColumn("snapshot_id", content_id("SNP", "project_id", "created_at"))
    _append_numbered(tables, "corpus_snapshots", rows.select("snapshot_id", "project_id", "created_at"), "project_id", "snapshot_number", ["created_at", "snapshot_id"])
    tables.append("corpus_snapshot_sources", rows.select("snapshot_id", F.explode(F.array_distinct("source_ids")).alias("source_id")), key="snapshot_id")


def create_editions(tables: VersionedTables, editions: DataFrame) -> None:
    """Editions (project_id, corpus_snapshot_id, report_plan_id, outline_id, created_at): numbered within a project, PRODUCING,
    each the child of the project's edition before it."""
    rows = editions.withColumns({"edition_id": content_id("ED", "project_id", "corpus_snapshot_id", "created_at"), "status": F.lit("PRODUCING")})

    def change(old: DataFrame | None) -> DataFrame:
        new = _numbered(old, rows, "project_id", "edition_number", ["created_at", "edition_id"]).withColumn("parent_edition_id", F.lit(None).cast("string"))
        every = new if old is None else old.unionByName(new)
        before = F.lag("edition_id").over(Window.partitionBy("project_id").orderBy("edition_number"))
        return every.withColumn("parent_edition_id", before)

    tables.transact("report_editions", change, key="project_id")


def add_section_versions(tables: VersionedTables, sections: DataFrame) -> None:
    """The present text of sections (section_id, content_markdown, reason, created_at) as their next versions."""
    _append_numbered(tables, "section_versions", sections, "section_id", "version", ["created_at"])


def set_status(tables: VersionedTables, name: str, key: str, changes: DataFrame) -> None:
    """Status of rows (key, status); null leaves it."""
    base = tables.read(name)
    touched = base.join(changes.select(key).distinct(), key, "left_semi")
    tables.upsert(name, patch(touched, changes, key, ["status"]), [key])


def upsert_assets(tables: VersionedTables, assets: DataFrame) -> DataFrame:
    """Visual assets (section_id, visual_type, title, path, status, seq): the last of each section and type stays. Gives (section_id, total,
    rendered, failed) of what is then there."""
    tables.upsert("visual_assets", assets, ["section_id", "visual_type"], key="section_id", order=[F.col(c) for c in ("seq", "title", "path", "status")])
    return asset_counts(tables)


def asset_counts(tables: VersionedTables) -> DataFrame:
    return tables.read("visual_assets").groupBy("section_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "RENDERED").alias("rendered"), F.count_if(F.col("status") == "FAILED").alias("failed")
    )
