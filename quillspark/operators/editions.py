"""Report editions: diffs, incremental rewriting, outlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .ordering import latest_per_key


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Sections (title, body, seq) of two editions by title: ADDED, REMOVED, UNCHANGED or MODIFIED.

    Of equal titles the last counts; bodies are compared without outer white space. Modified sections say how many
    percent values came and went.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        return latest_per_key(df.select("title", "body", "seq"), ["title"], [F.col("seq")]).select("title", F.col("body").alias(name))

    both = side(old, "was").join(side(new, "now"), "title", "full_outer")
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    status = (
        F.when(F.col("was").isNull(), "ADDED").when(F.col("now").isNull(), "REMOVED")
        .when(strip(F.col("was")) == strip(F.col("now")), "UNCHANGED").otherwise("MODIFIED")
    )
    a, b = (T.percents(F.coalesce(c, F.lit(""))) for c in ("was", "now"))
    return both.select("title", status.alias("status"), F.size(F.array_except(b, a)).alias("numbers_added"), F.size(F.array_except(a, b)).alias("numbers_removed"))


def new_sources(current: DataFrame, snapshot: DataFrame, key: str = "source_id") -> DataFrame:
    return current.join(snapshot.select(key).distinct(), key, "left_anti")


def incremental(nodes: DataFrame, parent: DataFrame, decisions: DataFrame) -> DataFrame:
    """What each outline node of a new edition does: REWRITE, INHERIT or ADD_SECTION, with the inherited body.

    The parent's section is found by node id, else by title.
    """
    by_id = parent.select("node_id", F.struct("section_id", "body").alias("_a"))
    by_title = parent.groupBy("title").agg(F.min(F.struct("section_id", "body")).alias("_b"))
    rows = nodes.join(by_id, "node_id", "left").join(by_title, "title", "left").withColumn("_p", F.coalesce("_a", "_b"))
    rows = rows.withColumn("section_id", F.col("_p.section_id")).join(decisions.select("section_id", "decision"), "section_id", "left")
    rewrite = F.col("decision").isin("FULL_REWRITE", "PARTIAL_REWRITE", "LIGHT_EDIT", "UPDATE_CITATION")
    action = F.when(F.col("_p").isNull(), "ADD_SECTION").when(rewrite, "REWRITE").otherwise("INHERIT")
    return rows.select("node_id", "title", "section_id", action.alias("action"), F.when(action == "INHERIT", F.col("_p.body")).alias("body"))


#: States of a section that is not finished; fixed values.
UNFINISHED = ("RESEARCHING", "WRITING", "REVISING", "PENDING", "FAILED")


def is_complete() -> Column:
    """A section that a resumed run skips: in no unfinished state (in any case of letters), its text 40 characters or more."""
    state = F.upper(F.coalesce("status", F.lit("")))
    body = F.regexp_replace(F.coalesce("content_markdown", F.lit("")), r"^\s+|\s+$", "")
    return ~state.isin(*UNFINISHED) & (F.length(body) >= 40)


def subtree(nodes: DataFrame, root: str) -> DataFrame:
    """Ids of a node and everything under it."""
    return nodes.sparkSession.sql(
        "WITH RECURSIVE t(node_id, depth) AS (SELECT node_id, 0 FROM {nodes} WHERE node_id = {root} UNION ALL "
        "SELECT n.node_id, t.depth + 1 FROM {nodes} n JOIN t ON n.parent_id = t.node_id) SELECT node_id, depth FROM t",
        nodes=nodes.select("node_id", "parent_id"),
        root=root,
    )


def without_subtree(nodes: DataFrame, root: str) -> DataFrame:
    return nodes.join(subtree(nodes, root).select("node_id"), "node_id", "left_anti")
