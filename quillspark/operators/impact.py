"""What new sources mean for the sections and claims of an edition: an edge table of typed relations, and a decision per section.

Sections are (section_id, title, objective, content_markdown), claims (section_id, claim_id, statement, claim_type,
verification_status, evidence_ids), new metrics (metric_id, name, change_value) and new chunks (chunk_id, page, seq, text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .joins import token_overlap
from .retrieval import token_weights

# How many shared tokens make a chunk or a text related, how much of a text is embedded, and the scores.
CHUNK_TOKENS, TEXT_TOKENS, FIRST_CHUNKS, EMBEDDED_CHARS = 2, 3, 20, 4000
STRONG, WEAK, SAME_VALUE = 0.35, 0.15, 0.01


def _tokens(df: DataFrame, key: list[str], text: Column) -> DataFrame:
    return df.select(*key, F.explode(T.overlap_tokens(text)).alias("token"))


def _focus() -> Column:
    return F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("objective", F.lit("")))


def relations(claims: DataFrame, metrics: DataFrame, chunks: DataFrame) -> DataFrame:
    """(section_id, claim_id, relation, metric_id): edges from claims to what is new.

    The first metric (by id) that shares a token with a claim's statement REPLACES it where the statement has percent values
    and the metric's change is none of them, and EXTENDS it otherwise. A claim without such a metric is SUPPORTED by
    three tokens or more of the first twenty chunks. Of each token only its first metric travels, so a common word makes no
    pairs.
    """
    said = _tokens(claims, ["claim_id"], F.col("statement"))
    first = _tokens(metrics, ["metric_id"], F.col("name")).groupBy("token").agg(F.min("metric_id").alias("metric_id"))
    met = said.join(first, "token").groupBy("claim_id").agg(F.min("metric_id").alias("metric_id"))
    met = met.join(metrics.select("metric_id", F.col("change_value").cast("double")), "metric_id")
    head = chunks.orderBy("page", "seq", "chunk_id").limit(FIRST_CHUNKS)
    new = _tokens(head, [], F.col("text")).distinct()
    shared = said.join(new, "token").groupBy("claim_id").agg(F.count("*").alias("shared")).where(F.col("shared") >= TEXT_TOKENS)
    rows = claims.select("section_id", "claim_id", T.percents(F.coalesce("statement", F.lit(""))).alias("values"))
    rows = rows.join(met, "claim_id", "left").join(shared, "claim_id", "left")
    other = F.col("change_value").isNotNull() & (F.size("values") > 0) & ~F.exists("values", lambda v: F.abs(v - F.col("change_value")) < SAME_VALUE)
    relation = F.when(F.col("metric_id").isNotNull(), F.when(other, "REPLACES").otherwise("EXTENDS")).when(F.col("shared").isNotNull(), "SUPPORTS")
    return rows.select("section_id", "claim_id", relation.alias("relation"), "metric_id").where("relation IS NOT NULL")


def unsupported(claims: DataFrame) -> DataFrame:
    """Claims (section_id, claim_id) that nothing holds up."""
    bare = (F.col("verification_status") == "UNVERIFIED") | (F.col("claim_type") == "UNSUPPORTED") | (F.size(F.coalesce("evidence_ids", F.array().cast("array<string>"))) == 0)
    return claims.where(F.coalesce(bare, F.lit(False))).select("section_id", "claim_id")


def text_similarity(sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """(section_id, similarity): cosine of a section's text with all new text in order; of each the first 4000 characters."""
    # A chunk adds a character at least, so that no more of them can be among those.
    head = chunks.orderBy("page", "seq", "chunk_id").limit(EMBEDDED_CHARS).select(F.struct("page", "seq", "chunk_id", "text").alias("c"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["text"]), "\n")
    blob = head.agg(F.substring(joined, 1, EMBEDDED_CHARS).alias("text")).withColumn("q", F.lit(1))
    sought = token_weights(blob, ["q"]).select("dim", F.col("weight").alias("sought"))  # 256 rows at most
    norm = sought.agg(F.sum(F.col("sought") * F.col("sought")).alias("asked2"))
    bodies = sections.select("section_id", F.substring("content_markdown", 1, EMBEDDED_CHARS).alias("text")).where(F.trim("text") != "")
    weights = token_weights(bodies, ["section_id"]).join(F.broadcast(sought), "dim", "left").groupBy("section_id").agg(
        F.sum(F.col("weight") * F.coalesce("sought", F.lit(0))).alias("dot"), F.sum(F.col("weight") * F.col("weight")).alias("norm2")
    )
    cosine = F.col("dot") / F.sqrt(F.col("norm2").cast("double") * F.col("asked2").cast("double"))
    return weights.crossJoin(F.broadcast(norm)).select("section_id", F.round(cosine, 6).alias("similarity"))  # one row


def decide() -> Column:
    """Decision from replaces, metric_hits, chunk_hits, score and unsupported."""
    return (
        F.when(F.col("replaces"), "FULL_REWRITE")
        .when(F.col("metric_hit"), "PARTIAL_REWRITE")
        .when((F.col("chunk_hits") >= 2) | (F.col("score") >= STRONG), "PARTIAL_REWRITE")
        .when(F.col("unsupported") > 0, "LIGHT_EDIT")
        .when((F.col("score") >= WEAK) | (F.col("chunk_hits") == 1), "UPDATE_CITATION")
        .otherwise("KEEP")
    )


def assess(sections: DataFrame, claims: DataFrame, metrics: DataFrame, chunks: DataFrame, edges: DataFrame | None = None, least: int = CHUNK_TOKENS) -> DataFrame:
    """(section_id, decision, replaces, metric_hit, chunk_hits, score, unsupported); ``edges`` is the table of relations,
    if it has been written. Without a new chunk or metric every section is kept."""
    edges = relations(claims, metrics, chunks) if edges is None else edges
    replaced = edges.where("relation = 'REPLACES'").select("section_id").distinct().withColumn("replaces", F.lit(True))
    # A section needs one name's token: only distinct tokens of the names travel.
    everything = F.concat_ws("\n", _focus(), F.coalesce("content_markdown", F.lit("")))
    names = _tokens(metrics, [], F.col("name")).distinct()
    named = _tokens(sections, ["section_id"], everything).join(names, "token", "left_semi").select("section_id").distinct().withColumn("metric_hit", F.lit(True))
    focus = sections.select("section_id", _focus().alias("focus"))
    shared = token_overlap(chunks.select("chunk_id", "text"), focus, "chunk_id", "section_id", least, "text", "focus")
    hits = shared.groupBy("section_id").agg(F.count("*").alias("chunk_hits"), (F.max("shared") / 10.0).alias("overlap"))
    bare = unsupported(claims).groupBy("section_id").agg(F.count("*").alias("unsupported"))
    rows = sections.select("section_id")
    for part in (replaced, named, hits, text_similarity(sections, chunks), bare):
        rows = rows.join(part, "section_id", "left")
    rows = rows.na.fill(False, ["replaces", "metric_hit"]).na.fill(0, ["chunk_hits", "unsupported", "overlap", "similarity"])
    rows = rows.withColumn("score", F.greatest("overlap", "similarity"))
    any_new = F.broadcast(chunks.select(F.lit(1).alias("x")).unionByName(metrics.select(F.lit(1).alias("x"))).agg((F.count("*") > 0).alias("_any")))  # one row
    decision = F.when(F.col("_any"), decide()).otherwise("KEEP")
    return rows.crossJoin(any_new).select("section_id", decision.alias("decision"), "replaces", "metric_hit", "chunk_hits", "score", "unsupported")


def affected(decisions: DataFrame, edges: DataFrame, claims: DataFrame) -> DataFrame:
    """(section_id, claim_id) to look at again: claims with a relation; in lightly edited sections those that nothing holds up."""
    light = decisions.where("decision = 'LIGHT_EDIT'").select("section_id")
    bare = unsupported(claims).join(light, "section_id", "left_semi")
    return edges.join(light, "section_id", "left_anti").select("section_id", "claim_id").unionByName(bare)


def preview(sections: DataFrame, claims: DataFrame, current: DataFrame, snapshot: DataFrame, metrics: DataFrame, chunks: DataFrame) -> DataFrame:
    """Decisions on the sources of ``current`` (source_id) that a snapshot (source_id) lacks; nothing is written.

    metrics and chunks are those of all sources, with source_id.
    """
    fresh = current.select("source_id").distinct().join(snapshot.select("source_id").distinct(), "source_id", "left_anti")
    return assess(sections, claims, metrics.join(fresh, "source_id", "left_semi"), chunks.join(fresh, "source_id", "left_semi"))


def newest_first(edges: DataFrame) -> DataFrame:
    """Edges with ``nth`` in their section, the gravest relation first."""
    rank = F.array_position(F.array(*map(F.lit, ("REPLACES", "EXTENDS", "SUPPORTS"))), F.col("relation"))
    return edges.withColumn("nth", F.row_number().over(Window.partitionBy("section_id").orderBy(rank, "claim_id")))
