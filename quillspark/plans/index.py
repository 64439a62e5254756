"""The search index of a folder of driver tables: built once per application from ``documents``, then read by the queries."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import retrieval
from ..operators.postings import Postings
from ..operators.vectors import VectorStore
from ..sources.shared import shared_dir
from ..sources.versioned import VersionedTables


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is a source with one page and one block."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("source").alias("source_id"), F.lit(1).alias("page"), F.col("doc_id").alias("seq"), F.col("doc_id").alias("block_id"), "text")


def _stamp(spark: SparkSession, sf_dir: str) -> str:
    """Changes with the files of ``documents``: their places, sizes and times."""
    files = table(spark, sf_dir, "documents").select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    said = sorted(map(str, files.collect()))  # a row per file
    return hashlib.md5("\n".join([sf_dir, *said]).encode()).hexdigest()


def _tables(spark: SparkSession, sf_dir: str) -> VersionedTables:
    return VersionedTables(spark, f"{shared_dir(spark)}/index-{spark.sparkContext.applicationId}-{_stamp(spark, sf_dir)}", buckets=32)


def _missing(tables: VersionedTables, name: str) -> bool:
    head = tables.commit(name)
    return head is None or "build" not in head.batches


def postings(spark: SparkSession, sf_dir: str) -> Postings:
    """Postings of all documents. What is there is not written again; a build that was stopped goes on."""
    tables = _tables(spark, sf_dir)
    found = Postings(tables)
    if _missing(tables, found.valid):
        found.add(blocks(spark, sf_dir).where("source_id IS NOT NULL AND text IS NOT NULL"), ("build", 0))
    return found


def vectors(spark: SparkSession, sf_dir: str) -> VectorStore:
    """Vectors of all documents, built as the postings are."""
    tables = _tables(spark, sf_dir)
    store = VectorStore(tables)
    if _missing(tables, store.name):
        rows = blocks(spark, sf_dir).where("source_id IS NOT NULL AND text IS NOT NULL")
        store.upsert(rows.select("source_id", F.col("block_id").alias("chunk_id"), "page", "text"), ("build", 0))
    return store


def hybrid(postings: Postings, store: VectorStore, query: str, sources: list | None = None, limit: int = retrieval.MERGED_LIMIT) -> DataFrame:
    """Keyword hits from postings and vector hits from the store, merged; the query alone is embedded."""
    words = postings.search(query, sources)
    # At most twenty rows of each; the store has the texts that hits are told apart by.
    texts = store.read().select("source_id", F.col("chunk_id").alias("block_id"), "text")
    words = texts.join(F.broadcast(words.select("source_id", "block_id", "page", "score", "rank")), ["source_id", "block_id"])
    near = store.search(query, sources=sources).withColumnRenamed("chunk_id", "block_id")
    return retrieval.merge_hits(words, near.select("block_id", "source_id", "page", "text", "cosine"), limit)
