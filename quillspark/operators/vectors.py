"""Stored vectors of text chunks, by source, with a manifest: what made them, and of which dimension.

Rows are (source_id, chunk_id, page, text, text_hash, vec, norm2) in hash buckets of the source. An upsert replaces the chunks of
its sources; a chunk whose text is that of a stored one takes over its vector, so that only changed texts are embedded.
A query embeds itself alone. Vectors of another dimension than the manifest's are refused; a store made by another
embedder is built anew from its texts when it is searched.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.versioned import Batch, VersionedTables
from .retrieval import VECTOR_LIMIT, code_sums, in_sources, token_codes

CHUNK = ["source_id", "chunk_id", "page", "text"]


@dataclass(frozen=True)
class Embedder:
    """embed: a DataFrame with (text_hash, text) of distinct texts to (text_hash, vec array<float>)."""

    name: str
    dimension: int
    embed: Callable[[DataFrame], DataFrame]


def _hash_vectors(texts: DataFrame) -> DataFrame:
    """Integer weights of the hashed embedding, as floats, without a shuffle; scaling to unit length is left to the cosine."""

    def dense(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            sums = code_sums(batch.column("codes")).astype("float32")
            ends = pa.array(np.arange(len(sums) + 1, dtype="int32") * T.VECTOR_DIMS)
            vec = pa.ListArray.from_arrays(ends, pa.array(sums.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("text_hash"), vec], ["text_hash", "vec"])

    return token_codes(texts, ["text_hash"]).mapInArrow(dense, "text_hash string, vec array<float>")


HASH = Embedder("hash-256", T.VECTOR_DIMS, _hash_vectors)


def text_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


class VectorStore:
    """The store ``name`` in some versioned tables."""

    def __init__(self, tables: VersionedTables, embedder: Embedder = HASH, name: str = "vectors"):
        self.tables, self.embedder, self.name = tables, embedder, name

    def manifest(self) -> dict[str, str]:
        """embedder and dimension of the stored vectors; empty where nothing is stored."""
        head = self.tables.commit(self.name)
        return dict(head.notes) if head else {}

    def _notes(self) -> dict[str, str]:
        return {"embedder": self.embedder.name, "dimension": str(self.embedder.dimension)}

    def fits(self) -> bool:
        """The store is empty or made by this embedder."""
        return self.manifest() in ({}, self._notes())

    def read(self) -> DataFrame:
        return self.tables.read(self.name)

    def _embedded(self, chunks: DataFrame) -> DataFrame:
        """Chunks with the vectors of their distinct texts."""
        texts = chunks.groupBy("text_hash").agg(F.first("text").alias("text"))
        rows = chunks.join(self.embedder.embed(texts), "text_hash")
        sized = F.assert_true(F.size("vec") == self.embedder.dimension, F.concat(F.lit("vector dimension is "), F.size("vec"), F.lit(f", not {self.embedder.dimension}")))
        norm2 = F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
        # The assertion gives null where it holds.
        return rows.select(*CHUNK, "text_hash", "vec", F.coalesce(sized.cast("double"), norm2).alias("norm2"))

    def upsert(self, chunks: DataFrame, batch: Batch | None = None) -> None:
        """All chunks (source_id, chunk_id, page, text) of some sources."""
        chunks = chunks.select(*CHUNK, text_hash(F.col("text")).alias("text_hash"))
        if not self.tables.exists(self.name):
            # The manifest is there before the first vector.
            self.tables.append(self.name, self._embedded(chunks.limit(0)), key="source_id", notes=self._notes())
        if not self.fits():
            raise ValueError(f"the store holds vectors of {self.manifest()}, not {self._notes()}; rebuild it first")
        stored = self.read().join(chunks.select("source_id").distinct(), "source_id", "left_semi")
        known = stored.groupBy("text_hash").agg(F.first("vec").alias("vec"), F.first("norm2").alias("norm2"))
        same = chunks.join(known, "text_hash").select(*CHUNK, "text_hash", "vec", "norm2")
        changed = chunks.join(known.select("text_hash"), "text_hash", "left_anti")
        self.tables.replace_keys(self.name, same.unionByName(self._embedded(changed)), "source_id", batch=batch, keys=chunks.select("source_id").distinct())

    def clear(self) -> None:
        """Forget all vectors and the manifest's content."""
        if self.tables.exists(self.name):
            self.tables.overwrite(self.name, self.read().limit(0), notes=self._notes())

    def clear_sources(self, sources: DataFrame) -> None:
        self.tables.delete_keys(self.name, sources.select("source_id"))

    def rebuild(self) -> int:
        """Embed all stored texts with this embedder; gives the number of chunks."""
        if not self.tables.exists(self.name):
            return 0
        self.tables.overwrite(self.name, self._embedded(self.read().select(*CHUNK, "text_hash")), notes=self._notes())
        return self.read().count()

    def _asked(self, query: str) -> list[float]:
        one = self.read().sparkSession.createDataFrame([(query,)], "text string").select(text_hash(F.col("text")).alias("text_hash"), "text")
        return list(self.embedder.embed(one).first()["vec"])

    def search(self, query: str, limit: int = VECTOR_LIMIT, sources: list | None = None) -> DataFrame:
        """The nearest chunks by cosine, ties by chunk: each task keeps ``limit`` rows. A store of another embedder is rebuilt."""
        if not self.fits():
            self.rebuild()
        asked = self._asked(query)
        length = sum(x * x for x in asked)
        rows = in_sources(self.read(), sources)
        dot = T.dot(F.col("vec"), F.array(*map(F.lit, asked)))
        cosine = F.round(dot / F.sqrt(F.col("norm2") * F.lit(length)), 6)
        return rows.select(*CHUNK, dot.alias("dot"), cosine.alias("cosine")).where("dot > 0").drop("dot").orderBy(F.desc("cosine"), "chunk_id").limit(limit)


def rebuild_mismatched(stores: list[VectorStore]) -> list[str]:
    """Rebuild the stores that another embedder made; gives their names."""
    stale = [s for s in stores if not s.fits()]
    for store in stale:
        store.rebuild()
    return [s.name for s in stale]
