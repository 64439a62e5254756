"""An inverted index over text blocks: a posting per term and block, with the term's positions, in versioned tables.

Postings lie in hash buckets of the term, those of one block and bucket in one row, which is made where the block is read
and written without a shuffle. They carry the batch that wrote them; the table ``sources`` names the batch of each
source that is valid. A source that comes again is indexed under a new batch, and its old postings count no more from
then on; ``compact`` drops them. A query reads the buckets of its own terms only, and never a text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.versioned import Batch, VersionedTables, key_bucket
from .ordering import rank_score
from .retrieval import KEYWORD_LIMIT, in_sources, phrases_of

PLACE = ["source_id", "page", "seq", "block_id"]


def terms_of(blocks: DataFrame) -> DataFrame:
    """(term, source_id, page, seq, block_id, positions): positions are those of the block's tokens, from 0, ascending.

    A block's tokens are sorted with their positions in its row, so that equal ones lie side by side: nothing is shuffled.
    Rows that repeat a block give postings of their own.
    """
    tokens = F.transform(T.search_tokens(F.col("text")), lambda t, i: F.struct(t.alias("term"), i.alias("position")))
    rows = blocks.select(*PLACE, F.sort_array(tokens).alias("told"))
    term = lambda i: F.get("told", i)["term"]
    first = F.filter(F.sequence(F.lit(0), F.size("told")), lambda i: (i < F.size("told")) & ((i == 0) | (term(i) != term(i - 1))))
    rows = rows.withColumn("first", first)

    def posting(at: Column, k: Column) -> Column:
        same = F.slice("told", at + 1, F.coalesce(F.get("first", k + 1), F.size("told")) - at)
        return F.struct(term(at).alias("term"), same["position"].alias("positions"))

    return rows.select(*PLACE, F.explode(F.transform("first", posting)).alias("p")).select("p.term", *PLACE, "p.positions")


def packs_of(blocks: DataFrame, buckets: int) -> DataFrame:
    """(source_id, page, seq, block_id, terms, positions): the postings of ``terms_of``, those of a block and bucket in one row.

    Tokens are sorted by bucket first, so that a row is a slice of a block's postings.
    """
    tokens = F.transform(T.search_tokens(F.col("text")), lambda t, i: F.struct(key_bucket(t, buckets).alias("bucket"), t.alias("term"), i.alias("position")))
    rows = blocks.select(*PLACE, F.sort_array(tokens).alias("told"))

    def firsts(told: str, field: str) -> Column:
        """Where another value of a field starts."""
        value = lambda i: F.get(told, i)[field]
        return F.filter(F.sequence(F.lit(0), F.size(told)), lambda i: (i < F.size(told)) & ((i == 0) | (value(i) != value(i - 1))))

    def part(told: str, at: Column, k: Column) -> Column:
        return F.slice(told, at + 1, F.coalesce(F.get("first", k + 1), F.size(told)) - at)

    def posting(at: Column, k: Column) -> Column:
        token = F.get("told", at)
        return F.struct(token["bucket"].alias("bucket"), token["term"].alias("term"), part("told", at, k)["position"].alias("positions"))

    def pack(at: Column, k: Column) -> Column:
        mine = part("held", at, k)
        return F.struct(mine["term"].alias("terms"), mine["positions"].alias("positions"))

    # Lambdas ask for whole elements: a field of a column of structs would be made again for each of them.
    rows = rows.withColumn("first", firsts("told", "term")).select(*PLACE, F.transform("first", posting).alias("held"))
    rows = rows.withColumn("first", firsts("held", "bucket")).select(*PLACE, F.explode(F.transform("first", pack)).alias("p"))
    return rows.select("p.terms", *PLACE, "p.positions")


class Postings:
    """The index ``name`` in some versioned tables."""

    def __init__(self, tables: VersionedTables, name: str = "postings"):
        self.tables, self.name, self.valid = tables, name, f"{name}_sources"

    def add(self, blocks: DataFrame, batch: Batch) -> None:
        """Index blocks (source_id, page, seq, block_id, text); what a source had before is replaced.

        Postings go first and the sources that make them valid second, so a reader sees a source whole or not at all; a
        batch that is repeated after a failure is written once.
        """
        label = F.lit(f"{batch[0]}:{batch[1]}")
        packs = lambda buckets: packs_of(blocks, buckets).withColumn("batch", label)
        self.tables.append(self.name, packs, key="terms", batch=batch, shuffled=False)
        # The number of blocks is kept, so that nothing else need be read to know how much is indexed.
        counts = blocks.groupBy("source_id").agg(F.countDistinct("block_id").alias("n_blocks")).withColumn("batch", label)
        self.tables.upsert(self.valid, counts, ["source_id"], batch=batch, known=blocks.select("source_id").distinct())

    def drop(self, sources: DataFrame) -> None:
        """Forget sources (source_id)."""
        self.tables.delete_keys(self.valid, sources.select("source_id"))

    def compact(self) -> None:
        """Rewrite the postings without those that no source makes valid."""
        self.tables.transact(self.name, lambda rows: rows.join(self._sources(), ["source_id", "batch"], "left_semi"))

    def _sources(self) -> DataFrame:
        return self.tables.read(self.valid).select("source_id", "batch")

    def of(self, terms: list[str]) -> DataFrame:
        """Valid postings (term, source_id, page, seq, block_id, positions, batch) of some terms, from their buckets."""
        packs = self.tables.read_keys(self.name, terms).join(self._sources(), ["source_id", "batch"], "left_semi")
        asked = F.filter(F.arrays_zip("terms", "positions"), lambda p: p["terms"].isin(terms) if terms else F.lit(False))
        return packs.select(F.explode(asked).alias("p"), *PLACE, "batch").select(F.col("p.terms").alias("term"), *PLACE, "p.positions", "batch")

    def matches(self, query: str, sources: list | None = None) -> DataFrame:
        """Places of the blocks that hold every token of the query; tokens with punctuation inside are phrases."""
        phrases = phrases_of(query)
        if not phrases:
            return self.of([]).select(*PLACE)
        terms = sorted({t for p in phrases for t in p})
        held = in_sources(self.of(terms), sources)
        places = {t: F.flatten(F.collect_list(F.when(F.col("term") == t, F.col("positions")))) for t in terms}
        alias = {t: f"p{i}" for i, t in enumerate(terms)}
        # One row per block; of each term the positions in it.
        rows = held.groupBy(*PLACE).agg(F.count_distinct("term").alias("_n"), *(c.alias(alias[t]) for t, c in places.items())).where(F.col("_n") == len(terms))
        for phrase in (p for p in phrases if len(p) > 1):
            rows = rows.where(F.size(starts([F.col(alias[t]) for t in phrase])) > 0)
        return rows.select(*PLACE)

    def search(self, query: str, sources: list | None = None, limit: int = KEYWORD_LIMIT) -> DataFrame:
        """First blocks in document order that hold all of the query, with ``rank`` from 1 and ``score`` falling by 0.01."""
        found = self.matches(query, sources).orderBy(*PLACE).limit(limit)
        # At most ``limit`` rows are numbered.
        return found.withColumn("rank", F.row_number().over(Window.orderBy(*PLACE))).withColumn("score", rank_score(F.col("rank")))


def starts(positions: list[Column]) -> Column:
    """Where a phrase starts: positions of its words, one after the other."""
    def back(found: Column, by: int) -> Column:
        return F.transform(found, lambda x: x - by)

    return reduce(F.array_intersect, [back(p, i) for i, p in enumerate(positions)])
