"""Importance resampling towards a target: documents drawn by how much more their n-grams belong to the target.

Words become integers through a dictionary, n-grams become tuples of these (a pair of words, then a pair and a word), and
each distinct tuple of a batch is hashed once, from the bytes of its words; the hashes go back to the places of the
tuple through the inverse index. A feature's bucket is its crc32 modulo ``buckets``. Only the bucket counts of a task leave
it (never a word or a text), and only ``buckets`` gains go out to the tasks again. The dictionary belongs to a Python
worker and is emptied when it passes ``max_words`` words (they then get new numbers; nothing is left out): one table
for all tasks would need a shuffle of every word.

The draw adds Gumbel noise that the id names to a document's weight and takes the highest sums. Ranks come from a
distributed sort: a row's place within its part, and the sizes of the parts before it.

Cases: null and empty texts, and texts without words, have no feature, weight 0 and are never drawn; texts of any length are read
whole; ties of the score go to the smaller id, null ids last; repeated rows are counted and ranked each for itself; an
empty table gives an empty result, an empty target gives every bucket the gain of a target without counts. Other
columns are not read, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import slices, utf8_view
from .columns import pick
from .workspace import Workspace

#: Bytes that stand in words, A-Z made small; all others part words.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_words: dict[int, "WordTable"] = {}


class WordTable:
    """Numbers of words, with what hashing needs of each."""

    def __init__(self, max_words: int):
        self.max_words = max_words
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.crc = array("I")
        self.after_space: list[bytes] = []

    def numbers(self, words: list[bytes]) -> list[int]:
        number = self.number
        for word in set(words).difference(number):
            number[word] = len(self.crc)
            self.crc.append(zlib.crc32(word))
            self.after_space.append(b" " + word)
        return list(map(number.__getitem__, words))


class Features:
    """The n-grams of 1 to 3 words of some texts: hashes of each place, and the text of each place."""

    def __init__(self, table: WordTable, column: pa.Array):
        if len(table.number) > table.max_words:
            table.clear()
        raw, offsets = utf8_view(column)
        numbers, counts = [], np.zeros(len(column), dtype=np.int64)
        for i in range(len(column)):
            found = raw[offsets[i] : offsets[i + 1]].tobytes().translate(_FOLD).split()
            counts[i] = len(found)
            numbers += table.numbers(found)
        self.n_words = counts
        self.n_features = counts + np.maximum(counts - 1, 0) + np.maximum(counts - 2, 0)
        word = np.array(numbers, dtype=np.int64)
        text = np.repeat(np.arange(len(column)), counts)
        crc, pieces = np.array(table.crc, dtype=np.uint32), table.after_space

        pair_at = np.flatnonzero(text[:-1] == text[1:])
        pairs, pair = np.unique(word[pair_at] << 32 | word[pair_at + 1], return_inverse=True)
        first = crc[pairs >> 32].tolist() if len(pairs) else []
        second = (pairs & 0xFFFFFFFF).tolist()
        pair_crc = np.fromiter((zlib.crc32(pieces[b], a) for a, b in zip(first, second, strict=True)), np.uint32, len(pairs))

        three_at = np.flatnonzero(text[:-2] == text[2:])
        pair_of = np.zeros(len(word), dtype=np.int64)
        pair_of[pair_at] = pair
        threes, three = np.unique(pair_of[three_at] << 32 | word[three_at + 2], return_inverse=True)
        first = pair_crc[threes >> 32].tolist() if len(threes) else []
        third = (threes & 0xFFFFFFFF).tolist()
        three_crc = np.fromiter((zlib.crc32(pieces[b], a) for a, b in zip(first, third, strict=True)), np.uint32, len(threes))

        self.hashes = np.concatenate([crc[word] if len(word) else np.zeros(0, np.uint32), pair_crc[pair], three_crc[three]])
        self.texts = np.concatenate([text, text[pair_at], text[three_at]])


def _table(max_words: int) -> WordTable:
    return _words.setdefault(max_words, WordTable(max_words))


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = 10_000, max_words: int = 1_000_000) -> DataFrame:
    """(bucket, n) for every bucket that a feature falls in; each task sends its sums only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in slices(batches, 256):
            total += np.bincount(Features(_table(max_words), batch.column(0)).hashes % buckets, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], names=["bucket", "n"])

    return pick(texts, text_col).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, text_col: str = "text", buckets: int = 10_000) -> np.ndarray:
    """floor(1000 * ln of the ratio of a bucket's smoothed shares in target and raw); the driver gets bucket counts only."""

    def counts(texts: DataFrame) -> list[int]:
        found = {r["bucket"]: r["n"] for r in bucket_counts(texts, text_col, buckets).collect()}
        return [found.get(b, 0) for b in range(buckets)]

    s, t = counts(raw), counts(target)
    all_s, all_t = float(sum(s) + buckets), float(sum(t) + buckets)
    return np.array([math.floor(1000 * math.log((b + 1) * all_s / ((a + 1) * all_t))) for a, b in zip(s, t, strict=True)], dtype=np.int64)


def weigh(
    docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, max_words: int = 1_000_000
) -> DataFrame:
    """id_col, n_words, n_features, weight (sum of its features' gains) and score (weight and the id's Gumbel noise)."""
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            found = Features(_table(max_words), batch.column(1))
            weight = np.zeros(batch.num_rows, dtype=np.int64)
            np.add.at(weight, found.texts, gain[found.hashes % buckets])
            columns = [batch.column(0), *map(pa.array, (found.n_words, found.n_features, weight))]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_words", "n_features", "weight"])

    docs = pick(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    weighed = docs.mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_features long, weight long")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return weighed.withColumn("score", F.col("weight") + noise)


def draw(weighed: DataFrame, percent: int = 5, min_words: int = 20, id_col: str = "doc_id") -> DataFrame:
    """``weighed`` with rank: 1, 2, 3 ... by falling score for floor(percent * N / 100) of the N rows of ``min_words`` words
    or more, null for all others. ``weighed`` should be a written table, as it is read three times.
    """
    spark = weighed.sparkSession
    space = Workspace(spark, "importance")
    fit = weighed.where(F.col("n_words") >= min_words)
    ordered = fit.orderBy(F.desc("score"), F.asc_nulls_last(id_col)).withColumn("place", F.monotonically_increasing_id())
    ordered = space.save(ordered, "ordered").withColumn("part", F.shiftright("place", 33))
    sizes = sorted((r["part"], r["count"]) for r in ordered.groupBy("part").count().collect())  # a row per part of the sort
    total = sum(n for _, n in sizes)
    before, at = [], 0
    for part, n in sizes:
        before.append((part, at))
        at += n
    starts = spark.createDataFrame(before, "part long, start long")
    rank = F.col("start") + F.col("place").bitwiseAND(F.lit(2**33 - 1)) + 1
    drawn = F.when(rank <= percent * total // 100, rank).cast("long").alias("rank")
    ranked = ordered.join(F.broadcast(starts), "part").select(*weighed.columns, drawn)
    rest = weighed.where(F.coalesce(F.col("n_words") < min_words, F.lit(True)))
    return ranked.unionByName(rest.withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 5) -> DataFrame:
    """Every document with its weight, score and rank in the draw of ``percent`` of 100 towards ``target``."""
    space = Workspace(docs.sparkSession, "importance")
    weighed = space.save(weigh(docs, gains(docs, target, text_col), id_col, text_col), "weighed")
    return draw(weighed, percent, id_col=id_col)
