"""Benchmark decontamination by pigeonhole edit matching.

Texts are normalised (lower case, runs of white space to one space). A test item with an error budget of k edits is
split into k + 1 pieces; an occurrence with at most k edits leaves one piece untouched, so exact piece hits (one
Aho-Corasick pass over each whole text) find every candidate. Myers' bit-parallel algorithm then measures the edit
distance of the best matching passage around each hit.

The budget is ``error_rate`` of the item's length, but pieces keep ``min_piece`` characters (at the default rate no item
loses an edit by that). Items shorter than ``min_item`` characters after normalisation are matched as they are, as whole
words: a passage of the text that equals the item with no letter or digit beside it.

The test items are the broadcast side. Their bytes are summed first and dealt into blocks of about ``block_bytes``; the
texts are scanned once per block, so what a task holds is bounded whatever the benchmark's size.

Cases: null and empty texts or items match nothing; texts and items of any length are matched whole; equal item texts give a row each; a text that holds an item many
times gives its best passage once; repeated documents give a row each; empty tables give an empty result; other columns
are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import slices


def normalize(text: str) -> str:
    return " ".join(text.lower().split())


def budget(length: int, error_rate: float, min_piece: int) -> int:
    return max(0, min(int(length * error_rate), length // min_piece - 1))


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """(start, piece) of k + 1 pieces that make up the item."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern: str, text: str, anchored: bool = False) -> tuple[int, int]:
    """(distance, end) of the best match of pattern inside text (anchored: from its start); the earliest end among equals."""
    m = len(pattern)
    peq: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        peq[c] |= 1 << i
    full, last = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & last:
            score += 1
        elif mh & last:
            score -= 1
        ph = ((ph << 1) | anchored) & full
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def is_word(text: str, start: int, end: int) -> bool:
    """No letter or digit stands beside the passage."""
    return not (start and text[start - 1].isalnum()) and not (end < len(text) and text[end].isalnum())


class Matcher:
    """Finds the items of one block in normalised texts."""

    def __init__(self, items: list[tuple[object, str]], error_rate: float, min_piece: int, min_item: int):
        import ahocorasick

        self.items: list[tuple[object, str, int, bool]] = []
        where: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for item_id, raw in items:
            item = normalize(raw or "")
            if not item:
                continue
            short = len(item) < min_item
            k = 0 if short else budget(len(item), error_rate, min_piece)
            for at, piece in pieces(item, k):
                where[piece].append((len(self.items), at))
            self.items.append((item_id, item, k, short))
        self.automaton = ahocorasick.Automaton()
        for piece, found in where.items():
            self.automaton.add_word(piece, (len(piece), found))
        if where:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[object, int, int, int]]:
        """(item_id, distance, start, end) of the best passage of every item found, in the normalised text."""
        if not self.items or not text:
            return []
        starts: dict[int, set[int]] = defaultdict(set)
        for end, (size, found) in self.automaton.iter(text):
            for item, at in found:
                starts[item].add(end - size + 1 - at)
        out = []
        for item, guesses in starts.items():
            item_id, pattern, k, short = self.items[item]
            best: tuple[int, int, int] | None = None
            done = None
            for guess in sorted(guesses):
                if done is not None and guess == done:
                    continue
                done = guess
                lo, hi = max(0, guess - k), min(len(text), guess + len(pattern) + k)
                if short and not is_word(text, guess, guess + len(pattern)):
                    continue
                if guess >= 0 and text.startswith(pattern, guess):
                    distance, start, end = 0, guess, guess + len(pattern)
                else:
                    distance, stop = myers(pattern, text[lo:hi])
                    end = lo + stop
                    if distance <= k:  # backwards from the end, the same distance tells where the passage starts
                        start = end - myers(pattern[::-1], text[lo:end][::-1], anchored=True)[1]
                if distance <= k and (best is None or distance < best[0]):
                    best = (distance, start, end)
                if best and not best[0]:
                    break
            if best:
                out.append((item_id, *best))
        return out


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    error_rate: float = 0.06,
    min_piece: int = 8,
    min_item: int = 24,
    block_bytes: int = 4_000_000,
) -> DataFrame:
    """(doc_id, item_id, distance, budget, start, end): each document with each test item it holds a passage of."""
    spark = docs.sparkSession
    usable = benchmark.select("item_id", "text").where(F.col("text").isNotNull())
    total = usable.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    doc_kind = docs.schema["doc_id"].dataType.simpleString()
    item_kind = benchmark.schema["item_id"].dataType.simpleString()
    out_schema = f"doc_id {doc_kind}, item_id {item_kind}, distance int, budget int, start long, end long"

    def scan(items: list[tuple[object, str]]) -> DataFrame:
        sent = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value, error_rate, min_piece, min_item)
            budgets = {item_id: k for item_id, _, k, _ in matcher.items}
            id_type = pa.from_numpy_dtype("int64") if item_kind in ("bigint", "int") else pa.string()
            for batch in slices(batches, 256):
                rows = [
                    (doc, item, distance, budgets[item], lo, hi)
                    for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                    if text
                    for item, distance, lo, hi in matcher.find(normalize(text))
                ]
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
                kinds = (batch.column(0).type, id_type if item_kind != "int" else pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                    names=["doc_id", "item_id", "distance", "budget", "start", "end"],
                )

        return docs.select("doc_id", "text").mapInArrow(run, out_schema)

    def block(b: int) -> DataFrame:
        rows = usable if blocks == 1 else usable.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        return scan(sorted(((r["item_id"], r["text"]) for r in rows.collect()), key=str))

    return reduce(DataFrame.unionByName, (block(b) for b in range(blocks)))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs that hold no passage of the benchmark; all columns stay. Rows without a doc_id stay."""
    leaked = find_leaks(docs, benchmark, **options).select("doc_id").distinct()
    return docs.join(leaked, "doc_id", "left_anti")
