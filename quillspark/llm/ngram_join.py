"""Exact Jaccard self-join of word n-grams, as components, with multiple-global-order prefix filters.

A text's set holds its distinct 5-word shingles (lower-cased A-Z; words are runs without white space; a text of fewer
words is one shingle). Two sets link when ``100 * |A & B| >= percent * |A | B|``.

Two linked sets share a token among their prefixes, the first ``n - ceil(percent/100 * n) + 1`` tokens, under *every*
global order of the tokens. All orders here put frequent tokens last, each by its own count sketch of fixed size over all
texts, and differ in how they hash tokens to cells and within a level. A candidate must pass every filter before a text
moves: it shares a prefix token under order 0 (a shuffle of the prefixes lists the pairs), the parities of its sets tell
few enough differences (256 bits, carried with each posting: a token in one of the sets flips one bit), and its prefixes
under orders 1 and 2, kept as 32-bit hashes, meet as well. Only then is its intersection counted.

Equal sets are one. Large groups of near copies are not expanded into pairs:

1. Prefix tokens of order 0 that two sets or more have are kept.
2. Every set is verified against the leader that it shares most tokens with, for two choices of leaders; the links are
   contracted to components. A pair whose sets are connected already needs no test.
3. All other pairs that share a prefix token and lie in different components are listed, filtered by what their shared
   tokens allow at most, and verified. None is left out.

Cases: null, empty and blank texts have an empty set, are linked with nothing and are their own component; equal texts
share a component; rows that repeat a doc_id are rows of their own with that id; rows without an id
have no component and connect nothing; very long texts are read whole; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow_text import ranges, slices, utf8_view
from .components import connect
from .hashing import mix, prefix_hash, span_hash
from .workspace import Workspace, partitions

WORDS = 5
SKETCH_BITS = 17
SLICE = 4096
ROWS = 2_000_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WEIGHTS = mix(np.arange(1, WORDS + 1, dtype=np.uint64)) | np.uint64(1)
_SEEDS = mix(np.arange(101, 104, dtype=np.uint64))
PARITY = 256
_BITS = [f"b{k}" for k in range(PARITY // 64)]


def shingle_sets(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts in a row, and the offsets of the texts in them."""
    n = len(at) - 1
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    inside = ~((raw == 0x20) | ((raw >= 0x09) & (raw <= 0x0D)))
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[at] = True
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    words = mix(span_hash(prefix_hash(_LOWER[raw]), starts, ends) + (ends - starts).astype(np.uint64))
    first = np.searchsorted(starts, at)
    per = np.diff(first)
    many = np.maximum(len(words) - WORDS + 1, 0)
    grams = np.zeros(many, dtype=np.uint64)
    for k in range(WORDS):
        grams += words[k : k + many] * _WEIGHTS[k]
    grams = mix(grams)
    sets, sizes = [], np.zeros(n, dtype=np.int64)
    for k in range(n):
        if per[k] >= WORDS:
            own = np.sort(grams[first[k] : first[k] + per[k] - WORDS + 1])
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif per[k]:
            few = words[first[k] : first[k + 1]] * _WEIGHTS[: per[k]]
            own = mix(np.array([few.sum(dtype=np.uint64) + np.uint64(per[k])], dtype=np.uint64))
        else:
            continue
        sets.append(own)
        sizes[k] = len(own)
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(sizes)])


def set_ids(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hash of every set; 0 for empty ones."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(flat ^ _SEEDS[0]), dtype=np.uint64)])
    sizes = np.diff(offsets).astype(np.uint64)
    out = mix(sums[offsets[1:]] - sums[offsets[:-1]] + sizes)
    return np.where(sizes > 0, out | np.uint64(1), np.uint64(0)).view(np.int64)


def prefix_length(n: int | np.ndarray, percent: int) -> int | np.ndarray:
    return n - -(-n * percent // 100) + 1


def cells(tokens: np.ndarray, order: int) -> np.ndarray:
    """Cells of tokens in the count sketch of an order."""
    return (mix(tokens ^ _SEEDS[order]) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def ordered(tokens: np.ndarray, levels: np.ndarray, order: int) -> np.ndarray:
    """Keys of tokens under a global order: the level of their cell's count, then the order's hash."""
    hashed = mix(tokens ^ _SEEDS[order])
    level = levels[order][(hashed >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64)
    return level << np.uint64(58) | hashed >> np.uint64(6)


def levels_of(counts: np.ndarray) -> np.ndarray:
    """Levels 0 to 63 of cell counts: quarters of a standard deviation around the median, above that by logarithm."""
    middle = np.median(counts, axis=1, keepdims=True)
    z = (counts - middle) / np.sqrt(np.maximum(middle, 1.0))
    high = 24 + np.ceil(4 * np.log2(np.maximum(z, 3.0) / 3.0))
    return np.where(z <= 3, np.floor(4 * (z + 3)), high).clip(0, 63).astype(np.uint8)


def room(size: np.ndarray, rank: np.ndarray, met: np.ndarray, after: np.ndarray, last: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(most, rest) of the pairs (i, j) of rows with one token: how many tokens they can share in all, and beyond it.

    Of the two sets, take the one whose prefix ends first. A token of its prefix that the other set has lies in the
    other's prefix too, so those that no prefix of another set has (``met`` and ``after`` leave them out) are not shared.
    Of the other set only ranks are known.
    """
    first = last[i].view(np.uint64) <= last[j].view(np.uint64)
    low, high = np.where(first, i, j), np.where(first, j, i)
    rest = np.minimum(after[low], size[high] - rank[high] - 1)
    return np.minimum(met[low], rank[high] + 1) + rest, rest


def parities(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For every set a row of words, whose bits tell if the number of its tokens with such a hash is odd."""
    n = len(offsets) - 1
    place = np.repeat(np.arange(n), np.diff(offsets)) * PARITY + (mix(flat + _SEEDS[1]) & np.uint64(PARITY - 1)).astype(np.int64)
    odd = np.bincount(place, minlength=n * PARITY).astype(np.uint8) & 1
    return np.packbits(odd.reshape(n, PARITY), axis=1).view(np.int64)


def heads(flat: np.ndarray, offsets: np.ndarray, levels: np.ndarray, order: int, percent: int) -> pa.Array:
    """Prefixes of all sets under an order, as lists of 32-bit hashes."""
    keys, out = ordered(flat, levels, order), []
    for k in range(len(offsets) - 1):
        own = keys[offsets[k] : offsets[k + 1]]
        p = int(prefix_length(len(own), percent)) if len(own) else 0
        out.append((np.partition(own, p - 1)[:p] if p < len(own) else own) & np.uint64(0xFFFFFFFF))
    sizes = np.array([len(x) for x in out], dtype=np.int64)
    values = np.concatenate(out).astype(np.uint32).view(np.int32) if out else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets link."""
    small, large = sorted((len(a), len(b)))
    if not small or 100 * small < percent * large:
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _gather(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray] | None:
    held = list(batches)
    if not held:
        return None
    table = pa.Table.from_batches(held)
    return [table.column(k).to_numpy() for k in range(table.num_columns)] if table.num_rows else None


def _group(token: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (token, set), starts and sizes of token groups."""
    by = np.lexsort((own, token))
    token = token[by]
    starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    return by, starts, np.diff(np.append(starts, len(by)))


def _leaders(own: np.ndarray, rank: np.ndarray, starts: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """Index of each group's leader: a set in which the token ranks lowest, ties by a hash.

    Among near copies that is one with few changes, as what a copy changes is rare and ranks before what all share.
    """
    key = rank.astype(np.uint64) << np.uint64(32) | mix(own.astype(np.uint64) + np.uint64(seed)) >> np.uint64(32)
    least = np.minimum.reduceat(key, starts)
    hit = np.flatnonzero(key == np.repeat(least, sizes))
    # Several rows of a set have one key; the first of each group counts.
    lead = hit[np.searchsorted(hit, starts)]
    return np.repeat(lead, sizes)


def join_components(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id): component_id is the least id reachable by links."""
    spark = docs.sparkSession
    n = partitions(spark)
    space = Workspace(spark, "ngram_join")
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(_SEEDS), 1 << SKETCH_BITS), dtype=np.int64)
        id_type = None
        for batch in slices(batches, 256):
            id_type = batch.column(0).type
            flat, offsets = shingle_sets(*utf8_view(batch.column(1)))
            for order in range(len(_SEEDS)):
                counts[order] += np.bincount(cells(flat, order), minlength=1 << SKETCH_BITS)
            rows = batch.num_rows
            odd = [pa.array(x) for x in parities(flat, offsets).T.copy()]
            columns = [batch.column(0), pa.array(np.diff(offsets)), pa.array(set_ids(flat, offsets)), *odd, pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "own", *_BITS, "slice", "counts"])
        if id_type is not None:
            parts = counts.reshape(-1, SLICE)
            k = len(parts)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(k + 1, dtype=np.int32) * SLICE), pa.array(parts.reshape(-1)))
            columns = [pa.nulls(k, id_type), *[pa.nulls(k, pa.int64())] * (2 + len(_BITS)), pa.array(np.arange(k, dtype=np.int32)), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "own", *_BITS, "slice", "counts"])

    odd = ", ".join(f"{c} long" for c in _BITS)
    described = space.save(texts.mapInArrow(describe, f"id {kind}, n long, own long, {odd}, slice int, counts array<bigint>"), "described")
    members = described.where("slice IS NULL").select("id", "n", "own")
    # Tasks that gather a partition hold about ROWS of prefix tokens, whatever the input's size.
    tokens = members.agg(F.sum("n")).first()[0] or 0
    n = max(n, tokens * (100 - percent) // 100 // ROWS + 1)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[k] = sums.get(k, 0) + np.asarray(part.values)
        yield pa.RecordBatch.from_pydict({"slice": pa.array(sums, pa.int32()), "counts": pa.array(list(sums.values()), pa.list_(pa.int64()))})

    # Three times 2**17 counts in 96 rows, whatever the input's size.
    sketched = described.where("slice IS NOT NULL").select("slice", "counts").repartition(8, "slice")
    counts = np.zeros((len(_SEEDS) << SKETCH_BITS) // SLICE * SLICE, dtype=np.int64).reshape(-1, SLICE)
    for row in sketched.mapInArrow(add_up, "slice int, counts array<bigint>").collect():
        counts[row["slice"]] = row["counts"]
    levels = spark.sparkContext.broadcast(levels_of(counts.reshape(len(_SEEDS), -1)))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches, 256):
            flat, offsets = shingle_sets(*utf8_view(batch.column(0)))
            own, keys = set_ids(flat, offsets), ordered(flat, levels.value, 0)
            token, sizes, ids, last = [], [], [], []
            for k, who in enumerate(own.tolist()):
                if not who or who in seen:
                    continue  # this task has sent the set already
                seen.add(who)
                size = offsets[k + 1] - offsets[k]
                p = prefix_length(int(size), percent)
                token.append(np.sort(keys[offsets[k] : offsets[k + 1]])[:p])
                last.append(token[-1][-1])
                sizes.append((int(size), p))
                ids.append(who)
            if not ids:
                continue
            size, p = np.array(sizes).T
            place = np.arange(int(p.sum())) - np.repeat(np.cumsum(p) - p, p)
            ends = np.repeat(np.array(last, dtype=np.uint64).view(np.int64), p)
            columns = [np.concatenate(token).view(np.int64), np.repeat(np.array(ids), p), np.repeat(size, p) << 32 | place, ends]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "own", "at", "last"])

    def collide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _gather(batches)
        if held is None:
            return
        by, starts, sizes = _group(held[0], held[1])
        by = by[np.repeat(sizes > 1, sizes)]
        token, own, at, last = (column[by] for column in held)
        one = np.ones(len(by), dtype=bool)  # tasks that hold a copy of a set each send it
        one[1:] = (token[1:] != token[:-1]) | (own[1:] != own[:-1])
        token, own, at, last = token[one], own[one], at[one], last[one]
        if not len(token):
            return
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        sizes = np.diff(np.append(starts, len(token)))
        many = np.repeat(sizes > 1, sizes)
        yield from pa.table({"token": token[many], "own": own[many], "at": at[many], "last": last[many]}).to_batches(max_chunksize=65536)

    def shared_tokens() -> DataFrame:
        listed = texts.select("text").mapInArrow(prefixes, "token long, own long, at long, last long").repartition(n, "token")
        met = listed.mapInArrow(collide, "token long, own long, at long, last long")
        # Prefix tokens of a set that some other prefix has, up to a token and in all.
        mine = Window.partitionBy("own")
        met = met.withColumns({"met": F.row_number().over(mine.orderBy("at")).cast("long"), "total": F.count("*").over(mine)})
        size, rank = F.shiftright("at", 32), F.col("at").bitwiseAND(F.lit(0xFFFFFFFF))
        outside = F.ceil(size * percent / 100) - 1
        rows = met.select("token", "own", size.alias("size"), rank.alias("rank"), "met", (outside + F.col("total") - F.col("met")).alias("after"), "last")
        odd = described.where("own != 0").groupBy("own").agg(*(F.max(c).alias(c) for c in _BITS))
        return space.save(rows.join(odd, "own"), "shared")

    # Each step is a call of its own, so that nothing refers to its shuffles when they may be freed.
    shared = shared_tokens()
    space.settle()
    reps = members.where("own != 0").groupBy("own").agg(F.min("id").alias("id"))

    def texts_of_sets() -> DataFrame:
        """Texts of the sets that share a prefix token with another one, and their prefixes under the other orders."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            for batch in slices(batches, 256):
                flat, offsets = shingle_sets(*utf8_view(batch.column(1)))
                # Rows that repeat an id bring other texts, or a text again; only the first one that has the set counts.
                own = batch.column(0).to_pylist()
                right = pa.array([x == y and not (x in seen or seen.add(x)) for x, y in zip(own, set_ids(flat, offsets).tolist(), strict=True)], pa.bool_())
                lists = [heads(flat, offsets, levels.value, order, percent) for order in (1, 2)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *lists], names=["own", "text", "head1", "head2"]).filter(right)

        wanted = shared.select("own").distinct().join(reps, "own")
        found = texts.join(wanted, "id").select("own", "text")
        return space.save(found.mapInArrow(run, "own long, text string, head1 array<int>, head2 array<int>"), "texts")

    chosen = texts_of_sets()
    space.settle()

    def meet(pairs: DataFrame, name: str) -> DataFrame:
        """(u, v, meets1, meets2) of every pair: whether the prefixes under orders 1 and 2 have a token in common; written."""
        a, b = (chosen.select(F.col("own").alias(x), *(F.col(f"head{k}").alias(f"{x}{k}") for k in (1, 2))) for x in "uv")
        both = pairs.select("u", "v").join(b, "v").join(a, "u")
        return space.save(both.select("u", "v", *(F.arrays_overlap(f"u{k}", f"v{k}").alias(f"meets{k}") for k in (1, 2))), name)

    def verify(pairs: DataFrame, name: str) -> DataFrame:
        """(u, v, linked) of every pair that all orders allow, written."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 128):
                left, right = (shingle_sets(*utf8_view(batch.column(k))) for k in (2, 3))
                found = [
                    similar(left[0][left[1][k] : left[1][k + 1]], right[0][right[1][k] : right[1][k + 1]], percent) for k in range(batch.num_rows)
                ]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.bool_())], names=["u", "v", "linked"])

        a = chosen.select(F.col("own").alias("u"), F.col("text").alias("text_u"))
        b = chosen.select(F.col("own").alias("v"), F.col("text").alias("text_v"))
        both = pairs.where("meets1 AND meets2").select("u", "v").join(b, "v").join(a, "u").select("u", "v", "text_u", "text_v")
        return space.save(both.mapInArrow(run, "u long, v long, linked boolean"), name)

    def best_leader(led: DataFrame) -> DataFrame:
        """Of each set v the leader u that leads most of its tokens."""
        led = led.groupBy("u", "v").agg(F.count("*").alias("c"))
        return led.groupBy("v").agg(F.max(F.struct("c", "u")).alias("b")).select("v", F.col("b.u").alias("u"))

    def linked(*tables: DataFrame) -> DataFrame:
        """Components of the links found so far."""
        edges = [t.where("linked").select("u", "v") if "linked" in t.columns else t.select(F.col("node").alias("u"), F.col("label").alias("v")) for t in tables]
        return connect(reduce(DataFrame.unionByName, edges), space)

    def across(batches: Iterator[pa.RecordBatch], every: bool) -> Iterator[pa.RecordBatch]:
        """Pairs of one token's sets whose components differ: with a second leader, or all of them."""
        held = _gather(batches)
        if held is None:
            return
        by = np.lexsort((held[1], held[7], held[0]))
        token, own, size, rank, met, after, last, label = (column[by] for column in held[:8])
        bits = [column[by].view(np.uint64) for column in held[8:]]

        def pairs(i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Pairs that this token allows; one that another token forbids lacks that row and is judged by the rest."""
            most, rest = room(size, rank, met, after, last, i, j)
            fit = (100 + percent) * most >= percent * (size[i] + size[j])
            fit &= 100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j])
            i, j, rest = i[fit], j[fit], rest[fit]
            apart = sum(np.bitwise_count(b[i] ^ b[j]).astype(np.int64) for b in bits)
            near = (100 + percent) * apart <= (100 - percent) * (size[i] + size[j])
            i, j, rest = i[near], j[near], rest[near]
            table = {"u": own[i], "v": own[j], "sizes": size[i] + size[j], "rest": rest}
            yield from pa.table(table).to_batches(max_chunksize=65536)

        new = np.concatenate([[True], token[1:] != token[:-1]])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(token)))
        if not every:
            lead = _leaders(own, rank, starts, sizes, 1)
            j = np.flatnonzero(label != label[lead])
            yield from pairs(lead[j], j)
            return
        # Sorted by component, a set's partners are the rows from the end of its component's block on.
        new[1:] |= label[1:] != label[:-1]
        blocks = np.flatnonzero(new)
        stop = np.repeat(np.append(blocks[1:], len(token)), np.diff(np.append(blocks, len(token))))
        many = np.repeat(starts + sizes, sizes) - stop
        done = np.concatenate([[0], np.cumsum(many)])
        lo = 0
        while lo < len(many):
            hi = max(lo + 1, int(np.searchsorted(done, done[lo] + 500_000, side="right")) - 1)
            i = np.repeat(np.arange(lo, hi), many[lo:hi])
            j = ranges(stop[lo:hi], many[lo:hi])
            lo = hi
            swap = own[i] > own[j]
            yield from pairs(np.where(swap, j, i), np.where(swap, i, j))

    def differing(labels: DataFrame | None, every: bool) -> DataFrame:
        rows = shared.withColumn("label", F.col("own"))
        if labels is not None:
            rows = shared.join(labels.withColumnRenamed("node", "own"), "own", "left").withColumn("label", F.coalesce("label", "own"))
        rows = rows.select("token", "own", "size", "rank", "met", "after", "last", "label", *_BITS).repartition(n, "token")
        return rows.mapInArrow(lambda it: across(it, every), "u long, v long, sizes long, rest long")

    def last_pairs(labels: DataFrame, *known: DataFrame) -> DataFrame:
        """All pairs between components that can have enough in common after the last token that they share."""
        rest = differing(labels, True).groupBy("u", "v").agg(
            F.count("*").alias("c"), F.max("sizes").alias("sizes"), F.min("rest").alias("rest")
        )
        rest = rest.where((100 + percent) * (F.col("c") + F.col("rest")) >= percent * F.col("sizes")).select("u", "v")
        seen = reduce(DataFrame.unionByName, known).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        return rest.join(seen, ["u", "v"], "left_anti")

    first = meet(best_leader(differing(None, False)), "first")
    labels = linked(verify(first, "tested"))
    space.settle()
    second = meet(best_leader(differing(labels, False)), "second")
    labels = linked(labels, verify(second, "again"))
    space.settle()
    labels = linked(labels, verify(meet(last_pairs(labels, first, second), "third"), "last"))
    space.settle()

    named = reps.join(labels.withColumnRenamed("node", "own"), "own", "left").select("own", "id", F.coalesce("label", "own").alias("label"))
    least = named.groupBy("label").agg(F.min("id").alias("component_id"))
    named = named.join(least, "label").select("own", "component_id")
    out = members.join(named, "own", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
