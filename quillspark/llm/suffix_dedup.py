"""Removal of long repeated byte strings with a sparse, range-partitioned suffix array.

Every byte that lies in a string of ``length`` bytes which also starts anywhere else (same text included) is removed;
strings are judged on the input.

1. Anchors. Each window of ``length`` bytes is served by its least-hashed ``gram`` (the leftmost of equals), so equal
   windows have their anchor at the same offset. Runs of windows with one anchor make one row: (anchor, the least and
   the greatest distance of its windows' starts to the anchor). There are about 1.3 rows per 100 bytes.
2. Only anchors whose gram occurs again somewhere stay. Each map task sends one row of a gram to the others and knows
   its own repeats itself, so a gram of a third of all rows sends one row per task.
3. Suffixes. For what stays, the suffix at the anchor and the reversed text before it are cut from the text. Suffixes
   are dealt by range of their leading bytes, with splitters that Spark samples; a hash of the place breaks ties, so
   that equal suffixes too spread over buckets.
4. Buckets sort their suffixes, and the reversed texts before them, by multikey quicksort on 8-byte digits. A window
   is repeated if another row shares at least ``length - x`` bytes after the anchor and ``x`` before it: its interval in
   both orders at these depths says so, for all windows of a bucket at once.
5. Across boundaries. Suffixes with the leading bytes of a bucket's first or last one may go on in a neighbour. Their
   windows, one of each kind, are hashed to 128 bits and compared between buckets.

Cases: null and empty texts, and texts under ``length`` bytes, lose nothing; rows that repeat a doc_id are told apart by
their text, equal rows are copies of each other; very long texts are cut into rows like others; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import ranges, slices, utf8_view
from .hashing import BYTES, gram_hash, mix, powers, prefix_hash, sliding_min
from .workspace import Workspace, partitions

GRAM = 48
_BLOCK = 1 << 20
_PLACE = np.uint64((1 << 21) - 1)


def anchors(raw: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(gram hash, text number, place in the text, least and greatest distance to a window's start) of every anchor."""
    sizes = np.diff(at)
    row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    left = np.repeat(at[1:], sizes)
    found = []
    for lo in range(0, max(0, len(raw) - length + 1), _BLOCK):
        part = raw[lo : lo + _BLOCK + length - 1]
        hashed = gram_hash(prefix_hash(part), gram)[: len(part) - gram + 1]
        least = sliding_min((hashed & ~_PLACE) | np.arange(len(hashed), dtype=np.uint64), length - gram + 1)
        place = (least & _PLACE).astype(np.int64)
        start = np.arange(len(place), dtype=np.int64)
        valid = left[lo : lo + len(place)] - (start + lo) >= length
        first = valid.copy()
        first[1:] &= ~(valid[:-1] & (place[1:] == place[:-1]))
        last = valid.copy()
        last[:-1] &= ~(valid[1:] & (place[1:] == place[:-1]))
        i, j = np.flatnonzero(first), np.flatnonzero(last)
        p = place[i]
        of = row[i + lo]
        found.append((hashed[p].view(np.int64), of, p + lo - at[of], p - j, p - i))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _gather(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    held = list(batches)
    return pa.Table.from_batches(held).combine_chunks() if held else None


def _column(table: pa.Table, k: int) -> np.ndarray:
    return table.column(k).to_numpy()


def _runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of runs of equal keys."""
    new = np.ones(len(sorted_keys), dtype=bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    starts = np.flatnonzero(new)
    return starts, np.diff(np.append(starts, len(sorted_keys)))


def multikey_order(digits: np.ndarray) -> np.ndarray:
    """Order of the rows of a matrix of digits: groups of equal leading digits are split by their next digit.

    A group whose rows are equal as a whole (by a hash; this only ends its sorting) is not split further.
    """
    n, width = digits.shape
    whole = mix(digits + np.arange(1, width + 1, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    order = np.arange(n)
    active, group = np.arange(n), np.zeros(n, dtype=np.int64)
    for k in range(width):
        digit = digits[order[active], k]
        by = np.lexsort((digit, group))
        order[active] = order[active][by]
        digit = digit[by]
        new = np.ones(len(active), dtype=bool)
        new[1:] = (digit[1:] != digit[:-1]) | (group[1:] != group[:-1])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(active)))
        rest = whole[order[active]]
        mixed = np.add.reduceat(rest != np.repeat(rest[starts], sizes), starts) > 0
        many = np.repeat(mixed, sizes)
        group = np.repeat(starts, sizes)[many]
        active = active[many]
        if not len(active):
            break
    return order


def common_bytes(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Leading bytes that each row shares with the one before it in the order (0 for the first)."""
    out = np.zeros(len(order), dtype=np.int64)
    for lo in range(1, len(order), 65536):
        hi = min(len(order), lo + 65536)
        differs = rows[order[lo:hi]] != rows[order[lo - 1 : hi - 1]]
        out[lo:hi] = np.where(differs.any(axis=1), differs.argmax(axis=1), rows.shape[1])
    return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Binary values as rows of bytes, padded with zeros to a multiple of 8."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int32, count=len(column) + 1 + column.offset)[column.offset :].astype(np.int64)
    out = np.zeros((len(column), -(-width // 8) * 8), dtype=np.uint8)
    sizes = np.diff(at)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    out.reshape(-1)[ranges(np.arange(len(column), dtype=np.int64) * out.shape[1], sizes)] = raw[at[0] : at[-1]]
    return out


def repeated_windows(right: np.ndarray, left: np.ndarray, least: np.ndarray, most: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Which windows of a bucket occur twice in it.

    right, left: bytes from the anchor on, and before it in reverse. Returns flags (row, distance to the anchor), the
    order of the suffixes and the bytes that neighbours in it share.
    """
    n = len(right)
    order_r, order_l = (multikey_order(np.ascontiguousarray(m).view(">u8").astype(np.uint64)) for m in (right, left))
    lcp_r, lcp_l = common_bytes(right, order_r), common_bytes(left, order_l)
    place_l = np.empty(n, dtype=np.int64)
    place_l[order_l] = np.arange(n)
    # Everything below goes by rows in the order of their suffixes.
    lo, hi, there = least[order_r], most[order_r], place_l[order_r]
    flags = np.zeros((n, int(most.max()) + 1 if n else 1), dtype=bool)
    bits = np.uint64(max(1, int(n).bit_length()))
    for x in range(int(least.min()) if n else 0, flags.shape[1]):
        rows = np.flatnonzero((lo <= x) & (hi >= x))
        if len(rows) < 2:
            continue
        # Rows stay in order, so equal suffix intervals are neighbours.
        same_r = np.cumsum(lcp_r < length - x)[rows]
        same_l = np.cumsum(lcp_l < x)[there[rows]] if x else np.zeros(len(rows), dtype=np.int64)
        if 3 * int(bits) <= 64:
            packed = np.sort(((same_r.astype(np.uint64) << bits | same_l.astype(np.uint64)) << bits) | rows.astype(np.uint64))
            key, at = packed >> bits, (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
            starts, sizes = _runs(key)
        else:
            by = np.lexsort((same_l, same_r))
            at = rows[by]
            starts, sizes = _runs(np.rec.fromarrays([same_r[by], same_l[by]]))
        flags[at[np.repeat(sizes > 1, sizes)], x] = True
    out = np.empty_like(flags)
    out[order_r] = flags
    return out, order_r, lcp_r


def window_hashes(right: np.ndarray, left: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums whose parts add up to the hash of the window at distance x: after[:, length - x] + before[:, x]."""
    _, down = powers(left.shape[1] + 2, which)
    after = np.zeros((len(right), right.shape[1] + 1), dtype=np.uint64)
    np.cumsum(BYTES[which][right] * powers(right.shape[1], which)[0], axis=1, out=after[:, 1:])
    before = np.zeros((len(left), left.shape[1] + 1), dtype=np.uint64)
    np.cumsum(BYTES[which][left] * down[1 : left.shape[1] + 1], axis=1, out=before[:, 1:])
    return after, before


def find_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(texts with their key ``rk``, spans (rk, start, end) in UTF-8 bytes of all repeated windows)."""
    spark = docs.sparkSession
    n, gram = partitions(spark), GRAM if length > 2 * GRAM else max(1, length // 2)
    space = Workspace(spark, "suffix_dedup")
    texts = docs.select(F.col(id_col), F.coalesce(text_col, F.lit("")).alias("text"))
    texts = texts.select(id_col, F.xxhash64(id_col, "text").alias("rk"), "text")

    def list_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in slices(batches, 512):
            raw, at = utf8_view(batch.column(1))
            h, of, place, least, most = anchors(raw, at, length, gram)
            held.append((h, batch.column(0).to_numpy()[of], place, least | most << 16))
        if not held:
            return
        h, rk, place, span = (np.concatenate(x) for x in zip(*held, strict=True))
        by = np.argsort(h, kind="stable")
        h, rk, place, span = h[by], rk[by], place[by], span[by]
        starts, sizes = _runs(h)
        again = np.repeat(sizes > 1, sizes)
        # The first row of a gram tells the other tasks of it; further ones go anywhere.
        to = mix((rk + place).astype(np.uint64)).view(np.int64)
        to[starts] = h[starts]
        first = np.zeros(len(h), dtype=bool)
        first[starts] = True
        table = pa.table({"to": to, "h": h, "rk": rk, "place": place, "span": span.astype(np.int32), "again": again, "first": first})
        yield from table.to_batches(max_chunksize=65536)

    def again_anywhere(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _gather(batches)
        if table is None or not table.num_rows:
            return
        h, again, first = (_column(table, k) for k in (1, 5, 6))
        told = np.flatnonzero(first)
        by = told[np.argsort(h[told], kind="stable")]
        starts, sizes = _runs(h[by])
        keep = again.copy()
        keep[by[np.repeat(sizes > 1, sizes)]] = True
        yield from table.select(["rk", "place", "span"]).filter(pa.array(keep)).to_batches(max_chunksize=65536)

    def repeated_places() -> DataFrame:
        listed = texts.where(F.octet_length("text") >= length).select("rk", "text").mapInArrow(
            list_anchors, "to long, h long, rk long, place long, span int, again boolean, first boolean"
        )
        again = listed.repartition(n, "to").mapInArrow(again_anywhere, "rk long, place long, span int")
        return space.save(again.groupBy("rk").agg(F.collect_set(F.struct("place", "span")).alias("places")), "places")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            raw, at = utf8_view(batch.column(1))
            listed = batch.column(2)
            parts, per = listed.flatten(), np.diff(np.asarray(listed.offsets))
            place, span = np.asarray(parts.field(0)), np.asarray(parts.field(1)).astype(np.int64)
            p = place + np.repeat(at[:-1], per)
            least, most = span & 0xFFFF, span >> 16
            after = raw[ranges(p, length - least)]
            back = np.repeat(p - 1, most) - ranges(np.zeros(len(p), dtype=np.int64), most)
            columns = [
                pa.array(np.repeat(batch.column(0).to_numpy(), per)), pa.array(place), pa.array(span.astype(np.int32)),
                _binary(after, length - least), _binary(raw[back], most),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["rk", "place", "span", "suffix", "before"])

    def sort_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _gather(batches)
        if table is None or not table.num_rows:
            return
        rk, place, span = (_column(table, k).astype(np.int64) for k in range(3))
        least, most = span & 0xFFFF, span >> 16
        right, left = (_matrix(table.column(k).combine_chunks(), w) for k, w in ((3, length), (4, max(1, int(most.max())))))
        flags, order, shared = repeated_windows(right, left, least, most, length)
        edge = np.zeros((len(flags), 1), dtype=bool)
        step = np.diff(np.hstack([edge, flags, edge]).astype(np.int8), axis=1)
        r, near = np.nonzero(step == 1)
        far = np.nonzero(step == -1)[1] - 1
        yield from _rows(rk[r], place[r] - far, place[r] - near + length)
        # Suffixes that may go on in a neighbouring bucket: those with the first or the last one's leading bytes.
        cuts = np.flatnonzero(shared < gram)
        ends = np.unique(np.concatenate([np.arange(cuts[1] if len(cuts) > 1 else len(order)), np.arange(cuts[-1], len(order))]))
        for lo in range(0, len(ends), 8192):
            some = order[ends[lo : lo + 8192]]
            sums = [window_hashes(right[some], left[some], k) for k in (0, 1)]
            for x in range(int(least[some].min()), int(most[some].max()) + 1):
                rows = np.flatnonzero((least[some] <= x) & (most[some] >= x))
                if not len(rows):
                    continue
                h1, h2 = (mix(after[rows, length - x] + before[rows, x]).view(np.int64) for after, before in sums)
                known = flags[some[rows], x]
                one = np.flatnonzero(known)[np.unique(h1[known], return_index=True)[1]]
                pick = np.concatenate([np.flatnonzero(~known), one])
                at = some[rows[pick]]
                yield from _rows(rk[at], place[at] - x, place[at] - x + length, h1[pick], h2[pick], known[pick])

    def judged_windows(places: DataFrame) -> DataFrame:
        suffixes = texts.select("rk", "text").join(places, "rk").select("rk", "text", "places")
        suffixes = suffixes.mapInArrow(cut, "rk long, place long, span int, suffix binary, before binary")
        buckets = suffixes.repartitionByRange(n, F.substring("suffix", 1, gram), F.xxhash64("rk", "place"))
        return space.save(buckets.mapInArrow(sort_bucket, "rk long, start long, end long, h1 long, h2 long, known boolean"), "judged")

    # Each step is a call of its own, so that nothing refers to its shuffles when they may be freed.
    places = repeated_places()
    space.settle()
    judged = judged_windows(places)
    space.settle()
    inside = judged.where("h1 IS NULL").select("rk", "start", "end")
    # A window kind comes at most once from a slice of a bucket, so groups stay as small as the number of slices.
    across = judged.where("h1 IS NOT NULL").groupBy("h1", "h2").agg(
        F.count("*").alias("n"), F.collect_list(F.when(~F.col("known"), F.struct("rk", "start", "end"))).alias("rows")
    )
    across = across.where("n > 1").select(F.explode("rows").alias("r")).select("r.*")
    return texts, inside.unionByName(across)


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _rows(rk, start, end, h1=None, h2=None, known=None) -> Iterator[pa.RecordBatch]:
    none = pa.nulls(len(rk), pa.int64())
    table = pa.table(
        {
            "rk": rk, "start": start, "end": end, "h1": none if h1 is None else h1, "h2": none if h2 is None else h2,
            "known": pa.nulls(len(rk), pa.bool_()) if known is None else known,
        }
    )
    yield from table.to_batches(max_chunksize=65536)


def merge(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by spans; spans that touch are one run."""
    by = np.argsort(starts, kind="stable")
    starts, reach = starts[by], np.maximum.accumulate(ends[by])
    new = np.ones(len(starts), dtype=bool)
    new[1:] = starts[1:] > reach[:-1]
    return starts[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)] if len(reach) else reach


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept binary): every text without its repeated bytes."""
    texts, spans = find_repeats(docs, length, id_col, text_col)
    spans = spans.groupBy("rk").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    joined = texts.join(spans, "rk", "left").select(id_col, "text", "spans")

    def take_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            raw, at = utf8_view(batch.column(1))
            rows = []
            listed = batch.column(2)
            for k in range(batch.num_rows):
                text = raw[at[k] : at[k + 1]]
                removed = runs = 0
                if listed[k].is_valid:
                    spans = listed[k].values
                    lo, hi = merge(np.asarray(spans.field(0)), np.asarray(spans.field(1)))
                    runs, removed = len(lo), int((hi - lo).sum())
                    keep = np.ones(len(text), dtype=bool)
                    keep[ranges(lo, hi - lo)] = False
                    text = text[keep]
                rows.append((int(at[k + 1] - at[k]), removed, runs, text.tobytes()))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))],
                names=[id_col, "n_bytes", "n_removed", "n_spans", "kept"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(take_out, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def digests(removed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return removed.select(id_col, "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


__all__ = ["digests", "find_repeats", "remove_repeats"]
