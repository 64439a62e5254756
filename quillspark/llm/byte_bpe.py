"""Byte-level BPE by replaying the merges over all distinct words of a batch at once.

Texts are cut by the split pattern. The distinct words that a Python worker has not met yet form one corpus: their bytes
lie in a row, an inverted index leads from each rank to the places where two neighbours make the token of that rank, and
ranks are taken in order, lowest first; a merge looks again at its two neighbours only. Within a rank places are taken
from left to right, and a merge that brings up a lower rank lets that go first, so every word is merged in the very order
in which the library would merge it alone. A word that is a token itself is that token. Ids go back to the words' places
in the texts; decoding looks up the bytes of every id.

The table of words belongs to a worker and is emptied when it passes ``max_words`` words or ``max_bytes`` of them (words are
then merged again; nothing is left out): one table for all tasks would need a shuffle of every word. No shuffle is needed.

Cases: null and empty texts have no ids and decode to nothing; texts and single words of any length are encoded whole;
repeated rows and ids are kept as they come; equal pairs in a word merge from the left; strings of special tokens are ordinary
text; an empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .arrow_text import ranges, slices
from .columns import pick

_SHIFT = 32
_tables: dict[tuple, "WordTable"] = {}


class Merges:
    """The tokens of a rank file, and for each pair of tokens the rank of the token that they make."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            rank = {base64.b64decode(token): int(at) for token, at in (line.split() for line in lines if line.strip())}
        self.rank = rank
        self.single = np.array([rank[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = sorted(
            (rank[token[:cut]] << _SHIFT | rank[token[cut:]], at)
            for token, at in rank.items()
            for cut in range(1, len(token))
            if token[:cut] in rank and token[cut:] in rank
        )
        self.pair_keys = np.array([key for key, _ in pairs], dtype=np.int64)
        self.pair_ranks = np.array([at for _, at in pairs], dtype=np.int64)
        tokens = [b""] * (max(rank.values()) + 1)
        for token, at in rank.items():
            tokens[at] = token
        self.data = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All bytes of the ids in a row, and the number of bytes of each id."""
        lengths = self.lengths[ids]
        return self.data[ranges(self.starts[ids], lengths)], lengths

    def made(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair of tokens makes, -1 where it makes none."""
        keys = left << _SHIFT | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], -1)

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and the number of ids of each word. No word is empty."""
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        ends = np.cumsum(lengths)
        token = self.single[np.frombuffer(b"".join(words), dtype=np.uint8)]
        n = len(token)
        word = np.repeat(np.arange(len(words)), lengths)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1], before[ends - lengths] = -1, -1
        index: dict[int, list[np.ndarray]] = {}
        waiting: list[int] = []

        def note(places: np.ndarray) -> None:
            """Put places that make a token with what follows into the index."""
            rank = self.made(token[places], token[after[places]])
            order = np.argsort(rank, kind="stable")
            order = order[np.searchsorted(rank[order], 0) :]
            if not len(order):
                return
            rank, places = rank[order], places[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, part in zip(rank[np.concatenate([[0], cuts])].tolist(), np.split(places, cuts) if len(cuts) else [places], strict=True):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heappush(waiting, r)

        note(np.flatnonzero(after >= 0))
        while waiting:
            rank = heappop(waiting)
            parts = index.pop(rank)
            places = np.sort(np.concatenate(parts)) if len(parts) > 1 else parts[0]
            # Some have been merged away since, or what follows has.
            live = (token[places] >= 0) & (after[places] >= 0)
            places = places[live]
            places = places[self.made(token[places], token[after[places]]) == rank]
            if not len(places):
                continue
            # The first place of each word; it may bring up a lower rank, which goes before the word's other places.
            first = np.ones(len(places), dtype=bool)
            first[1:] = word[places[1:]] != word[places[:-1]]
            if not first.all():
                index[rank] = [places[~first]]
                heappush(waiting, rank)
            left = places[first]
            right = after[left]
            beyond = after[right]
            token[left], token[right], after[left] = rank, -1, beyond
            has = beyond >= 0
            before[beyond[has]] = left[has]
            ahead = before[left]
            note(np.sort(np.concatenate([ahead[ahead >= 0], left[has]])))
        kept = token >= 0
        return token[kept], _sums(kept.astype(np.int64), lengths)


class WordTable:
    """Ids of the distinct words that a worker has met."""

    def __init__(self, path: str, pattern: str, max_words: int, max_bytes: int):
        import regex

        self.split = regex.compile(pattern).findall
        self.merges = Merges(path)
        self.max_words, self.max_bytes = max_words, max_bytes
        self.clear()

    def clear(self) -> None:
        self.code: dict[str, int] = {}
        self.size = 0
        self.ids, self.starts, self.lengths = array("i"), array("q"), array("q")

    def add(self, words: list[str]) -> None:
        """Ids of words that have their codes, in the order of these."""
        raw = [w.encode() for w in words]
        whole = [self.merges.rank.get(w, -1) for w in raw]
        alone = np.array(whole, dtype=np.int64)
        open_ = alone < 0
        counts = np.ones(len(raw), dtype=np.int64)
        flat = np.zeros(0, np.int64)
        if open_.any():
            flat, counts[open_] = self.merges.replay([w for w, rank in zip(raw, whole, strict=True) if rank < 0])
        ids = np.empty(int(counts.sum()), dtype=np.int32)
        inside = np.repeat(open_, counts)
        ids[inside], ids[~inside] = flat, alone[~open_]
        self.starts.frombytes((len(self.ids) + np.cumsum(counts) - counts).tobytes())
        self.lengths.frombytes(counts.tobytes())
        self.ids.frombytes(ids.tobytes())
        self.size += sum(map(len, raw))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of ids of each text."""
        if len(self.code) > self.max_words or self.size > self.max_bytes:
            self.clear()
        code, codes, per_text, new = self.code, array("q"), [], []
        for text in texts:
            words = self.split(text) if text else []
            for word in set(words).difference(code):
                code[word] = len(code)
                new.append(word)
            codes.extend(map(code.__getitem__, words))
            per_text.append(len(words))
        if new:
            self.add(new)
        at = np.array(codes, dtype=np.int64)
        lengths = np.array(self.lengths, dtype=np.int64)[at] if len(at) else at
        flat = np.zeros(0, np.int32)
        if len(at):
            flat = np.array(self.ids, dtype=np.int32)[ranges(np.array(self.starts, dtype=np.int64)[at], lengths)]
        return flat, _sums(lengths, np.array(per_text, dtype=np.int64))


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each run of ``values``; runs have ``counts`` entries."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def _portions(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text, one row at least."""
    for batch in batches:
        size = pc.cumulative_sum(pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())).to_numpy()
        at = 0
        while at < batch.num_rows:
            before = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, before + most, side="right")))
            yield batch.slice(at, end - at)
            at = end


def _offsets(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)])


def encode_decode(
    docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", max_words: int = 500_000,
    max_bytes: int = 64_000_000, bytes_at_once: int = 8_000_000,
) -> DataFrame:
    """(id_col, ids array<int>, decoded binary) of every whole text.

    ranks: a file of tokens in base 64 with their ranks that every executor can open at that path; pattern: how texts are
    cut before merging; bytes_at_once: how much text is one corpus of the merge replay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (ranks, pattern, max_words, max_bytes)
        if key not in _tables:
            _tables[key] = WordTable(*key)
        table = _tables[key]
        for batch in _portions(batches, bytes_at_once):
            flat, counts = table.encode(batch.column(1).to_pylist())
            data, sizes = table.merges.decode(flat)
            ids = pa.ListArray.from_arrays(pa.array(_offsets(counts), pa.int32()), pa.array(flat, pa.int32()))
            ends = pa.py_buffer(_offsets(_sums(sizes, counts)).astype(np.int32))
            decoded = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, ends, pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, decoded], names=[id_col, "ids", "decoded"])

    docs = pick(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded binary")


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of encode_decode's result: ids as little-endian unsigned 32-bit integers, decoded bytes as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            ids, decoded = batch.column(1), batch.column(2)
            ends = np.asarray(ids.offsets, dtype=np.int64)
            flat = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<u4"))).cast("B")
            spans = zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)
            columns = [
                batch.column(0),
                pa.array(np.diff(ends)),
                pa.array([hashlib.sha256(flat[4 * a : 4 * b]).hexdigest() for a, b in spans], pa.string()),
                pa.array([hashlib.sha256(d.as_buffer()).hexdigest() for d in decoded], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = encoded.schema[id_col].dataType.simpleString()
    chosen = encoded.select(id_col, "ids", "decoded")
    return chosen.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
