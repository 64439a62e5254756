"""SentencePiece encoding and decoding through a table of distinct chunks.

A chunk is a run of whitespace markers and the characters up to the next marker. When no piece of the model has a
marker after another character, no merge can cross from one chunk into the next, so each distinct chunk is segmented
once by the library and the ids are joined back by position. A model with such a piece is encoded text by text.

The table is kept per Python worker: it holds distinct chunks only and is emptied when it passes ``max_chunks`` (the
chunks are then segmented again; nothing is left out). No shuffle is needed.

Cases: null and empty texts give no ids and an empty decoded text; repeated rows and ids are kept as they come; an
empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import ranges, slices

MARK = "▁"
_CHUNK = re.compile(r" *[^ ]+| +$")
_tables: dict[tuple[str, int], "ChunkTable"] = {}


class ChunkTable:
    def __init__(self, model: str, max_chunks: int):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = (self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size()))
        self.separable = not any(MARK in piece.lstrip(MARK) for piece in pieces) and self.sp.encode("a") == self.sp.encode(
            "a a"
        )[:1]
        self.max_chunks = max_chunks
        self.clear()

    def clear(self) -> None:
        self.code: dict[str, int] = {}
        self.surface: dict[str, str] = {}
        self.ids = array("i")
        self.starts = array("q")
        self.lengths = array("q")

    def add(self, chunks: list[str]) -> None:
        # The library itself puts the first marker before what it is given.
        encoded = self.sp.encode([c[1:] for c in chunks], num_threads=1)
        for chunk, ids, decoded in zip(chunks, encoded, self.sp.decode(encoded, num_threads=1), strict=True):
            if chunk == " ":
                ids = [self.sp.piece_to_id(MARK)]
            self.code[chunk] = len(self.starts)
            self.surface[chunk] = " " + decoded
            self.starts.append(len(self.ids))
            self.lengths.append(len(ids))
            self.ids.extend(ids)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Ids of all texts in a row, the number of ids of each text, and the decoded texts."""
        if not self.separable:
            found = [self.sp.encode(t) if t else [] for t in texts]
            flat = np.fromiter((i for ids in found for i in ids), dtype=np.int32)
            return flat, np.array([len(ids) for ids in found], dtype=np.int64), [self.sp.decode(i) if i else "" for i in found]
        if len(self.code) > self.max_chunks:
            self.clear()
        codes, per_text, decoded = array("q"), [], []
        for text in texts:
            chunks = _CHUNK.findall(" " + text.replace(MARK, " ")) if text else []
            if missing := set(chunks).difference(self.code):
                self.add(list(missing))
            codes.extend(map(self.code.__getitem__, chunks))
            per_text.append(len(chunks))
            decoded.append("".join(map(self.surface.__getitem__, chunks))[1:])
        at = np.frombuffer(codes, dtype=np.int64) if len(codes) else np.zeros(0, np.int64)
        lengths = np.frombuffer(self.lengths, dtype=np.int64)[at] if len(at) else at
        flat = np.zeros(0, np.int32)
        if len(at):
            flat = np.frombuffer(self.ids, dtype=np.int32)[ranges(np.frombuffer(self.starts, dtype=np.int64)[at], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        stops = np.concatenate([[0], np.cumsum(np.array(per_text, dtype=np.int64))])
        return flat, np.diff(ends[stops]), decoded


def _table(model: str, max_chunks: int) -> ChunkTable:
    key = (model, max_chunks)
    if key not in _tables:
        _tables[key] = ChunkTable(model, max_chunks)
    return _tables[key]


def encode_decode(
    docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", max_chunks: int = 400_000
) -> DataFrame:
    """(id_col, ids array<int>, decoded string): what the library's encode and decode give for every whole text.

    model: a SentencePiece model file that every executor can open at that path.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(model, max_chunks)
        for batch in slices(batches, 256):
            flat, counts, decoded = table.encode(batch.column(1).to_pylist())
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(decoded, pa.string())], names=[id_col, "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded string")


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of encode_decode's result."""
    return encoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
