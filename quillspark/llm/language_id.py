"""Language identification with error-correcting output codes.

Every language gets a codeword of bits. One binary classifier per bit, over hashed byte n-grams of the letters, says
which side of the bit a text is on; loss-weighted decoding picks the language whose codeword costs least, and texts
whose second-best codeword costs nearly as little are flagged as ambiguous.

Fitting takes a bounded sample of labelled rows: about ``rows_per_language`` rows of each language (rows whose hash of
the id falls under a threshold set by the language's count), whole texts. Ridge regression on that sample is solved on
the driver; its size does not grow with the input. Prediction runs over all rows in tasks, without a shuffle.

Cases: null texts and texts without a letter give ``und`` with score 0; rows with a null language are not learned
from; with no labelled row every text is ``und``; with one language every text with a letter gets it; repeated rows
and an empty table go through; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import slices, utf8_view

UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits, +1 or -1
    weights: np.ndarray  # (features + 1) x bits
    bit_loss: np.ndarray  # weight of each bit in decoding
    features: int


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """n rows of +1/-1: the exhaustive code up to five languages, else the best of random ones by least distance."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        cols = [[1 if (mask >> k) & 1 else -1 for k in range(n)] for mask in range(1, 2 ** (n - 1))]
        return np.array(cols, dtype=float).T
    rng = np.random.default_rng(seed)
    bits = max(15, 4 * int(np.ceil(np.log2(n))))
    best, far = None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], size=(n, bits))
        apart = (bits - code @ code.T) / 2 + np.eye(n) * bits
        usable = np.abs(code.sum(axis=0)).max() < n
        if usable and apart.min() > far:
            best, far = code, apart.min()
    return best


# Byte classes: letters in lower case, bytes of other scripts as they are, everything else a space.
_FOLD = np.full(256, 32, dtype=np.uint64)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def featurize(texts: pa.Array, features: int) -> np.ndarray:
    """Rows of square-rooted, length-normalised counts of hashed byte 1- to 4-grams."""
    raw, at = utf8_view(texts)
    n = len(at) - 1
    out = np.zeros((n, features), dtype=np.float32)
    if not len(raw):
        return out
    folded = _FOLD[raw]
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(at))
    counts = np.zeros(n * features, dtype=np.int64)
    gram = np.zeros(len(raw), dtype=np.uint64)
    for size in range(1, 5):
        gram = gram[: len(raw) - size + 1] * np.uint64(256) + folded[size - 1 :]
        if not len(gram):
            break
        hashed = (gram + np.uint64(size)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)
        whole = row[: len(gram)] == row[size - 1 :]
        key = row[: len(gram)] * features + (hashed % np.uint64(features)).astype(np.int64)
        counts += np.bincount(key[whole], minlength=n * features)
    out = np.sqrt(counts.reshape(n, features)).astype(np.float32)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def has_letter(texts: list[str | None]) -> np.ndarray:
    return np.array([t is not None and any(map(str.isalpha, t)) for t in texts], dtype=bool)


def fit(
    docs: DataFrame, id_col: str = "doc_id", rows_per_language: int = 400, features: int = 4096, ridge: float = 0.3
) -> Model:
    """Fit on about rows_per_language rows of each language among ``docs`` (columns: id, text, lang)."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    totals = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(totals)
    if not languages:
        return Model([], np.ones((0, 1)), np.zeros((features + 1, 1)), np.ones(1), features)
    if len(languages) == 1:
        return Model(languages, np.ones((1, 1)), np.ones((features + 1, 1)), np.ones(1), features)
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, rows_per_language / totals[lang]))])
    drawn = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000
    sample = labelled.where(drawn).select("text", "lang").toPandas()
    sample = sample.sort_values(["lang", "text"], kind="stable")
    x = featurize(pa.array(sample["text"], pa.large_string()), features).astype(np.float64)
    x = np.hstack([x, np.ones((len(x), 1))])
    code = codewords(len(languages))
    y = code[np.searchsorted(languages, sample["lang"].to_numpy())] if len(sample) else np.zeros((0, code.shape[1]))
    # Rows of rarer languages weigh as much in all as those of common ones.
    _, inverse, sizes = np.unique(sample["lang"].to_numpy(), return_inverse=True, return_counts=True)
    heft = np.sqrt((len(sample) / len(sizes)) / sizes[inverse])[:, None]
    xw, yw = x * heft, y * heft
    dual = np.linalg.solve(xw @ xw.T + ridge * np.eye(len(xw)), yw)
    weights = xw.T @ dual
    wrong = (np.sign(x @ weights) != y).mean(axis=0)
    return Model(languages, code, weights, 1.0 / (0.01 + wrong), features)


def decode(model: Model, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Loss-weighted decoding: index of the nearest codeword, and how far the second-best lies behind (0 to 1)."""
    loss = np.maximum(0.0, 1.0 - margins[:, None, :] * model.code[None, :, :]) ** 2 @ (model.bit_loss / model.bit_loss.sum())
    if loss.shape[1] == 1:
        return np.zeros(len(loss), dtype=np.int64), np.ones(len(loss))
    two = np.partition(loss, 1, axis=1)[:, :2]
    return loss.argmin(axis=1), (two[:, 1] - two[:, 0]) / np.maximum(two[:, 1] + two[:, 0], 1e-12)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", ambiguous_below: float = 0.2) -> DataFrame:
    """(id_col, lang_pred, score, ambiguous) of every row, from its text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, UNKNOWN], dtype=object)
        for batch in slices(batches, 128):
            letters = has_letter(batch.column(1).to_pylist())
            pick = np.full(batch.num_rows, len(names) - 1)
            score = np.zeros(batch.num_rows)
            if model.languages:
                x = featurize(batch.column(1), model.features)
                best, lead = decode(model, x @ model.weights[:-1].astype(np.float32) + model.weights[-1])
                pick[letters], score[letters] = best[letters], lead[letters]
            columns = [batch.column(0), pa.array(names[pick], pa.string()), pa.array(score), pa.array(score < ambiguous_below)]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "lang_pred", "score", "ambiguous"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, "text").mapInArrow(
        run, f"`{id_col}` {kind}, lang_pred string, score double, ambiguous boolean"
    )
