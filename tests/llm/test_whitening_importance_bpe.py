"""Whitening, importance resampling and byte-level BPE against plain versions, and their edge cases."""

import binascii
import collections
import hashlib
import math
import random
import re
import struct

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import byte_bpe, importance, queries, whitening

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def texts(sf_dir):
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall())


@pytest.fixture(scope="module")
def library():
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def table():
    return byte_bpe.WordTable(RANKS, public_tokenizers.PATTERN, 500, 20_000)  # small: emptied again and again


# byte-level BPE


def test_bpe_query(spark, sf_dir, texts, library):
    rows = queries.op13_byte_bpe(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]] or ""
        ids = library.encode_ordinary(text)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        want = (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == want


HARD = st.text(alphabet=st.one_of(st.sampled_from("aabbbeeinst  \n\t'012!?"), st.characters(exclude_categories=["Cs"])), max_size=80)


@settings(max_examples=300, deadline=None)
@given(st.lists(HARD, max_size=6))
def test_bpe_equals_library(table, library, found):
    flat, counts = table.encode(found)
    want = [library.encode_ordinary(t) for t in found]
    assert counts.tolist() == list(map(len, want)) and flat.tolist() == [i for ids in want for i in ids]
    data, _ = table.merges.decode(flat)
    assert data.tobytes() == "".join(found).encode()


def test_bpe_long_words_and_ties(table, library):
    rng = random.Random(3)
    hard = ["a" * 3001, "ab" * 999, "\u00e9" * 700, "".join(rng.choice("aeinst") for _ in range(20_000)), "<|endoftext|>", " " * 501 + "x", "0" * 777]
    flat, counts = table.encode(hard)
    want = [library.encode_ordinary(t) for t in hard]
    assert flat.tolist() == [i for ids in want for i in ids] and counts.tolist() == list(map(len, want))


ROWS = [(1, None), (2, ""), (3, "  \n"), (4, "one two"), (4, "one two"), (None, "one two"), (5, "lorem ipsum " * 30_000)]


def clashing(spark, rows, kind):
    """Columns that differ from the operator's in case only, hold a backtick, or have names that it uses itself."""
    wide = [(*r, "x", "y", "z", "w") for r in rows]
    return spark.createDataFrame(wide, f"key long, value {kind}, a string, b string, c string, d string")


def test_bpe_words_of_one_corpus(library):
    """Many words that share pairs, merged together, give what each gives alone."""
    rng = random.Random(8)
    words = ["".join(rng.choice("aabeinrst") for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    flat, counts = byte_bpe.Merges(RANKS).replay([w.encode() for w in words])
    ends = np.cumsum(counts)
    for word, end, n in zip(words, ends.tolist(), counts.tolist(), strict=True):
        assert flat[end - n : end].tolist() == library._core_bpe.encode_single_piece(word.encode()) or len(library.encode_ordinary(word)) == 1


def test_bpe_edge_cases(spark, library):
    docs = clashing(spark, ROWS, "string").toDF("doc_id", "text", "TEXT", "Doc_Id", "a`b", "ids")
    got = byte_bpe.encode_decode(docs.repartition(2), RANKS, public_tokenizers.PATTERN, bytes_at_once=20).collect()
    want = [(i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in ROWS]
    assert sorted(((r["doc_id"] or 0, r["ids"], bytes(r["decoded"])) for r in got)) == sorted((i or 0, x, t) for i, x, t in want)
    digest = byte_bpe.digests(byte_bpe.encode_decode(docs.limit(0), RANKS, public_tokenizers.PATTERN))
    assert digest.count() == 0 and digest.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


# importance resampling


def plain_features(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)
    grams = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), [binascii.crc32(g.encode()) % 10_000 for g in grams]


def plain_resample(rows, target, percent=5):
    found = [(i, *plain_features(t)) for i, t in rows]
    s = collections.Counter(b for _, _, f in found for b in f)
    t = collections.Counter(b for x in target for b in plain_features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000)))) for b in range(10_000)]
    out = []
    for i, n, f in found:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[5] = k + 1
    return sorted(((-1 if r[0] is None else r[0], *r[2:]) for r in out), key=str)


def test_importance_query(spark, sf_dir, texts):
    target = [t for (t,) in duckdb.sql(f"SELECT text FROM '{sf_dir}/benchmark.parquet'").fetchall()]
    got = queries.op12_importance(spark, sf_dir).collect()
    assert [c for c in ("doc_id", "n_features", "weight", "score", "rank")] == list(got[0].asDict())
    assert sorted(map(tuple, got), key=str) == plain_resample(sorted(texts.items()), target)


def test_importance_edge_cases(spark):
    rng = random.Random(4)
    word = ["Caf\u00e9", "ZEBRA", "x1", "\u4e16\u754c", "co-op", "a_b", "\u00c9A"]
    rows = ROWS + [(k, " ".join(rng.choice(word) for _ in range(rng.randint(15, 40)))) for k in range(10, 90)]
    rows += [rows[-1], (None, rows[-1][1]), (91, rows[-2][1])]
    docs = clashing(spark, rows, "string").toDF("doc_id", "text", "TEXT", "Doc_Id", "a`b", "weight").repartition(5)
    target = spark.createDataFrame([("zebra caf\u00e9 co op", 1), (None, 2), ("", 3)], "text string, TEXT_ long")
    got = importance.resample(docs, target, percent=50).collect()
    have = [(-1 if r["doc_id"] is None else r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in got]
    assert sorted(have, key=str) == plain_resample(rows, ["zebra caf\u00e9 co op"], 50)
    empty = importance.resample(docs.limit(0), target.limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]


def test_importance_dictionary_is_emptied(spark):
    docs = spark.createDataFrame([(k, f"w{k} w{k + 1} same w{k} end") for k in range(600)], "doc_id long, text string").coalesce(1)
    few = sorted(map(tuple, importance.bucket_counts(docs, max_words=7).collect()))
    assert few == sorted(map(tuple, importance.bucket_counts(docs).collect())) and sum(n for _, n in few) == 600 * 12


# whitening


def plain_whitening(rows, components=16):
    fit = {tuple(math.floor(64 * c) + 1_000_000 for c in v) for _, v in rows}
    x = np.array(sorted(fit), dtype=np.float64)
    n, s = len(fit), [sum(column) for column in zip(*fit, strict=True)]
    centred = x - x.mean(axis=0)
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    order = np.argsort(-e)[:components]
    out = []
    for i, c in rows:
        lattice = [math.floor(64 * float(a)) + 1_000_000 for a in c]
        deviation = sum((n * a - b) ** 2 for a, b in zip(lattice, s, strict=True))
        w = (np.array(lattice, dtype=np.float64) - x.mean(axis=0)) @ u[:, order] / np.sqrt(e[order])
        out += [(i, k + 1, n, deviation, abs(w[k]), e[order[k]] / np.trace(v)) for k in range(len(order))]
    return out


def same_whitening(got, want):
    got, want = sorted(got), sorted(want)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert np.allclose([r[4:] for r in got], [r[4:] for r in want], rtol=1e-6, atol=1e-6)


def values(found):
    rows = found.collect()
    assert all(0 <= r["identity_error"] <= 1e-9 for r in rows) and len({r["identity_error"] for r in rows}) <= 1
    return [(r["vec_id"], r["component"], r["n"], r["deviation"], abs(r["whitened"]), r["explained"]) for r in rows]


def test_whitening_query(spark, sf_dir):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{sf_dir}/embeddings.parquet'").fetchall()
    same_whitening(values(queries.op11_whitening(spark, sf_dir)), plain_whitening(rows))


def test_whitening_edge_cases(spark):
    rng = np.random.default_rng(1)
    good = [(k, rng.normal(size=5).tolist()) for k in range(60)]
    good += [(100, good[0][1]), (101, good[0][1])] + [good[0]] * 50 + [(7, good[3][1])]
    bad = [(200, None), (201, []), (202, [1.0, None, 1.0, 1.0, 1.0]), (203, [float("nan")] * 5), (204, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (205, [1.0, 2.0])]
    table = clashing(spark, good + bad, "array<double>").toDF("vec_id", "embedding", "EMBEDDING", "Vec_Id", "a`b", "n").repartition(7)
    same_whitening(values(whitening.whiten(table, whitening.fit(table))), plain_whitening(good))
    # one distinct vector has no direction, an empty table no vector
    for rows in (spark.createDataFrame([(101, good[0][1])] * 3, "vec_id long, embedding array<double>"), table.limit(0)):
        model = whitening.fit(rows)
        assert model is None and whitening.whiten(rows, model).count() == 0


def test_whitening_far_values(spark):
    """Sums beyond 64 bits stay exact; deviations that no long holds are null."""
    far = [(k, [3e15 * (k + 1), float(k * k), 0.5 * (k % 2)]) for k in range(12)]
    table = spark.createDataFrame(far, "vec_id long, embedding array<double>")
    model = whitening.fit(table)
    assert model.sums == [sum(math.floor(64 * v[d]) + 1_000_000 for _, v in far) for d in range(3)]
    assert all(r["deviation"] is None for r in whitening.whiten(table, model).collect())


def test_merge_tree_equals_whole(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1000, (500, 6)) + 1_000_000
    parts = [whitening.Moments.of(x[a:b]) for a, b in ((0, 1), (1, 7), (7, 7 + 300), (307, 500))]
    merged = parts[3].merged(parts[1]).merged(whitening.NOTHING).merged(parts[0].merged(parts[2]))
    assert merged.n == 500 and merged.sums == x.sum(axis=0).tolist()
    assert np.allclose(merged.scatter / 500, np.cov(x.T, bias=True), rtol=1e-12)
