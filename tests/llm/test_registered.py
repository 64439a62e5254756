"""The registered queries over the smallest tables against SQL or plain versions that share no code with the operators."""

import binascii
import collections
import hashlib
import re

import duckdb
import pytest
from oracle import assert_same
from test_edge_cases import brute_components, brute_removed, word_edits

from quillspark.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(sf_dir):
    return {i: t or "" for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall()}


def result(spark, sf_dir, name):
    return {r["doc_id"]: r for r in queries.QUERIES[name](spark, sf_dir).collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    assert_same(spark, sf_dir, queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_suffix_dedup(spark, sf_dir, texts):
    got = result(spark, sf_dir, "op1_suffix_dedup")
    ids = sorted(texts)
    want = dict(zip(ids, brute_removed([texts[i].encode() for i in ids], 200), strict=True))
    assert {i: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in got.items()} == want


def test_line_dedup(spark, sf_dir, texts):
    """Every pair of lines is compared by word edits; one line of each group stays, in the smallest document."""
    places = collections.defaultdict(list)
    for i in sorted(texts):
        for k, line in enumerate(texts[i].split("\n")):
            form = tuple(w for w in re.split(r"[\W_]+", re.sub("[1-9]", "0", line.lower())) if w)
            if form:
                places[form].append((i, k))
    forms = sorted(places, key=len)
    label = {f: f for f in forms}

    def root(f):
        while label[f] != f:
            f = label[f]
        return f

    bags = [collections.Counter(f) for f in forms]
    links = 0
    for a, f in enumerate(forms):
        for b in range(a + 1, len(forms)):
            g = forms[b]
            most = int(0.2 * len(g) + 1e-9)
            if len(g) - len(f) > most:
                break
            if sum((bags[b] - bags[a]).values()) <= most and word_edits(f, g) <= most:
                label[root(g)] = root(f)
                links += 1
    groups = collections.defaultdict(list)
    for f in forms:
        groups[root(f)] += places[f]
    gone = collections.Counter()
    for members in groups.values():
        gone.update(i for i, _ in sorted(members)[1:])
    got = result(spark, sf_dir, "op2_line_dedup")
    assert links > 40 and {i: r["n_removed"] for i, r in got.items()} == {i: gone[i] for i in got}


def test_sentencepiece(spark, sf_dir, texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.model_path())
    for i, r in result(spark, sf_dir, "op3_sentencepiece").items():
        ids = sp.encode(texts[i])
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), sp.decode(ids))]
        assert [r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]] == [len(ids), *digest]


def test_ngram_join(spark, sf_dir, texts):
    got = result(spark, sf_dir, "op6_ngram_join")
    assert {(i, r["n_shingles"], r["component_id"]) for i, r in got.items()} == set(map(tuple, brute_components(sorted(texts.items()))))


def test_quality_rules(spark, sf_dir, texts):
    for i, r in result(spark, sf_dir, "op7_quality_rules").items():
        words, seen = WORD.findall(texts[i]), collections.Counter()
        windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        seen.update(windows)
        repeated = {k + d for k, w in enumerate(windows) if seen[w] > 1 for d in range(5)}
        lines = [line for line in texts[i].split("\n") if WORD.search(line)]
        want = (len(words), sum(map(len, words)), sum(texts[i].count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        failed = len(words) < 10 or 100 * len(repeated) > 20 * len(words)
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_language_id(spark, sf_dir, texts):
    learned = {x for (x,) in duckdb.sql(f"SELECT DISTINCT lang FROM '{sf_dir}/documents.parquet' WHERE lang IS NOT NULL").fetchall()}
    for i, r in result(spark, sf_dir, "op8_language_id").items():
        assert r["held_out"] == (binascii.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        assert r["lang_pred"] in learned if any(c.isalpha() for c in texts[i]) else r["lang_pred"] == "und"
