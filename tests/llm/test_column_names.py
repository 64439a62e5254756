"""Columns that clash with others in case, hold backticks or dots, or repeat; empty tables; and recall of line links by length."""

import random

import pytest

import corpus_pipeline
from quillspark.llm import line_dedup, quality_rules
from quillspark.llm.columns import pick

NAMES = ["doc_id", "text", "lang", "source", "n_chars", "TEXT", "Doc_Id", "a`b", "c.d", "N_WORDS", "failed_", "n_removed", "words", "KEPT"]


@pytest.fixture(scope="module")
def odd(spark):
    said = "one line of many words that is here twice and more\n\nanother line of the text"
    rows = [(k, said if k % 2 else f"text number {k} has some words of its own and is not too short", "en", "s", 9, "T", "D", "b", "d", "n", "f", "r", "w", "k") for k in range(6)]
    kinds = "a0 long, a1 string, a2 string, a3 string, a4 long, " + ", ".join(f"a{i} string" for i in range(5, len(NAMES)))
    return spark.createDataFrame(rows, kinds).toDF(*NAMES)


def test_pick(odd):
    assert [tuple(r) for r in pick(odd, "doc_id", "TEXT").collect()] == [(k, "T") for k in range(6)]
    with pytest.raises(ValueError):
        pick(odd, "tExT")
    assert pick(odd.toDF(*["x"] * len(NAMES)), "x").columns == ["x"]


def test_line_dedup_keeps_all_columns(odd):
    for docs in (odd, odd.limit(0)):
        kept = line_dedup.dedup_lines(docs)
        assert kept.columns == [*(c for c in NAMES if c != "n_removed"), "n_lines", "n_removed"]
        rows = sorted(kept.collect(), key=lambda r: r[0])
        assert len(rows) == docs.count() and all(r[5] == "T" and r[6] == "D" and r[7] == "b" and r[8] == "d" for r in rows)
        if rows:
            assert [r[-1] for r in rows] == [0, 0, 1, 2, 1, 2] and rows[3][1] == ""


def test_quality_rules_keep_all_columns(odd):
    for docs in (odd, odd.limit(0)):
        book = quality_rules.apply_policy(quality_rules.ledger(docs, ["bad"]))
        assert book.columns[:9] == NAMES[:9] and "n_words" in book.columns and "N_WORDS" not in book.columns
        assert [r[0] for r in sorted(book.collect(), key=lambda r: r[0])] == [r[0] for r in sorted(docs.collect(), key=lambda r: r[0])]


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_all_columns(spark, sf_dir, odd, k):
    stage = corpus_pipeline.STAGES[k][1]
    for docs in (odd, odd.limit(0)):
        out = stage(spark, docs, sf_dir)
        assert out.columns == NAMES
        assert all(tuple(r)[5:9] == ("T", "D", "b", "d") for r in out.collect())


def test_last_stage_reads_its_own_columns(spark, sf_dir, odd):
    out = corpus_pipeline.STAGES[4][1](spark, odd, sf_dir)
    assert out.count() == 6 and {r["n_tokens"] > 3 for r in out.collect()} == {True}
    assert corpus_pipeline.STAGES[4][1](spark, odd.limit(0), sf_dir).count() == 0


def pairs_of(rng, length, n):
    """n pairs of lines of so many words, a fifth of which differ, in places drawn at random."""
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(4, 9))) for _ in range(4000)]
    for _ in range(n):
        a = [rng.choice(words) for _ in range(length)]
        b = list(a)
        for at in rng.sample(range(length), length // 5):
            b[at] = rng.choice(words) + "x"
        yield " ".join(a), " ".join(b)


def test_no_link_is_missed_without_a_cap(spark):
    """With all pairs that the edit budget asks for, every link is found at every length; with the default cap nearly all."""
    rng = random.Random(5)
    lengths, n = (30, 60, 100, 200), 25
    docs, k = [], 0
    for length in lengths:
        for a, b in pairs_of(rng, length, n):
            docs += [(k, a), (k + 1, b)]
            k += 2
    table = spark.createDataFrame(docs, "doc_id long, text string")
    for keys, least in ((None, 1.0), (line_dedup.KEYS, 0.95)):
        gone = {r["doc_id"] for r in line_dedup.dedup_lines(table, keys=keys).where("n_removed > 0").collect()}
        assert not any(i % 2 == 0 for i in gone)  # the smaller id of a pair stays
        for j, length in enumerate(lengths):
            mine = range(2 * n * j + 1, 2 * n * (j + 1), 2)
            assert sum(i in gone for i in mine) >= least * n - (0 if keys is None else 1), (keys, length)
