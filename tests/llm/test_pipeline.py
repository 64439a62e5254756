"""Every stage of the pipeline against a plain version of it, on the smallest tables."""

import collections

import corpus_pipeline
import pytest
from test_edge_cases import brute_components

from quillspark.llm import decontaminate, line_dedup, quality_rules, queries
from quillspark.llm.workspace import Workspace


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    space, out = Workspace(spark, "test_pipeline"), [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out.append(space.save(stage(spark, out[-1], sf_dir), f"s{k}"))
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_names_and_columns(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "SentencePiece encoding and decoding"
    ]
    assert all(df.columns == stages[0].columns for df in stages[1:5])
    sizes = [df.count() for df in stages]
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0]


def test_quality_stage(spark, sf_dir, stages):
    lexicon = quality_rules.fit_lexicon(stages[0], spark.read.parquet(f"{sf_dir}/labels.parquet"))
    book = quality_rules.ledger(stages[0], lexicon).collect()
    assert set(rows(stages[1])) == {r["doc_id"] for r in book if not r["failed"]}
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    clean = [i for i, r in labels.items() if r["quality"] and not r["toxic"]]
    assert sum(i in rows(stages[1]) for i in clean) > 0.95 * len(clean)


def test_line_stage(spark, stages):
    before, after = rows(stages[1]), rows(stages[2])
    lines, groups = line_dedup.find_groups(stages[1])
    label = {r["lk"]: (r["label"], r["keep_doc"]) for r in groups.collect()}
    seen, gone = set(), collections.defaultdict(set)
    for r in sorted(lines.collect(), key=lambda r: (r["doc_id"], r["line_no"])):
        if r["lk"] in label:
            if label[r["lk"]][0] in seen:
                gone[r["doc_id"]].add(r["line_no"])
            seen.add(label[r["lk"]][0])
    for i, r in before.items():
        parts = r["text"].split("\n")
        kept = "\n".join(x for k, x in enumerate(parts) if k not in gone[i])
        if i in after:
            assert after[i]["text"] == kept and after[i]["n_chars"] == len(kept)
        else:
            assert not any(c.isalnum() for c in kept) and gone[i]


def test_near_duplicate_stage(stages):
    before, after = rows(stages[2]), rows(stages[3])
    assert set(after) == {i for i, _, least in brute_components([(i, r["text"]) for i, r in before.items()]) if i == least}


def test_decontamination_stage(spark, sf_dir, stages):
    before, after = rows(stages[3]), rows(stages[4])
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    plain = [decontaminate.normalize(t) for _, t in items]
    for i, r in before.items():
        text = decontaminate.normalize(r["text"])
        holds = any(decontaminate.myers(p, text)[0] <= decontaminate.budget(len(p), 0.06, 8) for p in plain)
        assert (i in after) == (not holds)


def test_token_stage(spark, sf_dir, stages):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.model_path())
    texts = rows(stages[4])
    got = rows(stages[5])
    assert set(got) == set(texts)
    assert all(list(got[i]["ids"]) == sp.encode(r["text"]) for i, r in texts.items())
    whole = corpus_pipeline.run(spark, sf_dir)
    assert {r["doc_id"]: r["ids_sha256"] for r in whole.collect()} == {i: r["ids_sha256"] for i, r in got.items()}
