"""Versioned tables, records, payloads, postings, vectors and the ingest."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from quillspark.operators import payload, records
from quillspark.operators.postings import Postings
from quillspark.operators.retrieval import keyword_search
from quillspark.operators.vectors import HASH, Embedder, VectorStore, rebuild_mismatched
from quillspark.sources.versioned import Conflict, VersionedTables


@pytest.fixture
def tables(spark, tmp_path):
    return VersionedTables(spark, f"file://{tmp_path}/tables", buckets=4)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*(columns or df.columns)).collect())


def test_versions_stay_readable(spark, tables):
    first = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    assert tables.append("t", first, key="id") == 1
    assert tables.upsert("t", spark.createDataFrame([(2, "B"), (2, "A"), (3, "c")], "id long, v string"), ["id"]) == 2
    assert tables.replace_keys("t", spark.createDataFrame([(1, "x"), (1, "y")], "id long, v string"), "id") == 3
    assert tables.delete_keys("t", spark.createDataFrame([(3,)], "id long")) == 4
    assert rows(tables.read("t", 1)) == [(1, "a"), (2, "b")]
    assert rows(tables.read("t", 2)) == [(1, "a"), (2, "B"), (3, "c")]
    assert rows(tables.read("t")) == [(1, "x"), (1, "y"), (2, "B")]
    assert rows(tables.read_keys("t", [2, 9])) == [(2, "B")] and rows(tables.read_keys("t", [])) == []
    assert [c.operation for c in tables.history("t")] == ["append", "upsert", "replace", "delete"]
    assert tables.vacuum("t", keep=1, unused_for_hours=0) >= 1 and tables.versions("t") == [4]
    assert rows(tables.read("t")) == [(1, "x"), (1, "y"), (2, "B")]
    with pytest.raises(ValueError):
        tables.read("t", 1)
    with pytest.raises(ValueError):
        tables.append("t", first.withColumn("more", F.lit(1)))


def test_empty_table_and_null_keys(spark, tables):
    empty = spark.createDataFrame([], "id string, v long")
    tables.append("t", empty, key="id")
    assert tables.read("t").count() == 0 and tables.read("t").columns == ["id", "v"]
    tables.append("t", spark.createDataFrame([(None, 1), ("", 2), ("a`b", 3)], "id string, v long"))
    assert rows(tables.read("t"), "v") == [(1,), (2,), (3,)]


def test_a_batch_is_written_once(spark, tables):
    one = spark.createDataFrame([(1,)], "id long")
    for number in (0, 0, 1, 0, 1):
        tables.append("t", one, batch=("w", number))
    tables.append("t", one, batch=("other", 0))
    assert tables.read("t").count() == 3


def test_only_touched_buckets_are_rewritten(spark, tables):
    tables.append("t", spark.range(100).withColumnRenamed("id", "k").withColumn("v", F.lit(0)), key="k")
    before = tables.commit("t").folders
    tables.upsert("t", spark.createDataFrame([(5, 1)], "k long, v int"), ["k"])
    after = tables.commit("t").folders
    assert sum(before[b] != after[b] for b in before) == 1 and tables.read("t").count() == 100


def test_two_writers_lose_nothing(spark, tables):
    """Both create editions of one project at a time; every number is given once and every row is there."""
    failed = []

    def write(writer: int):
        try:
            mine = VersionedTables(spark, tables.root, buckets=4)
            for k in range(3):
                new = spark.createDataFrame([("p", f"s{writer}{k}", "plan", "out", f"2024-01-0{k + 1}")], "project_id string, corpus_snapshot_id string, report_plan_id string, outline_id string, created_at string")
                records.create_editions(mine, new)
                mine.append("log", spark.createDataFrame([(writer, k)], "w int, k int"))
        except Exception as e:  # told to the test's own thread
            failed.append(e)

    threads = [threading.Thread(target=write, args=(w,)) for w in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    editions = tables.read("report_editions")
    assert [n for (n,) in rows(editions, "edition_number")] == [1, 2, 3, 4, 5, 6]
    assert len(rows(editions, "corpus_snapshot_id")) == 6 and tables.read("log").count() == 6
    by_number = {r["edition_number"]: r for r in editions.collect()}
    assert by_number[1]["parent_edition_id"] is None and by_number[4]["parent_edition_id"] == by_number[3]["edition_id"]
    assert tables.versions("report_editions") == [1, 2, 3, 4, 5, 6] and tables.read("report_editions", 2).count() == 2


def test_the_loser_of_a_race_takes_the_new_state(spark, tables):
    tables.append("t", spark.createDataFrame([(1,)], "n long"))
    asked = []

    def change(old):
        asked.append(old.count())
        if len(asked) == 1:  # another writer comes in between
            VersionedTables(spark, tables.root).append("t", spark.createDataFrame([(2,)], "n long"))
        return old.unionByName(old.agg((F.max("n") + 1).alias("n")))

    tables.transact("t", change)
    assert asked == [1, 2] and rows(tables.read("t")) == [(1,), (2,), (3,)]
    with pytest.raises(Conflict):
        VersionedTables(spark, tables.root, retries=1).transact("t", lambda old: (change_again(spark, tables, old)))


def change_again(spark, tables, old):
    tables.append("t", spark.createDataFrame([(9,)], "n long"))
    return old


NODE = "struct<node_id:string,parent_id:string,level:int,order:int,title:string,objective:string>"
PLAN = f"project_id string, snapshot_id string, title string, subtitle string, purpose string, target_reader string, report_summary string, created_at string, outline array<{NODE}>"


def test_plans(spark, tables):
    outline = [("N1", None, 1, 1, "One", "o1"), ("N2", "N1", 2, 2, "Two", "o2")]
    records.save_plans(tables, spark.createDataFrame([("p", "s", "T", None, "why", "who", "sum", "t0", outline), ("q", "s", "Q", None, "why", "who", "sum", "t0", [])], PLAN))
    plan = {r["project_id"]: r for r in tables.read("report_plans").collect()}
    outlines = {r["plan_id"]: r for r in tables.read("outlines").collect()}
    mine = outlines[plan["p"]["plan_id"]]
    assert (mine["version"], mine["approved"], mine["approved_at"]) == (1, False, None)
    assert rows(tables.read("outline_nodes"), "node_id", "order") == [("N1", 1), ("N2", 2)]
    assert json.loads(tables.read("outline_nodes").where("node_id = 'N2'").first()["payload_json"])["parent_id"] == "N1"
    new = spark.createDataFrame([(mine["outline_id"], [("N9", None, 1, 1, "Nine", "o9")]), ("unknown", [])], f"outline_id string, outline array<{NODE}>")
    records.replace_nodes(tables, new)
    records.approve(tables, new.limit(1), "t1")
    assert rows(tables.read("outline_nodes"), "node_id") == [("N9",)]
    assert rows(tables.read("outlines").where("approved"), "version", "approved_at") == [(2, "t1")] and tables.read("outlines").count() == 2
    records.update_plans(tables, spark.createDataFrame([(plan["p"]["plan_id"], "New \"T\"", None)], "plan_id string, title string, purpose string"))
    after = tables.read("report_plans").where("project_id = 'p'").first()
    assert (after["title"], after["purpose"], json.loads(after["payload_json"])["title"], json.loads(after["payload_json"])["purpose"]) == ("New \"T\"", "why", "New \"T\"", "why")
    assert [n["node_id"] for n in json.loads(after["payload_json"])["outline"]] == ["N1", "N2"]
    records.replace_nodes(tables, spark.createDataFrame([(mine["outline_id"], [])], f"outline_id string, outline array<{NODE}>"))
    assert tables.read("outline_nodes").count() == 0 and tables.read("outlines").agg(F.max("version")).first()[0] == 3


def test_reviews(spark, tables):
    issue = "struct<severity:string,issue_type:string,paragraph_id:string,description:string,recommendation:string>"
    found = [("MINOR", "A", "P1", "a", "fix a"), ("CRITICAL", "B", "P2", "b", "fix b"), ("MAJOR", "C", None, "c", None)]
    schema = f"section_id string, reviewer_type string, decision string, payload_json string, created_at string, issues array<{issue}>"
    records.save_reviews(tables, spark.createDataFrame([("s1", "technical", "REVISE", "{}", "t0", found), ("s2", "editorial", "PASS", "{}", "t0", [])], schema))
    assert tables.read("reviews").count() == 2
    mine = [r["issue_type"] for r in records.open_issues(tables).where("section_id = 's1'").orderBy("nth").collect()]
    assert mine == ["B", "C", "A"]
    gone = tables.read("review_issues").where("issue_type = 'B'").select("issue_id").unionByName(spark.createDataFrame([("no",)], "issue_id string"))
    records.resolve_issues(tables, gone)
    assert rows(tables.read("review_issues"), "issue_type", "status") == [("A", "OPEN"), ("B", "RESOLVED"), ("C", "OPEN")]


def test_snapshots_versions_and_assets(spark, tables):
    corpus = "project_id string, created_at string, source_ids array<string>"
    records.create_snapshots(tables, spark.createDataFrame([("p", "t0", ["a", "b", "a"]), ("p", "t1", []), ("q", "t0", ["c"])], corpus))
    records.create_snapshots(tables, spark.createDataFrame([("p", "t2", ["a"])], corpus))
    assert rows(tables.read("corpus_snapshots"), "project_id", "snapshot_number") == [("p", 1), ("p", 2), ("p", 3), ("q", 1)]
    assert tables.read("corpus_snapshot_sources").count() == 4
    section = "section_id string, content_markdown string, reason string, created_at string"
    for text in ("one", "two"):
        records.add_section_versions(tables, spark.createDataFrame([("s", text, "r", "t")], section))
    assert rows(tables.read("section_versions"), "version", "content_markdown") == [(1, "one"), (2, "two")]
    asset = "section_id string, visual_type string, title string, path string, status string, seq int"
    records.upsert_assets(tables, spark.createDataFrame([("s", "BAR", "a", "p", "PLANNED", 0), ("s", "TABLE", "b", "p", "RENDERED", 1)], asset))
    counts = records.upsert_assets(tables, spark.createDataFrame([("s", "BAR", "a", "p", "FAILED", 5), ("s", "BAR", "a", "p", "RENDERED", 7)], asset))
    assert rows(counts) == [("s", 2, 2, 0)]


def test_payloads(spark):
    texts = [
        ('{"a": 1}', '{"a": 1}'), ('so: {"a": {"b": "}{"}}\nend', '{"a": {"b": "}{"}}'), ('one {"a":1} two {"b":2}', '{"a":1}'), ("[1]", None), (None, None),
        ("", None), ('{bad} {"c": 1}', '{"c": 1}'), ('```json\n{"k": "q\\"}"}\n```', '{"k": "q\\"}"}'), ('{"open": 1', None),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "i int, t string")
    got = [r[1] for r in sorted(df.select("i", payload.recover_object(F.col("t"))).collect())]
    assert got == [want for _, want in texts]
    change = {"a": F.lit("x"), "none": F.lit(None).cast("string"), "list": F.array(F.lit(1))}
    set_ = [r[1] for r in sorted(df.select("i", payload.with_fields(F.col("t"), change)).collect())]
    assert json.loads(set_[0]) == {"a": "x", "list": [1]} and set_[3] == "[1]" and set_[4] is None
    assert [r[0] for r in df.orderBy("i").limit(2).select(payload.field(F.col("t"), "$.a", "int")).collect()] == [1, None]


BLOCKS = "source_id string, page int, seq int, block_id string, text string"


def test_postings_find_what_a_scan_finds(spark, tables):
    said = ["The quick brown fox", "quick-brown The", "brown quick the the quick brown", None, "", "quick", "the\nQUICK  brown", "x-y x y"]
    blocks = spark.createDataFrame([(f"s{i % 3}", 1, i, f"b{i}", t) for i, t in enumerate(said)], BLOCKS)
    index = Postings(tables)
    index.add(blocks, ("w", 0))
    for query in ("quick", "quick-brown", "the quick", '"the" quick-brown', "x-y", "nothing", "", "!!", "the quick-brown-fox"):
        for sources in (None, [], ["s0", "s2"]):
            want = keyword_search(blocks, query, sources).select("block_id", "rank", "score")
            assert rows(index.search(query, sources), "block_id", "rank", "score") == rows(want), query
    plan = index.search("quick brown")._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan
    # a source that comes again
    index.add(spark.createDataFrame([("s0", 1, 0, "b0", "slow fox")], BLOCKS), ("w", 1))
    assert rows(index.search("quick"), "block_id") == [("b1",), ("b2",), ("b5",)] and rows(index.search("slow"), "block_id") == [("b0",)]
    held = tables.read("postings").count()
    index.compact()
    assert tables.read("postings").count() < held and rows(index.search("fox"), "block_id") == [("b0",)]
    index.drop(spark.createDataFrame([("s0",)], "source_id string"))
    assert rows(index.search("fox")) == []


CHUNK = "source_id string, chunk_id string, page int, text string"


def counted(spark, dimension, name, seen):
    """An embedder that notes how many texts it gets."""

    def embed(texts):
        seen.append(texts.count())
        vec = F.transform(F.sequence(F.lit(1), F.lit(dimension)), lambda k: (F.length("text") % (k + 1)).cast("float") + 1)
        return texts.select("text_hash", vec.alias("vec"))

    return Embedder(name, dimension, embed)


def test_only_changed_texts_are_embedded(spark, tables):
    seen = []
    store = VectorStore(tables, counted(spark, 4, "four", seen))
    assert store.manifest() == {} and store.fits()
    store.upsert(spark.createDataFrame([("a", "1", 1, "one"), ("a", "2", 1, "two"), ("b", "3", 1, "three"), ("b", "4", 1, "one")], CHUNK), ("w", 0))
    store.upsert(spark.createDataFrame([("a", "1", 1, "one"), ("a", "2", 1, "two!")], CHUNK), ("w", 1))
    assert [n for n in seen if n] == [3, 1] and rows(store.read(), "chunk_id", "text") == [("1", "one"), ("2", "two!"), ("3", "three"), ("4", "one")]
    seen.clear()
    assert len(store.search("one", 2).collect()) == 2 and seen == [1]
    assert {r["source_id"] for r in store.search("one", sources=["b"]).collect()} == {"b"}
    store.clear_sources(spark.createDataFrame([("b",)], "source_id string"))
    assert rows(store.read(), "source_id") == [("a",), ("a",)]


def test_dimensions_never_mix(spark, tables):
    chunks = spark.createDataFrame([("a", "1", 1, "one"), ("b", "2", 1, "two")], CHUNK)
    VectorStore(tables).upsert(chunks)
    four = VectorStore(tables, counted(spark, 4, "four", []))
    with pytest.raises(ValueError, match="rebuild"):
        four.upsert(chunks)
    assert four.search("one").count() == 2  # rebuilt for the query
    assert four.manifest() == {"embedder": "four", "dimension": "4"} and {r[0] for r in four.read().select(F.size("vec")).collect()} == {4}
    assert rebuild_mismatched([four, VectorStore(tables, HASH)]) == ["vectors"]
    assert {r[0] for r in four.read().select(F.size("vec")).collect()} == {256}
    wrong = Embedder("wrong", 5, counted(spark, 4, "", []).embed)
    with pytest.raises(Exception, match="vector dimension is 4, not 5"):
        VectorStore(tables, wrong, "other").upsert(chunks)
    store = VectorStore(tables, HASH)
    store.clear()
    assert store.read().count() == 0 and store.search("one").count() == 0


def test_hash_vectors_are_unit_vectors_of_the_weights(spark, tables):
    from quillspark.operators.retrieval import hash_embedding

    store = VectorStore(tables)
    texts = ["the fox", "", "fox the", "여우 the"]
    store.upsert(spark.createDataFrame([("a", str(i), 1, t) for i, t in enumerate(texts)], CHUNK))
    unit = {r["chunk_id"]: r["u"] for r in hash_embedding(store.read().select("chunk_id", "text"), "u").collect()}
    for r in store.read().collect():
        length = sum(x * x for x in r["vec"]) ** 0.5
        assert r["norm2"] == pytest.approx(length * length)
        assert unit[r["chunk_id"]] == pytest.approx([x / length if length else 0.0 for x in r["vec"]], abs=1e-6)
        assert sum(x * x for x in unit[r["chunk_id"]]) == pytest.approx(1.0 if texts[int(r["chunk_id"])] else 0.0, abs=1e-5)
