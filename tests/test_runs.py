"""Impact of new sources, production runs that stop and go on, review rounds, and files that are written."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspark.operators import impact, quality, report
from quillspark.operators.runs import EditionRun, section_id
from quillspark.sources import sink
from quillspark.sources.versioned import VersionedTables

SECTION = "section_id string, title string, objective string, content_markdown string"
CLAIM = "section_id string, claim_id string, statement string, claim_type string, verification_status string, evidence_ids array<string>"
METRIC = "metric_id string, name string, change_value double"
CHUNK = "chunk_id string, page int, seq int, text string"


def by_section(df):
    return {r["section_id"]: r["decision"] for r in df.collect()}


@pytest.fixture(scope="module")
def edition(spark):
    sections = [
        ("deliver", "납기 성과", "납기 준수율을 본다", "## 납기 성과\n\n납기 준수율은 8% 증가했다."), ("cost", "비용 구조", "비용을 본다", "## 비용 구조\n\n운영비 설명."),
        ("poison", "서론", "배경", "## 서론\n\n클라우드 전환으로 운영비가 45% 감소했다."), ("plain", "결론", "요약", "## 결론\n\n맺음말."),
        ("weak", "kernel tuning", "scheduler latency", "## other words entirely"),
    ]
    claims = [
        ("deliver", "c1", "납기 준수율은 8% 증가했다", "FACT", "VERIFIED", ["e1"]), ("cost", "c2", "운영비 설명", "FACT", "VERIFIED", ["e2"]),
        ("poison", "c3", "클라우드 전환으로 45% 감소했다", "UNSUPPORTED", "UNVERIFIED", []), ("plain", "c4", "맺음말", "FACT", "VERIFIED", ["e4"]),
        ("weak", "c5", "kernel scheduler latency tuning", "FACT", "VERIFIED", ["e5"]),
    ]
    return spark.createDataFrame(sections, SECTION), spark.createDataFrame(claims, CLAIM)


def new(spark, metrics=(), chunks=()):
    return spark.createDataFrame(list(metrics), METRIC), spark.createDataFrame(list(chunks), CHUNK)


def test_no_new_source_keeps_all(spark, edition):
    assert set(by_section(impact.assess(*edition, *new(spark))).values()) == {"KEEP"}


def test_a_metric_targets_its_section_only(spark, edition):
    metrics, chunks = new(spark, [("m1", "납기 준수율", 12.0)], [("k1", 1, 0, "납기 준수율 12% 증가 보고")])
    edges = {r["claim_id"]: (r["relation"], r["metric_id"]) for r in impact.relations(edition[1], metrics, chunks).collect()}
    assert edges == {"c1": ("REPLACES", "m1")}
    decisions = by_section(impact.assess(*edition, metrics, chunks))
    assert decisions["deliver"] == "FULL_REWRITE" and decisions["poison"] == "LIGHT_EDIT" and decisions["plain"] == "KEEP"
    # the same value extends, and the metric still makes a part new
    same, _ = new(spark, [("m1", "납기 준수율", 8.001)])
    assert {r["relation"] for r in impact.relations(edition[1], same, chunks).collect()} == {"EXTENDS"}
    assert by_section(impact.assess(*edition, same, chunks))["deliver"] == "PARTIAL_REWRITE"
    found = impact.assess(*edition, metrics, chunks)
    assert sorted(tuple(r) for r in impact.affected(found, impact.relations(edition[1], metrics, chunks), edition[1]).collect()) == [("deliver", "c1"), ("poison", "c3")]


def test_texts_support_and_overlap(spark, edition):
    one = [("k1", 1, 0, "the kernel has a scheduler with latency")]
    metrics, chunks = new(spark, (), one)
    assert [(r["claim_id"], r["relation"]) for r in impact.relations(edition[1], metrics, chunks).collect()] == [("c5", "SUPPORTS")]
    found = {r["section_id"]: r for r in impact.assess(*edition, metrics, chunks).collect()}
    assert (found["weak"]["chunk_hits"], found["weak"]["decision"]) == (1, "UPDATE_CITATION") and found["weak"]["score"] >= 0.3
    _, two = new(spark, (), [*one, ("k2", 1, 1, "tuning the kernel")])
    assert by_section(impact.assess(*edition, metrics, two))["weak"] == "PARTIAL_REWRITE"
    # only the first twenty chunks support, in their order
    many = [(f"x{k:02}", 1, k, "nothing") for k in range(20)] + [("z", 2, 0, "kernel scheduler latency")]
    assert impact.relations(edition[1], *new(spark, (), many)).count() == 0


def test_preview_takes_the_sources_that_the_snapshot_lacks(spark, edition):
    metrics, chunks = new(spark, [("m1", "납기 준수율", 12.0)], [("k1", 1, 0, "납기")])
    metrics, chunks = metrics.withColumn("source_id", F.lit("s2")), chunks.withColumn("source_id", F.lit("s2"))
    both, old = (spark.createDataFrame([(s,) for s in x], "source_id string") for x in (["s1", "s2"], ["s1"]))
    assert by_section(impact.preview(*edition, both, old, metrics, chunks))["deliver"] == "FULL_REWRITE"
    assert set(by_section(impact.preview(*edition, both, both, metrics, chunks)).values()) == {"KEEP"}


# runs

NODE = "node_id string, title string, objective string, order int"
EVIDENCE = "node_id string, kind string, seq int, statement string, source_id string, page int, evidence_id string"


@pytest.fixture(scope="module")
def plan(spark):
    nodes = spark.createDataFrame([(f"n{k}", f"Title {k}", f"goal {k}", k) for k in range(5)], NODE)
    rows = [(f"n{k}", "FACT", j, f"fact {j} of section {k} is 1{j}% of all", "SRC-1", j, f"EV-{k}{j}") for k in range(5) if k != 3 for j in range(1, 3)]
    return nodes, spark.createDataFrame(rows, EVIDENCE)


def state(tables, edition="E"):
    return {
        "sections": sorted((r["section_id"], r["content_markdown"], r["status"]) for r in tables.read("sections").collect()),
        "claims": sorted((r["claim_id"], r["statement"], r["verification_status"], str(r["evidence_ids"])) for r in tables.read("claims").collect()),
        "versions": sorted((r["section_id"], r["version"], r["content_markdown"]) for r in tables.read("section_versions").collect()),
        "ledger": sorted((r["section_id"], r["step"], r["input_hash"]) for r in tables.read("run_ledger").collect()),
    }


@pytest.fixture(scope="module")
def whole(spark, plan, tmp_path_factory):
    tables = VersionedTables(spark, f"file://{tmp_path_factory.mktemp('whole')}/t", buckets=2)
    run = EditionRun(tables, "E", wave_size=3)
    assert run.resumable(plan[0]) and run.run(*plan) == 5 and not run.resumable(plan[0])
    return tables


def test_a_whole_run(whole, plan):
    made = state(whole)
    assert len(made["sections"]) == 5 and len(made["ledger"]) == 15 and [v for _, v, _ in made["versions"]] == [1] * 5
    assert sum(report.NO_EVIDENCE in text for _, text, _ in made["sections"]) == 1 and any(v == "VERIFIED" for _, _, v, _ in made["claims"])
    assert EditionRun(whole, "E", wave_size=3).run(*plan) == 0 and state(whole) == made


@pytest.mark.parametrize("stop", [("text", 0), ("claims", 1), ("version", 0)])
def test_a_stopped_run_gives_the_same(spark, plan, whole, tmp_path, stop):
    def watch(step, wave):
        if (step, wave) == stop:
            raise KeyboardInterrupt("stopped")

    tables = VersionedTables(spark, f"file://{tmp_path}/t", buckets=2)
    with pytest.raises(KeyboardInterrupt):
        EditionRun(tables, "E", 3, watch).run(*plan)
    left = EditionRun(tables, "E", 3).run(*plan)
    assert 0 < left <= 5 and state(tables) == state(whole)


def test_changed_inputs_and_single_sections_are_done_again(spark, plan, whole, tmp_path):
    nodes, evidence = plan
    tables = VersionedTables(spark, f"file://{tmp_path}/t", buckets=2)
    run = EditionRun(tables, "E", wave_size=100)
    run.run(nodes, evidence)
    more = evidence.unionByName(spark.createDataFrame([("n2", "FACT", 9, "a late fact", "SRC-2", 1, "EV-late")], EVIDENCE))
    assert run.run(nodes, more) == 1 and run.run(nodes, more) == 0
    mine = spark.range(1).select(section_id("E", F.lit("n2"))).first()[0]
    assert [v for s, v, _ in state(tables)["versions"] if s == mine] == [1, 2]
    newer = more.unionByName(spark.createDataFrame([(n, "FACT", 10, "a later fact", "SRC-2", 2, f"EV-{n}") for n in ("n2", "n4")], EVIDENCE))
    assert run.regenerate(nodes, newer, "n4") == 1  # n2 has new evidence too, but is not asked for
    texts = {r["node_id"]: r["content_markdown"] for r in tables.read("sections").collect()}
    assert "a later fact" in texts["n4"] and "a later fact" not in texts["n2"]
    assert run.regenerate(nodes.where("node_id != 'n1'"), newer.withColumn("page", F.col("page") + 1), "n1") == 1


def test_inherited_sections_are_scrubbed(spark, plan, tmp_path):
    nodes, evidence = plan
    old = "## Title 0\n\n수치는 11% 이다 [SRC-1, p.1].\n\n운영비가 45% 감소했다.\n\n남는 문단 [SRC-9, p.9]."
    tables = VersionedTables(spark, f"file://{tmp_path}/t", buckets=2)
    EditionRun(tables, "E2").run(nodes.where("node_id = 'n0'"), evidence, spark.createDataFrame([("n0", old)], "node_id string, content_markdown string"))
    text = tables.read("sections").first()["content_markdown"]
    assert "45%" not in text and "SRC-9" not in text and "11%" in text and "남는 문단" in text
    version = tables.read("section_versions").first()
    assert (version["version"], version["reason"]) == (1, "inherited from parent")


# reviews

PAGES, NUMBERS, SAID = "section_id string, source_id string, page int", "section_id string, value double", "section_id string, statement string"


def test_technical_review_judges_claims(spark):
    sections = spark.createDataFrame([("a", "plain text without numbers"), ("b", "생산이 3% 늘었다"), ("c", "【분석】 7% 로 본다 [S, p.1]"), ("d", "quiet")], "section_id string, content_markdown string")
    claims = spark.createDataFrame([
        ("a", "claim with 5 things", "UNSUPPORTED", "UNVERIFIED"), ("a", "weak words", "FACT", "UNVERIFIED"), ("a", "증가", "FACT", "VERIFIED"),
        ("c", "증가 9", "ANALYSIS", "UNVERIFIED"), ("d", None, "FACT", "UNVERIFIED"),
    ], "section_id string, statement string, claim_type string, verification_status string")
    pages, numbers = spark.createDataFrame([("c", "S", 1)], PAGES), spark.createDataFrame([("b", 3.0), ("c", 7.0)], NUMBERS)
    said = spark.createDataFrame([], SAID)
    got = {r["section_id"]: (r["unsupported"], r["critical"], r["decision"]) for r in quality.technical_review(sections, pages, numbers, said, claims).collect()}
    assert got == {"a": (1, 1, "REVISE"), "b": (1, 1, "REVISE"), "c": (0, 0, "PASS"), "d": (0, 0, "PASS")}
    cover = {r["section_id"]: r["coverage"] for r in quality.technical_review(sections, pages, numbers, said, claims).collect()}
    assert cover["a"] == pytest.approx(1 / 3) and cover["b"] == 0.0
    issue = quality.technical_issues(sections, pages, numbers, said, claims).where("section_id = 'b'").first()
    assert issue["status"] == "OPEN" and issue["recommendation"] == quality.ADVICE["UNSUPPORTED_CLAIM"]


def test_review_rounds(spark):
    long = "근거가 있는 설명 문장이 이어진다. " * 8
    rows = [("fine", long, 0), ("mend", f"{long}\n45% 감소했다.", 0), ("last", f"{long}\n45% 감소했다.", 3), ("stuck", "수치 12% 라고 한다", 0)]
    sections = spark.createDataFrame(rows, "section_id string, content_markdown string, revision_count int")
    pages, numbers = spark.createDataFrame([], PAGES), spark.createDataFrame([("stuck", 12.0)], NUMBERS)
    done = quality.review_loop(sections, pages, numbers, spark.createDataFrame([], SAID), spark.createDataFrame([], "section_id string, pack_text string"))
    got = {r["section_id"]: (r["status"], r["revision_count"]) for r in done.collect()}
    assert got == {"fine": ("PASSED", 0), "mend": ("PASSED", 1), "last": ("MANUAL_REVIEW", 3), "stuck": ("MANUAL_REVIEW", 3)}
    assert done.count() == 4


def test_repeated_paragraphs(spark):
    words = [f"word{k}" for k in range(20)]
    text = "\n\n".join([" ".join(words), " ".join(words[:19]), "short", " ".join(words[5:]), "other " * 12])
    sections = spark.createDataFrame([("s", text), ("t", " ".join(words))], "section_id string, content_markdown string")
    ratio = {r["section_id"]: r["ratio"] for r in quality.duplicate_ratio(sections).collect()}
    assert ratio == {"s": 0.25, "t": 0.0}
    assert quality.duplicate_paragraphs(sections).count() == 1


# files


def test_markdown_json_and_csv(spark, tmp_path):
    rows = spark.createDataFrame([("a.md", "# A\n"), ("sub/b.md", None), ("c.md", "한글")], "file string, content string").repartition(3)
    sink.write_markdown(rows, f"file://{tmp_path}/md")
    assert {p.relative_to(tmp_path / "md").as_posix(): p.read_text() for p in (tmp_path / "md").rglob("*.md")} == {"a.md": "# A\n", "sub/b.md": "", "c.md": "한글"}
    sink.write_json(spark.createDataFrame([("x.json", 1, ["p", "q"], None)], "file string, n int, l array<string>, nothing string"), f"file://{tmp_path}/json")
    assert json.loads((tmp_path / "json" / "x.json").read_text()) == {"n": 1, "l": ["p", "q"], "nothing": None}
    table = spark.createDataFrame([(k, f"line {k}\n\"quoted\", comma" if k % 2 else None) for k in range(50)], "k int, v string").repartition(4)
    sink.write_csv(table, f"file://{tmp_path}/csv")
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema("k int, v string").csv(f"file://{tmp_path}/csv")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, table.collect()))
    assert [p.name for p in tmp_path.iterdir() if p.name.startswith(".")] == []


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    boom = F.udf(lambda k: "x" if k < 90 else 1 / 0, "string")
    rows = spark.range(100).repartition(4).select(F.concat("id", F.lit(".md")).alias("file"), boom("id").alias("content"))
    with pytest.raises(Exception, match="ZeroDivisionError"):
        sink.write_markdown(rows, f"file://{tmp_path}/out")
    assert list(tmp_path.iterdir()) == []
    good = spark.createDataFrame([("a.md", "old")], "file string, content string")
    sink.write_markdown(good, f"file://{tmp_path}/out")
    for bad in (rows, good.unionByName(good), spark.createDataFrame([("../a.md", "x")], "file string, content string")):
        with pytest.raises(Exception):
            sink.write_markdown(bad, f"file://{tmp_path}/out")
        assert [p.name for p in tmp_path.iterdir()] == ["out"] and (tmp_path / "out" / "a.md").read_text() == "old"
    with pytest.raises(Exception, match="out"):
        sink.write_markdown(good, f"file://{tmp_path}/out", overwrite=False)
    sink.write_markdown(spark.createDataFrame([("b.md", "new")], "file string, content string"), f"file://{tmp_path}/out")
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["b.md"]


def test_bundles(spark, tmp_path):
    reports = spark.createDataFrame([("E1", "# R1\n"), ("E2", "# R2\n")], "edition_id string, report string")
    claims = spark.createDataFrame([("E1", "c2", 'say "x", y'), ("E1", "c1", None)], "edition_id string, claim_id string, statement string")
    refs = spark.createDataFrame([("E1", "s1", 3), ("E2", "s2", 4)], "edition_id string, source_id string, page int")
    files = sink.export_files(reports, claims, refs)
    sink.write_bundles(files, f"file://{tmp_path}/zips")
    with zipfile.ZipFile(tmp_path / "zips" / "E1.zip") as z:
        assert z.namelist() == ["claims.csv", "references.json", "report.md"]
        assert z.read("claims.csv").decode() == 'claim_id,statement\n"c1",""\n"c2","say ""x"", y"\n'
        assert json.loads(z.read("references.json")) == [{"source_id": "s1", "page": 3}]
    exports = sorted((r["edition_id"], r["format"], r["status"]) for r in sink.export_rows(files, f"file://{tmp_path}/zips").collect())
    assert exports == [("E1", "csv", "READY"), ("E1", "json", "READY"), ("E1", "markdown", "READY"), ("E1", "zip", "READY"), ("E2", "json", "READY"), ("E2", "markdown", "READY"), ("E2", "zip", "READY")]
