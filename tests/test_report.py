from pyspark.sql import functions as F

from quillspark.operators import quality, report


def test_write_claim_review_assemble(spark):
    sections = spark.createDataFrame([("SEC-000001", "성과", "성과를 본다", 1), ("SEC-000002", "빈 절", "없음", 2)], "section_id string, title string, objective string, seq int")
    rows = [
        ("SEC-000001", "FACT", 1, "생산 실적 처리를 자동화했다.", "SRC-1", 12, "EV-1"), ("SEC-000001", "METRIC", 1, "생산량 8.0% 증가.", "SRC-1", 16, "MET-1"),
        ("SEC-000001", "MISSING", 1, "비용 자료", None, None, None), ("SEC-000001", "LIMITATION", 1, "표본이 작다.", None, None, None),
    ]
    evidence = spark.createDataFrame(rows, "section_id string, kind string, seq int, statement string, source_id string, page int, evidence_id string")
    written = report.write_sections(sections, evidence)
    text = {r["section_id"]: r["content_markdown"] for r in written.collect()}
    assert text["SEC-000001"].count("<!-- P-") == 6 and "[SRC-1, p.16]" in text["SEC-000001"] and text["SEC-000001"].count("분석상 한계") == 1
    assert report.NO_EVIDENCE in text["SEC-000002"]
    found = report.claims(written, evidence)
    kinds = [(r["claim_type"], list(r["evidence_ids"])) for r in found.where("section_id = 'SEC-000001'").orderBy("pos").collect()]
    assert kinds == [("UNSUPPORTED", []), ("FACT", ["EV-1"]), ("FACT", ["MET-1"]), ("UNSUPPORTED", []), ("ANALYSIS", [])]
    assert {r["places"] for r in report.claim_ledger(found, evidence).collect()} == {"", "SRC-1:p.12", "SRC-1:p.16"}
    assert report.coverage(found).where("section_id = 'SEC-000001'").first()["ratio"] == 0.4
    pages, numbers = evidence.select("section_id", "source_id", "page"), spark.createDataFrame([("SEC-000001", 8.0)], "section_id string, value double")
    verdict = quality.technical_review(written, pages, numbers, evidence).where("section_id = 'SEC-000001'").first()
    assert verdict["citation_mismatch"] == 0 and verdict["numeric_mismatch"] == 0
    done = report.assemble(written.join(sections.select("section_id", "seq"), "section_id"), "보고서").first()["report"]
    assert done.startswith("# 보고서\n\n## 목차\n\n1. 성과\n2. 빈 절\n") and done.index("## 성과") < done.index("## 빈 절")


def test_text_products(spark):
    one = spark.range(1)
    got = one.select(
        report.number_figures(F.lit("a ![x](p) b ![y](q)")).alias("f"), report.mermaid(F.array(F.lit('a"b'), F.lit("c"))).alias("m"),
        report.markdown_table(F.array(F.lit("k"), F.lit("v")), F.array(F.array(F.lit("1")))).alias("t"),
    ).first()
    assert got["f"] == "a ![그림 1. x](p) b ![그림 2. y](q)"
    assert got["m"] == "flowchart LR\n  S0[\"a'b\"]\n  S1[\"c\"]\n  S0 --> S1\n"
    assert got["t"] == "| k | v |\n| --- | --- |\n| 1 |  |"
    docs = spark.createDataFrame([(1, "• 문제: 느림\n짧\n문제: 느림\n다른 줄")], "doc_id long, text string")
    assert [r["line"] for r in report.keyword_lines(docs, "doc_id", ("문제",)).collect()] == ["문제: 느림"]
    plan = report.outline(spark.createDataFrame([("문제", 1, "a"), ("문제", 2, "b"), ("목표", 1, "c")], "topic string, seq int, title string"), {"문제": 1})
    assert [(r["level"], r["title"]) for r in plan.orderBy("order").collect()] == [(1, "목표"), (2, "c"), (1, "문제"), (2, "a")]
