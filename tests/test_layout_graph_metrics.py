from pyspark.sql import functions as F

from quillspark.operators import graphs, layout, metrics

BLOCK = "source_id string, page int, seq int, block_type string, text string, x0 double, y0 double, x1 double, y1 double, confidence double, width double"


def blocks(spark, items, width):
    return spark.createDataFrame([("s", 1, k, "TEXT", t, *map(float, box), 1.0, float(width)) for k, (t, box) in enumerate(items)], BLOCK)


def ordered(df):
    return [r["text"] for r in layout.reading_order(df).orderBy("reading_order").collect()]


def test_reading_order(spark):
    assert ordered(blocks(spark, [("B", (200, 50, 300, 70)), ("A", (20, 50, 80, 70)), ("C", (20, 120, 80, 140))], 400)) == ["A", "B", "C"]
    columns = [(f"R{k + 1}", (300, y, 360, y + 20)) for k, y in enumerate((40, 100, 160))] + [(f"L{k + 1}", (40, y, 100, y + 20)) for k, y in enumerate((40, 100, 160))]
    assert ordered(blocks(spark, columns, 400)) == ["L1", "L2", "L3", "R1", "R2", "R3"]
    marked = layout.section_marks(blocks(spark, columns, 500))
    assert marked.where("block_type = 'STRUCTURE'").count() == 2
    two = layout.clusters(blocks(spark, [("A", (20, 10, 80, 30)), ("B", (20, 50, 80, 70)), ("C", (220, 10, 280, 30)), ("D", (220, 50, 280, 70))], 400), "x")
    assert two.select("cluster").distinct().count() == 2


def test_row_pairs_and_key_values(spark):
    cells = []
    for k, name in enumerate("가나다"):
        cells += [(f"기능{name}", (20, 50 + 60 * k, 100, 70 + 60 * k)), (f"{name} 설명이 길게 이어지는 본문", (260, 50 + 60 * k, 560, 70 + 60 * k))]
    df = blocks(spark, cells, 600)
    assert 120 < layout.column_splits(df).first()["split_x"] < 300
    paired = layout.pair_rows(df).orderBy("seq").collect()
    assert [r["block_type"] for r in paired] == ["TABLE"] * 3 and paired[0]["text"] == "기능가 | 가 설명이 길게 이어지는 본문"
    texts = ["기능\n세부내용", "1,931억원\n1,762억원", "PDA\nPDA\nPDA", "역할\n이 모듈은 생산 실적을 모아서 보여 주는 일을 한다", "한 줄"]
    got = [r["text"] for r in layout.promote_key_values(blocks(spark, [(t, (0, 0, 10, 10)) for t in texts], 400)).orderBy("seq").collect()]
    assert got == ["기능 | 세부내용", "1,931억원\n1,762억원", "PDA · PDA · PDA", "역할 | 이 모듈은 생산 실적을 모아서 보여 주는 일을 한다", "한 줄"]


def test_page_types(spark):
    pages = spark.createDataFrame(
        [("s", 1, 600.0, 800.0, "x", False, 0, 0), ("s", 2, 600.0, 800.0, "a|b|c\nd|e|f\ng|h|i", True, 0, 0), ("s", 3, 600.0, 800.0, "word " * 200, True, 0, 0), ("s", 4, 600.0, 800.0, "few words", True, 3, 0)],
        "source_id string, page int, width double, height double, full_text string, text_layer boolean, image_count int, drawing_count int",
    )
    got = {r["page"]: (r["page_type"], r["needs_ocr"]) for r in layout.page_types(pages, spark.createDataFrame([], BLOCK)).collect()}
    assert got == {1: ("SCANNED", True), 2: ("TABLE", False), 3: ("TEXT", False), 4: ("DIAGRAM", True)}


def test_graphs(spark):
    lines = spark.createDataFrame([], "source_id string, page int, seq int, px0 double, py0 double, px1 double, py1 double")
    rects = spark.createDataFrame([], "source_id string, page int, seq int, x0 double, y0 double, x1 double, y1 double")
    boxes = [(f"단계{k}", (40 + 230 * (k % 3), 60 + 80 * (k // 3), 140 + 230 * (k % 3), 90 + 80 * (k // 3))) for k in range(8)]
    found = graphs.nodes(blocks(spark, boxes, 700).withColumn("height", F.lit(400.0)))
    facts, edges = graphs.graph_facts(found, lines, rects)
    row = facts.first()
    assert row["n_nodes"] == 8 and row["kind"] == "ARCHITECTURE" and edges.count() == 5  # three columns make groups
    assert sorted(row["groups"]) == ["단계0", "단계1", "단계2"]
    boxes = [("서버 구역", (60, 60, 140, 80)), ("웹", (60, 120, 140, 150)), ("앱", (60, 200, 140, 230)), ("외부", (420, 60, 500, 80)), ("사용자", (420, 130, 500, 160))]
    found = graphs.nodes(blocks(spark, [(t if len(t) > 1 else t + "서버", b) for t, b in boxes], 600).withColumn("height", F.lit(300.0)))
    rects = spark.createDataFrame([("s", 1, 0, 40.0, 40.0, 180.0, 260.0), ("s", 1, 1, 400.0, 40.0, 540.0, 200.0)], rects.schema)
    lines = spark.createDataFrame([("s", 1, 0, 140.0, 135.0, 420.0, 145.0)], lines.schema)
    facts, edges = graphs.graph_facts(found, lines, rects)
    assert facts.first()["kind"] == "ARCHITECTURE" and len(facts.first()["groups"]) == 2 and edges.count() >= 1


def test_metrics(spark):
    text = "1. 시간당생산량\n효과\n기존대비8% 증가\n2. Claim 건수\n기존대비60% 감소\n"
    rows = [("a", 1, text), ("b", 1, "납기준수율 +24% 향상\n재공재고 -33% 감소"), ("c", 1, "상시 인원\n2019\n371명\n311명\n매출 규모\n1,931억원\n1,762억원\n1,633억원"), ("d", 1, None), ("e", 1, "1. 생산량\n8% 증가")]
    facts = metrics.metric_facts(spark.createDataFrame(rows, "source_id string, page_number int, text string")).collect()
    by = {}
    for r in facts:
        by.setdefault(r["source_id"], []).append(r)
    assert [(r["name"], r["change_value"], r["direction"]) for r in by["a"]] == [("시간당생산량", 8.0, "INCREASE"), ("Claim 건수", 60.0, "DECREASE")]
    assert [(r["change_value"], r["direction"]) for r in by["b"]] == [(24.0, "INCREASE"), (33.0, "DECREASE")]
    assert [r["result_value"] for r in by["c"]] == [371.0, 311.0, 1931.0, 1762.0, 1633.0] and [r["name"] for r in by["c"]][2] == "매출 규모"
    assert [(r["name"], r["change_value"]) for r in by["e"]] == [("생산량", 8.0)] and "d" not in by
    strict = metrics.metric_facts(spark.createDataFrame([rows[-1]], "source_id string, page_number int, text string"), unsigned_change=False)
    assert strict.count() == 0
