"""Corpus analysis, assembled details and outline helpers, against cases by hand."""

from pyspark.sql import functions as F

from quillspark.operators import corpus, details, graphs


def test_corpus_analysis(spark):
    sources = spark.createDataFrame([
        ("p", "s2", "EVIDENCE_SOURCE", "READY", "t2"), ("p", "s1", "EVIDENCE_SOURCE", "READY", "t1"), ("p", "s3", "FORMAT_REFERENCE", "READY", "t0"),
        ("p", "s4", "EVIDENCE_SOURCE", "FAILED", "t0"), ("q", "s5", "EVIDENCE_SOURCE", "READY", "t0"),
    ], "project_id string, source_id string, role string, status string, created_at string")
    pages = spark.createDataFrame([("s1", 1, "TEXT"), ("s1", 2, "DIAGRAM"), ("s2", 1, "TEXT"), ("s3", 1, "TEXT"), ("s4", 1, "TEXT"), ("s2", 2, "TEXT")], "source_id string, page int, page_type string")
    blocks = spark.createDataFrame([
        ("s1", 1, 1, "TEXT", "• 문제:  설비 노후\n짧다"), ("s1", 1, 0, "TEXT", "  생산 시스템 MES\nMES workflow"), ("s1", 1, 2, "IMAGE", "문제 그림"), ("s2", 1, 0, "TEXT", "- 문제: 설비 노후\nan issue of MES " + "x" * 100),
        ("s3", 1, 0, "TEXT", "문제: 양식일 뿐이다"), ("s2", 2, 0, "TEXT", "   "),
    ], "source_id string, page int, seq int, block_type string, text string")
    metrics = spark.createDataFrame([("s1", 1, "m", "name", None), ("s3", 1, "n", "name", "how")], "source_id string, page_number int, metric_id string, name string, measurement_method string")
    found = corpus.context(sources, pages, blocks, metrics)
    assert sorted((r["source_id"], r["page"], r["pos"]) for r in found.digest.collect()) == [("s1", 1, 1), ("s1", 2, 2), ("s2", 1, 3)]
    rows = {r["project_id"]: r for r in corpus.analyze(found).collect()}
    p = rows["p"]
    assert p["main_topic"] == "생산 시스템 MES" and p["problems"] == ["문제: 설비 노후"] and p["components"] == ["생산 시스템 MES"]
    assert p["processes"] == ["생산 시스템 MES", "MES workflow"] and p["n_metrics"] == 1 and p["page_count"] == 4
    assert p["key_entities"][0] == "MES" and p["technical_domain"].startswith("MES / ") and "MES" in p["key_technologies"]
    assert p["evidence_gaps"] == [corpus.GAPS[1]] and p["recommended_focus"] == list(corpus.FOCUS)
    q = rows["q"]
    assert (q["main_topic"], q["technical_domain"], q["recommended_focus"], q["page_count"]) == (corpus.DEFAULT_TOPIC, corpus.DEFAULT_DOMAIN, [corpus.FOCUS[4]], 0)


def test_claim_locations(spark):
    blocks = spark.createDataFrame([("s", 1, k, f"b{k}", f"t{k}") for k in range(5)], "source_id string, page int, seq int, block_id string, text string")
    evidence = spark.createDataFrame([("e1", "s", 1, ["b4", "b1"]), ("e2", "s", 1, []), ("e3", "s", 1, None), ("e4", "s", 9, ["b1"])], "evidence_id string, source_id string, page int, block_ids array<string>")
    claims = spark.createDataFrame([("c", ["e1", "e2", "e4", "gone"]), ("d", ["e3"]), ("none", [])], "claim_id string, evidence_ids array<string>")
    got = sorted((r["claim_id"], r["evidence_id"], r["nth"], r["block_id"]) for r in details.claim_locations(claims, evidence, blocks).collect())
    assert got == [("c", "e1", 1, "b1"), ("c", "e1", 2, "b4"), ("c", "e2", 1, "b0"), ("c", "e2", 2, "b1"), ("c", "e2", 3, "b2"), ("c", "e4", 1, None), ("d", "e3", 1, "b0"), ("d", "e3", 2, "b1"), ("d", "e3", 3, "b2")]
    assert details.citation_targets(claims, evidence).count() == 4


def test_diagram_specs(spark):
    node, edge = "struct<node_id:string,label:string,group:string>", "struct<src:string,dst:string,label:string,medium:string>"
    schema = f"project_id string, fact_id string, kind string, title string, page int, confidence double, nodes array<{node}>, edges array<{edge}>"
    two, many = [("N0", " a b ", None), ("N1", "", "g"), ("N2", "cd", "g")], [(f"N{k}", f"label {k}", None) for k in range(20)]
    facts = spark.createDataFrame([
        ("p", "f1", "PROCESS", "low", 1, 0.5, many, []), ("p", "f2", "PROCESS", "best", 3, 0.9, two, None), ("p", "f3", "PROCESS", "one", 1, 0.99, two[:2], []),
        ("q", "f4", "PROCESS", "q", 2, 0.7, many, []), ("q", "f5", "PROCESS", "q early", 1, 0.7, many, []),
        ("p", "f6", "ARCHITECTURE", "arch", 1, None, two, [("N0", "N2", None, "VPN"), ("N0", "N1", "x", None), ("N2", "N2", "x", None)]),
    ], schema)
    steps = {r["project_id"]: (r["title"], len(r["steps"]), r["steps"][0]) for r in details.process_specs(facts).collect()}
    assert steps == {"p": ("best", 2, "a b"), "q": ("q early", 12, "label 0")}
    spec = details.architecture_specs(facts).first()
    assert [tuple(n) for n in spec["nodes"]] == [("N0", "a b", None), ("N2", "cd", "g")] and [tuple(e) for e in spec["edges"]] == [("N0", "N2", "VPN")]


def test_outline_helpers(spark):
    nodes = spark.createDataFrame([("pl", 0, None, 0, "A", None), ("pl", 1, "n", 7, "B", ["x"]), ("pl", 2, "", -1, "C", [])], "plan_id string, pos int, node_id string, order int, title string, source_scope array<string>")
    got = sorted(details.normalize_plan(nodes, F.array(F.lit("s1"))).collect(), key=lambda r: r["pos"])
    assert [(r["order"], r["source_scope"]) for r in got] == [(1, ["s1"]), (7, ["x"]), (3, ["s1"])] and got[1]["node_id"] == "n" and got[0]["node_id"].startswith("N-") and got[0]["node_id"] != got[2]["node_id"]
    outline = spark.createDataFrame([("o", "b", 5), ("o", "a", 5), ("o", "c", 1), ("x", "d", 9)], "outline_id string, node_id string, order int")
    assert sorted((r["node_id"], r["order"]) for r in details.renumber(outline).collect()) == [("a", 2), ("b", 3), ("c", 1), ("d", 1)]
    asked = spark.createDataFrame([("p", "n", "제목", None), ("p", "m", "둘", ["왜?"])], "project_id string, node_id string, title string, analysis_questions array<string>")
    out = {r["node_id"]: r for r in details.recommend(asked, spark.createDataFrame([("p", "")], "project_id string, main_topic string")).collect()}
    assert out["n"]["objective"].startswith("제목에 대해 본 자료를 바탕으로") and len(out["n"]["analysis_questions"]) == 2 and out["m"]["analysis_questions"] == ["왜?"]
    one = spark.range(1).select(
        details.pixels_to_points(F.struct(F.lit(200.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(400.0).alias("x1"), F.lit(100.0).alias("y1")), 200).alias("b"),
        details.lexicon_words(F.lit("서버 / 클라우드|서버·x\n  wide   gap – end")).alias("w"),
    ).first()
    assert tuple(one["b"]) == (72.0, 0.0, 144.0, 36.0) and one["w"] == ["서버", "클라우드", "wide gap", "end"]


def test_edges_and_bands(spark):
    kinds = "source_id string, page int, idx int, node_id string, label string, x0 double, y0 double, x1 double, y1 double, width double, height double"
    rows = [("s", 1, k, f"N{k}", label, x, y, x + 60.0, y + 20.0, 600.0, 400.0) for k, (label, x, y) in enumerate([("Left head", 50.0, 10.0), ("left two", 50.0, 60.0), ("VPN", 210.0, 10.0), ("Right head that is longer than that", 400.0, 10.0), ("right two", 400.0, 60.0)])]
    found = spark.createDataFrame(rows, kinds)
    line = spark.createDataFrame([("s", 1, 0, 110.0, 20.0, 400.0, 20.0)], "source_id string, page int, seq int, px0 double, py0 double, px1 double, py1 double")
    edge = graphs.line_edges(found, line).first()
    assert (edge["src"], edge["dst"], edge["label"], edge["medium"], edge["confidence"]) == ("N0", "N3", "VPN", "VPN", 0.82)
    assert {(r["src"], r["dst"], r["confidence"]) for r in graphs.column_edges(found).collect()} == {("N0", "N1", 0.62), ("N3", "N4", 0.62)}
    assert sorted((r["node_id"], r["group"]) for r in graphs.band_groups(found).collect()) == [("N0", "Left head"), ("N1", "Left head"), ("N3", "열3"), ("N4", "열3")]
    none = spark.createDataFrame([], "source_id string, page int, seq int, x0 double, y0 double, x1 double, y1 double")
    assert graphs.grouped_nodes(found, none).count() == 4 and graphs.band_groups(found.where("idx < 3")).count() == 0


def test_page_details_and_payloads(spark):
    pages = spark.createDataFrame([("s", 1, "TEXT"), ("s", 2, "TEXT")], "source_id string, page int, page_type string")
    blocks = spark.createDataFrame([("s", 1, 1, "b1", "TEXT", "second"), ("s", 1, 0, "b0", "TEXT", "first"), ("s", 1, 2, "b2", "IMAGE", "[IMAGE]")], "source_id string, page int, seq int, block_id string, block_type string, text string")
    metrics = spark.createDataFrame([("s", 1, 0, "m", "name")], "source_id string, page_number int, seq int, metric_id string, name string")
    facts = spark.createDataFrame([("s", 1, "f", "PROCESS", 0.7)], "source_id string, page int, fact_id string, kind string, confidence double")
    got = {r["page"]: r for r in details.page_details(pages, blocks, metrics, facts).collect()}
    assert got[1]["text"] == "first\nsecond" and [b["block_id"] for b in got[1]["blocks"]] == ["b0", "b1", "b2"] and got[1]["metrics"][0]["name"] == "name"
    assert got[2]["blocks"] == [] and got[2]["text"] == "" and got[2]["structures"] == []
    nodes = spark.createDataFrame([("s", 1, 1, "N1", "two"), ("s", 1, 0, "N0", "one")], "source_id string, page int, idx int, node_id string, label string")
    edges = spark.createDataFrame([("s", 1, 0, "N0", "N1", None, "VPN", 0.82)], "source_id string, page int, seq int, src string, dst string, label string, medium string, confidence double")
    made = details.structure_payload(facts, nodes, edges).first()
    assert made["payload_json"].startswith('{"kind":"PROCESS","nodes":[{"node_id":"N0","label":"one"}') and [n["label"] for n in made["nodes"]] == ["one", "two"]
