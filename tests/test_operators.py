import io
import random
import zipfile

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import editions, joins, ordering, quality, retrieval, tables
from quillspark.sources import readers


def test_chunks_equal_a_plain_loop(spark):
    rng = random.Random(4)
    pages = {p: ["x" * rng.randint(1, 90) if rng.random() > 0.1 else "  " for _ in range(rng.randint(1, 12))] for p in range(40)}
    rows = [("s", p, k, f"{p}-{k}", t) for p, texts in pages.items() for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "source_id string, page int, seq int, block_id string, text string")
    got = {}
    for r in retrieval.chunk_pages(df, 100, 15).orderBy("page", "chunk_no").collect():
        got.setdefault(r["page"], []).append((r["text"], list(r["block_ids"])))
    want = {}
    for p, texts in pages.items():
        buf, ids, length, out = [], [], 0, []
        for k, t in enumerate(texts):
            if not t.strip():
                continue
            if ids and length + len(t) + 1 > 100:
                text = "\n".join(buf).strip()
                out.append((text, ids))
                buf, ids, length = [text[-15:]], ids[-1:], len(text[-15:])
            buf.append(t)
            ids = [*ids, f"{p}-{k}"]
            length += len(t) + 1
        if ids:
            out.append(("\n".join(buf).strip(), ids))
        if out:
            want[p] = out
    assert got == want


def test_running_mean_clusters_follow_the_moving_mean(spark):
    rng = random.Random(1)
    rows = [(k, sorted(rng.uniform(0, 100) for _ in range(rng.randint(1, 15))), rng.uniform(1, 20)) for k in range(60)]
    df = spark.createDataFrame(rows, "k int, v array<double>, tol double")
    got = {r["k"]: r["c"] for r in df.select("k", ordering.running_mean_clusters(F.col("v"), F.col("tol")).alias("c")).collect()}
    for k, values, tol in rows:
        ids, members = [], []
        for v in values:
            if not members or abs(v - sum(members) / len(members)) > tol:
                members = []
                ids.append((ids[-1] if ids else -1) + 1)
            else:
                ids.append(ids[-1])
            members.append(v)
        assert got[k] == ids


def test_pack_paragraphs_equals_the_decoder(spark):
    rng = random.Random(2)
    texts = ["\n\n".join("w" * rng.randint(1, 60) for _ in range(rng.randint(1, 20))) for _ in range(50)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {r["k"]: r["p"] for r in df.select("k", readers.pack_paragraphs(F.col("t"), 100).alias("p")).collect()}
    assert all(got[k] == readers.pack_text(t.split("\n\n"), 100) for k, t in enumerate(texts))


def _zip(**files):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, text in files.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), text)
    return data.getvalue()


def test_office_readers(spark, tmp_path):
    w = 'xmlns:w="urn:w"'
    (tmp_path / "a.docx").write_bytes(_zip(word__document_xml=f"<w:document {w}><w:p><w:t>one</w:t></w:p><w:tbl><w:tr><w:tc><w:p><w:t>a</w:t></w:p></w:tc><w:tc><w:p><w:t>b</w:t></w:p></w:tc></w:tr></w:tbl></w:document>"))
    slide = '<p xmlns:a="urn:a"><sp><a:p><a:t>title</a:t></a:p></sp>{}</p>'
    table = "<a:tbl><a:tr><a:tc><a:p><a:t>x</a:t></a:p></a:tc><a:tc><a:p><a:t>y</a:t></a:p></a:tc></a:tr></a:tbl>"
    (tmp_path / "b.pptx").write_bytes(_zip(ppt__slides__slide1_xml=slide.format(""), ppt__slides__slide2_xml=slide.format(table)))
    cells = '<worksheet><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>k</t></is></c><c r="C1"><v>3</v></c></row></sheetData></worksheet>'
    (tmp_path / "c.xlsx").write_bytes(_zip(xl__workbook_xml='<workbook><sheets><sheet name="metrics"/></sheets></workbook>', xl__worksheets__sheet1_xml=cells))
    (tmp_path / "d.hwpx").write_bytes(_zip(Contents__section0_xml="<s><p>first</p><p>second</p></s>"))
    (tmp_path / "e.csv").write_text("\n".join(f"{i},{i * i}" for i in range(205)))
    (tmp_path / "f.txt").write_text("page one\fpage two")
    (tmp_path / "g.pdf").write_bytes(b"%PDF")
    (tmp_path / "h.docx").write_bytes(b"broken")
    rows = readers.read_files(spark, str(tmp_path)).collect()
    by = {}
    for r in rows:
        by.setdefault(r["path"].rpartition("/")[2], []).append(r)
    assert [r["text"] for r in by["a.docx"]] == ["one\n\na | b"]
    assert [(r["page"], r["block_type"]) for r in sorted(by["b.pptx"], key=lambda r: (r["page"], r["seq"]))] == [(1, "TEXT"), (2, "TEXT"), (2, "TABLE")]
    assert {r["text"] for r in by["c.xlsx"]} == {"metrics", "k |  | 3"}
    assert by["d.hwpx"][0]["text"] == "first\n\nsecond"
    sheet = next(r["text"] for r in by["e.csv"] if r["block_type"] == "TABLE").split("\n")
    assert len(sheet) == 205
    assert sorted(r["text"] for r in by["f.txt"]) == ["page one", "page two"]
    assert "no decoder" in by["g.pdf"][0]["error"] and "BadZipFile" in by["h.docx"][0]["error"]
    text = readers.read_text(spark, str(tmp_path / "f.txt")).orderBy("page").collect()
    assert [(r["page"], r["text"]) for r in text] == [(1, "page one"), (2, "page two")]


def test_changes_of_one_key(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, n int")
    twice = spark.createDataFrame([(2, "x", 5), (2, "y", 4), (3, "z", 1)], base.schema)
    assert sorted(map(tuple, tables.upsert(base, twice, ["k"], [F.col("n")]).collect())) == [(1, "a", 1), (2, "x", 5), (3, "z", 1)]
    assert sorted(map(tuple, tables.patch(base, twice, "k", ["v"]).collect())) == [(1, "a", 1), (2, "y", 1)]


def test_review_revise_and_gate(spark):
    good = "시간당 생산량은 8% 증가했다 [SRC-1, p.16]. " + "설명 문장이 이어진다. " * 8
    sections = spark.createDataFrame([("S1", good + "\n추가로 45% 감소했다 [SRC-9, p.2].", 0), ("S2", good, 0)], "section_id string, content_markdown string, revision_count int")
    pages = spark.createDataFrame([("S1", "SRC-1", 16), ("S2", "SRC-1", 16)], "section_id string, source_id string, page int")
    numbers = spark.createDataFrame([("S1", 8.0), ("S2", 8.0)], "section_id string, value double")
    said = spark.createDataFrame([("S1", "생산량 지표")], "section_id string, statement string")
    verdict = {r["section_id"]: r for r in quality.technical_review(sections, pages, numbers, said).collect()}
    assert verdict["S1"]["numeric_mismatch"] == 1 and verdict["S1"]["citation_mismatch"] == 1 and verdict["S1"]["decision"] == "REVISE"
    assert verdict["S2"]["decision"] == "PASS"
    pack = spark.createDataFrame([("S1", good)], "section_id string, pack_text string")
    done = {r["section_id"]: r for r in quality.review_loop(sections, pages, numbers, said, pack).collect()}
    assert "45%" not in done["S1"]["content_markdown"] and done["S1"]["status"] == "PASSED" and done["S2"]["revision_count"] == 0
    scrubbed = quality.scrub(spark.createDataFrame([("S1", "좋다 8% [SRC-1, p.16]\n\n나쁘다 45%")], "section_id string, content_markdown string"), pages, numbers)
    assert scrubbed.first()["content_markdown"] == "좋다 8% [SRC-1, p.16]"
    gates = spark.createDataFrame([(0, 0, 0, 0, 0, None, 3), (0, 0, 1, 0, 0, 0, 3)], "unsupported int, citation_mismatch int, numeric_mismatch int, critical_t int, critical_e int, unrendered int, revision int")
    assert [tuple(r) for r in gates.select(quality.passes_gate(), quality.needs_manual_review()).collect()] == [(True, False), (False, True)]
    stages = list(quality.TRANSITIONS)
    moves = spark.createDataFrame([(a, b) for a in stages for b in stages], "from_stage string, to_stage string")
    bad = {tuple(r) for r in quality.illegal_moves(moves).collect()}
    assert len(bad) == len(stages) ** 2 - sum(map(len, quality.TRANSITIONS.values()))
    assert {("CREATED", "PRODUCING"), ("WAITING_FOR_OUTLINE_APPROVAL", "EXPORTED"), ("ANALYZING", "INGESTING"), ("EXPORTED", "FAILED")} <= bad
    good = {("CREATED", "INGESTING"), ("WAITING_FOR_OUTLINE_APPROVAL", "PRODUCING"), ("READY_FOR_EXPORT", "PRODUCING"), ("REVISING", "REVIEWING"), ("PAUSED", "FINALIZING")}
    assert not good & bad
    rows = [("WRITING", "x" * 50), ("writing", "x" * 50), ("EMPTY", "x" * 50), (None, "x" * 50), ("PASSED", "  " + "x" * 39 + "  "), ("PASSED", None), ("REVISING", "x" * 50)]
    done = spark.createDataFrame(rows, "status string, content_markdown string").select(editions.is_complete()).collect()
    assert [r[0] for r in done] == [False, False, True, True, False, False, False]


def test_editions(spark):
    old = spark.createDataFrame([("a", "x 5%", 1), ("b", "y", 2), ("c", "z", 3)], "title string, body string, seq int")
    new = spark.createDataFrame([("a", "x 6%", 1), ("b", " y ", 2), ("d", "z", 3)], "title string, body string, seq int")
    assert {r["title"]: r["status"] for r in editions.diff(old, new).collect()} == {"a": "MODIFIED", "b": "UNCHANGED", "c": "REMOVED", "d": "ADDED"}
    assert {r["status"] for r in editions.diff(old, old).collect()} == {"UNCHANGED"}
    nodes = spark.createDataFrame([("1", None), ("2", "1"), ("3", "2"), ("4", None)], "node_id string, parent_id string")
    assert sorted(r["node_id"] for r in editions.without_subtree(nodes, "1").collect()) == ["4"]


def test_joins(spark):
    lexicon = spark.createDataFrame([("G스틸",), ("생산실적처리",), ("작업지시",)], "word string")
    lines = spark.createDataFrame([("G스템",), ("생산신적처리",), ("전혀다른문장입니다",)], "text string")
    assert {r["text"]: r["corrected"] for r in joins.fuzzy_lookup(lines, lexicon).collect()} == {"G스템": "G스틸", "생산신적처리": "생산실적처리", "전혀다른문장입니다": "전혀다른문장입니다"}
    edges = spark.createDataFrame([("a", "b", 1), ("b", "a", 2), ("a", "z", 3)], "src string, dst string, seq int")
    nodes = spark.createDataFrame([("a",), ("b",)], "node_id string")
    assert [tuple(r) for r in joins.undirected_once(joins.known_edges(edges, nodes)).collect()] == [("a", "b", 1)]
    points = spark.createDataFrame([(1, "n", 50.0, 50.0)], "page int, node_id string, cx double, cy double")
    rects = spark.createDataFrame([(1, "big", 0.0, 0.0, 80.0, 80.0), (1, "small", 40.0, 40.0, 70.0, 70.0)], "page int, rect_id string, x0 double, y0 double, x1 double, y1 double")
    assert joins.smallest_container(points, rects, F.lit(10000.0)).first()["rect_id"] == "small"


def test_text_functions(spark):
    row = spark.createDataFrame([("[SRC-1, p.3] up 8 % and 8% x", "a  b\n c")], "t string, s string")
    got = row.select(T.citations(F.col("t")).alias("c"), T.percents(F.col("t")).alias("p"), T.collapse_space(F.col("s")).alias("s"), T.number(F.lit("1,931")).alias("n")).first()
    assert [tuple(c) for c in got["c"]] == [("SRC-1", 3)] and got["p"] == [8.0] and got["s"] == "a b c" and got["n"] == 1931.0


def test_streams_equal_batches(spark, sf_dir, tmp_path):
    from quillspark.streaming import events

    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = events.read_stream(spark, sf_dir, batch.schema, "events.parquet")
    query = events.tumbling(stream).writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("tumbled").collect())) == sorted(map(tuple, events.tumbling(batch).collect()))
    query = events.write_once(events.once(stream), str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == batch.select("event_id").distinct().count()


def test_token_overlap_same_either_way(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.col("text").alias("item"))
    args = (docs, items, "doc_id", "item_id", 9, "text", "item")
    counted = {tuple(r) for r in joins.token_overlap(*args).collect()}
    monkeypatch.setattr(joins, "TOKENS_AT_ONCE", 0)
    assert counted and {tuple(r) for r in joins.token_overlap(*args).collect()} == counted


def test_postings_of_empty_repeated_and_long_blocks(spark):
    from quillspark.operators.postings import terms_of

    texts = ["", None, "...", "b a B c a", "x", "w " * 5000 + "v"]
    rows = [("s", 1, i, f"b{i}", t) for i, t in enumerate(texts)] + [("s", 1, 4, "b4", "x")]
    blocks = spark.createDataFrame(rows, "source_id string, page int, seq int, block_id string, text string")
    got = sorted((r.block_id, r.term, r.positions) for r in terms_of(blocks).collect())
    assert got == [
        ("b3", "a", [1, 4]), ("b3", "b", [0, 2]), ("b3", "c", [3]), ("b4", "x", [0]), ("b4", "x", [0]), ("b5", "v", [5000]), ("b5", "w", list(range(5000))),
    ]


def test_packs_of_sections_without_evidence(spark):
    from quillspark.operators import evidence

    sections = spark.createDataFrame(
        [(1, "납기", "목표", ["metric", "Architecture"]), (2, "x", "y", None), (3, "q", "r", ["PROCESS"])], "section_id int, title string, objective string, required array<string>"
    )
    hits = spark.createDataFrame(
        [(2, 1, "s", 1, " [IMAGE] ", "METRIC"), (2, 2, "s", 1, "a  b" + "c" * 500, "PROBLEM"), (2, 3, "s", 2, "이란", "DEFINITION"), (3, 1, "s", 1, "흐름", "PROCESS"), (1, 1, "s", 1, None, "METRIC")],
        "section_id int, seq int, source_id string, page int, text string, evidence_type string",
    )
    metrics = spark.createDataFrame([], "metric_id int, name string, confidence double")
    facts = spark.createDataFrame([(7, "Process", "y z", ["n"], 4, 0)], "fact_id int, fact_kind string, title string, labels array<string>, page int, n_edges int")
    got = {r.section_id: r for r in evidence.section_packs(sections, hits, metrics, facts).collect()}
    assert got[1].missing_evidence == [evidence.LACKS["METRIC"], evidence.LACKS["ARCHITECTURE"], evidence.LACKS_ALL] and got[1].limitations == [evidence.NO_CLAIMS]
    assert [len(e.statement) for e in got[2].supporting_facts] == [400] and [e.statement for e in got[2].definitions] == ["이란"]
    assert got[2].missing_evidence == [] and got[2].limitations == ["p4 " + evidence.UNLINKED_PROCESS] and [f.fact_id for f in got[2].process_facts] == [7]
    assert got[3].missing_evidence == [] and got[3].metrics == [] and [f.fact_id for f in got[3].process_facts] == [7]
