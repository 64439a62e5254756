"""The ingest: uploads, pages and blocks of all formats, and runs that are stopped anywhere and started again."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspark.operators import graphs
from quillspark.operators.postings import Postings
from quillspark.operators.vectors import VectorStore
from quillspark.sources import readers
from quillspark.sources.versioned import VersionedTables
from quillspark.streaming import ingest

P = 'xmlns:p="p" xmlns:a="a" xmlns:r="r"'


def slides(*trees):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("ppt/presentation.xml", f'<p:presentation {P}><p:sldSz cx="9144000" cy="6858000"/></p:presentation>')
        for k, tree in enumerate(trees, 1):
            z.writestr(f"ppt/slides/slide{k}.xml", f"<p:sld {P}><p:cSld><p:spTree>{tree}</p:spTree></p:cSld></p:sld>")
    return out.getvalue()


def shape(text, x, y, cx, cy, more=""):
    return (
        f'<p:sp><p:nvSpPr><p:cNvSpPr {more}/></p:nvSpPr><p:spPr><a:xfrm><a:off x="{x}" y="{y}"/><a:ext cx="{cx}" cy="{cy}"/></a:xfrm>'
        f'<a:prstGeom prst="rect"/></p:spPr><p:txBody><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>'
    )


DIAGRAM = "".join(shape(f"step {k}", 914400, 457200 * k, 1828800, 228600) for k in range(12))
FILES = {
    "notes.txt": "first page of notes\f생산성 기존 대비 12% 증가\n측정방법: 월간 집계\f \fthird page".encode(),
    "table.csv": b"name,value\nwidget,3\n\"a, b\",4\n",
    "deck.pptx": slides(DIAGRAM, shape("title", 0, 0, 9144000, 914400, 'txBox="1"') + "<p:pic/><p:cxnSp/><p:grpSp/>"),
    "readme.md": b"# head\n\nsome words\n\n" + b"long words " * 400,
    "broken.docx": b"this is no archive",
}


@pytest.fixture(scope="module")
def landing(spark, tmp_path_factory):
    """The files, uploaded; and the tables of a run that nothing stopped."""
    here = tmp_path_factory.mktemp("ingest")
    for name, data in FILES.items():
        (here / name).write_bytes(data)
    tables = VersionedTables(spark, f"file://{here}/clean", buckets=2)
    ids = ingest.upload(spark, tables, [f"file://{here}/{n}" for n in FILES], f"file://{here}/landing", "proj")
    assert {r["status"] for r in tables.read("sources").collect()} == {"INGESTING"} and len(set(ids)) == len(FILES)
    run(spark, here, tables, "clean")
    return here, tables, dict(zip(FILES, ids, strict=True))


def run(spark, here, tables, name, watch=lambda table: None):
    query = ingest.ingest_stream(spark, f"file://{here}/landing", tables, f"file://{here}/checkpoint-{name}", files_per_batch=10, watch=watch)
    query.awaitTermination()
    return query


def content(tables):
    """All rows of all tables, without what names a batch."""
    out = {}
    for name in (*ingest.TABLES, "postings", "postings_sources", "vectors"):
        df = tables.read(name)
        out[name] = sorted(str(r.asDict()) for r in df.select(sorted(c for c in df.columns if c not in ("batch", "filename", "project_id"))).collect())
    return out


def test_rows_of_all_formats(spark, landing):
    _, tables, ids = landing
    sources = {r["source_id"]: r for r in tables.read("sources").collect()}
    assert {n: (sources[i]["status"], sources[i]["page_count"]) for n, i in ids.items()} == {
        "notes.txt": ("READY", 3), "table.csv": ("READY", 1), "deck.pptx": ("READY", 2), "readme.md": ("READY", 2), "broken.docx": ("FAILED", 0),
    }
    assert "BadZipFile" in sources[ids["broken.docx"]]["error"] and sources[ids["notes.txt"]]["filename"] == "notes.txt"
    pages = {(r["source_id"], r["page"]): r for r in tables.read("pages").collect()}
    assert pages[ids["deck.pptx"], 1]["page_type"] == "DIAGRAM" and pages[ids["deck.pptx"], 1]["drawing_count"] == 12
    assert (pages[ids["deck.pptx"], 2]["image_count"], pages[ids["deck.pptx"], 2]["drawing_count"]) == (1, 2)
    assert pages[ids["notes.txt"], 3]["full_text"] == "third page"
    fact = tables.read("metric_facts").first()
    assert (fact["source_id"], fact["page_number"], fact["change_value"], fact["direction"]) == (ids["notes.txt"], 2, 12.0, "INCREASE")
    structure = tables.read("structure_facts").first()
    assert (structure["source_id"], structure["page"], structure["kind"], structure["n_nodes"]) == (ids["deck.pptx"], 1, "PROCESS", 12)
    assert tables.read("structure_edges").count() == 11
    box = tables.read("blocks").where(F.col("text") == "step 1").first()
    assert (box["x0"], box["y0"], box["x1"], box["y1"], box["width"]) == (72.0, 36.0, 216.0, 54.0, 720.0)
    assert [r["source_id"] for r in Postings(tables).search("third page").collect()] == [ids["notes.txt"]]
    assert VectorStore(tables).search("widget").first()["source_id"] == ids["table.csv"]


def test_a_stopped_batch_ends_like_a_clean_one(spark, landing):
    """A batch that fails half-way and is run again under its number, as a stream does it, repeats nothing."""
    here, clean, _ = landing
    tables = VersionedTables(spark, f"file://{here}/stopped", buckets=2)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"file://{here}/landing")

    def watch(table):
        if table == "postings":
            raise RuntimeError("stopped")

    with pytest.raises(RuntimeError, match="stopped"):
        ingest.ingest_batch(tables, Postings(tables), VectorStore(tables), files, ("ingest", 0), watch=watch)
    assert not tables.exists("sources") and not tables.exists("vectors")
    ingest.ingest_batch(tables, Postings(tables), VectorStore(tables), files, ("ingest", 0))
    assert content(tables) == content(clean)
    assert tables.versions("pages") == [1] and tables.versions("postings") == [1]


def test_new_text_of_a_source_replaces_the_old(spark, tmp_path):
    (tmp_path / "a.txt").write_text("old words\fsecond")
    tables = VersionedTables(spark, f"file://{tmp_path}/tables", buckets=2)
    for text in ("old words\fsecond", "new words"):
        (tmp_path / "a.txt").write_text(text)
        ids = ingest.upload(spark, tables, [f"file://{tmp_path}/a.txt"], f"file://{tmp_path}/landing", "p")
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"file://{tmp_path}/landing")
        number = tables.commit("pages").batches["b"] + 1 if tables.exists("pages") else 0
        ingest.ingest_batch(tables, Postings(tables), VectorStore(tables), files, ("b", number))
    assert [(r["source_id"], r["full_text"]) for r in tables.read("pages").collect()] == [(ids[0], "new words")]
    assert Postings(tables).search("old").count() == 0 and Postings(tables).search("words").count() == 1
    ingest.remove(tables, Postings(tables), VectorStore(tables), tables.read("sources"))
    assert tables.read("sources").count() == 0 and Postings(tables).search("words").count() == 0
    for bad, error in (("missing.txt", FileNotFoundError), ("a.xyz", ValueError)):
        (tmp_path / "a.xyz").write_text("")
        with pytest.raises(error):
            ingest.upload(spark, tables, [f"file://{tmp_path}/{bad}"], f"file://{tmp_path}/landing", "p")


def test_long_sheets_are_whole(spark):
    data = "\n".join(f"r{k},{k}" for k in range(500)).encode()
    page = readers.decode_csv(data, "s")[0]
    assert page.blocks[1][1].count("\n") == 499
    capped = readers.decode_csv(data, "s", most=200)[0].blocks[1][1].split("\n")
    assert len(capped) == 181 and capped[150] == "... (320 rows omitted) ..." and capped[-1] == "r499 | 499"


def test_vector_primitives(spark):
    schema = "source_id string, page int, paths array<struct<x0:double,y0:double,x1:double,y1:double,items:array<struct<op:string,points:array<struct<x:double,y:double>>>>>>"

    def path(box, *items):
        return (*map(float, box), [(op, [(float(x), float(y)) for x, y in points]) for op, points in items])

    paths = [
        path((0, 0, 10, 10), ("l", [(10, 10), (0, 0)]), ("l", [(0, 0), (3, 4)])),  # a line, a tick; an area of 100 is too small
        path((0, 0, 20, 10), ("re", [(0, 0), (20, 10)]), ("re", [(0, 0), (5, 5)])),  # a rectangle; one too small; no shape, as it has one
        path((0, 0, 20, 10), ("c", [(1, 1), (50, 50), (60, 60), (2, 2)])),  # a curve of any size, and the path's own rectangle
        path((0, 0, 200, 1)),  # area 200 without items
        (None, None, None, None, None), path((0, 0, 100, 100), ("re", [(9, 9)])),
    ]
    df = spark.createDataFrame([("s", 1, paths), ("s", 2, None), ("s", 3, [])], schema)
    got = [tuple(r) for r in graphs.primitives(df).orderBy("page", "seq").collect()]
    assert got == [
        ("s", 1, 0, "line", 0.0, 0.0, 10.0, 10.0, 10.0, 10.0, 0.0, 0.0),
        ("s", 1, 1, "rect", 0.0, 0.0, 20.0, 10.0, None, None, None, None),
        ("s", 1, 2, "line", 1.0, 1.0, 2.0, 2.0, 1.0, 1.0, 2.0, 2.0),
        ("s", 1, 3, "rect", 0.0, 0.0, 20.0, 10.0, None, None, None, None),
        ("s", 1, 4, "rect", 0.0, 0.0, 200.0, 1.0, None, None, None, None),
    ]
