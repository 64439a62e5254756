"""Ingest of source files as a stream: what comes into a landing folder becomes pages, blocks, facts, chunks and index rows.

Every micro-batch is written under its number. The files of a batch are decoded once into a staging folder, and all tables
follow from that; each table's log remembers the number, so that a batch that failed half-way and is run again adds what
is missing and repeats nothing. A source becomes READY last, when all its rows are there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ids import content_id
from ..operators import evidence, graphs, layout, metrics, retrieval
from ..operators.postings import Postings
from ..operators.vectors import HASH, Embedder, VectorStore
from ..sources import readers
from ..sources.versioned import Batch, VersionedTables

FILES = "path string, modificationTime timestamp, length long, content binary"
#: Tables of the ingest, in the order in which a batch writes them; postings and vectors come between chunks and sources.
TABLES = ("pages", "blocks", "metric_facts", "structure_facts", "structure_edges", "chunks", "sources")


def source_id(path: Column) -> Column:
    """The folder of a stored file (``.../<source_id>/original.<ext>``), else an id from the path."""
    stored = F.regexp_extract(path, r"([^/]+)/original\.[^/.]+$", 1)
    return F.when(stored != "", stored).otherwise(content_id("SRC", path))


def upload(spark: SparkSession, tables: VersionedTables, paths: list[str], landing: str, project_id: str) -> list[str]:
    """Store files under ``landing/<project>/<source>/original.<ext>`` and list them as INGESTING; gives their source ids.

    A missing file and one of an unknown format are refused before anything is stored. A file that comes again has its
    id again, from project and name, and is ingested anew.
    """
    found = []
    for path in paths:
        fs, place = tables._path(path)
        if not fs.exists(place):
            raise FileNotFoundError(path)
        found.append((fs, place, readers.detect_format(path)))
    names = spark.createDataFrame([(p.getName(),) for _, p, _ in found], "filename string")
    rows = names.select(content_id("SRC", F.lit(project_id), "filename").alias("source_id"), F.lit(project_id).alias("project_id"), "filename")
    ids = {r["filename"]: r["source_id"] for r in rows.collect()}
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for fs, place, kind in found:
        target_fs, target = tables._path(f"{landing.rstrip('/')}/{project_id}/{ids[place.getName()]}/original.{kind}")
        # A stream sees a file when it is renamed into its place, whole; it does not look at hidden files.
        draft = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}")
        target_fs.mkdirs(target.getParent())
        jvm.org.apache.hadoop.fs.FileUtil.copy(fs, place, target_fs, draft, False, conf)
        target_fs.delete(target, False)
        target_fs.rename(draft, target)
    listed = rows.select("source_id", "project_id", "filename", F.lit("INGESTING").alias("status"), F.lit(0).cast("long").alias("page_count"), F.lit(None).cast("string").alias("error"))
    tables.upsert("sources", listed, ["source_id"])
    return [ids[p.getName()] for _, p, _ in found]


def remove(tables: VersionedTables, postings: Postings, store: VectorStore, sources: DataFrame) -> None:
    """Forget sources (source_id): from the indexes first, from the list last."""
    postings.drop(sources)
    store.clear_sources(sources)
    for name in TABLES:
        tables.delete_keys(name, sources.select("source_id"))


def decoded(files: DataFrame, decoders: dict | None = None) -> DataFrame:
    """Block rows of files with ``source_id``; seq is the reading order of a page."""
    rows = readers.decode_files(files, decoders).withColumn("source_id", source_id(F.col("path")))
    return rows.withColumn("block_id", content_id("BLK", "source_id", "page", "seq"))


def page_rows(blocks: DataFrame) -> DataFrame:
    """Pages (source_id, page, page_type, needs_ocr, width, height, full_text, ...) of decoded blocks."""
    held = F.col("block_type").isNotNull() & (F.col("block_type") != "IMAGE") & (F.trim(F.coalesce("text", F.lit(""))) != "")
    # Of blocks with one key (letters, digits and signs only) the first one's text counts.
    first = F.row_number().over(Window.partitionBy("source_id", "page", held, evidence.line_key(F.col("text"))).orderBy("seq")) == 1
    item = F.when(held & F.col("first"), F.struct("seq", F.trim("text").alias("t")))
    pages = blocks.withColumn("first", first).groupBy("source_id", "page").agg(
        F.first("width").alias("width"), F.first("height").alias("height"), F.max("image_count").alias("image_count"),
        F.max("drawing_count").alias("drawing_count"), F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda i: i["t"]), "\n").alias("full_text"),
    )
    pages = pages.withColumn("text_layer", F.trim("full_text") != "")
    typed = layout.page_types(pages, blocks.where("block_type IS NOT NULL"))
    return pages.join(typed, layout.PAGE)


def structure_rows(pages: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Structure facts and edges of the pages that hold a diagram."""
    drawn = graphs.primitives(blocks.where("paths IS NOT NULL").select("source_id", "page", "paths"))
    graph = evidence.holds_graph(pages.select("source_id", "page", "page_type"), blocks, drawn).where("holds_graph").select("source_id", "page")
    found = graphs.nodes(blocks.join(graph, layout.PAGE, "left_semi"))
    drawn = drawn.join(graph, layout.PAGE, "left_semi")
    facts, edges = graphs.graph_facts(found, drawn.where("kind = 'line'"), drawn.where("kind = 'rect'"))
    facts = facts.where("n_nodes >= 3").withColumn("fact_id", content_id("STR", "source_id", "page"))
    return facts, edges.join(facts.select("source_id", "page"), layout.PAGE, "left_semi")


def ingest_batch(
    tables: VersionedTables, postings: Postings, store: VectorStore, files: DataFrame, batch: Batch, decoders: dict | None = None,
    watch: Callable[[str], None] = lambda table: None,
) -> None:
    """All rows of files (path, content) under one batch; ``watch`` is told the name of each table that is written.

    Decoded files, pages, blocks and chunks are staged, so that each is made once for all the tables that need it.
    """
    spark = files.sparkSession
    staged = f"{tables.root}/_staged/{batch[0]}-{batch[1]}"

    def stage(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{staged}/{name}")
        return spark.read.parquet(f"{staged}/{name}")

    rows = stage("decoded", decoded(files, decoders))
    sources = rows.select("source_id").distinct()
    good = rows.where("error IS NULL")
    pages = stage("pages", page_rows(good))
    typed = good.where("block_type IS NOT NULL").join(pages.select("source_id", "page", "page_type"), layout.PAGE)
    usable = stage("blocks", typed.where((F.col("block_type") != "IMAGE") & (F.trim("text") != "")))
    said = pages.select("source_id", F.col("page").alias("page_number"), F.col("full_text").alias("text"))
    facts, edges = structure_rows(pages, typed)
    chunks = stage("chunks", retrieval.chunk_pages(usable).withColumn("chunk_id", content_id("CHK", "source_id", "page", "chunk_no")))
    made = {"pages": pages, "blocks": usable.drop("path", "paths", "error"), "metric_facts": metrics.metric_facts(said), "structure_facts": facts, "structure_edges": edges, "chunks": chunks}
    for name, table in made.items():
        tables.replace_keys(name, table, "source_id", batch=batch, keys=sources)
        watch(name)
    postings.add(usable.select("source_id", "page", "seq", "block_id", "text"), batch)
    watch("postings")
    store.upsert(chunks.select("source_id", "chunk_id", "page", "text"), batch)
    watch("vectors")
    ends = rows.groupBy("source_id").agg(
        F.max("path").alias("_path"), F.countDistinct("page").alias("page_count"), F.max("error").alias("error")
    )
    ends = ends.withColumn("status", F.when(F.col("error").isNull(), "READY").otherwise("FAILED"))
    # What the upload has listed stays; files that came without one get a row.
    listed = tables.read("sources") if tables.exists("sources") else spark.createDataFrame([], "source_id string, project_id string, filename string")
    known = listed.select("source_id", "project_id", "filename")
    ends = ends.join(known, "source_id", "left").withColumn("filename", F.coalesce("filename", F.regexp_extract("_path", "([^/]+)$", 1)))
    tables.upsert("sources", ends.select("source_id", "project_id", "filename", "status", "page_count", "error"), ["source_id"], batch=batch, known=sources)
    watch("sources")


def ingest_stream(
    spark: SparkSession, landing: str, tables: VersionedTables, checkpoint: str, embedder: Embedder = HASH, decoders: dict | None = None,
    files_per_batch: int = 1000, name: str = "ingest", watch: Callable[[str], None] = lambda table: None,
):
    """Start a query that takes in what has come into ``landing`` since the last run, and ends.

    A stopped or failed run goes on where it was when it is started again with the same checkpoint and name.
    """
    postings, store = Postings(tables), VectorStore(tables, embedder)
    files = (
        spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("pathGlobFilter", "original.*")
        .option("maxFilesPerTrigger", files_per_batch).load(landing)
    )

    def take(batch: DataFrame, number: int) -> None:
        ingest_batch(tables, postings, store, batch, (name, number), decoders, watch)

    return files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).queryName(name).trigger(availableNow=True).start()
