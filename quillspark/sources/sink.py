"""A Spark data source that writes files of reports: Markdown, JSON, CSV and zip bundles.

    rows.write.format("quill_files").option("kind", "markdown").mode("overwrite").save("file:///reports/1")

Rows of ``markdown`` are (file, content), a file each; of ``json`` (file, ...), an object of the other columns each; ``csv`` rows go to
one file per partition, with a header; ``bundle`` rows are (bundle, file, content), a zip per bundle, so the rows of a bundle must
lie together in one partition, by file (``write_bundles`` sees to it).

Each task writes to a folder of its own attempt. The driver moves the files of the attempts that Spark has accepted into
one hidden folder and then renames that to the target, in one step. A failed job, or a task that runs twice, leaves nothing
to see.
"""

from __future__ import annotations

import csv
import io
import json
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "quill_files"
KINDS = {"markdown": {"file", "content"}, "json": {"file"}, "csv": set(), "bundle": {"bundle", "file", "content"}}
ZIP_TIME = (1980, 1, 1, 0, 0, 0)  # so that equal rows make equal bundles


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: list[str]


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _safe(name: str) -> str:
    """A relative name that stays inside its folder."""
    parts = name.split("/")
    if not name or name.startswith("/") or any(p in ("", ".", "..") for p in parts):
        raise ValueError(f"not a file name inside the target: {name!r}")
    return name


class FileWriter(DataSourceWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.kind, self.path, self.overwrite, self.names = options.get("kind", "markdown"), options["path"].rstrip("/"), overwrite, schema.names
        if self.kind not in KINDS:
            raise ValueError(f"kind is one of {sorted(KINDS)}, not {self.kind!r}")
        if missing := KINDS[self.kind] - set(self.names):
            raise ValueError(f"{self.kind} rows lack {sorted(missing)}")
        head, _, tail = self.path.rpartition("/")
        self.staged = f"{head}/.{tail}-{uuid.uuid4().hex}"

    def _files(self, rows: Iterator[Row], attempt: str) -> Iterator[tuple[str, bytes]]:
        if self.kind == "markdown":
            yield from ((_safe(r["file"]), (r["content"] or "").encode()) for r in rows)
        elif self.kind == "json":
            for r in rows:
                rest = {k: v for k, v in r.asDict(recursive=True).items() if k != "file"}
                yield _safe(r["file"]), json.dumps(rest, ensure_ascii=False, indent=2, default=str).encode()
        elif self.kind == "csv":
            out = io.StringIO(newline="")
            lines = csv.writer(out, lineterminator="\n")
            lines.writerow(self.names)
            n = sum(1 for r in rows if lines.writerow(["" if v is None else v for v in r]))
            if n:
                yield f"part-{attempt}.csv", out.getvalue().encode()
        else:
            yield from self._bundles(rows)

    def _bundles(self, rows: Iterator[Row]) -> Iterator[tuple[str, bytes]]:
        name, out, seen = None, None, set()
        for r in rows:
            if r["bundle"] != name:
                if out is not None:
                    yield _closed(name, out)
                name = r["bundle"]
                if name in seen:
                    raise ValueError(f"rows of bundle {name!r} do not lie together")
                seen.add(name)
                out = (io.BytesIO(), [])
            out[1].append((_safe(r["file"]), (r["content"] or "").encode()))
        if out is not None:
            yield _closed(name, out)

    def write(self, iterator: Iterator[Row]) -> Written:
        attempt = uuid.uuid4().hex
        fs, staged = _fs(self.staged)
        files = []
        for name, data in self._files(iterator, attempt):
            path = f"{staged}/{attempt}/{name}"
            fs.create_dir(path.rpartition("/")[0], recursive=True)
            with fs.open_output_stream(path) as out:
                out.write(data)
            files.append(name)
        if len(set(files)) < len(files):
            raise ValueError("two rows of a partition name the same file")
        return Written(attempt, files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow.fs import FileType

        fs, staged = _fs(self.staged)
        _, target = _fs(self.path)
        fs.create_dir(f"{staged}/out", recursive=True)
        seen: set[str] = set()
        for message in filter(None, messages):
            for name in message.files:
                if name in seen:
                    self.abort(messages)
                    raise ValueError(f"two rows name the file {name!r}")
                seen.add(name)
                fs.create_dir(f"{staged}/out/{name}".rpartition("/")[0], recursive=True)
                fs.move(f"{staged}/{message.folder}/{name}", f"{staged}/out/{name}")
        old = fs.get_file_info(target).type != FileType.NotFound
        if old and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(self.path)
        if old:
            fs.move(target, f"{staged}/old")
        fs.move(f"{staged}/out", target)
        fs.delete_dir(staged)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow.fs import FileType

        fs, staged = _fs(self.staged)
        if fs.get_file_info(staged).type != FileType.NotFound:
            fs.delete_dir(staged)


def _closed(name: str, out: tuple[io.BytesIO, list[tuple[str, bytes]]]) -> tuple[str, bytes]:
    data, files = out
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for file, content in files:
            z.writestr(zipfile.ZipInfo(file, ZIP_TIME), content, zipfile.ZIP_DEFLATED)
    return _safe(f"{name}.zip"), data.getvalue()


class FileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return FileWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FileSource)


def _save(rows: DataFrame, kind: str, path: str, overwrite: bool) -> None:
    register(rows.sparkSession)
    # Spark's mode tells the writer whether an old target may go; without it the writer itself refuses.
    rows.write.format(NAME).option("kind", kind).mode("overwrite" if overwrite else "append").save(path)


def write_markdown(rows: DataFrame, path: str, overwrite: bool = True) -> None:
    """(file, content) rows as files."""
    _save(rows.select("file", "content"), "markdown", path, overwrite)


def write_json(rows: DataFrame, path: str, overwrite: bool = True) -> None:
    _save(rows, "json", path, overwrite)


def write_csv(rows: DataFrame, path: str, overwrite: bool = True) -> None:
    _save(rows, "csv", path, overwrite)


def write_bundles(rows: DataFrame, path: str, overwrite: bool = True) -> None:
    """(bundle, file, content) rows as ``<bundle>.zip`` each; a bundle's files lie in one task, as a zip is one file."""
    together = rows.select("bundle", "file", "content").repartition("bundle").sortWithinPartitions("bundle", "file")
    _save(together, "bundle", path, overwrite)


def export_files(reports: DataFrame, claims: DataFrame, references: DataFrame) -> DataFrame:
    """(bundle, file, content) of editions: the report, the claim ledger as CSV, and the references as JSON.

    reports (edition_id, report), claims (edition_id, claim_id, statement, ...), references (edition_id, source_id, ...).
    """
    report = reports.select(F.col("edition_id").alias("bundle"), F.lit("report.md").alias("file"), F.col("report").alias("content"))
    names = [c for c in claims.columns if c != "edition_id"]
    cell = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    lines = claims.groupBy("edition_id").agg(F.array_sort(F.collect_list(F.concat_ws(",", *map(cell, names)))).alias("l"))
    ledger = lines.select(F.col("edition_id").alias("bundle"), F.lit("claims.csv").alias("file"), F.concat(F.array_join(F.concat(F.array(F.lit(",".join(names))), "l"), "\n"), F.lit("\n")).alias("content"))
    rest = [c for c in references.columns if c != "edition_id"]
    listed = references.groupBy("edition_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct(*rest)))).alias("content"))
    refs = listed.select(F.col("edition_id").alias("bundle"), F.lit("references.json").alias("file"), "content")
    return report.unionByName(ledger).unionByName(refs)


def export_rows(files: DataFrame, path: str) -> DataFrame:
    """Rows of the exports table (export_id, edition_id, format, storage_path, status): one per file of a bundle, and its zip."""
    from ..functions.ids import content_id

    root = path.rstrip("/")
    ending = F.lower(F.regexp_extract("file", r"\.([^.]+)$", 1))
    kind = F.when(ending == "md", "markdown").otherwise(ending)
    every = files.select("bundle", kind.alias("format"), F.concat(F.lit(f"{root}/"), "bundle", F.lit(".zip/"), "file").alias("storage_path"))
    zips = files.select("bundle").distinct().select("bundle", F.lit("zip").alias("format"), F.concat(F.lit(f"{root}/"), "bundle", F.lit(".zip")).alias("storage_path"))
    rows = every.unionByName(zips)
    return rows.select(content_id("EXP", "storage_path").alias("export_id"), F.col("bundle").alias("edition_id"), "format", "storage_path", F.lit("READY").alias("status"))
