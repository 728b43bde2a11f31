"""Files that are written all or not at all: a Python data source whose tasks write aside, and whose driver moves and lists what they wrote.

Each attempt of a task writes files of its own under ``_staging-…``. Only attempts that Spark commits are moved to the path,
one rename a task; then a manifest names them, written last and put in place by a rename. A job that fails takes its staging
folder away, and one whose driver dies leaves files that no manifest names, which the next overwrite removes.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from millrace.functions.text import safe_filename
from millrace.sources.archive import opened

MANIFEST = "_manifest.json"
STATUS = "title string, author string, status string, size string, path string, images int"


@dataclass
class Written(WriterCommitMessage):
    """What one task wrote: the names of its file and of its status file in the staging folder, its partition, rows and bytes."""

    part: int
    name: str | None
    status: str | None
    rows: int
    bytes: int


class CommittedFiles(DataSource):
    """``kind``: markdown, lines of one table; or articles, a folder with a file for each row."""

    @classmethod
    def name(cls) -> str:
        return "committed_files"

    def schema(self) -> str:
        raise NotImplementedError("committed files are only written; read them by their manifest")

    def writer(self, schema: StructType, overwrite: bool) -> FileSetWriter:
        return {"markdown": MarkdownWriter, "articles": ArticleWriter}[self.options["kind"]](self.options["path"], schema.names, overwrite)


class FileSetWriter(DataSourceArrowWriter):
    """The commit; kinds say what a task writes."""

    ending = ""

    def __init__(self, path: str, names: list[str], overwrite: bool) -> None:
        self.path, self.names, self.overwrite, self.job = path, names, overwrite, uuid.uuid4().hex
        store, folder = self.staging()
        store.create_dir(folder, recursive=True)  # by the driver alone: tasks that outlive their job find it gone, and fail

    def place(self, *more: str) -> tuple[fs.FileSystem, str]:
        store, path = opened(self.path)
        return store, "/".join([path.rstrip("/"), *more])

    def staging(self, *more: str) -> tuple[fs.FileSystem, str]:
        return self.place(f"_staging-{self.job}", *more)

    def header(self) -> str | None:
        return None

    def task(self, store: fs.FileSystem, folder: str, name: str, rows: Iterator[pa.RecordBatch]) -> Written:
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        context = TaskContext.get()
        store, folder = self.staging()
        return self.task(store, folder, f"{context.partitionId():05d}-{context.taskAttemptId()}", iterator)

    def commit(self, messages: list[Written | None]) -> None:
        """Moves the parts in the order of their partitions; the first of a set brings the header."""
        store, path = self.place()
        store.create_dir(path, recursive=True)
        before = [] if self.overwrite else manifest(self.path)["commits"]
        number, files = len(before), []
        if not before and self.header() is not None:
            name = f"part-{0:05d}-head{self.ending}"
            self.put(store, self.staging(name)[1], self.header())
            files.append({"name": name, "rows": 0, "staged": name, "bytes": len(self.header().encode())})
        statuses = []
        for m in sorted((m for m in messages if m and m.rows), key=lambda m: m.part):
            files.append({"name": f"part-{number:05d}-{m.part:05d}{self.ending}", "rows": m.rows, "bytes": m.bytes, "staged": m.name})
            if m.status:
                statuses.append((m.status, f"part-{number:05d}-{m.part:05d}.json"))
        old = names_of(manifest(self.path)) if self.overwrite else set()
        aside = f"{path}/_replaced-{self.job}"
        for name in sorted(old):
            if store.get_file_info(f"{path}/{name}").type != fs.FileType.NotFound:
                store.create_dir(f"{aside}/{name}".rpartition("/")[0], recursive=True)
                store.move(f"{path}/{name}", f"{aside}/{name}")
        for f in files:
            store.move(self.staging(f.pop("staged"))[1], f"{path}/{f['name']}")
        if statuses:
            store.create_dir(f"{path}/_status", recursive=True)
        for staged, name in statuses:
            store.move(self.staging(staged)[1], f"{path}/_status/{name}")
        commit = {"id": self.job, "files": files, "status": [f"_status/{name}" for _, name in statuses]}
        self.put(store, self.staging(MANIFEST)[1], json.dumps({"commits": [*before, commit]}, indent=1))
        store.move(self.staging(MANIFEST)[1], f"{path}/{MANIFEST}")
        for folder in (self.staging()[1], aside):
            if store.get_file_info(folder).type == fs.FileType.Directory:
                store.delete_dir(folder)

    def put(self, store: fs.FileSystem, path: str, text: str) -> None:
        store.create_dir(path.rpartition("/")[0], recursive=True)
        with store.open_output_stream(path) as out:
            out.write(text.encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = self.staging()
        for _ in range(5):  # a task may add a file meanwhile
            try:
                if store.get_file_info(folder).type == fs.FileType.Directory:
                    store.delete_dir(folder)
                return
            except OSError:
                time.sleep(1)


class MarkdownWriter(FileSetWriter):
    """Rows of one text column, lines of a table whose header is in the first file of the set; the column's name is that header."""

    ending = ".md"

    def header(self) -> str:
        return self.names[0]

    def task(self, store: fs.FileSystem, folder: str, name: str, rows: Iterator[pa.RecordBatch]) -> Written:
        n = size = 0
        with store.open_output_stream(f"{folder}/{name}") as out:
            for table in rows:
                if table.num_rows:
                    text = ("\n".join(table.column(0).to_pylist()) + "\n").encode()
                    out.write(text)
                    n, size = n + table.num_rows, size + len(text)
        return Written(TaskContext.get().partitionId(), name, None, n, size)


class ArticleWriter(FileSetWriter):
    """Rows (title, author, folder, file, content, images): the content goes to folder/file in the task's folder, and a status row of each to the task's status file."""

    def task(self, store: fs.FileSystem, folder: str, name: str, rows: Iterator[pa.RecordBatch]) -> Written:
        n = size = 0
        store.create_dir(f"{folder}/{name}", recursive=False)
        with store.open_output_stream(f"{folder}/{name}-status") as told:
            for table in rows:
                for row in table.to_pylist():
                    raw = (row["content"] or "").encode()
                    status = {"title": row["title"], "author": "-", "status": "failed", "size": "No content to save"}
                    if raw:
                        store.create_dir(f"{folder}/{name}/{row['folder']}", recursive=False)
                        with store.open_output_stream(f"{folder}/{name}/{row['folder']}/{row['file']}") as out:
                            out.write(raw)
                        status = {"title": row["title"], "author": row["author"] or "-", "status": "ok", "size": shown_size(len(raw)), "path": f"{row['folder']}/{row['file']}", "images": row["images"]}
                    told.write((json.dumps(status, ensure_ascii=False) + "\n").encode())
                    n, size = n + 1, size + len(raw)
        return Written(TaskContext.get().partitionId(), name, f"{name}-status", n, size)


def shown_size(n: int) -> str:
    return f"{n / 1e6:.1f} MB" if n > 1_000_000 else f"{n / 1e3:.1f} KB" if n > 1000 else f"{n} bytes"


def manifest(path: str) -> dict:
    """What has been committed to ``path``: commits with their files, in order; no commits where nothing has."""
    store, folder = opened(path)
    if store.get_file_info(f"{folder.rstrip('/')}/{MANIFEST}").type != fs.FileType.File:
        return {"commits": []}
    with store.open_input_stream(f"{folder.rstrip('/')}/{MANIFEST}") as file:
        return json.loads(file.read())


def names_of(found: dict) -> set[str]:
    return {name for c in found["commits"] for name in (*(f["name"] for f in c["files"]), *c["status"])}


def save(df: DataFrame, path: str, kind: str, overwrite: bool) -> None:
    df.sparkSession.dataSource.register(CommittedFiles)
    df.write.format(CommittedFiles.name()).option("kind", kind).mode("overwrite" if overwrite else "append").save(path)


def write_markdown(lines: DataFrame, header: str, path: str, overwrite: bool = True) -> None:
    """Lines of a Markdown table (one column) as a set of files that together are one table: its header stands once, in the first."""
    save(lines.toDF(header), path, "markdown", overwrite)


def save_articles(
    df: DataFrame, path: str, title: str = "title", content: str = "content", author: str | None = None, images: str | None = None, file: str = "article.md", key: str | None = None, overwrite: bool = True,
) -> DataFrame:
    """Writes an article a row to ``path``/part-…/folder/``file`` and gives back the status rows (STATUS) of all articles there.

    The folder is the title as a file name, ``article`` without one, with ``key`` behind it, which tells articles of one
    title apart (without a key the last one of a task stays, as names are then meant to be unique). Rows without content
    are ``failed`` and write nothing. ``images`` counts the images that an article names; their addresses stay as they are.
    """
    name = F.coalesce(F.col(f"`{title}`").cast("string"), F.lit("article"))
    folder = safe_filename(name)
    folder = F.when(folder == "", "article").otherwise(folder)
    folder = folder if key is None else F.concat_ws("-", folder, safe_filename(F.col(f"`{key}`").cast("string")))
    count = F.lit(0) if images is None else F.coalesce(F.size(F.col(f"`{images}`")), F.lit(0))
    rows = df.select(
        name.alias("title"), (F.lit(None).cast("string") if author is None else F.col(f"`{author}`").cast("string")).alias("author"), folder.alias("folder"), F.lit(file).alias("file"),
        F.col(f"`{content}`").cast("string").alias("content"), count.alias("images"),
    )
    save(rows, path, "articles", overwrite)
    return statuses(df.sparkSession, path)


def statuses(spark: SparkSession, path: str) -> DataFrame:
    """The status rows of all articles that were committed to ``path``, each with its ``part``."""
    files = [f"{path.rstrip('/')}/{name}" for c in manifest(path)["commits"] for name in c["status"]]
    if not files:
        return spark.createDataFrame([], STATUS + ", part string")
    return spark.read.schema(STATUS).json(files).withColumn("part", F.regexp_extract(F.input_file_name(), r"(part-[\d\-]+)\.json$", 1))
