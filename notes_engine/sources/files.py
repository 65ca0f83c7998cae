"""One file for each row: a data source that writes, and the files of finished sources.

Tasks write below ``_temporary/<job>/<task>`` of the target; the job's commit
moves what the tasks that succeeded report and deletes the rest, so a lost or
repeated task leaves nothing.  Files go to any file system that Arrow can open.
"""

from __future__ import annotations

import posixpath
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

SINK = "notes_files"


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # below the task's folder, below the target
    folder: str


def relative(path: str | None) -> str:
    """A path below the target; ``ValueError`` for one that leaves it."""
    clean = posixpath.normpath(path or "")
    if not path or clean.startswith(("/", "..")) or clean == "." or "\\" in clean or "\0" in clean or clean.split("/")[0] == "_temporary":
        raise ValueError(f"not a path below the target: {path!r}")
    return clean


class _Writer(DataSourceWriter):
    def __init__(self, target: str, overwrite: bool):
        self.target, self.overwrite, self.job = target, overwrite, uuid.uuid4().hex

    def _open(self):
        from pyarrow import fs

        if "://" not in self.target:
            target = self.target.removeprefix("file:")
            return fs.LocalFileSystem(), target.rstrip("/")
        system, root = fs.FileSystem.from_uri(self.target)
        return system, root.rstrip("/")

    def write(self, rows: Iterator[Row]) -> Written:
        system, root = self._open()
        task = f"_temporary/{self.job}/{uuid.uuid4().hex}"
        system.create_dir(f"{root}/{task}", recursive=False)  # fails once the job is over
        files = []
        for n, row in enumerate(rows):
            path, part = relative(row["path"]), f"{task}/{n // 1000}/{n}"
            if n % 1000 == 0:
                system.create_dir(f"{root}/{task}/{n // 1000}", recursive=False)
            with system.open_output_stream(f"{root}/{part}") as out:
                out.write((row["text"] or "").encode("utf-8", "surrogatepass"))
            files.append((part, path))
        return Written(files, task)

    def commit(self, messages: list[Written | None]) -> None:
        """Move all files to their places; two rows of one path are an error, before anything is moved."""
        system, root = self._open()
        files = [f for m in messages if m is not None for f in m.files]
        try:
            seen: set[str] = set()
            for _, path in files:
                if path in seen:
                    raise ValueError(f"two rows for {path}")
                seen.add(path)
            there = {i.path for i in system.get_file_info([f"{root}/{p}" for p in seen]) if i.type.name != "NotFound"} if not self.overwrite else set()
            if there:
                raise FileExistsError(sorted(there)[0])
            for folder in {posixpath.dirname(p) for p in seen}:
                system.create_dir(posixpath.join(root, folder), recursive=True)
            for part, path in files:
                system.move(f"{root}/{part}", f"{root}/{path}")
        finally:
            self._clear(system, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*self._open())

    def start(self) -> _Writer:
        system, root = self._open()
        system.create_dir(f"{root}/_temporary/{self.job}", recursive=True)
        return self

    def _clear(self, system, root: str) -> None:
        """Delete the job's folder, also where tasks that were told to stop still write; they cannot make it again."""
        from pyarrow import fs

        for k in range(50):
            try:
                if system.get_file_info(f"{root}/_temporary/{self.job}").type.name != "NotFound":
                    system.delete_dir(f"{root}/_temporary/{self.job}")
                break
            except OSError:
                if k == 49:
                    raise
                time.sleep(0.1)
        try:
            if not system.get_file_info(fs.FileSelector(f"{root}/_temporary")):
                system.delete_dir(f"{root}/_temporary")
        except OSError:  # another job's, or gone
            pass


class FileSink(DataSource):
    """``df.write.format("notes_files").mode("append").save(target)`` for rows (path, text)."""

    @classmethod
    def name(cls) -> str:
        return SINK

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if not {"path", "text"} <= set(schema.names):
            raise ValueError("files need the columns path and text")
        return _Writer(self.options["path"], overwrite).start()


def write(files: DataFrame, target: str, overwrite: bool = True) -> None:
    """Write rows (path, text) as files below ``target``; null texts are empty files.

    With ``overwrite`` files of the same paths are replaced, others stay; without
    it any that is there is an error.
    """
    files.sparkSession.dataSource.register(FileSink)
    out = files.select(F.col("path").cast("string"), F.col("text").cast("string"))
    out.write.format(SINK).mode("overwrite" if overwrite else "append").save(target)


def folder_name(x: Column) -> Column:
    """A title as the name of a folder: letters, digits, ``-`` and ``_``; runs of others as one ``_``."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(x, r"(?U)[^\w-]+", "_"), "^_+|_+$", ""), F.lit("")), F.lit("untitled"))


def rendered_files(rendered: DataFrame, folder: Column) -> DataFrame:
    """path, text of the three files of each source: ``content.md``, ``summary.md`` and ``README.md`` in its folder.

    ``rendered`` has the texts content, summary and readme; a null one makes no file.
    """
    names = {"content": "content.md", "summary": "summary.md", "readme": "README.md"}
    each = F.explode(F.array(*[F.struct(F.concat_ws("/", folder, F.lit(n)).alias("path"), F.col(c).alias("text")) for c, n in names.items()]))
    return rendered.select(each.alias("f")).select("f.path", "f.text").where("text is not null")


def usage_files(reports: DataFrame, folder: Column, stamp: Column) -> DataFrame:
    """path, text of ``llm_usage_<time>.md`` and ``.json`` of each run (reports: report and json_report)."""
    base = F.concat_ws("/", folder, F.concat(F.lit("llm_usage_"), F.date_format(stamp, "yyyyMMdd_HHmmss")))
    each = F.explode(F.array(*[F.struct(F.concat(base, F.lit(end)).alias("path"), F.col(c).alias("text")) for c, end in (("report", ".md"), ("json_report", ".json"))]))
    return reports.select(each.alias("f")).select("f.path", "f.text").where("text is not null")


def read(spark: SparkSession, target: str) -> DataFrame:
    """path, text of all files below a target."""
    rows = spark.read.text(target, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    root = target.removeprefix("file:").rstrip("/").lstrip("/")
    return rows.select(F.regexp_replace(F.substring_index(F.url_decode("file"), root, -1), "^/", "").alias("path"), "text")
