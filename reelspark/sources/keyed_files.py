"""A sink of one file a row, which can be taken up again: what is there already isn't written twice.

Every task writes its own rows' files, each under another name first and then moved, so a file is there whole or
not at all, however often a task runs. What a task did comes back in its commit message; the last of all
is a list of counts, written when every task is through. A run that was stopped leaves whole files and no
list; the next one writes what is missing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT, DONE = "keyed_files", "_DONE"


@dataclass
class Written(WriterCommitMessage):
    written: int
    skipped: int
    size: int


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _Writer(DataSourceWriter):
    def __init__(self, options: dict):
        self.path, self.force = options["path"], options.get("force", "false") == "true"

    def write(self, iterator: Iterator[Row]) -> Written:
        from pyarrow import fs

        store, base = _store(self.path)
        store.create_dir(base, recursive=True)
        done, made = Written(0, 0, 0), set()
        for row in iterator:
            to = f"{base}/{row['file']}"
            if not self.force and store.get_file_info(to).type != fs.FileType.NotFound:
                done.skipped += 1
                continue
            folder = to.rpartition("/")[0]
            if folder not in made:
                store.create_dir(folder, recursive=True)
                made.add(folder)
            part = f"{folder}/.{uuid.uuid4().hex}.part"
            try:
                with store.open_output_stream(part) as out:
                    out.write(bytes(row["content"] or b""))
                store.move(part, to)
            except BaseException:
                if store.get_file_info(part).type != fs.FileType.NotFound:
                    store.delete_file(part)
                raise
            done.written, done.size = done.written + 1, done.size + len(row["content"] or b"")
        return done

    def commit(self, messages: list[Written | None]) -> None:
        store, base = _store(self.path)
        store.create_dir(base, recursive=True)
        total = {k: sum(getattr(m, k) for m in messages if m) for k in ("written", "skipped", "size")}
        with store.open_output_stream(f"{base}/{DONE}") as out:
            out.write(json.dumps(total).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Whole files stay: the next run goes on from them."""


class KeyedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options)


def write(rows: DataFrame, path: str, file: str = "file", content: str = "content", force: bool = False) -> dict:
    """Writes each row's ``content`` to the file named ``file`` below ``path``, unless it is there or ``force`` is set.

    Returns the counts: written, skipped, size. Of rows with one name one is written. Rows without a name are an error.
    """
    spark = rows.sparkSession
    spark.dataSource.register(KeyedFiles)
    name = F.when(F.col(file).isNull(), F.raise_error(F.lit("a row has no file name"))).otherwise(F.col(file))
    one = rows.select(name.cast("string").alias("file"), F.col(content).cast("binary").alias("content")).dropDuplicates(["file"])
    one.write.format(FORMAT).option("path", path).option("force", str(force).lower()).mode("append").save()
    return done(spark, path)


def done(spark: SparkSession, path: str) -> dict | None:
    """The counts of the last run that came to its end; None if there is none."""
    from pyarrow import fs

    store, base = _store(path)
    if store.get_file_info(f"{base}/{DONE}").type == fs.FileType.NotFound:
        return None
    with store.open_input_stream(f"{base}/{DONE}") as f:
        return json.loads(f.read())


def missing(rows: DataFrame, path: str, file: str = "file") -> DataFrame:
    """The rows whose file isn't there yet: what is worth working out before ``write``."""
    found = rows.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "[!._]*")
    store, base = _store(path)
    from pyarrow import fs

    if store.get_file_info(base).type != fs.FileType.Directory:
        return rows
    there = found.load(path).select(F.element_at(F.split("path", rf"\Q{base.rstrip('/')}/\E", 2), -1).alias("__there"))
    return rows.join(there, rows[file] == F.col("__there"), "left_anti")
