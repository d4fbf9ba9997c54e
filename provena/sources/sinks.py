"""A sink of whole files: one file for each row, all of them or none.

Tasks write below a staging folder of their own; when every task has ended well, the files move
to their names, and otherwise the staging folder goes. The folder is reached through Arrow's file
systems, so it may be local, HDFS or an object store.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from provena.sources.shipping import ship

FORMAT = "provena_files"
#: A file of the staging folder that says that the job goes on.
MARK = "_going"
#: Files that are moved at the same time.
MOVERS = 16


def _opened(path: str):
    """Arrow's file system of a path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace(":", "://", 1))


def _there(system, path: str) -> bool:
    from pyarrow import fs

    return system.get_file_info(path).type != fs.FileType.NotFound


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: its folder, and the names in it."""

    folder: str
    names: list[str]


class _Writer(DataSourceWriter):
    def __init__(self, path: str) -> None:
        self.path = path.rstrip("/")
        self.staging = f"{self.path}/_staging-{uuid.uuid4().hex}"
        system, base = _opened(self.staging)
        system.create_dir(base, recursive=True)
        with system.open_output_stream(f"{base}/{MARK}") as out:
            out.write(b"")

    def write(self, rows: Iterator) -> Written:
        from pyspark import TaskContext

        system, base = _opened(self.staging)
        folder, names = f"{base}/{TaskContext.get().taskAttemptId()}", []
        try:
            for name, content in rows:
                if not name or name.startswith("/") or ".." in name.split("/"):
                    raise ValueError(f"not a name below the folder: {name!r}")
                system.create_dir(f"{folder}/{name}".rpartition("/")[0], recursive=True)
                with system.open_output_stream(f"{folder}/{name}") as out:
                    out.write(bytes(content))
                names.append(name)
                if not _there(system, f"{base}/{MARK}"):
                    raise RuntimeError("the job was given up")
        except BaseException:
            if _there(system, folder):
                system.delete_dir(folder)
            raise
        return Written(folder, names)

    def commit(self, messages: list[Written | None]) -> None:
        system, base = _opened(self.path)
        done = [(m.folder, n) for m in messages if m for n in m.names]
        if len({n for _, n in done}) < len(done):
            self.abort(messages)
            raise ValueError("two rows have the same file name")
        for folder in {f"{base}/{n}".rpartition("/")[0] for _, n in done}:
            system.create_dir(folder, recursive=True)
        with ThreadPoolExecutor(MOVERS) as pool:
            list(pool.map(lambda x: system.move(f"{x[0]}/{x[1]}", f"{base}/{x[1]}"), done))
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, base = _opened(self.staging)
        if _there(system, f"{base}/{MARK}"):
            system.delete_file(f"{base}/{MARK}")  # tasks that still write see it and take back what they wrote
        for pause in (0.0, 0.5, 1.0) if len([m for m in messages if m]) < len(messages) else (0.0,):
            time.sleep(pause)
            if _there(system, base):
                system.delete_dir(base)


class FileSink(DataSource):
    """``df.write.format("provena_files")`` of (name, content): one file per row below the option ``path``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


def write_files(df: DataFrame, path: str) -> None:
    """Write (name, content), content being text or bytes, as files below a path; files of that name are replaced.

    Names are relative, may have folders, and must differ. Nothing is left of a job that fails.
    """
    ship(df.sparkSession)
    df.sparkSession.dataSource.register(FileSink)
    df.select("name", F.col("content").cast("binary").alias("content")).write.format(FORMAT).mode("append").option("path", path).save()


def below(file: Column, root: str) -> Column:
    """A file's path from a root on; the whole path, without its scheme and first slash, if it is not below it."""
    plain = lambda c: F.regexp_replace(c, r"^\w+:/*(?=/)|^\w+:/+", "")
    start = plain(F.lit(root.rstrip("/") + "/"))
    full = plain(file)
    return F.ltrim(F.when(F.startswith(full, start), F.substr(full, F.length(start) + 1)).otherwise(full), F.lit("/"))
