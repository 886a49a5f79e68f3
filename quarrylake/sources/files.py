"""A sink of named files: rows of path and content become a folder of files, all of them or none.

Tasks write into a new version of the folder beside it and report how many files they wrote. The commit swaps a link, so readers see the
version before or the whole new one; a failing task makes the job remove what it began. A task that is tried again writes the same
files anew. The version before stays for readers that have begun.
"""

from __future__ import annotations

import contextlib
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from quarrylake.storage import ship


@dataclass
class Written(WriterCommitMessage):
    files: int
    size: int


def is_inside(path: str) -> bool:
    """Whether a relative path stays in its folder and names a file."""
    parts = path.split("/")
    return bool(parts[-1]) and not path.startswith("/") and not {"..", "."} & set(parts) and "" not in parts and "\0" not in path


class TreeWriter(DataSourceArrowWriter):
    def __init__(self, root: str, overwrite: bool):
        self.root = os.path.abspath(root.removeprefix("file://"))
        if os.path.lexists(self.root) and not os.path.islink(self.root):
            raise ValueError(f"{root} is there and was not written by this sink")
        if os.path.lexists(self.root) and not overwrite:
            raise ValueError(f"{root} is there already")
        self.versions = os.path.join(os.path.dirname(self.root), f".{os.path.basename(self.root)}.versions")
        self.name = uuid.uuid4().hex
        self.target = os.path.join(self.versions, self.name)
        os.makedirs(self.target)  # here alone: a task that still runs when the job was given up finds no folder to write to

    def _folder(self, path: str) -> None:
        """The folders of a path below the version's own."""
        at = self.target
        for part in path.split("/")[:-1]:
            at = os.path.join(at, part)
            if not os.path.isdir(at):
                with contextlib.suppress(FileExistsError):
                    os.mkdir(at)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files = size = 0
        own = uuid.uuid4().hex[:8]
        for b in iterator:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if path is None or content is None or not is_inside(path):
                    raise ValueError(f"path leaves the folder, or there is none, or no content: {path}")
                full = os.path.join(self.target, path)
                self._folder(path)
                data = content.encode()
                with open(f"{full}.{own}.part", "wb") as f:
                    f.write(data)
                os.replace(f"{full}.{own}.part", full)
                files, size = files + 1, size + len(data)
        return Written(files, size)

    def commit(self, messages: list[Written | None]) -> None:
        before = os.readlink(self.root) if os.path.islink(self.root) else ""
        link = f"{self.target}.link"
        os.symlink(self.target, link)
        os.replace(link, self.root)
        for name in os.listdir(self.versions):
            old = os.path.join(self.versions, name)
            if old not in (self.target, before):
                shutil.rmtree(old, ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        gone = f"{self.target}.gone"
        os.rename(self.target, gone)
        while os.path.isdir(gone):  # files of tasks that write at this moment may come up meanwhile
            shutil.rmtree(gone, ignore_errors=True)


class FileTree(DataSource):
    """`df.write.format("file_tree")` of path and content, with option path: a folder that driver and executors share."""

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return "path string, content string"

    def writer(self, schema: StructType, overwrite: bool) -> TreeWriter:
        return TreeWriter(self.options["path"], overwrite)


def write_tree(files: DataFrame, root: str, overwrite: bool = False) -> None:
    """Write files(path, content) as a folder: an error leaves the folder as it was, or absent.

    Errors are paths that leave the folder, paths given twice, rows without path or content, and a folder that is there without `overwrite`.
    """
    twice = files.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"path given twice: {twice[0]['path']}")
    ship(files.sparkSession).dataSource.register(FileTree)
    files.select("path", "content").write.format("file_tree").mode("overwrite" if overwrite else "append").save(root)
