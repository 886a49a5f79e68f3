"""Bundles as a data source: `spark.read.format("bundle").load(root)`.

The driver lists folders level by level only until there are enough of them to deal out; tasks walk what lies below, and read and parse
the files. The option `under` names prefixes of paths: folders that can't hold a match are not entered, and files that don't match are
not opened. A schema of some of the columns, given to the reader, prunes what is done: for path and id no file is opened, and without
body, citations and parse_error only front matter is read.

Prefixes are an option and not filters that Spark pushes down: Spark keeps what a Python source took over with the table, so a second
query of the same DataFrame would see the rows of the first one's filter.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quarrylake.model import CONCEPTS, fields
from quarrylake.sources.bundle import MAX_BYTES, is_concept_file, parse_concept, too_large
from quarrylake.storage import ship

ENOUGH = 256  # folders to deal out
FILES = 64  # parsed at once
SHARE, SHARES = 2_000, 64  # files of one folder in a task, about; tasks of one folder, each of which lists it, at most


class Folder(InputPartition):
    """A folder below the root, '' for the root: with all below it, or the files in it alone, or one of `of` shares of these by name."""

    def __init__(self, path: str, deep: bool, share: int = 0, of: int = 1):
        self.path, self.deep, self.share, self.of = path, deep, share, of

    def holds(self, path: str) -> bool:
        return self.of == 1 or zlib.crc32(path.encode(errors="surrogateescape")) % self.of == self.share


class BundleReader(DataSourceReader):
    def __init__(self, root: str, most: int, under: Sequence[str], schema: StructType):
        self.root, self.most, self.under, self.schema = root, most, tuple(under), schema

    def _file(self, path: str) -> bool:
        return not self.under or path.startswith(self.under)

    def _folder(self, path: str) -> bool:
        """Whether a folder, with its closing slash, may hold a match."""
        return self._file(path) or any(p.startswith(path) for p in self.under)

    def _below(self, folder: str) -> tuple[list[str], list[str]]:
        """(names of concept files, folders with a closing slash) in a folder; links to folders are not followed."""
        files, folders = [], []
        with os.scandir(os.path.join(self.root, folder)) as entries:
            for e in entries:
                if e.is_dir(follow_symlinks=False):
                    if self._folder(f"{folder}{e.name}/"):
                        folders.append(f"{folder}{e.name}/")
                elif is_concept_file(e.name) and e.is_file() and self._file(folder + e.name):
                    files.append(folder + e.name)
        return sorted(files), sorted(folders)

    def partitions(self) -> Sequence[InputPartition]:
        if not os.path.isdir(self.root):
            raise FileNotFoundError(self.root)
        shallow, level = [], [""]
        while level and len(level) < ENOUGH and len({f.path for f in shallow}) < ENOUGH:
            below = []
            for folder in level:
                files, folders = self._below(folder)
                of = max(1, min(SHARES, -(-len(files) // SHARE)))
                shallow += [Folder(folder, False, i, of) for i in range(of)]
                below += folders
            level = below
        return [*shallow, *(Folder(f, True) for f in level)]

    def _paths(self, part: Folder) -> Iterator[str]:
        left = [part.path]
        while left:
            files, folders = self._below(left.pop())
            yield from filter(part.holds, files)
            if part.deep:
                left += folders[::-1]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        arrow, held = to_arrow_schema(self.schema), []
        names = set(self.schema.fieldNames())
        whole, named = bool(names & {"body", "citations", "parse_error"}), names <= {"id", "path"}
        for path in self._paths(partition):
            held.append(self._concept(path, whole, named))
            if len(held) >= FILES:
                yield batch(held, arrow)
                held = []
        if held:
            yield batch(held, arrow)

    def _concept(self, path: str, whole: bool, named: bool) -> dict:
        bare = dict.fromkeys(fields()) | {"id": path.removesuffix(".md"), "path": path}
        if named:
            return bare
        full = os.path.join(self.root, path)
        size = os.path.getsize(full)
        if size > self.most:
            return bare | {"parse_error": too_large(size, self.most)}
        with open(full, "rb") as f:
            content = f.read() if whole else front_lines(f)
        try:
            return parse_concept(path, content.decode("utf-8"))
        except UnicodeDecodeError as e:
            return bare | {"parse_error": f"not UTF-8: {e.reason}"}


def front_lines(lines: Iterable[bytes]) -> bytes:
    """The lines of a file up to the end of its front matter; nothing if it has none."""
    out = []
    for i, line in enumerate(lines):
        mark = line.strip() == b"---"
        if not i and not mark:
            return b""
        out.append(line)
        if i and mark:
            break
    return b"".join(out)


def batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    for r in rows:
        if r["extra"] is not None:
            r["extra"] = list(r["extra"].items())
    return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in schema], schema=schema)


class Bundle(DataSource):
    """Options: path, a folder that driver and executors share, max_bytes, and under, a JSON list of prefixes of paths."""

    @classmethod
    def name(cls) -> str:
        return "bundle"

    def schema(self) -> str:
        return CONCEPTS

    def reader(self, schema: StructType) -> BundleReader:
        most = int(self.options.get("max_bytes", MAX_BYTES))
        return BundleReader(self.options["path"], most if most > 0 else MAX_BYTES, json.loads(self.options.get("under", "[]")), schema)


def read_bundle(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES, columns: Sequence[str] = (), under: Sequence[str] = ()) -> DataFrame:
    """Concepts of the bundle in a shared folder, or some columns of them, of all paths or those that start with one of `under`. Files
    larger than max_bytes (10 MiB if not above 0) are rows with parse_error and are not read; without body, citations and parse_error,
    what follows front matter isn't looked at."""
    ship(spark).dataSource.register(Bundle)
    reader = spark.read.format("bundle").option("max_bytes", max_bytes).option("under", json.dumps(list(under)))
    if columns:
        reader = reader.schema(", ".join(f"{c} {fields()[c]}" for c in columns))
    return reader.load(root)


def read_repository(spark: SparkSession, clone: str, path: str = "concepts") -> DataFrame:
    """Concepts below a folder of a cloned repository that parsed, with ids from that folder on; none if the folder isn't there."""
    root = os.path.join(clone, path or "concepts")
    if not os.path.isdir(root):
        return spark.createDataFrame([], CONCEPTS)
    return read_bundle(spark, root).where("coalesce(parse_error, '') = ''")
