"""A watched bundle: a streaming data source of file changes, and concepts, issues and edges kept up to date from it.

An offset is a numbered snapshot of the folder, kept beside it: for each file its path, when it was written and changed, and its size.
What lies between two offsets is the difference of two snapshots, dealt to tasks by path; they read and parse the changed files alone.
A file that changes while it is read is found by the next snapshot, and files that are gone are removals.

Each micro-batch appends what it learnt: a row for each change, the issues of changed concepts, some of which hold only while another
concept is missing, and their links. What holds now are the rows of each path's newest change, and joins of narrow tables tell which
issues and edges stand. No micro-batch reads or rewrites what others wrote.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quarrylake.functions import filled
from quarrylake.model import CONCEPTS
from quarrylake.operators import graph, validate
from quarrylake.sources.bundle import MAX_BYTES, is_concept_file, parse_files
from quarrylake.storage import ship

CHANGES = "path string, op string, content binary, parse_error string"
CHUNK = 64  # files a task


def snapshot(root: str) -> dict[str, list[int]]:
    """For each file of a bundle: when it was written and last changed in any way, in nanoseconds, and its size."""
    out = {}
    for folder, _, names in os.walk(root):
        for n in filter(is_concept_file, names):
            full = os.path.join(folder, n)
            try:
                s = os.stat(full)
            except FileNotFoundError:  # gone since it was listed
                continue
            out[os.path.relpath(full, root).replace(os.sep, "/")] = [s.st_mtime_ns, s.st_ctime_ns, s.st_size]
    return dict(sorted(out.items()))


class Snapshots:
    """Numbered snapshots in a folder; a file counts once it has its name."""

    def __init__(self, root: str):
        self.root = root

    def numbers(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in os.listdir(self.root) if n.endswith(".json")) if os.path.isdir(self.root) else []

    def load(self, number: int) -> dict[str, list[int]]:
        if not number:
            return {}
        with open(f"{self.root}/{number:012d}.json", encoding="utf-8") as f:
            return json.load(f)

    def save(self, number: int, files: dict[str, list[int]]) -> None:
        os.makedirs(self.root, exist_ok=True)
        path = f"{self.root}/{number:012d}.json"
        with open(f"{path}.part", "w", encoding="utf-8") as f:
            json.dump(files, f)
        os.replace(f"{path}.part", path)

    def forget(self, below: int) -> None:
        for n in self.numbers():
            if n < below:
                os.remove(f"{self.root}/{n:012d}.json")


class Changed(InputPartition):
    def __init__(self, files: list[tuple[str, str, int]]):
        self.files = files


class ChangeReader(DataSourceStreamReader):
    def __init__(self, root: str, state: str, max_bytes: int):
        self.root, self.snapshots, self.most = root, Snapshots(state), max_bytes

    def initialOffset(self) -> dict:
        return {"snapshot": 0, "digest": ""}

    def latestOffset(self) -> dict:
        known = self.snapshots.numbers()
        last, now = known[-1] if known else 0, snapshot(self.root)
        if self.snapshots.load(last) != now:
            last += 1
            self.snapshots.save(last, now)
        return {"snapshot": last, "digest": hashlib.sha256(json.dumps(now).encode()).hexdigest() if last else ""}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        before, after = self.snapshots.load(start["snapshot"]), self.snapshots.load(end["snapshot"])
        changes = [(p, "create" if p not in before else "write", s[2]) for p, s in after.items() if before.get(p) != s]
        changes += [(p, "remove", 0) for p in before if p not in after]
        return [Changed(changes[i : i + CHUNK]) for i in range(0, len(changes), CHUNK)]

    def read(self, partition: Changed) -> Iterator[tuple]:
        for path, op, size in partition.files:
            if op == "remove":
                yield path, op, None, None
            elif size > self.most:
                yield path, op, None, f"file size {size} exceeds the limit of {self.most} bytes"
            else:
                try:
                    with open(os.path.join(self.root, path), "rb") as f:
                        yield path, op, f.read(), None
                except FileNotFoundError:
                    yield path, "remove", None, None

    def commit(self, end: dict) -> None:
        self.snapshots.forget(end["snapshot"] - 1)


class BundleChanges(DataSource):
    """`spark.readStream.format("bundle_changes")` with options root, state (a folder of its own) and max_bytes; both folders are shared."""

    @classmethod
    def name(cls) -> str:
        return "bundle_changes"

    def schema(self) -> str:
        return CHANGES

    def streamReader(self, schema: StructType) -> ChangeReader:
        return ChangeReader(self.options["root"], self.options["state"], int(self.options.get("max_bytes", MAX_BYTES)))


def changes(spark: SparkSession, root: str, state: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The stream of a bundle's changes: path, op (create, write, remove), content or else parse_error."""
    ship(spark).dataSource.register(BundleChanges)
    return spark.readStream.format("bundle_changes").option("root", root).option("state", state).option("max_bytes", max_bytes).load()


class WatchedBundle:
    """What is known of a bundle, in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str, known: str):
        self.spark, self.root, self.known = spark, root, known.rstrip("/")

    def follow(self, once: bool = True, every: str = "10 seconds") -> StreamingQuery:
        """Takes what has changed. `once` ends then, else a micro-batch is made `every` so often."""
        writer = changes(self.spark, self.root, f"{self.known}/snapshots").writeStream.foreachBatch(self._take).option("checkpointLocation", f"{self.known}/checkpoint")
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()

    def _take(self, batch: DataFrame, number: int) -> None:
        """Appends a micro-batch; one that is made again replaces what it left."""
        at = F.lit(number).cast("bigint").alias("batch")

        def put(df: DataFrame, name: str) -> DataFrame:
            path = f"{self.known}/{name}/batch-{number:012d}"
            df.write.mode("overwrite").parquet(path)
            return self.spark.read.schema(df.schema).parquet(path)

        batch.persist()
        concepts = put(parse_files(batch.where("op != 'remove'")).select("*", at), "concepts")
        put(batch.select("path", "op", at), "changes")
        put(validate.raw_issues(concepts, validate.timeless_rules()).select("*", at), "issues")
        put(graph.internal_links(concepts).select("concept_id", "path", "pos", "target", "resolved", at), "links")
        batch.unpersist()

    def _log(self, name: str, schema: str) -> DataFrame:
        there = os.path.isdir(f"{self.known}/{name}")
        return self.spark.read.schema(schema + ", batch bigint").parquet(f"{self.known}/{name}/batch-*") if there else self.spark.createDataFrame([], schema + ", batch bigint")

    def _newest(self) -> DataFrame:
        """(path, batch) of each file that is there: its newest change."""
        seen = self._log("changes", "path string, op string").groupBy("path").agg(F.max("batch").alias("batch"), F.max_by("op", "batch").alias("op"))
        return seen.where("op != 'remove'").select("path", "batch")

    def _now(self, name: str, schema: str) -> DataFrame:
        log = self._log(name, schema)
        return log.join(self._newest(), ["path", "batch"], "left_semi").select(log.columns).drop("batch")

    def concepts(self) -> DataFrame:
        """The bundle's concepts as they are now."""
        return self._now("concepts", CONCEPTS)

    def _ids(self) -> DataFrame:
        return self._newest().select(F.regexp_replace("path", r"\.md$", "").alias("id"))

    def issues(self, as_of: Column) -> DataFrame:
        """As validate.lint of all concepts; only what is stale is judged anew, from one column."""
        raw = self._now("issues", "concept_id string, path string, severity string, message string, needs string")
        dated = self.concepts().where((filled("parse_error") == "") & F.col("stale_after").isNotNull())
        return validate.holding(raw, self._ids()).unionByName(validate.row_issues(dated, validate.freshness_rules(as_of)))

    def edges(self) -> DataFrame:
        """As graph.link_edges of all concepts, from the links of changed ones."""
        return graph.edges_of(self._now("links", "concept_id string, path string, pos int, target string, resolved string"), self._ids())

    def history(self) -> DataFrame:
        """(path, op, batch, turn): what happened to each file, turn by turn."""
        return self._log("changes", "path string, op string").withColumn("turn", F.row_number().over(Window.partitionBy("path").orderBy("batch")))
