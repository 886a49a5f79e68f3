"""Tables kept up to date from a stream of changes by keyed state: of each key the newest change holds, whenever it arrives.

The state of a key is its newest change so far, removals included, so an older change of a later micro-batch loses. What a micro-batch
writes are the keys that it changed, appended to a log; no batch reads or rewrites the table. The table is the newest row of each key in
the log, and compacting the log writes it anew when that suits.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from quarrylake.storage import ship

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def rank(order: Iterable) -> list[tuple]:
    """Orders compare as these; nulls come first."""
    return [(0,) if x is None else (1, x) for x in order]


class Newest(StatefulProcessor):
    """Keeps the newest change of a key and gives it out where a micro-batch replaced it."""

    def __init__(self, schema: StructType, order: list[str]):
        self.schema, self.order = schema, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("newest", self.schema)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        names = self.schema.fieldNames()
        at = [names.index(c) for c in self.order]
        known = self.held.get()
        best = None if known is None else tuple(known)
        before = best
        for row in rows:
            change = tuple(row[n] for n in names)
            if best is None or rank(change[i] for i in at) > rank(best[i] for i in at):
                best = change
        if best is not before:
            self.held.update(best)
            yield Row(**dict(zip(names, best, strict=True)))

    def close(self) -> None:
        pass


class ChangeLog:
    """The log of a keyed table in a folder: appended to by a stream, read as the newest row of each key."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType, key: str, order: list[str], op: str = "op"):
        self.spark, self.root, self.schema, self.key, self.order, self.op = spark, root.rstrip("/"), schema, key, order, op
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _bases(self) -> list[str]:
        """Compacted states, oldest first; one counts once its marker is there."""
        at = self._path(f"{self.root}/base")
        names = {f.getPath().getName() for f in self._fs.listStatus(at)} if self._fs.exists(at) else set()
        return sorted(n.removesuffix(".done") for n in names if n.endswith(".done") and n.removesuffix(".done") in names)

    def rows(self) -> DataFrame:
        """The newest compacted state and all that was appended; rows in both do no harm."""
        parts = [f"{self.root}/base/{n}" for n in self._bases()[-1:]]
        out = self.spark.read.schema(self.schema).parquet(*parts) if parts else self.spark.createDataFrame([], self.schema)
        log = f"{self.root}/log"
        return out.unionByName(self.spark.read.schema(self.schema).parquet(log)) if self._fs.exists(self._path(log)) else out

    def newest(self) -> DataFrame:
        """The newest change of each key, removals among them."""
        best = self.rows().groupBy(self.key).agg(F.max_by(F.struct("*"), F.struct(*self.order)).alias("row"))
        return best.select("row.*")

    def table(self) -> DataFrame:
        """The rows that are there now."""
        return self.newest().where(F.col(self.op) != "delete").drop(self.op)

    def compact(self) -> None:
        """Writes the newest changes as one state, which reading starts from; only the state before it is kept beside it. Files of the log
        stay, as a stream knows them; a new log is begun with a new stream."""
        known = self._bases()
        name = f"b{int(known[-1][1:13]) + 1 if known else 1:012d}-{uuid.uuid4().hex[:8]}"
        self.newest().write.parquet(f"{self.root}/base/{name}")
        self._fs.create(self._path(f"{self.root}/base/{name}.done"), False).close()
        for old in known[:-1]:
            self._fs.delete(self._path(f"{self.root}/base/{old}.done"), False)
            self._fs.delete(self._path(f"{self.root}/base/{old}"), True)

    def follow(self, stream: DataFrame, checkpoint: str, once: bool = True, every: str = "30 seconds") -> StreamingQuery:
        """Appends what stream, a stream of this schema, changes. Rows without a key take no part.

        Equal orders: the first that arrives holds. `once` ends with what is there now, else a micro-batch is made `every` so often.
        """
        ship(self.spark).conf.set(PROVIDER, ROCKS)
        changes = stream.select(self.schema.fieldNames()).where(F.col(self.key).isNotNull())
        kept = changes.groupBy(self.key).transformWithState(Newest(self.schema, self.order), self.schema, "Append", "None")
        writer = kept.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start(f"{self.root}/log")
