"""Hash-based two-way synchronisation, in batch and as a stream.

State is a table: sync_state(concept_id, connector, external_id, content_hash, last_pushed) and pull_state(concept_id, hash). Deltas
are joins against it; hashes are committed only after a sink has taken its rows, so delivery is at least once and sinks are
idempotent by id.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarrylake.functions import concept_hash, filled
from quarrylake.model import metadata_json
from quarrylake.storage import checkpointed, shuffled

STATE = "concept_id string, connector string, external_id string, content_hash string, last_pushed timestamp"
PULL_STATE = "concept_id string, hash string"


class Connector(Protocol):
    """A system to synchronise with; an inactive one takes no part, so nothing is marked as pushed to it."""

    name: str
    active: bool

    def push(self, concepts: DataFrame) -> None: ...

    def pull(self, spark: SparkSession) -> DataFrame: ...


def hashed(concepts: DataFrame) -> DataFrame:
    """Concepts that parsed, with content_hash, computed once for all connectors."""
    return concepts.where(filled("parse_error") == "").withColumn("content_hash", concept_hash(metadata_json(), "body"))


def external_id(connector: Column | str, ident: Column | str, known: Column | None = None) -> Column:
    """The id in the other system: the known one, else <connector>-<id>."""
    minted = F.concat_ws("-", connector, ident)
    return minted if known is None else F.coalesce(F.nullif(known, F.lit("")), minted)


def push_delta(local: DataFrame, connectors: DataFrame, state: DataFrame) -> DataFrame:
    """(connector, id, content_hash, external_id) of local(id, content_hash) that connectors(connector) don't have in this form.

    Connectors are a handful of names, so each row is repeated for each of them.
    """
    s = state.select(F.col("concept_id").alias("id"), "connector", F.col("content_hash").alias("_known"), F.col("external_id").alias("_ext"))
    each = local.select("id", "content_hash").crossJoin(F.broadcast(connectors.select("connector")))
    return each.join(shuffled(s), ["id", "connector"], "left").where(~F.col("_known").eqNullSafe(F.col("content_hash"))).select("connector", "id", "content_hash", external_id("connector", "id", F.col("_ext")).alias("external_id"))


def pull_delta(pulled: DataFrame, pull_state: DataFrame) -> DataFrame:
    """Rows of pulled(id, content_hash, ...) that are new or changed since the last pull."""
    s = pull_state.select(F.col("concept_id").alias("id"), F.col("hash").alias("_known"))
    return pulled.join(shuffled(s), "id", "left").where(~F.col("_known").eqNullSafe(F.col("content_hash"))).drop("_known")


def committed(state: DataFrame, pushed: DataFrame, at: Column) -> DataFrame:
    """State after pushed(connector, id, content_hash, external_id) has been taken."""
    new = pushed.select(F.col("id").alias("concept_id"), "connector", "external_id", "content_hash", at.cast("timestamp").alias("last_pushed"))
    return state.join(shuffled(new.select("concept_id", "connector")), ["concept_id", "connector"], "left_anti").select(new.columns).unionByName(new)


class StateTable:
    """Versions of a state table in a folder. A version counts once its marker is there, which is made after its files; the newest
    marked one is the table, so a crash at any moment leaves the table as it was. Each save keeps the version before, for readers
    that have begun, and removes older ones. One writer at a time."""

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[str]:
        """Names of the complete versions, oldest first."""
        root = self._path(self.root)
        names = {f.getPath().getName() for f in self._fs.listStatus(root)} if self._fs.exists(root) else set()
        return sorted(n.removesuffix(".done") for n in names if n.endswith(".done") and n.removesuffix(".done") in names)

    def load(self) -> DataFrame:
        known = self.versions()
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/{known[-1]}") if known else self.spark.createDataFrame([], self.schema)

    def save(self, df: DataFrame) -> None:
        known = self.versions()
        name = f"v{int(known[-1][1:13]) + 1 if known else 1:012d}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(f"{self.root}/{name}")
        self._fs.create(self._path(f"{self.root}/{name}.done"), False).close()
        for old in known[:-1]:
            self._fs.delete(self._path(f"{self.root}/{old}.done"), False)
            self._fs.delete(self._path(f"{self.root}/{old}"), True)


def sync_once(concepts: DataFrame, connectors: list[Connector], states: StateTable, pulls: StateTable, write: Callable[[DataFrame], None], at: Column) -> dict[str, tuple[int, int]]:
    """Push to all active connectors, then pull from all; gives (pushed, pulled) by connector. A pulled row's hash is that before writing."""
    spark, local, out = concepts.sparkSession, hashed(concepts), {}
    for c in (c for c in connectors if c.active):
        delta = checkpointed(push_delta(local, spark.createDataFrame([(c.name,)], "connector string"), states.load()))
        n = delta.count()
        if n:  # what is pushed and what is committed are the same rows, even if the source moves on meanwhile
            c.push(local.join(shuffled(delta.select("id", "content_hash", "external_id")), ["id", "content_hash"]))
            states.save(committed(states.load(), delta, at))
        out[c.name] = (n, 0)
    for c in (c for c in connectors if c.active):
        delta = checkpointed(pull_delta(hashed(c.pull(spark)), pulls.load()))
        n = delta.count()
        if n:
            known = pulls.load()
            new = delta.select(F.col("id").alias("concept_id"), F.col("content_hash").alias("hash"))
            keep = known.join(shuffled(new.select("concept_id")), "concept_id", "left_anti").select("concept_id", "hash").unionByName(new)
            write(delta.drop("content_hash"))
            pulls.save(keep)
        out[c.name] = (out[c.name][0], n)
    return out


def latest(changes: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The last row of each key."""
    return changes.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_rn = 1").drop("_rn")


def upsert(current: DataFrame, changes: DataFrame, key: str = "id", op: str = "op") -> DataFrame:
    """current after changes, of which those with op = 'delete' remove their key."""
    kept = current.join(shuffled(changes.select(key)), key, "left_anti")
    return kept.unionByName(changes.where(F.col(op) != "delete").select(current.columns))


def stream_upsert(stream: DataFrame, table: StateTable, key: str, order: list[Column], checkpoint: str, once: bool = True, every: str = "30 seconds") -> StreamingQuery:
    """Keep a state table up to date from a stream of changes(…, op): each micro-batch is reduced to the last row of a key and merged."""

    def merge(batch: DataFrame, _: int) -> None:
        table.save(upsert(table.load(), latest(batch, key, order), key))

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def snapshot_changes(before: DataFrame, after: DataFrame, key: str = "path", stamp: str = "modified") -> DataFrame:
    """(key, op) between two listings: create, write or remove; how in-place edits and deletions are seen."""
    b, a = before.select(key, F.col(stamp).alias("_b")), after.select(key, F.col(stamp).alias("_a"))
    both = b.join(a, key, "full_outer").where(~F.col("_b").eqNullSafe(F.col("_a")))
    return both.select(key, F.when(F.col("_b").isNull(), F.lit("create")).when(F.col("_a").isNull(), F.lit("remove")).otherwise(F.lit("write")).alias("op"))
