"""Shared folders, intermediate tables and Python workers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from quarrylake.storage import shared_dir, spread

__all__ = ["MADE", "tidy", "bitmap", "hits", "in_one_task", "sent", "shared_dir", "ship", "spread", "stored", "without"]
ROOT = str(Path(__file__).resolve().parents[2])


BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
ROWS, BYTES = 2000, 8 << 20  # of whole texts in an Arrow batch


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package where they see the driver's folder; on a cluster where they don't, it has to be given to
    them (--py-files). Arrow batches get about ROWS rows and BYTES bytes at most, as these are whole texts, unless the session sets numbers
    of its own. Workers take Arrow's memory from the C library, as numpy does, so that one reuses what the other has left."""
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, ROWS)
    if spark.conf.get(BATCH_BYTES) == f"{64 << 20}b":
        spark.conf.set(BATCH_BYTES, f"{BYTES}b")
    env = spark.sparkContext.environment
    env.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH", ""), ROOT) if x)
    return spark


MADE: list[str] = []  # folders written by `stored` in this process, oldest first


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it again: later steps start from files that outlive executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quarrylake/{name}-{uuid.uuid4().hex}"
    MADE.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Delete the folders that `stored` has written since MADE had `since` entries, but for those to keep; only for results that are
    written elsewhere by now, as what was stored is read until then."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    for p in MADE[since:]:
        if p not in keep:
            path(p).getFileSystem(spark._jsc.hadoopConfiguration()).delete(path(p), True)
    MADE[since:] = [p for p in MADE[since:] if p in keep]


def sent(df: DataFrame, most: int = 8 << 20) -> DataFrame:
    """A stored table with a broadcast hint if its rows, summed up first, take less than `most` bytes as text; else as it is."""
    size = df.agg(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(df) if size < most else df


HELD = 128 << 20  # bytes of rows that a task holds in memory


def in_one_task(df: DataFrame, body: Callable[[pa.Table], pa.RecordBatch], schema: str, held: int = HELD) -> DataFrame:
    """body(all rows of df), in one executor task; for stored tables of a bounded size. No rows: an empty table.

    Beyond `held` bytes the rows are mapped from a file of the task's own, gone when it ends, and take no memory of the worker."""
    ship(df.sparkSession)
    kinds = to_arrow_schema(df.schema)

    def run(batches):
        parts, size, writer = [], 0, None
        with tempfile.NamedTemporaryFile(prefix="quarrylake-") as f:
            for b in batches:
                if size < held:
                    parts.append(b)
                    size += b.nbytes
                    continue
                writer = writer or pa.ipc.new_file(f, b.schema)
                writer.write_batch(b)
            if writer:
                writer.close()
                f.flush()
                parts += pa.ipc.open_file(pa.memory_map(f.name)).read_all().to_batches()
            t = pa.Table.from_batches(parts) if parts else kinds.empty_table()
            yield body(t)
        parts, t = [], None
        pa.default_memory_pool().release_unused()  # else the idle worker keeps it

    return df.coalesce(1).mapInArrow(run, schema)


def bitmap(df: DataFrame, column: str, log2_bits: int) -> np.ndarray:
    """Bits set at the top log2_bits bits of a long hash column, as uint64 words.

    At most 2**log2_bits / 64 partly aggregated rows reach the driver, however many rows df has, so the size bound is fixed.
    """
    at = F.shiftrightunsigned(F.col(column), 64 - log2_bits)
    words = (
        df.where(F.col(column).isNotNull()).select(F.shiftright(at, 6).alias("w"), F.expr("1L").alias("one"), at.alias("p"))
        .select("w", F.expr("shiftleft(one, cast(p & 63 as int))").alias("b"))
        .groupBy("w").agg(F.bit_or("b").alias("b"))
    )
    t = words.toArrow()
    out = np.zeros(1 << max(0, log2_bits - 6), dtype=np.uint64)
    if t.num_rows:
        out[t.column("w").to_numpy()] = t.column("b").to_numpy().astype(np.int64).view(np.uint64)
    return out


def hits(bits: np.ndarray, log2_bits: int, hashes: np.ndarray) -> np.ndarray:
    """Which uint64 hashes fall on a set bit of `bitmap`."""
    at = hashes >> np.uint64(64 - log2_bits)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0


def without(df: DataFrame, key: str, ids: DataFrame, bits: int = 24) -> DataFrame:
    """Rows of df whose key is not in ids: a bitmap of fixed size clears most rows in place, only the others go to an anti join.

    Rows with a null key stay. df may have any column names.
    """
    spark = ship(df.sparkSession)
    ids = ids.select(F.col(key).alias("gone")).where("gone is not null").distinct()
    known = spark.sparkContext.broadcast(bitmap(ids.select(F.xxhash64("gone").alias("h")), "h", bits))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(key).alias("own"), F.xxhash64(key).alias("h"))
    schema = rows.schema

    def part(inside: bool):
        def run(batches):
            for b in batches:
                at = np.flatnonzero(hits(known.value, bits, b.column(2).to_numpy().view(np.uint64)) == inside)
                yield b.take(pa.array(at))

        return rows.mapInArrow(run, schema)

    out = part(False).unionByName(part(True).join(ids, F.col("own").eqNullSafe(F.col("gone")), "left_anti"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in df.columns])
