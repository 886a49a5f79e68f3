"""Operator 2, benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Items are put into partitions by shingle length (items of fewer than K words are one shingle) and by the size of their sets, powers
of two. A document is first reduced, for each shingle length, to the sequence of its shingles that may belong to any item, by a bitmap
of fixed size that misses none. For a partition of up to L shingles, windows of SPAN * L of that sequence start every L. As words that
no item has are not in the sequence, an item is found however long the document is and however far its words are scattered over it,
as long as no more than (SPAN - 2) * L shingles of other items stand between them; a passage in one piece lies whole in one window.
Each window gets one MinHash value a band; each partition's number of bands follows from the smallest Jaccard similarity that an
item of the needed containment can have with such a window. Items and windows meet on equal values; then the item's share of
shingles in the whole document is counted exactly.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylake.llm import _text
from quarrylake.llm._work import bitmap, hits, ship, stored

K = 5
CONTAINMENT = 0.8
MISS = 1e-6
SPAN = 4
GATE_BITS = 26
ITEMS = "item_id bigint, k int, n int, s array<bigint>"


def _level(n: int) -> int:
    return max(0, math.ceil(math.log2(n)))


def bands(level: int, containment: float = CONTAINMENT, miss: float = MISS) -> int:
    """How many bands of one value make a match in a partition collide but for a chance of `miss`."""
    top = 1 << level
    window, low = SPAN * top, (top // 2 + 1 if level else 1)
    least = min((need := math.ceil(containment * n - 1e-9)) / (window + n - need) for n in {low, top})
    return 1 if least >= 1 else max(1, math.ceil(math.log(miss) / math.log(1 - least)))


MOST_BANDS = 1024
_SEEDS = _text.mix(np.arange(1, MOST_BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def signature(s: np.ndarray, n_bands: int) -> np.ndarray:
    """The smallest hash of s in each band."""
    return _text.mix(s[None, :] ^ _SEEDS[:n_bands, None]).min(axis=1)


def keyed(values: np.ndarray, level: int) -> np.ndarray:
    """Values with partition and band mixed in, so that one column joins them."""
    return _text.mix(values + (np.arange(len(values), dtype=np.uint64) + np.uint64(level << 16)) * np.uint64(0xC2B2AE3D27D4EB4F))


def _lists(parts: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)), _text.longs(np.concatenate(parts) if parts else np.zeros(0, np.uint64)))


def item_sets(items: DataFrame, k: int) -> DataFrame:
    """item_id, the shingle length used (fewer than k words: all of them), n and the shingles; items without words are left out."""

    def run(batches):
        for batch in batches:
            for b in _text.blocks(batch):
                data, offs = _text.bytes_of(b.column(1))
                (h,), first = _text.words(data, offs, lower=True)
                sets, n = _text.shingle_sets(h, first, k), np.diff(first)
                at = np.flatnonzero(n)
                keep = [sets[i] for i in at]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(np.minimum(n[at], k).astype(np.int32)), pa.array([len(x) for x in keep], pa.int32()), _lists(keep)], names=["item_id", "k", "n", "s"])

    return items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, ITEMS)


def contaminated(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, miss: float = MISS, k: int = K) -> DataFrame:
    """doc_id, item_id, n_item (shingles), n_shared, containment for each pair where a document holds >= containment of an item.

    Words are lower-cased (A-Z) runs of other than white space. An item of fewer than k words is looked for as one run of words;
    items and texts that are null or blank match nothing. Repeated rows: one row for each doc_id and item_id, of the best match.
    Rows without doc_id or item_id take no part. Empty tables: no rows. Other columns are not read.
    """
    spark = ship(docs.sparkSession)
    sets = stored(item_sets(items, k).where("item_id is not null"), "decontaminate-items")
    shape = sets.groupBy("k", "n").agg(F.count("*")).select("k", F.expr("cast(greatest(0, ceil(log2(n))) as int)").alias("level")).distinct().toArrow()  # a row for each partition
    partitions = sorted(zip(shape.column("k").to_pylist(), shape.column("level").to_pylist(), strict=True))
    lengths, n_bands = sorted({x for x, _ in partitions}), {lv: bands(lv, containment, miss) for _, lv in partitions}
    if max(n_bands.values(), default=0) > MOST_BANDS:
        raise ValueError(f"a containment of {containment} and a miss of {miss} need more than {MOST_BANDS} bands")
    gate = spark.sparkContext.broadcast(bitmap(sets.select(F.explode("s").alias("h")), "h", GATE_BITS))

    def item_bands(batches):
        for b in batches:
            ids, keys = [], []
            lists = b.column(1)
            for i, s in zip(b.column(0).to_pylist(), lists, strict=True):
                v = s.values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                lv = _level(len(v))
                q = keyed(signature(v, n_bands[lv]), lv)
                keys.append(q)
                ids += [i] * len(q)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), _text.longs(np.concatenate(keys) if keys else np.zeros(0, np.uint64))], names=["item_id", "key"])

    wanted = stored(sets.select("item_id", "s").mapInArrow(item_bands, "item_id bigint, key bigint").distinct(), "decontaminate-bands")
    asked = spark.sparkContext.broadcast(bitmap(wanted, "key", GATE_BITS))

    def scan(batches):
        for batch in batches:
            for b in _text.blocks(batch):
                data, offs = _text.bytes_of(b.column(1))
                (h,), first = _text.words(data, offs, lower=True)
                ids, held, keys = [], [], []
                found: dict[int, list[tuple[int, np.ndarray]]] = {}
                for n in lengths:
                    g = _text.grams(h, n)
                    at = np.flatnonzero(hits(gate.value, GATE_BITS, g))
                    doc = np.searchsorted(first, at, side="right") - 1
                    inside = at + n <= first[doc + 1]
                    at, doc = at[inside], doc[inside]
                    cuts = np.flatnonzero(np.diff(doc)) + 1
                    for s, d in zip(np.split(g[at], cuts), np.split(doc, cuts), strict=True):
                        if len(s):
                            found.setdefault(int(d[0]), []).append((n, s))
                for d, parts in found.items():
                    made = [keyed(signature(s[a : a + (SPAN << lv)], n_bands[lv]), lv) for n, s in parts for k_, lv in partitions if k_ == n for a in range(0, max(1, len(s) - (SPAN - 1 << lv)), 1 << lv)]
                    got = np.unique(np.concatenate(made))
                    got = got[hits(asked.value, GATE_BITS, got)]
                    if len(got):
                        ids.append(d)
                        held.append(np.unique(np.concatenate([s for _, s in parts])))
                        keys.append(got)
                if ids:
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids)), _lists(held), _lists(keys)], names=["doc_id", "have", "keys"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null").mapInArrow(scan, "doc_id bigint, have array<bigint>, keys array<bigint>")
    found = stored(found.withColumn("row", F.monotonically_increasing_id()), "decontaminate-found")
    pairs = found.select("row", F.explode("keys").alias("key")).join(wanted, "key").select("row", "item_id").distinct()
    both = pairs.join(found.select("row", "doc_id", "have"), "row").join(sets.select("item_id", "n", "s"), "item_id")
    both = both.select("doc_id", "item_id", F.col("n").cast("long").alias("n_item"), F.size(F.array_intersect("have", "s")).cast("long").alias("n_shared"))
    both = both.where(F.col("n_shared") >= F.lit(containment) * F.col("n_item") - 1e-9)
    best = both.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("n_item", "n_shared"), F.col("n_shared") / F.col("n_item")).alias("m"))
    return best.select("doc_id", "item_id", "m.n_item", "m.n_shared", (F.col("m.n_shared") / F.col("m.n_item")).alias("containment"))
