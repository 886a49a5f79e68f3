"""Operator 13, suffix-array dedup of bytes: suffixes are sorted in two stages, and neighbours that share 400 bytes are repeats.

A suffix array of everything would be one sort, so strings that may be equal are brought together first. The anchor of a 400-byte
window is the smallest hash among its 32-byte grams, the leftmost of equal ones; equal windows have equal anchors. Neighbouring windows
share their anchor, and the bytes of such a stretch are a context. A sketch counts anchors, and contexts whose anchor can't be there
twice are left out, which loses nothing. Equal contexts stand for each other: of each the first two places at most are sorted.

Contexts are dealt by anchor, so all windows that may be equal are in one task, which sorts their suffixes block by block:
suffixes smaller than their successors are sorted directly, by their first 400 bytes, all others are induced by scans of the buckets of
first bytes, since a suffix larger than its successor follows from the place of that. Common prefixes of neighbours then tell the
windows that occur twice.

An anchor with more than HOT different contexts would be an unbounded block. Its windows are counted by 128-bit digests instead, in
partial sums, which is exact too and needs more rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylake.llm import _sketch, _text
from quarrylake.llm._work import bitmap, hits, sent, ship, stored

LENGTH = 400
GRAM = 32
HOT = 2048
BLOCK = 1 << 19  # suffixes sorted at once, or those of one anchor
SLICE = 1 << 23  # bytes of a long text looked at at once
ROWS = 1 << 14
DOC_BITS = 24
_U = np.uint64


def byte_grams(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of each `gram` consecutive bytes; gram is 8, 16, 32, ..."""
    g, width = _text.lanes(data)[: max(0, len(data) - 7)], 8
    while width < gram:
        g = _text.join(g[:-width], g[width:])
        width *= 2
    return _text.mix(g)


def sliding_min(g: np.ndarray, w: int) -> np.ndarray:
    """The smallest of each w consecutive values, by running minima from both ends of blocks of w."""
    n = -(-len(g) // w)
    x = np.full(n * w, np.iinfo(np.uint64).max, _U)
    x[: len(g)] = g
    x = x.reshape(n, w)
    left = np.minimum.accumulate(x, axis=1).ravel()
    right = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: len(g) - w + 1], left[w - 1 : len(g)])


def stretches(data: np.ndarray, offs: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, number of windows) of each stretch of windows inside one document."""
    none = np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(data) < length:
        return none
    w = length - gram + 1
    g = byte_grams(data, gram)
    m = sliding_min(g, w)
    inside = np.zeros(len(data) + 1, np.int64)
    own = np.flatnonzero(np.diff(offs) >= length)
    inside[offs[own]] += 1
    inside[offs[own + 1] - length + 1] -= 1
    ok = np.cumsum(inside)[: len(m)] > 0
    change = m[1:] != m[:-1]
    begin, end = ok.copy(), ok.copy()
    begin[1:] &= change | ~ok[:-1]
    end[:-1] &= change | ~ok[1:]
    begin, end = np.flatnonzero(begin), np.flatnonzero(end)
    if not len(begin):
        return none
    rows = np.lib.stride_tricks.sliding_window_view(g, w)
    place = np.concatenate([begin[i : i + ROWS] + rows[begin[i : i + ROWS]].argmin(axis=1) for i in range(0, len(begin), ROWS)])
    tied = place < end  # the anchor is there again further on
    firsts, counts, values = [begin[~tied]], [(end - begin + 1)[~tied]], [m[begin[~tied]]]
    for a, b in zip(begin[tied].tolist(), end[tied].tolist(), strict=True):
        at = np.flatnonzero(g[a : b + w] == m[a]) + a
        ends = np.minimum(at[: np.searchsorted(at, b) + 1], b)
        starts = np.append(a, ends[:-1] + 1)
        firsts.append(starts)
        counts.append(ends - starts + 1)
        values.append(np.full(len(starts), m[a]))
    return np.concatenate(values), np.concatenate(firsts), np.concatenate(counts)


def _digest(x) -> bytes:
    return hashlib.blake2b(x, digest_size=16).digest()


def _two(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)


class Block:
    """Texts of a batch, with ids and digests, and their stretches."""

    def __init__(self, b: pa.RecordBatch, length: int, gram: int):
        self.data, self.offs = _text.bytes_of(b.column(1))
        self.bytes = self.data.tobytes()
        self.ids = b.column(0).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        view = memoryview(self.bytes)
        self.cls = _two([_digest(view[x:y]) for x, y in zip(self.offs[:-1].tolist(), self.offs[1:].tolist(), strict=True)])
        parts = [[], [], []]
        step = len(self.data) if len(self.data) <= SLICE or len(self.offs) > 2 else SLICE
        for lo in range(0, len(self.data), max(1, step)):
            part = self.data[lo : lo + step + length - 1]
            for out, x in zip(parts, stretches(part, self.offs if step == len(self.data) else np.array([0, len(part)]), length, gram), strict=True):
                out.append(x)
            parts[1][-1] = parts[1][-1] + lo
        self.anchor, self.at, self.n = (np.concatenate(p) if p else np.zeros(0, t) for p, t in zip(parts, (_U, np.int64, np.int64), strict=True))

    def keep(self, mask: np.ndarray) -> None:
        self.anchor, self.at, self.n = self.anchor[mask], self.at[mask], self.n[mask]

    def places(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, start in it, identity of the place) of each stretch."""
        doc = np.searchsorted(self.offs, self.at, side="right") - 1
        start = self.at - self.offs[doc]
        row = _text.mix(self.cls[:, 0].view(_U) ^ _text.mix(self.ids.view(_U)))
        return doc, start, _text.mix(row[doc] + start.astype(_U))

    def contexts(self, length: int) -> list[bytes]:
        return [self.bytes[a : a + n + length - 1] for a, n in zip(self.at.tolist(), self.n.tolist(), strict=True)]


def _blocks(batches, length: int, gram: int) -> Iterator[tuple[pa.RecordBatch, Block]]:
    for batch in batches:
        for b in _text.blocks(batch):
            yield b, Block(b, length, gram)


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than their successors; 0 ends a string, and equal bytes go as those behind them."""
    step = np.append(text[1:].astype(np.int16) - text[:-1].astype(np.int16), -1)
    told = np.where(step != 0, np.arange(len(text)), len(text) - 1)
    told = np.minimum.accumulate(told[::-1])[::-1]
    return step[told] > 0


def two_stage_order(text: np.ndarray, begin: np.ndarray, n: np.ndarray, end: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes begin[i] .. begin[i] + n[i] - 1 of the strings that end in a 0 at end[i], in the order of their first `depth` bytes
    or more. text has `depth` zeros behind it."""
    small = smaller_than_next(text)
    stops = np.where(small | (text == 0), np.arange(len(text)), len(text) - 1)
    stops = np.minimum.accumulate(stops[::-1])[::-1]
    last = np.minimum(stops[begin + n], end)  # what follows a string's suffixes up to one that is sorted directly
    need = np.zeros(len(text) + 1, np.int64)
    np.add.at(need, begin, 1)
    np.add.at(need, last + 1, -1)
    need = np.cumsum(need)[:-1] > 0
    induced = need & ~small & (text > 0)
    seeds = np.flatnonzero(need & ~induced)
    rows = np.lib.stride_tricks.sliding_window_view(text, depth)[seeds]
    left = end[np.searchsorted(end, seeds)] - seeds
    for i in np.flatnonzero(left < depth).tolist():
        rows[i, left[i] :] = 0
    seeds = seeds[pc.array_sort_indices(pa.Array.from_buffers(pa.binary(depth), len(seeds), [None, pa.py_buffer(rows)])).to_numpy()]
    first = text[seeds]
    edges = np.searchsorted(first, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out: list[np.ndarray] = []

    def scan(found: np.ndarray) -> None:
        """Puts the predecessors of found suffixes into their buckets, in order."""
        out.append(found)
        before = found[found > 0] - 1
        before = before[induced[before]]
        if not len(before):
            return
        byte = text[before]
        by = np.argsort(byte, kind="stable")
        before, byte = before[by], byte[by]
        cuts = np.flatnonzero(np.append(True, byte[1:] != byte[:-1])).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(byte)], strict=True):
            waiting[int(byte[a])].append(before[a:b])

    for c in range(256):
        while waiting[c]:  # larger than their successors: before the others of the bucket; runs of a byte come back here
            scan(waiting[c].pop(0))
        if edges[c] < edges[c + 1]:
            scan(seeds[edges[c] : edges[c + 1]])
    order = np.concatenate(out) if out else seeds
    wanted = np.zeros(len(text), bool)
    for a, k in zip(begin.tolist(), n.tolist(), strict=True):
        wanted[a : a + k] = True
    return order[wanted[order]]


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """The common prefix of each suffix with the one before it, `depth` at most; all have that many bytes."""
    rows, out = np.lib.stride_tricks.sliding_window_view(text, depth), [np.zeros(min(1, len(order)), np.int64)]
    for i in range(1, len(order), ROWS):
        a, b = order[i - 1 : i - 1 + ROWS][: len(order) - i], order[i : i + ROWS]
        differ = rows[a] != rows[b]
        out.append(np.where(differ.any(axis=1), differ.argmax(axis=1), depth))
    return np.concatenate(out)


def repeated_windows(contexts: list[bytes], length: int) -> list[np.ndarray]:
    """For each context the places of its windows that are windows of another place too."""
    sizes = np.array([len(c) for c in contexts], np.int64)
    text = np.frombuffer(b"\0".join(contexts) + bytes(length + 1), np.uint8).copy()
    end = np.cumsum(sizes + 1) - 1
    solid = np.ones(len(text), bool)
    solid[end], solid[end[-1] :] = False, False
    text += solid  # UTF-8 has no byte above 244; 0 is the end of a string alone
    begin, n = end - sizes, sizes - length + 1
    order = two_stage_order(text, begin, n, end, length)
    same = common_prefixes(text, order, length) >= length
    again = np.zeros(len(text), bool)
    again[order[same]] = True
    again[order[np.flatnonzero(same) - 1]] = True
    return [np.flatnonzero(again[a : a + k]) for a, k in zip(begin.tolist(), n.tolist(), strict=True)]


def _runs(at: np.ndarray) -> list[dict]:
    """Ascending places as spans a .. b - 1."""
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > 1)
    return [{"a": a, "b": b + 1} for a, b in zip(at[np.append(0, cut + 1)].tolist(), at[np.append(cut, len(at) - 1)].tolist(), strict=True)]


SPANS = "array<struct<a:int,b:int>>"
_SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _sorted_blocks(length: int):
    """(c1, c2, spans) of contexts(anchor, pos, c1, c2, context) in order of anchor and pos, whole anchors at a time."""

    def solved(held) -> pa.RecordBatch:
        found = repeated_windows([x[4] for x in held], length)
        keep = [i for i, f in enumerate(found) if len(f)]
        return pa.RecordBatch.from_arrays([pa.array([held[i][2] for i in keep], pa.int64()), pa.array([held[i][3] for i in keep], pa.int64()), pa.array([_runs(found[i]) for i in keep], _SPANS)], names=["c1", "c2", "spans"])

    def run(batches):
        held, group, size, last = [], [], 0, None
        for b in batches:
            for x in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if last is not None and x[0] == last[0]:
                    if x[1] == last[1]:  # the same place again, of a row that repeats another
                        continue
                else:
                    held += group if len(group) > 1 else []  # a single place of an anchor repeats nothing
                    group = []
                    if size >= BLOCK and held:
                        yield solved(held)
                        held, size = [], 0
                group.append(x)
                size += len(x[4]) - length + 1
                last = x
        held += group if len(group) > 1 else []
        if held:
            yield solved(held)

    return run


def _cut(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """(removed bytes, maximal removed runs, what is left)."""
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    left, at = [], 0
    for a, b in merged:
        left.append(text[at:a])
        at = b
    left.append(text[at:])
    return sum(b - a for a, b in merged), len(merged), b"".join(left)


RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"


def repeated_places(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Of docs(doc_id, text): (cls1, cls2, found) with the starts and spans of repeated windows of each text that has any, by the digest
    of the text; and (cls1, cls2) of rows that repeat another, whose windows are all repeated."""
    spark = ship(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = _sketch.width(size // (length // 3))
    schema = pa.schema([("row", pa.int32()), ("segment", pa.int32()), ("cells", pa.binary()), ("doc_id", pa.int64()), ("cls1", pa.int64()), ("cls2", pa.int64())])

    def first(batches):
        sketch = _sketch.PartSketch(bits)

        def wide(x):
            return pa.RecordBatch.from_arrays([*x.columns, *[pa.nulls(x.num_rows, pa.int64())] * 3], schema=schema)

        for b, block in _blocks(batches, length, gram):
            yield from map(wide, sketch.add(block.anchor))
            own = np.flatnonzero(np.diff(block.offs) >= length)
            k = len(own)
            yield pa.RecordBatch.from_arrays([pa.array([-1] * k, pa.int32()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), b.column(0).take(pa.array(own)), pa.array(block.cls[own, 0]), pa.array(block.cls[own, 1])], schema=schema)
        yield from map(wide, sketch.flush())

    told = stored(docs.mapInArrow(first, "row int, segment int, cells binary, doc_id bigint, cls1 bigint, cls2 bigint"), "suffixes-first")
    maps = spark.sparkContext.broadcast(_sketch.merged(told.where("row >= 0").select("row", "segment", "cells"), bits))
    twins = told.where("row = -1").groupBy("doc_id", "cls1", "cls2").count().where("count > 1").select("cls1", "cls2").distinct()

    def occurrences(batches):
        for _, block in _blocks(batches, length, gram):
            block.keep(_sketch.repeated(maps.value, bits, block.anchor))
            if not len(block.at):
                continue
            doc, start, pos = block.places()
            ctx = _two([_digest(c) for c in block.contexts(length)])
            order = np.lexsort((start, ctx[:, 1], ctx[:, 0], doc))
            doc, start, pos, ctx, anchor = doc[order], start[order], pos[order].view(np.int64), ctx[order], block.anchor[order].view(np.int64)
            new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (ctx[1:] != ctx[:-1]).any(axis=1)))
            starts = pa.ListArray.from_arrays(pa.array(np.append(new, len(doc)).astype(np.int32)), pa.array(start.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(ctx[new, 0]), pa.array(ctx[new, 1]), pa.array(anchor[new]), pa.array(np.minimum.reduceat(pos, new)), pa.array(np.maximum.reduceat(pos, new)), pa.array(block.cls[doc[new], 0]), pa.array(block.cls[doc[new], 1]), starts], names=["c1", "c2", "anchor", "low", "high", "cls1", "cls2", "starts"])

    occ = stored(docs.mapInArrow(occurrences, "c1 bigint, c2 bigint, anchor bigint, low bigint, high bigint, cls1 bigint, cls2 bigint, starts array<int>"), "suffixes-places")
    kinds = stored(occ.groupBy("c1", "c2").agg(F.min("anchor").alias("anchor"), F.min("low").alias("low"), F.max("high").alias("high")), "suffixes-contexts")
    anchors = kinds.groupBy("anchor").agg(F.count("*").alias("n"), F.min("low").alias("lowest"), F.max("high").alias("highest")).where("lowest != highest")
    anchors = stored(anchors.select("anchor", "n"), "suffixes-anchors")
    chosen = stored(kinds.join(anchors, "anchor").select(F.explode(F.array_distinct(F.array("low", "high"))).alias("pos")), "suffixes-chosen")
    log2 = int(min(28, max(20, np.ceil(np.log2(max(1, size // length) * 8)))))
    asked = spark.sparkContext.broadcast(bitmap(chosen, "pos", log2))

    def bodies(batches):
        for _, block in _blocks(batches, length, gram):
            block.keep(_sketch.repeated(maps.value, bits, block.anchor))
            _, _, pos = block.places()
            mine = hits(asked.value, log2, pos)
            block.keep(mine)
            if len(block.at):
                found = block.contexts(length)
                ctx = _two([_digest(c) for c in found])
                yield pa.RecordBatch.from_arrays([_text.longs(block.anchor), _text.longs(pos[mine]), pa.array(ctx[:, 0]), pa.array(ctx[:, 1]), pa.array(found, pa.binary())], names=["anchor", "pos", "c1", "c2", "context"])

    rows = docs.mapInArrow(bodies, "anchor bigint, pos bigint, c1 bigint, c2 bigint, context binary")
    crowded = sent(stored(anchors.where(F.col("n") > hot).select("anchor"), "suffixes-crowded"))
    rows = stored(rows.join(crowded.withColumn("crowded", F.lit(True)), "anchor", "left"), "suffixes-bodies")
    cold = rows.where("crowded is null").drop("crowded").repartition("anchor").sortWithinPartitions("anchor", "pos")
    found = cold.mapInArrow(_sorted_blocks(length), f"c1 bigint, c2 bigint, spans {SPANS}")

    def windows(batches):
        for b in batches:
            for c1, c2, pos, c in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                n = len(c) - length + 1
                keys = _two([_digest(c[i : i + length]) for i in range(n)])
                here = _text.mix(np.full(n, pos, np.int64).view(_U) ^ _text.mix(np.arange(n, dtype=_U)))
                yield pa.RecordBatch.from_arrays([pa.array([c1] * n, pa.int64()), pa.array([c2] * n, pa.int64()), pa.array(np.arange(n, dtype=np.int32)), pa.array(keys[:, 0]), pa.array(keys[:, 1]), _text.longs(here)], names=["c1", "c2", "at", "k1", "k2", "here"])

    warm = rows.where("crowded").select("c1", "c2", "pos", "context").mapInArrow(windows, "c1 bigint, c2 bigint, at int, k1 bigint, k2 bigint, here bigint")
    warm = stored(warm, "suffixes-windows")
    twice = warm.groupBy("k1", "k2").agg(F.min("here").alias("x"), F.max("here").alias("y")).where("x != y").select("k1", "k2")
    warm = warm.join(twice, ["k1", "k2"]).groupBy("c1", "c2").agg(F.collect_set(F.struct(F.col("at").alias("a"), (F.col("at") + 1).alias("b"))).alias("spans"))
    found = found.groupBy("c1", "c2").agg(F.first("spans").alias("spans")).unionByName(warm)
    found = stored(found, "suffixes-found")
    each = occ.select("c1", "c2", "cls1", "cls2", "starts").join(found, ["c1", "c2"])
    gone = each.groupBy("cls1", "cls2").agg(F.collect_set(F.struct("starts", "spans")).alias("found"))
    return stored(gone, "suffixes-gone"), stored(twins, "suffixes-twins")


def dedup_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, with_bytes: bool = False) -> DataFrame:
    """For each row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes left, if with_bytes).

    A byte goes if a string of `length` bytes that covers it starts at another place as well, of any row, its own included. Null and
    empty texts have no bytes and the digest of nothing. Rows that repeat another, doc_id and all, are documents of their own, so all
    of their windows are repeated; null doc_ids are as others. Empty table: no rows. Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    gone, twins = repeated_places(docs, length, gram, hot)
    gone = gone.withColumn("whole", F.lit(False)).unionByName(twins.select("cls1", "cls2", F.lit(None).cast(gone.schema["found"].dataType).alias("found"), F.lit(True).alias("whole")))
    gone = stored(gone.groupBy("cls1", "cls2").agg(F.max("whole").alias("whole"), F.first("found", ignorenulls=True).alias("found")), "suffixes-cuts")
    touched = docs.sparkSession.sparkContext.broadcast(bitmap(gone.select(F.col("cls1").alias("h")), "h", DOC_BITS))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])

    def batch_of(ids, sizes, made):
        return pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.int64()), pa.array([hashlib.sha256(m[2]).hexdigest() for m in made], pa.string()), pa.array([m[2] if with_bytes else None for m in made], pa.binary())], schema=schema)

    def classes(b):
        data, offs = _text.bytes_of(b.column(1))
        view = memoryview(data.tobytes())
        return [view[x:y] for x, y in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]

    def plain(batches):
        for batch in batches:
            for b in _text.blocks(batch):
                texts = classes(b)
                at = [i for i, h in enumerate(hits(touched.value, DOC_BITS, _two([_digest(t) for t in texts])[:, 0].copy().view(_U)).tolist()) if not h]
                yield batch_of(b.column(0).take(pa.array(at, pa.int64())), [len(texts[i]) for i in at], [(0, 0, bytes(texts[i])) for i in at])

    def picked(batches):
        for batch in batches:
            for b in _text.blocks(batch):
                cls = _two([_digest(t) for t in classes(b)])
                at = pa.array(np.flatnonzero(hits(touched.value, DOC_BITS, cls[:, 0].copy().view(_U))))
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(cls[:, 0]).take(at), pa.array(cls[:, 1]).take(at)], names=["doc_id", "text", "cls1", "cls2"])

    def cut(batches):
        for batch in batches:
            for b in _text.blocks(batch):
                texts, made = [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()], []
                for t, whole, found in zip(texts, b.column(2).to_pylist(), b.column(3), strict=True):
                    spans = [(0, len(t))] if whole else [(s + x["a"], s + x["b"] + length - 1) for f in found.as_py() or [] for s in f["starts"] for x in f["spans"]]
                    made.append(_cut(t, spans))
                yield batch_of(b.column(0), [len(t) for t in texts], made)

    matched = docs.mapInArrow(picked, "doc_id bigint, text string, cls1 bigint, cls2 bigint").join(gone, ["cls1", "cls2"], "left")
    out = docs.mapInArrow(plain, RESULT).unionByName(matched.select("doc_id", "text", "whole", "found").mapInArrow(cut, RESULT))
    return out if with_bytes else out.drop("kept")


def oracle() -> str:
    """The same rows in DuckDB SQL, by digests of all windows as hexadecimal text."""
    return f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
wins AS MATERIALIZED (SELECT r, i, md5_number(substr(x, 2 * i + 1, {2 * LENGTH})) AS h FROM (SELECT r, x, unnest(range(len(x) // 2 - {LENGTH - 1})) AS i FROM docs WHERE len(x) >= {2 * LENGTH})),
twice AS MATERIALIZED (SELECT h FROM wins GROUP BY h HAVING count(*) > 1),
hit AS MATERIALIZED (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM wins WHERE h IN (SELECT h FROM twice)),
spans AS MATERIALIZED (
  SELECT r, min(i) AS a, max(i) + {LENGTH} AS b FROM (
    SELECT r, i, sum(CASE WHEN before IS NULL OR i > before + {LENGTH} THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS s FROM hit) GROUP BY r, s),
edges AS MATERIALIZED (
  SELECT d.r, coalesce(lag(s.b) OVER (PARTITION BY d.r ORDER BY s.a), 0) AS a, s.a AS b FROM docs d JOIN spans s ON s.r = d.r
  UNION ALL SELECT d.r, coalesce(m.b, 0), len(d.x) // 2 FROM docs d LEFT JOIN (SELECT r, max(b) AS b FROM spans GROUP BY r) m ON m.r = d.r),
kept AS MATERIALIZED (SELECT e.r, string_agg(substr(x, CAST(2 * e.a + 1 AS BIGINT), CAST(2 * (e.b - e.a) AS BIGINT)), '' ORDER BY e.a) AS x FROM edges e JOIN docs d ON d.r = e.r GROUP BY e.r),
sums AS MATERIALIZED (SELECT r, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM spans GROUP BY r)
SELECT doc_id, len(d.x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(k.x)) AS kept_sha256
FROM docs d JOIN kept k ON k.r = d.r LEFT JOIN sums s ON s.r = d.r"""
