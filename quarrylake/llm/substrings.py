"""Operator 5, substring dedup: a count-min prefilter over 50-word windows, then exact grouping of the windows it lets through.

The sketch doesn't count windows one by one. A window's anchor is the smallest hash among its 25-word grams, so equal windows
have equal anchors, and the number of documents with an anchor is never below the number with any window of that anchor. Each
partition counts the distinct anchors of its documents; the merged sketch thus overestimates every window's document count, and
a window whose estimate is below two cannot be repeated. The second pass groups the others by 128-bit keys.

Whole copies (equal word sequences) are found first by fingerprint, and only one of each takes part in the second pass.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylake.llm import _sketch, _text
from quarrylake.llm._work import bitmap, hits, ship, stored

WINDOW = 50
GRAM = 25
DOC_BITS = 24
KEY_SIDES = 2


def _anchors(h: np.ndarray, window: int, gram: int) -> np.ndarray:
    """For each window the smallest hash of its grams."""
    g, span, step = _text.grams(h, gram), window - gram + 1, 1
    while step * 2 <= span:
        g = np.minimum(g[:-step], g[step:])
        step *= 2
    return np.minimum(g[: len(g) - (span - step)], g[span - step :]) if span > step else g


def _ids(hashes: list[np.ndarray]) -> tuple[int, int]:
    return tuple(int(np.uint64(_text.prints(h)).view(np.int64)) for h in hashes)


def _first_pass(docs: DataFrame, log2_cells: int, window: int, gram: int) -> DataFrame:
    """Partition sketches (row >= 0) and one row (row = -1) of each document: doc_id, n, fingerprint f1, f2."""
    schema = pa.schema([("row", pa.int32()), ("segment", pa.int32()), ("cells", pa.binary()), ("doc_id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64())])

    def wide(b: pa.RecordBatch) -> pa.RecordBatch:
        none = [pa.nulls(b.num_rows, pa.int64())] * 4
        return pa.RecordBatch.from_arrays([*b.columns, *none], schema=schema)

    def run(batches):
        sketch = _sketch.PartSketch(log2_cells)
        for batch in batches:
            for b in _text.blocks(batch):
                data, offs = _text.bytes_of(b.column(1))
                hs, first = _text.words(data, offs, lower=False, sides=2)
                ns, ids, found = [], [], []
                for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                    ns.append(hi - lo)
                    ids.append(_ids([h[lo:hi] for h in hs]))
                    if hi - lo >= window:
                        found.append(np.unique(_anchors(hs[0][lo:hi], window, gram)))
                if found:
                    for out in sketch.add(np.concatenate(found)):
                        yield wide(out)
                n = b.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([-1] * n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), b.column(0), pa.array(ns, pa.int64()), pa.array([x[0] for x in ids], pa.int64()), pa.array([x[1] for x in ids], pa.int64())], schema=schema)
        for out in sketch.flush():
            yield wide(out)

    return docs.mapInArrow(run, "row int, segment int, cells binary, doc_id bigint, n bigint, f1 bigint, f2 bigint")


def _windows(rows: DataFrame, maps, log2_cells: int, window: int, gram: int, skip=None) -> DataFrame:
    """(k1, k2, doc_id, f1, pos) of the windows estimated repeated; rows(doc_id, h, text). skip: a bitmap of h to leave out."""

    def run(batches):
        for batch in batches:
            if skip is not None:
                batch = batch.take(pa.array(np.flatnonzero(~hits(skip.value, DOC_BITS, batch.column(1).to_numpy().view(np.uint64)))))
            for b in _text.blocks(batch):
                data, offs = _text.bytes_of(b.column(2))
                hs, first = _text.words(data, offs, lower=False, sides=KEY_SIDES)
                parts = []
                for i, (lo, hi) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                    if hi - lo < window:
                        continue
                    at = np.flatnonzero(_sketch.repeated(maps.value, log2_cells, _anchors(hs[0][lo:hi], window, gram)))
                    if len(at):
                        keys = [_text.grams(h[lo:hi], window)[at] for h in hs]
                        parts.append((keys[0], keys[1], np.full(len(at), i), np.full(len(at), _ids([hs[0][lo:hi]])[0], np.int64), at))
                if parts:
                    k1, k2, i, f1, at = (np.concatenate(x) for x in zip(*parts, strict=True))
                    yield pa.RecordBatch.from_arrays([_text.longs(k1), _text.longs(k2), b.column(0).take(pa.array(i)), pa.array(f1), pa.array(at.astype(np.int32))], names=["k1", "k2", "doc_id", "f1", "pos"])

    return rows.select("doc_id", "h", "text").mapInArrow(run, "k1 bigint, k2 bigint, doc_id bigint, f1 bigint, pos int")


def _kept(text: bytes | None, starts: np.ndarray | None, window: int) -> tuple[int, int, bytes]:
    """(words, removed words, what is kept) of a text whose windows at starts go."""
    w = (text or b"").split()
    if starts is None or not len(starts) or not w:
        return len(w), 0, b" ".join(w)
    edge = np.zeros(len(w) + 1, np.int64)
    starts = np.unique(starts)
    edge[starts] += 1
    np.subtract.at(edge, np.minimum(starts + window, len(w)), 1)
    gone = np.cumsum(edge)[:-1] > 0
    return len(w), int(gone.sum()), b" ".join([x for x, g in zip(w, gone.tolist(), strict=True) if not g])


RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string"


def dedup_substrings(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """For each row of docs: doc_id, n_words, n_removed, kept_sha256 (and kept, the text left, if with_text).

    A word goes if a window that covers it starts in a document of smaller doc_id as well. Null texts and texts of fewer words
    than a window lose nothing; an empty or null text has the digest of the empty string. Repeats within one document, and rows
    that repeat a doc_id, don't remove each other. Rows with a null doc_id are returned whole and remove nothing. Empty table: no
    rows. Other columns are not read.
    """
    spark = ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = _sketch.width(size // 64)  # about one anchor in 13 words, of five bytes or so
    first = stored(_first_pass(docs, bits, window, gram), "substrings-pass1")
    maps = spark.sparkContext.broadcast(_sketch.merged(first.where("row >= 0").select("row", "segment", "cells"), bits))
    seen = first.where(f"row = -1 and n >= {window} and doc_id is not null").select("doc_id", "f1", "f2")
    copies = seen.groupBy("f1", "f2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("f1", "f2", "low")
    copies = stored(copies, "substrings-groups")  # a join of two stored tables can be split where a key is hot
    copies = stored(seen.join(copies, ["f1", "f2"]).distinct(), "substrings-copies")
    of_copy = spark.sparkContext.broadcast(bitmap(copies.select(F.xxhash64("doc_id").alias("h")), "h", DOC_BITS))

    whole = copies.where("doc_id > low").select("doc_id", "f1").distinct()

    # Second pass: windows of single documents, and of the first of each set of copies.
    rows = docs.where("doc_id is not null").withColumn("h", F.xxhash64("doc_id"))

    def chosen(bits_of):
        def run(batches):
            for batch in batches:
                batch = batch.take(pa.array(np.flatnonzero(hits(bits_of.value, DOC_BITS, batch.column(1).to_numpy().view(np.uint64)))))
                for b in _text.blocks(batch):
                    data, offs = _text.bytes_of(b.column(2))
                    (h,), first = _text.words(data, offs, lower=False)
                    f1 = [_ids([h[lo:hi]])[0] for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(f1, pa.int64())], names=["doc_id", "text", "f1"])

        return rows.select("doc_id", "h", "text").mapInArrow(run, "doc_id bigint, text string, f1 bigint")

    firsts = chosen(of_copy).join(whole, ["doc_id", "f1"], "left_anti").select("doc_id", F.lit(0).cast("long").alias("h"), "text")
    wins = _windows(rows, maps, bits, window, gram, skip=of_copy).unionByName(_windows(firsts, maps, bits, window, gram))
    wins = stored(wins, "substrings-windows")
    low = wins.groupBy("k1", "k2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("k1", "k2", "low")
    low = stored(low, "substrings-repeated")
    gone = wins.join(low, ["k1", "k2"]).where("doc_id > low").groupBy("doc_id", "f1").agg(F.collect_set("pos").alias("starts"))
    gone = gone.withColumn("all", F.lit(False)).unionByName(whole.select("doc_id", "f1", F.lit(None).cast("array<int>").alias("starts"), F.lit(True).alias("all")))
    gone = stored(gone, "substrings-gone")
    touched = spark.sparkContext.broadcast(bitmap(gone.select(F.xxhash64("doc_id").alias("h")), "h", DOC_BITS))

    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])

    def batch_of(ids, made):
        return pa.RecordBatch.from_arrays([ids, pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.int64()), pa.array([hashlib.sha256(m[2]).hexdigest() for m in made], pa.string()), pa.array([m[2].decode() if with_text else None for m in made], pa.string())], schema=schema)

    def plain(batches):
        for batch in batches:
            known = hits(touched.value, DOC_BITS, batch.column(1).to_numpy().view(np.uint64)) & np.asarray(batch.column(0).is_valid())
            batch = batch.take(pa.array(np.flatnonzero(~known)))
            for b in _text.blocks(batch):
                yield batch_of(b.column(0), [_kept(t, None, window) for t in b.column(2).cast(pa.binary()).to_pylist()])

    def cut(batches):
        for batch in batches:
            for b in _text.blocks(batch):
                made = []
                for t, starts, wiped in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                    if wiped:
                        n = len(t.split())
                        made.append((n, n, b""))
                    else:
                        made.append(_kept(t, np.array(starts, np.int64) if starts is not None else None, window))
                yield batch_of(b.column(0), made)

    everything = docs.withColumn("h", F.xxhash64("doc_id")).select("doc_id", "h", "text")
    untouched = everything.mapInArrow(plain, RESULT)
    matched = chosen(touched).join(gone, ["doc_id", "f1"], "left")
    out = untouched.unionByName(matched.select("doc_id", "text", "starts", "all").mapInArrow(cut, RESULT))
    return out if with_text else out.drop("kept")
