"""Operator 9, exact top-k search: dual-tree search over cover trees of queries and of data.

Components are scaled and floored to integers, scores are integer inner products. Queries are dealt into groups and rows into parts,
both tables of bounded pieces; each part meets each group in a task that indexes both in cover trees. A pair of nodes with centres
a, c and covering radii r, s can hold no score above a.c + |a| s + |c| r + r s; it is pruned if that is below the worst kth score of
the node's queries. At leaves each query is held against its own bound q.c + |q| s, and only those that may gain are multiplied, in
one matrix product a leaf pair. Scores against a bounded sample of rows give each query a first kth score, so that parts don't
return what can't be among the best; every row is searched all the same.

Vectors spread evenly in many dimensions admit no pruning: any exact search must look at all pairs. Then the work is one blocked
matrix product, and the bounds cost a small part of it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylake.llm._work import shared_dir, ship, stored

SCALE = 64
EVERY = 20
TOP = 20
LEAF = 256
FANOUT = 64
BASE = 1.3
BLOCK = 8192  # rows of a block
PART_BYTES = 48 << 20  # of blocks in a task
GROUP_BYTES = 8 << 20  # of queries in a task
HELD = 1 << 20  # scores kept before they are ranked
SAMPLE = 4096
LOW = np.iinfo(np.int64).min
KINDS = ("<i2", "<i4", "<f8")


def scaled(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, their integer vectors as float64, short ones padded with zeros)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    lens = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = col.flatten()
    vals = np.floor(SCALE * flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)) if len(flat) else np.zeros(0)
    width = int(lens.max()) if len(lens) else 0
    out = np.zeros((len(lens), width))
    row = np.repeat(np.arange(len(lens)), lens)
    out[row, np.arange(len(vals)) - np.repeat(np.cumsum(lens) - lens, lens)] = vals
    ok = np.asarray(col.is_valid()) & np.isfinite(out).all(axis=1)
    return np.flatnonzero(ok), out[ok]


def packed(x: np.ndarray) -> tuple[int, bytes]:
    """(index in KINDS, bytes) of integer vectors, in the smallest kind that holds them."""
    most = abs(x).max(initial=0)
    kind = 0 if most < 1 << 15 else 1 if most < 1 << 31 else 2
    return kind, np.ascontiguousarray(x, KINDS[kind]).tobytes()


def unpacked(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors as float64) of rows (ids, width, kind, x)."""
    ids = [np.frombuffer(b.as_buffer(), np.int64) for b in t.column("ids")]
    widths, kinds = t.column("width").to_pylist(), t.column("kind").to_pylist()
    out = np.zeros((sum(map(len, ids)), max(widths, default=0)))
    at = 0
    for i, w, k, x in zip(ids, widths, kinds, t.column("x"), strict=True):
        out[at : at + len(i), :w] = np.frombuffer(x.as_buffer(), KINDS[k]).reshape(len(i), w)
        at += len(i)
    return np.concatenate(ids) if ids else np.zeros(0, np.int64), out


class CoverTree:
    """Nodes with a centre, a covering radius, and either children or points.

    Points are inserted in a fixed random order: one farther than r / BASE from all centres of a level becomes a centre of its own, up
    to as many as leave LEAF points each, and others go to the nearest.
    """

    def __init__(self, x: np.ndarray):
        self.x = x
        self.center, self.radius, self.norm, self.children, self.inside = [], [], [], [], []
        self.lengths = np.sqrt((x * x).sum(axis=1))
        if len(x):
            order = np.random.default_rng(1).permutation(len(x))
            self._node(order, self._far(order, order[0]))

    def _far(self, at: np.ndarray, c: int) -> np.ndarray:
        d = self.lengths[at] ** 2 + self.lengths[c] ** 2 - 2 * (self.x[at] @ self.x[c])
        return np.sqrt(np.maximum(0, d))

    def _node(self, at: np.ndarray, dist: np.ndarray) -> int:
        """at[0] is the centre."""
        me, r = len(self.center), float(dist.max())
        self.center.append(self.x[at[0]])
        self.radius.append(r)
        self.norm.append(float(self.lengths[at[0]]))
        self.children.append([])
        self.inside.append(at)
        if len(at) <= LEAF or r == 0:
            return me
        near, own, n = dist.copy(), np.zeros(len(at), np.int64), 1
        fan = min(FANOUT, -(-len(at) // LEAF))
        while n < fan:
            open_ = near > r / BASE
            first = int(open_.argmax())
            if not open_[first]:
                break
            d = self._far(at, at[first])
            closer = d < near
            closer[first] = True
            near[closer], own[closer] = d[closer], n
            near[first] = 0
            n += 1
        if n == 1:
            return me
        for c in range(n):
            mine = np.flatnonzero(own == c)
            if len(mine):
                mine = mine[np.argsort(near[mine], kind="stable")]  # the centre comes first
                self.children[me].append(self._node(at[mine], near[mine]))
        return me


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of integer vectors held as float64, in a kind that holds them."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    most = float(abs(a).max(initial=0)) * float(abs(b).max(initial=0)) * max(1, width)
    if most < 1 << 24:
        return a.astype(np.float32) @ b.astype(np.float32).T
    if most < 1 << 52:
        return a @ b.T
    if most < 1 << 62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    return np.array([[sum(int(p) * int(q) for p, q in zip(u, v, strict=True)) for v in b] for u in a], np.int64).reshape(len(a), len(b))


class Best:
    """The k best (score, smaller id first) of each query."""

    def __init__(self, n: int, k: int, least: np.ndarray):
        self.k, self.least = k, least.copy()  # a kth score known to be reached
        self.q, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.held, self.n = [], 0

    def add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self.held.append((q, score, ids))
        self.n += len(q)
        if self.n >= HELD:
            self.rank()

    def rank(self) -> None:
        if not self.n:
            return
        q, s, i = (np.concatenate(x) for x in zip((self.q, self.score, self.id), *self.held, strict=True))
        self.held, self.n = [], 0
        order = np.lexsort((i, np.invert(s), q))
        q, s, i = q[order], s[order], i[order]
        first = np.searchsorted(q, q, side="left")
        place = np.arange(len(q)) - first
        last = place == self.k - 1
        self.least[q[last]] = np.maximum(self.least[q[last]], s[last])
        keep = place < self.k
        self.q, self.score, self.id = q[keep], s[keep], i[keep]


def search(qt: CoverTree, qid: np.ndarray, dt: CoverTree, did: np.ndarray, best: Best) -> int:
    """Put every score that may be among the best into `best`; gives the number of pairs of vectors multiplied."""
    if not len(qid) or not len(did):
        return 0
    looked, stack = 0, [(0, 0)]
    width = min(qt.x.shape[1], dt.x.shape[1])
    while stack:
        q, d = stack.pop()
        a, c, r, s = qt.center[q][:width], dt.center[d][:width], qt.radius[q], dt.radius[d]
        rows, most = qt.inside[q], float(a @ c) + qt.norm[q] * s + dt.norm[d] * r + r * s
        if most + 1e-9 * abs(most) + 1 < best.least[rows].min():
            continue
        if not qt.children[q] and not dt.children[d]:
            own = qt.x[rows][:, :width] @ c + qt.lengths[rows] * s
            rows = rows[own + 1e-9 * abs(own) + 1 >= best.least[rows]]
            at = dt.inside[d]
            for lo in range(0, len(at) if len(rows) else 0, 2048):
                part = at[lo : lo + 2048]
                scores = dots(qt.x[rows], dt.x[part])
                looked += scores.size
                i, j = np.nonzero(scores >= best.least[rows].astype(scores.dtype)[:, None])
                other = qid[rows[i]] != did[part[j]]
                i, j = i[other], j[other]
                best.add(rows[i], scores[i, j].astype(np.int64), did[part[j]])
        elif not dt.children[d] or (qt.children[q] and r > s):
            stack += [(x, d) for x in qt.children[q]]
        else:  # the most promising child is looked at first
            kids = sorted(dt.children[d], key=lambda x: float(a @ dt.center[x][:width]) + qt.norm[q] * dt.radius[x])
            stack += [(q, x) for x in kids]
    return looked


_BLOCK = "b bigint, ids binary, width int, kind int, x binary"


def _blocks(v: DataFrame) -> DataFrame:
    """Rows of v(vec_id, embedding) in blocks of BLOCK at most, one row each; vectors that take no part are left out."""

    def made(held: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        ok, x = scaled(t.column(1))
        kind, data = packed(x)
        b = (TaskContext.get().partitionId() << 32) + number
        return pa.RecordBatch.from_arrays([pa.array([b]), pa.array([t.column(0).to_numpy()[ok].astype(np.int64).tobytes()], pa.binary()), pa.array([x.shape[1]], pa.int32()), pa.array([kind], pa.int32()), pa.array([data], pa.binary())], names=["b", "ids", "width", "kind", "x"])

    def run(batches):
        held, n, number = [], 0, 0
        for b in batches:
            while b.num_rows:
                part = b.slice(0, BLOCK - n)
                held.append(part)
                n += part.num_rows
                b = b.slice(part.num_rows)
                if n == BLOCK:
                    yield made(held, number)
                    held, n, number = [], 0, number + 1
        if held:
            yield made(held, number)

    return v.mapInArrow(run, _BLOCK)


_GROUP = "g bigint, ids binary, width int, kind int, x binary, least binary"


def _groups(queries: DataFrame, n: int, sent, k: int) -> DataFrame:
    """queries(vec_id, embedding) dealt into n groups, one row each, with a kth score that each query reaches in the sample."""

    def run(key, t):
        ok, x = scaled(t.column("embedding"))
        qid = t.column("vec_id").to_numpy()[ok].astype(np.int64)
        sid, sx = sent.value
        least = np.full(len(qid), LOW, np.int64)
        for lo in range(0, len(qid), 1024):
            s = dots(x[lo : lo + 1024], sx)
            if s.shape[1] > k:  # one of the sample may be the query itself
                s = s.astype(np.int64)
                s[qid[lo : lo + 1024, None] == sid[None, :]] = LOW
                least[lo : lo + 1024] = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        kind, data = packed(x)
        return pa.table({"g": pa.array([key[0].as_py()], pa.int64()), "ids": pa.array([qid.tobytes()], pa.binary()), "width": pa.array([x.shape[1]], pa.int32()), "kind": pa.array([kind], pa.int32()), "x": pa.array([data], pa.binary()), "least": pa.array([least.tobytes()], pa.binary())})

    return queries.withColumn("g", F.pmod(F.xxhash64("vec_id"), F.lit(n))).groupBy("g").applyInArrow(run, _GROUP)


def nearest(vectors: DataFrame, every: int = EVERY, k: int = TOP) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row whose vec_id is divisible by `every` its k best rows, itself left out.

    Ties go to the smaller vec_id; with fewer than k other rows all are returned. Vectors that are null or hold null or non-finite
    components, and rows without vec_id, take no part; shorter vectors count as padded with zeros, so an empty one scores 0. Rows
    that share a vec_id: the query's own id is left out, other ids keep each row; queries that share an id share one list, of the
    smallest vector. Scores must fit 63 bits. Empty table: no rows. Other columns are not read.
    """
    spark = ship(vectors.sparkSession)
    shared_dir(spark)
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null and embedding is not null")
    sample = v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    ok, sx = scaled(sample.column("embedding"))
    sent = spark.sparkContext.broadcast((sample.column("vec_id").to_numpy()[ok], sx))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    asked = v.where(F.col("vec_id") % every == 0).where(~bad).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    size = asked.agg(F.sum(F.size("embedding") * 8 + 64)).first()[0] or 0
    n_groups = max(1, -(-size // GROUP_BYTES))
    groups = stored(_groups(asked, n_groups, sent, k), "topk-queries")
    blocks = stored(_blocks(v), "topk-rows")
    n_blocks, held = blocks.agg(F.count("*"), F.coalesce(F.sum(F.length("x") + F.length("ids")), F.lit(0))).first()
    n_parts = min(max(1, n_blocks), max(spark.sparkContext.defaultParallelism, -(-held // PART_BYTES)))
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    rows = blocks.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(n_parts)).cast("long")).withColumn("g", numbers(n_groups))
    asking = groups.withColumn("part", numbers(n_parts))

    def run(key, left, right):
        qid, x = unpacked(left)
        did, y = unpacked(right)
        least = np.frombuffer(left.column("least")[0].as_buffer(), np.int64) if left.num_rows else np.zeros(0, np.int64)
        best = Best(len(qid), k, least)
        search(CoverTree(x), qid, CoverTree(y), did, best)
        best.rank()
        keep = best.score >= least[best.q]
        return pa.table({"query_id": pa.array(qid[best.q[keep]]), "vec_id": pa.array(best.id[keep]), "score": pa.array(best.score[keep])})

    got = asking.groupBy("g", "part").cogroup(rows.groupBy("g", "part")).applyInArrow(run, "query_id bigint, vec_id bigint, score bigint")
    ranked = got.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
