"""Operator 11, phrase collocation mining: count tries of limited depth, merged by prefix range.

A task reads its shard into tries of DEPTH words below each language, counts in every node, and hands them on serialised: one row for
each word and first byte of the word after it, with the tails of the paths below in order. A path's key is its language and words with
a zero byte between, every other byte moved up by one, so a node comes right before its subtree in the order of keys, and rows are
cut alike in all shards. Rows are dealt by ranges, whose bounds come from the tries of a small sample, so that the tries are made once,
and sorted, so each range of all tries is merged in one walk. On that walk the counts of the ancestors, the left parts of the phrase,
stand on a stack; where a range starts inside a subtree, they come from the stacks that other ranges ended with. A suffix link leads from a path to the one without its first words:
a join by key, which gives the right parts.

Before that sketches count words and pairs of neighbours, and then the longer runs whose pairs may be frequent. Sketches never fall
below a true count, and no phrase is more frequent than its parts, so nodes they rule out can't reach `least` occurrences and are left
out of the tries.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylake.llm import _sketch, _text
from quarrylake.llm._work import ship, stored

DEPTH = 4
LEAST = 30
MOST_RANKS = 2000
PERCENT = 80
SCALE = 2_000_000
SHARD = 500_000  # words in a trie; a task holds one shard at a time, so this bounds a Python worker's memory
SALTS = 64
SAMPLE = 8 << 20  # bytes of the texts that tell where ranges are cut; counts are of all texts
NO_LANG = "und"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", 10, 11, 12, 13]] = True
_GAP = _BREAK.copy()
_GAP[[9, 32]] = True


class Shard:
    """Words of some texts in order: bytes of each, the piece it stands in, and its language."""

    def __init__(self):
        self.words, self.pieces, self.langs, self.names, self.n, self.last = [], [], [], {}, 0, 0

    def add(self, texts: pa.Array, langs: list[str | None]) -> None:
        data, offs = _text.bytes_of(texts)
        known = np.array([self.names.setdefault(NO_LANG if x is None else x, len(self.names)) for x in langs], np.int64)
        for lo, hi in _text.cuts(data, offs, _GAP):
            part = _LOWER[data[lo:hi]]
            gap = _GAP[part]
            begin = ~gap
            begin[1:] &= gap[:-1]
            inner = offs[(offs >= lo) & (offs < hi)] - lo
            begin[inner] = ~gap[inner]
            at = np.flatnonzero(begin)
            ends = _BREAK[part].astype(np.int64)
            np.add.at(ends, inner, 1)  # a document is a piece of its own
            piece = np.cumsum(ends) + self.last
            self.last = int(piece[-1]) if len(piece) else self.last
            if not len(at):
                continue
            chars, rank = part[~gap], np.cumsum(~gap) - 1
            begins = np.append(rank[at], len(chars)).astype(np.int32)
            self.words.append(pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(begins.tobytes()), pa.py_buffer(chars.tobytes())]))
            self.pieces.append(piece[at])
            self.langs.append(known[np.searchsorted(offs, at + lo, side="right") - 1])
            self.n += len(at)

    def coded(self) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """(distinct words in order, the place there of each word, pieces, languages, names of languages)."""
        d = pa.chunked_array(self.words, pa.binary()).combine_chunks().dictionary_encode()
        d = d.combine_chunks() if isinstance(d, pa.ChunkedArray) else d
        order = pc.array_sort_indices(d.dictionary)
        place = np.empty(len(order), np.int64)
        place[order.to_numpy()] = np.arange(len(order))
        return d.dictionary.take(order), place[d.indices.to_numpy()], np.concatenate(self.pieces), np.concatenate(self.langs), list(self.names)


def shards(batches) -> Iterator[Shard]:
    held = Shard()
    for batch in batches:
        for b in _text.blocks(batch):
            held.add(b.column(0), b.column(1).to_pylist())
            if held.n >= SHARD:
                yield held
                held = Shard()
    if held.n:
        yield held


def _hashes(words: pa.Array, w: np.ndarray, langs: np.ndarray, names: list[str]) -> np.ndarray:
    """A hash of each word in its language."""
    of_word = np.array([xxhash.xxh3_64_intdigest(x) for x in words.to_pylist()], np.uint64)
    of_lang = np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in names], np.uint64)
    return _text.mix(of_word[w] ^ _text.mix(of_lang[langs]))


def runs_of(h: np.ndarray, pieces: np.ndarray, depth: int, often) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(d, places, hashes) of the runs of 1 to `depth` words inside pieces whose parts all may be frequent, as often[d](hashes) says; of a
    length without such a test, all those."""
    ok, run = np.ones(len(h), bool), h
    for d in range(1, depth + 1):
        if d > 1:
            ok = ok[:-1] & ok[1:] & (pieces[: len(h) - d + 1] == pieces[d - 1 :])
            run = _text.join(run[:-1], h[d - 1 :])
        at = np.flatnonzero(ok)
        if d in often:
            at = at[often[d](run[at])]
            ok = np.zeros(len(ok), bool)
            ok[at] = True
        yield d, at, run[at]


def _key(words: list[pa.Array]) -> pa.Array:
    """Keys of paths, from columns of moved bytes."""
    return words[0] if len(words) == 1 else pc.binary_join_element_wise(*words, pa.scalar(b"\0", pa.binary()))


def _moved(a: pa.Array) -> pa.Array:
    """Every byte up by one; UTF-8 has none above 244."""
    data, offs = _text.bytes_of(a)
    return pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(offs.astype(np.int32).tobytes()), pa.py_buffer((data + np.uint8(1)).tobytes())])


def trie(shard: Shard, depth: int, often) -> pa.RecordBatch:
    """key, tails, counts: the parts of a shard's trie; often tells the runs of words that may be frequent."""
    words, w, pieces, langs, names = shard.coded()
    moved, tongues = _moved(words), _moved(pa.array([x.encode() for x in names], pa.binary()))
    first_byte = np.array([x[0] + 1 for x in words.to_pylist()], np.int64)
    longest = np.zeros(len(w), np.int8)  # of the node that starts at a word
    for d, at, _ in runs_of(_hashes(words, w, langs, names), pieces, depth, often):
        longest[at] = d
    at = np.flatnonzero(longest)
    path = np.full((depth, len(at)), -1, np.int64)
    for d in range(depth):
        live = longest[at] > d
        path[d, live] = w[at[live] + d]
    order = np.lexsort((*path[::-1], langs[at]))
    path, lang = path[:, order], langs[at][order]
    new = np.ones(len(order), bool)
    new[1:] = lang[1:] != lang[:-1]
    heads, bytes_, tails, counts = [], [], [], []  # of nodes: place of the first path with their language and first word, next byte, rest
    word_at = np.zeros(len(order), np.int64)
    for d in range(depth):
        new[1:] |= path[d, 1:] != path[d, :-1]
        if d == 0:
            word_at = np.flatnonzero(new)[np.cumsum(new) - 1]
        there = np.flatnonzero(new & (path[d] >= 0))  # a node's first path; its others follow, as shorter ones come before
        if len(there):
            ends = np.append(np.flatnonzero(new), len(order))
            counts.append(ends[np.searchsorted(ends, there, side="right")] - there)
            heads.append(word_at[there])
            bytes_.append(first_byte[path[1, there]] if d else np.zeros(len(there), np.int64))
            tails.append(_key([moved.take(pa.array(path[j, there])) for j in range(1, d + 1)]) if d else pa.array([b""] * len(there), pa.binary()))
    roots = np.bincount(langs, minlength=len(names)).astype(np.int64)
    top = pa.RecordBatch.from_arrays([tongues, pa.array([b""] * len(names), pa.binary()), pa.array([[c] for c in roots.tolist()], pa.list_(pa.int64()))], names=["key", "tails", "counts"])
    if not heads:
        return top
    head, byte, tail, count = np.concatenate(heads), np.concatenate(bytes_), pa.concat_arrays(tails), np.concatenate(counts).astype(np.int64)
    order = pc.sort_indices(pa.table({"h": head, "b": byte, "t": tail}), [("h", "ascending"), ("b", "ascending"), ("t", "ascending")]).to_numpy()
    head, byte, tail, count = head[order], byte[order], tail.take(pa.array(order)), count[order]
    cut = np.flatnonzero(np.append(True, (head[1:] != head[:-1]) | (byte[1:] != byte[:-1])))
    edges = pa.array(np.append(cut, len(head)).astype(np.int32))
    stems = _key([tongues.take(pa.array(lang[head[cut]])), moved.take(pa.array(path[0, head[cut]]))])
    letters = pa.array([bytes([0, b]) if b else b"" for b in byte[cut].tolist()], pa.binary())
    keys = pc.binary_join_element_wise(stems, letters, pa.scalar(b"", pa.binary()))
    joined = pc.binary_join(pa.ListArray.from_arrays(edges, tail), pa.scalar(b"\xff", pa.binary()))
    rows = pa.RecordBatch.from_arrays([keys, joined, pa.ListArray.from_arrays(edges, pa.array(count))], names=["key", "tails", "counts"])
    return pa.Table.from_batches([top, rows]).combine_chunks().to_batches()[0]


def _text_of(key: bytes) -> str:
    return bytes(b - 1 for b in key).decode()


NODE = "key binary, f bigint, depth int, lang string, phrase string, cuts array<struct<k:int,left:binary,l:bigint,right:binary>>, inner array<binary>, open boolean"
_NODE = pa.schema([
    ("key", pa.binary()), ("f", pa.int64()), ("depth", pa.int32()), ("lang", pa.string()), ("phrase", pa.string()),
    ("cuts", pa.list_(pa.struct([("k", pa.int32()), ("left", pa.binary()), ("l", pa.int64()), ("right", pa.binary())]))),
    ("inner", pa.list_(pa.binary())), ("open", pa.bool_()),
])


class Walk:
    """A walk over merged nodes in order; `stack` holds the node itself and its ancestors met so far."""

    def __init__(self):
        self.stack: list[tuple[bytes, int]] = []

    def node(self, key: bytes, f: int) -> dict:
        parts = key.split(b"\0")
        while self.stack and not key.startswith(self.stack[-1][0] + b"\0"):
            self.stack.pop()
        above = dict(self.stack)
        self.stack.append((key, f))
        lang, words = parts[0], parts[1:]
        cuts, inner = [], []
        for k in range(1, len(words)):
            left = b"\0".join([lang, *words[:k]])
            cuts.append({"k": k, "left": left, "l": above.get(left), "right": b"\0".join([lang, *words[k:]])})
        for size in range(2, len(words)):
            inner += [b"\0".join([lang, *words[i : i + size]]) for i in range(len(words) - size + 1)]
        return {"key": key, "f": f, "depth": len(words), "lang": _text_of(lang), "phrase": " ".join(map(_text_of, words)), "cuts": cuts, "inner": sorted(set(inner)), "open": False}

    def ends(self) -> list[dict]:
        return [{"key": k, "f": f, "depth": k.count(b"\0"), "lang": None, "phrase": None, "cuts": [], "inner": [], "open": True} for k, f in self.stack]


def merge(least: int):
    """Merges ranges of sorted parts of tries, the fourth column being the range: nodes of `least` occurrences, roots in any case, and the
    stack that each range ended with."""

    def run(batches):
        walk, now, key, held = Walk(), None, None, Counter()

        def done():
            stem = key[: key.rindex(b"\0") + 1] if key.count(b"\0") > 1 else key
            return [walk.node(stem + tail, f) for tail, f in sorted(held.items()) if f >= least or b"\0" not in key]

        for b in batches:
            rows = []
            for k, tails, counts, part in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if (part, k) != (now, key):
                    if key is not None:
                        rows += done()
                        if part != now:
                            rows += walk.ends()
                            walk = Walk()
                    now, key, held = part, k, Counter()
                for tail, c in zip(tails.split(b"\xff"), counts, strict=True):
                    held[tail] += c
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_NODE)
        if key is not None:
            yield pa.RecordBatch.from_pylist([*done(), *walk.ends()], schema=_NODE)

    return run


def quantiles(keys: pa.Array, n: np.ndarray, parts: int) -> tuple[pa.Array, np.ndarray]:
    """(some of the keys in order, the weight up to each since the one before) at equal steps of the weights n, `parts` keys at most."""
    order = pc.array_sort_indices(keys).to_numpy()
    upto = np.cumsum(n[order])
    at = np.unique(np.searchsorted(upto, np.arange(1, parts + 1) * (upto[-1] / parts)).clip(max=len(upto) - 1)) if len(upto) else order
    return keys.take(pa.array(order[at])), np.diff(np.append(0, upto[at]))


def bounds(docs: DataFrame, size: int, depth: int, often, parts: int) -> list[bytes]:
    """Ascending keys, `parts` at most, that cut the rows of tries into ranges of about equal size. They are those of about SAMPLE bytes of
    the `size` bytes of text; only how work is dealt depends on them."""

    def run(batches):
        for shard in shards(batches):
            t = trie(shard, depth, often)
            keys, n = quantiles(t.column("key"), pc.list_value_length(t.column("counts")).to_numpy().astype(np.int64), parts)
            yield pa.RecordBatch.from_arrays([keys, pa.array(n)], names=["key", "n"])

    some = docs if size <= SAMPLE else docs.where(F.rand(11) < SAMPLE / size)
    t = some.repartition(2).mapInArrow(run, "key binary, n bigint").toArrow().combine_chunks()
    if not t.num_rows:
        return []
    keys, _ = quantiles(t.column("key").combine_chunks(), t.column("n").to_numpy(), parts)
    return sorted(set(keys.to_pylist()))


class _Often:
    """Whether runs may be frequent, by a broadcast sketch."""

    def __init__(self, maps, bits: int):
        self.maps, self.bits = maps, bits

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        return _sketch.repeated(self.maps.value, self.bits, hashes)


def nodes(docs: DataFrame, depth: int = DEPTH, least: int = LEAST) -> DataFrame:
    """The merged trie, stored: nodes of `least` occurrences, with what their cuts and inner phrases lead to, and rows of open ends."""
    spark = ship(docs.sparkSession)
    docs = docs.select("text", F.col("lang").cast("string").alias("lang"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = _sketch.width(size // 64)  # about two words and pairs for six bytes; some five counts a cell are far below `least`

    often: dict = {}  # by number of words
    for shortest, longest in ((1, 2), (3, depth)):

        def counted(batches):
            s = _sketch.PartSketch(bits, 1, least)
            for shard in shards(batches):
                words, w, pieces, langs, names = shard.coded()
                for d, _, h in runs_of(_hashes(words, w, langs, names), pieces, longest, often):
                    if d >= shortest:
                        yield from s.add(h)
            yield from s.flush()

        if shortest <= depth:
            maps = spark.sparkContext.broadcast(_sketch.merged(docs.mapInArrow(counted, _sketch.SKETCH), bits, 1, least))
            often |= {d: _Often(maps, bits) for d in range(shortest, longest + 1)}

    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges = spark.sparkContext.broadcast(bounds(docs, size, depth, often, parts))

    def tries(batches):
        for shard in shards(batches):
            t = trie(shard, depth, often)
            part = [bisect_right(edges.value, x) for x in t.column("key").to_pylist()]
            yield pa.RecordBatch.from_arrays([*t.columns, pa.array(part, pa.int32())], names=["key", "tails", "counts", "part"])

    made = docs.mapInArrow(tries, "key binary, tails binary, counts array<bigint>, part int")
    ranges = made.repartition("part").sortWithinPartitions("part", "key")
    return stored(ranges.mapInArrow(merge(least), NODE), "phrases-nodes")


def _exact(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(19,0)")


def collocations(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, ranks: int = MOST_RANKS, percent: int = PERCENT) -> DataFrame:
    """The first `ranks` phrases of 2 to `depth` words of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase's score is that of its worst cut in two, SCALE * a / (l + r), rounded down. Phrases of fewer than `least` occurrences are
    left out, and those that stand inside a longer one which has `percent` of their occurrences or more. Null and blank texts have no
    words, a null lang is `und`; repeated rows count each; no frequent phrase: no rows. Ties go by a, then by the phrase's bytes. Other
    columns are not read.
    """
    all_ = nodes(docs, depth, least)
    real = all_.where("not open")
    ends = F.broadcast(all_.where("open").select(F.col("key").alias("left"), F.col("f").alias("end")))  # a path's length a range
    cuts = real.where("depth > 1").select("key", "f", F.explode("cuts").alias("c")).select("key", "f", "c.*")
    cuts = cuts.join(ends, "left", "left").select("key", "f", "k", "right", F.coalesce("l", "end").alias("l"))
    cuts = cuts.join(real.select(F.col("key").alias("right"), F.col("f").alias("r")), "right")
    cuts = cuts.withColumn("lr", _exact("l") + _exact("r")).withColumn("times", _exact("f") * F.lit(SCALE).cast("decimal(10,0)"))
    cuts = cuts.select("key", F.struct(F.expr("times div lr").alias("score"), "k", "l", "r").alias("cut"))
    worst = cuts.groupBy("key").agg(F.min("cut").alias("cut"))
    inner = real.where("depth > 2").select("f", F.explode("inner").alias("key")).groupBy("key").agg(F.max("f").alias("within"))
    hundred, part = F.lit(100).cast("decimal(3,0)"), F.lit(percent).cast("decimal(3,0)")
    found = real.where("depth > 1").select("key", "lang", "phrase", F.col("f").alias("a")).join(worst, "key").join(inner, "key", "left")
    found = found.where(F.col("within").isNull() | (hundred * _exact("within") < part * _exact("a")))
    found = found.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", F.pmod(F.xxhash64("key"), F.lit(SALTS)).alias("salt"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for by in (["lang", "salt"], ["lang"]):  # the best of each part first, so that no language is one task
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= ranks)
    roots = real.where("depth = 0").select("lang", F.col("f").alias("n"))
    out = found.join(roots, "lang")
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def oracle() -> str:
    """The same rows in DuckDB SQL, by all runs of up to four words."""
    later = ", ".join(f"lead(w, {j}) OVER p AS w{j}" for j in range(1, DEPTH))
    runs = " UNION ALL ".join(f"SELECT lang, {d} AS d, {" || ' ' || ".join(['w', *(f'w{j}' for j in range(1, d))])} AS phrase FROM words" for d in range(1, DEPTH + 1))
    runs += " UNION ALL SELECT lang, 0, '' FROM words"
    return rf"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS t, regexp_split_to_array(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents WHERE text IS NOT NULL),
pieces AS (SELECT lang, row_number() OVER () AS p, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (SELECT lang, unnest(pieces) AS piece FROM texts)),
words AS MATERIALIZED (SELECT lang, w, {later} FROM (SELECT lang, p, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM pieces) WINDOW p AS (PARTITION BY p ORDER BY i)),
f AS MATERIALIZED (SELECT lang, d, phrase, count(*) AS f FROM ({runs}) WHERE phrase IS NOT NULL GROUP BY ALL),
candidates AS MATERIALIZED (SELECT lang, d, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE d > 1 AND f >= {LEAST}),
cuts AS (SELECT *, unnest(range(1, d)) AS k FROM candidates),
scored AS MATERIALIZED (
  SELECT c.*, l.f AS l, r.f AS r, n.f AS n, CAST(CAST(2000000 AS HUGEINT) * c.a // (l.f + r.f) AS BIGINT) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:k], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1:], ' ')
  JOIN f n ON n.lang = c.lang AND n.d = 0),
worst AS MATERIALIZED (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS MATERIALIZED (
  SELECT DISTINCT c.lang, c.phrase FROM candidates c JOIN (
    SELECT lang, a, array_to_string(w[i:i + s - 1], ' ') AS part FROM (
      SELECT lang, a, w, d, s, unnest(range(1, d - s + 2)) AS i FROM (SELECT *, unnest(range(2, d)) AS s FROM candidates WHERE d > 2))) o
  ON c.lang = o.lang AND c.phrase = o.part AND CAST(100 AS HUGEINT) * o.a >= CAST({PERCENT} AS HUGEINT) * c.a)
SELECT w.lang, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM (SELECT * FROM worst ANTI JOIN inside USING (lang, phrase)) w
QUALIFY rank <= {MOST_RANKS}"""
