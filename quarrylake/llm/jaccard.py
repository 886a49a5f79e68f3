"""Operator 7, n-gram Jaccard join: grouped prefix join over sets of 5-word shingles, and the components of its links.

Documents with equal sets form a class, documents of equal size and prefix a group. Under one total order of shingles (rarely
seen ones first) two sets of n and m shingles can only reach the threshold if their prefixes, n - ceil(0.8 n) + 1 shingles,
meet; what lies behind one of the prefixes bounds the rest of the overlap, so the number of shared prefix shingles filters group
pairs as well. Shingles of prefixes seen once are left out by a count-min sketch, which never misses one seen twice. First each
bucket's groups are held against one leader; then, since components are asked for, only pairs of groups that are still in
different components are expanded to classes and verified by exact set overlap. So a large group of near copies costs a star, not
all pairs, and no link that could join components is left unverified.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylake.llm import _sketch, _text
from quarrylake.llm._work import bitmap, hits, ship, stored, without
from quarrylake.llm.components import components

HOT_LIST = 1 << 18
HOT_IN_BATCH = 2
DOC_BITS = 24
PERCENT = 80
K = 5
ROW = "_quarrylake_row"


def _need(n, percent: int):
    return (percent * n + 99) // 100


def hot_shingles(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, counts) of at most HOT_LIST shingles that are frequent in batches of rows. Only the order of prefixes depends on it."""

    def run(batches):
        for batch in batches:
            sets = []
            for b in _text.blocks(batch):
                data, offs = _text.bytes_of(b.column(0))
                (h,), first = _text.words(data, offs, lower=True)
                sets += _text.shingle_sets(h, first, k)
            u, n = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            u, n = u[n >= HOT_IN_BATCH], n[n >= HOT_IN_BATCH]
            yield pa.RecordBatch.from_arrays([_text.longs(u), pa.array(n.astype(np.int64))], names=["s", "n"])

    t = docs.select("text").mapInArrow(run, "s bigint, n bigint").groupBy("s").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "s").limit(HOT_LIST).toArrow()
    s, n = t.column("s").to_numpy().view(np.uint64), t.column("n").to_numpy()
    o = np.argsort(s)
    return s[o], n[o]


def _set_ids(u: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    n = np.full(1, len(u), np.uint64)
    out = []
    for salt in (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47):
        total = _text.mix(u ^ np.uint64(salt)).sum(dtype=np.uint64, keepdims=True)
        out.append(int((total + n * np.uint64(salt | 1)).view(np.int64)[0]))
    return out[0], out[1]


def prefixes(docs: DataFrame, percent: int, k: int) -> DataFrame:
    """doc_id, h (a hash of the text), n, the class (a, b), the group gid, and prefix, for every document."""
    hot = docs.sparkSession.sparkContext.broadcast(hot_shingles(docs, k))

    def run(batches):
        hot_s, hot_n = hot.value
        for batch in batches:
            for b in _text.blocks(batch):
                data, offs = _text.bytes_of(b.column(1))
                (h,), first = _text.words(data, offs, lower=True)
                ns, ids, gids, heads = [], [], [], []
                for u in _text.shingle_sets(h, first, k):
                    ns.append(len(u))
                    if not len(u):
                        ids.append((None, None)), gids.append(None), heads.append(u)
                        continue
                    if len(hot_s):
                        at = np.minimum(np.searchsorted(hot_s, u), len(hot_s) - 1)
                        u2 = u[np.lexsort((u, np.where(hot_s[at] == u, hot_n[at], 0)))]
                    else:
                        u2 = u
                    p = u2[: len(u) - _need(len(u), percent) + 1]
                    ids.append(_set_ids(u))
                    gids.append(int(np.uint64(_text.prints(np.append(p, np.uint64(len(u))))).view(np.int64)))
                    heads.append(p)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in heads])]).astype(np.int32)), _text.longs(np.concatenate(heads)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(ns, pa.int64()), pa.array([x[0] for x in ids], pa.int64()), pa.array([x[1] for x in ids], pa.int64()), pa.array(gids, pa.int64()), lists], names=["doc_id", "h", "n", "a", "b", "gid", "prefix"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h")).mapInArrow(run, "doc_id bigint, h bigint, n bigint, a bigint, b bigint, gid bigint, prefix array<bigint>")


def _buckets(table: DataFrame) -> DataFrame:
    """(token, gid, n, pos), once for each group, without the tokens seen once."""
    total = table.agg(F.sum(F.size("prefix"))).first()[0] or 0
    bits = _sketch.width(total)

    def flat(batch):
        yield batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)

    maps = table.sparkSession.sparkContext.broadcast(_sketch.merged(_sketch.sketched(table.select("prefix"), flat, bits), bits))

    def run(batches):
        for b in batches:
            lists = b.column(2)
            lens = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            tok = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            row = np.repeat(np.arange(b.num_rows), lens)
            pos = np.arange(len(tok)) - np.repeat(np.cumsum(lens) - lens, lens)
            keep = np.flatnonzero(_sketch.repeated(maps.value, bits, tok))
            row = row[keep]
            yield pa.RecordBatch.from_arrays([_text.longs(tok[keep]), b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array(pos[keep].astype(np.int64))], names=["token", "gid", "n", "pos"])

    rows = table.where("n > 0").select("gid", "n", "prefix").mapInArrow(run, "token bigint, gid bigint, n bigint, pos bigint")
    return rows.distinct()


def _near_sizes(percent: int):
    return 100 * F.least("l.n", "r.n") >= percent * F.greatest("l.n", "r.n")


def _first_shared(percent: int):
    """What holds of the first shingle that two sets of enough overlap share: all of the overlap is here or further on."""
    here = F.least(F.col("l.n") - F.col("l.pos"), F.col("r.n") - F.col("r.pos"))
    return (100 + percent) * here >= percent * (F.col("l.n") + F.col("r.n"))


def _least_shared(percent: int):
    """How many prefix shingles two sets of n1 and n2 with enough overlap share: the rest is behind the prefix that ends first."""
    behind = lambda n: F.floor(n * percent / 100.0 + 0.999999) - 1
    return F.ceil(percent * (F.col("n1") + F.col("n2")) / (100 + percent) - 1e-6) - F.greatest(behind(F.col("n1")), behind(F.col("n2")))


def _verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, percent: int, k: int) -> DataFrame:
    """pairs(u, v) of classes with `linked`, by exact overlap; only the texts of their classes are read into sets."""
    spark = docs.sparkSession
    ends = pairs.select(F.col("u").alias("c")).union(pairs.select(F.col("v").alias("c"))).distinct()
    bits = spark.sparkContext.broadcast(bitmap(ends.join(reps, "c").select(F.xxhash64("doc_id").alias("h")), "h", DOC_BITS))

    def run(batches):
        for batch in batches:
            at = np.flatnonzero(hits(bits.value, DOC_BITS, batch.column(0).to_numpy().view(np.uint64)))
            if not len(at):
                continue
            for b in _text.blocks(batch.take(pa.array(at))):
                data, offs = _text.bytes_of(b.column(1))
                (h,), first = _text.words(data, offs, lower=True)
                sets = [u for u in _text.shingle_sets(h, first, k) if len(u)]
                ids = [_set_ids(u) for u in sets]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)), _text.longs(np.concatenate(sets) if sets else np.zeros(0, np.uint64)))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in ids], pa.int64()), pa.array([x[1] for x in ids], pa.int64()), lists], names=["a", "b", "s"])

    sets = docs.select(F.xxhash64(F.col("doc_id").cast("long")).alias("h"), "text").mapInArrow(run, "a bigint, b bigint, s array<bigint>")
    sets = sets.select(F.struct("a", "b").alias("c"), "s").groupBy("c").agg(F.first("s").alias("s"))
    sets = stored(sets, "jaccard-sets")
    one = sets.select(F.col("c").alias("u"), F.col("s").alias("su"))
    two = sets.select(F.col("c").alias("v"), F.col("s").alias("sv"))
    both = F.size(F.array_intersect("su", "sv"))
    return pairs.join(one, "u").join(two, "v").select("u", "v", (100 * both >= percent * (F.size("su") + F.size("sv") - both)).alias("linked"))


def members(docs: DataFrame, percent: int = PERCENT, k: int = K) -> DataFrame:
    """For each row of docs: doc_id, h (a hash of the text), n (shingles), its class a, b, component_id, and first: whether class and doc_id
    are those that stand for its component, of its smallest doc_id (nulls last) and then smallest class. Rows without shingles have no
    class, and are first."""
    ship(docs.sparkSession)
    table = stored(prefixes(docs, percent, k), "jaccard-prefixes")
    classes = table.where("n > 0").groupBy("gid", F.struct("a", "b").alias("c")).agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"))
    classes = stored(classes, "jaccard-classes")
    reps = classes.select("c", "doc_id")
    buckets = stored(_buckets(table), "jaccard-buckets")

    def expanded(groups: DataFrame) -> DataFrame:
        of = classes.select("gid", "c")
        x = groups.join(of.select(F.col("gid").alias("g1"), F.col("c").alias("c1")), "g1").join(of.select(F.col("gid").alias("g2"), F.col("c").alias("c2")), "g2")
        return x.where("c1 != c2").select(F.least("c1", "c2").alias("u"), F.greatest("c1", "c2").alias("v"))

    # Stars: each bucket's groups, and each group's classes, against a leader. The leader has the fewest rarer shingles before the
    # bucket's, so of near copies it is the one with the fewest changes of its own.
    lead = buckets.groupBy("token").agg(F.min(F.struct("pos", "gid", "n")).alias("m"), F.count("*").alias("size")).where("size > 1").select("token", "m.gid", "m.n")
    lead = stored(lead, "jaccard-leaders")  # a join of two stored tables can be split where a token is hot
    star = buckets.alias("l").join(lead.alias("r"), "token").where("l.gid != r.gid").where(_near_sizes(percent))
    star = star.groupBy(F.col("l.gid").alias("g1"), F.col("r.gid").alias("g2"), F.col("l.n").alias("n1"), F.col("r.n").alias("n2")).agg(F.count("*").alias("shared"))
    star = star.where(F.col("shared") >= _least_shared(percent)).select("g1", "g2")
    first = classes.groupBy("gid").agg(F.min("c").alias("m"), F.count("*").alias("size")).where("size > 1").select("gid", "m")
    inner = classes.join(first, "gid").where("c != m").select(F.col("m").alias("u"), F.col("c").alias("v"))
    stars = stored(_verified(stored(expanded(star).union(inner).distinct(), "jaccard-stars"), docs, reps, percent, k), "jaccard-starlinks")
    links = stars.where("linked").select("u", "v")
    label = components(links).select(F.col("node").alias("c"), F.col("component").alias("label"))

    # What is left: pairs in different components.
    state = classes.join(label, "c", "left").select("gid", "c", F.coalesce("label", "c").alias("label"))
    state = stored(state, "jaccard-state")
    groups = state.groupBy("gid").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    groups = groups.select("gid", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("label"))
    open_ = buckets.join(groups, "gid")
    mixed = open_.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n_all"), F.count("label").alias("n_one"))
    mixed = mixed.where("n_all > 1 and (n_one < n_all or lo != hi)").select("token")
    open_ = stored(open_.join(mixed, "token", "left_semi"), "jaccard-open")
    rest = open_.alias("l").join(open_.alias("r"), (F.col("l.token") == F.col("r.token")) & (F.col("l.gid") < F.col("r.gid")) & ~F.coalesce(F.col("l.label") == F.col("r.label"), F.lit(False)) & _near_sizes(percent) & _first_shared(percent))
    rest = rest.select(F.col("l.gid").alias("g1"), F.col("r.gid").alias("g2"), F.col("l.n").alias("n1"), F.col("r.n").alias("n2")).distinct()
    heads = buckets.join(open_.select("gid").distinct(), "gid", "left_semi").groupBy("gid").agg(F.collect_list("token").alias("head"))
    rest = rest.join(heads.select(F.col("gid").alias("g1"), F.col("head").alias("h1")), "g1").join(heads.select(F.col("gid").alias("g2"), F.col("head").alias("h2")), "g2")
    rest = expanded(rest.where(F.size(F.array_intersect("h1", "h2")) >= _least_shared(percent)).select("g1", "g2"))
    split = groups.where("label is null").select("gid")
    some = state.join(split, "gid", "left_semi").select("gid", "c", "label")
    within = some.alias("l").join(some.alias("r"), (F.col("l.gid") == F.col("r.gid")) & (F.col("l.c") < F.col("r.c")) & (F.col("l.label") != F.col("r.label")))
    rest = rest.union(within.select(F.col("l.c").alias("u"), F.col("r.c").alias("v"))).distinct()
    of = state.select("c", "label")
    rest = rest.join(of.select(F.col("c").alias("u"), F.col("label").alias("lu")), "u").join(of.select(F.col("c").alias("v"), F.col("label").alias("lv")), "v").where("lu != lv").select("u", "v")
    rest = stored(rest.join(stars.select("u", "v"), ["u", "v"], "left_anti"), "jaccard-rest")
    links = links.union(_verified(rest, docs, reps, percent, k).where("linked").select("u", "v"))
    final = components(stored(links, "jaccard-links")).select(F.col("node").alias("c"), F.col("component").alias("label"))
    named = reps.join(final, "c", "left").select("c", "doc_id", F.coalesce("label", "c").alias("label"))
    low = named.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "c")).alias("m"))
    named = named.join(low, "label").select(F.col("c.a").alias("a"), F.col("c.b").alias("b"), "component_id", F.when(F.col("c") == F.col("m.c"), F.struct(F.col("m.doc_id").alias("id"))).alias("stands"))
    out = table.join(named, ["a", "b"], "left")
    first = F.col("stands").isNotNull() & F.col("doc_id").eqNullSafe(F.col("stands.id"))
    return out.select("doc_id", "h", "n", "a", "b", F.coalesce("component_id", "doc_id").alias("component_id"), ((F.col("n") == 0) | F.coalesce(first, F.lit(False))).alias("first"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, k: int = K) -> DataFrame:
    """For each row of docs: doc_id, n_shingles, component_id, the smallest doc_id reachable by links of Jaccard >= percent / 100.

    Null or blank texts: an empty set, linked with nothing, component_id = doc_id. Texts of fewer than k words: one shingle, the
    whole sequence. Repeated rows and equal texts: each row is returned, all in one component. Null doc_id: the row is returned
    with its component's smallest id (null if all are null). Empty table: no rows. Other columns are not read.
    """
    return members(docs, percent, k).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def deduplicated(docs: DataFrame, percent: int = PERCENT, k: int = K) -> DataFrame:
    """docs with one row of each component of near duplicates: of its smallest doc_id, nulls last.

    Rows are told apart by doc_id and text, so rows of one id with different texts go or stay each for themselves, and of rows that repeat
    one another one stays. Rows without words stay.
    """
    docs = docs.withColumn(ROW, F.struct(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("h")))
    rows = members(docs, percent, k).select(F.struct(F.col("doc_id").alias("id"), "h").alias(ROW), "n", "a", "b", "first")
    rows = stored(rows.withColumn("id", F.col(f"{ROW}.id")), "jaccard-documents")
    again = rows.where("first and n > 0").groupBy("id", "a", "b").agg(F.count("*").alias("c"), F.min(f"{ROW}.h").alias("h")).where("c > 1")
    again = stored(again, "jaccard-again")  # rows that stand for one component together
    crowd = rows.where("first and n > 0").join(again.select(F.col("id").alias("i"), "a", "b"), ["a", "b"]).where(F.col("id").eqNullSafe(F.col("i"))).select(ROW)
    one = again.select(F.struct("id", "h").alias("stays"))
    rest = without(docs, ROW, rows.where("not first").select(ROW).union(crowd))
    some = docs.join(one, F.col(ROW).eqNullSafe(F.col("stays")), "left_semi").dropDuplicates([ROW])
    return rest.unionByName(some).drop(ROW)
