"""Operator 8, mixing sources to target weights by weighted fair queueing.

Documents are shuffled within their source by a digest of seed and doc_id, and each is offered up to EPOCHS times. An offer's
virtual finish time is the words of its source up to the offer's middle, divided by the source's target. Offers are put in one
global order of finish times and cut where the words taken reach the total budget, so every source stands within about half a
document of its target. Running sums, within sources and over all, are made in two steps, by range and inside each range, so a
source that holds most rows is no single task's work.

What a source gives in an epoch is a prefix of its shuffled documents, so all sums run over a narrow stored table of keys and sizes,
and the outcome is one bound for each source and epoch; the documents themselves are only held against these bounds, in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylake.llm._work import sent, shared_dir, stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
EPOCHS = 2
SEED = "mix-1"
RANGES = 4096  # of finish times below 2; the digest's ranges are its first three hexadecimal digits


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = EPOCHS) -> DataFrame:
    """source, source_size, target from one row of each source.

    Sources in order of code points, null last, have the weights in turn. A budget of share times all sizes is split by weight; a
    source stops at `most` times its size and the rest is split again, until none is above. Sources fill up in order of size by
    weight, so running sums in that order give the final level.
    """
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", w.cast("long"))
    up = Window.orderBy(F.col("source_size") / F.col("w"), "w", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    s = s.withColumn("full", F.coalesce(F.sum("source_size").over(up), F.lit(0))).withColumn("done", F.coalesce(F.sum("w").over(up), F.lit(0)))
    s = s.withColumn("all_w", F.sum("w").over(everything)).withColumn("all_size", F.sum("source_size").over(everything))
    # The level if this source and all after it stay below their stops; it holds from the first source whose stop it doesn't reach.
    s = s.withColumn("level", (F.lit(float(share)) * F.col("all_size") - F.lit(float(most)) * F.col("full")) / (F.col("all_w") - F.col("done")))
    s = s.withColumn("open", F.col("level") * F.col("w") <= F.lit(float(most)) * F.col("source_size"))
    s = s.withColumn("level", F.min(F.when(F.col("open"), F.struct(F.col("source_size") / F.col("w"), "w", "done", "level"))).over(everything)["level"])
    t = F.least(F.coalesce(F.col("level") * F.col("w"), F.lit(float(most)) * F.col("source_size")), F.lit(float(most)) * F.col("source_size"))
    return s.select("source", "source_size", t.cast("double").alias("target"))


def keyed(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """docs(row, doc_id, source, text) as row, source, at: the place in the shuffled source (digest k, hash of the text, size)."""
    k = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    return docs.select("row", "source", F.struct(k.alias("k"), F.xxhash64("text").alias("tie"), word_count().alias("size")).alias("at"))


def scheduled(places: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """From places(source, at), one row a document: source, at, c (rows in this place), j (the row's number among them), size,
    start (words of the source before the row), source_size, target."""
    d = stored(places.groupBy("source", "at").agg(F.count("*").alias("c")), "mixing-places")
    d = d.select("source", "at", "c", F.substring("at.k", 1, 3).alias("range"), (F.col("c") * F.col("at.size")).alias("words"))
    parts = d.groupBy("source", "range").agg(F.sum("words").alias("part"))
    parts = parts.withColumn("before", F.coalesce(F.sum("part").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    goal = targets(parts.groupBy("source").agg(F.sum("part").alias("source_size")), weights, share, epochs)
    parts = parts.withColumnsRenamed({"source": "s", "range": "r"}).join(goal, F.col("s").eqNullSafe(F.col("source"))).select("s", "r", "before", "source_size", "target")
    inside = Window.partitionBy("source", "range").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("inside", F.coalesce(F.sum("words").over(inside), F.lit(0)))
    d = d.join(parts, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r"))).withColumn("j", F.explode(F.sequence(F.lit(1).cast("long"), "c")))
    size = F.col("at.size")
    return d.select("source", "at", "c", "j", size.alias("size"), (F.col("before") + F.col("inside") + (F.col("j") - 1) * size).alias("start"), "source_size", "target")


def finish(epoch: int) -> Column:
    """Virtual finish time, at the document's middle, of its offer in an epoch."""
    return (F.lit(epoch) * F.col("source_size") + F.col("start") + F.col("size") / 2) / F.col("target")


def cut(plan: DataFrame, epochs: int, share: float) -> tuple[float, str, int] | None:
    """The first offer, as (finish, k, epoch), that no longer fits the budget; None if all fit. One row reaches the driver."""
    offers = plan.where("size > 0").select("size", "at.k", F.explode(F.array(*[F.struct(finish(e).alias("f"), F.lit(e).alias("e")) for e in range(epochs)])).alias("o")).select("size", "k", "o.f", "o.e")
    offers = offers.withColumn("range", F.least(F.floor(F.col("f") * (RANGES / epochs)), F.lit(RANGES)).cast("int"))
    sums = offers.groupBy("range").agg(F.sum("size").alias("part"))
    up = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # RANGES + 1 rows at most
    sums = sums.withColumn("before", F.coalesce(F.sum("part").over(up), F.lit(0))).withColumn("budget", F.lit(float(share)) * F.sum("part").over(Window.partitionBy()) / epochs)
    at = sums.where("before + part >= budget").orderBy("range").first()
    if at is None:
        return None
    run = Window.orderBy("f", "k", "e").rowsBetween(Window.unboundedPreceding, -1)  # of one range
    one = offers.where(F.col("range") == at["range"]).withColumn("before", F.lit(at["before"]) + F.coalesce(F.sum("size").over(run), F.lit(0)))
    first = one.where(F.col("before") + F.col("size") / 2 > F.lit(at["budget"])).orderBy("f", "k", "e").first()
    return (first["f"], first["k"], first["e"]) if first else (epochs * (at["range"] + 1) / RANGES, "", 0)


def bounds(plan: DataFrame, last: tuple[float, str, int] | None, epochs: int) -> DataFrame:
    """For each source: own, source_size, target, and for each epoch e to_e, the last place (at, j, c) that the mix takes, or null."""
    out = []
    for e in range(epochs):
        before = F.lit(True) if last is None else F.struct(finish(e), F.col("at.k"), F.lit(e)) < F.struct(F.lit(last[0]), F.lit(last[1]), F.lit(last[2]))
        out.append(F.max(F.when((F.col("size") > 0) & before, F.struct("at", "j", "c"))).alias(f"to_{e}"))
    return plan.groupBy(F.col("source").alias("own"), "source_size", "target").agg(*out)


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """For each row of docs: its columns and size, source_size, target (of its source), taken (words the mix takes, repeats counted).

    taken is 0 to epochs times size, in whole documents. Null and blank texts have size 0 and are never taken. A null source is a
    source of its own, after all others. Reruns agree: rows of equal doc_id follow by a hash of their text, and of equal rows as many
    are taken as fit. Empty table, or no words at all: nothing is taken. docs keeps all its columns; where it has one of an added
    name, in any case of letters, the added one is called mix_<name>.
    """
    shared_dir(docs.sparkSession)
    rows = keyed(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "source", "text"), seed)
    plan = stored(scheduled(keyed(docs.select(F.lit(0).alias("row"), "doc_id", "source", "text"), seed).drop("row"), weights, share, epochs), "mixing-plan")
    to = stored(bounds(plan, cut(plan, epochs, share), epochs), "mixing-bounds")
    shared = to.agg(F.max(F.greatest(*(F.col(f"to_{e}.c") for e in range(epochs)))) if epochs > 1 else F.max("to_0.c")).first()[0] or 0
    rows = rows.join(sent(to), F.col("source").eqNullSafe(F.col("own")), "left")
    at, ends = F.col("at"), [F.col(f"to_{e}") for e in range(epochs)]
    rows = rows.withColumn("j", F.lit(1).cast("long"))
    if shared > 1:  # equal rows at a bound, of which only some are taken
        split = F.lit(False)
        for x in ends:
            split = split | F.coalesce((at == x["at"]) & (x["c"] > 1), F.lit(False))
        number = F.row_number().over(Window.partitionBy("source", "at").orderBy(F.xxhash64("row"))).cast("long")
        rows = rows.where(~split).unionByName(rows.where(split).withColumn("j", number))
    taken = F.lit(0)
    for x in ends:
        taken = taken + F.when((at["size"] > 0) & ((at < x["at"]) | ((at == x["at"]) & (F.col("j") <= x["j"]))), at["size"]).otherwise(0)
    have = {c.lower() for c in docs.columns}
    added = {"size": at["size"], "source_size": F.col("source_size"), "target": F.col("target"), "taken": taken.cast("long")}
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], *[v.alias(f"mix_{n}" if n in have else n) for n, v in added.items()])


def oracle(weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED, docs: str = "documents") -> str:
    """The same in DuckDB's SQL."""
    w = " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(weights))
    offers = " UNION ALL ".join(f"SELECT size, k, ({e} * source_size + start + size / 2) / target AS f, {e} AS e FROM plan WHERE size > 0" for e in range(epochs))
    took = " + ".join(f"CASE WHEN size > 0 AND (n.f IS NULL OR (({e} * source_size + start + size / 2) / target, plan.k, {e}) < (n.f, n.k, n.e)) THEN size ELSE 0 END" for e in range(epochs))
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')), 0)::BIGINT AS size, md5('{seed}:' || coalesce(doc_id::VARCHAR, 'null')) AS k FROM {docs}),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} {w} END::BIGINT AS w FROM s),
u AS (SELECT *, coalesce(sum(source_size) OVER o, 0)::BIGINT AS full_, coalesce(sum(w) OVER o, 0)::BIGINT AS done, (sum(w) OVER ())::BIGINT AS all_w, (sum(source_size) OVER ())::BIGINT AS all_size
  FROM w WINDOW o AS (ORDER BY source_size / w, w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT *, ({share}::DOUBLE * all_size - {epochs}::DOUBLE * full_) / (all_w - done) AS level FROM u),
x AS (SELECT arg_min(level, (source_size / w, w, done)) AS level FROM v WHERE level * w <= {epochs}::DOUBLE * source_size),
t AS (SELECT source, source_size, least(coalesce(x.level * w, {epochs}::DOUBLE * source_size), {epochs}::DOUBLE * source_size) AS target FROM v CROSS JOIN x),
plan AS (SELECT d.doc_id, d.size, d.k, t.source_size, t.target, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
o AS ({offers}),
r AS (SELECT *, coalesce(sum(size) OVER (ORDER BY f, k, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, {share}::DOUBLE * (sum(size) OVER ()) / {epochs} AS budget FROM o),
n AS (SELECT min(f) AS f, arg_min(k, (f, k, e)) AS k, arg_min(e, (f, k, e)) AS e FROM r WHERE before + size / 2 > budget)
SELECT doc_id, size, source_size, target, ({took})::BIGINT AS taken FROM plan CROSS JOIN n
"""
