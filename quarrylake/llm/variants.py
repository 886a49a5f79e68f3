"""Operator 12, spelling variant grouping: an even-partition pigeonhole join of words one edit apart.

A word of L code points is cut into two segments, the first of L // 2. One edit leaves one of them whole, so words of equal length
meet on a segment at its place, and a word one longer probes the index of L with its own first L // 2 code points and with its last
L - L // 2, which stand one place further on. Candidates are verified by edit distance, and those met on both segments counted once.

Segments shared by more than HOT entries aren't paired out: there the words must agree in all but one place of the other segment
too, so those entries meet on what is left of it without one code point. Such a group holds one word for each letter at most.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylake.llm._work import ship, stored

LEAST_LENGTH = 5
LEAST_COUNT = 3
EVERY = 97
HOT = 64
FACTOR = 2  # how many times as frequent as a word its form is
HELD = 300_000  # words counted by a task before it hands them on
PIECE = 1 << 20

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_GAP = re.compile("[^A-Za-zÀ-ÿ]")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _pieces(text: str) -> Iterator[str]:
    """A text in parts that end between runs."""
    at = 0
    while len(text) - at > PIECE:
        gap = _GAP.search(text, at + PIECE)
        if gap is None:
            break
        yield text[at : gap.start()]
        at = gap.start()
    yield text[at:] if at else text


def variants_of(doc_id: int | None, text: str | None) -> Iterator[tuple[str, int]]:
    """(word, occurrences) of a text: lower-cased runs, some of which lose a code point as the checksum of id and run says."""
    runs: Counter[str] = Counter()
    for part in _pieces(text or ""):
        runs.update(_RUN.findall(part.encode().translate(_LOWER).decode()))
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), start)
        if h % EVERY == 0:
            cut = h % len(run)
            run = run[:cut] + run[cut + 1 :]
        if len(run) >= LEAST_LENGTH:
            yield run, n


def vocabulary(docs: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words that occur `least` times or more; tasks hand on sums, so frequent words are few rows each."""
    ship(docs.sparkSession)

    def run(batches):
        held: Counter[str] = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for word, n in variants_of(i, text.as_py()):
                    held[word] += n
                if len(held) >= HELD:
                    yield out()
                    held.clear()
        yield out()

    counts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "word string, n bigint")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _cut(word: Column, at: Column) -> Column:
    """word without its code point at a place from 0."""
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))


def entries(words: DataFrame) -> DataFrame:
    """(size, part, segment, rest, longer, word, n): the two index entries of each word, and its two probes as the longer one."""
    m, w = F.length("word"), F.col("word")

    def entry(size: Column, part: int, longer: bool) -> Column:
        first = F.floor(size / 2).cast("int")
        last = size - first
        head = F.substring(w, F.lit(1), first if part == 1 else m - last)
        tail = F.substring(w, first + 1 if part == 1 else m - last + 1, m)
        segment, rest = (head, tail) if part == 1 else (tail, head)
        return F.struct(size.alias("size"), F.lit(part).alias("part"), segment.alias("segment"), rest.alias("rest"), F.lit(longer).alias("longer"))

    all_ = F.array(*[entry(m - int(longer), part, longer) for longer in (False, True) for part in (1, 2)])
    return words.select("word", "n", F.explode(all_).alias("e")).select("e.*", "word", "n")


KEY = ["size", "part", "segment"]


def near_pairs(words: DataFrame, hot: int = HOT) -> DataFrame:
    """(a, na, b, nb), each pair of words(word, n) that differ by one edit once."""
    rows = stored(entries(words), "variants-entries")
    counts = rows.groupBy(*KEY).agg(F.count("*").alias("c"), F.min("longer").alias("none_short")).where("c > 1 and not none_short")
    counts = stored(counts.select(*KEY, (F.col("c") > hot).alias("hot")), "variants-buckets")
    rows = stored(rows.join(counts, KEY), "variants-met")
    cold, warm = rows.where("not hot"), rows.where("hot")

    # Finer keys of hot segments: words of equal length by place and rest without it, words of unequal length by the shorter rest.
    places = F.sequence(F.lit(0), F.length("rest") - 1)
    without = F.transform(places, lambda j: F.struct(j.alias("place"), _cut(F.col("rest"), j).alias("left")))
    whole = F.array(F.struct(F.lit(-1).alias("place"), F.col("rest").alias("left")))
    shorter = F.array_distinct(F.transform(places, lambda j: F.struct(F.lit(-1).alias("place"), _cut(F.col("rest"), j).alias("left"))))
    fine = warm.select(*KEY, "longer", "word", "n", F.explode(F.when(F.col("longer"), shorter).otherwise(F.concat(without, whole))).alias("f")).select(*KEY, "longer", "word", "n", "f.*")

    def met(side: DataFrame, keys: list[str]) -> DataFrame:
        left, right = side.alias("l"), side.where("not longer").alias("r")
        same = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys]
        apart = F.col("l.longer") | (F.col("l.word") < F.col("r.word"))
        one = F.levenshtein(F.col("l.word"), F.col("r.word"), 1) == 1
        pairs = left.join(right, [*same, apart]).where(one)
        return pairs.select(F.col("l.word").alias("a"), F.col("l.n").alias("na"), F.col("r.word").alias("b"), F.col("r.n").alias("nb"))

    return met(cold, KEY).unionByName(met(fine, [*KEY, "place", "left"])).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms(word, form): the last word reached. Steps double, and forms are ever more frequent, so they end."""
    way = stored(forms.select("word", F.col("form").alias("root")), "variants-way")
    while True:
        on = way.select(F.col("word").alias("root"), F.col("root").alias("next"))
        way = stored(way.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "variants-way")
        if way.where("moved").isEmpty():
            return way.select("word", "root")
        way = way.select("word", "root")


def spelling_variants(docs: DataFrame, least: int = LEAST_COUNT, hot: int = HOT) -> DataFrame:
    """For each word: word, form (its near word of largest n, if that is FACTOR times its own or more, else null), root (the last word
    that forms lead to, or the word itself), n, n_near (words one edit apart), form_n.

    Null and blank texts have no words; a null doc_id counts as an empty one in the checksum. Repeated rows count each. Of near words of
    equal n the smallest in code-point order is the form. Empty table: no rows. Other columns are not read.
    """
    words = stored(vocabulary(docs, least), "variants-words")
    pairs = stored(near_pairs(words, hot), "variants-pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("nb").alias("near_n"))
    both = both.unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("na").alias("near_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    known = words.join(best, "word", "left")
    has_form = -F.col("best.less") >= FACTOR * F.col("n")
    known = known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has_form, F.col("best.near")).alias("form"), F.when(has_form, -F.col("best.less")).alias("form_n"))
    known = stored(known, "variants-known")
    out = known.join(roots(known.where("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def oracle() -> str:
    """The same rows in DuckDB SQL: checksums by a table of 256 remainders, near words by the places where they may differ."""
    step = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END"
    chain = "b0.i AS v0, " + ", ".join(f"{step.format(f'v{k}')} AS v{k + 1}" for k in range(8))
    return f"""
WITH bits AS (SELECT list(v8 ORDER BY i) AS t FROM (SELECT i, {chain} FROM (SELECT range AS i FROM range(256)) b0)),
runs AS (
  SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL),
bytes AS (
  SELECT run, n, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END)) AS b FROM runs),
sums AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, bits),
words AS (
  SELECT CASE WHEN h % {EVERY} = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word,
    CAST(sum(n) AS BIGINT) AS n FROM sums GROUP BY 1 HAVING length(word) >= {LEAST_LENGTH} AND sum(n) >= {LEAST_COUNT}),
places AS (SELECT word, n, unnest(range(length(word))) AS p FROM words),
less AS (SELECT word, n, p, substr(word, 1, p) || substr(word, p + 2) AS rest FROM places),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.p = b.p AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, min((-near_n, near)) AS m FROM pairs GROUP BY word),
known AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -m[1] >= {FACTOR} * n THEN m[2] END AS form, CASE WHEN -m[1] >= {FACTOR} * n THEN -m[1] END AS form_n
  FROM words w LEFT JOIN best USING (word)),
way(word, root, far) AS (
  WITH RECURSIVE go(word, root, far) AS (
    SELECT word, word, 0 FROM known UNION ALL SELECT go.word, k.form, far + 1 FROM go JOIN known k ON go.root = k.word WHERE k.form IS NOT NULL)
  SELECT word, max_by(root, far), max(far) FROM go GROUP BY word)
SELECT word, form, root, n, n_near, CAST(form_n AS BIGINT) AS form_n FROM known JOIN way USING (word)"""
