"""A substring index of search texts: posting lists of trigrams, the rarest grams' lists intersected, and an exact check.

A query asks for concepts whose search text holds each of its tokens, anywhere, inside words as well. Tokens are runs of a-z and 0-9,
so the grams indexed are the distinct runs of three such characters of a text, those of one and two for short tokens, and the empty
gram, which every text has, for queries without tokens. A text that holds a token holds all of its grams; of a query's grams the RAREST
with the fewest postings give candidates, and the texts of candidates alone are looked at. All of this is equi joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylake.functions import search_text, tokenize
from quarrylake.operators.catalog import matches, tokens_of
from quarrylake.storage import checkpointed

SIZE = 3
RAREST = 4
SPLIT = 16  # parts of a gram's list, so that none of a frequent one is a task's alone
SMALL = 100_000  # rows of asked grams that are broadcast


def grams(text: Column) -> Column:
    """The distinct grams of 0 to SIZE characters of a lower-cased text, in one pass for each size."""
    runs = [F.regexp_extract_all(text, F.lit(f"(?=([a-z0-9]{{{n}}}))"), F.lit(1)) for n in range(1, SIZE + 1)]
    return F.array_distinct(F.concat(F.array(F.lit("")), *runs))


def token_grams(tokens: Column) -> Column:
    """The grams that a text with all tokens must hold: the longest there are of each token, or the empty one if there is none."""

    def of(token: Column) -> Column:
        size = F.least(F.length(token), F.lit(SIZE))
        return F.transform(F.sequence(F.lit(1), F.length(token) - size + 1), lambda i: F.substring(token, i, size))

    return F.when(F.size(tokens) == 0, F.array(F.lit(""))).otherwise(F.array_distinct(F.flatten(F.transform(tokens, of))))


def postings(concepts: DataFrame) -> DataFrame:
    """(gram, id), a row for each gram of each concept's search text."""
    return concepts.select("id", F.explode(grams(search_text())).alias("gram")).select("gram", "id")


def frequencies(lists: DataFrame) -> DataFrame:
    """(gram, n): the lengths of posting lists."""
    return lists.groupBy("gram").agg(F.count("*").alias("n"))


def candidates(asked: DataFrame, lists: DataFrame, counts: DataFrame, rarest: int = RAREST) -> DataFrame:
    """(query_id, id) of concepts in all lists of the `rarest` grams of asked(query_id, tokens) that have the shortest ones.

    A gram without a list has length 0, so a query with one is left without candidates.
    """
    each = asked.select("query_id", F.explode(token_grams(F.col("tokens"))).alias("gram")).join(counts, "gram", "left")
    ranked = each.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))), 1, rarest).alias("best"))
    chosen = ranked.select("query_id", F.size("best").alias("k"), F.explode("best.gram").alias("gram"))
    return chosen.join(lists, "gram").groupBy("query_id", "k", "id").agg(F.count("*").alias("held")).where("held = k").select("query_id", "id")


def search_each(concepts: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, id) for each of queries(query_id, query) and concept whose search text holds all its tokens, without an index at hand:
    only the grams that some query asks for get posting lists.

    Queries without tokens are met by every concept, null ones by none. Repeated query_ids are an error of the caller's: they count as
    one query each.
    """
    asked = checkpointed(queries.where("query is not null").select("query_id", tokenize("query").alias("tokens")))
    wanted = checkpointed(asked.select(F.explode(token_grams(F.col("tokens"))).alias("gram")).distinct())
    small = wanted.count() <= SMALL  # at most SMALL strings of three characters
    lists = checkpointed(postings(concepts).join(F.broadcast(wanted) if small else wanted, "gram", "left_semi"))
    found = candidates(asked, lists, frequencies(lists))
    return checked(found, asked, concepts)


def checked(found: DataFrame, asked: DataFrame, concepts: DataFrame) -> DataFrame:
    """Those of found(query_id, id) whose search text holds all tokens of asked(query_id, tokens)."""
    texts = concepts.select("id", search_text().alias("text"))
    pairs = found.join(asked, "query_id").join(texts, "id")
    return pairs.where(F.forall("tokens", lambda t: F.contains(F.col("text"), t))).select("query_id", "id")


class SubstringIndex:
    """Posting lists in a folder, sorted by gram, so that a search reads the row groups of its grams alone."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.lists = spark.read.schema("gram string, id string").parquet(f"{self.root}/postings")
        self.counts = spark.read.schema("gram string, n bigint").parquet(f"{self.root}/grams")

    @classmethod
    def build(cls, concepts: DataFrame, root: str) -> SubstringIndex:
        """Writes the index of all concepts. A folder with an index in it is an error."""
        spark, root = concepts.sparkSession, root.rstrip("/")
        spread = F.pmod(F.xxhash64("id"), F.lit(SPLIT))  # by hash, as ranges would make all grams once more for their sample
        postings(concepts).repartition("gram", spread).sortWithinPartitions("gram", "id").write.parquet(f"{root}/postings")
        lists = spark.read.schema("gram string, id string").parquet(f"{root}/postings")
        frequencies(lists).repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{root}/grams")
        return cls(spark, root)

    def candidates(self, query: str, rarest: int = RAREST) -> DataFrame:
        """(id) of concepts in the shortest lists of one query's grams."""
        tokens = tokens_of(query)
        wanted = sorted({t[i : i + SIZE] for t in tokens for i in range(max(1, len(t) - SIZE + 1))}) or [""]
        known = {r.gram: r.n for r in self.counts.where(F.col("gram").isin(wanted)).collect()}  # at most one row for each gram asked
        best = sorted(wanted, key=lambda g: (known.get(g, 0), g))[:rarest]
        held = self.lists.where(F.col("gram").isin(best)).groupBy("id").agg(F.count("*").alias("held"))
        return held.where(F.col("held") == len(best)).select("id")

    def search(self, concepts: DataFrame, query: str = "", kind: str = "", tag: str = "") -> DataFrame:
        """As catalog.search over the same concepts; texts of candidates alone are looked at."""
        return concepts.join(self.candidates(query), "id", "left_semi").where(matches(query, kind, tag)).orderBy("id")

    def search_each(self, concepts: DataFrame, queries: DataFrame) -> DataFrame:
        """As search_each, from the stored lists."""
        asked = checkpointed(queries.where("query is not null").select("query_id", tokenize("query").alias("tokens")))
        return checked(candidates(asked, self.lists, self.counts), asked, concepts)
