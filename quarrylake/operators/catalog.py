"""Lists, filters, searches and counts over concepts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylake.functions import excerpt, filled, is_stale, is_verified, search_text, trust_tier

SUMMARY = ("id", "type", "title", "description", "tags")


def list_types(concepts: DataFrame) -> DataFrame:
    return concepts.where(filled("type") != "").select("type").distinct().orderBy("type")


def list_tags(concepts: DataFrame) -> DataFrame:
    return concepts.select(F.explode("tags").alias("tag")).where("tag != ''").distinct().orderBy("tag")


def by_type(concepts: DataFrame, kind: str) -> DataFrame:
    return concepts.where(F.col("type") == kind).orderBy("id")


def by_status(concepts: DataFrame, status: str) -> DataFrame:
    return concepts.where(F.lower(filled("status")) == status.lower()).orderBy("id")


def by_trust_tier(concepts: DataFrame, tier: str) -> DataFrame:
    return concepts.where(trust_tier("verified") == tier.lower()).orderBy("id")


def summaries(concepts: DataFrame) -> DataFrame:
    return concepts.select(*SUMMARY)


def get_concept(concepts: DataFrame, ident: str) -> DataFrame:
    """One row, or a LookupError."""
    got = concepts.where(F.col("id") == ident)
    if not got.limit(1).count():
        raise LookupError(f"concept not found: {ident}")
    return got


def tokens_of(query: str) -> list[str]:
    """As `tokenize`, for a query that is known before the plan is made."""
    import re

    return re.findall("[a-z0-9]+", query.lower())


def matches(query: str = "", kind: str = "", tag: str = "") -> Column:
    """Every token of the query is part of the search text, the type is `kind` and some tag is `tag`, case aside; empty asks nothing."""
    ok = F.lit(True)
    if kind:
        ok &= F.lower(filled("type")) == kind.lower()
    if tag:
        ok &= F.coalesce(F.exists("tags", lambda t: F.lower(t) == tag.lower()), F.lit(False))
    for t in tokens_of(query):
        ok &= F.contains(search_text(), F.lit(t))
    return ok


def search(concepts: DataFrame, query: str = "", kind: str = "", tag: str = "") -> DataFrame:
    return concepts.where(matches(query, kind, tag)).orderBy("id")


def portal_search(concepts: DataFrame, text: str = "", kind: str = "") -> DataFrame:
    """One trimmed, lower-cased piece of text in title, id, description or tags; not in bodies."""
    q = text.strip().lower()
    tags = F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " ")
    ok = F.lit(True) if not q else F.contains(F.lower(filled("title")), F.lit(q)) | F.contains(F.lower("id"), F.lit(q)) | F.contains(F.lower(filled("description")), F.lit(q)) | F.contains(F.lower(tags), F.lit(q))
    return concepts.where(ok & (F.col("type") == kind if kind else F.lit(True))).orderBy("id")


def search_index(concepts: DataFrame) -> DataFrame:
    return concepts.select("id", search_text().alias("text"))


def trust_summary(concepts: DataFrame, as_of: Column) -> DataFrame:
    """Counts of all, verified, stale and deprecated concepts."""
    return concepts.agg(
        F.count("*").alias("total"),
        F.count_if(is_verified("verified")).alias("verified"),
        F.count_if(is_stale("stale_after", as_of)).alias("stale"),
        F.count_if(F.lower(filled("status")) == "deprecated").alias("deprecated"),
    )


def tiers(concepts: DataFrame) -> DataFrame:
    return concepts.groupBy(trust_tier("verified").alias("trust_tier")).agg(F.count("*").alias("n"))


def nav_groups(concepts: DataFrame) -> DataFrame:
    """Concepts by type, `Other` for none, in the order in which people expect titles."""
    label = F.coalesce(F.nullif(filled("title"), F.lit("")), F.col("id"))
    return concepts.select(F.coalesce(F.nullif(filled("type"), F.lit("")), F.lit("Other")).alias("nav_group"), "id", label.alias("label")).orderBy("nav_group", F.collate("label", "UNICODE"), "id")


def index_listing(concepts: DataFrame) -> DataFrame:
    """A line for each concept, by id."""
    return concepts.select("id", F.format_string("- [%s](%s): %s", F.coalesce(F.nullif(filled("title"), F.lit("")), F.col("id")), filled("path"), filled("description")).alias("line")).orderBy("id")


def portal_index(concepts: DataFrame) -> DataFrame:
    """The light projection that a portal lists, without bodies or rows that failed to parse."""
    return concepts.where(filled("parse_error") == "").select(
        "id", filled("type").alias("type"), filled("title").alias("title"), filled("description").alias("description"), "resource", "tags",
        "timestamp", "status", trust_tier("verified").alias("trust_tier"), "stale_after", excerpt("body").alias("excerpt"),
    )
