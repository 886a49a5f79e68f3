"""Trust: dates, staleness, verification tiers, content hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrylake.functions.text import col, filled, trim_space


def parse_timestamp(x: Column | str) -> Column:
    """RFC 3339, else YYYY-MM-DD; null for anything else."""
    x = trim_space(filled(x))
    return F.coalesce(
        F.try_to_timestamp(x, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]XXX")),
        F.when(x.rlike(r"^\d{4}-\d\d-\d\d$"), F.try_to_timestamp(x, F.lit("yyyy-MM-dd"))),
    )


def parse_rfc3339(x: Column | str) -> Column:
    return F.try_to_timestamp(trim_space(filled(x)), F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]XXX"))


def is_stale(stale_after: Column | str, as_of: Column) -> Column:
    """Whether the date is readable and strictly before as_of."""
    return F.coalesce(parse_timestamp(stale_after) < as_of, F.lit(False))


def is_verified(verified: Column | str) -> Column:
    return F.coalesce(F.size(col(verified)), F.lit(0)) > 0


def trust_tier(verified: Column | str) -> Column:
    """unverified, else the highest of certified, human, automated; `verified` if only unknown tiers vouch."""
    v = F.coalesce(F.transform(col(verified), lambda x: F.lower(x["tier"])), F.array().cast("array<string>"))
    out = F.when(F.size(v) == 0, F.lit("unverified"))
    for tier in ("certified", "human", "automated"):
        out = out.when(F.array_contains(v, tier), F.lit(tier))
    return out.otherwise(F.lit("verified"))


def concept_hash(metadata: Column, body: Column | str) -> Column:
    """SHA-256 of metadata and body."""
    return F.sha2(F.concat(metadata, filled(body)), 256)
