"""Differences between two bundles, and their merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylake.functions import filled, parse_rfc3339
from quarrylake.model import TEXT_FIELDS, fields

ADDED, DELETED, MODIFIED = "ADDED", "DELETED", "MODIFIED"
_FIELD = "array<struct<field:string,old_value:string,new_value:string>>"
TRUST_FIELDS = ("sources", "generated", "verified", "stale_after", "status", "attestation")


def _tags(c: Column) -> Column:
    return F.array_sort(F.coalesce(c, F.array().cast("array<string>")))


def _one(differs: Column, name, old: Column, new: Column) -> Column:
    name = F.lit(name) if isinstance(name, str) else name
    row = F.array(F.struct(name.alias("field"), old.alias("old_value"), new.alias("new_value")))
    return F.when(differs, row.cast(_FIELD)).otherwise(F.array().cast(_FIELD))


def field_changes(include_trust: bool = False) -> Column:
    """Changes of metadata between structs o and n: text fields, tags as a bag, extra keys one by one; by field name."""
    parts = [_one(filled(F.col(f"o.{f}")) != filled(F.col(f"n.{f}")), f, F.col(f"o.{f}"), F.col(f"n.{f}")) for f in TEXT_FIELDS]
    parts.append(_one(_tags(F.col("o.tags")) != _tags(F.col("n.tags")), "tags", F.array_join(_tags(F.col("o.tags")), ","), F.array_join(_tags(F.col("n.tags")), ",")))
    none = F.create_map().cast("map<string,string>")
    old, new = F.coalesce(F.col("o.extra"), none), F.coalesce(F.col("n.extra"), none)
    both = F.map_entries(F.map_zip_with(old, new, lambda k, a, b: F.struct(a.alias("a"), b.alias("b"))))
    changed = F.filter(both, lambda e: ~e["value"]["a"].eqNullSafe(e["value"]["b"]))
    parts.append(F.transform(changed, lambda e: F.struct(F.concat(F.lit("extra."), e["key"]).alias("field"), e["value"]["a"].alias("old_value"), e["value"]["b"].alias("new_value"))).cast(_FIELD))
    if include_trust:
        for f in TRUST_FIELDS:
            a, b = (F.to_json(F.struct(F.col(f"{s}.{f}").alias("v"))) for s in "on")
            parts.append(_one(~a.eqNullSafe(b), f, a, b))
    return F.array_sort(F.concat(*parts))


def paired(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Full outer join of both sides as structs o and n."""
    o = old.select(F.col(key).alias("_k"), F.struct("*").alias("o"))
    n = new.select(F.col(key).alias("_k"), F.struct("*").alias("n"))
    return o.join(n, "_k", "full_outer").withColumnRenamed("_k", key)


def diff(old: DataFrame, new: DataFrame, include_trust: bool = False) -> DataFrame:
    """(id, change, body_drift, fields) of concepts that were added, deleted or modified; fields is sorted by name."""
    p = paired(old, new)
    drift = filled(F.col("o.body")) != filled(F.col("n.body"))
    both = F.col("o").isNotNull() & F.col("n").isNotNull()
    p = p.select("id", F.when(F.col("o").isNull(), F.lit(ADDED)).when(F.col("n").isNull(), F.lit(DELETED)).otherwise(F.lit(MODIFIED)).alias("change"), (both & drift).alias("body_drift"), F.when(both, field_changes(include_trust)).otherwise(F.array().cast(_FIELD)).alias("fields"))
    return p.where((F.col("change") != MODIFIED) | F.col("body_drift") | (F.size("fields") > 0))


def diff_fields(old: DataFrame, new: DataFrame, include_trust: bool = False) -> DataFrame:
    """(id, field, old_value, new_value) of every changed field."""
    return diff(old, new, include_trust).select("id", F.inline("fields"))


def diff_report(changes: DataFrame) -> DataFrame:
    """(id, text): the lines that a report has for each change."""
    detail = F.array_join(F.transform("fields", lambda f: F.concat(F.lit("\n        - "), f["field"], F.lit(":\n            Old: "), F.coalesce(f["old_value"], F.lit("<nil>")), F.lit("\n            New: "), F.coalesce(f["new_value"], F.lit("<nil>")))), "")
    body = F.when(F.col("body_drift"), F.lit("\n    ~ Body text drifted")).otherwise(F.lit(""))
    meta = F.when(F.size("fields") > 0, F.concat(F.lit("\n    ~ Metadata frontmatter drifted:"), detail)).otherwise(F.lit(""))
    mark = F.when(F.col("change") == ADDED, F.lit("[+] ADDED    ")).when(F.col("change") == DELETED, F.lit("[-] DELETED  ")).otherwise(F.lit("[~] MODIFIED "))
    return changes.select("id", F.concat(mark, F.col("id"), body, meta).alias("text")).orderBy("id")


def merged_tags(a: Column, b: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.array_sort(F.filter(F.array_union(F.coalesce(a, none), F.coalesce(b, none)), lambda t: t != ""))


def merged_citations(a: Column, b: Column) -> Column:
    """One citation for each address, the last of b's or else of a's, by number and address."""
    kind = "array<struct<number:int,title:string,uri:string>>"
    all_ = F.concat(F.coalesce(a, F.array().cast(kind)), F.coalesce(b, F.array().cast(kind)))
    last = F.filter(F.transform(all_, lambda c, i: F.struct(c["number"].alias("number"), c["uri"].alias("uri"), c["title"].alias("title"), F.exists(F.slice(all_, i + 2, F.size(all_)), lambda d: d["uri"].eqNullSafe(c["uri"])).alias("again"))), lambda c: ~c["again"])
    return F.transform(F.array_sort(last), lambda c: F.struct(c["number"].alias("number"), c["title"].alias("title"), c["uri"].alias("uri")))


def first_is_newer(a: Column, b: Column) -> Column:
    """Of two timestamps as text: the later one; a readable one before an unreadable one; else the greater text. A tie goes to b."""
    x, y = parse_rfc3339(a), parse_rfc3339(b)
    return F.when(x.isNotNull() & y.isNotNull(), x > y).when(x.isNotNull(), F.lit(True)).when(y.isNotNull(), F.lit(False)).otherwise(filled(a) >= filled(b))


def merge(ours: DataFrame, theirs: DataFrame, strategy: str = "union") -> DataFrame:
    """Concepts of both bundles: on conflict ours, theirs, or the union based on the newer one.

    Trust fields go with the concept that the rest is taken from.
    """
    if strategy not in ("ours", "theirs", "union"):
        raise ValueError(f"unknown merge strategy: {strategy}")
    p = paired(ours, theirs)
    newer = first_is_newer(F.col("o.timestamp"), F.col("n.timestamp"))
    conflict = F.col("o").isNotNull() & F.col("n").isNotNull()
    out = []
    for name, kind in fields().items():
        a, b = F.col(f"o.{name}"), F.col(f"n.{name}")
        only = F.when(F.col("o").isNull(), b).otherwise(a)
        if strategy != "union":
            both = a if strategy == "ours" else b
        elif name in ("type", "title", "description", "resource"):
            both = F.when(newer, F.coalesce(F.nullif(a, F.lit("")), b)).otherwise(F.coalesce(F.nullif(b, F.lit("")), a))
        elif name == "tags":
            both = merged_tags(a, b)
        elif name == "citations":
            both = merged_citations(a, b)
        elif name == "extra":
            none = F.create_map().cast("map<string,string>")
            first, second = F.when(newer, a).otherwise(b), F.when(newer, b).otherwise(a)
            both = F.map_zip_with(F.coalesce(first, none), F.coalesce(second, none), lambda k, x, y: F.coalesce(x, y))
        else:
            both = F.when(newer, a).otherwise(b)
        out.append((F.col("id") if name == "id" else F.when(conflict, both).otherwise(only)).cast(kind).alias(name))
    return p.select(*out)
