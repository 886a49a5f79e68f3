"""The concept model: one row a document of a bundle."""

from __future__ import annotations

from collections.abc import Mapping
from functools import cache
from types import MappingProxyType

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACTOR = "struct<by:string,at:string,tier:string>"
CONCEPTS = (
    "id string, path string, type string, title string, description string, resource string, tags array<string>, timestamp string, "
    "format_version string, sources array<struct<uri:string,title:string,author:string,usage_count:int,last_modified:string>>, "
    f"generated {ACTOR}, verified array<{ACTOR}>, stale_after string, status string, attestation struct<query:string,executor:string,attester:string>, "
    "extra map<string,string>, body string, parse_error string, citations array<struct<number:int,title:string,uri:string>>"
)
EDGES = "src string, dst string, ordinal int"
TEXT_FIELDS = ("type", "title", "description", "resource", "timestamp")


@cache
def fields() -> Mapping[str, str]:
    """Column names and types of CONCEPTS, read once a process, as parsers ask for them in every row."""
    out, depth, start = {}, 0, 0
    text = CONCEPTS + ","
    for i, c in enumerate(text):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            name, _, kind = text[start:i].strip().partition(" ")
            out[name], start = kind, i + 1
    return MappingProxyType(out)


def as_concepts(df: DataFrame, **columns: Column) -> DataFrame:
    """df's own and the given columns as concepts; what is missing is null."""
    have = set(df.columns)
    return df.select(*[(columns[n] if n in columns else F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in fields().items()])


def metadata_json(extra: bool = True) -> Column:
    """All fields of a concept but path, body, error and citations, as JSON with its keys in a fixed order and nulls left out."""
    names = [n for n in fields() if n not in ("id", "path", "body", "parse_error", "citations") and (extra or n != "extra")]
    cols = [F.map_from_entries(F.array_sort(F.map_entries("extra"))).alias("extra") if n == "extra" else F.col(n) for n in names]
    return F.to_json(F.struct(*cols))
