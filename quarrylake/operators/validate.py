"""Conformance rules as issues(concept_id, path, severity, message).

All rules of a row, its links and its citations among them, are compiled into one array of issues, so they take one scan. An issue
about a link inside the bundle names the concept that the link needs; one join against the known ids drops those that are there.
Messages are fixed values: they are the expected output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylake.functions import extract_links, filled, hub_bundle, hub_concept, is_external, is_outside, link_path, parse_timestamp, trim_space, without_md
from quarrylake.operators.graph import raw_links
from quarrylake.storage import shuffled

ERROR, WARNING = "ERROR", "WARNING"
STATUSES = ("draft", "stable", "deprecated")
_ISSUE = "array<struct<severity:string,message:string,needs:string>>"
_ISSUES = ("concept_id", "path", "severity", "message")


def _issue(severity: str, message, needs: Column | None = None) -> Column:
    """needs: the concept without which this is an issue."""
    return F.struct(F.lit(severity).alias("severity"), (F.lit(message) if isinstance(message, str) else message).alias("message"), (F.lit(None).cast("string") if needs is None else needs).alias("needs"))


def _text(template: str, *parts) -> Column:
    """A message with each '{}' filled in."""
    pieces = template.split("{}")
    out = [F.lit(pieces[0])]
    for p, rest in zip(parts, pieces[1:], strict=True):
        out += [filled(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")), F.lit(rest)]
    return F.concat(*out)


def _when(bad: Column, severity: str, message) -> Column:
    return F.when(bad, F.array(_issue(severity, message)).cast(_ISSUE)).otherwise(F.array().cast(_ISSUE))


def field_rules() -> list[Column]:
    return [
        _when(trim_space(filled("type")) == "", ERROR, "missing or empty 'type' field in frontmatter"),
        _when(trim_space(filled("title")) == "", WARNING, "missing recommended 'title' field"),
        _when(trim_space(filled("description")) == "", WARNING, "missing recommended 'description' field"),
    ]


def status_rules() -> list[Column]:
    s = F.lower(trim_space(filled("status")))
    return [
        _when(s == "deprecated", WARNING, "concept is marked as deprecated"),
        _when((s != "") & ~s.isin(*STATUSES), WARNING, _text("unrecognized lifecycle status '{}' (expected draft, stable, or deprecated)", "status")),
    ]


def freshness_rules(as_of: Column) -> list[Column]:
    s = trim_space(filled("stale_after"))
    at = parse_timestamp(s)
    return [
        _when((s != "") & at.isNull(), WARNING, _text("invalid 'stale_after' date format '{}' (expected RFC3339 or YYYY-MM-DD)", s)),
        _when((s != "") & (at < as_of), WARNING, _text("concept is stale (stale_after date '{}' has passed)", s)),
    ]


def actor_rules() -> list[Column]:
    g = trim_space(F.coalesce(F.col("generated")["at"], F.lit("")))
    bad = F.filter(
        F.transform(F.coalesce("verified", F.array().cast("array<struct<by:string,at:string,tier:string>>")), lambda v, i: F.struct(i.alias("i"), trim_space(F.coalesce(v["at"], F.lit(""))).alias("at"))),
        lambda x: (x["at"] != "") & parse_timestamp(x["at"]).isNull(),
    )
    return [
        _when((g != "") & parse_timestamp(g).isNull(), WARNING, _text("invalid 'generated.at' date format '{}'", g)),
        F.transform(bad, lambda x: _issue(WARNING, F.concat(F.lit("invalid 'verified["), x["i"].cast("string"), F.lit("].at' date format '"), x["at"], F.lit("'")))).cast(_ISSUE),
    ]


def attestation_rules() -> list[Column]:
    kind = F.lower(trim_space(filled("type")))
    a = F.col("attestation")
    none = a.isNull() | ((F.coalesce(a["query"], F.lit("")) == "") & (F.coalesce(a["executor"], F.lit("")) == ""))
    return [_when(kind.isin("attestation", "attested computation") & none, ERROR, "attestation concept requires an 'attestation' frontmatter block with 'query' or 'executor'")]


def _references(targets: Column, outside: str, broken: str) -> Column:
    """Issues of references to paths of the bundle: those that leave it, and the others, which need their concept."""
    own = F.filter(targets, lambda t: (filled(t) != "") & ~is_external(t) & ~t.startswith("hub://") & ~t.startswith("#"))
    placed = F.transform(own, lambda t: F.struct(t.alias("target"), link_path(F.col("path"), t).alias("to")))

    def issue(x: Column) -> Column:
        to = without_md(x["to"])
        return F.when(is_outside(x["to"]), _issue(WARNING, _text(outside, x["target"]))).otherwise(_issue(WARNING, _text(broken, to, x["target"]), to))

    return F.transform(placed, issue).cast(_ISSUE)


def link_rules() -> list[Column]:
    return [_references(extract_links("body"), "link '{}' references a path outside the bundle", "broken link: target concept '{}' (resolved from '{}') does not exist")]


def citation_rules() -> list[Column]:
    """As link_rules; hub citations are no paths and are left alone."""
    uris = F.transform(F.coalesce("citations", F.array().cast("array<struct<number:int,title:string,uri:string>>")), lambda c: c["uri"])
    return [_references(uris, "citation link '{}' references a path outside the bundle", "broken citation link: target concept '{}' (resolved from '{}') does not exist")]


def raw_issues(concepts: DataFrame, rules: list[Column]) -> DataFrame:
    """(concept_id, path, severity, message, needs): issues of rules, of which those with needs hold only where that concept isn't there.
    A row that failed to parse has that one issue."""
    own = F.when(filled("parse_error") != "", F.array(_issue(ERROR, F.col("parse_error"))).cast(_ISSUE)).otherwise(F.concat(*rules))
    return concepts.select(F.col("id").alias("concept_id"), "path", F.inline(own))


def holding(issues: DataFrame, known: DataFrame) -> DataFrame:
    """Raw issues that hold against known(id)."""
    there = known.select(F.col("id").alias("there"))
    return issues.join(shuffled(there), F.col("needs") == F.col("there"), "left_anti").select(*_ISSUES)


def row_issues(concepts: DataFrame, rules: list[Column], known: DataFrame | None = None) -> DataFrame:
    """Issues of rules that hold against known(id), by default the concepts themselves."""
    return holding(raw_issues(concepts, rules), concepts if known is None else known)


def link_issues(concepts: DataFrame) -> DataFrame:
    """Links that leave the bundle or whose target does not exist, once for each occurrence."""
    return row_issues(concepts.where(filled("parse_error") == ""), link_rules(), concepts)


def citation_issues(concepts: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """As link_issues, of citations. Ids that are had without parsing may be given as known(id), so that files are parsed once."""
    return row_issues(concepts.where(filled("parse_error") == ""), citation_rules(), concepts if known is None else known)


def remote_issues(links: DataFrame, remote: DataFrame) -> DataFrame:
    """Issues of links(concept_id, path, target) with hub targets against remote(bundle, concept): a missing concept is an error, a
    bundle without any concept a warning."""
    hub = links.where(F.lower(F.left(filled("target"), F.lit(6))) == "hub://").select("concept_id", "path", hub_bundle("target").alias("bundle"), hub_concept("target").alias("concept")).where("bundle is not null")
    known = remote.select("bundle").distinct()
    unknown = hub.join(shuffled(known), "bundle", "left_anti").select("concept_id", "path", F.lit(WARNING).alias("severity"), _text("remote bundle '{}' could not be resolved or is empty", "bundle").alias("message"))
    asked = hub.where("concept is not null").join(shuffled(known), "bundle", "left_semi")
    missing = asked.join(shuffled(remote.select("bundle", "concept").distinct()), ["bundle", "concept"], "left_anti")
    return unknown.unionByName(missing.select("concept_id", "path", F.lit(ERROR).alias("severity"), _text("broken remote link: concept '{}' not found in remote bundle '{}'", "concept", "bundle").alias("message")))


def timeless_rules() -> list[Column]:
    """All rules whose issues only change with the concept, or with which others there are."""
    return [*field_rules(), *status_rules(), *actor_rules(), *attestation_rules(), *link_rules(), *citation_rules()]


def all_rules(as_of: Column) -> list[Column]:
    return [*freshness_rules(as_of), *timeless_rules()]


def lint(concepts: DataFrame, as_of: Column, remote: DataFrame | None = None) -> DataFrame:
    """All issues of a bundle, in no order; hub links only against a given remote(bundle, concept)."""
    out = row_issues(concepts, all_rules(as_of))
    return out if remote is None else out.unionByName(remote_issues(raw_links(concepts), remote))


def in_order(issues: DataFrame) -> DataFrame:
    """Issues by path and message, for a report."""
    return issues.orderBy("path", "message")


def lint_changed(concepts: DataFrame, changed: DataFrame, as_of: Column) -> DataFrame:
    """Issues of changed concepts against the bundle that they replace rows of; only the changed ones are read whole."""
    known = concepts.select("id").join(shuffled(changed.select("id")), "id", "left_anti").unionByName(changed.select("id"))
    return row_issues(changed, all_rules(as_of), known)


def lint_counts(issues: DataFrame) -> DataFrame:
    return issues.agg(F.count_if(F.col("severity") == ERROR).alias("errors"), F.count_if(F.col("severity") == WARNING).alias("warnings"))


def report(issues: DataFrame) -> tuple[DataFrame, int]:
    """(lines `SEVERITY path: message` in order, exit status: 1 if there is an error). One row reaches the driver."""
    lines = in_order(issues).select(F.concat("severity", F.lit(" "), "path", F.lit(": "), "message").alias("line"))
    return lines, int((lint_counts(issues).first()["errors"] or 0) > 0)
