"""Links: what is external, what a target resolves to, which targets a Markdown body holds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrylake.functions.text import col, filled


def is_external(x: Column | str) -> Column:
    """http, https, mailto, ftp and file links, whatever the case."""
    return filled(x).rlike(r"(?i)^(https?://|mailto:|ftp://|file://)")


def is_git_url(x: Column | str) -> Column:
    x = F.lower(filled(x))
    return x.rlike(r"^(https?://|git@|ssh://|git://)") | x.endswith(".git")


def clean_path(x: Column) -> Column:
    """A relative path without empty and dot segments; '..' pops a segment, or stays where none is left."""

    def step(acc: Column, s: Column) -> Column:
        top = F.element_at(acc, -1)
        pop = (F.size(acc) > 0) & (top != "..")
        return (
            F.when((s == "") | (s == "."), acc)
            .when((s == "..") & pop, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
            .otherwise(F.array_append(acc, s))
        )

    return F.array_join(F.aggregate(F.split(x, "/"), F.array().cast("array<string>"), step), "/")


def without_md(x: Column) -> Column:
    return F.regexp_replace(x, r"\.md$", "")


def link_path(source_path: Column | str, target: Column | str) -> Column:
    """Where a target points to, as a path from the bundle's root: from the root if it starts with '/', else from the source's folder."""
    t = F.regexp_replace(filled(target), "#.*$", "")
    folder = F.regexp_extract(filled(source_path), r"^(.*)/[^/]*$", 1)
    return clean_path(F.when(t.startswith("/"), F.regexp_replace(t, "^/+", "")).otherwise(F.concat_ws("/", folder, t)))


def resolve_link(source_path: Column | str, target: Column | str) -> Column:
    return without_md(link_path(source_path, target))


def is_outside(path: Column | str) -> Column:
    """Paths that leave the bundle; a name that merely starts with two dots counts too."""
    return col(path).startswith("..")


_MASK = (r"(?ms)^[ ]{0,3}(```+|~~~+)[^\n]*\n.*?(^[ ]{0,3}\1[`~]*[ \t]*$|\z)", r"(?s)(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)")
# Loops are possessive: what may follow never starts inside them, and so Java's matcher neither recurses nor goes back.
_LABEL = r"(?:[^\[\]\\]++|\\.|\[[^\[\]]*+\])*+"
_PLAIN = r"(?:[^\[\]\\]++|\\.)"
_INLINE = rf"""(?<![!\\])\[{_LABEL}\]\(\s*+(?:<([^<>\n]*+)>|((?:[^\s()\\]++|\\.|\([^\s()]*+\))*+))(?:\s++(?:"[^"]*+"|'[^']*+'|\([^()]*+\)))?\s*+\)"""
_REFERENCE = rf"(?<![!\\\]])\[{_PLAIN}++\]\[({_PLAIN}*+)\]"
_SHORT = rf"(?<![!\\\]])\[({_PLAIN}++)\]\[\]"
_DEFINITION = rf"""(?m)^[ ]{{0,3}}\[({_PLAIN}++)\]:[ \t]*+<?([^\s<>]++)>?[ \t]*+(?:"[^"\n]*+"|'[^'\n]*+'|\([^)\n]*+\))?[ \t]*+$"""


def masked_code(body: Column | str) -> Column:
    """A body with fenced blocks and code spans taken out."""
    out = filled(body)
    for p in _MASK:
        out = F.regexp_replace(out, p, " ")
    return F.regexp_replace(out, r"(?m)^(?: {4}|\t)[^\n]*$", " ")


def extract_links(body: Column | str) -> Column:
    """Targets of inline links, then of full reference links, each in document order and as often as they occur.

    Code, images and bare addresses are no links. Nested brackets are followed one level deep.
    """
    text = masked_code(body)
    may = F.contains(filled(body), F.lit("](")) | F.contains(filled(body), F.lit("]["))
    inline = F.transform(F.regexp_extract_all(text, F.lit(_INLINE), F.lit(0)), lambda m: F.concat(F.regexp_extract(m, _INLINE, 1), F.regexp_extract(m, _INLINE, 2)))
    names = F.regexp_extract_all(text, F.lit(_DEFINITION), F.lit(1))
    targets = F.regexp_extract_all(text, F.lit(_DEFINITION), F.lit(2))
    defined = F.zip_with(names, targets, lambda n, t: F.struct(F.lower(n).alias("name"), t.alias("target")))
    used = F.transform(F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(1)), lambda n: F.lower(n))
    shown = F.transform(F.regexp_extract_all(text, F.lit(_SHORT), F.lit(1)), lambda n: F.lower(n))
    asked = F.concat(F.filter(used, lambda n: n != ""), shown)
    by_name = F.transform(asked, lambda n: F.get(F.filter(defined, lambda d: d["name"] == n), F.lit(0))["target"])
    return F.when(may, F.filter(F.concat(inline, by_name), lambda t: t.isNotNull() & (t != ""))).otherwise(F.array().cast("array<string>"))


def hub_bundle(uri: Column | str) -> Column:
    """hub://a/b/c -> a/b; with two segments the whole; with fewer null."""
    s = F.filter(F.split(F.regexp_replace(filled(uri), "^hub://", ""), "/"), lambda x: x != "")
    return F.when(F.size(s) >= 3, F.array_join(F.slice(s, F.lit(1), F.size(s) - 1), "/")).when(F.size(s) == 2, F.array_join(s, "/"))


def hub_concept(uri: Column | str) -> Column:
    """The concept that a hub link names; null for a link to a bundle."""
    s = F.filter(F.split(F.regexp_replace(filled(uri), "^hub://", ""), "/"), lambda x: x != "")
    return F.when(F.size(s) >= 3, F.element_at(s, -1))


def web_id(url: Column | str) -> Column:
    """web/ and the URL's path, with `index` for folders; host, query and fragment don't count."""
    path = F.regexp_replace(F.coalesce(F.try_parse_url(col(url), F.lit("PATH")), F.lit("")), "^/", "")
    return F.concat(F.lit("web/"), F.when((path == "") | path.endswith("/"), F.concat(path, F.lit("index"))).otherwise(path))


def proto_link(name: Column | str) -> Column:
    return F.concat(F.lower(col(name)), F.lit(".md"))


def uri_path(uri: Column | str) -> Column:
    """The path of a file URI, else the text itself."""
    return F.when(filled(uri).startswith("file://"), F.url_decode(F.regexp_replace(col(uri), "^file://", ""))).otherwise(col(uri))


def resolve_url(base: Column | str, href: Column | str) -> Column:
    """The absolute URL that a link on a page at base leads to, without its fragment: whole URLs, //host, /path, ?query, and paths from
    the page's folder, with `.` and `..` taken away. Null if either is null."""
    base, href = (F.col(c) if isinstance(c, str) else c for c in (base, href))
    plain = F.regexp_replace(F.regexp_replace(href, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), "#.*$", "")
    page = F.regexp_replace(base, "#.*$", "")
    scheme, site = F.regexp_extract(page, "^([A-Za-z][A-Za-z0-9+.-]*:)", 1), F.regexp_extract(page, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1)
    own = F.regexp_extract(page, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1)
    folder = F.coalesce(F.nullif(F.regexp_replace(own, "[^/]*$", ""), F.lit("")), F.lit("/"))
    path, query = F.regexp_extract(plain, r"^([^?]*)", 1), F.regexp_extract(plain, r"(\?.*)$", 1)
    whole = F.when(path.startswith("/"), path).otherwise(F.concat(folder, path))
    relative = F.concat(site, without_dots(whole), query)
    return (
        F.when(plain.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), plain)
        .when(plain.startswith("//"), F.concat(scheme, plain))
        .when(plain == "", page)
        .when(path == "", F.concat(site, own, query))
        .otherwise(relative)
    )


def without_dots(path: Column) -> Column:
    """An absolute path without `.` and `..`; what would go above the root stays at it."""
    parts = F.split(F.substring(path, F.lit(2), F.length(path)), "/", -1)
    last = F.element_at(parts, -1)

    def step(done: Column, part: Column) -> Column:
        return F.when(part == ".", done).when(part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part)))

    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(last.isin(".", "..") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit("")))


def host_of(url: Column | str) -> Column:
    """A URL's host with its port, in lower case."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))
