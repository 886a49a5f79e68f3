"""Text: tokens, excerpts, headings, escapes, slugs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def filled(x: Column | str) -> Column:
    """Missing text is empty text."""
    return F.coalesce(col(x), F.lit(""))


def trim_space(x: Column | str) -> Column:
    """White space of any kind gone from both ends; trim() only knows the space."""
    return F.regexp_replace(col(x), r"^\s+|\s+$", "")


def tokenize(x: Column | str) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(filled(x)), "[^a-z0-9]+"), lambda t: t != "")


def token_estimate(x: Column | str) -> Column:
    """UTF-8 bytes by four, floored."""
    return F.floor(F.octet_length(filled(x)) / 4).cast("long")


def shortened(x: Column | str, most: int) -> Column:
    """At most `most` characters, the last three dots where text was cut."""
    x = filled(x)
    return F.when(F.length(x) > most, F.concat(F.left(x, F.lit(most - 3)), F.lit("..."))).otherwise(x)


def excerpt(x: Column | str) -> Column:
    return shortened(x, 300)


def short_desc(x: Column | str) -> Column:
    """One line of at most 100 characters; line ends become spaces after the cut."""
    return F.replace(shortened(x, 100), F.lit("\n"), F.lit(" "))


def first_heading(x: Column | str, fallback: Column | None = None) -> Column:
    """The first level-one heading, else fallback."""
    got = trim_space(F.regexp_extract(filled(x), r"(?m)^[ \t]*# ([^\n]*)$", 1))
    return F.when(got != "", got).otherwise(fallback if fallback is not None else F.lit(""))


def escape_xml(x: Column | str) -> Column:
    """XML character data; quotes, tab, line feed and carriage return as numeric references."""
    # The entities, the ampersand first.
    out = filled(x)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;"), ("\t", "&#x9;"), ("\n", "&#xA;"), ("\r", "&#xD;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def endpoint_id(method: Column | str, path: Column | str) -> Column:
    """get, /users/{id} -> get-users-id"""
    body = F.regexp_replace(F.translate(F.translate(col(path), "/", "-"), "{}", ""), "^-+|-+$", "")
    return F.concat(F.lower(col(method)), F.lit("-"), body)


def email_slug(x: Column | str) -> Column:
    return F.translate(F.replace(F.lower(col(x)), F.lit("@"), F.lit("-at-")), "._", "--")


def short_hash(x: Column | str) -> Column:
    return F.left(col(x), F.lit(8))


def search_text(title="title", description="description", body="body", tags="tags", ident="id") -> Column:
    """Everything search looks at, lower-cased."""
    tag_text = F.array_join(F.coalesce(col(tags), F.array().cast("array<string>")), " ")
    return F.lower(F.concat_ws(" ", filled(ident), filled(title), filled(description), filled(body), tag_text))


def bar(share: Column, width: int = 20) -> Column:
    """A bar of filled and empty blocks."""
    n = F.least(F.lit(width), F.greatest(F.lit(0), F.floor(share * width).cast("int")))
    return F.concat(F.repeat(F.lit("█"), n), F.repeat(F.lit("░"), F.lit(width) - n))


# Kinds of alerts in quotes.
ALERTS = ("NOTE", "TIP", "IMPORTANT", "WARNING", "CAUTION")


def alert_kind(quote: Column | str) -> Column:
    """The kind of alert that a quote is marked as, [!NOTE] and the like in any case, in lower case; null for a plain quote."""
    return F.nullif(F.lower(F.regexp_extract(filled(quote), rf"(?i)\[!({'|'.join(ALERTS)})\]", 1)), F.lit(""))


def alert_block(quote: Column | str) -> Column:
    """A quote's HTML as a block, of the alert's class and without its first mark if it is one."""
    mark = rf"(?i)\[!(?:{'|'.join(ALERTS)})\]\s*<br\s*/?>?"
    text = filled(quote)
    place = F.regexp_instr(text, F.lit(mark))
    cut = F.when(place > 0, F.concat(F.substring(text, F.lit(1), place - 1), F.substring(text, place + F.length(F.regexp_extract(text, mark, 0)), F.length(text)))).otherwise(text)
    kind = alert_kind(quote)
    return F.when(kind.isNotNull(), F.concat(F.lit('<blockquote class="alert alert-'), kind, F.lit('">'), cut, F.lit("</blockquote>"))).otherwise(F.concat(F.lit("<blockquote>"), text, F.lit("</blockquote>")))


def warehouse_target(connection: Column | str, dataset: Column | str) -> Column:
    """struct(project, dataset) of a connection text: projects/<project>/datasets/<dataset>, or else the project itself with the given
    dataset, which is null where none is known."""
    text, parts = filled(connection), F.split(filled(connection), "/", -1)
    full = (F.size(parts) == 4) & (F.get(parts, F.lit(0)) == "projects") & (F.get(parts, F.lit(2)) == "datasets")
    return F.struct(F.when(full, F.get(parts, F.lit(1))).otherwise(text).alias("project"), F.nullif(F.when(full, F.get(parts, F.lit(3))).otherwise(filled(dataset)), F.lit("")).alias("dataset"))
