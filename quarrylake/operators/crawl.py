"""A crawl over a table of pages: a frontier that stays on its hosts, within a depth, and visits no page twice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylake.functions.links import host_of, resolve_url
from quarrylake.sources.harvest import html_links
from quarrylake.storage import checkpointed


def page_links(pages: DataFrame) -> DataFrame:
    """(url, target): the distinct absolute targets, on the same host, of each page's links; neither has a fragment."""
    own = pages.select(F.regexp_replace("url", "#.*$", "").alias("url"), F.explode(html_links("html")).alias("href"))
    links = own.select("url", resolve_url("url", "href").alias("target"))
    return links.where((host_of("url") == host_of("target")) & F.col("target").rlike("^https?://") & (F.col("url") != F.col("target"))).distinct()


def crawl(pages: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """(url, depth) of pages(url, html) within `depth` links of seeds(url), a seed itself at 0, each by its shortest way.

    Links to other hosts aren't followed, nor those to pages that aren't there. The links are resolved once; a level is a join of the
    frontier with them, then an anti join with what was visited, and a checkpoint, so plans stay small however deep the walk. Fragments
    of URLs are dropped; nulls take no part; several rows of a URL are one page with the links of all.
    """
    links = checkpointed(page_links(pages).join(pages.select(F.regexp_replace("url", "#.*$", "").alias("target")).distinct(), "target", "left_semi").select("url", "target"))
    known = pages.select(F.regexp_replace("url", "#.*$", "").alias("url")).where("url is not null").distinct()
    front = checkpointed(known.join(seeds.select(F.regexp_replace("url", "#.*$", "").alias("url")), "url", "left_semi").select("url", F.lit(0).alias("depth")))
    seen = front
    for level in range(1, depth + 1):
        found = links.join(front.select("url"), "url", "left_semi").select(F.col("target").alias("url")).distinct()
        front = checkpointed(found.join(seen.select("url"), "url", "left_anti").select("url", F.lit(level).alias("depth")))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen
