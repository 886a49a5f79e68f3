"""The link graph: edges from bodies, degrees, bounded breadth-first walks and context assembly within a budget."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylake.functions import bar, escape_xml, extract_links, filled, is_external, is_outside, resolve_link
from quarrylake.model import metadata_json
from quarrylake.storage import checkpointed, shuffled

STEP = "array<struct<side:int,ordinal:int,via:string>>"


def raw_links(concepts: DataFrame) -> DataFrame:
    """(concept_id, path, pos, target): every link of every body, in document order."""
    return concepts.where(filled("parse_error") == "").select(F.col("id").alias("concept_id"), "path", F.posexplode(extract_links("body")).alias("pos", "target"))


def internal_links(concepts: DataFrame) -> DataFrame:
    """raw_links inside bundles, with the id they resolve to; a bare anchor points nowhere else and is left out."""
    links = raw_links(concepts).where(~is_external("target") & ~F.col("target").startswith("hub://") & ~F.col("target").startswith("#"))
    return links.withColumn("resolved", resolve_link("path", "target"))


def edges_of(links: DataFrame, concepts: DataFrame) -> DataFrame:
    """(src, dst, ordinal): links(concept_id, pos, resolved) to concepts that exist, the first of each pair; loops stay."""
    known = concepts.select(F.col("id").alias("resolved"))
    first = links.where(~is_outside("resolved")).join(shuffled(known), "resolved", "left_semi").groupBy(F.col("concept_id").alias("src"), F.col("resolved").alias("dst")).agg(F.min("pos").alias("ordinal"))
    return first.select("src", "dst", "ordinal")


def link_edges(concepts: DataFrame) -> DataFrame:
    return edges_of(internal_links(concepts), concepts)


def node_degree(edges: DataFrame) -> DataFrame:
    """In- and out-degree together; a loop counts twice."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def inlinks(edges: DataFrame) -> DataFrame:
    """Sources of each node, sorted."""
    return edges.groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_list("src")).alias("sources"))


def backlinks(edges: DataFrame, concepts: DataFrame) -> DataFrame:
    """(id, source, label): who links to each node, under the source's title or else its id."""
    names = concepts.select(F.col("id").alias("source"), F.coalesce(F.nullif(filled("title"), F.lit("")), F.col("id")).alias("label"))
    return edges.select(F.col("dst").alias("id"), F.col("src").alias("source")).join(shuffled(names), "source").select("id", "source", "label")


def visible_edges(edges: DataFrame, visible: DataFrame) -> DataFrame:
    """Edges whose ends are both in visible(id)."""
    return edges.join(shuffled(visible.select(F.col("id").alias("src"))), "src", "left_semi").join(shuffled(visible.select(F.col("id").alias("dst"))), "dst", "left_semi")


# Colours of node types, looked for in this order as parts of the type.
COLOURS = (
    ("dataset", "#8b5cf6"),
    ("bigquery dataset", "#8b5cf6"),
    ("table", "#3b82f6"),
    ("bigquery table", "#3b82f6"),
    ("spanner table", "#3b82f6"),
    ("postgres table", "#3b82f6"),
    ("metric", "#10b981"),
    ("reference", "#10b981"),
    ("playbook", "#f59e0b"),
)
NO_COLOUR = "#94a3b8"


def graph_nodes(concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, label, type, colour, size) of a drawing: colour by type, size by degree up to a bound."""
    kind = F.lower(filled("type"))
    colour = F.when(F.lit(False), F.lit(""))
    for part, c in COLOURS:
        colour = colour.when(F.contains(kind, F.lit(part)), F.lit(c))
    deg = F.coalesce("degree", F.lit(0))
    out = concepts.join(shuffled(node_degree(edges)), "id", "left")
    return out.select("id", F.coalesce(F.nullif(filled("title"), F.lit("")), F.col("id")).alias("label"), filled("type").alias("type"), colour.otherwise(F.lit(NO_COLOUR)).alias("colour"), (20 + F.least(deg * 4, F.lit(40))).cast("long").alias("size"))


def resolve_loosely(links: DataFrame, concepts: DataFrame) -> DataFrame:
    """(source, target, id): a portal's way to resolve: the id itself, else relative to the source's folder, else the end of some id.

    Ids are exploded into their suffixes at '/', so that the last step is an equi join too; of several ids the first by name holds.
    """
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace("target", "#.*$", ""), r"\.md$", ""), "^/+", "")
    base = links.select("source", "target", bare.alias("bare"), resolve_link(F.concat("source", F.lit(".md")), F.col("target")).alias("relative"))
    ids = concepts.select("id")
    parts = F.split("id", "/")
    suffixes = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    ends = concepts.where(F.contains("id", F.lit("/"))).select("id", F.explode(suffixes).alias("suffix"))
    ends = ends.groupBy("suffix").agg(F.min("id").alias("by_suffix"))
    got = base.join(shuffled(ids.withColumnRenamed("id", "by_id")), F.col("bare") == F.col("by_id"), "left").join(shuffled(ends), F.col("bare") == F.col("suffix"), "left")
    got = got.join(shuffled(ids.withColumnRenamed("id", "by_relative")), F.col("relative") == F.col("by_relative"), "left")
    return got.select("source", "target", F.coalesce("by_id", "by_relative", "by_suffix").alias("id"))


@dataclass(frozen=True)
class Options:
    """Of a walk and its budget; 0 means without bound."""

    depth: int = 2
    max_characters: int = 16_000
    max_tokens: int = 4_000
    direction: str = "bidirectional"
    format: str = "xml"


def _steps(edges: DataFrame, direction: str) -> DataFrame:
    """(u, v, step): moves of a walk; outgoing links come first, by ordinal, then incoming ones by source."""
    kind = STEP[6:-1]
    out = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), F.struct(F.lit(0), "ordinal", F.lit("")).cast(kind).alias("step"))
    back = edges.select(F.col("dst").alias("u"), F.col("src").alias("v"), F.struct(F.lit(1), F.lit(0), F.col("src")).cast(kind).alias("step"))
    return {"inbound": back, "bidirectional": out.unionByName(back)}.get(direction, out)


SMALL = 10_000  # rows of a frontier that is broadcast


def bfs(edges: DataFrame, start: str, depth: int = 2, direction: str = "outbound", strict: bool = False, cost: Callable[[DataFrame], DataFrame] | None = None, budget: int = 0) -> DataFrame:
    """(id, depth, place): nodes within depth of start; ordering by depth and place is the order of a queue.

    place is the path of moves that first found a node, so no level needs a global numbering. With a budget the walk ends with the
    level on which the sum of costs passes it; cost gets nodes(id) and adds their cost. strict: unknown directions are an error, else
    outbound. Moves are checkpointed once, dealt by both of their nodes, so those of a hub are in all tasks, and one action counts each
    level; a frontier of SMALL rows at most is broadcast to them, a larger one is shuffled, and the moves of a node that is hot there are
    split, as the frontier has each node once.
    """
    if strict and direction not in ("outbound", "inbound", "bidirectional"):
        raise ValueError(f"unknown direction: {direction}")
    spark = edges.sparkSession
    steps = _steps(edges, direction)
    steps = checkpointed(steps.repartition("u", "v")) if depth > 1 else steps
    seen = spark.createDataFrame([(start, 0)], "id string, depth int").withColumn("place", F.array().cast(STEP))
    front, n, spent = seen, 1, 0
    for level in range(1, depth + 1):
        if budget and cost is not None:
            spent += cost(F.broadcast(front.select("id")) if n <= SMALL else front.select("id")).agg(F.coalesce(F.sum("cost"), F.lit(0))).first()[0]
            if spent > budget:
                break
        found = (F.broadcast(front) if n <= SMALL else front).join(steps, F.col("id") == F.col("u")).select(F.col("v").alias("id"), F.concat("place", F.array("step")).alias("place"))
        front = checkpointed(found.groupBy("id").agg(F.min("place").alias("place")).join(seen.select("id"), "id", "left_anti").select("id", F.lit(level).alias("depth"), "place"))
        n = front.count()
        if not n:
            break
        seen = seen.unionByName(front)
    return seen


def format_concept(kind: str = "xml") -> Column:
    """A concept as an XML or Markdown block; metadata is escaped in XML like all else."""
    meta = metadata_json()

    def opt(name: str, before: str, after: str, esc) -> Column:
        return F.when(filled(name) != "", F.concat(F.lit(before), esc(F.col(name)), F.lit(after))).otherwise(F.lit(""))

    if kind.lower() == "markdown":
        plain = lambda c: c
        head = [opt(n, f"- **{label}:** ", "\n", plain) for n, label in (("type", "Type"), ("title", "Title"), ("description", "Description"))]
        return F.concat(F.lit("# Concept: "), F.col("id"), F.lit("\n"), *head, F.lit("\n## Metadata\n```json\n"), meta, F.lit("\n```\n\n## Body\n"), filled("body"), F.lit("\n\n---\n"))
    head = [opt(n, f"  <{n}>", f"</{n}>\n", escape_xml) for n in ("type", "title", "description")]
    return F.concat(F.lit('<concept id="'), escape_xml("id"), F.lit('">\n'), *head, F.lit("  <metadata>\n    "), escape_xml(meta), F.lit("\n  </metadata>\n  <body>\n"), escape_xml("body"), F.lit("\n  </body>\n</concept>\n"))


def within_budget(nodes: DataFrame, max_characters: int, max_tokens: int) -> DataFrame:
    """The longest prefix of nodes(depth, place, characters, tokens) whose sums stay within both budgets, with running sums.

    Nodes are dealt into ranges of their order; sums run inside each range, and those of whole ranges before it, a row each, are added.
    So no level of a walk is one task.
    """
    rows = checkpointed(nodes.repartitionByRange("depth", "place").withColumn("_part", F.spark_partition_id()))
    up = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    before = rows.groupBy("_part").agg(F.sum("characters").alias("c"), F.sum("tokens").alias("t"))
    before = before.select("_part", F.coalesce(F.sum("c").over(up), F.lit(0)).alias("_c"), F.coalesce(F.sum("t").over(up), F.lit(0)).alias("_t"))
    inside = Window.partitionBy("_part").orderBy("depth", "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = rows.join(F.broadcast(before), "_part")
    run = run.withColumn("running_characters", F.sum("characters").over(inside) + F.col("_c")).withColumn("running_tokens", F.sum("tokens").over(inside) + F.col("_t")).drop("_part", "_c", "_t")
    ok = F.lit(True)
    if max_characters > 0:
        ok &= F.col("running_characters") <= max_characters
    if max_tokens > 0:
        ok &= F.col("running_tokens") <= max_tokens
    return run.where(ok)


def assemble(concepts: DataFrame, edges: DataFrame, start: str, options: Options = Options()) -> DataFrame:  # noqa: B008
    """(id, depth, place, characters, tokens, running sums, text) of the nodes whose texts fit the budget, in order of depth and place."""
    parsed = concepts.where(filled("parse_error") == "")
    if parsed.where(F.col("id") == start).isEmpty():
        raise LookupError(f"concept not found: {start}")

    def texts(nodes: DataFrame) -> DataFrame:
        """nodes with the text of each; only the nodes' own texts are made."""
        made = nodes.join(parsed, "id").select(*nodes.columns, format_concept(options.format).alias("text"))
        return made.withColumn("characters", F.octet_length("text").cast("long")).withColumn("tokens", F.floor(F.col("characters") / 4).cast("long"))

    cost = lambda nodes: texts(nodes).select("id", F.col("characters").alias("cost"))
    most = min([x for x in (options.max_characters, options.max_tokens * 4 + 3 if options.max_tokens else 0) if x > 0], default=0)
    nodes = bfs(edges, start, options.depth, options.direction, cost=cost, budget=most if options.max_characters > 0 else 0)
    return within_budget(texts(nodes).select("id", "depth", "place", "text", "characters", "tokens"), options.max_characters, options.max_tokens)


def context(assembled: DataFrame, kind: str = "xml") -> DataFrame:
    """One row: context, total_tokens, total_characters; the wrapper doesn't count. The budget bounds its size."""
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("depth", "place", "text"))), lambda x: x["text"]), "")
    wrap = (F.lit(""), F.lit("")) if kind.lower() == "markdown" else (F.lit("<context>\n"), F.lit("</context>\n"))
    return assembled.agg(F.concat(wrap[0], texts, wrap[1]).alias("context"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("total_tokens"), F.coalesce(F.sum("characters"), F.lit(0)).alias("total_characters"))


def token_monitor(assembled: DataFrame, max_tokens: int) -> DataFrame:
    """(id, tokens, percent, bar) of each node's share of the budget."""
    share = F.col("tokens") / max_tokens if max_tokens > 0 else F.lit(0.0)
    return assembled.select("id", "tokens", F.round(share * 100, 1).alias("percent"), bar(share).alias("bar"))
