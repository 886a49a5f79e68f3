"""JSON-LD, portal data, publish payloads and rendered documents."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from quarrylake.functions import excerpt, filled, trim_space, trust_tier
from quarrylake.model import metadata_json
from quarrylake.operators.catalog import portal_index
from quarrylake.sources.files import write_tree

SCHEME = "bundle://"
ANY_LENGTH = {"maxStringLen": str(2**31 - 1)}  # Spark's JSON reader gives up strings of more than 20 million characters otherwise


def parse_columns(body: Column | str = "body") -> Column:
    """array of struct(name, type, description) from the rows of Markdown tables of five columns: lines that start and end with a
    pipe, without rules ('---') and without the header (`column` or `field`)."""
    lines = F.transform(F.split(filled(body), "\n"), lambda x: trim_space(x))
    rows = F.filter(lines, lambda x: x.startswith("|") & x.endswith("|") & ~F.contains(x, F.lit("---")))
    cells = F.filter(F.transform(rows, lambda x: F.split(x, r"\|", -1)), lambda c: F.size(c) >= 6)
    got = F.transform(cells, lambda c: F.struct(trim_space(F.get(c, F.lit(1))).alias("name"), trim_space(F.get(c, F.lit(2))).alias("type"), trim_space(F.get(c, F.lit(5))).alias("description")))
    return F.filter(got, lambda c: ~F.lower(c["name"]).isin("column", "field"))


def _some(x: Column) -> Column:
    return F.nullif(F.coalesce(x, F.lit("")), F.lit(""))


def jsonld_type() -> Column:
    """By parts of the type's name: tables are datasets, APIs and endpoints web APIs, all else articles."""
    t = F.lower(filled("type"))
    return F.when(F.contains(t, F.lit("table")), F.lit("Dataset")).when(F.contains(t, F.lit("api")) | F.contains(t, F.lit("endpoint")), F.lit("WebAPI")).otherwise(F.lit("TechArticle"))


def jsonld(concepts: DataFrame, scheme: str = SCHEME, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, ld_type, node): a schema.org node as JSON for each concept that parsed; empty fields are left out. `keep` names columns of
    the concepts that go along."""
    kind = jsonld_type()
    tags = F.when(F.size(F.coalesce("tags", F.array().cast("array<string>"))) > 0, F.col("tags"))
    columns = F.transform(parse_columns(), lambda c: F.struct(F.lit("PropertyValue").alias("@type"), c["name"].alias("name"), _some(c["description"]).alias("description"), _some(c["type"]).alias("valueReference")))
    node = F.struct(
        kind.alias("@type"),
        F.concat(F.lit(scheme), "id").alias("@id"),
        F.coalesce(_some(F.col("title")), F.col("id")).alias("name"),
        _some(F.col("description")).alias("description"),
        F.when(kind == "Dataset", _some(F.col("resource"))).alias("identifier"),
        F.when((kind == "Dataset") & (F.size(columns) > 0), columns).alias("variableMeasured"),
        F.when(kind == "WebAPI", _some(F.col("resource"))).alias("documentation"),
        F.when(kind == "TechArticle", _some(F.col("body"))).alias("articleBody"),
        tags.alias("keywords"),
        _some(F.col("timestamp")).alias("dateModified"),
    )
    return concepts.where(filled("parse_error") == "").select("id", kind.alias("ld_type"), F.to_json(node).alias("node"), *keep)


def jsonld_document(nodes: DataFrame) -> DataFrame:
    """The whole graph as one JSON text, for bundles that fit one row."""
    all_ = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "node"))), lambda x: x["node"]), ",")
    return nodes.agg(F.concat(F.lit('{"@context":"https://schema.org","@graph":['), all_, F.lit("]}")).alias("document"))


def publish_payload(concepts: DataFrame) -> DataFrame:
    """(id, payload): id, type, title, description and body as JSON."""
    return concepts.select("id", F.to_json(F.struct("id", filled("type").alias("type"), filled("title").alias("title"), filled("description").alias("description"), filled("body").alias("body"))).alias("payload"))


def portal_documents(concepts: DataFrame) -> DataFrame:
    """(id, document): what a portal loads for one concept, body included."""
    parsed = concepts.where(filled("parse_error") == "")
    return parsed.select("id", F.to_json(F.struct("id", "type", "title", "description", "resource", "tags", "timestamp", "status", trust_tier("verified").alias("trustTier"), F.col("stale_after").alias("staleAfter"), excerpt("body").alias("excerpt"), "body", "citations")).alias("document"))


SHARD = 1000  # entries of a portal's index in a file, about
SHARDS = 16  # of them in a task of a reader, fewer while that leaves cores idle


def portal_files(concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, content) of a portal's data: concepts/<id>.json for each concept that parsed; its entries and the edges between them in
    shards of about SHARD, index/<n>.json and edges/<n>.json, empty ones too; and manifest.json with the numbers of both. No file grows
    with the bundle but the manifest, by nothing."""
    documents = portal_documents(concepts).select(F.concat(F.lit("concepts/"), "id", F.lit(".json")).alias("path"), F.col("document").alias("content"))
    entries = portal_index(concepts)
    edges = edges.join(entries.select(F.col("id").alias("src")), "src", "left_semi").join(entries.select(F.col("id").alias("dst")), "dst", "left_semi")

    def sharded(rows: DataFrame, key: Column, name: str) -> tuple[DataFrame, int]:
        n = max(1, -(-rows.count() // SHARD))
        by = rows.select(F.pmod(F.xxhash64(key), F.lit(n)).alias("shard"), F.struct(key.alias("key"), F.to_json(F.struct("*")).alias("json")).alias("e"))
        every = concepts.sparkSession.range(n).select(F.col("id").alias("shard"), F.lit(None).cast(by.schema["e"].dataType).alias("e"))
        lists = by.unionByName(every).groupBy("shard").agg(F.array_sort(F.collect_list("e")).alias("es"))
        content = F.concat(F.lit("["), F.array_join(F.transform("es", lambda e: e["json"]), ",\n"), F.lit("]"))
        return lists.select(F.format_string(f"{name}/%d.json", "shard").alias("path"), content.alias("content")), n

    index, n_index = sharded(entries, F.struct("id"), "index")
    links, n_edges = sharded(edges.select("src", "dst"), F.struct("src", "dst"), "edges")
    manifest = concepts.sparkSession.range(1).select(F.lit("manifest.json").alias("path"), F.to_json(F.struct(F.lit(n_index).alias("index"), F.lit(n_edges).alias("edges"))).alias("content"))
    return documents.unionByName(index).unionByName(links).unionByName(manifest)


def write_portal(concepts: DataFrame, edges: DataFrame, root: str, overwrite: bool = False) -> None:
    """Write portal_files as a folder that driver and executors share, all of them or none."""
    write_tree(portal_files(concepts, edges), root, overwrite)


BATCH_FILES, BATCH_BYTES = 256, 8 << 20  # of the files that a batch holds, a single larger file aside


def _with_files(rows: DataFrame, root: str) -> DataFrame:
    """rows(path, ...) with the content of each path below root, read by the tasks that hold the rows. No folder is listed: Spark's file
    source keeps every file that it reads on the driver."""

    def read(batches):
        import os

        import pyarrow as pa

        def joined(b, start, got):
            return pa.RecordBatch.from_arrays([*b.slice(start, len(got)).columns, pa.array(got, pa.binary())], names=[*b.schema.names, "content"])

        for b in batches:
            start, got, size = 0, [], 0
            for path in b.column(b.schema.names.index("path")).to_pylist():
                with open(os.path.join(root, path), "rb") as f:
                    data = f.read()
                if got and (len(got) == BATCH_FILES or size + len(data) > BATCH_BYTES):
                    yield joined(b, start, got)
                    start, got, size = start + len(got), [], 0
                got.append(data)
                size += len(data)
            if got:
                yield joined(b, start, got)

    return rows.mapInArrow(read, StructType([*rows.schema.fields, StructField("content", BinaryType())]))


def _parsed(content: Column | str, schema: str) -> Column:
    return F.from_json(F.col(content).cast("string"), schema, {"mode": "FAILFAST", **ANY_LENGTH})


def read_portal(spark: SparkSession, root: str, entry: str, document: str, edge: str) -> tuple[DataFrame, DataFrame]:
    """What write_portal wrote, as a portal loads it, from the manifest on: (documents, edges), the fields that the schemas name.

    documents has a row for each entry of the index: `entry`, and `document`, the file of its id. The version that is there now is read,
    whatever is written later; a file that is missing or no JSON is an error. `entry` has to name id. Neither is for Spark to guess the
    size of and broadcast: join them by `shuffled`.
    """
    root = os.path.realpath(root.removeprefix("file://"))
    with open(f"{root}/manifest.json", encoding="utf-8") as f:
        shards = json.load(f)

    def listed(name: str, schema: str) -> DataFrame:
        n = shards[name]
        tasks = max(1, min(n, max(spark.sparkContext.defaultParallelism, -(-n // SHARDS))))
        paths = spark.range(0, n, 1, tasks).select(F.format_string(f"{name}/%d.json", "id").alias("path"))
        return _with_files(paths, root).select(F.explode(_parsed("content", f"array<struct<{schema}>>")).alias("x"))

    entries = listed("index", entry).select(F.col("x").alias("entry"), F.concat(F.lit("concepts/"), F.col("x.id"), F.lit(".json")).alias("path"))
    return _with_files(entries, root).select("entry", _parsed("content", document).alias("document")), listed("edges", edge).select("x.*")


def publish_edges(edges: DataFrame) -> DataFrame:
    """(src, payload): what is published of the links of each concept, a list of targets; a concept's own links bound it."""
    return edges.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("targets")).select("src", F.to_json(F.struct(F.col("src").alias("source"), "targets")).alias("payload"))


def rendered(concepts: DataFrame, by: str = "quarrylake", at: str | None = None) -> DataFrame:
    """(path, content): each concept as a Markdown file with JSON front matter, which YAML readers read too.

    A missing status is stable, and with `at` a missing origin is (by, at). One line end closes the file.
    """
    if at is not None:
        origin = F.struct(F.lit(by).alias("by"), F.lit(at).alias("at"), F.lit(None).cast("string").alias("tier"))
        concepts = concepts.withColumn("generated", F.coalesce("generated", origin))
    concepts = concepts.withColumn("status", F.coalesce(F.nullif(filled("status"), F.lit("")), F.lit("stable")))
    body = F.regexp_replace(F.regexp_replace(filled("body"), r"^\n+", ""), r"\n+$", "")
    return concepts.select("path", F.concat(F.lit("---\n"), metadata_json(), F.lit("\n---\n\n"), body, F.lit("\n")).alias("content"))


def write_bundle(concepts: DataFrame, root: str, by: str = "quarrylake", at: str | None = None) -> int:
    """Write each concept to its path below root, a folder that all executors share; gives the number of files.

    Paths that leave root are an error before anything is written.
    """
    files = rendered(concepts, by, at)
    outside = files.where(F.col("path").startswith("/") | F.col("path").rlike(r"(^|/)\.\.(/|$)"))
    if outside.limit(1).count():
        raise ValueError(f"path leaves the bundle: {outside.first()['path']}")

    def put(batches):
        import os

        import pyarrow as pa

        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                full = os.path.join(root, path)
                os.makedirs(os.path.dirname(full), exist_ok=True)
                with open(f"{full}.part", "w", encoding="utf-8", newline="") as f:
                    f.write(content)
                os.replace(f"{full}.part", full)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    return files.mapInArrow(put, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
