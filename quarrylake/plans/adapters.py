"""The driver's tables as concepts, links, histories and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylake.model import as_concepts
from quarrylake.storage import dealt, spread

AS_OF = "2025-01-01 00:00:00"


LONG = ("documents", "pages", "conversations")  # tables of texts, where a row costs much
KEYS = {"customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in LONG else dealt(df, KEYS[name]) if name in KEYS else df


def document_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with labels: language as type, language and source as tags; good quality is vouched for by a person, toxic is deprecated."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    d = d.join(lab, "doc_id", "left")
    ident = F.concat(F.lit("docs/"), "source", F.lit("/"), F.col("doc_id").cast("string"))
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 700).cast("int")), "yyyy-MM-dd")
    human = F.array(F.struct(F.lit("labels").alias("by"), day.alias("at"), F.lit("human").alias("tier")))
    return as_concepts(
        d, id=ident, path=F.concat(ident, F.lit(".md")), type=F.col("lang"), title=F.concat(F.lit("Document "), F.col("doc_id").cast("string")),
        description=F.when(F.col("n_chars") > 100, F.left("text", F.lit(40))), tags=F.array("lang", "source"), timestamp=F.concat(day, F.lit("T00:00:00Z")), stale_after=day,
        status=F.when(F.col("toxic") == 1, F.lit("deprecated")).when(F.col("quality") == 0, F.lit("poor")).when(F.col("quality") == 1, F.lit("stable")),
        verified=F.when(F.col("quality") == 1, human), body=F.col("text"),
    )


DOCS_SQL = """
c AS (SELECT 'docs/' || source || '/' || d.doc_id AS id, 'docs/' || source || '/' || d.doc_id || '.md' AS path, lang AS type, 'Document ' || d.doc_id AS title,
  CASE WHEN n_chars > 100 THEN left(text, 40) END AS description, lang, source, text AS body, quality, toxic, d.doc_id,
  strftime(DATE '2024-01-01' + (d.doc_id % 700)::INT, '%Y-%m-%d') AS day,
  CASE WHEN toxic = 1 THEN 'deprecated' WHEN quality = 0 THEN 'poor' WHEN quality = 1 THEN 'stable' END AS status,
  CASE WHEN quality = 1 THEN 'human' ELSE 'unverified' END AS trust_tier
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def key_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the key graph: regions, nations, customers, suppliers and orders."""

    def rows(name: str, key: str, title: str, kind: str) -> DataFrame:
        return table(spark, sf_dir, name).select(F.concat(F.lit(f"{name}/"), F.col(key).cast("string")).alias("id"), F.col(title).alias("title"), F.lit(kind).alias("type"))

    parts = [rows("region", "r_regionkey", "r_name", "Reference"), rows("nation", "n_nationkey", "n_name", "Reference"), rows("customer", "c_custkey", "c_name", "Customer Table"), rows("supplier", "s_suppkey", "s_name", "Supplier Metric"), rows("orders", "o_orderkey", "o_orderpriority", "Order")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return as_concepts(out, path=F.concat("id", F.lit(".md")), body=F.col("title"))


def key_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(concept_id, pos, resolved): a link for each foreign key."""

    def rows(name: str, key: str, to: str, ref: str) -> DataFrame:
        return table(spark, sf_dir, name).select(F.concat(F.lit(f"{name}/"), F.col(key).cast("string")).alias("concept_id"), F.lit(0).alias("pos"), F.concat(F.lit(f"{to}/"), F.col(ref).cast("string")).alias("resolved"))

    out = rows("nation", "n_nationkey", "region", "n_regionkey")
    for x in (("customer", "c_custkey", "nation", "c_nationkey"), ("supplier", "s_suppkey", "nation", "s_nationkey"), ("orders", "o_orderkey", "customer", "o_custkey")):
        out = out.unionByName(rows(*x))
    return out


KEYS_SQL = """
k AS (SELECT 'region/' || r_regionkey AS id, r_name AS title, 'Reference' AS type FROM region UNION ALL SELECT 'nation/' || n_nationkey, n_name, 'Reference' FROM nation
  UNION ALL SELECT 'customer/' || c_custkey, c_name, 'Customer Table' FROM customer UNION ALL SELECT 'supplier/' || s_suppkey, s_name, 'Supplier Metric' FROM supplier
  UNION ALL SELECT 'orders/' || o_orderkey, o_orderpriority, 'Order' FROM orders),
e AS (SELECT DISTINCT src, dst FROM (SELECT 'nation/' || n_nationkey AS src, 'region/' || n_regionkey AS dst FROM nation UNION ALL SELECT 'customer/' || c_custkey, 'nation/' || c_nationkey FROM customer
  UNION ALL SELECT 'supplier/' || s_suppkey, 'nation/' || s_nationkey FROM supplier UNION ALL SELECT 'orders/' || o_orderkey, 'customer/' || o_custkey FROM orders) WHERE dst IN (SELECT id FROM k))"""


def part_snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two states of all parts: the new one has other ids for some, and other titles, bodies, tags and extra keys for more."""
    p, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    size = F.col("p_size").cast("string")

    def side(rows: DataFrame, new: bool) -> DataFrame:
        ident = F.concat(F.lit("part/"), key.cast("string"), F.when(key % 10 == 1, F.lit("/new" if new else "/old")).otherwise(F.lit("")))
        title = F.when((key % 5 == 0) & F.lit(new), F.upper("p_name")).otherwise(F.col("p_name"))
        body = F.when((key % 7 == 0) & F.lit(new), F.concat("p_type", F.lit(" revised"))).otherwise(F.col("p_type"))
        extra = F.when((key % 11 == 0) & F.lit(new), F.create_map(F.lit("origin"), F.lit("new"))).otherwise(F.create_map(F.lit("size"), size))
        stamp = F.when((key % 3 == 0) == F.lit(new), F.lit("2024-06-01T00:00:00Z")).otherwise(F.lit("2024-01-01T00:00:00Z"))
        tags = F.array(F.col("p_brand"), F.lit("new" if new else "old"))
        return as_concepts(rows, id=ident, path=F.concat(ident, F.lit(".md")), type=F.lit("Part"), title=title, body=body, extra=extra, timestamp=stamp, tags=tags, resource=F.when(F.lit(new), F.lit("")).otherwise(F.col("p_brand")))

    return side(p, False), side(p, True)


PARTS_SQL = """
o AS (SELECT 'part/' || p_partkey || CASE WHEN p_partkey % 10 = 1 THEN '/old' ELSE '' END AS id, p_partkey AS key, p_name AS title, p_type AS body, p_brand, p_size::VARCHAR AS size, NULL::VARCHAR AS origin, p_brand AS resource,
  CASE WHEN p_partkey % 3 = 0 THEN '2024-01-01T00:00:00Z' ELSE '2024-06-01T00:00:00Z' END AS stamp FROM part),
n AS (SELECT 'part/' || p_partkey || CASE WHEN p_partkey % 10 = 1 THEN '/new' ELSE '' END AS id, p_partkey AS key, CASE WHEN p_partkey % 5 = 0 THEN upper(p_name) ELSE p_name END AS title, CASE WHEN p_partkey % 7 = 0 THEN p_type || ' revised' ELSE p_type END AS body,
  p_brand, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_size::VARCHAR END AS size, CASE WHEN p_partkey % 11 = 0 THEN 'new' END AS origin, '' AS resource,
  CASE WHEN p_partkey % 3 = 0 THEN '2024-06-01T00:00:00Z' ELSE '2024-01-01T00:00:00Z' END AS stamp FROM part),
p AS (SELECT coalesce(o.id, n.id) AS id, o AS o, n AS n, o.id AS oid, n.id AS nid FROM o FULL JOIN n ON o.id = n.id)"""


def event_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a history, the latest first."""
    e = table(spark, sf_dir, "events")
    return e.select(F.sha2(F.col("event_id").cast("string"), 256).alias("hash"), (-F.unix_micros(F.col("ts").cast("timestamp"))).alias("t"), "event_id", F.concat(F.lit("User "), F.col("user_id").cast("string")).alias("author_name"), F.concat(F.lit(" User."), F.col("user_id").cast("string"), F.lit("@Example.com ")).alias("author_email"), F.col("ts").alias("at"), F.col("event_type").alias("message")).withColumn("ord", F.struct("t", "event_id")).drop("t", "event_id")
