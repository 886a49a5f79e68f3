"""Queries that write and read again: bundles of files, state tables, synchronisation cycles and a change stream."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylake import functions as fn
from quarrylake.functions.links import host_of
from quarrylake.model import as_concepts
from quarrylake.operators import export, index, trees, validate
from quarrylake.operators.crawl import crawl
from quarrylake.plans.adapters import AS_OF, DOCS_SQL, document_concepts, part_snapshots, table
from quarrylake.sources import bundle, harvest, scan, specs, watch
from quarrylake.sources.files import write_tree
from quarrylake.storage import checkpointed, shared_dir, shuffled
from quarrylake.streaming import sync
from quarrylake.streaming.state import ChangeLog


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quarrylake/{name}-{uuid.uuid4().hex}"


def _written(spark: SparkSession, sf_dir: str) -> str:
    """A bundle of suppliers, a file each, with longer bodies for every third."""
    s = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey").cast("string")
    body = F.concat(F.lit("# "), "s_name", F.when(F.col("s_suppkey") % 3 == 0, F.repeat(F.lit(" more"), 200)).otherwise(F.lit("")))
    c = as_concepts(s, id=F.concat(F.lit("suppliers/"), key), path=F.concat(F.lit("suppliers/"), key, F.lit(".md")), type=F.lit("Supplier"), title=F.col("s_name"), body=body)
    root = _folder(spark, "bundle").removeprefix("file://")
    export.write_bundle(c, root)
    return root


def scan_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.read_bundle(spark, _written(spark, sf_dir)).select("id", "type", "title", "status", F.length("body").alias("length"))


SCAN_BUNDLE = "SELECT 'suppliers/' || s_suppkey AS id, 'Supplier' AS type, s_name AS title, 'stable' AS status, (length(s_name) + 2 + CASE WHEN s_suppkey % 3 = 0 THEN 1000 ELSE 0 END)::INTEGER AS length FROM supplier"


def scan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As scan_bundle, by Spark's own file source."""
    return bundle.read_files(spark, _written(spark, sf_dir)).select("id", "type", "title", "status", F.length("body").alias("length"))


SCAN_FILES = SCAN_BUNDLE


def scan_pushed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Front matter of some folders of a bundle, by a data source that enters no others and reads no bodies."""
    p = table(spark, sf_dir, "part")
    folder = F.concat(F.lit("parts/"), (F.col("p_partkey") % 13).cast("string"))
    path = F.concat(folder, F.lit("/"), F.col("p_partkey").cast("string"))
    root = _folder(spark, "parts").removeprefix("file://")
    export.write_bundle(as_concepts(p, id=path, path=F.concat(path, F.lit(".md")), type=F.col("p_type"), title=F.col("p_name"), body=F.col("p_brand")), root)
    return scan.read_bundle(spark, root, columns=["id", "type", "title"], under=["parts/1/", "parts/12", "parts/7/"])


SCAN_PUSHED = "SELECT 'parts/' || (p_partkey % 13) || '/' || p_partkey AS id, p_type AS type, p_name AS title FROM part WHERE p_partkey % 13 IN (1, 7, 12)"


def scan_size_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files over 800 bytes are rows with an error, not read."""
    c = scan.read_bundle(spark, _written(spark, sf_dir), 800)
    return c.select("id", F.col("parse_error").endswith("exceeds the limit of 800 bytes").alias("too_large"), "title")


SCAN_SIZE_GUARD = "SELECT 'suppliers/' || s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN true END AS too_large, CASE WHEN s_suppkey % 3 <> 0 THEN s_name END AS title FROM supplier"


def bundle_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The versions in the front matter of the index files of many bundles, one for each supplier; some have none."""
    k = F.col("s_suppkey").cast("string")
    front = F.when(F.col("s_suppkey") % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("---\nx_version: '0."), k, F.lit("'\ntitle: x\n---\n")))
    files = table(spark, sf_dir, "supplier").select(F.concat(F.lit("b"), k, F.lit("/index.md")).alias("path"), F.concat(front, F.lit("# Index\n")).alias("content"))
    return bundle.versions(files)


BUNDLE_VERSION = "SELECT 'b' || s_suppkey || '/index.md' AS path, CASE WHEN s_suppkey % 4 <> 0 THEN '0.' || s_suppkey END AS version FROM supplier"


def search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A substring index written and read again; one search by it, inside words and with short tokens, and one for each language and source."""
    c = document_concepts(spark, sf_dir)
    found = index.SubstringIndex.build(c, _folder(spark, "index"))
    one = found.search(c, "The, ON! 2", "EN").select(F.lit("one").alias("query_id"), "id")
    asked = table(spark, sf_dir, "documents").select(F.concat_ws("/", "lang", "source").alias("query_id")).distinct().withColumn("query", F.col("query_id"))
    return one.unionByName(found.search_each(c, asked))


_HAY = "lower(id || ' ' || title || ' ' || coalesce(description, '') || ' ' || body || ' ' || lang || ' ' || source)"
SEARCH_INDEXED = f"""WITH {DOCS_SQL}, h AS (SELECT id, type, {_HAY} AS hay FROM c),
b AS (SELECT DISTINCT lang, source FROM documents)
SELECT 'one' AS query_id, id FROM h WHERE lower(type) = 'en' AND contains(hay, 'the') AND contains(hay, 'on') AND contains(hay, '2')
UNION ALL SELECT lang || '/' || source, id FROM b JOIN h ON contains(hay, lang) AND contains(hay, source)"""


def _linked(c: DataFrame) -> DataFrame:
    """Parts whose bodies link to the part of the same number without the end of its id."""
    return c.withColumn("body", F.concat(F.lit("[p](/"), F.regexp_extract("id", "^(part/[0-9]+)", 1), F.lit(".md)")))


def lint_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All new parts against the bundle of old ones that they replace."""
    old, new = part_snapshots(spark, sf_dir)
    return validate.lint_changed(_linked(old), _linked(new), F.lit(AS_OF).cast("timestamp")).select("concept_id", "message")


LINT_ONE = """WITH n AS (SELECT 'part/' || p_partkey AS part, 'part/' || p_partkey || CASE WHEN p_partkey % 10 = 1 THEN '/new' ELSE '' END AS id FROM part)
SELECT id AS concept_id, 'missing recommended ''description'' field' AS message FROM n
UNION ALL SELECT id, 'broken link: target concept ''' || part || ''' (resolved from ''/' || part || '.md'') does not exist' FROM n WHERE id <> part"""


class _Drop:
    """A connector that takes what it is given into a folder and offers given concepts."""

    def __init__(self, name: str, folder: str, offer: DataFrame, active: bool = True):
        self.name, self.folder, self.offer, self.active = name, folder, offer, active

    def push(self, concepts: DataFrame) -> None:
        concepts.select("id", "external_id").write.mode("append").parquet(f"{self.folder}/{self.name}")

    def pull(self, spark: SparkSession) -> DataFrame:
        return self.offer


def sync_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two cycles, the second after the bundle has changed: what is known of each concept at each connector, and how often it was pushed."""
    old, new = part_snapshots(spark, sf_dir)
    root = _folder(spark, "sync")
    states, pulls = sync.StateTable(spark, f"{root}/state", sync.STATE), sync.StateTable(spark, f"{root}/pulls", sync.PULL_STATE)
    ends = [_Drop("jira", root, old), _Drop("notion", root, new), _Drop("off", root, new, active=False)]
    for concepts in (old, new, new):
        sync.sync_once(concepts, ends, states, pulls, lambda _: None, F.lit(AS_OF))
    now = sync.hashed(new).select(F.col("id").alias("concept_id"), F.col("content_hash").alias("now"))
    pushed = spark.read.parquet(*(f"{root}/{x.name}" for x in ends if x.active)).groupBy("external_id").agg(F.count("*").alias("pushes"))
    s = states.load().join(shuffled(now), "concept_id", "left").join(shuffled(pushed), "external_id")
    return s.select("concept_id", "connector", "external_id", F.coalesce(F.col("content_hash") == F.col("now"), F.lit(False)).alias("current"), "pushes")


SYNC_CYCLES = """WITH k AS (SELECT p_partkey AS key, unnest(CASE WHEN p_partkey % 10 = 1 THEN ['/old', '/new'] ELSE [''] END) AS e FROM part)
SELECT 'part/' || key || e AS concept_id, c AS connector, c || '-part/' || key || e AS external_id, e <> '/old' AS current, CASE WHEN e = '' THEN 2 ELSE 1 END AS pushes FROM k CROSS JOIN (VALUES ('jira'), ('notion')) v(c)"""


def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of changes, merged into a state table: the last event of each user, none where that is a refund."""
    changes = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern, as the source takes no single file
    changes = changes.withColumn("op", F.when(F.col("event_type") == "refund", F.lit("delete")).otherwise(F.lit("write")))
    root = _folder(spark, "stream")
    state = sync.StateTable(spark, f"{root}/state", "user_id bigint, event_type string, value double")
    sync.stream_upsert(changes, state, "user_id", [F.desc("ts"), F.desc("event_id")], f"{root}/checkpoint").awaitTermination()
    return state.load()


STREAM_UPSERT = "SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1 AND event_type <> 'refund'"

def stream_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events, dealt at random over five micro-batches, as changes to a table kept by keyed state; compacted once between."""
    e = table(spark, sf_dir, "events").withColumn("op", F.when(F.col("event_type") == "refund", F.lit("delete")).otherwise(F.lit("write")))
    e = e.select("user_id", "ts", "event_id", "event_type", "value", "op")
    root = _folder(spark, "ordered")
    for part in range(5):
        e.where(F.pmod(F.xxhash64("event_id"), F.lit(5)) == part).coalesce(1).write.parquet(f"{root}/in/{part}")
    log = ChangeLog(spark, f"{root}/table", e.schema, "user_id", ["ts", "event_id"])
    for upto in ("[0-2]", "*"):  # the second stream goes on where the first ended
        stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in/{upto}")
        log.follow(stream, f"{root}/checkpoint").awaitTermination()
        log.compact()
    return log.table().select("user_id", "event_type", "value")


STREAM_ORDERED = STREAM_UPSERT

def portal_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A portal of the documents, each with an edge to the one before it of its source, written twice over and read back from its files."""
    c = document_concepts(spark, sf_dir)
    by_source = Window.partitionBy(F.element_at("tags", 2)).orderBy(F.substring_index("id", "/", -1).cast("bigint"))
    edges = c.select(F.col("id").alias("src"), F.lag("id").over(by_source).alias("dst")).where("dst is not null")
    root = _folder(spark, "portal").removeprefix("file://")
    export.write_portal(c.where("type = 'de'"), edges, root)
    export.write_portal(c, edges, root, overwrite=True)
    loaded, out = export.read_portal(spark, root, "id string, excerpt string", "id string, type string, title string, trustTier string, body string", "src string, dst string")
    one = loaded.select("document.*", F.col("entry.excerpt").alias("excerpt")).withColumn("digest", F.md5(F.col("body").cast("binary"))).drop("body")
    return one.join(shuffled(out.withColumnRenamed("src", "id")), "id", "left").select("id", "type", "title", "trustTier", "digest", "excerpt", "dst")


PORTAL_WRITTEN = f"""WITH {DOCS_SQL} SELECT id, type, title, trust_tier AS trustTier, md5(body) AS digest, CASE WHEN length(body) > 300 THEN left(body, 297) || '...' ELSE body END AS excerpt,
lag(id) OVER (PARTITION BY source ORDER BY doc_id) AS dst FROM c"""


def web_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of each host from its first one on, where each page links in one of four forms to the next of its host and to the third."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", "html", host_of("url").alias("host"))
    w = Window.partitionBy("host").orderBy("page_id")

    def link(ahead: int):
        to = F.regexp_replace(F.lead("url", ahead).over(w), "#.*$", "")
        rest = F.regexp_replace(to, "^[a-z]+:", "")
        path = F.regexp_replace(rest, "^//[^/]*/", "")
        form = F.pmod(F.col("page_id"), F.lit(4))
        href = F.when(form == 0, to).when(form == 1, rest).when(form == 2, F.concat(F.lit("/"), path)).otherwise(F.concat(F.lit("../.././../../"), path))
        return F.coalesce(F.concat(F.lit('<p><a class="n" href="'), href, F.lit('">next</a>')), F.lit(""))

    site = p.select("page_id", "host", "url", F.concat("html", link(1), link(3)).alias("html"))
    seeds = site.groupBy("host").agg(F.min_by("url", "page_id").alias("url"))
    return crawl(site.select("url", "html"), seeds, 3)


WEB_CRAWL = r"""WITH RECURSIVE p AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS url, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host FROM pages),
n AS (SELECT page_id, url, unnest([lead(url, 1) OVER w, lead(url, 3) OVER w]) AS nxt FROM p WINDOW w AS (PARTITION BY host ORDER BY page_id)),
e AS (SELECT DISTINCT url, CASE WHEN page_id % 4 = 0 THEN nxt ELSE regexp_extract(url, '^([a-z]+:)', 1) || regexp_replace(nxt, '^[a-z]+:', '') END AS target FROM n WHERE nxt IS NOT NULL),
l AS (SELECT * FROM e WHERE target IN (SELECT url FROM p)),
walk AS (SELECT DISTINCT arg_min(url, page_id) AS url, 0 AS depth FROM p GROUP BY host UNION SELECT l.target, depth + 1 FROM walk JOIN l ON l.url = walk.url WHERE depth < 3)
SELECT url, min(depth) AS depth FROM walk GROUP BY url"""


def watched_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bundle of suppliers that link to the next one, watched while a seventh of the files is edited and another removed: the edges and
    the issues of links that stand in the end, from three micro-batches of changes."""
    s = table(spark, sf_dir, "supplier")
    key, following = F.col("s_suppkey").cast("string"), (F.col("s_suppkey") + 1).cast("string")

    def written(rows: DataFrame, body) -> None:
        c = as_concepts(rows, id=F.concat(F.lit("suppliers/"), key), path=F.concat(F.lit("suppliers/"), key, F.lit(".md")), type=F.lit("Supplier"), title=F.col("s_name"), description=F.lit("d"), body=body)
        export.write_bundle(c, f"{root}/bundle")

    def remove(batches):
        for b in batches:
            for k in b.column(0).to_pylist():
                os.remove(f"{root}/bundle/suppliers/{k}.md")
            yield b

    root = _folder(spark, "watched").removeprefix("file://")
    w = watch.WatchedBundle(spark, f"{root}/bundle", f"{root}/known")
    written(s, F.concat(F.lit("[next]("), following, F.lit(".md)")))
    w.follow().awaitTermination()
    written(s.where("s_suppkey % 7 = 1"), F.concat(F.lit("[self](/suppliers/"), key, F.lit(".md) and [next]("), following, F.lit(".md)")))
    w.follow().awaitTermination()
    s.where("s_suppkey % 7 = 0").select(F.col("s_suppkey").cast("bigint").alias("k")).mapInArrow(remove, "k bigint").count()
    w.follow().awaitTermination()
    issues = w.issues(F.lit(AS_OF).cast("timestamp")).select(F.col("concept_id").alias("src"), F.col("message").alias("what"))
    return w.edges().select("src", F.col("dst").alias("what")).unionByName(issues)


WATCHED_BUNDLE = """WITH s AS (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 7 <> 0), l AS (SELECT k, k + 1 AS t FROM s UNION ALL SELECT k, k FROM s WHERE k % 7 = 1)
SELECT 'suppliers/' || k AS src, 'suppliers/' || t AS what FROM l WHERE t IN (SELECT k FROM s)
UNION ALL SELECT 'suppliers/' || k, 'broken link: target concept ''suppliers/' || t || ''' (resolved from ''' || t || '.md'') does not exist' FROM l WHERE t NOT IN (SELECT k FROM s)"""

def git_pull(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts of one folder of a clone that parsed: nations, beside regions in another folder; every fifth file is broken."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    root = _folder(spark, "clone").removeprefix("file://")
    key = F.col("n_nationkey").cast("string")
    write = F.when(F.col("n_nationkey") % 5 == 0, F.lit("---\ntype: a\ntype: b\n---\n")).otherwise(F.concat(F.lit("---\ntype: Nation\ntitle: "), "n_name", F.lit("\n---\n"), "n_comment" if "n_comment" in n.columns else "n_name"))
    files = n.select(F.concat(F.lit("concepts/n/"), key, F.lit(".md")).alias("path"), write.alias("content"))
    other = r.select(F.concat(F.lit("other/"), F.col("r_regionkey").cast("string"), F.lit(".md")).alias("path"), F.col("r_name").alias("content"))
    write_tree(files.unionByName(other), root)
    return scan.read_repository(spark, root).select("id", "type", "title")


GIT_PULL = "SELECT 'n/' || n_nationkey AS id, 'Nation' AS type, n_name AS title FROM nation WHERE n_nationkey % 5 <> 0"


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of conversations as quotes, some of which are marked as alerts."""
    c = table(spark, sf_dir, "conversations")
    mark = F.get(F.array(*[F.lit(x) for x in ("[!NOTE]<br>", "[!tip] <br/>", "[!Caution]", "", "[!OTHER]<br>")]), F.col("turn") % 5)
    quote = F.concat(mark, "text")
    return c.select("conv_id", "turn", fn.alert_kind(quote).alias("kind"), F.md5(fn.alert_block(quote).cast("binary")).alias("block"))


ALERTS = """SELECT conv_id, turn, kind, md5(CASE WHEN kind IS NULL THEN '<blockquote>' || mark || text ELSE '<blockquote class="alert alert-' || kind || '">' || CASE WHEN kind = 'caution' THEN mark ELSE '' END || text END || '</blockquote>') AS block FROM (
SELECT *, CASE turn % 5 WHEN 0 THEN 'note' WHEN 1 THEN 'tip' WHEN 2 THEN 'caution' END AS kind, ['[!NOTE]<br>', '[!tip] <br/>', '[!Caution]', '', '[!OTHER]<br>'][1 + turn % 5] AS mark FROM conversations)"""


def warehouse_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connection texts made of customers: some name project and dataset, some a project alone."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey").cast("string")
    text = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("projects/p"), key, F.lit("/datasets/d"), F.col("c_nationkey").cast("string"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("projects/"), key)).otherwise(F.col("c_name"))
    t = fn.warehouse_target(text, F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")))
    return c.select("c_custkey", t["project"].alias("project"), t["dataset"].alias("dataset"))


WAREHOUSE_TARGETS = """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'p' || c_custkey WHEN 1 THEN 'projects/' || c_custkey ELSE c_name END AS project,
CASE WHEN c_custkey % 3 = 0 THEN 'd' || c_nationkey WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS dataset FROM customer"""


def _order_trees(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders")
    path = F.concat_ws("/", F.date_format("o_orderdate", "yyyy"), F.date_format("o_orderdate", "MM"), F.concat(F.lit("f"), F.col("o_orderkey").cast("string")))
    base = o.select((F.col("o_custkey") % 10).cast("string").alias("commit"), path.alias("path"), "o_orderkey", F.month("o_orderdate").alias("month"), "o_orderstatus")
    changed = (F.col("month") == 3) & (F.col("o_orderkey") % 3 == 0)
    after = base.withColumn("blob", F.when(~changed, F.col("o_orderstatus")).when(F.col("o_orderkey") % 2 == 0, F.lit("x"))).unionByName(base.where("month = 4").select("commit", F.concat("path", F.lit("-copy")).alias("path"), "o_orderkey", "month", "o_orderstatus").withColumn("blob", F.col("o_orderstatus")))
    return base.select("commit", "path", F.col("o_orderstatus").alias("blob")), after.where("blob is not null").select("commit", "path", "blob")


def object_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files by year and month under ten commits; what changes in March and April, found without opening other months."""
    before, after = _order_trees(spark, sf_dir)
    (rb, eb), (ra, ea) = trees.tree_objects(before), trees.tree_objects(after)
    return trees.object_diff(rb, ra, eb.unionByName(ea).distinct())


OBJECT_DIFF = """WITH o AS (SELECT (o_custkey % 10)::VARCHAR AS commit, strftime(o_orderdate, '%Y/%m/f') || o_orderkey AS path, o_orderkey AS k, month(o_orderdate) AS m FROM orders)
SELECT commit, path, CASE WHEN k % 2 = 0 THEN 'Modify' ELSE 'Delete' END AS change FROM o WHERE m = 3 AND k % 3 = 0 UNION ALL SELECT commit, path || '-copy', 'Insert' FROM o WHERE m = 4"""


def _api_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A specification for each supplier; those of every seventh can't be read."""
    k = F.col("s_suppkey").cast("string")
    text = F.concat(
        F.lit("openapi: 3.0.0\npaths:\n  /s"), k, F.lit("/items:\n    get:\n      summary: List of "), k,
        F.lit('\n      parameters: [{name: limit, in: query, schema: {type: integer}, description: "most\\nrows"}]\n      responses: {\'200\': {description: ok, content: {application/json: {schema: {type: array, items: {$ref: \'#/components/schemas/Item'), k,
        F.lit("'}}}}}}\n  /s"), k, F.lit("/items/{id}:\n    post:\n      requestBody: {content: {application/json: {schema: {$ref: '#/components/schemas/Item"), k, F.lit("'}}}}\n      responses: {'201': {description: ''}}\n"),
    )
    return table(spark, sf_dir, "supplier").select(k.alias("file"), F.when(F.col("s_suppkey") % 7 == 0, F.lit("paths: [")).otherwise(text).alias("text"))


def harvest_openapi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The endpoints of suppliers' specifications, with their bodies."""
    ops = specs.operations(_api_files(spark, sf_dir)).where("error is null")
    return harvest.endpoint_concepts(ops).select("id", "title", "description", "body")


HARVEST_OPENAPI = """WITH s AS (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 7 <> 0), n AS (SELECT chr(10) AS n)
SELECT 'endpoints/get-s' || k || '-items' AS id, 'GET /s' || k || '/items' AS title, 'List of ' || k AS description, '# GET /s' || k || '/items' || n || n || '**Summary**: List of ' || k || n || n || '## Parameters' || n || '| Name | In | Type | Required | Description |' || n || '| ---- | -- | ---- | -------- | ----------- |' || n || '| limit | query | integer | No | most rows |' || n || n || '## Responses' || n || '| Status Code | Description | Schema Type |' || n || '| ----------- | ----------- | ----------- |' || n || '| 200 | ok | []Item' || k || ' |' || n || n AS body FROM s, n
UNION ALL SELECT 'endpoints/post-s' || k || '-items-id', 'POST /s' || k || '/items/{id}', '', '# POST /s' || k || '/items/{id}' || n || n || '## Request Body' || n || '- **Type**: `Item' || k || '` (application/json)' || n || n || '## Responses' || n || '| Status Code | Description | Schema Type |' || n || '| ----------- | ----------- | ----------- |' || n || '| 201 | - | - |' || n || n FROM s, n"""


def _proto_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file with a message for each customer, in the package of its nation, and one with a service for each nation, which takes its
    messages from those."""
    c = table(spark, sf_dir, "customer")
    k, n = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    own = c.select(F.concat(F.lit("c"), k).alias("file"), F.concat(F.lit('syntax = "proto3";\npackage shop.n'), n, F.lit(";\n// A customer.\nmessage C"), k, F.lit(" {\n  // own\n  string name = 1; // not this\n  repeated shop.Order orders = 2;\n}\n")).alias("text"))
    methods = F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("  rpc Get"), k, F.lit("(Key"), n, F.lit(") returns (stream n"), n, F.lit(".C"), k, F.lit(");\n")))), "")
    service = c.groupBy("c_nationkey").agg(methods.alias("ms")).select(F.concat(F.lit("n"), n).alias("file"), F.concat(F.lit("package shop;\nmessage Key"), n, F.lit(" { int32 id = 1; }\nservice Nation"), n, F.lit(" {\n"), "ms", F.lit("}\n")).alias("text"))
    n = spark.sparkContext.defaultParallelism * 4  # few long texts, which would be one task by their bytes
    return own.unionByName(service.repartition(n, "file"))


def harvest_proto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages of customers' files and the services of nations' files, with the bodies of messages."""
    c = harvest.proto_concepts(specs.resolved(specs.definitions(_proto_files(spark, sf_dir)).where("error is null")))
    return c.select("id", "type", F.when(F.col("id").rlike(r"\.c[0-9]+$"), F.col("body")).alias("body"))


HARVEST_PROTO = """WITH n AS (SELECT chr(10) AS n)
SELECT 'protobuf/shop.n' || c_nationkey || '.c' || c_custkey AS id, 'Protobuf Message' AS type, '# Protobuf Message shop.n' || c_nationkey || '.C' || c_custkey || n || n || 'A customer.' || n || n || '## Fields' || n || '| Name | Type | Tag | Description |' || n || '| ---- | ---- | --- | ----------- |' || n || '| name | string | 1 | own |' || n || '| orders | repeated shop.Order | 2 | - |' || n || n AS body FROM customer, n
UNION ALL SELECT DISTINCT 'protobuf/shop.key' || c_nationkey, 'Protobuf Message', NULL FROM customer UNION ALL SELECT DISTINCT 'protobuf/shop.nation' || c_nationkey, 'Protobuf Service', NULL FROM customer"""


def proto_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages that the services of nations take and give, found in other files."""
    defs = checkpointed(specs.definitions(_proto_files(spark, sf_dir)).where("error is null"))
    return harvest.method_links(specs.methods(defs), defs)


PROTO_LINKS = """SELECT 'shop.Nation' || c_nationkey AS service, 'Get' || c_custkey AS method, role, 'protobuf/shop.' || CASE role WHEN 'request' THEN 'key' || c_nationkey ELSE 'n' || c_nationkey || '.c' || c_custkey END AS message_id FROM customer, (VALUES ('request'), ('response')) v(role)"""


def fk_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as tables whose columns, their orders, point to tables of priorities: columns by table."""
    o = table(spark, sf_dir, "orders")
    fks = o.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("table_name"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("column_name"), F.col("o_orderpriority").alias("foreign_table"), F.lit("key").alias("foreign_column"))
    out, _ = harvest.fk_groups(fks)
    return out.select("name", F.array_join(F.transform("outgoing", lambda x: F.concat(x["column_name"], F.lit(">"), x["foreign_table"])), ",").alias("columns"))


FK_GROUPS = "SELECT 'c' || o_custkey AS name, string_agg('o' || o_orderkey || '>' || o_orderpriority, ',' ORDER BY 'o' || o_orderkey) AS columns FROM orders GROUP BY o_custkey"


CYCLES = {n: (globals()[n], globals()[n.upper()]) for n in "scan_bundle scan_files scan_pushed scan_size_guard bundle_version search_indexed lint_one sync_cycles stream_upsert stream_ordered portal_written web_crawl watched_bundle git_pull alerts warehouse_targets object_diff harvest_openapi harvest_proto proto_links fk_groups".split()}
