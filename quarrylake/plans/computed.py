"""Functions on single texts, run over texts made of the columns of `part`, `orders` and `events`; the SQL derives what they have to
give from the same columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylake import functions as fn
from quarrylake.model import as_concepts
from quarrylake.operators import delta, export, graph, validate
from quarrylake.plans.adapters import event_commits, table
from quarrylake.sources import bundle, harvest, history

Q = "p_partkey AS key, p_type AS kind, replace(p_type, ' ', '_') AS t, p_name AS name, p_size AS size"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, t (the type in one word), name, size, k (the key as text)."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(key.alias("key"), F.replace("p_type", F.lit(" "), F.lit("_")).alias("t"), F.col("p_name").alias("name"), F.col("p_size").alias("size"), key.cast("string").alias("k"))


def _sql(select: str) -> str:
    return f"WITH p AS (SELECT {Q} FROM part) {select}"


def _text(template: str) -> Column:
    """A template with {k}, {t} and {name} filled in from the columns."""
    out, rest = [], template
    while rest:
        at = min((rest.find(f"{{{n}}}") for n in ("k", "t", "name") if f"{{{n}}}" in rest), default=len(rest))
        if at:
            out.append(F.lit(rest[:at]))
        if at < len(rest):
            name = rest[at + 1 : rest.index("}", at)]
            out.append(F.col(name))
            rest = rest[at + len(name) + 2 :]
        else:
            rest = ""
    return F.concat(*out)


def _case(*templates: str) -> Column:
    """By key modulo the number of templates."""
    out = F.lit(None).cast("string")
    for i, x in enumerate(templates):
        out = F.when(F.col("key") % len(templates) == i, _text(x)).otherwise(out)
    return out


def resolve_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parts(spark, sf_dir).withColumn("path", _text("tables/{t}/{k}.md"))
    p = p.withColumn("target", _case("../x/./{k}.md", "{k}/../y{k}", "/docs//{t}.md#top", "../../../{t}/{k}.md", "..x/{k}.md"))
    return p.select("key", fn.resolve_link("path", "target").alias("resolved"))


RESOLVE_LINK = _sql("SELECT key, CASE key % 5 WHEN 0 THEN 'tables/x/' || key WHEN 1 THEN 'tables/' || t || '/y' || key WHEN 2 THEN 'docs/' || t WHEN 3 THEN '../' || t || '/' || key ELSE 'tables/' || t || '/..x/' || key END AS resolved FROM p")


def extract_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = _case(
        "See [{name}](t/{k}.md \"the {t}\") and `[no](x.md)` ![i](p{k}.png) [n [m]](q({k}).md)",
        "[d][r{k}] and [R{k}][]\n\n[r{k}]: ref/{k}.md 'T'\n```\n[no](x.md)\n```\n[c](</z {k}.md>)",
        "{name} [{t}] (no link) \\[a](b{k}.md) plain",
    )
    return _parts(spark, sf_dir).select("key", F.array_join(fn.extract_links(body), ",").alias("targets"))


EXTRACT_LINKS = _sql("SELECT key, CASE key % 3 WHEN 0 THEN 't/' || key || '.md,q(' || key || ').md' WHEN 1 THEN '/z ' || key || '.md,ref/' || key || '.md,ref/' || key || '.md' ELSE '' END AS targets FROM p")


def parse_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, at = F.col("event_id"), F.col("ts").cast("timestamp")
    day, second = F.date_format(at, "yyyy-MM-dd"), F.date_format(at, "HH:mm:ss")
    text = F.when(key % 5 == 0, day).when(key % 5 == 1, F.concat(F.lit(" "), day, F.lit("T"), second, F.lit("Z "))).when(key % 5 == 2, F.concat(day, F.lit("T"), second, F.lit(".25+02:00"))).when(key % 5 == 3, F.concat(F.left(day, F.lit(5)), F.lit("13-01"))).otherwise(F.concat(day, F.lit(" "), second))
    return table(spark, sf_dir, "events").select("event_id", fn.parse_timestamp(text).cast("timestamp_ntz").alias("moment"))


PARSE_TIMESTAMP = "SELECT event_id, CASE event_id % 5 WHEN 0 THEN date_trunc('day', ts::TIMESTAMP) WHEN 1 THEN date_trunc('second', ts::TIMESTAMP) WHEN 2 THEN date_trunc('second', ts::TIMESTAMP) + INTERVAL 250 MILLISECOND - INTERVAL 2 HOUR END::TIMESTAMP AS moment FROM events"


def is_git_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select("key", fn.is_git_url(_case("https://github.com/{t}/{k}", "GIT@host:{k}", "./{t}/{k}", "SSH://h/{k}", "{t}/{k}.GIT", "ftp://h/{k}")).alias("is_git"))


IS_GIT_URL = _sql("SELECT key, key % 6 IN (0, 1, 3, 4) AS is_git FROM p")


def hub_uri(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = _case("hub://{t}/api/c{k}", "hub://{t}/core", "hub://{k}", "hub://a//{t}/b/{k}/")
    return _parts(spark, sf_dir).select("key", fn.hub_bundle(uri).alias("bundle"), fn.hub_concept(uri).alias("concept"))


HUB_URI = _sql("SELECT key, CASE key % 4 WHEN 0 THEN t || '/api' WHEN 1 THEN t || '/core' WHEN 3 THEN 'a/' || t || '/b' END AS bundle, CASE key % 4 WHEN 0 THEN 'c' || key WHEN 3 THEN key::VARCHAR END AS concept FROM p")


def endpoint_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    method = F.element_at(F.array(*[F.lit(x) for x in ("GET", "Post", "DELETE")]), (F.col("key") % 3 + 1).cast("int"))
    return _parts(spark, sf_dir).select("key", fn.endpoint_id(method, _case("/{t}/{{id}}/x{k}/".replace("{{id}}", "{id}"), "/", "/{t}")).alias("id"))


ENDPOINT_ID = _sql("SELECT key, CASE key % 3 WHEN 0 THEN 'get-' || t || '-id-x' || key WHEN 1 THEN 'post-' ELSE 'delete-' || t END AS id FROM p")


def first_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of documents with headings put between their lines."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("#"), F.lit("+")).alias("text"))
    head = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("\n## two\n#  One "), F.col("doc_id").cast("string"), F.lit(" \n# more"))).otherwise(F.lit("\n## only two\n#no"))
    return d.select("doc_id", fn.first_heading(F.concat("text", head)).alias("heading"))


FIRST_HEADING = "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'One ' || doc_id ELSE '' END AS heading FROM documents"


def parse_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = _text("# {name}\n| Column | Type | Nullable | Default | Description |\n| --- | --- | --- | --- | --- |\n| id{k} | {t} | NO | NULL | key |\n | name | text | YES | NULL | {name} |\n| short | x |\n")
    return _parts(spark, sf_dir).select("key", F.inline(export.parse_columns(body)))


PARSE_COLUMNS = _sql("SELECT key, 'id' || key AS name, t AS type, 'key' AS description FROM p UNION ALL SELECT key, 'name', 'text', name FROM p")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of parts: with front matter, broken or without it."""
    whole = "---\ntype: {t}\ntitle: 'Part {k}'\ntags: [a, t{k}]\ntimestamp: 2024-01-02T03:04:05Z\nowner: {name}\n---\n\n\n# {name}\n\n## Citations\n[1] [Doc](docs/{k}.md)\n[2] https://e.org/{k}\n# Next\n[3] no\n"
    p = _parts(spark, sf_dir)
    content = F.when(F.col("key") % 7 == 0, _text("---\ntype: [{k}\n---\nbody")).when(F.col("key") % 7 == 1, _text("no front matter {k}")).otherwise(_text(whole))
    return p.select(_text("tables/{k}.md").alias("path"), content.cast("binary").alias("content"), F.lit(None).cast("string").alias("parse_error"))


def parse_frontmatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundle.parse_files(_files(spark, sf_dir)).select("id", "type", "title", F.array_join("tags", ",").alias("tags"), "timestamp", F.col("extra")["owner"].alias("owner"), F.col("parse_error").isNotNull().alias("failed"))


PARSE_FRONTMATTER = _sql("SELECT 'tables/' || key AS id, CASE WHEN w THEN t END AS type, CASE WHEN w THEN 'Part ' || key END AS title, CASE WHEN w THEN 'a,t' || key END AS tags, CASE WHEN w THEN '2024-01-02T03:04:05Z' END AS timestamp, CASE WHEN w THEN '\"' || name || '\"' END AS owner, key % 7 = 0 AS failed FROM (SELECT *, key % 7 > 1 AS w FROM p)")


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundle.parse_files(_files(spark, sf_dir)).select("id", F.inline("citations"))


CITATIONS = _sql("SELECT 'tables/' || key AS id, 1 AS number, 'Doc' AS title, 'docs/' || key || '.md' AS uri FROM p WHERE key % 7 > 1 UNION ALL SELECT 'tables/' || key, 2, 'https://e.org/' || key, 'https://e.org/' || key FROM p WHERE key % 7 > 1")


def broken_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the cited documents exist."""
    files = _files(spark, sf_dir)
    there = as_concepts(_parts(spark, sf_dir).where("key % 3 = 0"), id=_text("tables/docs/{k}"), path=_text("tables/docs/{k}.md"))
    known = bundle.file_ids(files).unionByName(there.select("id"))
    return validate.citation_issues(bundle.parse_files(files).unionByName(there), known).select("concept_id", "message")


BROKEN_CITATIONS = _sql("SELECT 'tables/' || key AS concept_id, 'broken citation link: target concept ''tables/docs/' || key || ''' (resolved from ''docs/' || key || '.md'') does not exist' AS message FROM p WHERE key % 7 > 1 AND key % 3 <> 0")


def outside_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = as_concepts(_parts(spark, sf_dir), id=F.col("k"), path=_text("d/{k}.md"), body=_case("[x](../../{t}.md) [y](#here) [z](https://e.org/{k})", "[x](../{k}.md)", "[x](/../{k}.md)").alias("body"))
    return validate.link_issues(c).select("concept_id", "message")


OUTSIDE_LINKS = _sql("SELECT key::VARCHAR AS concept_id, CASE key % 3 WHEN 0 THEN 'link ''../../' || t || '.md'' references a path outside the bundle' ELSE 'link ''/../' || key || '.md'' references a path outside the bundle' END AS message FROM p WHERE key % 3 <> 1")


def broken_remote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links to bundles by type; only even keys are there, and one type in five not at all."""
    p = _parts(spark, sf_dir)
    links = p.select(F.col("k").alias("concept_id"), _text("{k}.md").alias("path"), _text("hub://org/{t}/c{k}").alias("target"))
    remote = p.where("key % 2 = 0 and t not like 'PROMO%'").select(_text("org/{t}").alias("bundle"), _text("c{k}").alias("concept"))
    return validate.remote_issues(links, remote).select("concept_id", "severity", "message")


BROKEN_REMOTE_LINKS = _sql(", r AS (SELECT DISTINCT t FROM p WHERE key % 2 = 0 AND t NOT LIKE 'PROMO%') SELECT key::VARCHAR AS concept_id, CASE WHEN t IN (SELECT t FROM r) THEN 'ERROR' ELSE 'WARNING' END AS severity, CASE WHEN t IN (SELECT t FROM r) THEN 'broken remote link: concept ''c' || key || ''' not found in remote bundle ''org/' || t || '''' ELSE 'remote bundle ''org/' || t || ''' could not be resolved or is empty' END AS message FROM p WHERE key % 2 = 1 OR t NOT IN (SELECT t FROM r)").replace("FROM part) , r", "FROM part), r")


def portal_link_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parts(spark, sf_dir)
    links = p.select(_text("a/{t}/b").alias("source"), _case("{t}/n{k}.md", "../d{k}", "/x/{t}/n{k}.md#s", "none{k}").alias("target"))
    ids = p.select(F.explode(F.array(_text("x/{t}/n{k}"), _text("a/d{k}"))).alias("id"))
    return graph.resolve_loosely(links, ids)


PORTAL_LINK_RESOLVE = _sql("SELECT 'a/' || t || '/b' AS source, CASE key % 4 WHEN 0 THEN t || '/n' || key || '.md' WHEN 1 THEN '../d' || key WHEN 2 THEN '/x/' || t || '/n' || key || '.md#s' ELSE 'none' || key END AS target, CASE key % 4 WHEN 1 THEN 'a/d' || key WHEN 3 THEN NULL ELSE 'x/' || t || '/n' || key END AS id FROM p")


def pull_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.struct(F.col("k").alias("id"), F.col("name").alias("title"), F.col("t").alias("description"))
    answer = F.when(F.col("key") % 2 == 0, F.to_json(F.struct(F.array(item).alias("concepts")))).otherwise(F.to_json(F.array(item)))
    return harvest.parse_pull(_parts(spark, sf_dir).select(answer.alias("json"))).select("id", "body")


PULL_PARSE = _sql("SELECT key::VARCHAR AS id, '# ' || name || chr(10) || chr(10) || t AS body FROM p")


def merge_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = "array<struct<number:int,title:string,uri:string>>"
    cite = lambda n, title, uri: F.struct(F.lit(n).alias("number"), title.alias("title"), uri.alias("uri"))
    one = F.array(cite(1, F.col("name"), F.col("t")), cite(3, F.lit("three"), F.col("k"))).cast(kind)
    two = F.array(cite(2, F.lit("second"), F.col("t"))).cast(kind)
    shown = F.array_join(F.transform(delta.merged_citations(one, two), lambda c: F.concat(c["number"].cast("string"), F.lit(":"), c["title"], F.lit(":"), c["uri"])), ",")
    tags = delta.merged_tags(F.array(F.lit("z"), F.lit(""), F.col("t")), F.array(F.col("k"), F.col("t")))
    return _parts(spark, sf_dir).select("key", F.array_join(tags, ",").alias("tags"), shown.alias("citations"))


MERGE_CITATIONS = _sql("SELECT key, key || ',' || t || ',z' AS tags, '2:second:' || t || ',3:three:' || key AS citations FROM p")


def harvest_fk_selfjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A two-column foreign key from each even order table to the one before it."""
    p = _parts(spark, sf_dir)
    cons = p.where("key > 1").select(_text("fk{k}").alias("constraint_name"), F.concat(F.lit("pk"), (F.col("key") - 1).cast("string")).alias("unique_constraint_name"))
    ends = [p.select(_text("fk{k}").alias("constraint_name"), _text("t{k}").alias("table_name"), F.lit(f"c{i}").alias("column_name"), F.lit(i).alias("ordinal_position"), F.lit(3 - i).alias("position_in_unique_constraint")) for i in (1, 2)]
    ends += [p.select(_text("pk{k}").alias("constraint_name"), _text("t{k}").alias("table_name"), F.lit(f"id{i}").alias("column_name"), F.lit(i).alias("ordinal_position"), F.lit(None).cast("int").alias("position_in_unique_constraint")) for i in (1, 2)]
    use = ends[0]
    for e in ends[1:]:
        use = use.unionByName(e)
    return harvest.fk_pairs(cons, use)


HARVEST_FK_SELFJOIN = "SELECT 't' || p.p_partkey AS table_name, 'c' || i AS column_name, 't' || o.p_partkey AS foreign_table, 'id' || (3 - i) AS foreign_column FROM part p JOIN part o ON o.p_partkey = p.p_partkey - 1 CROSS JOIN (VALUES (1), (2)) v(i) WHERE p.p_partkey > 1"


# Histories: events as commits, each of which changes as many files as its user's number modulo 40 says


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("user_id % 40 > 0")
    return e.select(F.sha2(F.col("event_id").cast("string"), 256).alias("commit"), F.explode(F.sequence(F.lit(1), (F.col("user_id") % 40).cast("int"))).alias("i")).select("commit", F.format_string("f%03d", "i").alias("path"), F.when(F.col("i") % 2 == 0, F.lit("Modify")).otherwise(F.lit("Insert")).alias("change"))


def harvest_git(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repository, commit and contributor concepts."""
    c = history.history_concepts(event_commits(spark, sf_dir).withColumn("parents", F.array(F.sha2("hash", 256))), _changes(spark, sf_dir), "main", ["https://e.org/r.git"])
    return c.select("id", "type", "title", "description", "timestamp", "body")


HARVEST_GIT = """
WITH e AS (SELECT *, sha256(event_id::VARCHAR) AS hash, strftime(ts::TIMESTAMP, '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM events),
s AS (SELECT count(*) AS n, count(DISTINCT user_id) AS u, arg_max(hash, (ts, -event_id)) AS last FROM e),
r AS (SELECT * FROM e ORDER BY ts DESC, event_id LIMIT 15),
f AS (SELECT hash, string_agg('- **' || CASE WHEN i % 2 = 0 THEN 'Modify' ELSE 'Insert' END || '**: `f' || lpad(i::VARCHAR, 3, '0') || '`' || chr(10), '' ORDER BY i) AS files FROM (SELECT hash, unnest(range(1, (user_id % 40 + 1)::BIGINT)) AS i FROM r) WHERE i <= 30 GROUP BY 1),
c AS (SELECT 'user.' || user_id || '@example.com' AS email, 'User ' || user_id AS name, count(*) AS n, strftime(min(ts::TIMESTAMP), '%Y-%m-%dT%H:%M:%SZ') AS first_at, strftime(max(ts::TIMESTAMP), '%Y-%m-%dT%H:%M:%SZ') AS last_at, 'user-' || user_id || '-at-example-com' AS slug FROM events GROUP BY user_id)
SELECT 'git/repository' AS id, 'Git Repository' AS type, 'Git Repository' AS title, 'Summary statistics of the git repository status and history.' AS description, NULL::VARCHAR AS timestamp,
 '# Git Repository Summary' || chr(10) || chr(10) || '* **Remote Origin**: https://e.org/r.git' || chr(10) || '* **Active Branch**: `main`' || chr(10) || '* **Total Commits**: ' || n || chr(10) || '* **Total Contributors**: ' || u || chr(10) || '* **Last Commit**: [' || left(last, 8) || '](commits/' || left(last, 8) || '.md)' || chr(10) AS body FROM s
UNION ALL SELECT 'git/commits/' || left(r.hash, 8), 'Git Commit', 'Commit: ' || left(r.hash, 8), 'Git commit hash ' || left(r.hash, 8) || ' by User ' || user_id || '.', stamp,
 '# Commit ' || r.hash || chr(10) || chr(10) || '* **Author**: User ' || user_id || ' (< User.' || user_id || '@Example.com >)' || chr(10) || '* **Date**: ' || stamp || chr(10) || chr(10) || '## Message' || chr(10) || chr(10) || '```' || chr(10) || event_type || chr(10) || '```' || chr(10) || chr(10)
 || '## Parents' || chr(10) || '- [' || left(sha256(r.hash), 8) || '](' || left(sha256(r.hash), 8) || '.md)' || chr(10) || chr(10) || '## File Diffs' || chr(10) || chr(10)
 || CASE WHEN user_id % 40 = 0 THEN '*No file changes detected (possibly a merge commit).*' ELSE f.files || CASE WHEN user_id % 40 > 30 THEN chr(10) || '... and ' || (user_id % 40 - 30) || ' more files.' ELSE '' END END FROM r LEFT JOIN f ON f.hash = r.hash
UNION ALL SELECT 'git/contributors/' || slug, 'Git Contributor', 'Contributor: ' || name, 'Contributor metrics for ' || name || ' in this project.', NULL,
 '# Contributor Profile: ' || name || chr(10) || chr(10) || '* **Email Address**: ' || email || chr(10) || '* **Total Commits**: ' || n || chr(10) || '* **First Contribution**: ' || first_at || chr(10) || '* **Latest Contribution**: ' || last_at || chr(10) FROM c
"""


def commit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as a log and read again."""
    e = event_commits(spark, sf_dir).withColumn("parents", F.array().cast("array<string>"))
    return history.parse_log(e.select(F.col("ord").alias("at_line"), history.log_record().alias("value")), "at_line").select("hash", "author_name", "message", "at")


COMMIT_LOG = "SELECT sha256(event_id::VARCHAR) AS hash, 'User ' || user_id AS author_name, event_type AS message, date_trunc('second', ts::TIMESTAMP) AS at FROM events"

COMPUTED = {n: (globals()[n], globals()[n.upper()]) for n in "resolve_link extract_links parse_timestamp is_git_url hub_uri endpoint_id first_heading parse_columns parse_frontmatter citations broken_citations outside_links broken_remote_links portal_link_resolve pull_parse merge_citations harvest_fk_selfjoin harvest_git commit_log".split()}
