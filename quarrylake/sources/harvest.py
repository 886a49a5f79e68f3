"""Harvesters: relational catalogs, OpenAPI, protobuf, histories and web pages as concepts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylake.functions import email_slug, endpoint_id, filled, proto_link, short_desc, short_hash, web_id
from quarrylake.model import as_concepts
from quarrylake.storage import shuffled

TABLES = "name string, description string"
COLUMNS = "table_name string, name string, data_type string, is_nullable boolean, default_value string, description string, position int"
FOREIGN_KEYS = "table_name string, column_name string, foreign_table string, foreign_column string"


def fk_groups(fks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Foreign keys by the table they start from, and by the one they point to."""
    out = fks.groupBy(F.col("table_name").alias("name")).agg(F.array_sort(F.collect_list(F.struct("column_name", "foreign_table", "foreign_column"))).alias("outgoing"))
    back = fks.groupBy(F.col("foreign_table").alias("name")).agg(F.array_sort(F.collect_list(F.struct("table_name", "column_name"))).alias("incoming"))
    return out, back


def schema_concepts(tables: DataFrame, columns: DataFrame, fks: DataFrame, brand: str, timestamp: str | None = None) -> DataFrame:
    """A concept for each table: description, a schema table of its columns in order, and its relationships both ways."""
    cols = columns.groupBy(F.col("table_name").alias("name")).agg(F.array_sort(F.collect_list(F.struct("position", F.struct("name", "data_type", "is_nullable", "default_value", "description").alias("c")))).alias("cols"))
    out, back = fk_groups(fks)
    t = tables.select("name", filled("description").alias("description")).join(cols, "name", "left").join(out, "name", "left").join(back, "name", "left")

    def row(x: Column) -> Column:
        c = x["c"]
        return F.concat(F.lit("| "), F.concat_ws(" | ", c["name"], c["data_type"], F.when(c["is_nullable"], F.lit("YES")).otherwise(F.lit("NO")), F.coalesce(F.nullif(c["default_value"], F.lit("")), F.lit("NULL")), F.coalesce(F.nullif(c["description"], F.lit("")), F.lit("-"))), F.lit(" |\n"))

    rows = F.coalesce(F.array_join(F.transform("cols", row), ""), F.lit(""))
    refs = F.coalesce(F.array_join(F.transform("outgoing", lambda f: F.concat(F.lit("*   Column `"), f["column_name"], F.lit("` references ["), f["foreign_table"], F.lit(" Table]("), F.lower(f["foreign_table"]), F.lit(".md) via `"), f["foreign_column"], F.lit("`.\n"))), ""), F.lit(""))
    used = F.coalesce(F.array_join(F.transform("incoming", lambda f: F.concat(F.lit("*   Referenced by ["), f["table_name"], F.lit(" Table]("), F.lower(f["table_name"]), F.lit(".md) via `"), f["column_name"], F.lit("`.\n"))), ""), F.lit(""))
    about = F.when(F.col("description") != "", F.col("description")).otherwise(F.concat(F.lit("Metadata representation of the "), "name", F.lit(" table.")))
    body = F.concat(
        F.lit("# "), "name", F.lit(" Table\n\n"), about, F.lit("\n\n## Schema\n| Column | Type | Nullable | Default | Description |\n| ------ | ---- | -------- | ------- | ----------- |\n"), rows, F.lit("\n"),
        F.when((refs != "") | (used != ""), F.concat(F.lit("## Key Relationships\n"), refs, used)).otherwise(F.lit("")),
    )
    ident = F.concat(F.lit("tables/"), F.lower("name"))
    return as_concepts(t, id=ident, path=F.concat(ident, F.lit(".md")), type=F.lit(f"{brand} Table"), title=F.concat("name", F.lit(" Table")), resource=F.col("name"), tags=F.array(F.lit("database"), F.lit("table"), F.lit(brand.lower())), timestamp=F.lit(timestamp), body=body)


def catalog_tables(spark: SparkSession, frames: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(tables, columns) of named DataFrames, from their schemas alone."""
    tables = spark.createDataFrame([(n, "") for n in sorted(frames)], TABLES)
    cols = [(n, f.name, f.dataType.simpleString(), f.nullable, "", "", i) for n in sorted(frames) for i, f in enumerate(frames[n].schema.fields, 1)]
    return tables, spark.createDataFrame(cols, COLUMNS)


def catalog_of_jdbc(spark: SparkSession, url: str, brand: str, schema: str, properties: dict | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tables, columns, foreign keys) of a database that has an information_schema; filters run in the database."""
    if not schema:
        raise ValueError("a schema is needed")

    def ask(query: str) -> DataFrame:
        return spark.read.format("jdbc").options(url=url, query=query, **(properties or {})).load()

    s = schema.replace("'", "''")
    comment = {"MySQL": "t.table_comment", "Postgres": "obj_description((quote_ident(t.table_schema) || '.' || quote_ident(t.table_name))::regclass)"}.get(brand, "''")
    tables = ask(f"SELECT t.table_name AS name, {comment} AS description FROM information_schema.tables t WHERE t.table_schema = '{s}' AND t.table_type = 'BASE TABLE'")
    note = {"MySQL": "c.column_comment"}.get(brand, "''")
    columns = ask(f"SELECT c.table_name, c.column_name AS name, c.data_type, CASE c.is_nullable WHEN 'NO' THEN 0 ELSE 1 END AS is_nullable, c.column_default AS default_value, {note} AS description, c.ordinal_position AS position FROM information_schema.columns c WHERE c.table_schema = '{s}'")
    if brand == "MySQL":
        fks = ask(f"SELECT table_name, column_name, referenced_table_name AS foreign_table, referenced_column_name AS foreign_column FROM information_schema.key_column_usage WHERE table_schema = '{s}' AND referenced_table_name IS NOT NULL")
    else:
        fks = fk_pairs(ask(f"SELECT constraint_name, unique_constraint_name FROM information_schema.referential_constraints WHERE constraint_schema = '{s}'"), ask(f"SELECT constraint_name, table_name, column_name, ordinal_position, position_in_unique_constraint FROM information_schema.key_column_usage WHERE table_schema = '{s}'"))
    return tables, columns.withColumn("is_nullable", F.col("is_nullable") == 1), fks


def fk_pairs(constraints: DataFrame, usage: DataFrame) -> DataFrame:
    """Foreign keys of referential constraints: the usage of both ends, column by column."""
    u = usage.alias("u").join(constraints.alias("r"), F.col("u.constraint_name") == F.col("r.constraint_name"))
    back = usage.alias("k")
    pairs = u.join(back, (F.col("k.constraint_name") == F.col("r.unique_constraint_name")) & (F.col("k.ordinal_position") == F.col("u.position_in_unique_constraint")))
    return pairs.select(F.col("u.table_name").alias("table_name"), F.col("u.column_name").alias("column_name"), F.col("k.table_name").alias("foreign_table"), F.col("k.column_name").alias("foreign_column"))


# OpenAPI

METHODS = ("get", "post", "put", "delete", "patch", "options", "head")


def type_name(schema: dict | None) -> str:
    """A schema's name: of a reference its last part, of an array its items' name after [], else its type, `any` without schema."""
    if not schema:
        return "any"
    if "$ref" in schema:
        return schema["$ref"].rsplit("/", 1)[-1]
    kind = schema.get("type")
    kind = next((k for k in kind if k != "null"), None) if isinstance(kind, list) else kind
    if kind == "array":
        return "[]" + type_name(schema.get("items"))
    return kind or "object"


def upgraded(spec: dict) -> dict:
    """A version 2 specification in the shape of version 3, as far as endpoints need it."""
    if "swagger" not in spec:
        return spec
    paths = {}
    for path, item in (spec.get("paths") or {}).items():
        out = {}
        for method, op in item.items():
            if method not in METHODS:
                continue
            op, params, body = dict(op), [], None
            for p in [*item.get("parameters", []), *op.get("parameters", [])]:
                if p.get("in") == "body":
                    media = (op.get("consumes") or spec.get("consumes") or ["application/json"])[0]
                    body = {"description": p.get("description", ""), "content": {media: {"schema": p.get("schema")}}}
                elif p.get("in") != "formData":
                    params.append({**p, "schema": p.get("schema") or {k: p[k] for k in ("type", "items") if k in p}})
            op["parameters"] = params
            if body:
                op["requestBody"] = body
            media = (op.get("produces") or spec.get("produces") or ["application/json"])[0]
            op["responses"] = {c: {**r, "content": {media: {"schema": r["schema"]}} if "schema" in r else {}} for c, r in (op.get("responses") or {}).items()}
            out[method] = op
        paths[path] = out
    return {**spec, "paths": paths}


def _deref(spec: dict, x: dict | None) -> dict:
    while x and "$ref" in x:
        at = spec
        for part in x["$ref"].removeprefix("#/").split("/"):
            at = (at or {}).get(part.replace("~1", "/").replace("~0", "~"), {})
        x = at
    return x or {}


OPERATION = "path string, method string, rank int, summary string, description string, params array<struct<name:string,place:string,type:string,required:boolean,description:string>>, has_body boolean, body_type string, body_media string, body_description string, responses array<struct<code:string,description:string,type:string>>"


def spec_operations(text: str) -> list[tuple]:
    """Operations of a specification in YAML or JSON, version 2 or 3, by path and method."""
    import yaml

    spec = upgraded(yaml.safe_load(text))
    rows = []
    for path, item in sorted((spec.get("paths") or {}).items()):
        for rank, method in enumerate(METHODS):
            op = item.get(method)
            if op is None:
                continue
            params = [_deref(spec, p) for p in op.get("parameters") or []]
            body = _deref(spec, op.get("requestBody")) if op.get("requestBody") else None
            media, content = next(((m, c) for m, c in (body or {}).get("content", {}).items() if c and c.get("schema")), (None, None))
            answers = []
            for code, r in sorted((str(c), _deref(spec, r)) for c, r in (op.get("responses") or {}).items()):
                schema = next((c["schema"] for c in (r.get("content") or {}).values() if c and c.get("schema")), None)
                answers.append((code, r.get("description") or "", type_name(schema) if schema else "-"))
            rows.append((path, method.upper(), rank, op.get("summary") or "", op.get("description") or "", [(p.get("name"), p.get("in"), type_name(p.get("schema")), bool(p.get("required")), p.get("description") or "") for p in params], body is not None, type_name(content["schema"]) if content else None, media, (body or {}).get("description") or "", answers))
    return rows


def openapi_operations(spark: SparkSession, text: str) -> DataFrame:
    """Operations of one specification that is at hand; specs.operations reads many."""
    return spark.createDataFrame(spec_operations(text), OPERATION)


def _flat(x: Column) -> Column:
    return F.replace(F.coalesce(F.nullif(x, F.lit("")), F.lit("-")), F.lit("\n"), F.lit(" "))


def endpoint_concepts(ops: DataFrame, timestamp: str | None = None) -> DataFrame:
    """A concept for each operation, with tables of its parameters and responses."""
    params = F.array_join(F.transform("params", lambda p: F.concat(F.lit("| "), F.concat_ws(" | ", p["name"], p["place"], p["type"], F.when(p["required"], F.lit("Yes")).otherwise(F.lit("No")), _flat(p["description"])), F.lit(" |\n"))), "")
    answers = F.array_join(F.transform("responses", lambda r: F.concat(F.lit("| "), F.concat_ws(" | ", r["code"], _flat(r["description"]), r["type"]), F.lit(" |\n"))), "")

    def part(ok: Column, *x) -> Column:
        return F.when(ok, F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])).otherwise(F.lit(""))

    body = F.concat(
        F.lit("# "), "method", F.lit(" "), "path", F.lit("\n\n"),
        part(F.col("summary") != "", "**Summary**: ", F.col("summary"), "\n\n"), part(F.col("description") != "", F.col("description"), "\n\n"),
        part(F.size("params") > 0, "## Parameters\n| Name | In | Type | Required | Description |\n| ---- | -- | ---- | -------- | ----------- |\n", params, "\n"),
        part(F.col("has_body"), "## Request Body\n", part(F.col("body_type").isNotNull(), "- **Type**: `", F.col("body_type"), "` (", F.col("body_media"), ")\n"), part(F.col("body_description") != "", "- **Description**: ", F.replace("body_description", F.lit("\n"), F.lit(" ")), "\n"), "\n"),
        part(F.size("responses") > 0, "## Responses\n| Status Code | Description | Schema Type |\n| ----------- | ----------- | ----------- |\n", answers, "\n"),
    )
    ident = F.concat(F.lit("endpoints/"), endpoint_id("method", "path"))
    about = short_desc(F.when(F.col("summary") != "", F.col("summary")).otherwise(F.col("description")))
    return as_concepts(ops, id=ident, path=F.concat(ident, F.lit(".md")), type=F.lit("API Endpoint"), title=F.concat_ws(" ", "method", "path"), description=about, resource=F.col("path"), tags=F.array(F.lit("api"), F.lit("endpoint"), F.lower("method")), timestamp=F.lit(timestamp), body=body)


# Protobuf

_TOKEN = re.compile(r'//[^\n]*|/\*.*?\*/|"(?:[^"\\]|\\.)*"|[A-Za-z_][\w.]*|\.[A-Za-z_][\w.]*|-?\d\w*|[{}()\[\];=,<>]', re.S)
_SCALARS = set("double float int32 int64 uint32 uint64 sint32 sint64 fixed32 fixed64 sfixed32 sfixed64 bool string bytes".split())
DEFINITION = "kind string, package string, name string, fqn string, comment string, fields array<struct<name:string,type:string,tag:int,comment:string>>, methods array<struct<name:string,request:string,response:string,comment:string>>"


def parse_proto(text: str) -> list[tuple]:
    """Messages (nested ones too), then services, of a proto file, with their leading comments."""
    tokens, notes, pending, end = [], {}, [], 0
    for m in _TOKEN.finditer(text):
        t, own_line, end = m[0], "\n" in text[end : m.start()] or not tokens, m.end()
        if t.startswith(("//", "/*")):
            if own_line or pending:  # one that follows on the same line belongs to what is before it
                pending.append(t[2:].strip() if t.startswith("//") else "\n".join(x.strip().lstrip("*").strip() for x in t[2:-2].split("\n")).strip())
        else:
            if pending:
                notes[len(tokens)] = "\n".join(pending)
                pending = []
            tokens.append(t)
    messages, services, enums, package, at = [], [], set(), "", 0

    def skip_block(i: int) -> int:
        depth = 0
        while i < len(tokens):
            depth += {"{": 1, "}": -1}.get(tokens[i], 0)
            i += 1
            if depth == 0 and tokens[i - 1] == "}":
                break
        return i

    def to(i: int, what: str) -> int:
        while i < len(tokens) and tokens[i] != what:
            i += 1
        return i + 1

    def message(i: int, scope: str) -> int:
        note, name = notes.get(i, ""), tokens[i + 1]
        fqn = f"{scope}.{name}" if scope else name
        row = ["message", package, name, fqn, note, [], []]
        messages.append(row)
        i += 3
        while tokens[i] != "}":
            if tokens[i] == "message":
                i = message(i, fqn)
            elif tokens[i] == "enum":
                enums.add(f"{fqn}.{tokens[i + 1]}")
                i = skip_block(i)
            elif tokens[i] == "oneof":
                i += 3
            elif tokens[i] in ("option", "reserved", "extensions", ";"):
                i = to(i, ";")
            else:
                note, repeated = notes.get(i, ""), tokens[i] == "repeated"
                i += tokens[i] in ("repeated", "optional", "required")
                if tokens[i] == "map" and tokens[i + 1] == "<":
                    kind, i = ("map", tokens[i + 2], tokens[i + 4]), i + 6
                else:
                    kind, i = ("repeated" if repeated else "", tokens[i]), i + 1
                row[5].append((tokens[i], (fqn, kind), int(tokens[i + 2], 0), note))
                i = to(i, ";")
            if i < len(tokens) and tokens[i] == "}" and len(tokens) > i + 1 and tokens[i - 1] == ";" and _in_oneof(tokens, i):
                i += 1
        return i + 1

    while at < len(tokens):
        t = tokens[at]
        if t == "package":
            package, at = tokens[at + 1], to(at, ";")
        elif t == "message":
            at = message(at, package)
        elif t == "enum":
            enums.add(f"{package}.{tokens[at + 1]}" if package else tokens[at + 1])
            at = skip_block(at)
        elif t == "service":
            name, note, i = tokens[at + 1], notes.get(at, ""), at + 3
            row = ["service", package, name, f"{package}.{name}" if package else name, note, [], []]
            while tokens[i] != "}":
                if tokens[i] == "rpc":
                    ends = []
                    note, method, i = notes.get(i, ""), tokens[i + 1], i + 2
                    for _ in range(2):
                        while tokens[i] != "(":
                            i += 1
                        i += 1 + (tokens[i + 1] == "stream")
                        ends.append(tokens[i])
                        i += 2
                    row[6].append((method, ends[0], ends[1], note))
                    i = skip_block(i) if tokens[i] == "{" else to(i, ";")
                else:
                    i = to(i, ";")
            services.append(row)
            at = i + 1
        else:
            at = to(at, ";")
    names = {m[3] for m in messages}

    def resolve(scope: str, kind: str) -> str:
        if kind in _SCALARS:
            return kind
        if kind.startswith("."):
            full = kind[1:]
        else:
            parts = scope.split(".") if scope else []
            tries = [".".join([*parts[:n], kind]) for n in range(len(parts), -1, -1)]
            full = next((x for x in tries if x in names or x in enums), kind)
        return "enum" if full in enums else full

    def shown(scope: str, kind: tuple) -> str:
        if kind[0] == "map":
            return f"map<{kind[1]}, {resolve(scope, kind[2])}>"
        return f"{kind[0]} {resolve(scope, kind[1])}".strip()

    for m in messages:
        m[5] = [(n, shown(*k), tag, note) for n, k, tag, note in m[5]]
    for s in services:
        s[6] = [(n, resolve(package, a), resolve(package, b), note) for n, a, b, note in s[6]]
    return [tuple(x) for x in [*messages, *services]]


def _in_oneof(tokens: list[str], i: int) -> bool:
    """Whether the closing brace at i ends a oneof block."""
    depth = 0
    for j in range(i, -1, -1):
        depth += {"}": 1, "{": -1}.get(tokens[j], 0)
        if depth == 0:
            return tokens[j - 2] == "oneof"
    return False


def proto_definitions(spark: SparkSession, texts: list[str]) -> DataFrame:
    return spark.createDataFrame([d for t in texts for d in parse_proto(t)], DEFINITION)


def proto_concepts(defs: DataFrame, timestamp: str | None = None) -> DataFrame:
    """A concept for each message and service; services link to the messages of their methods."""
    fields = F.array_join(F.transform("fields", lambda f: F.concat(F.lit("| "), F.concat_ws(" | ", f["name"], f["type"], f["tag"].cast("string"), _flat(f["comment"])), F.lit(" |\n"))), "")

    def linked(x: Column) -> Column:
        return F.concat(F.lit("["), x, F.lit("]("), proto_link(x), F.lit(")"))

    methods = F.array_join(F.transform("methods", lambda m: F.concat(F.lit("| "), F.concat_ws(" | ", m["name"], linked(m["request"]), linked(m["response"]), _flat(m["comment"])), F.lit(" |\n"))), "")
    is_message = F.col("kind") == "message"
    about = F.when(F.col("comment") != "", F.concat("comment", F.lit("\n\n"))).otherwise(F.lit(""))
    body = F.when(is_message, F.concat(F.lit("# Protobuf Message "), "fqn", F.lit("\n\n"), about, F.lit("## Fields\n| Name | Type | Tag | Description |\n| ---- | ---- | --- | ----------- |\n"), fields, F.lit("\n"))).otherwise(
        F.concat(F.lit("# Protobuf Service "), "fqn", F.lit("\n\n"), about, F.lit("## RPC Methods\n| Method | Request | Response | Description |\n| ------ | ------- | -------- | ----------- |\n"), methods, F.lit("\n"))
    )
    ident = F.concat(F.lit("protobuf/"), F.lower("fqn"))
    label = F.when(is_message, F.lit("Message")).otherwise(F.lit("Service"))
    desc = F.when(F.col("comment") != "", F.col("comment")).otherwise(F.concat(F.lit("Protobuf "), "kind", F.lit(" definition for "), "name", F.lit(".")))
    return as_concepts(defs, id=ident, path=F.concat(ident, F.lit(".md")), type=F.concat(F.lit("Protobuf "), label), title=F.concat_ws(" ", label, "name"), description=short_desc(desc), resource=F.col("fqn"), tags=F.array(F.lit("protobuf"), F.col("kind"), F.col("package")), timestamp=F.lit(timestamp), body=body)


def proto_links(defs: DataFrame) -> DataFrame:
    """(service, method, role, message_id): the message concept of each request and response, matched by lower-cased full name."""
    return method_links(defs.where("kind = 'service'").select("fqn", F.explode("methods").alias("method")), defs)


def method_links(methods: DataFrame, defs: DataFrame) -> DataFrame:
    """As proto_links, of methods(fqn, method), one row each: methods need not come together by service."""
    m = defs.where("kind = 'message'").select(F.lower("fqn").alias("key"), F.concat(F.lit("protobuf/"), F.lower("fqn")).alias("message_id"))
    ends = methods.select(F.col("fqn").alias("service"), F.col("method.name").alias("name"), F.explode(F.array(F.struct(F.lit("request").alias("role"), F.col("method.request").alias("fqn")), F.struct(F.lit("response").alias("role"), F.col("method.response").alias("fqn")))).alias("e"))
    return ends.select("service", F.col("name").alias("method"), "e.role", F.lower("e.fqn").alias("key")).join(shuffled(m), "key").select("service", "method", "role", "message_id")


# Histories: commits(hash, ord, author_name, author_email, at, message), ord 0 for the latest


def contributor_stats(commits: DataFrame) -> DataFrame:
    """By trimmed, lower-cased address (empty ones left out): commits, first and last time, and the name seen first in the log."""
    key = F.lower(F.regexp_replace(filled("author_email"), r"^\s+|\s+$", ""))
    return commits.select(key.alias("email"), "author_name", "at", "ord").where("email != ''").groupBy("email").agg(F.count("*").alias("commits"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.min_by("author_name", "ord").alias("name")).withColumn("slug", email_slug("email"))


def repo_summary(commits: DataFrame) -> DataFrame:
    key = F.lower(F.regexp_replace(filled("author_email"), r"^\s+|\s+$", ""))
    return commits.agg(F.count("*").alias("total_commits"), F.count_distinct(F.nullif(key, F.lit(""))).alias("contributors"), F.min_by("hash", "ord").alias("last_commit"))


def recent_commits(commits: DataFrame, n: int = 15) -> DataFrame:
    return commits.orderBy("ord").limit(n).select("ord", "hash", short_hash("hash").alias("short_hash"), "author_name", "at", "message")


def tree_diff(parent: DataFrame, child: DataFrame) -> DataFrame:
    """(commit, path, change) between trees(commit, path, blob): Insert, Modify or Delete; without a parent all is inserted."""
    p = parent.select("commit", "path", F.col("blob").alias("before"))
    c = child.select("commit", "path", F.col("blob").alias("after"))
    both = p.join(c, ["commit", "path"], "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))
    return both.select("commit", "path", F.when(F.col("before").isNull(), F.lit("Insert")).when(F.col("after").isNull(), F.lit("Delete")).otherwise(F.lit("Modify")).alias("change"))


def listed_changes(changes: DataFrame, most: int = 30) -> DataFrame:
    """(commit, rank, line): the first `most` files of each commit by path, and how many more there are."""
    from pyspark.sql import Window

    ranked = changes.withColumn("rank", F.row_number().over(Window.partitionBy("commit").orderBy("path")))
    shown = ranked.where(F.col("rank") <= most).select("commit", "rank", F.concat_ws(" ", "change", "path").alias("line"))
    more = changes.groupBy("commit").agg(F.count("*").alias("n")).where(F.col("n") > most).select("commit", F.lit(most + 1).alias("rank"), F.concat(F.lit("... and "), (F.col("n") - most).cast("string"), F.lit(" more files.")).alias("line"))
    return shown.unionByName(more)


# Web pages: pages(url, html)

STRIPPED = ("script", "style", "nav", "footer", "header", "aside")


def stripped_html(html: Column | str) -> Column:
    """HTML without the regions that are no content, and without elements of class sidebar."""
    out = filled(html)
    for tag in STRIPPED:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    return F.regexp_replace(out, r"""(?is)<(\w+)\b[^>]*\bclass\s*=\s*["'][^"']*\bsidebar\b[^"']*["'][^>]*>.*?</\1\s*>""", "")


def html_links(html: Column | str) -> Column:
    return F.regexp_extract_all(filled(html), F.lit(r"""(?is)<a\b[^>]*\bhref\s*=\s*["']([^"'#]+)"""), F.lit(1))


def html_title(html: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_extract(filled(html), r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1), r"\s+", " "), r"^ | $", "")


def html_markdown(html: Column | str) -> Column:
    """Headings, links, lists and paragraphs of stripped HTML as Markdown."""
    out = F.regexp_replace(stripped_html(html), r"(?is)<(head|title)\b.*?</\1\s*>", "")
    for n in range(1, 7):
        out = F.regexp_replace(out, rf"(?is)<h{n}\b[^>]*>\s*(.*?)\s*</h{n}\s*>", "\n\n" + "#" * n + " $1\n\n")
    for pattern, by in ((r"""(?is)<a\b[^>]*\bhref\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a\s*>""", "[$2]($1)"), (r"(?is)<li\b[^>]*>\s*", "\n- "), (r"(?is)<(?:strong|b)\b[^>]*>(.*?)</(?:strong|b)\s*>", "**$1**"), (r"(?is)<(?:em|i)\b[^>]*>(.*?)</(?:em|i)\s*>", "_$1_"), (r"(?is)<br\b[^>]*>", "\n"), (r"(?is)</?(?:p|div|ul|ol|section|article|table|tr)\b[^>]*>", "\n\n"), (r"(?s)<[^>]+>", "")):
        out = F.regexp_replace(out, pattern, by)
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(out, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def web_concepts(pages: DataFrame) -> DataFrame:
    """A concept for each page; pages of equal paths share an id, which collisions() shows."""
    ident = web_id("url")
    return as_concepts(pages, id=ident, path=F.concat(ident, F.lit(".md")), type=F.lit("Web Page"), title=F.coalesce(F.nullif(html_title("html"), F.lit("")), F.col("url")), resource=F.col("url"), tags=F.array(F.lit("web")), body=html_markdown("html"))


def collisions(concepts: DataFrame) -> DataFrame:
    return concepts.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


# Hub answers


def parse_pull(answers: DataFrame) -> DataFrame:
    """Concepts of answers(json): a list, or a list under `concepts`; the body is the title as a heading and the description."""
    item = "array<struct<id:string,type:string,title:string,description:string,tags:array<string>>>"
    got = F.coalesce(F.from_json("json", f"struct<concepts:{item}>")["concepts"], F.from_json("json", item))
    rows = answers.select(F.explode(got).alias("c")).select("c.*")
    return as_concepts(rows, path=F.concat("id", F.lit(".md")), body=F.concat(F.lit("# "), filled("title"), F.lit("\n\n"), filled("description")))


def curated(concepts: DataFrame, describe) -> DataFrame:
    """Concepts whose description and body pass through describe(id, title, body) -> (description, body); failures leave a row as it is.

    The hook for language models: describe runs once a row in Arrow batches, and nothing here calls a network.
    """
    import pyarrow as pa

    def run(batches):
        for b in batches:
            rows = []
            for i, t, d, x in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                try:
                    rows.append(describe(i, t, x))
                except Exception:  # noqa: BLE001  a failed call is a warning, not the end
                    rows.append((d, x))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=["id", "d", "x"])

    got = concepts.select("id", "title", "description", "body").mapInArrow(run, "id string, d string, x string")
    return concepts.drop("description", "body").join(got.withColumnsRenamed({"d": "description", "x": "body"}), "id").select(concepts.columns)


def sync_config(text: str | None) -> dict:
    """Settings of connectors from YAML; nothing for a missing file."""
    import yaml

    return (yaml.safe_load(text) or {}) if text else {}


