"""Bundles, validation, graphs, differences, merges, export and synchronisation on own fixtures."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from quarrylake import functions as fn
from quarrylake.model import as_concepts
from quarrylake.operators import catalog, delta, export, graph, validate
from quarrylake.sources import bundle, harvest, history
from quarrylake.streaming import sync

_PROTO = 'syntax = "proto3";\npackage shop;\n// An order.\nmessage Order {\n  string id = 1; // own\n  repeated Item items = 2;\n  map<string, Item> by_key = 3;\n  message Item { int32 n = 1; }\n  oneof pay { string card = 4; bool cash = 5; }\n}\nservice Orders { rpc Get(Order) returns (stream Order.Item); }\n'


def now():
    return F.lit("2025-01-01").cast("timestamp")


def put(root, path, text):
    full = os.path.join(root, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "w", encoding="utf-8", newline="") as f:
        f.write(text)


@pytest.fixture
def root(tmp_path):
    r = str(tmp_path / "b")
    put(r, "index.md", "---\nformat_version: '0.2'\n---\nhello")
    put(r, "log.md", "x")
    put(r, "deep/index.md", "x")
    put(r, "a.txt", "x")
    put(r, "tables/users.md", "---\r\ntype: Table\r\ntitle: Users\r\ndescription: people\r\ntags: [auth, core]\r\ntimestamp: 2024-01-02T03:04:05Z\r\nowner: team\r\n---\r\n\r\n\r\n# Users\r\nsee [orders](orders.md), [gone](../gone.md), [out](../../x.md), [web](https://e.org), `[c](d.md)`\r\n")
    put(r, "tables/orders.md", "---\ntype: Table\ntitle: Orders\ndescription: d\nstatus: deprecated\nverified: [{by: me, at: 2024-01-01, tier: human}]\n---\n[users](/tables/users.md#x) [users](users.md) [self](orders.md)\n")
    put(r, ".hidden/_draft.md", "no front matter")
    put(r, "bad.md", "---\ntype: a\ntype: b\n---\nbody")
    put(r, "shape.md", "---\ntags: one\n---\n")
    put(r, "open.md", "---\ntype: Note\ntitle: t\n")
    put(r, "large.md", "y" * 1001)
    return r


def test_read_bundle(spark, root):
    c = {r.id: r for r in bundle.read_bundle(spark, root, 1000).collect()}
    assert set(c) == {"tables/users", "tables/orders", ".hidden/_draft", "bad", "shape", "open", "large"}
    u = c["tables/users"]
    assert (u.type, u.tags, u.timestamp, u.extra) == ("Table", ["auth", "core"], "2024-01-02T03:04:05Z", {"owner": '"team"'})
    assert u.body.startswith("# Users\nsee") and not u.body.endswith("\n")
    assert "exceeds the limit" in c["large"].parse_error and "already defined" in c["bad"].parse_error and c["bad"].body is None
    assert "list is expected" in c["shape"].parse_error
    assert c["open"].type == "Note" and c["open"].body == "" and c[".hidden/_draft"].body == "no front matter"
    assert c["tables/orders"].verified[0].tier == "human"
    assert bundle.bundle_version(root) == "0.2"
    with pytest.raises(FileNotFoundError):
        bundle.read_bundle(spark, root + "/none")


def test_read_files_by_spark(spark, root):
    assert {r.id for r in bundle.read_files(spark, root).collect()} == {"tables/users", "tables/orders", "bad", "shape", "open", "large"}


def test_lint_messages(spark, root):
    issues = {(r.concept_id, r.severity, r.message) for r in validate.lint(bundle.read_bundle(spark, root), now()).collect()}
    assert ("tables/users", "WARNING", "broken link: target concept 'gone' (resolved from '../gone.md') does not exist") in issues
    assert ("tables/users", "WARNING", "link '../../x.md' references a path outside the bundle") in issues
    assert ("tables/orders", "WARNING", "concept is marked as deprecated") in issues
    assert ("open", "WARNING", "missing recommended 'description' field") in issues
    assert (".hidden/_draft", "ERROR", "missing or empty 'type' field in frontmatter") in issues
    assert sum(i[0] == "bad" for i in issues) == 1
    assert not any("orders.md" in i[2] or "d.md'" in i[2] for i in issues)


def test_edges_of_a_bundle(spark, root):
    e = {(r.src, r.dst, r.ordinal) for r in graph.link_edges(bundle.read_bundle(spark, root)).collect()}
    assert e == {("tables/users", "tables/orders", 0), ("tables/orders", "tables/users", 0), ("tables/orders", "tables/orders", 2)}


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(pairs)], "src string, dst string, ordinal int")


def test_walk_of_the_double_and_triple_graph(spark):
    pairs = [(str(i), str(j % 200)) for i in range(200) for j in (2 * i, 3 * i)]
    got = graph.bfs(edges(spark, sorted(set(pairs), key=lambda p: (int(p[0]), int(p[1])))), "0", 3, "bidirectional").collect()
    assert {int(r.id) for r in got} == {0, 100, 50, 150, 25, 75, 125, 175}


def test_walk_orders_and_budgets(spark):
    e = edges(spark, [("a", "c"), ("a", "b"), ("d", "a"), ("c", "e"), ("b", "e"), ("e", "a")])
    order = lambda d, n: [r.id for r in graph.bfs(e, "a", n, d).orderBy("depth", "place").collect()]
    assert order("outbound", 0) == ["a"] and order("outbound", 2) == ["a", "c", "b", "e"]
    assert order("inbound", 1) == ["a", "d", "e"] and order("bidirectional", 1) == ["a", "c", "b", "d", "e"]
    with pytest.raises(ValueError, match="unknown direction"):
        graph.bfs(e, "a", 1, "sideways", strict=True)
    c = as_concepts(spark.createDataFrame([(x, "T", "x" * 100) for x in "abcde"], "id string, type string, body string"))
    full = graph.assemble(c, e, "a", graph.Options(depth=3)).orderBy("depth", "place").collect()
    one = full[0].characters
    part = graph.assemble(c, e, "a", graph.Options(depth=3, max_characters=2 * one + 5)).orderBy("depth", "place").collect()
    assert [r.id for r in part] == [r.id for r in full][:2]
    assert graph.assemble(c, e, "a", graph.Options(max_characters=10)).count() == 0
    assert graph.assemble(c, e, "a", graph.Options(depth=3, max_tokens=one // 4, max_characters=0)).count() == 1
    text = graph.context(graph.assemble(c, e, "a", graph.Options(depth=0))).first()
    assert text.context.startswith('<context>\n<concept id="a">') and text.total_characters == one
    with pytest.raises(LookupError):
        graph.assemble(c, e, "zz")


def test_trust(spark):
    rows = [("a", [], "2024-01-01"), ("b", [("x", "", "human"), ("y", "", "Certified")], "2026-01-01"), ("c", [("x", "", "odd")], "soon"), ("d", None, None)]
    df = spark.createDataFrame(rows, "id string, verified array<struct<by:string,at:string,tier:string>>, stale_after string")
    got = {r.id: (r.tier, r.stale, r.ok) for r in df.select("id", fn.trust_tier("verified").alias("tier"), fn.is_stale("stale_after", now()).alias("stale"), fn.is_verified("verified").alias("ok")).collect()}
    assert got == {"a": ("unverified", True, False), "b": ("certified", False, True), "c": ("verified", False, True), "d": ("unverified", False, False)}


def test_search(spark):
    c = as_concepts(spark.createDataFrame([("a", "Table", "Users", ["Auth"], "people"), ("b", "API", None, None, "sign in")], "id string, type string, title string, tags array<string>, body string"))
    ids = lambda df: [r.id for r in df.collect()]
    assert ids(catalog.search(c)) == ["a", "b"] and ids(catalog.search(c, "PEOPLE user")) == ["a"] and ids(catalog.search(c, "é")) == ["a", "b"]
    assert ids(catalog.search(c, kind="api")) == ["b"] and ids(catalog.search(c, tag="auth")) == ["a"] and ids(catalog.portal_search(c, "people")) == []
    with pytest.raises(LookupError):
        catalog.get_concept(c, "zz")


def snapshot(spark, rows):
    return as_concepts(spark.createDataFrame([(i, t, d, tags, ts, b, x) for i, t, d, tags, ts, b, x in rows], "id string, type string, description string, tags array<string>, timestamp string, body string, extra map<string,string>"))


def test_diff_and_merge(spark):
    a = snapshot(spark, [("users", "T", "old", ["x", "y"], "2024-01-01T00:00:00Z", "one", {"k": "1"}), ("deploy", "T", "", [], "", "b", None)])
    b = snapshot(spark, [("users", "T", "new", ["y", "z"], "2024-02-01T00:00:00Z", "two", {"j": "2"}), ("signup", "T", "", [], "", "b", None)])
    d = {r.id: r for r in delta.diff(a, b).collect()}
    assert {k: r.change for k, r in d.items()} == {"users": "MODIFIED", "deploy": "DELETED", "signup": "ADDED"}
    assert d["users"].body_drift and [f.field for f in d["users"].fields] == ["description", "extra.j", "extra.k", "tags", "timestamp"]
    assert delta.diff(a, a).count() == 0
    assert "[+] ADDED    signup" in [r.text for r in delta.diff_report(delta.diff(a, b)).collect()]
    m = {r.id: r for r in delta.merge(a, b).collect()}
    assert set(m) == {"users", "deploy", "signup"} and m["users"].body == "two" and m["users"].tags == ["x", "y", "z"] and m["users"].extra == {"k": "1", "j": "2"}
    assert {r.id: r.body for r in delta.merge(a, b, "ours").collect()}["users"] == "one"
    with pytest.raises(ValueError, match="unknown merge strategy"):
        delta.merge(a, b, "both")


def test_jsonld_and_rendering(spark, tmp_path):
    body = "| Column | Type | Nullable | Default | Description |\n|---|---|---|---|---|\n| id | int | NO | NULL | key |\n| n | text | YES | NULL | - |"
    c = as_concepts(spark.createDataFrame([("t", "t.md", "Postgres Table", "T", body, ["b"]), ("e", "e.md", "API Endpoint", None, "x", None), ("p", "p.md", "Playbook", "P", "\n\ntext\n\n", [])], "id string, path string, type string, title string, body string, tags array<string>"))
    got = {r.id: json.loads(r.node) for r in export.jsonld(c).collect()}
    assert got["t"]["@type"] == "Dataset" and [x["name"] for x in got["t"]["variableMeasured"]] == ["id", "n"] and got["t"]["keywords"] == ["b"]
    assert got["e"] == {"@type": "WebAPI", "@id": "bundle://e", "name": "e"} and got["p"]["@type"] == "TechArticle"
    assert len(json.loads(export.jsonld_document(export.jsonld(c)).first().document)["@graph"]) == 3
    out = str(tmp_path / "out")
    assert export.write_bundle(c, out, at="2025-01-01T00:00:00Z") == 3
    back = {r.id: r for r in bundle.read_bundle(spark, out).collect()}
    assert back["p"].body == "text" and back["p"].status == "stable" and back["p"].generated.at == "2025-01-01T00:00:00Z" and back["t"].body == body
    with pytest.raises(ValueError, match="leaves the bundle"):
        export.write_bundle(c.withColumn("path", F.lit("../x.md")), out)


def test_harvesters(spark):
    v2 = "swagger: '2.0'\npaths: {/pets: {get: {summary: s, parameters: [{name: n, in: query, type: array, items: {type: string}}], responses: {'200': {description: d, schema: {$ref: '#/definitions/Pet'}}}}}}"
    e = harvest.endpoint_concepts(harvest.openapi_operations(spark, v2)).first()
    assert e.id == "endpoints/get-pets" and "| n | query | []string | No | - |" in e.body and "| 200 | d | Pet |" in e.body

    p = {r.id: r for r in harvest.proto_concepts(harvest.proto_definitions(spark, [_PROTO])).collect()}
    order = p["protobuf/shop.order"].body
    assert "| items | repeated shop.Order.Item | 2 | - |" in order and "| by_key | map<string, shop.Order.Item> | 3 | - |" in order and "| cash | bool | 5 | - |" in order and "An order." in order
    page = spark.createDataFrame([("https://h/a/?q", "<title>T </title><nav><a href='/x'>n</a></nav><h1>Hi</h1><p>some <b>bold</b> <a href='/y'>link</a></p>")], "url string, html string")
    w = harvest.web_concepts(page).first()
    assert (w.id, w.title, w.body) == ("web/a/index", "T", "# Hi\n\nsome **bold** [link](/y)")
    c = harvest.curated(as_concepts(spark.createDataFrame([("a", "t"), ("b", "t")], "id string, title string")), lambda i, t, b: ("new", "body") if i == "a" else 1 / 0)
    assert {r.id: r.description for r in c.collect()} == {"a": "new", "b": None}


class Memory:
    active = True

    def __init__(self, name, incoming=None):
        self.name, self.pushed, self.incoming = name, [], incoming

    def push(self, concepts):
        self.pushed.append(sorted(r.id for r in concepts.collect()))

    def pull(self, spark):
        return self.incoming if self.incoming is not None else as_concepts(spark.createDataFrame([], "id string"))


def test_sync_pushes_and_pulls_changes_once(spark, tmp_path):
    one = snapshot(spark, [("a", "T", "", [], "", "x", None), ("b", "T", "", [], "", "y", None)])
    conn, off = Memory("mem", snapshot(spark, [("z", "T", "", [], "", "p", None)])), Memory("off")
    off.active = False
    states, pulls, written = sync.StateTable(spark, str(tmp_path / "s"), sync.STATE), sync.StateTable(spark, str(tmp_path / "p"), sync.PULL_STATE), []
    go = lambda c: sync.sync_once(c, [conn, off], states, pulls, lambda d: written.append(d.count()), F.lit("2025-01-01"))
    assert go(one) == {"mem": (2, 1)} and go(one) == {"mem": (0, 0)}
    two = one.withColumn("body", F.when(F.col("id") == "a", F.lit("new")).otherwise(F.col("body")))
    assert go(two) == {"mem": (1, 0)} and conn.pushed == [["a", "b"], ["a"]] and written == [1]
    assert {r.external_id for r in states.load().collect()} == {"mem-a", "mem-b"} and not off.pushed


def test_streaming_upsert(spark, tmp_path):
    src, kind = str(tmp_path / "in"), "id string, v int, at int, op string"
    table = sync.StateTable(spark, str(tmp_path / "t"), "id string, v int")
    for rows in ([("a", 1, 1, "write"), ("a", 2, 2, "write"), ("b", 1, 1, "write")], [("b", 9, 3, "delete"), ("c", 5, 3, "write")]):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(src)
        q = sync.stream_upsert(spark.readStream.schema(kind).parquet(src), table, "id", [F.desc("at")], str(tmp_path / "c"))
        q.awaitTermination(60)
    assert {(r.id, r.v) for r in table.load().collect()} == {("a", 2), ("c", 5)}
    before, after = (spark.createDataFrame(x, "path string, modified int") for x in ([("a", 1), ("b", 1)], [("b", 2), ("c", 1)]))
    assert {(r.path, r.op) for r in sync.snapshot_changes(before, after).collect()} == {("a", "remove"), ("b", "write"), ("c", "create")}


def test_links_of_long_bodies(spark):
    n = 1_000_000
    bodies = ["[" + "a" * n + "](x.md) [b](y.md)", "[" + "\\\\*" * (n // 2) + "](x.md)", "[" * 20_000 + "a](x.md)", "[" + "[b]" * 100_000 + "](x.md)", "[a](" + "u" * n + ")", "[a](x.md 't) " * 2_000, "[a][" + "r" * n + "]\n\n[" + "r" * n + "]: x.md"]
    got = spark.createDataFrame(list(enumerate(bodies)), "i int, body string").select("i", fn.extract_links("body").alias("t")).collect()
    got = {r.i: r.t for r in got}
    assert got[0] == ["x.md", "y.md"] and got[1] == ["x.md"] and got[2] == ["x.md"] and got[3] == ["x.md"] and got[4] == ["u" * n] and got[6] == ["x.md"]


def test_state_table_survives_a_crash(spark, tmp_path):
    table = sync.StateTable(spark, str(tmp_path / "state"), "k string, v int")
    assert table.load().count() == 0
    for v in range(4):
        table.save(spark.createDataFrame([("a", v)], "k string, v int"))
    assert len(table.versions()) == 2
    half = spark.createDataFrame([("a", 99)], "k string, v int")  # written, but without its marker
    half.write.parquet(str(tmp_path / "state" / "v000000000009-dead"))
    assert [r.v for r in table.load().collect()] == [3]
    table.save(table.load().withColumn("v", F.col("v") + 1))
    assert [r.v for r in table.load().collect()] == [4]


def test_history(spark, tmp_path):
    record = lambda *f: "\x1f".join(f) + "\x1e"
    log = record("b" * 40, "a" * 40, "Ann", " Ann@E.org", "2024-02-01T00:00:00+01:00", "second\n\nmore") + "\n" + record("a" * 40, "", "Ann", "ann@e.org", "2024-01-01T00:00:00Z", "first")
    (tmp_path / "log.txt").write_text(log)
    commits = history.read_log(spark, str(tmp_path / "log.txt"))
    assert [(r.hash[0], r.parents, r.message) for r in commits.orderBy("ord").collect()] == [("b", ["a" * 40], "second\n\nmore"), ("a", [], "first")]
    changes = spark.createDataFrame([("b" * 40, f"f{i:02}", "Insert") for i in range(32)], "commit string, path string, change string")
    got = {r.id: r for r in history.history_concepts(commits, changes, "main").collect()}
    assert set(got) == {"git/repository", "git/commits/" + "b" * 8, "git/commits/" + "a" * 8, "git/contributors/ann-at-e-org"}
    assert "* **Total Contributors**: 1\n" in got["git/repository"].body and "Remote" not in got["git/repository"].body
    assert got["git/commits/" + "b" * 8].body.endswith("- **Insert**: `f29`\n\n... and 2 more files.") and "## Parents" not in got["git/commits/" + "a" * 8].body


def test_walk_beyond_the_broadcast_frontier(spark, monkeypatch):
    e = edges(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a")])
    small = [(r.id, r.depth) for r in graph.bfs(e, "a", 3).orderBy("depth", "place").collect()]
    monkeypatch.setattr(graph, "SMALL", 0)
    assert [(r.id, r.depth) for r in graph.bfs(e, "a", 3).orderBy("depth", "place").collect()] == small == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]
