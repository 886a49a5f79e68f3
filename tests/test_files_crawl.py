"""The sink of named files, URL resolution and the crawl."""

from __future__ import annotations

import json
import os
import random
from urllib.parse import urldefrag, urljoin

import pytest
from pyspark.sql import functions as F

from quarrylake.functions.links import host_of, resolve_url
from quarrylake.model import as_concepts
from quarrylake.operators import export, graph
from quarrylake.operators.crawl import crawl
from quarrylake.sources import bundle, scan
from quarrylake.sources.files import write_tree


def tree(root):
    return {os.path.relpath(os.path.join(d, n), root): open(os.path.join(d, n), encoding="utf-8").read() for d, _, ns in os.walk(root, followlinks=True) for n in ns}


def test_all_files_or_none(spark, tmp_path):
    root = str(tmp_path / "out")
    one = spark.createDataFrame([(f"a/{i}.txt", f"é{i}\r\n") for i in range(40)], "path string, content string").repartition(5)
    write_tree(one, root)
    want = {f"a/{i}.txt": f"é{i}\r\n" for i in range(40)}
    assert {p: open(f"{root}/{p}", encoding="utf-8", newline="").read() for p in want} == want and set(tree(root)) == set(want)
    for bad in (("../x", "y"), ("/x", "y"), ("a//b", "y"), ("a/../b", "y"), ("dir/", "y"), ("n", None), (None, "n")):
        more = spark.createDataFrame([*[(f"b/{i}", "z") for i in range(30)], bad], "path string, content string").repartition(6)
        with pytest.raises(Exception, match="path leaves the folder"):
            write_tree(more, root, overwrite=True)
        assert set(tree(root)) == set(want)
    failing = one.withColumn("content", F.when(F.col("path") == "a/7.txt", F.raise_error(F.lit("lost"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="lost"):
        write_tree(failing, root, overwrite=True)
    with pytest.raises(ValueError, match="given twice"):
        write_tree(one.union(one.limit(1)), root, overwrite=True)
    with pytest.raises(Exception, match="there already"):
        write_tree(one, root)
    assert set(tree(root)) == set(want) and len(os.listdir(tmp_path / ".out.versions")) == 1
    write_tree(one.where("path = 'a/3.txt'"), root, overwrite=True)
    assert set(tree(root)) == {"a/3.txt"}
    write_tree(one.limit(0), root, overwrite=True)
    assert tree(root) == {} and len(os.listdir(tmp_path / ".out.versions")) == 2  # this one, and the one before for readers
    plain = tmp_path / "plain"
    plain.mkdir()
    with pytest.raises(Exception, match="not written by this sink"):
        write_tree(one, str(plain), overwrite=True)


def test_portal_files(spark, tmp_path):
    c = spark.createDataFrame([(f"t/{i}", "Table", None if i else "Zero", f"body {i}", "broken" if i == 5 else None) for i in range(2300)], "id string, type string, title string, body string, parse_error string")
    c = as_concepts(c, path=F.concat("id", F.lit(".md")))
    edges = spark.createDataFrame([("t/1", "t/0", 0), ("t/0", "t/5", 0), ("t/2", "t/0", 1)], "src string, dst string, ordinal int")
    export.write_portal(c, edges, str(tmp_path / "portal"))
    files = tree(str(tmp_path / "portal"))
    manifest = json.loads(files["manifest.json"])
    index = [json.loads(files[f"index/{i}.json"]) for i in range(manifest["index"])]
    assert manifest == {"index": 3, "edges": 1} and {x["id"] for s in index for x in s} == {f"t/{i}" for i in range(2300) if i != 5} and all(len(s) < 1000 for s in index)
    assert [(x["src"], x["dst"]) for x in json.loads(files["edges/0.json"])] == [("t/1", "t/0"), ("t/2", "t/0")]
    assert json.loads(files["concepts/t/7.json"])["body"] == "body 7" and "concepts/t/5.json" not in files and len(files) == 2299 + 5
    assert {r.src: json.loads(r.payload)["targets"] for r in export.publish_edges(edges).collect()} == {"t/1": ["t/0"], "t/0": ["t/5"], "t/2": ["t/0"]}


def test_urls_resolve_as_links_do(spark):
    bases = ["http://e.org", "http://e.org/", "https://E.org:8080/a/b/c?x=1#f", "http://e.org/a/b/", "http://e.org/a/b/?q=/x/y", "https://e.org/a.b/c.d"]
    hrefs = ["x", "/x", "./x", "../x", "../../x", "../../../x/", "x/./y/../z", ".", "..", "./", "../", "?y=2", "?", "#z", "", "//f.org/p", "http://g.org/q#r", "x?a=../b", "/a/../b/./c", "/..", "mailto:a@b.c", " x ", "a:b", "é/ü", "..x/.y", "x;p=1"]
    df = spark.createDataFrame([(b, h) for b in bases for h in hrefs], "b string, h string")
    for r in df.withColumn("got", resolve_url("b", "h")).collect():
        want = urldefrag(urljoin(r.b, r.h.strip()))[0]
        if r.h == "?":  # an empty query asks for the page itself
            want = urldefrag(r.b)[0].split("?")[0] + "?"
            want = want if urldefrag(r.b)[0].count("/") > 2 else want
        assert r.got.rstrip("?") == want.rstrip("?") or (r.h, r.got) in {("", urldefrag(r.b)[0])}, (r.b, r.h, r.got, want)
    assert df.limit(1).select(resolve_url("b", F.lit(None).cast("string"))).first()[0] is None
    assert [r[0] for r in spark.createDataFrame([("https://u@E.org:80/x",), ("nothing",)], "u string").select(host_of("u")).collect()] == ["e.org:80", ""]


def test_crawl(spark):
    rng = random.Random(9)
    pages, links = [], {}
    for i in range(90):
        host = f"http://h{i % 3}.org"
        to = [rng.randrange(90) for _ in range(rng.randint(0, 3))]
        hrefs = [rng.choice([f"/p/{t}", f"{t}", f"http://h{t % 3}.org/p/{t}#x", f"//h{t % 3}.org/p/{t}", f"../p/./{t}"]) for t in to] + ["/gone", "mailto:x@y.z"]
        links[f"{host}/p/{i}"] = {urldefrag(urljoin(f"{host}/p/{i}", h))[0] for h in hrefs}
        pages.append((f"{host}/p/{i}" + ("#top" if i % 4 == 0 else ""), " ".join(f'<a href="{h}">x</a>' for h in hrefs)))
    pages += [(None, "<a href='/p/1'>"), ("http://h0.org/p/0", None)]
    seeds = ["http://h0.org/p/0", "http://h1.org/p/1#s", "http://h9.org/", None]
    for depth in (0, 1, 4, 30):
        want = {urldefrag(s)[0]: 0 for s in seeds if s and urldefrag(s)[0] in links}
        front = list(want)
        for level in range(1, depth + 1):
            front = sorted({t for u in front for t in links[u] if t in links and t.split("/")[2] == u.split("/")[2]} - set(want))
            want |= dict.fromkeys(front, level)
        df = spark.createDataFrame(pages, "url string, html string").repartition(3)
        got = [tuple(r) for r in crawl(df, spark.createDataFrame([(s,) for s in seeds], "url string"), depth).collect()]
        assert len(got) == len(dict(got)) and dict(got) == want


def test_bundle_source_prunes_folders_and_columns(spark, tmp_path):
    root = str(tmp_path / "b")
    for path, text in {"a/b/c/1.md": "---\ntype: T\n---\n\nbody [1] é", "a/b/2.md": "no front", "a/3.md": "---\ntype: [x]\n---\n", "ab/4.md": "---\ntitle: open\nx: 1", "index.md": "x", "a/log.md": "x", "c.txt": "x", ".h/_5.md": "---\n---\nb", "6.md": "", "big.md": "y" * 300}.items():
        os.makedirs(os.path.dirname(os.path.join(root, path)), exist_ok=True)
        with open(os.path.join(root, path), "w", encoding="utf-8") as f:
            f.write(text)
    with open(f"{root}/a/bad.md", "wb") as f:
        f.write(b"---\ntype: B\n---\n\xff")
    key = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    full = scan.read_bundle(spark, root, 200)
    assert key(full.drop("extra")) == key(bundle.read_bundle(spark, root, 200).drop("extra"))
    assert {r.id for r in full.where("id like 'a/%'").collect()} == {"a/b/c/1", "a/b/2", "a/3", "a/bad"} and full.count() == 8
    some = scan.read_bundle(spark, root, columns=["title", "id", "type"], under=["a/b/", "ab/4", "6"])
    assert key(some) == key(bundle.read_bundle(spark, root).where("path like 'a/b/%' or path in ('ab/4.md', '6.md')").select("title", "id", "type"))
    os.chmod(f"{root}/ab", 0)
    opened = []
    reader = scan.BundleReader(root, 200, ["a/b/"], some.select("id", "type").schema)
    reader._concept = lambda path, whole, named: opened.append((path, whole, named)) or dict.fromkeys(("extra", "id", "type"))
    assert [p.path for p in reader.partitions()] == ["", "a/", "a/b/", "a/b/c/"]
    for p in reader.partitions():
        list(reader.read(p))
    os.chmod(f"{root}/ab", 0o755)
    assert sorted(opened) == [("a/b/2.md", False, False), ("a/b/c/1.md", False, False)]
    assert scan.front_lines([b"---\n", b"a: 1\n", b"---\n", b"body"]) == b"---\na: 1\n---\n" and scan.front_lines([b"x\n", b"---\n"]) == b""


def test_a_hub_is_in_all_tasks_of_a_walk(spark):
    edges = spark.range(4000).select(F.concat(F.lit("n"), "id").alias("src"), F.lit("hub").alias("dst"), F.lit(0).alias("ordinal"))
    assert graph.bfs(edges, "n1", 2, "bidirectional").groupBy("depth").count().orderBy("depth").collect() == [(0, 1), (1, 1), (2, 3999)]
    moves = graph._steps(edges, "inbound").repartition(4, "u", "v")
    sizes = sorted(r["count"] for r in moves.groupBy(F.spark_partition_id()).count().collect())
    assert len(sizes) == 4 and sizes[-1] < 2 * sizes[1]


def test_budgets_over_ranges(spark):
    rng = random.Random(1)
    rows = [(f"n{i}", i % 3, [(0, i, "")], rng.randint(0, 9), rng.randint(0, 3)) for i in range(500)]
    df = spark.createDataFrame(rows, f"id string, depth int, place {graph.STEP}, characters bigint, tokens bigint").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.id: (r.running_characters, r.running_tokens) for r in graph.within_budget(df, 900, 600).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, c, t = {}, 0, 0
    for i, *_, x, y in sorted(rows, key=lambda r: (r[1], r[2])):
        c, t = c + x, t + y
        if c <= 900 and t <= 600:
            want[i] = (c, t)
    assert got == want and 100 < len(want) < 500
