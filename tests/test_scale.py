"""What keeps tasks small: rows of one row group are dealt out, files are parsed once and a few at a time."""

from __future__ import annotations

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from quarrylake.model import as_concepts
from quarrylake.operators import export
from quarrylake.plans import adapters, computed, cycles, queries
from quarrylake.sources import bundle
from quarrylake.streaming import sync
from tests.oracle import differences

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["part", "customer", "supplier"])
def test_one_row_group_is_many_tasks(spark, name):
    t = adapters.table(spark, SF, name)
    assert t.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert t.exceptAll(spark.read.parquet(f"{SF}/{name}.parquet")).isEmpty()


def test_broken_citations_parse_files_once(spark):
    assert plan_of(computed.broken_citations(spark, SF)).count("MapInArrow") == 1
    files = spark.createDataFrame([("a/b.md",), ("c.md.md",), ("d",), ("e.md\n",)], "path string")
    assert [r.id for r in bundle.file_ids(files).collect()] == [p.removesuffix(".md") for p in ("a/b.md", "c.md.md", "d", "e.md\n")]


@pytest.mark.parametrize(
    "text",
    ["a: 1\nb: [x, 2.5, true, yes]\nd: 2024-01-02\nt: 2024-01-02T03:04:05Z\n", '{"title":"a \\"q\\" \\u00e9 / b","tags":["x","é"],"n":null}', "a: |\n  x\n  y\nb: >-\n  u\n  v\nc: 'it''s'\n", "a: &x {k: v}\nb: *x\n", "", "- a\n- b\n", "k: ~\n1: 2\n"],
)
def test_libyaml_reads_the_same(text):
    import yaml

    fast, slow = bundle._loaded(text), yaml.load(text, Loader=bundle._Loader)  # noqa: S506
    assert fast == slow and repr(fast) == repr(slow)
    assert not getattr(yaml, "__with_libyaml__", False) or issubclass(bundle._FastLoader, yaml.CSafeLoader)


@pytest.mark.parametrize("text", ["a: 1\na: 2\n", "a: [1\n", "a: b: c\n", "\tx: 1\n"])
def test_errors_keep_their_messages(text):
    import yaml

    with pytest.raises(yaml.YAMLError) as fast:
        bundle._loaded(text)
    with pytest.raises(yaml.YAMLError) as slow:
        yaml.load(text, Loader=bundle._Loader)  # noqa: S506
    assert str(fast.value) == str(slow.value)


def test_citations_are_read_by_many_tasks(spark):
    found = computed.citations(spark, SF)
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert found.count() == 2 * spark.read.parquet(f"{SF}/part.parquet").where("p_partkey % 7 > 1").count()


def test_portal_links_are_not_resolved_by_broadcast(spark):
    assert "Broadcast" not in plan_of(computed.portal_link_resolve(spark, SF))


@pytest.mark.parametrize("name", ["visible_edges", "link_edges", "backlinks", "broken_remote_links", "outside_links", "broken_citations"])
def test_edges_and_issues_are_not_held_by_broadcast(spark, name):
    assert "Broadcast" not in plan_of(queries.QUERIES[name](spark, SF))


def test_states_are_not_joined_by_broadcast(spark):
    old, _ = adapters.part_snapshots(spark, SF)
    local, names = sync.hashed(old), spark.createDataFrame([("jira",)], "connector string")
    state, known = spark.createDataFrame([("part/1/old", "jira", "x", "y", None)], sync.STATE), spark.createDataFrame([("part/1/old", "z")], sync.PULL_STATE)
    pushed = sync.push_delta(local, names, state)
    assert plan_of(pushed).count("BroadcastHashJoin") == 0 and "SortMergeJoin" in plan_of(pushed)
    assert "Broadcast" not in plan_of(sync.pull_delta(local, known))
    assert "BroadcastHashJoin" not in plan_of(sync.committed(state, pushed, F.lit(adapters.AS_OF)))


def test_a_large_folder_is_read_in_shares(spark, tmp_path, monkeypatch):
    from quarrylake.sources import scan

    for n in range(30):
        (tmp_path / "a").mkdir(exist_ok=True)
        (tmp_path / "a" / f"{n}.md").write_text(f"---\ntype: T{n}\n---\n")
    monkeypatch.setattr(scan, "SHARE", 5)
    reader = scan.BundleReader(str(tmp_path), 200, (), spark.createDataFrame([], "id string, type string").schema)
    parts = reader.partitions()
    assert [p.path for p in parts] == ["", *["a/"] * 6]
    read = [[r["id"] for b in reader.read(p) for r in b.to_pylist()] for p in parts]
    assert sum(bool(x) for x in read) > 1 and sorted(x for r in read for x in r) == sorted(f"a/{n}" for n in range(30))


def test_proto_files_are_parsed_once(spark):
    from quarrylake.plans import cycles

    for q in (cycles.harvest_proto, cycles.proto_links):
        plan = plan_of(q(spark, SF))
        assert "PythonUDTF" not in plan and "Broadcast" not in plan


def test_methods_are_kept_with_their_service(spark):
    from quarrylake.sources import specs

    files = spark.createDataFrame([("a", "package p.q;\nmessage M {}\nservice S { rpc A(M) returns (N); rpc B(X) returns (p.N); }\nservice E {}"), ("b", "package p;\nmessage N {}"), ("c", "message {")], "file string, text string")
    defs = specs.definitions(files)
    got = {r.fqn: [(m.name, m.request, m.response) for m in r.methods or []] for r in specs.resolved(defs).collect()}
    assert got == {"p.q.M": [], "p.q.S": [("A", "p.q.M", "p.N"), ("B", "X", "p.N")], "p.q.E": [], "p.N": [], None: []}


def test_methods_of_a_service_need_not_come_together(spark):
    from quarrylake.plans import cycles
    from quarrylake.sources import specs

    assert "collect_list" not in plan_of(cycles.proto_links(spark, SF))
    files = spark.createDataFrame([("a", "package p; service S { rpc A(M) returns (Z); }"), ("b", "package p; message M {}"), ("c", "message {"), ("d", None)], "file string, text string")
    defs = specs.definitions(files)
    assert "MapInArrow" in plan_of(defs) and [r.file for r in defs.where("error is not null").collect()] == ["c"]
    assert [(r.file, r.fqn, r.pos, r.method.request, r.method.response) for r in specs.methods(defs).collect()] == [("a", "p.S", 0, "p.M", "Z")]


def test_fields_are_read_once_a_process():
    from quarrylake import model

    assert model.fields() is model.fields() and list(model.fields())[0] == "id"


def test_files_are_parsed_a_few_at_a_time():
    import pyarrow as pa

    whole = [pa.RecordBatch.from_pydict({"n": list(range(n))}) for n in (3 * bundle.FILES + 1, 0, 5)]
    parts = list(bundle.sliced(whole))
    assert max(p.num_rows for p in parts) == bundle.FILES
    assert [x for p in parts for x in p.column(0).to_pylist()] == [x for b in whole for x in b.column(0).to_pylist()]


def test_an_index_makes_its_grams_once(spark, tmp_path, monkeypatch):
    from quarrylake.operators import index

    frame, asked = type(spark.range(1)), []
    by_range = frame.repartitionByRange
    monkeypatch.setattr(frame, "repartitionByRange", lambda self, *by: asked.append(self.columns) or by_range(self, *by))
    c = adapters.key_concepts(spark, SF).where("type = 'Reference'")
    found = index.SubstringIndex.build(c, str(tmp_path / "index"))
    assert asked == [["gram", "n"]]  # counts alone are sampled for ranges, not postings
    assert found.search(c, "region/0").count() == 1


def test_jsonld_of_empty_missing_and_very_long_texts(spark, tmp_path):
    rows = [(0, "", "en", "s", 0), (1, None, "en", "s", None), (2, "é" + "b" * 20_000_100, "en", "s", 20_000_101), (3, "", "de", "s", 500), (4, "x" * 200, None, "s", 200)]
    spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").schema).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").where("doc_id < 3").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert differences(queries.export_jsonld(spark, str(tmp_path)), queries.ORACLE["export_jsonld"], con) == ""


def test_portal_is_read_without_listing_its_files(spark, tmp_path):
    assert len(cycles.portal_written(spark, SF).inputFiles()) < 10
    texts = {f"a/{i % 7}/é {i}": f"{i}\n" * (i % 40) for i in range(1500)} | {"long": "é" + "b" * 20_000_100, "empty": ""}
    c = as_concepts(spark.createDataFrame(list(texts.items()), "id string, body string"), title=F.lit("t"))
    edges = spark.createDataFrame([("long", "empty"), ("empty", "gone"), ("a/1/é 1", "long")], "src string, dst string")
    root = str(tmp_path / "portal")
    export.write_portal(c, edges, root)
    loaded, out = export.read_portal(spark, root, "id string, excerpt string", "id string, title string, body string", "src string, dst string")
    export.write_portal(c.limit(0), edges, root, overwrite=True)  # the version that was there is read
    got = loaded.select("entry.id", F.col("document.id").alias("own"), "document.title", F.sha2(F.col("document.body").cast("binary"), 256).alias("body"), "entry.excerpt").collect()
    assert len(got) == len(texts) and all(r.id == r.own and r.title == "t" and r.excerpt[:200] == texts[r.id][:200] for r in got)
    assert {r.id: r.body for r in got} == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in texts.items()}
    assert sorted(tuple(r) for r in out.collect()) == [("a/1/é 1", "long"), ("long", "empty")]
    assert [df.count() for df in export.read_portal(spark, root, "id string", "id string", "src string")] == [0, 0]
    (tmp_path / "portal" / "manifest.json").write_text('{"index": 2, "edges": 1}')
    with pytest.raises(Exception, match="index/1.json"):
        export.read_portal(spark, root, "id string", "id string", "src string")[0].collect()
