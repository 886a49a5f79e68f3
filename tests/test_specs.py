"""Specifications read by tasks, names resolved over files, alerts and connection texts."""

from __future__ import annotations

from quarrylake import functions as fn
from quarrylake.sources import bundle, harvest, scan, specs


def test_texts_that_cannot_be_read_are_rows_with_errors(spark):
    files = [("good", "openapi: 3.0.0\npaths: {/a: {get: {summary: A}, put: {}}}"), ("two", '{"swagger": "2.0", "paths": {"/b": {"post": {"parameters": [{"in": "body", "name": "x", "schema": {"$ref": "#/definitions/B"}}]}}}}'), ("broken", "paths: ["), ("shape", "paths: {/x: 3}"), ("none", None), ("empty", "")]
    got = specs.operations(spark.createDataFrame(files, "file string, text string")).collect()
    assert {(r.file, r.method, r.path, r.body_type) for r in got if r.error is None} == {("good", "GET", "/a", None), ("good", "PUT", "/a", None), ("two", "POST", "/b", "B")}
    assert {r.file for r in got if r.error is not None} == {"broken", "shape", "empty"} and len(got) == 6


def test_names_are_resolved_from_the_inside_out(spark):
    files = [
        ("a", "package a.b;\nmessage M { int32 x = 1; }\nmessage Only { }\n"),
        ("b", "package a;\nmessage M { }\nmessage Up { }\n"),
        ("c", "package a.b.c;\nservice S { rpc One(M) returns (Up); rpc Two(b.Only) returns (.a.M); rpc Three(Missing) returns (stream a.b.M); }\n"),
        ("d", "message M { }\nservice Bare { rpc One(M) returns (a.M); }"),
        ("e", "service Empty { }"),
    ]
    defs = specs.resolved(specs.definitions(spark.createDataFrame(files, "file string, text string")).where("error is null"))
    methods = {(r.fqn, m.name): (m.request, m.response) for r in defs.where("kind = 'service'").collect() for m in r.methods}
    assert methods == {("a.b.c.S", "One"): ("a.b.M", "a.Up"), ("a.b.c.S", "Two"): ("a.b.Only", "a.M"), ("a.b.c.S", "Three"): ("Missing", "a.b.M"), ("Bare", "One"): ("M", "a.M")}
    assert defs.count() == 8 and {r.message_id for r in harvest.proto_links(defs).where("method = 'Three'").collect()} == {"protobuf/a.b.m"}


def test_alerts_and_targets(spark):
    quotes = {"[!NOTE]<br>a": ("note", '<blockquote class="alert alert-note">a</blockquote>'), "x [!warning] <br/> [!TIP]<br> b": ("warning", '<blockquote class="alert alert-warning">x  [!TIP]<br> b</blockquote>'), "[!NOTE] c": ("note", '<blockquote class="alert alert-note">[!NOTE] c</blockquote>'), "plain": (None, "<blockquote>plain</blockquote>"), "": (None, "<blockquote></blockquote>")}
    df = spark.createDataFrame([(q,) for q in quotes], "q string").select("q", fn.alert_kind("q").alias("kind"), fn.alert_block("q").alias("block"))
    assert {r.q: (r.kind, r.block) for r in df.collect()} == quotes
    targets = {("projects/p/datasets/d", "x"): ("p", "d"), ("projects/p/datasets/", "x"): ("p", None), ("projects/p", "x"): ("projects/p", "x"), ("p", None): ("p", None), ("projects/p/tables/d", "y"): ("projects/p/tables/d", "y")}
    df = spark.createDataFrame(list(targets), "c string, d string").select("c", "d", fn.warehouse_target("c", "d").alias("t"))
    assert {(r.c, r.d): tuple(r.t) for r in df.collect()} == targets


def test_a_repository_without_the_folder_has_no_concepts(spark, tmp_path):
    assert scan.read_repository(spark, str(tmp_path)).count() == 0
    assert bundle.version_of("---\na_version: 1\n---\n") == "1" and bundle.version_of("---\n- x\n---\n") is None and bundle.version_of("x") is None
