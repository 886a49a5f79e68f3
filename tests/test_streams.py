"""A watched bundle over three micro-batches against a full parse, and tables kept by keyed state against the last change of each key."""

from __future__ import annotations

import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from quarrylake.operators import graph, validate
from quarrylake.sources import bundle, watch
from quarrylake.streaming.state import ChangeLog


def put(root, path, text):
    full = os.path.join(root, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "w", encoding="utf-8") as f:
        f.write(text)


def concept(title, *links, more=""):
    return f"---\ntype: Note\ntitle: {title}\n{more}---\n" + " ".join(f"[x]({t})" for t in links)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_watched_bundle_equals_a_full_parse(spark, tmp_path):
    root, known = str(tmp_path / "bundle"), str(tmp_path / "known")
    now = F.lit("2025-01-01").cast("timestamp")
    put(root, "a.md", concept("A", "b.md", "sub/c.md", "gone.md", more="stale_after: 2024-02-02\n"))
    put(root, "b.md", concept("B", "/a.md", "a.md", "../out.md"))
    put(root, "sub/c.md", concept("C", "../a.md", "/later.md"))
    put(root, ".hidden/d.md", "plain [a](/a.md)")
    put(root, "index.md", "reserved")
    put(root, "bad.md", "---\ntype: a\ntype: b\n---\n")
    put(root, "big.md", "x" * 100)
    w = watch.WatchedBundle(spark, root, known)

    def agrees():
        w.follow().awaitTermination()
        full = bundle.read_bundle(spark, root)
        assert rows(w.concepts().drop("extra")) == rows(full.drop("extra"))
        assert rows(w.issues(now)) == rows(validate.lint(full, now))
        assert rows(w.edges()) == rows(graph.link_edges(full))

    agrees()
    put(root, "later.md", concept("Later", "b.md", "bad.md"))  # mends the link of sub/c.md
    put(root, "b.md", concept("B two", "sub/c.md"))
    put(root, "bad.md", concept("Good", more="status: odd\n"))
    agrees()
    os.remove(f"{root}/a.md")  # breaks the links to it
    shutil.rmtree(f"{root}/.hidden")
    before = os.stat(f"{root}/big.md")
    put(root, "big.md", "y" * 100)  # of equal size and written at the same time
    os.utime(f"{root}/big.md", ns=(before.st_atime_ns, before.st_mtime_ns))
    agrees()
    agrees()  # nothing new
    assert {(r.path, r.turn, r.op) for r in w.history().where("path in ('a.md', 'b.md', 'big.md')").collect()} == {("a.md", 1, "create"), ("a.md", 2, "remove"), ("b.md", 1, "create"), ("b.md", 2, "write"), ("big.md", 1, "create"), ("big.md", 2, "write")}
    assert len({r.batch for r in w.history().collect()}) == 3


def test_an_empty_bundle_has_nothing(spark, tmp_path):
    os.makedirs(tmp_path / "none")
    w = watch.WatchedBundle(spark, str(tmp_path / "none"), str(tmp_path / "known"))
    w.follow().awaitTermination()
    assert w.concepts().count() == 0 and w.edges().count() == 0 and w.issues(F.current_timestamp()).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_older_changes_that_arrive_later_lose(spark, tmp_path, seed):
    rng = random.Random(seed)
    changes = [(f"k{rng.randrange(12)}", None if rng.random() < 0.1 else i // 2, i % 2, f"v{i}", "delete" if rng.random() < 0.2 else "write") for i in range(150)] + [(None, 1, 1, "x", "write")]
    order = list(changes)
    rng.shuffle(order)
    df = spark.createDataFrame(order, "key string, at int, n int, value string, op string")
    log = ChangeLog(spark, str(tmp_path / "t"), df.schema, "key", ["at", "n", "value"])
    assert log.table().count() == 0
    for i in range(0, len(order), 40):
        spark.createDataFrame(order[i : i + 40], df.schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        log.follow(stream, str(tmp_path / "checkpoint")).awaitTermination()
        if i == 40:
            log.compact()
    last = {}
    for k, at, n, v, op in changes:
        if k is not None and (k not in last or ((at is not None, at or 0), n, v) > last[k][0]):
            last[k] = (((at is not None, at or 0), n, v), (k, at, n, v), op)
    assert {tuple(r) for r in log.table().collect()} == {row for _, row, op in last.values() if op != "delete"}
    written = log.spark.read.parquet(f"{tmp_path}/t/log").count()
    assert written <= len(changes)
    log.compact()
    assert {tuple(r) for r in log.table().collect()} == {row for _, row, op in last.values() if op != "delete"}
