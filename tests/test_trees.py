"""Differences of content-addressed trees against those of plain lists of files."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from quarrylake.operators import trees
from quarrylake.sources import harvest


def plain(before, after):
    out = set()
    for key in {k for k in before} | {k for k in after}:
        if before.get(key) != after.get(key):
            out.add((*key, "Insert" if key not in before else "Delete" if key not in after else "Modify"))
    return out


def test_object_diff(spark):
    rng = random.Random(5)
    names = ["a", "b", "c", "d"]

    def files(seed):
        r, out = random.Random(seed), {}
        for c in range(4):
            for _ in range(40):
                path = "/".join(r.choice(names) for _ in range(r.randint(1, 4)))
                if not any(path.startswith(p + "/") or p.startswith(path + "/") for k, p in out if k == f"c{c}"):
                    out[f"c{c}", path] = r.choice("xyz")
        return out

    before = files(1)
    after = {k: (rng.choice("xyz") if rng.random() < 0.2 else v) for k, v in before.items() if rng.random() < 0.9 and k[0] != "c3"}
    after |= {k: v for k, v in files(2).items() if k[0] in ("c2", "new")} | {("new", "p/q"): "x"}
    after = {k: v for k, v in after.items() if not any(k[0] == j and p.startswith(k[1] + "/") for j, p in after)}
    frame = lambda d: spark.createDataFrame([(*k, v) for k, v in d.items()], "commit string, path string, blob string")
    (rb, eb), (ra, ea) = trees.tree_objects(frame(before)), trees.tree_objects(frame(after))
    got = [tuple(r) for r in trees.object_diff(rb, ra, eb.union(ea).distinct()).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(before, after) == {tuple(r) for r in harvest.tree_diff(frame(before), frame(after)).collect()}
    assert len({c for _, _, c in got}) == 3


def test_equal_subtrees_are_not_opened(spark):
    files = [("c", f"{i % 20}/{i % 7}/{i}", "x") for i in range(2000)]
    one = spark.createDataFrame(files, "commit string, path string, blob string")
    other = one.withColumn("blob", F.when(F.col("path") == "3/4/123", F.lit("y")).otherwise(F.col("blob")))
    (rb, eb), (ra, ea) = trees.tree_objects(one), trees.tree_objects(other)
    entries = eb.union(ea).distinct()
    assert [tuple(r) for r in trees.object_diff(rb, ra, entries).collect()] == [("c", "3/4/123", "Modify")]
    roots = rb.select("commit", F.lit("").alias("folder"), F.col("tree").alias("b")).join(ra.select("commit", F.col("tree").alias("a")), "commit")
    assert trees._opened(roots, entries).count() == 1  # of twenty folders one is gone into
    assert eb.where("kind = 'tree'").select("hash").distinct().count() == 160 and eb.count() == 2160
    assert trees.object_diff(rb, rb, entries).count() == 0


def test_no_trees(spark):
    none = spark.createDataFrame([("c", None, "x"), (None, "a", "x"), ("c", "a", None)], "commit string, path string, blob string")
    roots, entries = trees.tree_objects(none)
    some, more = trees.tree_objects(spark.createDataFrame([("c", "a", "x"), ("c", "a", "w")], "commit string, path string, blob string"))
    assert roots.count() == entries.count() == 0
    assert [tuple(r) for r in trees.object_diff(roots, some, more).collect()] == [("c", "a", "Insert")]
    assert more.collect()[0]["hash"] == "w" and trees.object_diff(some, roots, more).collect()[0]["change"] == "Delete"
