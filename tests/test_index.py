"""The substring index against brute force."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from quarrylake.model import as_concepts
from quarrylake.operators import catalog, index


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abAB12é-") for _ in range(rng.randint(1, 7)))
    rows = [(f"d/{i}", " ".join(word() for _ in range(rng.randint(0, 30))), "Table" if i % 2 else "Metric") for i in range(120)]
    rows += [("d/empty", "", None), ("d/none", None, "Table"), ("d/long", "ab" * 200_000, "Table")]
    df = spark.createDataFrame(rows, "key string, text string, kind string").repartition(3)
    concepts = as_concepts(df, id=F.col("key"), path=F.concat("key", F.lit(".md")), type=F.col("kind"), body=F.col("text"))
    hay = {r.id: r.text for r in catalog.search_index(concepts).collect()}
    asked = [(i, " ".join(word() for _ in range(rng.randint(0, 3)))) for i in range(80)] + [(100, ""), (101, " -!"), (102, "zzzz"), (103, "ABAB a"), (104, None), (105, "ab1 zz"), (106, "d")]
    return concepts, hay, asked


def brute(hay, asked):
    return {(i, d) for i, q in asked if q is not None for d, t in hay.items() if all(w in t for w in re.findall("[a-z0-9]+", q.lower()))}


def test_search_each(spark, corpus, tmp_path):
    concepts, hay, asked = corpus
    queries = spark.createDataFrame(asked, "query_id int, query string")
    want = brute(hay, asked)
    got = [tuple(r) for r in index.search_each(concepts, queries).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 500
    stored = index.SubstringIndex.build(concepts, str(tmp_path / "index"))
    assert {tuple(r) for r in stored.search_each(concepts, queries).collect()} == want
    for i, q in asked[:12] + asked[80:84]:
        assert [r.id for r in stored.search(concepts, q).collect()] == sorted(d for j, d in want if j == i)
        assert [r.id for r in stored.search(concepts, q, "TABLE").collect()] == [r.id for r in catalog.search(concepts, q, "table").collect()]


def test_plans_have_no_nested_loops_and_push_grams_down(spark, corpus, tmp_path):
    concepts, _, asked = corpus
    plan = index.search_each(concepts, spark.createDataFrame(asked, "query_id int, query string"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    stored = index.SubstringIndex.build(concepts, str(tmp_path / "index"))
    plan = stored.candidates("abab 12")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*In\(gram", plan) and "ReadSchema: struct<gram:string,id:string>" in plan


def test_nothing_to_index(spark):
    none = as_concepts(spark.range(0), id=F.col("id").cast("string"))
    queries = spark.createDataFrame([(1, "a"), (2, "")], "query_id int, query string")
    assert index.search_each(none, queries).count() == 0
    assert index.search_each(as_concepts(spark.range(2), id=F.col("id").cast("string")), queries.limit(0)).count() == 0
