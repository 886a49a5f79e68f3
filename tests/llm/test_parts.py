"""Shared parts, exact search, components and the pipeline."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quarrylake.llm import _sketch, _text, topk
from quarrylake.llm._work import in_one_task, ship
from quarrylake.llm.components import components


def test_words_are_those_of_bytes_split():
    rng = random.Random(8)
    texts = ["".join(rng.choice("aB é\n\t\x0b\x1c\xa0你") for _ in range(rng.randint(0, 40))) for _ in range(300)] + [None, "", "x" * 300_000, ("ab " * 200_000)]
    data, offs = _text.bytes_of(pa.array(texts, pa.string()))
    (h,), first = _text.words(data, offs, lower=True)
    seen = {}
    for i, t in enumerate(texts):
        w = (t or "").encode().lower().split()
        assert first[i + 1] - first[i] == len(w)
        for word, x in zip(w, h[first[i] : first[i + 1]].tolist(), strict=True):
            assert seen.setdefault(word, x) == x
    assert len(set(seen.values())) == len(seen)
    for k in (1, 5, 7, 25, 50):
        g = _text.grams(h[:500], k)
        assert len(g) == 501 - k and [int(_text.grams(h[i : i + k], k)[0]) for i in (0, 3, 500 - k)] == g[[0, 3, 500 - k]].tolist()


def thue_morse(n):
    return [bin(i).count("1") % 2 for i in range(n)]


def test_hashes_are_not_linear():
    word = "".join("ab"[x] for x in thue_morse(1024))
    other = word.translate({97: 98, 98: 97})
    data, offs = _text.bytes_of(pa.array([" ".join([word, other, word[:512], other[:512], word * 5, other * 5]), " ".join(word), " ".join(other)]))
    hs, first = _text.words(data, offs, lower=False, sides=2)
    for h in hs:
        assert len(set(h[:6].tolist())) == 6
        one, two = h[first[1] : first[2]], h[first[2] : first[3]]
        assert _text.prints(one) != _text.prints(two)
        assert _text.grams(one, 1024)[0] != _text.grams(two, 1024)[0] and _text.grams(one, 50)[0] != _text.grams(two, 50)[0]


def test_sketch_never_misses_a_repeat(spark):
    rng = np.random.default_rng(1)
    once, twice = rng.integers(0, 1 << 63, 5000, dtype=np.uint64), rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    rows = np.concatenate([once, twice, twice])
    rng.shuffle(rows)
    df = spark.createDataFrame([(int(x),) for x in rows.view(np.int64)], "h bigint").repartition(6)
    maps = _sketch.merged(_sketch.sketched(df, lambda b: iter([b.column(0).to_numpy().view(np.uint64)]), 20), 20)
    assert _sketch.repeated(maps, 20, twice).all() and _sketch.repeated(maps, 20, once).mean() < 0.01


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    parent = list(range(200))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame([((a, 0), (b, 0)) for a, b in edges], "u struct<a:bigint,b:bigint>, v struct<a:bigint,b:bigint>")
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert {(r.node.a, r.component.a) for r in components(df).collect()} == {(x, find(x)) for x in nodes}
    assert components(df.limit(0)).count() == 0


def brute(rows, every, k):
    keep = [(i, np.floor(64 * np.array(v, dtype=np.float64)).astype(np.int64)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, x in keep:
        if q % every == 0:
            best = sorted((-int(x @ y), i) for i, y in keep if i != q)[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return out


def test_exact_top_k(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(700)] + [(700 + i, [0.5] * 8) for i in range(200)]
    rows += [(1000, None), (1001, [float("nan")] + [0.0] * 7), (1020, [None] + [1.0] * 7), (1040, [0.0] * 8)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<float>, score string").repartition(4)
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.nearest(df).collect()}
    assert got == brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], 20, 20)
    few = df.where("vec_id < 5")
    assert {r.vec_id for r in topk.nearest(few).collect()} == {1, 2, 3, 4}
    assert topk.nearest(df.limit(0)).count() == 0


def ranked(best, n):
    best.rank()
    return [[(-int(s), int(i)) for q, s, i in zip(best.q, best.score, best.id, strict=True) if q == x] for x in range(n)]


def share(x, q, k=5):
    """What share of all pairs the trees multiply; the result is held against all products."""
    sample = topk.dots(q, x[::10]).astype(np.int64)
    best = topk.Best(len(q), k, np.partition(sample, -k - 1, axis=1)[:, -k - 1])
    looked = topk.search(topk.CoverTree(q), np.arange(len(q)), topk.CoverTree(x), np.arange(len(x)), best)
    scores = (q @ x.T).astype(np.int64)
    got = ranked(best, len(q))
    for i in range(0, len(q), 7):
        assert got[i] == sorted((-int(s), j) for j, s in enumerate(scores[i]) if j != i)[:k]
    return looked / len(q) / len(x)


def test_cover_trees_prune_what_can_be_pruned():
    rng = np.random.default_rng(4)
    centers = rng.integers(-400, 400, (12, 6))
    clustered = (centers[rng.integers(0, 12, 6000)] + rng.integers(-3, 4, (6000, 6))).astype(float)
    assert share(clustered, clustered[:900]) < 0.3
    even = rng.normal(size=(4000, 64))
    even = np.floor(64 * even / np.linalg.norm(even, axis=1)[:, None])
    assert share(even, even[:300]) > 0.9  # evenly spread in 64 dimensions: nothing can be pruned, and nothing is lost


def test_top_k_in_many_groups_and_parts(spark, monkeypatch):
    monkeypatch.setattr(topk, "GROUP_BYTES", 2000)
    monkeypatch.setattr(topk, "PART_BYTES", 1000)
    monkeypatch.setattr(topk, "SAMPLE", 30)
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(400)] + [(3, rng.normal(size=6).tolist()), (20, [9.0] * 6)]
    rows += [(1001, [float("inf")] + [0.0] * 5), (1020, [float("-inf")] + [0.0] * 5), (1040, []), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(6)
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.nearest(df, k=4).collect()}
    ids = [(i, np.floor(64 * np.array(v)).astype(np.int64)) for i, v in rows if i is not None and np.isfinite(v).all()]
    want = set()
    for q in sorted({i for i, _ in ids if i % 20 == 0}):
        x = min(list(v) for i, v in rows if i == q)  # of a repeated query the smallest vector
        x = np.floor(64 * np.array(x)).astype(np.int64)
        best = sorted((-int(x @ y) if len(x) and len(y) else 0, i) for i, y in ids if i != q)[:4]
        want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    assert got == want


def test_top_k_scores_of_any_size():
    a = np.array([[2.0**30, -(2.0**30)], [3.0, 4.0], [2.0**20, 1.0]])
    for x in (a, a[1:], a[1:2]):
        assert topk.dots(x, x).astype(np.int64).tolist() == [[int(sum(int(p) * int(q) for p, q in zip(u, v, strict=True))) for v in x] for u in x]


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(7)
    vocab = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    leak, copy = prose(30), prose(80)
    texts = [prose(rng.randint(20, 90)) for _ in range(60)] + [copy, copy + " end", prose(20) + " " + leak + " " + prose(20), "WORD!! " * 40, prose(30) + " me@here.example"]
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        seen[name] = {r.doc_id: r for r in docs.collect()}
        docs = spark.createDataFrame(list(seen[name].values()), docs.schema)
    assert [n for n, _ in corpus_pipeline.STAGES][-1] == "source_mixing" and set(docs.columns) > set(columns)
    assert set(range(65)) - set(seen["quality_classifier"]) == {63}
    assert set(seen["quality_classifier"]) - set(seen["ngram_jaccard_join"]) == {61}
    assert set(seen["ngram_jaccard_join"]) - set(seen["benchmark_decontamination"]) == {62}
    assert seen["pii"][64].text.endswith("[EMAIL]") and set(seen["pii"]) == set(seen["benchmark_decontamination"])
    assert {i for i in seen["source_mixing"]} <= set(seen["pii"])
    whole = {(r.doc_id, r.taken) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert whole == {(i, r.taken) for i, r in seen["source_mixing"].items()}


def test_rows_of_one_task_are_not_held_in_memory(spark):
    df = spark.range(4000).select("id", F.expr("repeat(cast(id % 10 as string), 5000)").alias("text")).repartition(3)

    def body(t):
        at = t.column("text").chunk(0).buffers()[2].address
        maps = [line.split(maxsplit=5) for line in open("/proc/self/maps")]
        held = next(m[5:] for m in maps if int(m[0].split("-")[0], 16) <= at < int(m[0].split("-")[1], 16))
        return pa.RecordBatch.from_arrays([pa.array([t.num_rows]), pa.array([sum(t.column("id").to_pylist())]), pa.array([" ".join(held)])], names=["n", "total", "held"])

    for held in (0, 1, 1 << 30):
        (r,) = in_one_task(df, body, "n bigint, total bigint, held string", held).collect()
        assert (r.n, r.total) == (4000, 4000 * 3999 // 2) and ("quarrylake-" in r.held) == (held == 0)  # mapped from a file


def test_batches_are_bounded_in_bytes(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    ship(spark)
    rows = spark.range(0, 3000, 1, 1).select(F.expr("repeat('x', 20000)").alias("text")).mapInArrow(sizes, "n bigint, size bigint").collect()
    assert sum(r.n for r in rows) == 3000 and max(r.size for r in rows) < 9 << 20
