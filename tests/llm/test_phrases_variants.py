"""Spelling variants and phrases against brute force, on fixtures with nulls, blanks, ties, repeats and clashing extra columns."""

from __future__ import annotations

import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quarrylake.llm import phrases, variants

SCHEMA = "doc_id bigint, text string, lang string, n bigint, word string, key string"


def variants_of(rows):
    n = Counter()
    for i, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}

    def one(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:j] + b[j + 1 :] == a for j in range(len(b)))

    near = {w: [v for v in n if one(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), None if form[w] is None else n[form[w]]))
    return out


@pytest.fixture(scope="module")
def misspelt():
    rng = random.Random(12)
    letters = "abcdéÿ"
    stems = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 9))) for _ in range(25)]
    words = []
    for s in stems:
        words += [s] * rng.randint(3, 60)
        for _ in range(30):
            j, kind = rng.randrange(len(s)), rng.randrange(3)
            v = s[:j] + s[j + 1 :] if kind == 0 else s[:j] + rng.choice(letters) + s[j + kind - 1 :]
            words += [v] * rng.randint(1, 9)
            words += [v[:-1] + rng.choice(letters)] * rng.randint(0, 4)
    words += ["aaaaa"] * 4 + ["aaaaaa"] * 8 + ["aaaaaaa"] * 16 + ["aaaaaaaa"] * 32 + ["abcdx"] * 3 + ["abcdy"] * 3 + ["Größe×2"] * 3
    rng.shuffle(words)
    texts = [" ".join(w.title() if rng.random() < 0.2 else w for w in words[i : i + 40]) for i in range(0, len(words), 40)]
    rows = [(i, t, "en", i, "x", "y") for i, t in enumerate([None, "", " \n", "a b cd", *texts])]
    return [*rows, rows[5], (None, texts[0], None, None, None, None), (10**12, "zzzzz " * 300_000 + "ZZZZY zzzzy zzzzy", "en", 1, "x", "y")]


@pytest.mark.parametrize("hot", [variants.HOT, 2])
def test_spelling_variants(spark, misspelt, hot):
    df = spark.createDataFrame(misspelt, SCHEMA).repartition(5)
    got = [tuple(r) for r in variants.spelling_variants(df, hot=hot).collect()]
    assert len(got) == len(set(got)) and set(got) == variants_of(misspelt)
    assert max(len([1 for r in got if r[2] == x]) for x in {r[2] for r in got}) > 10


def test_no_words(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert variants.spelling_variants(df).count() == 0
    assert variants.spelling_variants(spark.createDataFrame([(1, None, None, 1, None, None)], SCHEMA)).count() == 0


def test_runs_longer_than_a_piece():
    text = "a" * (variants.PIECE + 5) + " bcdef " + "é" * 10
    assert "".join(variants._pieces(text)) == text
    assert sorted(w[:5] for w, _ in variants.variants_of(0, text)) == ["aaaaa", "bcdef", "ééééé"]


def collocations_of(rows, least, ranks):
    f, n = defaultdict(Counter), Counter()
    for _, t, lang, *_ in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for d in range(1, 5):
                for i in range(len(w) - d + 1):
                    f[lang][tuple(w[i : i + d])] += 1
    out = set()
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        gone = {p[i : i + s] for p, b in cand.items() for s in range(2, len(p)) for i in range(len(p) - s + 1) if 100 * b >= 80 * cand[p[i : i + s]]}
        best = []
        for p, a in cand.items():
            if p not in gone:
                score, k = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, x, y) in enumerate(sorted(best)[:ranks]):
            out.add((lang, rank + 1, p.decode(), -a, x, y, n[lang], -s))
    return out


@pytest.fixture(scope="module")
def spoken():
    rng = random.Random(11)
    vocab = [*"abcdefgh", "Été", "été", "\x01", "a\x01", "你好", "x\xa0y", "A-b", "ÿ"]
    text = lambda n: "".join(rng.choice(vocab[: rng.choice((3, 8, 15))]) + rng.choice((" ", " ", " ", "  ", "\t", ". ", "\n", "!", "\r\n")) for _ in range(n))
    rows = [(i, text(rng.randint(0, 120)), ("en", "fr", "", None, "und")[i % 5], i, "x", "y") for i in range(150)]
    rows += [(900, None, "en", 1, "x", "y"), (901, "", None, 1, "x", "y"), (902, " .\n", "en", 1, "x", "y"), (None, "only the one and only the one", "xx", 1, "x", "y")]
    return [*rows, rows[3], rows[3], (903, "the same words again " * 70_000, "long", 1, "x", "y"), (904, "z" * 600_000 + " z" * 50, "long", 1, "x", "y")]


@pytest.mark.parametrize(("least", "ranks"), [(30, 2000), (3, 2000), (2, 5)])
def test_collocations(spark, spoken, least, ranks):
    df = spark.createDataFrame(spoken, SCHEMA).repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that ranges start inside subtrees
    try:
        got = [tuple(r) for r in phrases.collocations(df, least=least, ranks=ranks).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(set(got)) and set(got) == collocations_of(spoken, least, ranks)
    assert len(got) > 20


def test_tries_are_made_once(spark, spoken, monkeypatch):
    frame, asked = type(spark.range(1)), []
    by_range = frame.repartitionByRange
    monkeypatch.setattr(frame, "repartitionByRange", lambda self, *by: asked.append(self.columns) or by_range(self, *by))
    df = spark.createDataFrame(spoken, SCHEMA).repartition(5)
    monkeypatch.setattr(phrases, "SAMPLE", 1000)  # ranges by a part of the texts give the same
    got = [tuple(r) for r in phrases.collocations(df, least=3, ranks=2000).collect()]
    assert not asked and set(got) == collocations_of(spoken, 3, 2000)  # ranges are not sampled from the tries themselves


def test_shards_bound_a_workers_memory():
    rng = np.random.default_rng(5)
    batch = pa.RecordBatch.from_pydict({"text": [" ".join(f"w{x}" for x in rng.integers(0, 5000, 2000).tolist()) for _ in range(150)], "lang": ["en"] * 150})
    often = {d: lambda h: h % np.uint64(8) == 0 for d in range(1, phrases.DEPTH + 1)}
    tracemalloc.start()
    try:
        words = 0
        for shard in phrases.shards([batch] * 7):
            words += shard.n
            phrases.trie(shard, phrases.DEPTH, often)
        peak = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    assert words == 7 * 150 * 2000 and peak < 90  # 176 MB with shards of two million words


def test_no_phrases(spark):
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, None, None, 1, None, None), (2, "a b c", "en", 1, None, None)], SCHEMA)).count() == 0
