"""Suffix-array dedup of bytes against brute force, and hashes of patterned texts in operators that compare runs of words."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from quarrylake.llm import decontaminate, jaccard, substrings, suffixes

SCHEMA = "doc_id bigint, text string, cls1 string, n bigint, anchor string"


def brute(rows, length):
    texts = [(t or "").encode() for _, t, *_ in rows]
    n = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = Counter()
    for (i, *_), t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for j in range(len(t) - length + 1):
            if n[t[j : j + length]] > 1:
                gone[j : j + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        out[i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(13)
    noise = lambda n, a="abcdefghijklmnop é你": "".join(rng.choice(a) for _ in range(n))
    passage, base = noise(60), noise(300)
    texts = [None, "", "a", passage, passage[:39], noise(39), noise(40), base, base, base[:150] + "X" + base[151:], base[100:], "x" * 200, "y" * 39 + " " + "x" * 41, "ab" * 150, "abc" * 30, "\0" * 90]
    texts += [noise(rng.randint(0, 90)) + passage[rng.randint(0, 10) : rng.randint(40, 60)] + noise(rng.randint(0, 90)) for _ in range(40)]
    texts += [noise(rng.randint(0, 400), "ab") for _ in range(20)] + [passage + noise(5) + passage]
    core = noise(36)  # shorter than a window, in many texts
    texts += [noise(30) + core + noise(30) for _ in range(60)] + [core + "tail" + noise(9)] * 2
    out = [(i, t, "a", i, "b") for i, t in enumerate(texts)]
    return [*out, out[20], (None, noise(80), None, None, None), (None, base[10:90], None, None, None), (None, base[10:90], None, None, None)]


@pytest.mark.parametrize("hot", [suffixes.HOT, 5])
def test_dedup_bytes(spark, rows, hot):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = Counter(tuple(r) for r in suffixes.dedup_bytes(df, length=40, gram=8, hot=hot).collect())
    assert got == brute(rows, 40)


def test_dedup_bytes_in_full_length(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long_, passage = prose(4000), prose(90)
    texts = [long_, long_[:9000] + "!" + long_[9000:], prose(200) + passage + prose(20), passage + prose(300), passage[:399], "-" * 5000, prose(100), prose(60) + "-" * 400, "line of log\n" * 300]
    rows = [(i, t, "a", 1, "b") for i, t in enumerate(texts)]
    got = Counter(tuple(r) for r in suffixes.dedup_bytes(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect())
    assert got == brute(rows, 400)
    assert suffixes.dedup_bytes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_two_stage_order_is_that_of_the_suffixes():
    rng = random.Random(1)
    for _ in range(60):
        strings = [bytes(rng.choice(b"ab\1") for _ in range(rng.randint(12, 40))) for _ in range(rng.randint(1, 6))]
        depth = 12
        text = np.frombuffer(b"\0".join(strings) + bytes(depth + 1), np.uint8).copy()
        end = np.cumsum([len(s) + 1 for s in strings]) - 1
        begin = np.append(0, end[:-1] + 1)
        n = np.array([len(s) - depth + 1 for s in strings])
        order = suffixes.two_stage_order(text, begin, n, end, depth)
        every = [(a + j) for a, k in zip(begin, n, strict=True) for j in range(k)]
        key = [text[i : i + depth].tobytes() for i in order]
        assert sorted(order.tolist()) == every and key == sorted(key)
        lcp = suffixes.common_prefixes(text, order, depth)
        assert lcp.tolist() == [0] + [next((j for j in range(depth) if a[j] != b[j]), depth) for a, b in zip(key, key[1:], strict=False)]


def patterned():
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    return word, word.translate({97: 98, 98: 97})


def test_patterned_words_differ(spark):
    one, two = patterned()
    common = " ".join(f"w{i}" for i in range(49))
    rows = [(1, f"{common} {one}"), (2, f"{common} {two}"), (3, " ".join(one)), (4, " ".join(two))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {(r.doc_id, r.n_removed) for r in substrings.dedup_substrings(df.where("doc_id < 3")).collect()} == {(1, 0), (2, 0)}
    short = spark.createDataFrame([(1, f"a b c d {one}"), (2, f"a b c d {two}")], "doc_id bigint, text string")
    assert {(r.doc_id, r.component_id) for r in jaccard.near_duplicates(short).collect()} == {(1, 1), (2, 2)}
    items = spark.createDataFrame([(7, f"a b c d {one}"), (8, "b c"), (9, " ".join(one[:40]))], "item_id bigint, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(short, items).collect()}
    assert found == {(1, 7), (1, 8), (2, 8)}
    assert {(r.doc_id, r.n_removed) for r in substrings.dedup_substrings(df.where("doc_id > 2")).collect() if r.doc_id == 3} == {(3, 0)}
