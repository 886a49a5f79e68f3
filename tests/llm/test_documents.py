"""Operators on documents against brute force, on a fixture with nulls, blanks, ties, repeats and clashing extra columns."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

from quarrylake.llm import decontaminate, jaccard, langid, licenses, mixing, pii, quality, substrings, tokens

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n bigint, h string"


def words(t):
    return (t or "").encode().split()


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base, passage, long_ = prose(200), prose(60), prose(6000)
    near = [" ".join(w if rng.random() > 0.01 else "edit" + str(i) for w in base.split()) for i in range(12)]
    rows = [None, "", " \n\t ", "one two", "One\x0btwo", "a b c d e", base, base, base.upper(), long_, long_ + " tail", *near]
    rows += [prose(30) + " " + passage + " " + prose(rng.randint(10, 40)) for _ in range(8)]
    rows += [passage, passage + "\n" + passage, "no\x1cbreak \xa0here é", "Écran " + prose(5), prose(49), prose(50)]
    rows += ["mail a.b@c.de, x@y.z_q@r.st 10.0.0.256 10.1.2.3 4111 1111 1111 1111 +1 (499) 555-6503", "Licensed under the Apache License, Version 2.0. " + prose(40)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ("en", "fr", None)[i % 3], ("a", "b", None, "")[i % 4], len(t or ""), i, "x") for i, t in enumerate(texts)]
    rows.append(rows[6])  # a repeated row
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sets_of(texts):
    out = {}
    for i, t in enumerate(texts):
        w = words(t.translate({c: c + 32 for c in range(65, 91)}) if t else t)
        out[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    return out


def test_jaccard_components(docs, texts, empty):
    sets = sets_of(texts)
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    got = jaccard.near_duplicates(docs).collect()
    assert len(got) == len(texts) + 1
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(i, len(s), find(i)) for i, s in sets.items()}
    kept = jaccard.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in sets if find(i) == i)
    assert jaccard.near_duplicates(empty).count() == 0


def test_substring_dedup(docs, texts, empty):
    first, want = {}, {}
    for i, t in enumerate(texts):
        w = words(t)
        for j in range(len(w) - 49):
            first.setdefault(tuple(w[j : j + 50]), i)
    for i, t in enumerate(texts):
        w, gone = words(t), set()
        for j in range(len(w) - 49):
            if first[tuple(w[j : j + 50])] < i:
                gone |= set(range(j, j + 50))
        want[i] = (len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest())
    got = substrings.dedup_substrings(docs).collect()
    assert len(got) == len(texts) + 1
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want
    assert substrings.dedup_substrings(empty).count() == 0


def test_token_counts(docs, texts, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary())
    want = {i: (len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in enumerate(texts)}
    for chunk, lap in ((tokens.CHUNK, tokens.OVERLAP), (200, 16)):
        got = tokens.count_tokens(docs, chunk=chunk, overlap=lap).collect()
        assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in got} == want
        assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    assert tokens.count_tokens(empty).count() == 0


def test_token_splices_of_odd_texts():
    from tokenizers import Tokenizer

    t, e, rng = Tokenizer.from_file(tokens.vocabulary()), tokens.RunEncoder(tokens.vocabulary()), random.Random(2)
    parts = [*"ab'sZ9 .,-\n\t\r", "  ", "\x1c", "\x1f", "\x85", "\xa0", "é", "<|endoftext|>", "'ll", " 's", "你", "😀", "\x00"]
    for _ in range(300):
        x = "".join(rng.choice(parts) for _ in range(rng.randint(1, 300)))
        n = len(t.encode(x, add_special_tokens=False).ids)
        assert e.count(x) == n and e.count_long(x, 40, 8) == n
    whole = "x" * 5000
    assert e.count_long(whole, 64, 8) == len(t.encode(whole, add_special_tokens=False).ids)


def test_mixing(docs, texts, empty, spark):
    import duckdb

    got = mixing.mix(docs)
    assert got.columns == [*docs.columns, "size", "source_size", "target", "taken"]
    rows = got.collect()
    assert len(rows) == len(texts) + 1
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(3)).collect()))
    by = collections.defaultdict(list)
    for r in rows:
        assert r["size"] == len(words(r["text"])) and r["taken"] in (0, r["size"], 2 * r["size"])
        by[r["source"]].append(r)
    total = sum(r["size"] for r in rows)
    assert abs(sum(v[0]["target"] for v in by.values()) - 1.5 * total) < 1e-6 * total
    order = sorted(by, key=lambda s: (s is None, s or ""))
    for weight, s in zip((3, 1, 2, 3), order, strict=True):
        size = sum(r["size"] for r in by[s])
        assert all(r["source_size"] == size for r in by[s]) and by[s][0]["target"] <= 2 * size + 1e-9
        assert abs(sum(r["taken"] for r in by[s]) - by[s][0]["target"]) <= 2 * max(r["size"] for r in by[s])
        del weight
    assert mixing.mix(empty).count() == 0
    once = docs.dropDuplicates(["doc_id"])
    frame = once.select("doc_id", "text", "source").toPandas()
    con = duckdb.connect()
    con.register("documents", frame)
    want = {tuple(r) for r in con.execute(mixing.oracle()).fetchall()}
    assert {(r.doc_id, r["size"], r.source_size, r.target, r.taken) for r in mixing.mix(once).collect()} == want


def test_license_scan(docs, texts, empty, spark):
    own = ["Copyright. ALL rights, reserved!", "mit license", "All rights are reserved", "x " * 5000 + "All rights reserved " + "y " * 3000 + "SPDX-License-Identifier: MIT", licenses.TEMPLATES[6][2] + " all rights"]
    docs = docs.unionByName(spark.createDataFrame([(500 + i, t) for i, t in enumerate(own)], "doc_id bigint, text string"), allowMissingColumns=True)
    want = set()
    for i, t in [*enumerate(texts), *enumerate(own, 500)]:
        w = licenses._words(t or "")
        for _, name, x in licenses.TEMPLATES:
            v = licenses._words(x)
            k = min(5, len(v))
            have, need = ({tuple(y[j : j + k]) for j in range(len(y) - k + 1)} for y in (w, v))
            if len(have & need) >= 0.8 * len(need):
                want.add((i, name))
    assert {(500, "all-rights"), (501, "mit-name"), (503, "mit-spdx"), (504, "mit-grant")} <= want and not any(i == 502 for i, _ in want)
    got = licenses.scan(docs).collect()
    assert {(r.doc_id, r.template) for r in got} == want and all(r.containment >= 0.8 for r in got)
    assert licenses.scan(empty).count() == 0


def test_licenses_are_looked_for_in_one_scan(docs):
    plan = licenses.scan(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") + plan.count("Relation [") <= 2 and "Union" not in plan  # texts and templates


def test_license_bands_hold_their_chance():
    sizes = [1, 2, 5, 9, 40, 100]
    for top, window, stride, bands in licenses.classes(sizes):
        assert window == top + stride
        for n in (n for n in sizes if top // 2 < n <= top):
            need = -(-8 * n // 10)
            assert (1 - need / (window + n - need)) ** bands <= licenses.MISS


def test_decontamination(docs, texts, empty, spark):
    rng = random.Random(9)
    long_ = words(texts[9])
    items = [(1, b" ".join(long_[100:130]).decode().upper()), (2, b" ".join(long_[5000:5060]).decode()), (3, "one two"), (4, None), (5, " "), (6, " ".join(rng.choice("xyz") * 3 for _ in range(20))), (7, texts[-8]), (1, b" ".join(long_[100:130]).decode())]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    sets, want = sets_of(texts), set()
    for item, t in items:
        w = [x.lower() for x in words(t)]
        k = min(5, len(w))
        own = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
        for i in sets:
            v = [x.lower() for x in words(texts[i])]
            have = {tuple(v[j : j + k]) for j in range(len(v) - k + 1)}
            if own and len(own & have) >= 0.8 * len(own):
                want.add((i, item, len(own), len(own & have)))
    assert {w[1] for w in want} >= {1, 2, 3, 7}
    got = decontaminate.contaminated(docs, table).collect()
    assert {(r.doc_id, r.item_id, r.n_item, r.n_shared) for r in got} == want and len(got) == len(want)
    assert decontaminate.contaminated(empty, table).count() == 0
    assert decontaminate.contaminated(docs, table.limit(0)).count() == 0


KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(t):
    def luhn(d):
        return sum(sum(divmod(int(c) * 2, 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0

    out = []
    for rank, (k, p) in enumerate(KINDS.items()):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": k == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[k]:
                out.append((m.start(), rank, k, m.end()))
    return sorted(out)


def test_pii_base_spans(docs, texts, empty, spark):
    rng = random.Random(3)
    parts = [*"ab1234567890@..-+ ()_é😀\n", "x@y.z", "1.2.3.4", "+1 (499) 555-6503", "4111 1111 1111 1111", "a@b.c_x@d.e"]
    odd = [(1000 + i, "".join(rng.choice(parts) for _ in range(rng.randint(1, 60)))) for i in range(400)]
    odd += [(2000, "a" * 100_000), (2001, "1" * 50_000), (2002, "a@" + "b." * 20_000 + "c"), (2003, "x@y.zz " * 600)]
    all_ = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id bigint, text string"))
    known = dict(enumerate(texts)) | dict(odd)
    got = pii.scan(all_).collect()
    assert len(got) == len(texts) + 1 + len(odd)
    for r in got:
        spans = base_spans(known[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[2] == k for s in spans) for k in KINDS]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in spans).encode()).hexdigest()
    assert pii.scan(empty).count() == 0


def disclosures(rows, least=0.6, chance=0.05, z=1.96):
    """Terms and their disclosure, from all pairs of texts' entities and terms; copies of a text with entities count once."""

    def term(w):
        return ("#a" if any(c.isalpha() for c in w) else "#9") + str(len(w)) if any(c.isnumeric() for c in w) else w.lower()

    def words_of(t):
        return {term(w) for w in regex.findall(r"[\p{L}\p{N}]{2,}+", t)}

    n_t, n_e, k, total = Counter(), Counter(), Counter(), 0
    known = {t: base_spans(t) for t in set(rows) - {None}}
    for t in [t for t, x in known.items() if x] + [t for t in rows if t is not None and not known[t]]:
        total += 1
        n_t.update(words_of(t))
        spans, rest, own = base_spans(t), list(t), {"any"}
        for a, _, kind, b in spans:
            v = t[a:b]
            d = "".join(c for c in v if c.isdigit())
            group = {"email": v.lower().rsplit("@")[-1], "ip": ".".join(v.split(".")[:2]), "card": d[:6], "phone": d[:4]}[kind]
            own |= {kind, f"{kind}:{group}", f"{kind}={v.lower() if kind == 'email' else v if kind == 'ip' else d}"}
            rest[a:b] = " " * (b - a)
        if spans:
            n_e.update(own)
            k.update((e, w) for e in own for w in words_of("".join(rest)))
    tests, out = sum(n > 1 for n in k.values()), {}
    for (e, w), n in k.items():
        by_chance, bits, p = n_t[w] * n_e[e] / total, math.log(total / n_e[e]), n / n_t[w]
        if n < 2 or n <= by_chance or not bits or n * math.log(n / by_chance) - n + by_chance <= math.log(tests / chance):
            continue
        low = (p + z * z / 2 / n_t[w] - z * math.sqrt(p * (1 - p) / n_t[w] + z * z / 4 / n_t[w] ** 2)) / (1 + z * z / n_t[w])
        share = 1 + math.log(low) / bits
        if share >= least and low >= 0.5:
            out[w] = max(share, out.get(w, 0))
    return out


@pytest.fixture(scope="module")
def private(spark):
    rng = random.Random(4)
    filler = lambda: " ".join(rng.choice(["plain", "common", "words", "everywhere", "again", "Ann", "é9"]) for _ in range(20))
    rows = [f"{filler()} zanzibar {' far away' * 30} boss@corp.example {filler()} {rng.randrange(16**12):012x}f0a" for _ in range(9)]  # far from the entity
    rows += [f"{filler()} call Kim +1 (499) 555-{6000 + i} 10.0.{i}.7 {filler()}" for i in range(7)]
    rows += [filler() for _ in range(150)] + [filler() + " zanzibar", "Zanzibar", rows[0], rows[0], rows[10], None, "", "x" * 4_000]
    return [*rows, rows[-2]]


def test_pii_terms_and_redaction(spark, private):
    names = "doc_id bigint, text string, n_chars bigint, spans string, terms string, text_hash string, _hash int, _doc int, h int, row int, told int, term string"
    d = spark.createDataFrame([(i if i % 5 else None, t, len(t or ""), "own", "own", "own", 1, 2, 3, i, 5, "own") for i, t in enumerate(private)], names).repartition(3)
    want = disclosures(private)
    got = {r.term: r.disclosure for r in pii.telling_terms(d).collect()}
    assert got.keys() == want.keys() and {"zanzibar", "call", "kim", "#a15"} <= want.keys() and "common" not in want
    assert all(abs(got[w] - x) < 1e-9 for w, x in want.items())
    rows = {r.doc_id: r for r in pii.scan(d.select(F.col("row").cast("long").alias("doc_id"), "text")).collect()}
    assert pii.scan(d).count() == len(private)
    for i, t in enumerate(private):
        marks = [(a, 4, "term", b) for a, b, w in ((m.start(), m.end(), m[0]) for m in regex.finditer(r"[\p{L}\p{N}]{2,}+", blanked(t))) if (("#a" if any(map(str.isalpha, w)) else "#9") + str(len(w)) if any(map(str.isnumeric, w)) else w.lower()) in want]
        both = sorted([(a, list(KINDS).index(k), k, b) for a, _, k, b in base_spans(t or "")] + marks)
        assert rows[i].spans == ",".join(f"{k}:{a}:{b}" for a, _, k, b in both) and rows[i].n_term == len(marks) and rows[i].n_spans == len(both)
    clean = {r["row"]: r for r in pii.redact(d).collect()}
    assert len(clean) == len(private) and pii.redact(d).columns == d.columns
    for i, t in enumerate(private):
        r = clean[i]
        assert (r.spans, r.terms, r.text_hash, r._hash, r._doc, r.h, r.told, r.term) == ("own", "own", "own", 1, 2, 3, 5, "own")
        assert r.text == t and r.n_chars == len(t or "") if not rows[i].spans else r.n_chars == len(r.text) and "zanzibar" not in r.text.lower() and "boss@" not in r.text and "Kim" not in r.text
    assert "[EMAIL]" in clean[0].text and "[IP]" in clean[10].text


def blanked(t):
    out = list(t or "")
    for a, _, _, b in base_spans(t or ""):
        out[a:b] = " " * (b - a)
    return "".join(out)


def test_pii_without_anything_to_tell(spark, empty):
    one = spark.createDataFrame([(1, "mail me@here.example now")], "doc_id bigint, text string")
    assert [(r.spans, r.n_term) for r in pii.scan(one).collect()] == [("email:5:20", 0)]
    long_ = spark.createDataFrame([(i, "x" * 300_000 + " code a1b2 me@here.example") for i in range(2)] + [(9 + i, "x y") for i in range(30)], "doc_id bigint, text string")
    assert {r.n_email for r in pii.scan(long_).where("doc_id < 9").collect()} == {1}
    assert pii.redact(empty).collect() == []


def test_language_identification(spark, empty):
    rng = random.Random(1)
    pools = {"aa": "the of and thing with that".split(), "bb": "le la des que eau dans".split(), "cc": "der und das ein schön mit".split()}
    rows = [(i, " ".join(rng.choice(pools[lang]) for _ in range(30)), lang) for i in range(600) for lang in [rng.choice(list(pools))]]
    rows += [(900, None, "aa"), (901, "12 34 !", "aa"), (902, "the thing", None), (None, "le la", "bb")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(d, per_language=100).collect()}
    right = [got[i].lang_pred == lang for i, _, lang in rows[:600] if got[i].held_out]
    assert len(right) > 100 and sum(right) / len(right) > 0.98
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= got[i].score <= 1 for i in range(600))
    assert got[900].lang_pred == got[901].lang_pred == langid.UNKNOWN and got[902].lang_pred == "aa" and not got[None].held_out
    assert langid.identify(empty).count() == 0
    assert [langid.has_letter(t) for t in ("² ½", "1²3", "a", "é", "中", "_ -")] == [False, False, True, True, True, False]
    nothing = langid.identify(d.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in nothing} == {langid.UNKNOWN}


def test_quality_classifier(spark, empty):
    rng = random.Random(6)
    vocab = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    rows, bad = [], set()
    for i in range(400):
        w = [rng.choice(vocab) for _ in range(rng.randint(25, 120))]
        kind = rng.choice(["good"] * 6 + ["marks", "shout", "echo", "toxic"])
        if kind != "good":
            bad.add(i)
        w = {"marks": [x + "***" for x in w], "shout": [x.upper() + "!!" for x in w], "echo": [w[0]] * len(w), "toxic": [*w, "you", "stupid", "worthless", "idiot"]}.get(kind, w)
        rows.append((i, " ".join(w)))
    rows += [(1000, None), (1001, "  "), (1002, "Short one.")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in quality.classify(d).collect()}
    right = sum(got[i].keep != (i in bad) for i in range(400))
    assert right / 400 > 0.97
    assert not got[1000].keep and not got[1001].keep and got[1002].keep
    assert sorted(r.doc_id for r in quality.accepted(d).collect()) == sorted(i for i, r in got.items() if r.keep)
    assert quality.classify(empty.select("doc_id", "text")).count() == 0


def test_quality_classifier_learns_from_labels_in_other_languages(spark):
    rng = random.Random(8)
    vocab = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    rows, labels, toxic = [], [], set()
    for i in range(600):
        w = [rng.choice(vocab) for _ in range(rng.randint(40, 120))]
        kind = rng.choice(["good"] * 5 + ["junk", "english", "other"])
        for _ in range(3):
            w.insert(rng.randrange(len(w)), {"english": "idiot", "other": "réeux" + rng.choice(vocab)}.get(kind, "plain"))
        if kind == "junk":
            w = [x + "***" for x in w]
        if kind in ("english", "other"):
            toxic.add(i)
        rows.append((i, " ".join(w)))
        if i % 2:
            labels.append((i, int(kind != "junk"), int(i in toxic)))
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in quality.classify(d, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()}
    assert sum((got[i].toxic_score >= 0.5) == (i in toxic) for i in range(0, 600, 2)) > 0.95 * 300


def test_quality_sample_takes_all_rare_labels():
    assert quality.quotas([5, 1000, 20, 4000], 500) == [5, 237, 20, 238]
    assert quality.quotas([900, 30, 40, 5000], 500) == [215, 30, 40, 215] and quality.quotas([900, 30, 40, 5000], 9000) == [900, 30, 40, 5000]


def test_one_row_of_each_group_of_near_duplicates_stays(spark):
    rng = random.Random(2)
    one, two, three = (" ".join(rng.choice("abcdefghijklmnop") * 3 for _ in range(80)) for _ in range(3))
    rows = [(1, one), (1, two), (2, one + " x"), (3, two), (3, three), (None, three), (None, three.upper()), (None, "alone and only once here"), (None, "alone and only once here")]
    rows += [(4, None), (4, ""), (None, None), (5, "short"), (5, "short"), (5, "SHORT"), (6, "short")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id bigint, text string, n string").repartition(3)
    kept = sorted(((r.doc_id, r.text) for r in jaccard.deduplicated(df).collect()), key=repr)
    exact = [x for x in kept if x[1] is None or x[1].lower() != "short"]
    assert exact == sorted([(1, one), (1, two), (3, three), (None, "alone and only once here"), (4, None), (4, ""), (None, None)], key=repr)
    assert len(kept) == len(exact) + 1 and {i for i, t in kept if t and t.lower() == "short"} == {5}


def test_pii_time_follows_the_spans(spark):
    n = 100_000
    text = " ".join(f"u{i}@ex.org" + (" é" if i % 7 == 0 else "") for i in range(n))
    df = spark.createDataFrame([(1, text), (2, "1.2.3.4." * 3000 + "5@x.y and 1.2.3.4"), (3, None)], "doc_id bigint, text string")
    start = time.monotonic()
    by = {r.doc_id: r for r in pii.scan(df).collect()}
    out = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert time.monotonic() - start < 60
    assert by[1].n_email == n and by[1].spans.endswith(f"email:{text.index(f'u{n - 1}@')}:{text.index(f'u{n - 1}@') + len(f'u{n - 1}@ex.org')}")
    assert out[1] == re.sub(r"u[0-9]+@ex\.org", "[EMAIL]", text)
    assert by[2].n_ip > 1000 and out[2] == "[EMAIL] and [IP]" and out[3] is None
