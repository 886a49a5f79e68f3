"""Trained operators against plain Python: the same statistics, the same regression, the same scores; and tables that are awkward."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quarrylake.llm import decontaminate, langid, mixing, quality, substrings
from quarrylake.llm._linear import Ftrl, temperature
from quarrylake.llm._work import without


def softmax(s):
    e = [math.exp(x - max(s)) for x in s]
    return [x / sum(e) for x in e]


def ftrl(rows, y, classes, heft=None, alpha=0.5, beta=1.0, l1=0.02, l2=0.05, epochs=3):
    """Follow-the-regularised-leader, one weight at a time; rows are dicts."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(f, c):
        v = z[f, c]
        return 0.0 if abs(v) <= l1 else -(v - math.copysign(l1, v)) / ((beta + math.sqrt(n[f, c])) / alpha + l2)

    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            w = {(f, c): weight(f, c) for f in rows[i] for c in range(classes)}
            p = softmax([sum(x * w[f, c] for f, x in rows[i].items()) for c in range(classes)])
            for f, x in rows[i].items():
                for c in range(classes):
                    g = x * (p[c] - y[i][c]) * (1 if heft is None else heft[i])
                    z[f, c] += g - (math.sqrt(n[f, c] + g * g) - math.sqrt(n[f, c])) / alpha * w[f, c]
                    n[f, c] += g * g
    return {k: weight(*k) for k in z}


def em(votes, rounds=60, prior=5.0):
    """(share of bad, table) over documents, not over counted patterns; votes are lists of 0 good, 1 none, 2 bad, the last that of labels."""

    def post(v, share, table):
        odds = math.log(share / (1 - share)) + sum(math.log(table[1][j][x]) - math.log(table[0][j][x]) for j, x in enumerate(v) if x != 1)
        return 1 / (1 + math.exp(-odds))

    k, told = len(votes[0]), quality.TRUST * sum(v[-1] != 1 for v in votes)
    p = [(0.02, 0.6, 0.9)[min(2, sum(x == 2 for x in v))] if v[-1] == 1 else quality.SURE if v[-1] == 2 else 1 - quality.SURE for v in votes]
    for _ in range(rounds):
        share = (sum(p) + 1) / (len(votes) + 10)
        table = []
        for bad in (False, True):
            by = [q if bad else 1 - q for q in p]
            own = []
            for j in range(k):
                sure = told * (1 - quality.SURE if bad else quality.SURE) if j == k - 1 else 0
                unsure = told * (quality.SURE if bad else 1 - quality.SURE) if j == k - 1 else 0
                good = sum(b for b, v in zip(by, votes, strict=True) if v[j] == 0) + prior * (0.2 if bad else 0.8) + sure
                ill = sum(b for b, v in zip(by, votes, strict=True) if v[j] == 2) + prior * (0.8 if bad else 0.2) + unsure
                own.append({0: good / (good + ill), 1: 1.0, 2: ill / (good + ill)})
            table.append(own)
        p = [post(v, share, table) for v in votes]
    return share, table, p


def known(p, share):
    """What a row counts: its posterior's divergence from the share, of the most there is on its side, sharpened."""
    if p in (0.0, 1.0):
        return 1.0
    moved = p * math.log(p / share) + (1 - p) * math.log((1 - p) / (1 - share))
    return (moved / -math.log(share if p >= share else 1 - share)) ** quality.SHARPNESS


@pytest.mark.parametrize("classes", [2, 4])
def test_regression_agrees_with_one_weight_at_a_time(classes):
    rng = np.random.default_rng(classes)
    rows = [{int(f): float(rng.normal()) for f in rng.choice(40, 6, replace=False)} for _ in range(60)]
    y = rng.dirichlet(np.ones(classes), 60)
    want = ftrl(rows, y, classes)
    got = Ftrl(40, classes).fit([(np.array(list(r)), np.array(list(r.values()))) for r in rows], y)
    assert all(abs(got[f, c] - w) < 1e-9 for (f, c), w in want.items()) and any(w == 0 for w in want.values())


def corpus(n, seed, kinds):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    out = []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randint(5, 60))]
        kind = rng.choice(kinds)
        out.append((i, " ".join({"marks": [x + "***" for x in w], "shout": [x.upper() + "!!" for x in w], "echo": [w[0]] * len(w), "toxic": [*w, "you", "stupid", "worthless", "idiot"]}.get(kind, w)), kind))
    return out


def as_lists(texts):
    import pyarrow as pa

    from quarrylake.llm import _text

    data, offs = _text.bytes_of(pa.array(texts))
    v, _, _ = quality.votes(data, offs)
    (h,), first = _text.words(data, offs, lower=False)
    return v, [quality.features(data[offs[i] : offs[i + 1]], h[first[i] : first[i + 1]], quality.LOG2_DIMS) for i in range(len(texts))]


@pytest.mark.parametrize("labelled", [0, 90])
def test_quality_scores_agree_with_plain_python(spark, labelled):
    rows = corpus(160, 3, ["good"] * 5 + ["marks", "shout", "echo", "toxic"])
    labels = [(i, int(kind not in ("marks", "shout", "echo")), int(kind == "toxic")) for i, _, kind in rows[:labelled]]
    d = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string").repartition(3)
    given = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int") if labelled else None
    got = {r.doc_id: r for r in quality.classify(d, given).collect()}
    v, features = as_lists([t for _, t, _ in rows])
    said = {i: (q, t) for i, q, t in labels}
    for j, (head, score) in enumerate((("junk", lambda r: 1 - r.score), ("toxic", lambda r: r.toxic_score))):
        votes = [[*v[head][i].tolist(), 1 if i not in said else 2 if said[i][j] == j else 0] for i in range(len(rows))]
        share, _, post = em(votes)
        heft = [known(p, share) for p in post]
        scale = quality.scales(head, features, np.array(post), np.array(heft), quality.LOG2_DIMS)
        vectors = [{int(f): float(np.float32(x)) * scale[f] for f, x in zip(*r, strict=True) if scale[f]} for r in features]
        w = ftrl(vectors, [(1 - p, p) for p in post], 2, heft, l1=0.05)
        for i, _, _ in rows:
            p = softmax([sum(x * scale[f] * w.get((int(f), c), 0.0) for f, x in zip(*features[i], strict=True)) for c in range(2)])[1]
            assert abs(p - score(got[i])) < 2e-4


def test_language_scores_agree_with_plain_python(spark):
    rng = random.Random(1)
    pools = {"aa": "the of and thing with that".split(), "bb": "le la des que eau dans".split(), "cc": "der und das ein schön mit".split()}
    rows = [(i, " ".join(rng.choice(pools[lang]) for _ in range(12)), lang) for i in range(120) for lang in [rng.choice(list(pools))]]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    got = {r.doc_id: r for r in langid.identify(d).collect()}
    train = [(i, t, x) for i, t, x in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    counts = {i: dict(zip(*map(np.ndarray.tolist, langid.features(t)), strict=True)) for i, t, _ in rows}
    df = Counter(f for i, _, _ in train for f in counts[i])

    def vector(i):
        x = {f: (1 + math.log(n)) * (math.log((1 + len(train)) / (1 + df[f])) + 1) for f, n in counts[i].items()}
        size = math.sqrt(sum(v * v for v in x.values()))
        return {f: v / size for f, v in x.items()}

    names = sorted(pools)
    fitted = [(i, x) for i, _, x in train if zlib.crc32(f"calibrate:{i}".encode()) % 5]
    held = [(i, x) for i, _, x in train if not zlib.crc32(f"calibrate:{i}".encode()) % 5]
    w = ftrl([vector(i) for i, _ in fitted], [[float(x == n) for n in names] for _, x in fitted], 3)
    logits = lambda i: [sum(v * w.get((f, c), 0.0) for f, v in vector(i).items()) for c in range(3)]
    temp = temperature(np.array([logits(i) for i, _ in held]), np.array([names.index(x) for _, x in held]))
    for i, _, _ in rows:
        p = softmax([x / temp for x in logits(i)])
        assert got[i].lang_pred == names[p.index(max(p))] and abs(got[i].score - max(p)) < 1e-4


CLASH = "doc_id bigint, text string, lang string, source string, n_chars bigint, h int, junk int, row int, own int, mark int, at string, size int, TAKEN int, target int, source_size int, k int, keep boolean, gone int, n int, range int, to_0 int"


@pytest.fixture(scope="module")
def awkward(spark):
    """Repeated rows, null ids, very long texts, and columns named like those that operators make."""
    rows = corpus(60, 5, ["good"] * 4 + ["marks", "toxic"])
    rows = [(i, t, "en" if i % 2 else "xx", f"s{i % 3}") for i, t, _ in rows]
    rows += [rows[3]] * 30 + [(None, "some text here", None, None), (None, None, "en", "s1"), (200, "", "en", None), (201, "word " * 60_000, "en", "s0")]
    return spark.createDataFrame([(i, t, x, s, len(t or ""), 1, 2, 3, 4, 5, "at", 6, 7, 8, 9, 10, True, 11, 12, 13, 14) for i, t, x, s in rows], CLASH).repartition(4)


def own(rows):
    """What columns of one's own must still hold."""
    return {(r["h"], r["junk"], r["row"], r["own"], r["mark"], r["at"], r["size"], r["TAKEN"], r["target"], r["source_size"], r["k"], r["keep"], r["gone"], r["n"], r["range"], r["to_0"]) for r in rows} <= {(1, 2, 3, 4, 5, "at", 6, 7, 8, 9, 10, True, 11, 12, 13, 14)}


def test_awkward_tables(spark, awkward):
    n = awkward.count()
    lang = langid.identify(awkward).collect()
    assert len(lang) == n and len({(r.lang_pred, r.score) for r in lang if r.doc_id == 3}) == 1
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, None), (2, None, 1), (None, 0, 1)], "doc_id bigint, quality int, toxic int")
    scored = quality.classify(awkward, labels).collect()
    assert len(scored) == n and len({(r.score, r.toxic_score) for r in scored if r.doc_id == 3}) == 1
    kept = quality.accepted(awkward, labels)
    assert kept.columns == awkward.columns and own(kept.collect()) and kept.count() == sum(r.keep for r in scored)
    rest = without(awkward, "doc_id", spark.createDataFrame([(3,), (None,)], "doc_id bigint"))
    assert rest.columns == awkward.columns and own(rest.collect()) and rest.count() == n - 31


def test_mixing_awkward_tables(spark, awkward):
    mixed = mixing.mix(awkward)
    rows = mixed.collect()
    assert mixed.columns == [*awkward.columns, "mix_size", "mix_source_size", "mix_target", "mix_taken"] and own(rows) and len(rows) == awkward.count()
    for s in {r.source for r in rows}:
        took = sum(r.mix_taken for r in rows if r.source == s)
        assert abs(took - next(r.mix_target for r in rows if r.source == s)) <= max(r.mix_size for r in rows if r.source == s)
    same = [r for r in rows if r.doc_id == 3]
    assert len(same) == 31 and {r.mix_taken for r in same} <= {0, same[0].mix_size, 2 * same[0].mix_size}
    many = spark.createDataFrame([(1, "a", "one two three")] * 50 + [(2, "b", "x y")] * 10, "doc_id bigint, source string, text string")
    got = mixing.mix(many).collect()  # equal rows, of which the mix takes some
    for s in "ab":
        own_rows = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own_rows) - own_rows[0].target) <= 3 and max(r.taken for r in own_rows) <= 2 * own_rows[0]["size"]


def test_decontamination_of_scattered_and_short_items(spark):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(4000)]
    item = rng.sample(vocab, 24)
    pieces = [" ".join(item[a : a + 8]) for a in (0, 4, 8, 12, 16)]  # shingles of the whole item, in pieces all over a text
    filler = lambda n: " ".join(rng.choice(vocab[:300]) for _ in range(n))
    text = " ".join(filler(400) + " " + p for p in pieces)
    items = [(1, " ".join(item)), (2, "two words"), (3, "lone"), *((10 + i, filler(4)) for i in range(30)), (None, "two words")]
    docs = [(1, text), (2, filler(50) + " two words " + filler(50)), (3, "LONE"), (None, " ".join(item)), (4, filler(500))]
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert {(1, 1), (2, 2), (3, 3)} <= got and not any(d is None or i is None for d, i in got) and (4, 1) not in got
    with pytest.raises(ValueError, match="bands"):
        one = spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")
        decontaminate.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), one, containment=0.05)


def test_substrings_with_text(spark):
    w = [f"w{i}" for i in range(120)]
    rows = [(1, " ".join(w[:60])), (2, "a " + " ".join(w[:60]) + " b"), (3, None)]
    got = {r.doc_id: r for r in substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id bigint, text string"), with_text=True).collect()}
    assert got[1].kept == rows[0][1] and got[2].kept == "a b" and got[2].n_removed == 60 and got[3].kept == ""


def test_estimates_of_every_labeller_reach_the_scores(spark, monkeypatch):
    rows = corpus(700, 5, ["good"] * 5 + ["marks", "toxic"])
    labels = [(i, int(kind != "marks"), int(kind == "toxic")) for i, _, kind in rows[:400]]  # many labels change nothing of the method
    d = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    given = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    before = {r.doc_id: r for r in quality.classify(d, given).collect()}
    plain, rng = quality.estimate, np.random.default_rng(0)

    def scrambled(patterns, counts, **more):
        share, table = plain(patterns, counts, **more)
        noise = rng.uniform(0.2, 0.8, table.shape[:2])
        return share, np.stack([noise, np.ones_like(noise), 1 - noise], axis=2)

    monkeypatch.setattr(quality, "estimate", scrambled)
    after = {r.doc_id: r for r in quality.classify(d, given).collect()}
    assert sum(abs(before[i].score - after[i].score) > 0.01 for i in before) > 350
    assert sum(abs(before[i].toxic_score - after[i].toxic_score) > 0.01 for i in before) > 350
    assert sum(before[i].keep == (kind == "good") for i, _, kind in rows) > 0.97 * len(rows)


def test_labels_count_as_one_labeller():
    patterns = np.array([[0, 0, 1], [2, 2, 1], [0, 1, 2], [0, 0, 0], [2, 2, 0], [2, 2, 2]])
    counts = np.array([900.0, 60, 30, 300, 1, 20])
    share, table = quality.estimate(patterns, counts)
    post = quality.posterior(patterns, share, table)
    assert 0.5 < post[2] < 1 - 1e-6 and post[5] > post[2] and post[4] > post[3]  # a label may be wrong, and other votes move it
    assert 0.9 < table[1, -1, 2] < 1 and 0 < table[0, -1, 2] < 0.1


def test_training_reads_its_rows_in_place(monkeypatch):
    rng, seen = np.random.default_rng(3), []
    ats = [np.sort(rng.integers(0, quality.width(14), 50)).astype(np.int32) for _ in range(40)]
    told = {c: pa.array(rng.integers(0, 3, 40)) for c in ("junk", "toxic", "p_junk", "p_toxic")}
    t = pa.table({"doc_id": pa.array(range(40))} | told | {"at": pa.array([a.tobytes() for a in ats], pa.binary()), "x": pa.array([np.full(50, i, np.float32).tobytes() for i in range(40)], pa.binary())})
    monkeypatch.setattr(quality.Ftrl, "fit", lambda self, rows, *a, **k: seen.append(rows) or self.weights())
    model = {h: (0.1, np.ones((2, k + 1, 3))) for h, k in quality.HEADS.items()}
    quality._train(model, {(a, b): 1.0 for a in range(3) for b in range(3)}, 14, t)
    whole = {c: np.frombuffer(t.column(c).chunk(0).buffers()[2], np.uint8) for c in ("at", "x")}
    for i, (at, x) in enumerate(seen[0]):
        assert at.tolist() == ats[i].tolist() and x.tolist() == [i] * 50
        assert np.shares_memory(at, whole["at"]) and np.shares_memory(x, whole["x"])
