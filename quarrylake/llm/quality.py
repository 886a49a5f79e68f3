"""Operator 10, quality classifier by weak labels: expectation-maximisation over overlapping heuristic labellers, then a hashed
linear scorer trained on their posterior.

Two heads share the code: junk (symbols, shouting, repetition, tables) and toxic (insults). Each labeller votes bad, good or
abstains on every document; a table of labels, where given, is one more labeller that abstains on most. The votes' patterns are
counted over the whole corpus, and from these counts alone EM estimates how often each labeller, the table of labels among them, votes
what for good and bad documents. That labels are right is a prior of TRUST times their number; without it EM would take the word lists'
silence on words they don't know for proof that labels err. The posteriors of SAMPLE documents at most, those of the smallest hash of
doc_id within each kind of label, train the scorer by follow-the-regularised-leader, each by the information that the votes gave on it:
a posterior that hardly moved from the share of bad documents counts little. Then the scorer scores every whole text. It sees the text
alone, never a vote: hashed words and runs of bytes, shares of word shapes, bins of repetition, and stems. In the toxic head, stems that
tell bad texts in the sample weigh more, by the lower bound of their log ratio, so what labels say in languages without a word list
reaches the scorer.

The fit is one executor task over the stored sample, whose size SAMPLE bounds; both heads share it, and only weights reach the driver.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylake.llm import _text
from quarrylake.llm._linear import Ftrl, counted, hashed_grams, softmax
from quarrylake.llm._work import in_one_task, ship, stored

LOG2_DIMS = 14
SAMPLE = 12_000
THRESHOLD = 0.5
SHORT = 20  # words below which repetition says nothing
SHRINK = 400.0  # in the square of a text's length in features, so that the few features of short texts weigh little
SURE = 0.999  # that a label is right, before EM
SHARPNESS = 3  # power of a posterior's information by which its row counts: many rows that votes hardly moved must not outvote few told
TRUST = 10.0  # how many labels each label stands for in the prior of that
STEM = 6  # bytes
LOG2_STEMS = 18  # stems that share a bucket blur each other
SHAPE_WEIGHT = 3.0
TELL, BOUND = 10.0, 2.0  # weight of a unit of log ratio; standard errors by which it is lowered
GOOD, NONE, BAD = 0, 1, 2

# Insults, as nouns and as adjectives, in English, German, French and Spanish.
NOUNS = (
    "idiot idiots moron morons loser losers clown clowns scum trash imbecile imbeciles jerk jerks bastard bastards scumbag dumbass cretin vermin "
    "idioten trottel dummkopf dummköpfe arschloch arschlöcher abschaum schwachkopf vollidiot mistkerl "
    "connard connards abruti abrutis crétin crétins salaud salauds ordure imbécile imbéciles "
    "idiota idiotas imbécil imbéciles cabrón cabrones gilipollas escoria basura"
).split()
ADJECTIVES = (
    "stupid worthless pathetic disgusting despicable brainless contemptible repulsive loathsome idiotic moronic "
    "erbärmlich widerlich wertlos hirnlos minable pitoyable répugnant méprisable estúpido estúpida patético repugnante despreciable"
).split()

_CLASS = np.zeros(256, np.uint8)  # 0 other bytes (letters beyond ASCII too), 1 upper, 2 lower, 3 digit, 4 space, 5 plain marks, 6 odd marks
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = 1, 2, 3
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
for _c in b".,;:?!'\"-()":
    _CLASS[_c] = 5
for _c in b"#$%&*+/<=>@[\\]^_`{|}~":
    _CLASS[_c] = 6


def _lexicon(ws: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(ws).encode(), np.uint8)
    (h,), _ = _text.words(data, np.array([0, len(data)]), lower=True)
    return np.sort(h)


_STRIP = np.arange(256, dtype=np.uint8)  # ASCII marks and digits are white space here
for _c in range(128):
    if not (65 <= _c <= 90 or 97 <= _c <= 122):
        _STRIP[_c] = 32
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_LEX = [_lexicon(NOUNS), _lexicon(ADJECTIVES)]


def _sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(values)])
    return c[offs[1:]] - c[offs[:-1]]


def _vote(x: np.ndarray, good: float, bad: float, known: np.ndarray) -> np.ndarray:
    """BAD from `bad` up, GOOD up to `good`."""
    return np.where(~known, NONE, np.where(x >= bad, BAD, np.where(x <= good, GOOD, NONE)))


def votes(data: np.ndarray, offs: np.ndarray) -> tuple[dict[str, np.ndarray], list[np.ndarray], np.ndarray]:
    """(votes of each head's labellers by document, word hashes of each document, whether it has words)."""
    cls = _CLASS[data]
    n_bytes = np.maximum(1, np.diff(offs))
    upper, lower, odd, marks = (_sums(cls == k, offs) for k in (1, 2, 6, 5))
    space = np.maximum(0, _sums(cls == 4, offs))
    solid = np.maximum(1, n_bytes - space)
    (h,), first = _text.words(data, offs, lower=False)
    n = np.diff(first)
    has = n > 0
    docs = [h[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
    top, fresh, echo = np.zeros(len(n)), np.ones(len(n)), np.zeros(len(n))
    for i, w in enumerate(docs):
        if len(w) > 1:
            echo[i] = (w[1:] == w[:-1]).mean()
        if len(w) >= SHORT:
            _, c = np.unique(w, return_counts=True)
            g = _text.grams(w, 3)
            top[i], fresh[i] = c.max() / len(w), len(np.unique(g)) / len(g)
    # Words whose last byte, or only byte, is an odd mark; and words that end in two exclamation marks.
    last = np.zeros(len(data), bool)
    if len(data):
        solid_at = cls != 4
        last[:-1] = solid_at[:-1] & ~solid_at[1:]
        last[-1] = solid_at[-1]
        ends = offs[1:][np.diff(offs) > 0] - 1
        last[ends] = solid_at[ends]
    odd_ends = _sums(last & (cls == 6), offs) / np.maximum(1, n)
    shout = np.zeros(len(data), bool)
    if len(data) > 1:
        shout[1:] = last[1:] & (data[1:] == 33) & (data[:-1] == 33)
    shouts = _sums(shout, offs) / np.maximum(1, n)
    letters = upper + lower
    long_ = has & (n >= SHORT)
    junk = np.stack([
        _vote(odd / solid, 0.02, 0.06, has),
        _vote(odd_ends, 0.05, 0.25, has),
        _vote(upper / np.maximum(1, letters), 0.2, 0.6, has & (letters >= 10)),
        _vote(shouts, 0.05, 0.3, has),
        _vote(top, 0.2, 0.35, long_),
        _vote(1 - fresh, 0.25, 0.5, long_),
        _vote((odd + marks) / solid, 0.1, 0.2, long_),
        _vote(echo, 0.1, 0.3, has & (n >= 6)),
    ], axis=1)
    (w,), wf = _text.words(_STRIP[data], offs, lower=True)
    found = [np.isin(w, lex) for lex in _LEX]
    a, b = (_sums(x, wf) for x in found)
    nw = np.diff(wf)
    # That the lists find nothing is one piece of evidence, not four: only one labeller votes GOOD on it.
    toxic = np.stack([
        np.where(has & (a > 0), BAD, NONE),
        np.where(has & (b > 0), BAD, NONE),
        np.where(has, np.where(a + b >= 2, BAD, np.where(a + b == 0, GOOD, NONE)), NONE),
        np.where(has & ((a + b) / np.maximum(1, nw) >= 0.004), BAD, NONE),
    ], axis=1)
    return {"junk": junk, "toxic": toxic}, docs, has


def _people(column: str, bad: int):
    return F.when(F.col(column).isNull(), F.lit(NONE)).when(F.col(column) == bad, F.lit(BAD)).otherwise(F.lit(GOOD))


HEADS = {"junk": 8, "toxic": 4}  # labellers of texts; the table of labels comes after them


def coded(v: np.ndarray) -> np.ndarray:
    return (v * 3 ** np.arange(v.shape[1])).sum(axis=1)


def decoded(code: np.ndarray, k: int) -> np.ndarray:
    return code[:, None] // 3 ** np.arange(k) % 3


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60, prior: float = 5.0) -> tuple[float, np.ndarray]:
    """(share of bad documents, P(vote | good or bad, no abstention) by labeller) from counted vote patterns; the last labeller is the
    table of labels.

    Abstentions say nothing: labellers abstain together on short texts, so they are no independent evidence.

    Starts from labels, and elsewhere from the number of bad votes, since each kind of bad document moves its own labellers only. A few
    pseudo-counts say that labellers are more often right than wrong, which also keeps the two classes from changing places; for labels
    there are TRUST times as many as labels, and SURE of them are right.
    """
    k = patterns.shape[1]
    post = np.array([0.02, 0.6, 0.9])[np.minimum(2, (patterns == BAD).sum(axis=1))]
    post = np.where(patterns[:, -1] == NONE, post, np.where(patterns[:, -1] == BAD, SURE, 1 - SURE))
    pseudo = np.repeat(prior * np.array([[0.8, 0.0, 0.2], [0.2, 0.0, 0.8]])[:, None], k, axis=1)
    pseudo[:, -1] += TRUST * counts[patterns[:, -1] != NONE].sum() * np.array([[SURE, 0, 1 - SURE], [1 - SURE, 0, SURE]])
    share, table = 0.1, np.ones((2, k, 3))
    for _ in range(rounds):
        by = np.stack([counts * (1 - post), counts * post])
        share = float((by[1].sum() + 1) / (counts.sum() + 10))
        for v in (GOOD, BAD):
            table[:, :, v] = by @ (patterns == v) + pseudo[:, :, v]
        table[:, :, [GOOD, BAD]] /= table[:, :, [GOOD, BAD]].sum(axis=2, keepdims=True)
        post = posterior(patterns, share, table)
    return share, table


def posterior(patterns: np.ndarray, share: float, table: np.ndarray) -> np.ndarray:
    """P(bad | votes)."""
    at = np.arange(patterns.shape[1])
    odds = np.log(share / (1 - share)) + (np.log(table[1][at, patterns]) - np.log(table[0][at, patterns])).sum(axis=1)
    return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def information(p: np.ndarray, share: float) -> np.ndarray:
    """How far posteriors moved from the share of bad documents: their divergence from it, of that of certainty on the same side."""
    p = np.clip(p, 1e-12, 1 - 1e-12)
    moved = p * np.log(p / share) + (1 - p) * np.log((1 - p) / (1 - share))
    return np.maximum(0, moved) / np.where(p >= share, -np.log(share), -np.log(1 - share))


def stems(data: np.ndarray) -> np.ndarray:
    """Buckets of the first STEM bytes of a text's words, in lower case: those that occur, and anew those that occur twice."""
    solid = ~_text._SPACE[data]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    at = np.flatnonzero(begin)
    codes, inside = np.append(_LOWER[data], np.zeros(STEM, np.uint64)), np.append(solid, np.zeros(STEM, bool))
    h, live = np.full(len(at), np.uint64(0x9E3779B97F4A7C15)), np.ones(len(at), bool)
    for j in range(STEM):
        live &= inside[at + j]
        h = np.where(live, (h ^ codes[at + j]) * np.uint64(0x100000001B3), h)
    found, n = np.unique((_text.mix(h) >> np.uint64(65 - LOG2_STEMS)).astype(np.int64), return_counts=True)
    return np.concatenate([found, found[n > 1] + (1 << LOG2_STEMS - 1)])


SHAPES = 7 * 7 * 2 + 22  # word shapes, then two rows of bins


def width(log2_dims: int) -> int:
    """Number of features: words and runs of bytes, a constant, shapes and bins, stems."""
    return (1 << log2_dims) + 1 + SHAPES + (1 << LOG2_STEMS)


def shapes(data: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Shares of word shapes (class of the first and of the last byte, whether a lower-case letter is there) and, as ones in two
    rows of eleven bins, the shares of repeated three-word runs and of words that repeat the one before. All shares are those of the
    text with SHORT plain lower-case words more, so that short texts look plain."""
    out = np.zeros(SHAPES)
    total = len(w) + SHORT
    cls = _CLASS[data]
    solid = np.concatenate([[False], cls != 4, [False]])
    first, end = np.flatnonzero(solid[1:-1] & ~solid[:-2]), np.flatnonzero(solid[1:-1] & ~solid[2:])
    low = np.concatenate([[0], np.cumsum((cls == 2) | (cls == 0))])
    out[: 7 * 7 * 2] = np.bincount((cls[first].astype(np.int64) * 7 + cls[end]) * 2 + (low[end + 1] > low[first]), minlength=7 * 7 * 2)
    out[(2 * 7 + 2) * 2 + 1] += SHORT
    out /= total
    g = _text.grams(w, 3)
    stale, echo = (len(g) - len(np.unique(g))) / total, float((w[1:] == w[:-1]).sum()) / total
    out[98 + int(10 * stale)] = out[109 + int(10 * echo)] = 1
    return out


def features(data: np.ndarray, w: np.ndarray, log2_dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values) of a text: words, runs of three and six bytes, a constant, shapes and bins, stems."""
    part, codes = log2_dims - 2, data.astype(np.uint64)
    grams = [hashed_grams(codes, 3, part) + (1 << part), hashed_grams(codes, 6, part + 1) + (2 << part)]
    at, n = counted(np.concatenate([(w >> np.uint64(64 - part)).astype(np.int64), *grams]), 1 << log2_dims)
    x, shape, s, base = 1 + np.log(n), shapes(data, w), stems(data), 1 << log2_dims
    on = np.flatnonzero(shape)
    return (
        np.concatenate([at, [base], base + 1 + on, base + 1 + SHAPES + s]),
        np.concatenate([x / np.sqrt((x * x).sum() + SHRINK), [1.0], SHAPE_WEIGHT * shape[on], np.full(len(s), 1 / np.sqrt(len(w) + SHORT))]),
    )


def scales(head: str, rows: list[tuple[np.ndarray, np.ndarray]], bad: np.ndarray, heft: np.ndarray, log2_dims: int) -> np.ndarray:
    """The scale of each feature, from rows that count by heft. The junk head takes all but stems as they are. In the toxic head a stem has TELL times the log ratio
    between bad and good rows, less BOUND standard errors, if above zero; shapes say nothing there."""
    dims, shapes_at = width(log2_dims), (1 << log2_dims) + 1
    stems_at = shapes_at + SHAPES
    out = np.ones(dims)
    out[stems_at:] = 0
    if head == "toxic":
        n = np.zeros((2, dims))
        for (at, _), p, h in zip(rows, bad.tolist(), heft.tolist(), strict=True):
            n[0, at] += h * (1 - p)
            n[1, at] += h * p
        ratio = np.log((n[1] + 0.5) / ((heft * bad).sum() + 1)) - np.log((n[0] + 0.5) / ((heft * (1 - bad)).sum() + 1))
        out[stems_at:] = (TELL * np.maximum(0, ratio - BOUND * np.sqrt((1 / (n + 0.5)).sum(axis=0))))[stems_at:]
        out[shapes_at:stems_at] = 0
    return out


def quotas(counts: list[int], sample: int) -> list[int]:
    """How many of each stratum to take: equal shares, where small strata leave theirs to the others."""
    out, left = [0] * len(counts), sample
    for done, i in enumerate(sorted(range(len(counts)), key=counts.__getitem__)):
        out[i] = min(counts[i], left // (len(counts) - done))
        left -= out[i]
    return out


def _logit(p: float) -> float:
    return float(np.log(p / (1 - p)))




def _voted(docs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """doc_id, h (a hash of the text), and for each head the code of its labellers' votes and the vote of the table of labels."""

    def run(batches):
        for batch in batches:
            for b in _text.blocks(batch):
                v, _, _ = votes(*_text.bytes_of(b.column(1)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array(coded(v[h])) for h in HEADS)], names=["doc_id", "h", *HEADS])

    spark = docs.sparkSession
    if labels is None:
        labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    people = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    people = people.select("doc_id", _people("quality", 0).alias("p_junk"), _people("toxic", 1).alias("p_toxic"))
    voted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h")).mapInArrow(run, "doc_id bigint, h bigint, junk bigint, toxic bigint")
    voted = voted.join(people, "doc_id", "left").select("doc_id", "h", "junk", "toxic", *(F.coalesce(f"p_{h}", F.lit(NONE)).cast("long").alias(f"p_{h}") for h in HEADS))
    return stored(voted, "quality-votes")


def fit(docs: DataFrame, labels: DataFrame | None = None, sample: int = SAMPLE, log2_dims: int = LOG2_DIMS) -> np.ndarray:
    """The scorer's weights: two columns, good and bad, for each head."""
    ship(docs.sparkSession)
    voted = _voted(docs, labels)
    codes = [F.struct(F.lit(h).alias("head"), (F.col(h) + F.lit(3**k) * F.col(f"p_{h}")).alias("code")) for h, k in HEADS.items()]
    t = voted.select(F.explode(F.array(*codes)).alias("c")).groupBy("c.head", "c.code").agg(F.count("*").alias("n")).toArrow()  # 3**9 + 3**5 rows at most
    t = t.sort_by([("head", "ascending"), ("code", "ascending")])
    model = {}
    for head, k in HEADS.items():
        mine = [(c, n) for h, c, n in zip(*(t.column(i).to_pylist() for i in range(3)), strict=True) if h == head]
        p = decoded(np.array([c for c, _ in mine], np.int64), k + 1)
        model[head] = estimate(p, np.array([n for _, n in mine], np.float64)) if mine else (0.1, np.ones((2, k + 1, 3)))

    # One row of each doc_id, so that repeats can't crowd the sample.
    told = [f"p_{h}" for h in HEADS]
    ids = voted.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("h", *HEADS, *told)).alias("v")).select("doc_id", "v.*")
    strata = sorted((r["p_junk"], r["p_toxic"], r["n"]) for r in ids.groupBy(*told).agg(F.count("*").alias("n")).collect())  # 9 rows at most
    takes = quotas([n for *_, n in strata], sample)
    part, most = F.lit(0.0), F.lit(0)
    for (junk, toxic, n), q in zip(strata, takes, strict=True):
        here = (F.col("p_junk") == junk) & (F.col("p_toxic") == toxic)
        part, most = F.when(here, F.lit((1.2 * q + 50) / n)).otherwise(part), F.when(here, F.lit(q)).otherwise(most)
    mark = F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    rank = F.row_number().over(Window.partitionBy(*told).orderBy("mark", "doc_id"))
    chosen = ids.withColumn("mark", mark).where(F.col("mark") < part).withColumn("r", rank).where(F.col("r") <= sample).where(F.col("r") <= most)
    chosen = stored(chosen.select("doc_id", "h", *HEADS, *told), "quality-chosen")  # at most `sample` rows

    def vectors(batches):
        for batch in batches:
            for b in _text.blocks(batch):
                data, offs = _text.bytes_of(b.column(1))
                (w,), first = _text.words(data, offs, lower=False)
                f = [features(data[offs[i] : offs[i + 1]], w[first[i] : first[i + 1]], log2_dims) for i in range(b.num_rows) if first[i + 1] > first[i]]
                keep = b.take(pa.array(np.flatnonzero(np.diff(first))))
                yield pa.RecordBatch.from_arrays([keep.column(0), *keep.columns[2:], pa.array([x[0].astype(np.int32).tobytes() for x in f], pa.binary()), pa.array([x[1].astype(np.float32).tobytes() for x in f], pa.binary())], names=["doc_id", *HEADS, *told, "at", "x"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("h", F.xxhash64("text"))
    picked = picked.join(F.broadcast(chosen), ["doc_id", "h"]).groupBy("doc_id").agg(F.first("text").alias("text"), *(F.first(c).alias(c) for c in (*HEADS, *told)))
    longs = ", ".join(f"{c} bigint" for c in (*HEADS, *told))
    rows = stored(picked.mapInArrow(vectors, f"doc_id bigint, {longs}, at binary, x binary"), "quality-sample")
    weigh = {(junk, toxic): n / q for (junk, toxic, n), q in zip(strata, takes, strict=True) if q}
    w = np.zeros((width(log2_dims), 2 * len(HEADS)), np.float32)
    got = in_one_task(rows, partial(_train, model, weigh, log2_dims), "column int, at binary, w binary").toArrow()
    for c, at, x in zip(*(got.column(i).to_pylist() for i in range(3)), strict=True):
        w[np.frombuffer(at, np.int32), c] = np.frombuffer(x, np.float32)
    return w


def _train(model: dict, weigh: dict, log2_dims: int, t: pa.Table) -> pa.RecordBatch:
    """Places and values of the weights that are not zero, for each column; t: the sample, which is read in place."""
    order = np.argsort(t.column("doc_id").to_numpy(), kind="stable")
    views = list(zip(_text.views(t.column("at"), np.int32), _text.views(t.column("x"), np.float32), strict=True))
    rows = [views[i] for i in order.tolist()]
    told = {c: t.column(c).to_numpy()[order] for c in (*HEADS, *(f"p_{h}" for h in HEADS))}
    heft = np.array([weigh[x] for x in zip(told["p_junk"].tolist(), told["p_toxic"].tolist(), strict=True)])
    at, values = [], []
    for head, k in HEADS.items():
        bad = posterior(np.column_stack([decoded(told[head], k), told[f"p_{head}"]]).astype(np.int64), *model[head])
        known = information(bad, model[head][0]) ** SHARPNESS
        u = scales(head, rows, bad, known, log2_dims)
        w = Ftrl(width(log2_dims), 2, l1=0.05).fit(rows, np.stack([1 - bad, bad], axis=1), scale=u, heft=known) * u[:, None]
        if len(rows):  # strata aren't taken in proportion; the constant makes up for it
            share = np.clip([bad.mean(), np.average(bad, weights=heft)], 1e-6, 1 - 1e-6)
            w[1 << log2_dims, 1] += _logit(share[1]) - _logit(share[0])
        for c in range(2):
            on = np.flatnonzero(w[:, c])
            at.append(on.astype(np.int32).tobytes())
            values.append(w[on, c].astype(np.float32).tobytes())
    return pa.RecordBatch.from_arrays([pa.array(range(len(at)), pa.int32()), pa.array(at, pa.binary()), pa.array(values, pa.binary())], names=["column", "at", "w"])


def scored(texts: pa.Array, w: np.ndarray, threshold: float, log2_dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, toxic_score, keep) of each text."""
    data, offs = _text.bytes_of(texts)
    (h,), first = _text.words(data, offs, lower=False)
    good, toxic, has = np.zeros(len(texts)), np.zeros(len(texts)), np.diff(first) > 0
    for i in np.flatnonzero(has).tolist():
        at, x = features(data[offs[i] : offs[i + 1]], h[first[i] : first[i + 1]], log2_dims)
        s = x @ w[at]
        good[i], toxic[i] = softmax(s[:2])[0], softmax(s[2:])[1]
    return good, toxic, has & (good >= 1 - threshold) & (toxic < threshold)


def classify(docs: DataFrame, labels: DataFrame | None = None, sample: int = SAMPLE, threshold: float = THRESHOLD, log2_dims: int = LOG2_DIMS) -> DataFrame:
    """For each row of docs: doc_id, score (of not being junk, 0 to 1), toxic_score (0 to 1), keep (score >= 1 - threshold and
    toxic_score < threshold).

    labels(doc_id, quality 0 or 1, toxic 0 or 1), if given, counts as a labeller of both heads; nulls abstain, and of several rows
    of a doc_id the worst holds. Texts that are null or blank have score 0, toxic_score 0, and are not kept. Repeated rows are
    scored each, and equal texts equally; of the rows of a doc_id one takes part in the fit, and rows without doc_id in the counts
    of votes only. Empty table: no rows. Other columns are not read.
    """
    weights = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample, log2_dims))

    def run(batches):
        for batch in batches:
            for b in _text.blocks(batch):
                good, toxic, keep = scored(b.column(1), weights.value, threshold, log2_dims)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(good), pa.array(toxic), pa.array(keep)], names=["doc_id", "score", "toxic_score", "keep"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, score double, toxic_score double, keep boolean")


def accepted(docs: DataFrame, labels: DataFrame | None = None, sample: int = SAMPLE, threshold: float = THRESHOLD, log2_dims: int = LOG2_DIMS) -> DataFrame:
    """The rows of docs that `classify` keeps, with all their columns."""
    weights = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample, log2_dims))
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for b in _text.blocks(batch):
                yield b.filter(pa.array(scored(b.column(at), weights.value, threshold, log2_dims)[2]))

    return docs.mapInArrow(run, docs.schema)
