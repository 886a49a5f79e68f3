"""Operator 4, language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies count every training document. The regression is fitted by follow-the-regularised-leader with elastic-net
penalties on a sample of at most PER_LANGUAGE documents of each language and SAMPLE in all, those of the smallest hash of doc_id; one
in five of these is kept out of the fit and sets the temperature. The fit is one executor task over the stored sample, and only
weights reach the driver. Then every whole text is scored.
"""

from __future__ import annotations

import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylake.llm import _text
from quarrylake.llm._linear import Ftrl, counted, hashed_grams, softmax, temperature, weighed
from quarrylake.llm._work import in_one_task, sent, ship, stored

LOG2_DIMS = 14
ORDERS = (1, 2, 3)
PER_LANGUAGE = 1_500
SAMPLE = 12_000
UNKNOWN = "und"


def features(text: str, log2_dims: int = LOG2_DIMS) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of the character n-grams of a text, lower-cased; digits count as one character."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    codes[(codes >= 48) & (codes <= 57)] = 48
    return counted(np.concatenate([hashed_grams(codes, n, log2_dims) for n in ORDERS]), 1 << log2_dims)


def has_letter(text: str) -> bool:
    """Whether a character is a letter (Unicode categories L*); numerals like the superscript two are none."""
    return any(map(str.isalpha, text))


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of doc_id as text modulo 3; null without doc_id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def fit(train: DataFrame, per_language: int = PER_LANGUAGE, most: int = SAMPLE, log2_dims: int = LOG2_DIMS):
    """(languages, weights, idf, temperature) from train(doc_id, text, lang), or None if it has no labelled text."""
    dims = 1 << log2_dims
    train = train.where("lang is not null and text is not null").select("doc_id", "text", "lang")

    def frequencies(batches):
        df, n = np.zeros(dims, np.int64), 0
        for b in batches:
            for t in b.column(0).to_pylist():
                df[features(t, log2_dims)[0]] += 1
                n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, dims)), pa.array(np.append(df[at], n))], names=["bucket", "n"])

    t = train.select("text").mapInArrow(frequencies, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # dims + 1 rows at most
    df = np.zeros(dims + 1, np.int64)
    df[t.column("bucket").to_numpy()] = t.column("n").to_numpy()
    if not df[dims]:
        return None
    idf = np.log((1 + df[dims]) / (1 + df[:dims])) + 1

    # The rate of each language is known before any text moves: rows are chosen in place.
    langs = stored(train.groupBy("lang").agg(F.count("*").alias("n")), "langid-languages")
    each = max(1, min(per_language, most // langs.count()))
    mark = F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    near = train.withColumn("mark", mark).join(sent(langs), "lang").where(F.col("mark") * F.col("n") < 1.2 * each + 50)

    def vectors(batches):
        for batch in batches:
            for b in _text.blocks(batch):
                f = [features(x, log2_dims) for x in b.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array([x[0].astype(np.int32).tobytes() for x in f], pa.binary()), pa.array([x[1].astype(np.int32).tobytes() for x in f], pa.binary())], names=["doc_id", "lang", "mark", "at", "n"])

    drawn = near.select("doc_id", "lang", "text", "mark").mapInArrow(vectors, "doc_id bigint, lang string, mark double, at binary, n binary")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("mark", "doc_id", "at", "n"))
    rows = stored(drawn.withColumn("r", rank).where(F.col("r") <= each).drop("r"), "langid-sample")  # at most `most` rows, if there are as few languages
    got = in_one_task(rows, partial(_train, idf, dims), "names array<string>, temperature double, w binary").toArrow()
    names, temp, w = (got.column(i)[0].as_py() for i in range(3))
    return names, np.frombuffer(w, np.float64).reshape(dims, len(names)), idf, temp


def _train(idf: np.ndarray, dims: int, s: pa.Table) -> pa.RecordBatch:
    """The languages, the temperature and the weights; s: the sample."""
    s = s.sort_by([("doc_id", "ascending"), ("lang", "ascending"), ("at", "ascending"), ("n", "ascending")])
    names = sorted(set(s.column("lang").to_pylist()))
    rows = []
    for at, n in zip(s.column("at"), s.column("n"), strict=True):
        a, c = np.frombuffer(at.as_buffer(), np.int32), np.frombuffer(n.as_buffer(), np.int32)
        rows.append((a, weighed(a, c, idf).astype(np.float32)))
    y = np.array([names.index(x) for x in s.column("lang").to_pylist()], np.int64)
    held = np.array([zlib.crc32(f"calibrate:{i}".encode()) % 5 == 0 for i in s.column("doc_id").to_pylist()], bool)
    if held.all() or not len(rows):
        held[:] = False
    w = Ftrl(dims, len(names)).fit([r for r, h in zip(rows, held, strict=True) if not h], np.eye(len(names))[y[~held]])
    logits = np.array([x @ w[a] for (a, x), h in zip(rows, held, strict=True) if h]).reshape(-1, len(names))
    return pa.RecordBatch.from_arrays([pa.array([names], pa.list_(pa.string())), pa.array([temperature(logits, y[held])]), pa.array([np.ascontiguousarray(w, np.float64).tobytes()], pa.binary())], names=["names", "temperature", "w"])


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE, most: int = SAMPLE, log2_dims: int = LOG2_DIMS) -> DataFrame:
    """For each row of docs: doc_id, held_out (its fold is 1), lang_pred (a learned language, or UNKNOWN) and score (0 to 1).

    Learns only from text and non-null lang of rows whose fold is 0 or 2. Texts that are null or have no letter are UNKNOWN with
    score 0, as is every text if nothing can be learned. Rows without doc_id are not held out and not learned from. Repeated rows
    are scored each. Empty table: no rows. Other columns are not read.
    """
    spark = ship(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = spark.sparkContext.broadcast(fit(d.where(fold() != 1), per_language, most, log2_dims))

    def run(batches):
        m = model.value
        for batch in batches:
            for b in _text.blocks(batch):
                pred, score = [], []
                for t in b.column(2).to_pylist():
                    if m is None or not t or not has_letter(t):
                        pred.append(UNKNOWN), score.append(0.0)
                        continue
                    names, w, idf, temp = m
                    at, n = features(t, log2_dims)
                    p = softmax(weighed(at, n, idf) @ w[at] / temp)
                    best = int(p.argmax())
                    pred.append(names[best]), score.append(float(p[best]))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return d.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "text").mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")
