"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of order 1 to 3 are hashed into 2**BITS bins. Document frequencies are counted over all
training rows; weights are learnt with follow-the-regularised-leader (per-coordinate steps, L1 and
L2 penalties) on a sample of TRAIN_ROWS training rows, the first by a hash of their id and, where an id
repeats, of their text; a fifth of the sample sets the temperature that calibrates the probabilities.

A null text or one without a letter is ``und`` with score 1. A null id counts as the empty text in
the hold-out rule. Repeated rows are scored alike; without any training row everything is ``und``
with score 0. Whole texts are read, however long; columns of other names pass through ``identify``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.llm import charfeat
from pathloom.llm.common import arrow_rows, by_place, id_crc, slices, texts

BITS = 15
ORDERS = (1, 2, 3)
#: Rows the weights are fitted on at most.
TRAIN_ROWS = 4000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 1.0, 0.1, 0.02, 0.02


def bins(text: str, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash bins of a text and 1 + log of their counts; both empty if it has no letter."""
    x = charfeat.letters(text, table)
    if x.size < 2:
        return np.zeros(0, np.int64), np.zeros(0)
    counts = np.bincount(charfeat.hashed(x, ORDERS, BITS), minlength=1 << BITS)
    at = np.flatnonzero(counts)
    return at, 1.0 + np.log(counts[at])


def document_frequencies(train: DataFrame) -> tuple[np.ndarray, int]:
    """Over all rows: in how many texts each bin occurs, and the number of texts. One row per bin reaches the driver."""

    def count(batches):
        table, df, n = charfeat.letter_table(), np.zeros(1 << BITS, np.int64), 0
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                df[bins(text, table)[0]] += 1
                n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), -1], pa.int32()), pa.array([*df[at].tolist(), n], pa.int64())], ["bin", "n"])

    rows = train.select("text").mapInArrow(count, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    df, total = np.zeros(1 << BITS, np.int64), 0
    for b, n in rows:
        if b < 0:
            total = n
        else:
            df[b] = n
    return df, total


def ftrl(samples: list[tuple[np.ndarray, np.ndarray, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights (bins x k) and bias of k classes from (bins, values, class) rows."""
    z, n = np.zeros(((1 << BITS) + 1, k)), np.zeros(((1 << BITS) + 1, k))

    def weights(at):
        zs, ns = z[at], n[at]
        w = -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(ns)) / ALPHA + L2)
        w[np.abs(zs) <= L1] = 0
        return w

    order = np.random.default_rng(5)
    for _ in range(EPOCHS):
        for i in order.permutation(len(samples)):
            at, v, y = samples[i]
            at, v = np.append(at, 1 << BITS), np.append(v, 1.0)
            w = weights(at)
            p = np.exp((s := v @ w) - s.max())
            p /= p.sum()
            p[y] -= 1
            g = np.outer(v, p)
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange((1 << BITS) + 1))
    return w[:-1].astype(np.float32), w[-1].astype(np.float32)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits under which the held labels are likeliest."""

    def loss(t):
        s = logits / t
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]).mean())

    return min(np.exp(np.linspace(np.log(0.05), np.log(20), 61)), key=loss)


def sampled(train: DataFrame, id_col: str) -> DataFrame:
    """The TRAIN_ROWS rows that come first by hash. The ids are fixed first (narrow rows), so only the sample's texts are featurised."""
    h = F.xxhash64(F.lit(3), id_col, "lang")
    first = train.select(h.alias("h_"), F.col(id_col).alias("i_")).orderBy("h_", "i_").limit(TRAIN_ROWS)
    upto = train.where(h <= first.agg(F.max("h_")).first()[0])
    if upto.count() <= TRAIN_ROWS:
        return upto
    # Rows of one id and language share their hash: they are told apart by their texts', whatever the length.
    key = F.struct(h.alias("h_"), F.xxhash64(F.lit(3), "text").alias("g_"))
    keys = upto.select(key.alias("k_")).orderBy("k_").limit(TRAIN_ROWS)
    edge, n = keys.groupBy("k_").agg(F.count("*").alias("n_")).agg(F.max(F.struct("k_", "n_"))).first()[0]
    at = F.struct(F.lit(edge["h_"]).alias("h_"), F.lit(edge["g_"]).alias("g_"))
    return upto.where(key < at).unionByName(upto.where(key == at).limit(n))


def fit(train: DataFrame, id_col: str = "doc_id") -> dict | None:
    """A model from rows with id, text and lang; none without rows."""
    with arrow_rows(train.sparkSession, 1000):
        return _fit(train, id_col)


def _fit(train: DataFrame, id_col: str) -> dict | None:
    train = train.where("text is not null and lang is not null")
    df, total = document_frequencies(train)
    if not total:
        return None
    idf = np.log((1.0 + total) / (1.0 + df)) + 1.0
    sample = sampled(train, id_col).select("text", "lang")

    def featurise(batches):
        table = charfeat.letter_table()
        for batch in slices(batches):
            got = [bins(t, table) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.list_(pa.int32())), pa.array([g[1] for g in got], pa.list_(pa.float32())), batch.column(1)], ["at", "tf", "lang"])

    got = sample.mapInArrow(featurise, "at array<int>, tf array<float>, lang string").toArrow().combine_chunks()
    tags = got.column("lang").to_pylist()
    langs = sorted(set(tags))
    number = {lang: i for i, lang in enumerate(langs)}
    rows = []
    # Numpy views of the Arrow lists: the sample never becomes Python objects.
    for at, tf, lang in zip(got.column("at"), got.column("tf"), tags, strict=True):
        if len(at):
            at = np.asarray(at.values).astype(np.int64)
            v = np.asarray(tf.values) * idf[at]
            rows.append((at, v / np.linalg.norm(v), number[lang]))
    del got
    rows = sorted(rows, key=lambda r: (r[0].size, r[2], float(r[1].sum())))
    held, kept = rows[::5], [r for i, r in enumerate(rows) if i % 5] or rows
    if not rows:
        return None
    w, b = ftrl(kept, len(langs))
    t = temperature(np.array([v @ w[at] + b for at, v, _ in held]), np.array([y for _, _, y in held]))
    return {"langs": langs, "idf": idf.astype(np.float32), "w": w, "b": b, "t": t}


def identify(docs: DataFrame, model: dict | None, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score; columns of these names are replaced."""

    @F.arrow_udf(T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    def named(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = charfeat.letter_table()
        for column in columns:
            langs, scores = [], []
            for text in texts(column):
                at, tf = bins(text, table)
                if at.size == 0 or model is None:
                    langs.append("und")
                    scores.append(0.0 if at.size else 1.0)
                    continue
                v = tf * model["idf"][at]
                s = (v @ model["w"][at] / np.sqrt(v @ v) + model["b"]) / model["t"]
                p = np.exp(s - s.max())
                best = int(p.argmax())
                langs.append(model["langs"][best])
                scores.append(float(p[best] / p.sum()))
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    # One column first, for the text is scored once however often its parts are used.
    given, at = by_place(docs)
    found = given.withColumn("found_", named(F.col(at[text_col])))
    return found.select(*[F.col(a).alias(c) for c, a in at.items() if c not in ("lang_pred", "score")], "found_.lang_pred", "found_.score")


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", "lang").where(F.pmod(id_crc(F.col("doc_id")), F.lit(5)) != 0)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs.select("doc_id", "text"), fit(training_rows(docs)))
    return out.select("doc_id", (F.pmod(id_crc(F.col("doc_id")), F.lit(5)) == 0).alias("held_out"), "lang_pred", "score")
