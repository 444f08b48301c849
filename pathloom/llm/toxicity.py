"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Whole texts become sets of hashed n-grams (order 3 to 5). On a bounded labelled sample the ratio of smoothed class
frequencies gives each n-gram its log-count ratio: SMOOTH documents without any finding, at the classes' shares, are
added, so what few documents hold says little of either class. A text's vector holds the ratios of its n-grams,
scaled to length one. All n-grams take part: a logistic regression learns their weights by
follow-the-regularised-leader with an elastic-net penalty. A second one, learnt without a fifth of the sample,
is held against that fifth to fit the logistic curve that turns margins into probabilities, at the classes'
shares of all training labels.

Null and empty texts are scored by the intercept. Repeated rows are scored alike. If training labels lack a class,
every score is the share of class 1 (0 without labels). Columns of other names pass through ``score``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.llm import charfeat, labelled
from pathloom.llm.common import arrow_rows, id_crc, release, slices, texts

BITS = 20
ORDERS = (3, 4, 5)
#: Labelled rows of each class the model is fitted on at most; the driver holds their sets of n-grams.
PER_CLASS = {1: 2000, 0: 4000}
#: Characters of these documents together at most.
CHARACTERS = 40_000_000
SMOOTH = 50.0
EPOCHS = 5
ALPHA, BETA, L1, L2 = 30.0, 0.1, 0.1, 0.1
THRESHOLD = 0.3


class Grams:
    """Bins that occur in a text, each once, in ascending order."""

    def __init__(self):
        self.table = charfeat.letter_table()

    def every(self, text: str) -> np.ndarray:
        """The bin of each n-gram as it comes."""
        return charfeat.hashed(charfeat.letters(text, self.table), ORDERS, BITS)

    def __call__(self, text: str) -> np.ndarray:
        return np.unique(self.every(text))


def ratios(sets: list[np.ndarray], y: np.ndarray, size: int) -> np.ndarray:
    """Log-count ratio of each of size n-grams over sets of them; 0 for what no set holds."""
    counts = [np.zeros(size), np.zeros(size)]
    for s, label in zip(sets, y.tolist(), strict=True):
        counts[label][s] += 1
    n = [float((y == label).sum()) for label in (0, 1)]
    added = [SMOOTH * x / sum(n) for x in n]
    logs = [np.log((c + a) / (x + a)) for c, a, x in zip(counts, added, n, strict=True)]
    return np.where(counts[0] + counts[1] > 0, logs[1] - logs[0], 0.0)


def vector(s: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """Ratios of a set's n-grams, of length one."""
    v = ratio[s]
    return v / np.sqrt(v @ v + 1e-12)


def ftrl(sets: list[np.ndarray], y: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and intercept of the logistic regression, by row in a seeded order; per-coordinate steps."""
    z, n = np.zeros(ratio.size), np.zeros(ratio.size)
    zb = nb = 0.0
    order = np.random.default_rng(5)

    def weights(zs, roots):
        return (np.sign(zs) * L1 - zs) * (np.abs(zs) > L1) / ((BETA + roots) / ALPHA + L2)

    for _ in range(EPOCHS):
        for i in order.permutation(len(sets)).tolist():
            at = sets[i]
            v, ns = vector(at, ratio), n[at]
            roots, rootb = np.sqrt(ns), np.sqrt(nb)
            w, b = weights(z[at], roots), -zb * ALPHA / (BETA + rootb)
            g0 = 1 / (1 + np.exp(-min(max(float(w @ v) + b, -35.0), 35.0))) - y[i]
            g = g0 * v
            ns += g * g
            z[at] += g - (np.sqrt(ns) - roots) / ALPHA * w
            n[at] = ns
            nb += g0 * g0
            zb += g0 - (np.sqrt(nb) - rootb) / ALPHA * b
    return weights(z, np.sqrt(n)), float(-zb * ALPHA / (BETA + np.sqrt(nb)))


def margins(sets: list[np.ndarray], ratio: np.ndarray, w: np.ndarray, b: float) -> np.ndarray:
    return np.array([w[s] @ vector(s, ratio) + b for s in sets])


def curve(raw: np.ndarray, y: np.ndarray, share: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve that fits labels best, rows weighted; slightly held to slope 1, offset 0."""
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * raw + b, -35, 35)))
        r, h = share * (p - y), share * p * (1 - p)
        hess = np.array([[h @ (raw * raw) + 1e-3, h @ raw], [h @ raw, h.sum() + 1e-3]])
        step = np.linalg.solve(hess, [r @ raw + 1e-3 * (a - 1), r.sum() + 1e-3 * b])
        step *= min(1.0, 1 / max(1e-12, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
    return max(a, 1e-3), b


def learn(flat: np.ndarray, sizes: np.ndarray, y: np.ndarray, prior: dict[int, int]) -> dict:
    """A model from sets of bins, one after the other in flat (overwritten: it may be the driver's largest array), their sizes and labels y; prior: numbers of all training labels."""
    seen = np.zeros(1 << BITS, bool)
    seen[flat] = True
    bins = np.flatnonzero(seen)
    place = np.zeros(1 << BITS, np.int32)
    place[bins] = np.arange(bins.size)
    for start in range(0, flat.size, 1 << 20):
        flat[start : start + (1 << 20)] = place[flat[start : start + (1 << 20)]]
    sets = np.split(flat, np.cumsum(sizes)[:-1])
    held = np.arange(len(y)) % 5 == 0
    a, b = 1.0, 0.0
    if len(set(y[held].tolist())) == 2 == len(set(y[~held].tolist())):
        inner, outer = ([s for s, h in zip(sets, held, strict=True) if h == side] for side in (False, True))
        ratio = ratios(inner, y[~held], bins.size)
        share = np.where(y == 1, prior[1] / max(1, (y == 1).sum()), prior[0] / max(1, (y == 0).sum()))
        a, b = curve(margins(outer, ratio, *ftrl(inner, y[~held], ratio)), y[held], share[held] / share.mean())
    ratio = ratios(sets, y, bins.size)
    w, at0 = ftrl(sets, y, ratio)
    return {"bins": bins.astype(np.int32), "ratio": ratio.astype(np.float32), "w": w.astype(np.float32), "a": a, "b": a * at0 + b}


class Scorer:
    """Probabilities of texts under a model."""

    def __init__(self, model: dict):
        self.model, self.grams = model, Grams()
        if "bins" in model:
            self.place = np.full(1 << BITS, -1, np.int32)
            self.place[model["bins"]] = np.arange(model["bins"].size)
            self.seen = np.zeros(model["bins"].size, bool)

    def __call__(self, text: str) -> float:
        model = self.model
        if "constant" in model:
            return model["constant"]
        at = self.place[self.grams.every(text)]
        at = at[at >= 0]
        # The model's n-grams in the text, each once: marks are quicker than sorting long lists.
        self.seen[at] = True
        at = np.flatnonzero(self.seen)
        self.seen[at] = False
        v = model["ratio"][at].astype(np.float64)
        m = model["a"] * float(v @ model["w"][at]) / np.sqrt(v @ v + 1e-12) + model["b"]
        return float(1 / (1 + np.exp(-min(max(m, -35.0), 35.0))))


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2) -> dict:
    with arrow_rows(docs.sparkSession, 1000):
        sample, prior = labelled.sample(docs, labels, "toxic", modulus, held, PER_CLASS, 23)
        sample = labelled.within(sample, F.char_length("text"), CHARACTERS)

        def featurise(batches):
            grams = Grams()
            for batch in slices(batches):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([grams(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int32())), batch.column(2)], ["h", "at", "y"])

        got = sample.select("h", "text", "y").mapInArrow(featurise, "h long, at array<int>, y int").toArrow()
    release(sample)
    # In the order of the hashes by which the rows were drawn, so that runs agree.
    order = np.argsort(np.asarray(got.column("h")), kind="stable")
    y = np.asarray(got.column("y"))[order]
    if len(set(y.tolist())) < 2:
        return {"constant": prior[1] / max(1, prior[0] + prior[1])}
    lists = [x for c in got.column("at").chunks for x in np.split(np.asarray(c.flatten()), np.cumsum(np.diff(np.asarray(c.offsets)))[:-1])]
    lists = [lists[i] for i in order]
    flat, sizes = np.concatenate(lists), np.array([x.size for x in lists])
    del lists, got
    pa.default_memory_pool().release_unused()
    return learn(flat, sizes, y, prior)


def score(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """docs with score, the probability that the text is toxic; a column of this name is replaced."""

    @F.arrow_udf(T.DoubleType())
    def toxic(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(model)
        for column in columns:
            yield pa.array([scorer(t) for t in texts(column)], pa.float64())

    return docs.withColumn("score", toxic(F.col(f"`{text_col}`")))


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = score(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", (F.pmod(id_crc(F.col("doc_id")), F.lit(4)) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
