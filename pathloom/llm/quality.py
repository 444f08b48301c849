"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad. Its features describe its own shape (length, letters, symbols,
repetition, function-word share ...) and that of the lines before and after; the chain's transitions
tie neighbouring labels. Forward-backward gives each line the marginal probability of being good, and
the mean of these weighted by line length, put through a fitted logistic curve, is the document's
score. The field is trained by maximum likelihood on all lines of a bounded sample of labelled documents,
each line carrying its document's label.

Null and empty texts count as one empty line. Repeated rows are scored alike. If training labels lack
a class, every score is the share of class 1 (0.5 without labels). Scoring reads whole texts and
passes other columns through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.llm import labelled
from pathloom.llm.common import arrow_rows, id_crc, release, slices, texts

#: Labelled documents of each class the field is fitted on at most.
PER_CLASS = {0: 1500, 1: 2500}
#: Lines of these documents together at most.
LINES = 150_000
OWN = 17
WIDTH = 3 * OWN + 3
STEPS, RATE, DECAY = 250, 0.05, 1e-3
THRESHOLD = 0.5


def kinds() -> np.ndarray:
    """Of each code point below 65536: 0 symbol, 1 lower-case or caseless letter, 2 capital, 3 digit, 4 space, 5 sentence mark."""
    out = np.zeros(65536, np.uint8)
    for c in range(65536):
        ch = chr(c)
        out[c] = 2 if ch.isupper() else 1 if ch.isalpha() else 3 if ch.isdigit() else 4 if ch.isspace() else 5 if ch in ".,;:!?'\"()-" else 0
    return out


def own_features(text: str, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of shape features for each line, and the lines' lengths plus one."""
    lines = text.split("\n")
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    k = kind[np.where(codes < 65536, codes, 0x4E00)]
    length = np.array([len(x) for x in lines])
    ends = np.cumsum(length + 1)
    per = []
    for what in range(6):
        upto = np.concatenate(([0], np.cumsum(k == what)))
        per.append(upto[np.minimum(ends - 1, codes.size)] - upto[np.minimum(ends - 1 - length, codes.size)])
    symbol, low, cap, digit, space, mark = per
    out = np.zeros((len(lines), OWN))
    some = np.maximum(length, 1)
    out[:, 0] = np.log1p(length)
    for at, x in enumerate((symbol, low, cap, digit, space, mark)):
        out[:, 2 + at] = x / some
    seen: set[str] = set()
    for i, line in enumerate(lines):
        words = line.split()
        n = len(words)
        row = out[i]
        row[1] = math.log1p(n)
        if n:
            sizes = list(map(len, words))
            row[8] = sum(sizes) / n / 10
            row[9] = len(set(words)) / n
            row[10] = sum(map(eq, words, words[1:])) / n
            row[11] = sizes.count(1) / n
            row[12] = (sizes.count(2) + sizes.count(3)) / n
            row[13] = math.log1p(max(sizes)) / 3
            last = line.rstrip()[-1:]
            row[14] = last in ".!?"
            row[15] = line[:1].isupper()
            row[16] = line in seen
            seen.add(line)
    return out, length + 1.0


def features(text: str, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """own_features with those of both neighbours, whether there are such, and a constant."""
    own, weight = own_features(text, kind)
    n = len(own)
    x = np.zeros((n, WIDTH))
    x[:, :OWN] = own
    x[1:, OWN : 2 * OWN] = own[:-1]
    x[:-1, 2 * OWN : 3 * OWN] = own[1:]
    x[0, 3 * OWN] = x[-1, 3 * OWN + 1] = x[:, 3 * OWN + 2] = 1
    return x, weight


def marginals(odds: np.ndarray, trans: np.ndarray) -> list[float]:
    """P(good) of each line by forward-backward; odds: log odds of good by the features alone, trans: 2 x 2 log potentials."""
    (t00, t01), (t10, t11) = np.exp(trans).tolist()
    e = np.exp(np.clip(odds, -30, 30)).tolist()
    forward, a = [], 0.5
    for i, v in enumerate(e):
        good, bad = (a * t11 + (1 - a) * t01) * v if i else v, a * t10 + (1 - a) * t00 if i else 1.0
        a = good / (good + bad)
        forward.append(a)
    out, b = [0.0] * len(e), 0.5
    for i in range(len(e) - 1, -1, -1):
        good, bad = forward[i] * b, (1 - forward[i]) * (1 - b)
        out[i] = good / (good + bad) if good + bad > 0 else forward[i]
        v = e[i]
        from_good, from_bad = t11 * v * b + t10 * (1 - b), t01 * v * b + t00 * (1 - b)
        b = from_good / (from_good + from_bad)
    return out


def train(x: Sequence[np.ndarray], y: np.ndarray, mask: Sequence[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions by Adam on the mean conditional log likelihood; x: of each chain lines x features, y: chains' labels.

    A mask tells the lines of padded chains. Messages are kept as probabilities of the good label, normalised at every
    line, for all chains at once: the longest chain comes first, so the i-th lines of those that have one are a block,
    and nothing is padded however long one chain is.
    """
    chains = x if mask is None else [c[k] for c, k in zip(x, mask, strict=True)]
    size = np.array([len(c) for c in chains])
    order = np.argsort(-size, kind="stable")
    size, y, d = size[order], np.asarray(y)[order], chains[0].shape[1]
    t, lines = int(size[0]), int(size.sum())
    live = np.searchsorted(-size, -np.arange(t), "left")
    start = np.concatenate(([0], np.cumsum(live)))
    flat, label = np.empty((lines, d), np.float32), np.empty(lines)
    for r, c in enumerate(order):
        at = start[: size[r]] + r
        flat[at], label[at] = chains[c], y[r]
    blocks = [slice(start[i], start[i + 1]) for i in range(t)]
    # Each line after the first of its chain, and the line before it.
    right = np.arange(live[0], lines)
    left = right - np.repeat(live[:-1], live[1:])
    w, trans = np.zeros(d), np.zeros((2, 2))
    m, v = np.zeros(d + 4), np.zeros(d + 4)
    for step in range(1, STEPS + 1):
        e = np.exp(np.clip((flat @ w.astype(np.float32)).astype(np.float64), -30, 30))
        (t00, t01), (t10, t11) = np.exp(trans)
        ahead, back = np.full(lines, 0.5), np.full(lines, 0.5)
        ahead[blocks[0]] = e[blocks[0]] / (e[blocks[0]] + 1)
        for i in range(1, t):
            a = ahead[start[i - 1] : start[i - 1] + live[i]]
            good, bad = (a * t11 + (1 - a) * t01) * e[blocks[i]], a * t10 + (1 - a) * t00
            ahead[blocks[i]] = good / (good + bad)
        for i in range(t - 2, -1, -1):
            b = back[blocks[i + 1]]
            good, bad = e[blocks[i + 1]] * b, 1 - b
            from_good, from_bad = t11 * good + t10 * bad, t01 * good + t00 * bad
            back[start[i] : start[i] + live[i + 1]] = from_good / (from_good + from_bad)
        good, bad = ahead * back, (1 - ahead) * (1 - back)
        p_good = good / (good + bad)
        g_w = flat.T @ (label - p_good).astype(np.float32) / lines - DECAY * w
        # Joint probabilities of neighbouring labels.
        a, good, bad = ahead[left], e[right] * back[right], 1 - back[right]
        joint = [[(1 - a) * t00 * bad, (1 - a) * t01 * good], [a * t10 * bad, a * t11 * good]]
        total = joint[0][0] + joint[0][1] + joint[1][0] + joint[1][1]
        g_t = np.array([[(((label[right] == i) & (i == j)) - joint[i][j] / total).sum() / lines for j in (0, 1)] for i in (0, 1)]) - DECAY * trans
        g = np.append(g_w, g_t.ravel())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, trans = w + move[:d], trans + move[d:].reshape(2, 2)
    return w, trans


def whole(x: np.ndarray, weight: np.ndarray, w: np.ndarray, trans: np.ndarray) -> float:
    """Log odds of a document: of its lines' marginals, weighted by length."""
    q = float(np.dot(marginals(x @ w, trans), weight) / weight.sum())
    q = min(max(q, 1e-6), 1 - 1e-6)
    return math.log(q / (1 - q))


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1) -> dict:
    with arrow_rows(docs.sparkSession, 1000):
        return _fit(docs, labels, modulus, held)


def _fit(docs: DataFrame, labels: DataFrame, modulus: int, held: int) -> dict:
    sample, prior = labelled.sample(docs, labels, "quality", modulus, held, PER_CLASS, 29)
    sample = labelled.within(sample, F.size(F.split("text", "\\n")), LINES)
    rows = {0: 0, 1: 0} | dict(sample.groupBy("y").count().collect())
    if not rows[0] or not rows[1]:
        return {"constant": prior[1] / (prior[0] + prior[1]) if sum(prior.values()) else 0.5}

    def featurise(batches):
        kind = kinds()
        for batch in slices(batches):
            got = [features(t, kind) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([g[0].ravel() for g in got], pa.list_(pa.float32())), pa.array([g[1] for g in got], pa.list_(pa.float32())), batch.column(1)], ["x", "weight", "y"])

    got = sample.select("text", "y").mapInArrow(featurise, "x array<float>, weight array<float>, y int").toArrow().combine_chunks()
    chains = [(np.asarray(x.values, np.float64).reshape(-1, WIDTH), np.asarray(k.values, np.float64)) for x, k in zip(got.column("x"), got.column("weight"), strict=True)]
    y = np.asarray(got.column("y"), np.float64)
    order = np.lexsort(([float(c[0].sum()) for c in chains], [len(c[1]) for c in chains], y))
    chains, y = [chains[i] for i in order], y[order]
    every = np.vstack([c[0] for c in chains])
    mean, scale = every.mean(0), every.std(0)
    scale[scale < 1e-6] = 1
    mean[-1] = 0
    w, trans = train([((c - mean) / scale).astype(np.float32) for c, _ in chains], y)
    raw = np.array([whole((c - mean) / scale, k, w, trans) for c, k in chains])
    # Logistic curve from marginals to the probability of class 1, at the classes' shares of all training labels.
    share = np.where(y == 1, prior[1] / rows[1], prior[0] / rows[0])
    share /= share.sum()
    a, b = 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * raw + b, -35, 35)))
        r, h = share * (p - y), share * p * (1 - p) + 1e-9
        hess = np.array([[h @ (raw * raw) + 1e-6, h @ raw], [h @ raw, h.sum() + 1e-6]])
        step = np.linalg.solve(hess, [r @ raw + 1e-6 * (a - 1), r.sum()])
        step *= min(1.0, 1 / max(1e-12, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
    release(sample)
    return {"mean": mean, "scale": scale, "w": w, "trans": trans, "a": max(a, 1e-3), "b": b}


def score(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """docs with score, the probability of good quality; a column of this name is replaced."""

    @F.arrow_udf(T.DoubleType())
    def good(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = kinds()
        if "w" in model:
            w = model["w"] / model["scale"]
            w[-1] -= model["mean"] @ w
        for column in columns:
            out = []
            for text in texts(column):
                if "constant" in model:
                    out.append(model["constant"])
                    continue
                x, weight = features(text, kind)
                out.append(1 / (1 + math.exp(-min(max(model["a"] * whole(x, weight, w, model["trans"]) + model["b"], -35), 35))))
            yield pa.array(out, pa.float64())

    return docs.withColumn("score", good(F.col(f"`{text_col}`")))


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = score(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", (F.pmod(id_crc(F.col("doc_id")), F.lit(3)) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
