import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.llm import negatives


def brute(rows, step=10, n_pos=5, n_neg=3):
    kept = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    first = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for a, (i, q, y) in enumerate(kept):
        if i is None or i % step:
            continue
        scored = [(sum(s * t for s, t in zip(q, p, strict=True)), j, z == y) for b, (j, p, z) in enumerate(kept) if b != a and len(p) == len(q)]
        for ps, pid, _ in sorted([r for r in scored if r[2]], key=first)[:n_pos]:
            window = [r for r in scored if not r[2] and 50 * ps <= 100 * r[0] <= 95 * ps]
            out += [(i, pid, n, nid, ps, ns) for n, (ns, nid, _) in enumerate(sorted(window, key=first)[:n_neg], 1)]
    return sorted(out, key=repr)


def odd(dims):
    return [(500, None, 1), (501, [0.1] * dims, None), (502, [0.1, None] + [0.0] * (dims - 2), 1), (503, [float("nan")] + [0.0] * (dims - 1), 1), (504, [float("inf")] + [0.0] * (dims - 1), 1), (505, [], 1), (510, [], 1), (515, [], 0), (520, [0.5] * (dims + 1), 0), (521, [0.4] * (dims + 1), 0), (522, [0.3] * (dims + 1), 1), (530, [0.0] * dims, 1)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, list string, score int")


@pytest.mark.parametrize(("block", "anchors", "steps", "sample"), [(4096, 1024, (4, 16, 64, 256), 16384), (7, 3, (1, 2, 5), 40)])
def test_against_brute_force(spark, monkeypatch, block, anchors, steps, sample):
    for name, value in (("BLOCK", block), ("ANCHORS", anchors), ("STEPS", steps), ("SAMPLE", sample)):
        monkeypatch.setattr(negatives, name, value)
    rng = np.random.default_rng(block)
    centres = rng.normal(size=(5, 6))
    rows = [(i, [float(x) for x in np.round(centres[rng.integers(5)] + rng.normal(size=6) * rng.choice([0.1, 0.6]), 2)], int(rng.integers(3))) for i in range(260)]
    # Copies with one label and with several, ids given twice, a null id.
    rows += [(300 + i, [1.0, 0.5, 0.25, 0.0, 0.0, 1.0], i % 2) for i in range(40)] + [rows[10], (20, rows[30][1], rows[20][2]), (20, rows[20][1], rows[20][2]), (None, rows[0][1], rows[0][2]), (None, rows[0][1], 9)]
    rows += odd(6)
    got = negatives.mine(frame(spark, rows), F.col("vec_id") % 10 == 0)
    want = brute(rows)
    assert len(want) > 200
    assert sorted(map(tuple, got.collect()), key=repr) == want


def test_lists_are_skipped_and_left_early(spark, monkeypatch):
    """Tight clusters far apart: bounds leave most lists unvisited, and the result is complete all the same."""
    visited = []
    whole = negatives.visits

    def counted(state, centroids, radii, start, stop):
        out = whole(state, centroids, radii, start, stop)
        visited.append((state.count(), len(radii), out.count()))
        return out

    monkeypatch.setattr(negatives, "visits", counted)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16)) * 3
    rows = [(i, [float(x) for x in centres[i % 20] + rng.normal(size=16) * 0.02], i % 3) for i in range(400)]
    got = sorted(map(tuple, negatives.mine(frame(spark, rows), F.col("vec_id") % 10 == 0).collect()), key=repr)
    assert got == brute(rows)
    every = sum(n * k for n, k, _ in visited if n) / len(visited) * 2
    assert sum(v for _, _, v in visited) < 0.5 * every


def test_scores_beyond_doubles_are_exact(spark):
    rows = [(0, [3e5, 1.0, 7.0], 1), (1, [3e5, 2.0, 7.0], 1), (2, [3e5, 3.0, 7.5], 1), (3, [2.5e5, 1.0, 0.0], 2), (4, [2.5e5, 1.0, 0.25], 2), (5, [2.5e5, 1.0, 0.5], 2), (6, [2.5e5, 1.0, 0.75], 2), (7, [1e300, 0.0, 0.0], 2)]
    got = sorted(map(tuple, negatives.mine(frame(spark, rows), F.col("vec_id") == 0).collect()), key=repr)
    assert got == brute(rows[:-1])
    assert max(r[4] for r in got) > 1 << 52


def test_empty_and_lonely(spark):
    df = frame(spark, [(0, [1.0, 0.0], 1)])
    assert negatives.mine(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert negatives.mine(df, F.col("vec_id") % 10 == 0).count() == 0
    assert negatives.mine(df, F.lit(False)).count() == 0
    assert negatives.mine(frame(spark, [(0, [], 1), (1, [], 1), (2, [], 2)]), F.col("vec_id") == 0).count() == 1
