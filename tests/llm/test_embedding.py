import numpy as np
import pytest

from pathloom.llm import embedding


def brute(rows):
    def ok(v, label):
        return label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)

    n = len(rows)
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if ok(v, y) else None for _, v, y in rows]
    link = [[i != j and unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= embedding.COSINE for j in range(n)] for i in range(n)]
    comp = [r[0] for r in rows]
    for _ in range(n):
        new = [min([comp[i], *[comp[j] for j in range(n) if link[i][j]]]) for i in range(n)]
        if new == comp:
            break
        comp = new
    return sorted((rows[i][0], sum(link[i]), comp[i], comp[i] == rows[i][0]) for i in range(n))


@pytest.mark.parametrize(("block", "leaf", "pivots"), [(5, 256, 8), (40, 3, 2), (3000, 10, 8)])
def test_against_brute_force(spark, monkeypatch, block, leaf, pivots):
    for name, value in (("BLOCK", block), ("LEAF", leaf), ("PIVOTS", pivots)):
        monkeypatch.setattr(embedding, name, value)
    rng = np.random.default_rng(block)
    centres = rng.normal(size=(6, 8))
    rows = []
    for i in range(220):
        c = centres[rng.integers(6)]
        rows.append((i, [float(np.float32(x)) for x in c + rng.normal(size=8) * rng.choice([0.05, 0.2, 0.5])], int(rng.integers(2))))
    rows += [(300 + i, [1.0] * 8, 0) for i in range(30)] + [(400, None, 0), (401, [0.0] * 8, 0), (402, [1.0, None] * 4, 0), (403, [float("nan")] * 8, 1), (404, [1.0] * 8, None), (405, [], 1), (406, [float("inf")] + [1.0] * 7, 0), (407, [1.0] * 4, 0), (408, [2.0] * 4, 0), (411, [1.0, 1.0, 1.0, 1.01], 0), (412, [-1.0, 1.0, 1.0, 1.01], 0), (409, [-0.0, 1.0] * 4, 1), (410, [0.0, 1.0] * 4, 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, n string")
    got = sorted(tuple(r) for r in embedding.near_vectors(df).collect())
    assert got == brute(rows)


def test_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (None, [1.0, 0.0], 1)], "vec_id long, embedding array<double>, label int")
    got = sorted([(r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding.near_vectors(df).collect()], key=repr)
    assert got == sorted([(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (None, 3, None, True)], key=repr)
    assert embedding.near_vectors(df.limit(0)).count() == 0


def test_cells_of_several_rounds(spark, monkeypatch):
    """Clusters along a curve, so that balls have neighbours across their borders: replicas in every round, no link lost or doubled."""
    for name, value in (("LEAF", 8), ("PIVOTS", 3), ("SAMPLE", 40), ("GAIN", 0.0)):
        monkeypatch.setattr(embedding, name, value)
    rng = np.random.default_rng(3)
    turn = rng.uniform(0, 6.28, 300)
    points = np.stack([np.cos(turn), np.sin(turn), 0.3 * np.cos(3 * turn)], 1) + rng.normal(size=(300, 3)) * 0.05
    rows = [(i, [float(x) for x in p], i % 2) for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    placed = embedding.cells(embedding.classes_of(df)[1])
    masks = {r["mask"] for r in placed.select("mask").distinct().collect()}
    done = embedding.work(placed)
    assert max(masks) >= 2 and done["cells"] > 12 and done["rows"] > 300
    assert sorted(tuple(r) for r in embedding.near_vectors(df).collect()) == brute(rows)


def test_clusters_are_kept_apart_from_the_rest(spark):
    """Tight clusters among scattered vectors: what the triangle inequality excludes is never compared."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(4, 32))
    rows = [(i, [float(x) for x in centres[i % 4] + rng.normal(size=32) * 0.02], 0) for i in range(200)] + [(1000 + i, [float(x) for x in rng.normal(size=32)], 0) for i in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    done = embedding.work(embedding.cells(embedding.classes_of(df)[1]))
    assert done["cells"] >= 5 and done["pairs"] < 0.3 * 300 * 299 / 2 and done["rows"] < 330
    assert sorted(tuple(r) for r in embedding.near_vectors(df).collect()) == brute(rows)


def test_ids_of_any_type(spark):
    df = spark.createDataFrame([("b", [1.0, 0.0], "x"), ("a", [1.0, 0.01], "x"), ("c", [0.0, 1.0], "x")], "vec_id string, embedding array<double>, label string")
    assert sorted(tuple(r) for r in embedding.near_vectors(df).collect()) == [("a", 1, "a", True), ("b", 1, "a", False), ("c", 0, "c", True)]
