import hashlib
import math
import random

from pathloom.llm import lloyd


def brute(rows, clusters=16, rounds=3, dims=64, scale=64):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    salted = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centres = [q for _, q in sorted(kept, key=salted)[:clusters]]
    far = lambda q, c: sum((a - b) ** 2 for a, b in zip(q, c, strict=True))
    near = lambda q: min((far(q, c), k) for k, c in enumerate(centres))
    for _ in range(rounds):
        at = [near(q)[1] for _, q in kept]
        centres = [[sum(col) // at.count(k) for col in zip(*[q for (_, q), a in zip(kept, at, strict=True) if a == k], strict=True)] if k in at else c for k, c in enumerate(centres)]
    placed = [(i, *near(q)[::-1]) for i, q in kept]
    own = {k: sum(d for _, c, d in placed if c == k) for k in range(len(centres))}
    text = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, c, d, own[c], sum(own.values()), text[c]) for i, c, d in placed), key=repr)


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, [round(rng.gauss(rng.randrange(3), 0.7), 3) for _ in range(64)]) for i in range(120)]
    rows += [(200 + i, [0.5] * 64) for i in range(40)] + [rows[0], (None, rows[3][1]), (0, [1.25] * 64), (1 << 60, [-0.01] * 64)]
    rows += [(300, None), (301, []), (302, [0.1] * 63), (303, [0.1] * 63 + [None]), (304, [0.1] * 63 + [float("nan")]), (305, [float("-inf")] + [0.1] * 63)]
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], "vec_id long, embedding array<double>, cluster string, at int")
    got = lloyd.cluster(df).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)
    assert sorted(map(tuple, lloyd.cluster(df.repartition(7)).collect()), key=repr) == brute(rows)


def test_few_vectors_ids_of_any_type_and_empty(spark):
    df = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [0.0, -1.3])], "vec_id string, embedding array<float>")
    got = {r.vec_id: r for r in lloyd.cluster(df, dims=2).collect()}
    assert {r.distance for r in got.values()} == {0} and {r.cluster for r in got.values()} == {0, 1}
    assert lloyd.cluster(df.limit(0), dims=2).count() == 0 and lloyd.cluster(df).count() == 0


def test_huge_components_leave_and_large_sums_are_exact(spark):
    df = spark.createDataFrame([(1, [2.0**21] * 64), (2, [-(2.0**21)] * 64), (3, [1e300] * 64), (4, [2.0**21] * 64)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in lloyd.cluster(df, clusters=1, rounds=1).collect()}
    # Three vectors of 64 components each: the mean is a third of the component, rounded down.
    mean = (1 << 27) // 3
    want = {1: 64 * ((1 << 27) - mean) ** 2, 2: 64 * ((1 << 27) + mean) ** 2, 4: 64 * ((1 << 27) - mean) ** 2}
    assert {i: r.distance for i, r in got.items()} == want
    whole = sum(want.values())
    assert {r.inertia for r in got.values()} == {whole if whole < 1 << 63 else None}
