import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.functions import confidence_level, context_valid, first_label, is_before, list_literal
from pathloom.operators import decision_set, metrics, mining, paths, rules, samples, thresholds
from pathloom.operators.graph import Graph, edge_type_index, filtered, without_combinations

from pathloom.sources.stages import written


def graph_of(spark, edges, types):
    nodes = spark.createDataFrame([(i, t, i, 1.0) for i, t in types.items()], "id string, node_type string, name string, orient double")
    rows = [(k, *e) for k, e in enumerate(edges)]
    return Graph(nodes, spark.createDataFrame(rows, "edge_id long, src string, dst string, label string, score double, ctx array<string>"))


def walk(edges, types, a, b, cutoff):
    """Independent depth-first search."""
    near = {}
    for s, d, l, score, ctx in edges:
        near.setdefault(s, []).append((d, l, score, ctx))
        near.setdefault(d, []).append((s, l, score, ctx))
    out = {}

    def go(n, seen, labels, scores, lists):
        if n == b:
            held = [set(x) for x in lists if x is not None]
            if len(held) <= 1 or set.intersection(*held):
                key = (tuple(labels), tuple(seen[1:-1]))
                out[key] = max(out.get(key, 0), math.exp(sum(map(math.log, scores)) / len(scores)))
            return
        if len(labels) < cutoff:
            for d, l, score, ctx in near.get(n, []):
                if d not in seen and score > 0 and types[d] != "X":
                    go(d, [*seen, d], [*labels, l], [*scores, score], [*lists, ctx])

    go(a, [a], [], [], [])
    return out


@pytest.mark.parametrize(("seed", "heavy_above"), [(0, 100), (1, 8), (2, 6), (0, 7), (1, 0)])
def test_paths_against_search(spark, seed, heavy_above):
    """Without heavy nodes, with some and with all nodes heavy."""
    rng = random.Random(seed)
    ids = [f"n{i}" for i in range(8)]
    types = {i: "G" if k < 3 else rng.choice("GPPX") for k, i in enumerate(ids)}
    edges = [(*rng.sample(ids, 2), rng.choice("xy"), rng.choice([0.0, 0.3, 0.5, 0.9]), rng.choice([None, None, None, ["u"], ["v"], ["u", "v"], []])) for _ in range(30)]
    g = graph_of(spark, edges, types)
    pairs = spark.createDataFrame([("0", "n0", "n1"), ("1", "n2", "n1"), ("2", "n0", "zz")], "pair_id string, a string, b string")
    for cutoff in (1, 2, 3, 4) if heavy_above == 8 else (3, 4):
        got = {}
        for r in paths.enumerate_paths(pairs, g.adjacency, cutoff, ["X"], heavy_above).collect():
            got.setdefault(r.pair_id, {})[tuple(r.edges), tuple(r.nodes)] = r.score
        for pair, a, b in (("0", "n0", "n1"), ("1", "n2", "n1")):
            want = walk(edges, types, a, b, cutoff)
            assert got.get(pair, {}).keys() == want.keys() and all(abs(got[pair][k] - v) < 1e-9 for k, v in want.items())
        assert "2" not in got
    summary = {r.pair_id: r.n_paths for r in paths.pair_summary(pairs, paths.enumerate_paths(pairs, g.adjacency, 3, ["X"])).collect()}
    assert summary["2"] == 0 and len(summary) == 3


def test_functions(spark):
    nan = float("nan")
    rows = [(1.0, "b", 2.0, "a", True), (2.0, "a", 1.0, "b", False), (nan, "a", 1.0, "b", True), (1.0, "b", nan, "a", False), (1.0, "a", 1.0, "b", True), (None, "b", 1.0, "a", False)]
    df = spark.createDataFrame(rows, "v double, i string, w double, j string, want boolean")
    assert df.where(is_before(F.col("v"), F.col("i"), F.col("w"), F.col("j")) != F.col("want")).count() == 0
    ev = spark.createDataFrame([(0, 0, 5, 0), (1, 0, 0, 1), (0, 1, 1, 1), (0, 1, 0, 0), (2, 0, 0, 2), (0, 2, 0, 3), (3, 0, 0, 3), (None, None, None, 0)], "a int, b int, c int, want int")
    assert ev.where(confidence_level(F.col("a"), F.col("b"), F.col("c")) != F.col("want")).count() == 0
    one = spark.range(1).select(first_label(F.lit(":Gene:X")).alias("l"), list_literal(F.lit("['a', 'b']")).alias("x"), context_valid(F.lit(1), F.array().cast("array<string>")).alias("v")).first()
    assert (one.l, one.x, one.v) == ("Gene", ["a", "b"], True)


def test_filters(spark):
    g = graph_of(spark, [("o", "g", "involves", 1.0, None), ("g", "h", "binds", 1.0, None)], {"o": "OligogenicCombination", "g": "Gene", "h": "Gene"})
    assert [r.label for r in without_combinations(g).edges.collect()] == ["binds"]
    assert [r.label for r in filtered(g, "bind").edges.collect()] == ["binds"]
    assert [(r.edge_type_idx, r.label) for r in edge_type_index(g).collect()] == [(0, "binds"), (1, "involves")]


def test_samples(spark):
    pairs = spark.createDataFrame([("a", "b", 9, 3), ("b", "c", 8, 3), ("c", "d", 7, 2), ("e", "f", 6, 1), ("g", "h", 7, 2)], "a string, b string, timestamp long, level int").withColumn("disease_nodes", F.array())
    assert samples.greedy_holdout(pairs, 3) == [("a", "b"), ("c", "d"), ("g", "h")]
    assert samples.greedy_holdout(pairs, 0) == [] and samples.greedy_holdout(pairs.limit(0), 5) == []
    train, held = samples.split_holdout(pairs, 2)
    assert {r.a for r in held.collect()} == {"a", "c"} and train.count() == 3
    nodes = spark.createDataFrame([("g1", "A", 2.0), ("g2", "B", 1.0), ("g3", "B", 5.0)], "id string, name string, orient double")
    raw = spark.createDataFrame([("A", "B", 1.0, 0), ("B", "A", 7.0, 1), ("A", "Z", 1.0, 2), (None, "A", 1.0, 3)], "gene_1 string, gene_2 string, weight double, line long")
    found, unknown = samples.resolve_pairs(raw, nodes, "name")
    assert [tuple(r) for r in found.collect()] == [("g1", "g3", 7.0)] and unknown.count() == 2
    with pytest.raises(ValueError):
        samples.negatives(raw, nodes, "name")
    both = samples.train_set(pairs.limit(1), pairs.limit(0), spark.createDataFrame([("a", "b", 0.5)], "a string, b string, weight double")).collect()
    assert [(r.label, r.weight) for r in both] == [(0, 0.5)]
    folds = samples.stratified_folds(spark.createDataFrame([(str(i), i % 3 == 0) for i in range(90)], "pair_id string, label boolean"), 10)
    assert {r["count"] for r in folds.where("label").groupBy("fold").count().collect()} == {3}


def random_paths(spark, rng, n_pairs=25):
    mps = [(["x"], []), (["x", "y"], ["P"]), (["y", "x"], ["P"]), (["x", "x", "y"], ["P", "Q"]), (["y", "x", "x"], ["Q", "P"])]
    rows = [(f"p{p}", *mps[m], [f"n{rng.randrange(4)}" for _ in mps[m][1]], round(rng.random(), 2)) for p in range(n_pairs) for m in range(5) for _ in range(rng.choice([0, 1, 3]))]
    df = spark.createDataFrame(rows, "pair_id string, edges array<string>, types array<string>, nodes array<string>, score double")
    df = df.groupBy("pair_id", "edges", "types", "nodes").agg(F.max("score").alias("score"))
    return written(df.withColumn("mp", paths.metapath_key(F.col("edges"), F.col("types"))), "paths")


def turned(m):
    return "/".join(reversed(m.split("/")))


@pytest.mark.parametrize("both", [False, True])
def test_mining_and_rules_against_enumeration(spark, both):
    rng = random.Random(11 + both)
    found = random_paths(spark, rng)
    weights = {f"p{i}": rng.choice([1, 2, 3]) / 3 for i in range(25)}
    sam = spark.createDataFrame(list(weights.items()), "pair_id string, weight double")
    data = {}
    for r in found.collect():
        data.setdefault((r.pair_id, 1), {}).setdefault(r.mp, {})[tuple(r.nodes)] = r.score
        if both:
            data.setdefault((r.pair_id, -1), {}).setdefault(turned(r.mp), {})[tuple(reversed(r.nodes))] = r.score
    minsup = 2.0
    every = sorted({m for v in data.values() for m in v})

    def support(ok):
        return sum(weights[p] for p in {p for (p, _), v in data.items() if ok(v)})

    want = {k: {c for c in itertools.combinations(every, k) if support(lambda v, c=c: set(c) <= v.keys()) >= minsup - 1e-9} for k in (2, 3)}
    levels = mining.grow_sets(mining.transactions(found, both), sam, minsup)
    assert {k: {tuple(r.mps) for r in s.collect()} for k, (s, _) in levels.items()} == want
    patterns, _ = mining.set_patterns(levels)

    unified = {}
    for k in (2, 3):
        for c in want[k]:
            for (p, _), v in data.items():
                if not set(c) <= v.keys():
                    continue
                spots = [{(n, pos + 1) for nodes in v[m] for pos, n in enumerate(nodes)} for m in c]
                for size in range(2, k + 1):
                    for which in itertools.combinations(range(k), size):
                        for combo in itertools.product(*[spots[i] for i in which]):
                            if len({n for n, _ in combo}) == 1:
                                unified.setdefault((c, tuple((i, pos) for i, (_, pos) in zip(which, combo, strict=True))), set()).add(p)
    patterns = written(patterns, "patterns")
    u = written(mining.unifications(patterns, found, sam, 1.0, both)[0], "unified")
    got = {(tuple(r.mps), tuple((x.i, x.pos) for x in r.unif)): r.n for r in u.collect()}
    assert got == {k: len(v) for k, v in unified.items() if sum(weights[p] for p in v) >= 1.0 - 1e-9}

    pats = written(patterns.unionByName(u), "patterns")
    ruled = rules.numbered(pats).withColumn("thresholds", F.transform("mps", lambda _, i: F.lit(0.2) + i * 0.1))
    ruled = written(ruled, "rules")

    def holds(r, v):
        kept = [[n for n, s in v.get(m, {}).items() if s >= t] for m, t in zip(r.mps, r.thresholds, strict=True)]
        if not all(kept):
            return False
        return not r.unif or bool(set.intersection(*[{n[x.pos - 1] for n in kept[x.i]} for x in r.unif]))

    brute = {(r.rule_id, p) for r in ruled.collect() for (p, _), v in data.items() if holds(r, v)}
    assert {tuple(r) for r in rules.cover(ruled, found, both).collect()} == brute
    behind = rules.matched_paths(ruled, found, both)
    assert {(r.rule_id, r.pair_id) for r in behind.select("rule_id", "pair_id").distinct().collect()} == brute

    rows = pats.collect()
    level = lambda r: r.k + bool(r.unif)
    loose = {r.pattern for r in rows if not any(level(q) == level(r) + 1 and r.mps[0] in q.mps and r.n <= q.n for q in rows)}
    strict = {r.pattern for r in rows if not any(level(q) == level(r) + 1 and set(r.mps) <= set(q.mps) and r.n <= q.n for q in rows)}
    assert {r.pattern for r in mining.closed_patterns(pats).collect()} == loose
    assert {r.pattern for r in mining.closed_patterns(pats, strict=True).collect()} == strict


def test_unifications_of_any_size(spark):
    """Conditions over two metapaths up to all of a pattern's."""
    mps = [f"a{i}/X/b{i}" for i in range(5)]
    found = spark.createDataFrame([(p, [f"a{i}", f"b{i}"], ["X"], m, ["x"], 0.5) for p in ("p", "q") for i, m in enumerate(mps)], "pair_id string, edges array<string>, types array<string>, mp string, nodes array<string>, score double")
    pairs = spark.createDataFrame([("p", 1.0), ("q", 1.0)], "pair_id string, weight double")
    pats, _ = mining.set_patterns({5: (spark.createDataFrame([(mps, 2.0, 2)], "mps array<string>, support double, n long"), spark.createDataFrame([(mps, "p", 1), (mps, "q", 1)], "mps array<string>, pair_id string, direction int"))})
    got, matched = mining.unifications(pats, found, pairs, 2.0)
    assert sorted(tuple(u.i for u in r.unif) for r in got.collect()) == sorted(c for n in range(2, 6) for c in itertools.combinations(range(5), n))
    assert matched.count() == 2 * 26


def searched(spark, rows, w, minsup, **more):
    """The search over score arrays by pair, direction and metapath; the weights of the pairs."""
    flat = [("t", str(p), j, i, [float(x) for x in d[i]]) for p, r in enumerate(rows) for j, d in enumerate(r) for i in range(len(d))]
    scores = spark.createDataFrame(flat, "pattern string, pair_id string, direction int, i int, scores array<double>")
    sam = spark.createDataFrame([(str(p), float(x)) for p, x in enumerate(w)], "pair_id string, weight double")
    r = thresholds.search(scores, sam, float(minsup), **more).first()
    return r.thresholds, r.cost


def enumerated(rows, w, minsup, values):
    """All combinations of candidates, the first of the cheapest."""
    k = len(values)
    grid = np.stack([x.ravel() for x in np.meshgrid(*values, indexing="ij")], axis=1)
    best = np.zeros((len(rows), len(grid)))
    for p, r in enumerate(rows):
        for d in r:
            c = [len(d[i]) - np.searchsorted(d[i], grid[:, i]) for i in range(k)]
            best[p] = np.maximum(best[p], np.where(np.min(c, axis=0) > 0, np.sum(c, axis=0), 0))
    n0 = np.array([max(sum(map(len, d)) for d in r) for r in rows])
    sup = w @ (best > 0)
    ok = (sup >= minsup - 1e-9) & (sup > 0)
    costs = np.where(ok, ((1 - sup / w.sum()) + (w @ best) / np.where(ok, sup, 1) / (w @ n0 / w.sum())) / 2, 1.0).round(12)
    return grid[np.argmin(costs)], costs.min(), len(grid)


@pytest.mark.parametrize(("k", "n", "digits", "seed", "width"), [(2, 40, 3, 1, 256), (2, 60, 3, 2, 2), (3, 90, 1, 3, 256), (3, 12, 2, 4, 3)])
def test_threshold_search_is_exact(spark, monkeypatch, k, n, digits, seed, width):
    """Against enumeration of all observed scores, with boxes that wait as well."""
    monkeypatch.setattr(thresholds, "WIDTH", width)
    rng = np.random.default_rng(seed)
    rows = [[[np.sort(rng.random(rng.integers(1, 5)).round(digits)) for _ in range(k)] for _ in range(1 + p % 2)] for p in range(n)]
    w = rng.choice([1 / 3, 2 / 3, 1.0], n)
    values = [np.unique(np.concatenate([[0.0], *[d[i] for r in rows for d in r]])) for i in range(k)]
    t, c, size = enumerated(rows, w, 0.1 * w.sum(), values)
    assert size * n > 100_000
    got = searched(spark, rows, w, 0.1 * w.sum())
    assert abs(got[1] - c) < 1e-11 and np.allclose(got[0], t)


def test_threshold_search_over_given_candidates(spark):
    rng = np.random.default_rng(9)
    rows = [[[np.sort(rng.random(rng.integers(1, 6))) for _ in range(3)]] for _ in range(30)]
    w, listed = rng.choice([1 / 3, 1.0], 30), [0.0, 0.3, 0.5, 0.8]
    t, c, _ = enumerated(rows, w, 3.0, [np.array(listed)] * 3)
    got = searched(spark, rows, w, 3.0, candidates=listed)
    assert abs(got[1] - c) < 1e-11 and np.allclose(got[0], t)
    # Not frequent enough at any thresholds: the lowest ones, at full cost.
    assert searched(spark, rows, w, 100.0) == ([0.0, 0.0, 0.0], 1.0)


def test_decision_set(spark):
    cover = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "x"), (3, "c"), (4, "x"), (4, "y")], "rule_id int, pair_id string")
    sam = spark.createDataFrame([(p, 1.0, 1) for p in "abcd"] + [(p, 1.0, 0) for p in "xyz"], "pair_id string, weight double, label int")

    def objective(chosen):
        if not chosen:
            return 1.0
        hit = {p for r, p in [tuple(x) for x in cover.collect()] if r in chosen}
        return 0.5 * (1 - len(hit & set("abcd")) / 4) + 0.5 * len(hit & set("xyz")) / 3

    got = decision_set.select_greedy(cover, sam, 0.5)
    want, left = [], {1, 2, 3, 4}
    while left:
        best = min(left, key=lambda r: (round(objective({*want, r}) - objective(set(want)), 12), -r))
        if objective({*want, best}) - objective(set(want)) >= 0:
            break
        want.append(best)
        left -= {best}
    assert got == want == [1, 3]
    assert {r.rule_id for r in decision_set.select_sequential(cover, sam, "conf").collect()} == {1, 3}
    assert {r.rule_id for r in decision_set.select_sequential(cover, sam, "conf", 2).collect()} == {1, 2, 3}
    assert decision_set.set_weight(cover.where("rule_id in (1, 3)"), sam, 0.5) == objective({1, 3})
    assert decision_set.set_weight(cover.limit(0), sam, 0.5) == 1.0
    p = decision_set.non_matching_probability(cover.where("rule_id in (1, 3)"), sam, 4 / 3)
    assert abs(p - 1 / (1 + 4 / 3 * 3)) < 1e-12


def test_metrics(spark):
    rng = np.random.default_rng(8)
    y, s, w = rng.integers(0, 2, 60), rng.integers(0, 10, 60) / 10, rng.integers(1, 4, 60) * 1.0
    df = spark.createDataFrame([(int(a), float(b), float(c)) for a, b, c in zip(y, s, w, strict=True)], "y int, proba double, weight double")
    r = metrics.performance(df).first()
    pos, neg = y == 1, y == 0
    auc = sum(w[i] * w[j] * ((s[i] > s[j]) + 0.5 * (s[i] == s[j])) for i in np.flatnonzero(pos) for j in np.flatnonzero(neg)) / (w[pos].sum() * w[neg].sum())
    hit = s >= 0.5
    tp, fp, fn, tn = (w[m].sum() for m in (hit & pos, hit & neg, ~hit & pos, ~hit & neg))
    assert abs(r.roc_auc - auc) < 1e-9 and abs(r.precision - tp / (tp + fp)) < 1e-9 and abs(r.recall - tp / (tp + fn)) < 1e-9
    assert abs(r.mcc - (tp * tn - fp * fn) / math.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))) < 1e-9
    best = max(sorted({*s}, reverse=True), key=lambda t: round(w[pos & (s >= t)].sum() / w[pos].sum() - w[neg & (s >= t)].sum() / w[neg].sum(), 12))
    assert r.optimal_threshold == best
    single = metrics.performance(df.where("y = 1")).first()
    assert math.isnan(single.precision) and math.isnan(single.mcc) and 0 <= single.recall <= 1


def test_fisher(spark):
    df = spark.createDataFrame([(3.0, 1.0, 1.0, 3.0), (0.0, 5.0, 5.0, 0.0)], "a double, b double, c double, d double")
    got = [r.p for r in df.select(rules.fisher_greater("a", "b", "c", "d").alias("p")).collect()]
    assert abs(got[0] - 17 / 70) < 1e-9 and abs(got[1] - 1) < 1e-9


def test_hubs_do_not_multiply_half_paths(spark):
    """Two hubs of 10^5 edges between few pairs: every half stays near its ends, and all paths through the hubs are found."""
    n = 100_000
    leaves = spark.range(n).select(F.concat(F.lit("l"), F.col("id")).alias("src"), F.explode(F.array(F.lit("H"), F.lit("K"))).alias("dst"))
    few = spark.createDataFrame([("a", "l1"), ("a", "l2"), ("b", "H"), ("b", "K"), ("a", "H"), ("H", "K"), ("b", "l7")], "src string, dst string")
    e = leaves.unionByName(few).withColumns({"label": F.lit("x"), "score": F.lit(0.5), "ctx": F.lit(None).cast("array<string>"), "src_type": F.lit("T"), "dst_type": F.lit("T")})
    adjacency = written(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "label", "score", "ctx", "src_type", "dst_type")), "adjacency")
    pairs = spark.createDataFrame([("p", "a", "b")], "pair_id string, a string, b string")
    heavy = paths.heavy_nodes(adjacency)
    assert {r.id for r in heavy.collect()} == {"H", "K"}
    near, far = paths.halves(pairs, paths.flagged(adjacency, heavy), 3)
    assert sum(h.count() for half in (near, far) for h in half.values()) < 50
    got = {tuple(r.nodes) for r in paths.enumerate_paths(pairs, adjacency).collect()}
    assert got == {("H",), ("l1", "H"), ("l2", "H"), ("l1", "K"), ("l2", "K"), ("H", "K"), ("H", "l7")}


@pytest.mark.parametrize("both", [False, True])
def test_bitmaps_of_many_ranges_and_weightings(spark, monkeypatch, both):
    """Pairs spread over many ranges, sets over many blocks, several weightings at once, sizes up to four."""
    monkeypatch.setattr(mining, "RANGE", 16)
    monkeypatch.setattr(mining, "SETS", 12)
    rng = random.Random(5)
    tx = sorted({(f"p{p}", rng.choice([1, -1]) if both else 1, f"m{m}") for p in range(120) for m in range(7) if rng.random() < 0.8})
    df = written(spark.createDataFrame(tx, "pair_id string, direction int, mp string"), "tx")
    weights = {f"p{p}": [rng.choice([1, 2, 3]) / 3, rng.choice([0.0, 1.0])] for p in range(130)}
    sam = spark.createDataFrame(list(weights.items()), "pair_id string, weights array<double>")
    minsups = [12.0, 10.0]
    baskets = {}
    for p, d, m in tx:
        baskets.setdefault((p, d), set()).add(m)
    want = {}
    for k in (2, 3, 4):
        for c in itertools.combinations([f"m{m}" for m in range(7)], k):
            hit = {p for (p, _), b in baskets.items() if set(c) <= b}
            sums = [sum(weights[p][f] for p in hit) for f in (0, 1)]
            if any(s >= m - 1e-9 for s, m in zip(sums, minsups, strict=True)):
                want.setdefault(k, {})[c] = [round(x, 6) for x in sums] + [sum(weights[p][f] > 0 for p in hit) for f in (0, 1)]
    got = mining.grow_weighted(df, sam, minsups, 4)
    assert {k: {tuple(r.mps): [*[round(x, 6) for x in r.supports], *r.ns] for r in s.collect()} for k, s in got.items()} == {k: want.get(k, {}) for k in (2, 3, 4)}
    assert want.get(2) and want.get(3)


def test_ordinals(spark):
    df = spark.range(500).select((F.col("id") * 37 % 501).alias("v"), "id")
    from pathloom.sources.stages import ordinals

    rows = ordinals(df.repartition(7), F.desc("v"), "id", name="place").collect()
    assert [r.v for r in sorted(rows, key=lambda r: r.place)] == sorted((r.v for r in rows), reverse=True)
    assert sorted(r.place for r in rows) == list(range(500))
    assert ordinals(df.limit(0), "id").count() == 0
