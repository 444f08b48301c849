"""What steps send around grows with their input: neither with a hub's neighbours per pair, nor with the number of rules per path."""

from pyspark.sql import functions as F

from pathloom.operators import graph, mining, paths, rules, samples, thresholds
from pathloom.plans.fixture import fixture
from pathloom.sources.stages import written


def _exchanges(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]


def test_a_hub_is_bridged_from_the_side_that_branches_less(spark):
    """40 first ends at a hub of 200 heavy nodes: 40 halves times 200 stretches are not made to find the few paths through it."""
    rows = [(f"a{i}", "H") for i in range(40)] + [("H", f"h{i}") for i in range(200)] + [(f"h{i}", f"x{i}_{j}") for i in range(200) for j in range(3)] + [("h7", "b")]
    e = spark.createDataFrame(rows, "src string, dst string").withColumns({"label": F.lit("x"), "score": F.lit(0.5), "ctx": F.lit(None).cast("array<string>"), "src_type": F.lit("T"), "dst_type": F.lit("T")})
    adjacency = written(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "label", "score", "ctx", "src_type", "dst_type")), "adjacency")
    pairs = spark.createDataFrame([(f"p{i}", f"a{i}", "b") for i in range(40)], "pair_id string, a string, b string")
    heavy = paths.heavy_nodes(adjacency, 3)
    hops = paths.flagged(adjacency, heavy)
    by_near, by_far = paths.stretches(heavy, hops, 1)[1]
    near, _ = paths.halves(pairs, hops, 3)
    assert by_far.where("end = 'H'").count() == 200 and paths._bridged(near[1].where("tip_heavy"), by_near).count() == 0
    got = [(r.pair_id, tuple(r.nodes)) for r in paths.enumerate_paths(pairs, adjacency, 3, heavy_above=3).collect()]
    assert sorted(got) == sorted((f"p{i}", ("H", "h7")) for i in range(40))


def test_rules_share_one_shuffle_of_pairs(spark):
    found = spark.createDataFrame([(f"p{i}", [m], [], m, [], 0.2 + 0.1 * i) for i in range(5) for m in "xyz"[: 1 + i % 3]], "pair_id string, edges array<string>, types array<string>, mp string, nodes array<string>, score double")
    ruled = written(spark.createDataFrame([(1, "a", ["x", "y"], [], [0.0, 0.0]), (2, "b", ["x", "z"], [], [0.0, 0.0]), (3, "c", ["x", "y"], [], [0.0, 0.5])], "rule_id int, pattern string, mps array<string>, unif array<struct<i:int,pos:int>>, thresholds array<double>"), "rules")
    out = rules.cover(ruled, written(found, "paths"))
    assert {tuple(r) for r in out.collect()} == {(1, "p1"), (1, "p2"), (1, "p4"), (2, "p2"), (3, "p4")}
    assert not any("rule_id" in line for line in _exchanges(out)) and sum("pair_id" in line for line in _exchanges(out.select("rule_id", "pair_id"))) <= 2


def test_negatives_are_neither_written_nor_shuffled(spark):
    found = fixture(spark, "/root/testdata/sf0.01").negatives
    assert not hasattr(found, "_pathloom_path") and not _exchanges(found)


def test_folds_leave_their_order_behind(spark):
    out = samples.stratified_folds(spark.createDataFrame([(str(i), i % 3) for i in range(30)], "pair_id string, label int"), 5)
    assert out.columns == ["pair_id", "label", "fold"] and "order__" not in out._jdf.queryExecution().analyzed().toString()


def _shuffles(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning"), plan


def test_edges_look_up_the_types_of_their_ends_once(spark):
    """Both ways of an edge come from one join with the nodes for each end, not from two."""
    nodes = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "B")], "id string, node_type string")
    edges = spark.createDataFrame([(1, "a", "b", "x", 0.5, ["1"]), (2, "c", "c", "y", 0.2, None), (3, "b", "c", "x", 0.1, None), (4, "a", "gone", "x", 0.1, None)], "edge_id long, src string, dst string, label string, score double, ctx array<string>")
    out = graph.Graph(nodes, edges).adjacency
    got = {(r.edge_id, r.src, r.dst, r.src_type, r.dst_type, r.label, r.score, tuple(r.ctx or ())) for r in out.collect()}
    assert got == {(1, "a", "b", "A", "B", "x", 0.5, ("1",)), (1, "b", "a", "B", "A", "x", 0.5, ("1",)), (2, "c", "c", "B", "B", "y", 0.2, ()), (3, "b", "c", "B", "B", "x", 0.1, ()), (3, "c", "b", "B", "B", "x", 0.1, ())} and out.count() == 5
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 2


def test_first_steps_leave_the_hops_where_they_are(spark, monkeypatch):
    """Half paths of one hop meet the hops as broadcast ends."""
    plans = []
    monkeypatch.setattr(paths, "written", lambda df, tag: plans.append((tag, _shuffles(df))) or written(df, tag))
    hops = spark.createDataFrame([("a", "x", "T", "T", "l", 0.0, 0, []), ("x", "b", "T", "T", "l", 0.0, 0, []), ("b", "x", "T", "T", "l", 0.0, 0, []), ("x", "a", "T", "T", "l", 0.0, 0, [])], "src string, dst string, src_type string, dst_type string, label string, log double, c int, ctx array<string>")
    hops = written(hops.withColumns({"src_heavy": F.lit(False), "dst_heavy": F.lit(False)}), "hops")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        near, far = paths.halves(spark.createDataFrame([("p", "a", "b")], "pair_id string, a string, b string"), hops, 2)
        assert near[1].count() == far[1].count() == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    found = [n for tag, (n, _) in plans if tag == "half"]
    assert len(found) == 2 and found == [0, 0]


def test_matches_and_scores_shuffle_each_path_once(spark):
    """Paths go to their pair before rules, patterns or thresholds multiply them; what is asked of a pair needs no further shuffle."""
    found = written(spark.createDataFrame([(f"p{i}", [m], ["T"], m, [f"n{i % 3}"], 0.2 + 0.1 * i) for i in range(6) for m in ("x/T/y", "z/T/w")[: 1 + i % 2]], "pair_id string, edges array<string>, types array<string>, mp string, nodes array<string>, score double"), "paths")
    pattern = "pattern string, mps array<string>, k int, unif array<struct<i:int,pos:int>>, support double, n long"
    patterns = written(spark.createDataFrame([("a", ["x/T/y", "z/T/w"], 2, [], 1.0, 3)], pattern), "patterns")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    by_pair = lambda df: [line for line in _exchanges(df.select("*")) if "pair_id" in line]
    try:
        ruled = written(rules.numbered(patterns), "rules")
        behind = rules.matched_paths(ruled, found)
        assert {(r.pair_id, r.i, r.u_node) for r in behind.collect()} == {(f"p{i}", j, None) for i in (1, 3, 5) for j in (0, 1)} and len(by_pair(behind)) == 1
        scores = thresholds.pattern_scores(patterns, found)
        assert {(r.pair_id, r.i, tuple(r.scores)) for r in scores.collect()} == {(f"p{i}", j, (0.2 + 0.1 * i,)) for i in (1, 3, 5) for j in (0, 1)} and len(by_pair(scores)) == 1
        above = thresholds.counts_above(written(scores, "scores"), thresholds.grid(patterns, [0.0, 0.4, 0.6]))
        assert {(r.t_id, r.pair_id): r.n_paths for r in above.collect()} == {(t, f"p{i}"): 2 if 0.2 + 0.1 * i >= v else 0 for t, v in enumerate((0.0, 0.4, 0.6)) for i in (1, 3, 5)} and len(by_pair(above)) == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_shared_nodes_read_the_paths_once(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(mining, "written", lambda df, tag: plans.append((tag, _shuffles(df)[1])) or written(df, tag))
    found = spark.createDataFrame([(f"p{i}", [m], ["T"], m, [f"n{i if m < 'y' else i - i % 2}"], 0.5) for i in range(6) for m in ("x/T/y", "z/T/w")[: 1 + (i < 4)]], "pair_id string, edges array<string>, types array<string>, mp string, nodes array<string>, score double")
    patterns = written(spark.createDataFrame([("a", ["x/T/y", "z/T/w"], 2, [])], "pattern string, mps array<string>, k int, unif array<struct<i:int,pos:int>>"), "patterns")
    got = mining.shared_nodes(patterns, written(found, "paths")).collect()
    assert {(r.pair_id, tuple((u.i, u.pos) for u in r.unif)) for r in got} == {(f"p{i}", ((0, 1), (1, 1))) for i in (0, 2)}
    spots = next(plan for tag, plan in plans if tag == "spots")
    assert sum("hashpartitioning" in line and "pair_id" in line for line in spots.splitlines()) == 1


def test_folds_are_numbered_in_one_shuffle_and_not_written(spark):
    import hashlib

    rows = [(f"p{i}", i % 3) for i in range(500)]
    out = samples.stratified_folds(spark.createDataFrame(rows, "pair_id string, label int"), 7)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "rangepartitioning" not in plan and "ordered-" not in plan
    want = {}
    for label in range(3):
        mine = sorted((hashlib.md5(f"42:{p}".encode()).hexdigest(), p) for p, y in rows if y == label)
        want |= {p: n % 7 for n, (_, p) in enumerate(mine)}
    assert {r.pair_id: r.fold for r in out.collect()} == want
