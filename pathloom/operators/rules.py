"""Rules: numbered patterns with thresholds, evaluated against pairs by relational division.

rules: rule_id, pattern, mps, unif, thresholds (one per metapath, 0 where none is set)
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from pathloom.operators.paths import directed
from pathloom.sources.stages import hinted, ordinals


def numbered(patterns: DataFrame, thresholds: DataFrame | None = None) -> DataFrame:
    """Rules from patterns, numbered from 1 in the order of their metapaths and conditions."""
    out = ordinals(patterns, "mps", "unif", name="rule_id").withColumn("rule_id", (F.col("rule_id") + 1).cast("int"))
    if thresholds is None:
        out = out.withColumn("thresholds", F.transform("mps", lambda _: F.lit(0.0)))
    else:
        out = out.join(thresholds.select("pattern", "thresholds"), "pattern")
    return out.select("rule_id", "pattern", "mps", "unif", "thresholds")


def hits(rules: DataFrame, paths: DataFrame, both: bool = False) -> DataFrame:
    """Paths that serve a metapath of a rule at its threshold: rule_id, k (its number of metapaths), i, pair_id, direction, nodes, score, edges."""
    items = rules.select("rule_id", F.size("mps").alias("k"), F.posexplode("mps").alias("i", "mp"), "thresholds").withColumn("thr", F.element_at("thresholds", F.col("i") + 1)).drop("thresholds")
    p = directed(paths, both).select("pair_id", "direction", "mp", "edges", "types", "nodes", "score")
    # Shuffled by pair before rules multiply the paths, so that what follows pair by pair needs no further shuffle.
    p = p.join(hinted(items.select("mp").distinct()), "mp", "left_semi").repartition("pair_id")
    return p.join(hinted(items), "mp").where("score >= thr")


def _shared(found: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule_id, pair_id, direction, node) where paths of all metapaths of the rule's condition pass the node."""
    cond = rules.where(F.size("unif") > 0).select("rule_id", F.size("unif").alias("m"), F.explode("unif").alias("u"))
    j = found.join(hinted(cond.select("rule_id", "m", F.col("u.i").alias("i"), F.col("u.pos").alias("pos"))), ["rule_id", "i"])
    j = j.select("rule_id", "pair_id", "direction", "i", "m", F.element_at("nodes", F.col("pos")).alias("node"))
    return j.groupBy("rule_id", "pair_id", "direction", "node").agg(F.countDistinct("i").alias("c"), F.first("m").alias("m")).where("c = m").select("rule_id", "pair_id", "direction", "node")


def metapath_sets(paths: DataFrame, both: bool = False, used: DataFrame | None = None) -> DataFrame:
    """pair_id and found: the pair's metapaths (of those used, if given), each with its best score (direction, mp, best)."""
    p = directed(paths.select("pair_id", "edges", "types", "mp", "nodes", "score"), both).select("pair_id", "direction", "mp", "score")
    p = p if used is None else p.join(used, "mp", "left_semi")
    # By pair alone, so that what follows pair by pair needs no further shuffle.
    per = p.repartition("pair_id").groupBy("pair_id", "direction", "mp").agg(F.max("score").alias("best"))
    return per.groupBy("pair_id").agg(F.collect_list(F.struct("direction", "mp", "best")).alias("found"))


def with_rules(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """sets (found, as in metapath_sets, and any other columns) with the sorted ids of the rules that match in place of found; rules have no conditions.

    A pair looks up the rules of each of its metapaths in one row that holds them all, so no pair is shuffled.
    """
    if not rules.where(F.size("unif") > 0).isEmpty():
        raise ValueError("rules with conditions need paths")
    per = rules.groupBy(F.get("mps", F.lit(0)).alias("mp")).agg(F.collect_list(F.struct("rule_id", F.arrays_zip("mps", "thresholds").alias("items"))).alias("of"))
    one = F.broadcast(per.agg(F.map_from_entries(F.collect_list(F.struct("mp", "of"))).alias("by_first__")))  # one row
    has = lambda x, item: F.exists("found", lambda y: (y["direction"] == x["direction"]) & (y["mp"] == item["mps"]) & (y["best"] >= item["thresholds"]))
    match = lambda x: F.transform(F.filter(F.try_element_at("by_first__", x["mp"]), lambda r: F.forall(r["items"], lambda item: has(x, item))), lambda r: r["rule_id"])
    known = F.filter(F.transform("found", match), lambda ids: ids.isNotNull())
    ids = F.coalesce(F.sort_array(F.array_distinct(F.flatten(known))), F.array().cast("array<int>"))
    return sets.crossJoin(one).select(*[c for c in sets.columns if c != "found"], ids.alias("rules"))


def pooled(covered: DataFrame) -> DataFrame:
    """Rows of with_rules (weight, label) that have the same rules and label as one: rules, label, weight (their sum) and n."""
    return covered.groupBy("rules", "label").agg(F.sum("weight").alias("weight"), F.count("*").alias("n"))


def matches(rules: DataFrame, paths: DataFrame, both: bool = False) -> DataFrame:
    """Distinct (rule_id, pair_id, direction) of all rules that match.

    A pair's metapaths, each with its best score, are gathered in one row; a rule meets them by its first metapath and looks up the others there, so
    what is shuffled is a row for each pair and metapath, however many rules have it. Paths themselves are looked at only for the rules with a condition.
    """
    n_rules = rules.count()
    sets = metapath_sets(paths, both, hinted(rules.select(F.explode("mps").alias("mp")).distinct())).select("pair_id", "found", F.inline("found"))
    wanted = rules.select("rule_id", F.get("mps", F.lit(0)).alias("mp"), F.arrays_zip("mps", "thresholds").alias("items"))
    j = sets.join(hinted(wanted, n_rules), "mp")
    served = lambda item: F.exists("found", lambda x: (x["direction"] == F.col("direction")) & (x["mp"] == item["mps"]) & (x["best"] >= item["thresholds"]))
    full = j.where(F.forall("items", served)).select("rule_id", "pair_id", "direction")
    conditions = rules.where(F.size("unif") > 0)
    if conditions.isEmpty():
        return full
    plain = full.join(hinted(conditions.select("rule_id"), n_rules), "rule_id", "left_anti")
    shared = _shared(hits(conditions, paths, both), conditions).select("rule_id", "pair_id", "direction").distinct()
    return plain.unionByName(full.join(shared, ["rule_id", "pair_id", "direction"], "left_semi"))


def cover(rules: DataFrame, paths: DataFrame, both: bool = False) -> DataFrame:
    """Distinct (rule_id, pair_id)."""
    found = matches(rules, paths, both).select("rule_id", "pair_id")
    return found.distinct() if both else found


def by_rule(cover: DataFrame, samples: DataFrame) -> DataFrame:
    """rule_id, weight and label of what each rule matches: from (rule_id, pair_id) and samples, or from rows that have rules, weight and label already."""
    if "rules" in cover.columns:
        return cover.select(F.explode("rules").alias("rule_id"), *[c for c in cover.columns if c != "rules"])
    return cover.join(samples.select("pair_id", "weight", "label"), "pair_id")


def rules_by_pair(pairs: DataFrame, covered: DataFrame) -> DataFrame:
    """Every pair with the ids of its rules, empty if none matches."""
    per = covered.groupBy("pair_id").agg(F.sort_array(F.collect_set("rule_id")).alias("rules"))
    return pairs.select("pair_id").join(per, "pair_id", "left").withColumn("rules", F.coalesce("rules", F.array().cast("array<int>")))


def matched_paths(rules: DataFrame, paths: DataFrame, both: bool = False) -> DataFrame:
    """The paths behind each match: rule_id, pair_id, direction, u_node (null for metapaths outside the condition), i, nodes, score, edges."""
    found = hits(rules, paths, both)
    key = ["rule_id", "pair_id", "direction"]
    if rules.where(F.size("unif") > 0).isEmpty():
        # Without conditions a rule matches where each of its metapaths is served, which its own rows show.
        whole = found.withColumn("served", F.size(F.collect_set("i").over(Window.partitionBy(*key)))).where("served = k")
        return whole.select(*key, F.when(F.lit(False), F.get("nodes", F.lit(0))).alias("u_node"), "i", "mp", "nodes", "score", "edges")
    found = found.join(matches(rules, paths, both), key, "left_semi")
    cond = rules.select("rule_id", F.explode("unif").alias("u")).select("rule_id", F.col("u.i").alias("i"), F.col("u.pos").alias("pos"))
    with_pos = found.join(hinted(cond), ["rule_id", "i"], "left").withColumn("u_node", F.when(F.col("pos").isNotNull(), F.try_element_at("nodes", F.col("pos"))))
    shared = _shared(found, rules).withColumnRenamed("node", "u_node")
    tied = with_pos.where("pos is not null").join(shared, [*key, "u_node"], "left_semi")
    cols = [*key, "u_node", "i", "mp", "nodes", "score", "edges"]
    return with_pos.where("pos is null").select(cols).unionByName(tied.select(cols))


def subgraph_edges(found: DataFrame, pairs: DataFrame, adjacency: DataFrame) -> DataFrame:
    """Distinct (rule_id, pair_id, edge_id, src, dst, label, score) of the graph under matched paths, parallel edges included."""
    ends = found.join(pairs.select("pair_id", "a", "b"), "pair_id")
    start, stop = F.when(F.col("direction") == 1, F.col("a")).otherwise(F.col("b")), F.when(F.col("direction") == 1, F.col("b")).otherwise(F.col("a"))
    # A path of the turned direction is stored from b to a.
    walk = ends.select("rule_id", "pair_id", "edges", F.concat(F.array(start), "nodes", F.array(stop)).alias("w"))
    steps = walk.select("rule_id", "pair_id", F.explode(F.transform("edges", lambda e, i: F.struct(F.element_at("w", i + 1).alias("src"), F.element_at("w", i + 2).alias("dst"), e.alias("label")))).alias("s"))
    steps = steps.select("rule_id", "pair_id", "s.*").distinct()
    out = steps.join(adjacency.select("edge_id", "src", "dst", "label", "score"), ["src", "dst", "label"])
    return out.groupBy("rule_id", "pair_id", "edge_id").agg(F.min("src").alias("src"), F.min("dst").alias("dst"), F.min("label").alias("label"), F.max("score").alias("score"))


def prune_by_fpr(rules: DataFrame, negative_cover: DataFrame, negatives: DataFrame, max_fpr: float = 1.0) -> DataFrame:
    """Rules whose matched negative weight is at most max_fpr of all negative weight."""
    total = negatives.agg(F.sum("weight")).first()[0] or 0.0
    per = negative_cover if "rules" in negative_cover.columns else negative_cover.join(negatives.select("pair_id", "weight"), "pair_id")
    per = per.select(F.explode("rules").alias("rule_id"), "weight") if "rules" in per.columns else per
    per = per.groupBy("rule_id").agg(F.sum("weight").alias("w"))
    return rules.join(per, "rule_id", "left").where(F.coalesce("w", F.lit(0.0)) <= max_fpr * total + 1e-9).drop("w")


@F.pandas_udf(DoubleType())
def fisher_greater(tp: pd.Series, fp: pd.Series, fn: pd.Series, tn: pd.Series) -> pd.Series:
    """One-sided exact test that tp is larger than chance; counts are rounded to whole numbers."""

    def one(a, b, c, d):
        a, b, c, d = (max(0, round(x)) for x in (a, b, c, d))
        lc = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
        n, row, col = a + b + c + d, a + b, a + c
        return min(1.0, sum(math.exp(lc(col, x) + lc(n - col, row - x) - lc(n, row)) for x in range(a, min(row, col) + 1)))

    return pd.Series([one(*x) for x in zip(tp, fp, fn, tn, strict=True)], dtype="float64")


def significance(rules: DataFrame, covered: DataFrame, samples: DataFrame, max_pval: float | None = None) -> DataFrame:
    """rule_id and pval of every rule, those below max_pval if given."""
    sums = samples.agg(F.coalesce(F.sum(F.when(F.col("label") == 1, F.col("weight"))), F.lit(0.0)), F.coalesce(F.sum(F.when(F.col("label") == 0, F.col("weight"))), F.lit(0.0))).first()
    per = by_rule(covered, samples).groupBy("rule_id").agg(
        F.sum(F.when(F.col("label") == 1, F.col("weight")).otherwise(0.0)).alias("tp"), F.sum(F.when(F.col("label") == 0, F.col("weight")).otherwise(0.0)).alias("fp")
    )
    out = rules.select("rule_id").join(per, "rule_id", "left").fillna(0.0, ["tp", "fp"])
    out = out.select("rule_id", fisher_greater("tp", "fp", F.lit(float(sums[0])) - F.col("tp"), F.lit(float(sums[1])) - F.col("fp")).alias("pval"))
    return out if max_pval is None else out.where(F.col("pval") < max_pval)
