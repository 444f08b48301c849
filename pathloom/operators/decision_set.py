"""A small weighted set of rules that classifies pairs: selection, probabilities, prediction, explanation.

cover: (rule_id, pair_id); samples: (pair_id, weight, label). Confidence and probability of a rule are
P / (P + r N) over its matched weights; r is the imbalance ratio, 1 while rules are being selected.
Instead of a cover, rows with rules, weight and label may be given (pairs with the rules that match them, or such of equal rules
and label pooled as one): nothing is joined then, and they are the samples as well.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.operators import rules as R
from pathloom.sources.stages import release, written


def class_weights(samples: DataFrame) -> tuple[float, float]:
    """Weight of all positives and of all negatives."""
    p, n = samples.agg(F.sum(F.when(F.col("label") == 1, F.col("weight"))), F.sum(F.when(F.col("label") == 0, F.col("weight")))).first()
    return p or 0.0, n or 0.0


def imbalance_ratio(samples: DataFrame) -> float:
    """Weight of positives over that of negatives; 1 without negatives."""
    p, n = class_weights(samples)
    return p / n if n else 1.0


def _ratio(pos: Column, neg: Column, imbalance: float) -> Column:
    total = pos + F.lit(float(imbalance)) * neg
    return F.when(total == 0, 0.0).otherwise(pos / total)


def rule_sums(cover: DataFrame, samples: DataFrame, imbalance: float = 1.0) -> DataFrame:
    """rule_id, pos, neg (matched weights) and confidence."""
    j = R.by_rule(cover, samples)
    per = j.groupBy("rule_id").agg(F.sum(F.when(F.col("label") == 1, F.col("weight")).otherwise(0.0)).alias("pos"), F.sum(F.when(F.col("label") == 0, F.col("weight")).otherwise(0.0)).alias("neg"))
    return per.withColumn("confidence", _ratio(F.col("pos"), F.col("neg"), imbalance))


def set_weight(cover: DataFrame, samples: DataFrame, alpha: float) -> float:
    """Objective of the rules in cover: alpha (1 - TPR) + (1 - alpha) FPR of what they cover together; 1 for no rule."""
    p, n = class_weights(samples)
    if cover.isEmpty():
        return 1.0
    if "rules" in cover.columns:
        cover = cover.where(F.size("rules") > 0)
        if cover.isEmpty():
            return 1.0
        cp, cn = class_weights(cover)
    else:
        cp, cn = class_weights(cover.select("pair_id").distinct().join(samples, "pair_id"))
    return alpha * (1 - (cp / p if p else 0.0)) + (1 - alpha) * (cn / n if n else 0.0)


def marginal_weights(cover: DataFrame, samples: DataFrame, alpha: float, covered: DataFrame | None = None) -> DataFrame:
    """rule_id, marginal and confidence: what adding each rule to those that cover `covered` changes in the objective."""
    p, n = class_weights(samples)
    rest = samples if covered is None else samples.join(covered, "pair_id", "left_anti")
    sums = rule_sums(cover, samples)
    gain = (sums if covered is None else rule_sums(cover, rest)).select("rule_id", F.col("pos").alias("p"), F.col("neg").alias("n"))
    j = sums.join(gain, "rule_id", "left").fillna(0.0, ["p", "n"])
    change = F.lit(1 - alpha) * (F.col("n") / F.lit(n) if n else F.lit(0.0)) - F.lit(alpha) * (F.col("p") / F.lit(p) if p else F.lit(0.0))
    start = alpha - 1.0 if covered is None else 0.0
    return j.select("rule_id", F.round(F.lit(start) + change, 12).alias("marginal"), "confidence")


def select_greedy_by(cover: DataFrame, totals: DataFrame, alpha: float = 0.5, by: str = "fold") -> list[tuple]:
    """(group, rule_id) chosen in every group of column by: rules added one by one, each the cheapest, while the objective falls; ties go to higher confidence, then id.

    cover: by, rule_id, pair_id, weight, label, distinct, or by, rules, weight, label; totals: by, p, n (weights of all positives and negatives). All groups
    advance in the same rounds, so their number adds no jobs. What every rule would add is kept and not worked out again:
    a round takes the pairs that the chosen rules are the first to cover from an index of pairs with their rules, and
    subtracts them from the sums of the rules they have. Once a rule is chosen, one without an uncovered positive can't lower
    the objective any more, so it leaves the table. Only chosen rules, one for each group and round, reach the driver.
    """
    spark, group = cover.sparkSession, cover.schema[by].dataType.simpleString()
    if "rules" in cover.columns:
        index = cover.where(F.size("rules") > 0).select(by, "rules", "weight", "label")
        cover = index.select(by, F.explode("rules").alias("rule_id"), "weight", "label")
    else:
        index = cover.groupBy(by, "pair_id").agg(F.collect_list("rule_id").alias("rules"), F.any_value("weight").alias("weight"), F.any_value("label").alias("label"))
    index = written(index, "index")
    part = lambda label: F.when(F.col("label") == label, F.col("weight")).otherwise(0.0)
    sums = cover.groupBy(by, "rule_id").agg(F.sum(part(1)).alias("pos"), F.sum(part(0)).alias("neg"))
    left = written(sums.withColumn("confidence", _ratio(F.col("pos"), F.col("neg"), 1.0)).join(F.broadcast(totals), by), "residual")  # a row per group
    share = lambda c, whole: F.when(F.col(whole) > 0, F.col(c) / F.col(whole)).otherwise(0.0)
    chosen: dict = {}
    while True:
        change = F.lit(0.0 if chosen else alpha - 1.0) + (1 - alpha) * share("neg", "n") - alpha * share("pos", "p")
        best = left.groupBy(by).agg(F.min(F.struct(F.round(change, 12).alias("marginal"), -F.col("confidence"), (-F.col("rule_id")).alias("last"))).alias("b")).where("b.marginal < 0")
        rows = [(r[by], -r["last"]) for r in best.select(by, "b.last").collect()]
        if not rows:
            return [(g, rule) for g, ids in sorted(chosen.items()) for rule in ids]
        # A row per group; a group without one has all its rules.
        picks = F.broadcast(spark.createDataFrame([(g, rule, chosen.get(g, [])) for g, rule in rows], f"`{by}` {group}, best int, before array<int>"))
        for g, rule in rows:
            chosen.setdefault(g, []).append(rule)
        new = index.join(picks, by).where(F.array_contains("rules", F.col("best")) & ~F.arrays_overlap("rules", "before"))
        gone = new.select(by, F.explode("rules").alias("rule_id"), part(1).alias("gone_p"), part(0).alias("gone_n"))
        gone = gone.groupBy(by, "rule_id").agg(F.sum("gone_p").alias("gone_p"), F.sum("gone_n").alias("gone_n"))
        rest = left.join(picks, by).where(F.col("rule_id") != F.col("best")).join(gone, [by, "rule_id"], "left").fillna(0.0, ["gone_p", "gone_n"])
        rest = rest.select(by, "rule_id", (F.col("pos") - F.col("gone_p")).alias("pos"), (F.col("neg") - F.col("gone_n")).alias("neg"), "confidence", "p", "n")
        rest = written(rest.where(F.col("pos") > 1e-12), "residual")
        release(left)
        left = rest


def select_greedy(cover: DataFrame, samples: DataFrame, alpha: float = 0.5) -> list[int]:
    """The rules that select_greedy_by chooses if all samples are one group."""
    p, n = class_weights(samples)
    pairs = cover if "rules" in cover.columns else cover.select("rule_id", "pair_id").distinct().join(samples.select("pair_id", "weight", "label"), "pair_id")
    totals = cover.sparkSession.createDataFrame([(0, float(p), float(n))], "fold int, p double, n double")
    return [rule for _, rule in select_greedy_by(pairs.withColumn("fold", F.lit(0)), totals, alpha)]


def _rounded() -> list[Column]:
    return [F.round("pos", 9).alias("pos"), F.round("neg", 9).alias("neg")]


def _rank(by: str) -> Column:
    """The place of a rule in sequential covering, from its rounded sums."""
    first = -F.round(_ratio(F.col("pos"), F.col("neg"), 1.0), 12) if by == "conf" else F.col("neg")
    return F.struct(first, -F.col("pos"), F.col("rule_id"))


def select_sequential_by(cover: DataFrame, by: str = "fold", rank: str = "conf") -> DataFrame:
    """(by, rule_id) that sequential covering picks in every group of column by; cover: by, rule_id, pair_id, weight, label, distinct.

    A positive pair is gone after one rule, so a rule stays exactly if it is the first of some positive pair. Sums are rounded before ranking.
    """
    part = lambda label: F.sum(F.when(F.col("label") == label, F.col("weight")).otherwise(0.0))
    sums = cover.groupBy(by, "rule_id").agg(part(1).alias("pos"), part(0).alias("neg")).select(by, "rule_id", *_rounded())
    ranked = sums.select(by, "rule_id", _rank(rank).alias("rank"))
    best = cover.where("label = 1").select(by, "rule_id", "pair_id").join(ranked, [by, "rule_id"]).groupBy(by, "pair_id").agg(F.min_by("rule_id", "rank").alias("rule_id"))
    return best.select(by, "rule_id").distinct()


def select_sequential(cover: DataFrame, samples: DataFrame, by: str = "conf", cover_threshold: int = 1) -> DataFrame:
    """rule_ids picked by sequential covering: rules in rank order, each kept if it matches a positive pair still there.

    by "conf" ranks by confidence, by "fpr" by negative weight; then by positive weight and id. A pair is gone after
    cover_threshold rules, so a rule stays exactly if it is among the first cover_threshold rules of some positive pair.
    Sums are rounded before ranking, so that ties don't hang on the order of adding.
    """
    sums = rule_sums(cover, samples).select("rule_id", *_rounded())
    ranked = sums.select("rule_id", _rank(by).alias("rank"))
    if "rules" in cover.columns:
        # Rows of equal rules pick the same ones.
        key = "rules"
        j = cover.where("label = 1").select("rules").distinct().select("rules", F.explode("rules").alias("rule_id")).join(ranked, "rule_id")
    else:
        key = "pair_id"
        j = cover.join(samples.where("label = 1").select("pair_id"), "pair_id", "left_semi").join(ranked, "rule_id")
    if cover_threshold == 1:
        return j.groupBy(key).agg(F.min_by("rule_id", "rank").alias("rule_id")).select("rule_id").distinct()
    order = Window.partitionBy(key).orderBy("rank")
    return j.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= cover_threshold).select("rule_id").distinct()


def non_matching_probability(cover: DataFrame, samples: DataFrame, imbalance: float) -> float:
    """The same ratio over the samples that no rule covers."""
    bare = cover.where(F.size("rules") == 0) if "rules" in cover.columns else samples.join(cover.select("pair_id").distinct(), "pair_id", "left_anti")
    pos, neg = class_weights(bare)
    total = pos + imbalance * neg
    return pos / total if total else 0.0


@dataclass
class DecisionSet:
    """A trained classifier: its rules with probabilities, and the probability of pairs without a rule."""

    rules: DataFrame
    default: float
    both: bool = False
    params: dict = field(default_factory=dict)

    def predict(self, pairs: DataFrame, paths: DataFrame) -> DataFrame:
        """pairs' pair_id with proba, the class (1 only above one half) and the number of rules that match."""
        found = R.cover(self.rules, paths, self.both).join(self.rules.select("rule_id", "proba"), "rule_id")
        per = found.groupBy("pair_id").agg(F.max("proba").alias("p"), F.count("*").alias("n_rules"))
        out = pairs.select("pair_id").join(per, "pair_id", "left")
        proba = F.coalesce("p", F.lit(self.default))
        return out.select("pair_id", proba.alias("proba"), F.when(proba > 1 - proba, 1).otherwise(0).alias("predicted"), F.coalesce("n_rules", F.lit(0)).alias("n_rules"))

    def _probas(self, covered: DataFrame) -> DataFrame:
        """covered with probas, what its rules of this set predict (proba, rule_id), best first."""
        one = F.broadcast(self.rules.agg(F.map_from_entries(F.collect_list(F.struct("rule_id", "proba"))).alias("by_rule__")))  # one row
        each = F.filter(F.transform("rules", lambda r: F.struct(F.try_element_at("by_rule__", r).alias("proba"), r.alias("rule_id"))), lambda x: x["proba"].isNotNull())
        return covered.crossJoin(one).select(*covered.columns, F.sort_array(each, False).alias("probas"))

    def predict_covered(self, covered: DataFrame) -> DataFrame:
        """covered (rules, the ids that match, and any other columns) with proba, predicted and n_rules; no row is shuffled."""
        proba = F.coalesce(F.get("probas", F.lit(0))["proba"], F.lit(self.default))
        out = self._probas(covered).select(*covered.columns, proba.alias("proba"), F.size("probas").cast("long").alias("n_rules"))
        return out.withColumn("predicted", F.when(F.col("proba") > 1 - F.col("proba"), 1).otherwise(0))

    def explained(self, covered: DataFrame) -> DataFrame:
        """covered (rules, the ids that match, and any other columns) with why, an array of rank, rule_id and proba, best first; no row is shuffled."""
        each = self._probas(covered).withColumn("levels", F.array_distinct(F.transform("probas", lambda x: x["proba"])))
        why = F.transform("probas", lambda x: F.struct(F.array_position("levels", x["proba"]).cast("int").alias("rank"), x["rule_id"].alias("rule_id"), x["proba"].alias("proba")))
        return each.select(*covered.columns, why.alias("why"))

    def explain_covered(self, covered: DataFrame) -> DataFrame:
        """What explain gives, from covered (pair_id, rules): pair_id, rank, rule_id, proba."""
        return self.explained(covered.select("pair_id", "rules")).select("pair_id", F.inline("why"))

    def explain(self, paths: DataFrame) -> DataFrame:
        """Matching rules of each pair, best first: pair_id, rank (dense, by probability), rule_id, pattern, proba."""
        found = R.cover(self.rules, paths, self.both).join(self.rules.select("rule_id", "pattern", "proba"), "rule_id")
        return found.withColumn("rank", F.dense_rank().over(Window.partitionBy("pair_id").orderBy(F.desc("proba")))).select("pair_id", "rank", "rule_id", "pattern", "proba")


def fit(rules: DataFrame, cover: DataFrame, samples: DataFrame, alpha: float = 0.5, strategy: str = "greedy", both: bool = False, params: dict | None = None) -> DecisionSet:
    """A decision set from candidate rules and their cover of the training samples."""
    whole = "rules" in cover.columns
    cover = cover if whole else cover.join(samples.select("pair_id"), "pair_id", "left_semi")
    if strategy == "greedy":
        ids = select_greedy(cover, samples, alpha)
        best = F.col("rule_id").isin(ids)
        chosen, kept = rules.where(best), cover if whole else cover.where(best)
        if whole:
            mine = F.array(*[F.lit(i) for i in ids]).cast("array<int>")
            kept = cover.withColumn("rules", F.array_intersect("rules", mine))
    elif strategy in ("conf", "fpr"):
        ids = select_sequential(cover, samples, strategy)
        chosen = rules.join(ids, "rule_id", "left_semi")
        if whole:
            one = F.broadcast(ids.agg(F.collect_list("rule_id").alias("mine__")))  # one row
            kept = cover.crossJoin(one).withColumn("rules", F.array_intersect("rules", "mine__")).drop("mine__")
        else:
            kept = cover.join(ids, "rule_id", "left_semi")
    else:
        raise ValueError(f"unknown strategy {strategy}")
    imbalance = imbalance_ratio(samples)
    probs = rule_sums(kept, samples, imbalance).select("rule_id", F.col("confidence").alias("proba"), "pos", "neg")
    return DecisionSet(chosen.join(probs, "rule_id"), non_matching_probability(kept, samples, imbalance), both, params or {})
