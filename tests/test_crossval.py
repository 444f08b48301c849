"""Cross-validation in one plan against one training after the other."""

import math
import os

import pytest
from pyspark.sql import functions as F

from pathloom.operators import decision_set, metrics, samples
from pathloom.plans import crossval, workflow
from pathloom.plans.fixture import fixture
from pathloom.plans.params import Params
from pathloom.sources.stages import written

DIR = "/root/testdata/sf0.001"
FOLDS = 3

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def every(spark):
    k = fixture(spark, DIR)
    split = F.when((F.col("label") == 1) & (F.crc32("pair_id") % 9 == 0), "holdout").otherwise("train")
    return written(samples.stratified_folds(k.samples.withColumn("split", split), FOLDS), "folds")


def one_by_one(found, every, params):
    """Rules, scores and metrics of each fold, trained on its own."""
    ruled, scores, rows = {}, {}, []
    for f in range(FOLDS):
        test = every.where(F.col("fold") == f)
        model, _, _ = workflow.fit(found, every.where((F.col("fold") != f) & (F.col("split") == "train")), params)
        scored = written(model.predict(test, found).join(test.select("pair_id", "weight", F.col("label").alias("y")), "pair_id").withColumn("proba", F.round("proba", 12)), "scored")
        ruled |= {(f, r.pattern): (r.thresholds, round(r.proba, 9)) for r in model.rules.collect()}
        scores |= {(f, r.pair_id): (round(r.proba, 9), r.predicted, r.n_rules) for r in scored.collect()}
        rows.append((f, *metrics.performance(scored).first()))
    return ruled, scores, rows


@pytest.mark.parametrize(
    "params",
    [
        Params(minsup_ratio=0.1, max_rule_length=2),
        Params(minsup_ratio=0.05, optimize_metapath_thresholds=False, orient_gene_pairs=False, max_fpr=0.5, strategy="conf"),
        Params(minsup_ratio=0.05, optimize_metapath_thresholds=False, strategy="fpr", max_rule_length=2),
    ],
)
def test_same_as_fold_after_fold(spark, every, params):
    found = fixture(spark, DIR).all_paths
    done = crossval.cross_validate(found, every, params, FOLDS)
    ruled, scores, rows = one_by_one(found, every, params)
    assert len(ruled) > FOLDS
    assert {(r.fold, r.pattern): (r.thresholds, round(r.proba, 9)) for r in done.rules.collect()} == ruled
    assert {(r.fold, r.pair_id): (round(r.proba, 9), r.predicted, r.n_rules) for r in done.scored.collect()} == scores
    got = sorted(done.metrics.collect())
    assert [r.fold for r in got] == [0, 1, 2]
    for a, b in zip(got, rows, strict=True):
        assert all(x == pytest.approx(y, abs=1e-9) or (math.isnan(x) and math.isnan(y)) for x, y in zip(a, b, strict=True))


def test_number_of_jobs_does_not_depend_on_the_number_of_folds(spark, every):
    found, params = fixture(spark, DIR).all_paths, Params(minsup_ratio=0.1, optimize_metapath_thresholds=False, compute_unifications=False, strategy="conf")
    jobs = []
    for folds in (2, 6):
        mine = written(samples.stratified_folds(every.drop("fold"), folds), "folds")
        group = f"folds-{folds}"
        spark.sparkContext.setJobGroup(group, group)
        assert crossval.cross_validate(found, mine, params, folds).metrics.count() == folds
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] and jobs[1] <= 1.2 * jobs[0]


def test_folds_without_rules_positives_or_paths(spark, every):
    found = fixture(spark, DIR).all_paths
    plain = Params(minsup_ratio=0.9)
    for rows, paths in ((every, found.limit(0)), (every.where("label = 0"), found), (every.limit(0), found)):
        done = crossval.cross_validate(paths, written(rows, "few"), plain, FOLDS)
        assert done.rules.count() == 0 and done.scored.count() == rows.count()
        assert {r.n_rules for r in done.scored.collect()} <= {0}
        assert done.metrics.count() == rows.select("fold").distinct().count()


def test_greedy_groups_are_told_apart(spark):
    """Two groups with the same cover under different weights, against one selection each."""
    rows = [(f, rule, pair, w, label) for f, heavy in ((0, "a"), (1, "c")) for rule, pairs in ((1, "abx"), (2, "cy"), (3, "abcxyz"), (4, "xz")) for pair in pairs for w in (3.0 if pair == heavy else 1.0,) for label in (int(pair in "abc"),)]
    cover = spark.createDataFrame(rows, "fold int, rule_id int, pair_id string, weight double, label int")
    totals = spark.createDataFrame([(0, 5.0, 5.0), (1, 5.0, 5.0)], "fold int, p double, n double")
    got = decision_set.select_greedy_by(cover, totals, 0.5)
    for f in (0, 1):
        mine = cover.where(F.col("fold") == f)
        whole = mine.select("pair_id", "weight", "label").distinct().unionByName(spark.createDataFrame([("u", 1.0, 0), ("v", 1.0, 0)], "pair_id string, weight double, label int"))
        assert [r for g, r in got if g == f] == decision_set.select_greedy(mine.select("rule_id", "pair_id"), whole)
    assert [r for g, r in got if g == 0] != [r for g, r in got if g == 1]
