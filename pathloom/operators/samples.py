"""Training, negative and holdout pairs with weights."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions import confidence_level, max_scaled, oriented
from pathloom.operators.graph import Graph
from pathloom.sources.stages import hinted, written

#: Weight of a positive pair is its level over the highest level.
TOP_LEVEL = 3

#: Rows that a task sorts for folds, about.
TASK_ROWS = 2_000_000


def combination_index(g: Graph, combination: str = "OligogenicCombination", gene: str = "Gene", disease: str = "Disease") -> DataFrame:
    """Every combination node with its genes and diseases and, if it has exactly two distinct genes, the oriented pair (a, b)."""
    links = g.adjacency.where((F.col("src_type") == combination) & F.col("dst_type").isin(gene, disease)).select(F.col("src").alias("combination"), "dst", "dst_type").distinct()
    links = links.join(g.nodes.select(F.col("id").alias("dst"), "orient"), "dst")
    per = links.groupBy("combination").agg(
        F.sort_array(F.collect_set(F.when(F.col("dst_type") == gene, F.struct("dst", "orient")))).alias("genes"),
        F.sort_array(F.collect_set(F.when(F.col("dst_type") == disease, F.col("dst")))).alias("disease_nodes"),
    )
    own = g.nodes.where(F.col("node_type") == combination).withColumnRenamed("id", "combination").drop("node_type", "name", "orient")
    out = own.join(per, "combination", "left")
    x, y = F.get("genes", F.lit(0)), F.get("genes", F.lit(1))
    pair = F.when(F.size("genes") == 2, oriented(x["dst"], x["orient"], y["dst"], y["orient"]))
    return out.withColumn("gene_pair", pair).withColumn("genes", F.transform("genes", lambda z: z["dst"]))


def with_levels(combinations: DataFrame) -> DataFrame:
    """Combinations with their evidence level."""
    return combinations.withColumn("level", confidence_level(F.col("FAMmanual"), F.col("STATmeta"), F.col("STATmanual")))


def positive_pairs(combinations: DataFrame, min_level: int = 1) -> DataFrame:
    """Per oriented pair the best level, the first timestamp and all diseases, from combinations (gene_pair, level, timestamp, disease_nodes)."""
    known = combinations.where("gene_pair is not null").select("gene_pair.a", "gene_pair.b", "level", "timestamp", "disease_nodes")
    pairs = known.groupBy("a", "b").agg(
        F.max("level").alias("level"), F.min("timestamp").alias("timestamp"), F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.coalesce("disease_nodes", F.array().cast("array<string>")))))).alias("disease_nodes")
    )
    return pairs.where(F.col("level") >= min_level)


def greedy_holdout(pairs: DataFrame, size: int) -> list[tuple[str, str]]:
    """The latest pairs of which none shares an entity with one taken before, at most size.

    Ties go to the smaller pair. The choice depends on order, so rows stream to the driver one partition
    at a time and reading stops once size pairs are taken.
    """
    taken: list[tuple[str, str]] = []
    used: set[str] = set()
    if size > 0:
        for a, b in pairs.select("a", "b", "timestamp").orderBy(F.desc("timestamp"), "a", "b").select("a", "b").toLocalIterator():
            if a not in used and b not in used:
                used |= {a, b}
                taken.append((a, b))
                if len(taken) == size:
                    break
    return taken


def split_holdout(pairs: DataFrame, size: int, min_level: int = 2) -> tuple[DataFrame, DataFrame]:
    """(training positives, holdout positives): the holdout is drawn from pairs of at least min_level."""
    taken = greedy_holdout(pairs.where(F.col("level") >= min_level), size)
    keys = F.broadcast(pairs.sparkSession.createDataFrame(taken, "a string, b string"))  # at most size rows
    return pairs.join(keys, ["a", "b"], "left_anti"), pairs.join(keys, ["a", "b"], "left_semi")


def resolve_pairs(rows: DataFrame, nodes: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Raw pairs (gene_1, gene_2, weight, line) as oriented pairs (a, b, weight), and the rows with an unknown end.

    key is the node column the raw names stand for. Of a pair given more than once the last line counts; names that
    several nodes carry mean the node with the largest id. Names are looked up in those that the rows have, so that rows are not shuffled for it
    unless these are very many.
    """
    named = rows.select(F.explode(F.array("gene_1", "gene_2")).alias("k")).distinct()
    lookup = nodes.select(F.col(key).alias("k"), "id", "orient").join(named, "k").groupBy("k").agg(F.max(F.struct("id", "orient")).alias("n"))
    lookup = hinted(written(lookup, "lookup"))
    out = rows
    for i in ("1", "2"):
        out = out.join(lookup.select(F.col("k").alias(f"gene_{i}"), F.col("n").alias(f"n{i}")), f"gene_{i}", "left")
    known = F.col("n1").isNotNull() & F.col("n2").isNotNull()
    pair = oriented(F.col("n1.id"), F.col("n1.orient"), F.col("n2.id"), F.col("n2.orient"))
    found = out.where(known).select(pair.alias("p"), "weight", "line").groupBy("p").agg(F.max_by("weight", "line").alias("weight"))
    return found.select("p.a", "p.b", "weight"), out.where(~known).select("gene_1", "gene_2").distinct()


def negatives(rows: DataFrame, nodes: DataFrame, key: str = "id") -> DataFrame:
    """Negative pairs weighted by their share of the largest weight; raises if a pair has an unknown end."""
    found, unknown = resolve_pairs(rows, nodes, key)
    if not unknown.isEmpty():
        raise ValueError("negative pairs with unknown entities")
    found = written(found, "resolved")
    largest = found.agg(F.max("weight")).first()[0]
    return found.withColumn("weight", max_scaled(F.col("weight"), largest or 1.0))


def train_set(train: DataFrame, holdout: DataFrame, neg: DataFrame) -> DataFrame:
    """(pair_id, a, b, weight, label, split) of all samples; a pair that is positive and negative counts as negative."""
    parts = [
        train.select("a", "b", (F.col("level") / TOP_LEVEL).alias("weight"), F.lit(1).alias("label"), F.lit("train").alias("split"), F.lit(0).alias("p")),
        holdout.select("a", "b", (F.col("level") / TOP_LEVEL).alias("weight"), F.lit(1).alias("label"), F.lit("holdout").alias("split"), F.lit(1).alias("p")),
        neg.select("a", "b", "weight", F.lit(0).alias("label"), F.lit("train").alias("split"), F.lit(2).alias("p")),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    last = rows.groupBy("a", "b").agg(F.max(F.struct("p", "weight", "label", "split")).alias("x"))
    return last.select(F.concat_ws("|", "a", "b").alias("pair_id"), "a", "b", "x.weight", "x.label", "x.split")


def stratified_folds(samples: DataFrame, k: int = 10, seed: int = 42) -> DataFrame:
    """samples with fold 0 to k - 1, the classes spread evenly in a hashed order.

    Samples are counted by the first digits of their hash, then sent once to the others of these digits and numbered there; they are not written.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), "pair_id").cast("binary"))
    dealt = samples.withColumn("digits__", F.substring(digest, 1, 3))
    counts = sorted(dealt.groupBy("label", "digits__").count().collect(), key=lambda r: (str(r["label"]), r["digits__"]))
    heads, ahead, last = [], 0, None
    for r in counts:
        ahead = 0 if not heads or r["label"] != last else ahead
        heads.append((r["label"], r["digits__"], ahead))
        ahead, last = ahead + r["count"], r["label"]
    total = sum(r["count"] for r in counts)
    kind = samples.schema["label"].dataType.simpleString()
    heads = F.broadcast(samples.sparkSession.createDataFrame(heads, f"label__ {kind}, of__ string, ahead__ long"))  # at most 4096 rows per class
    tasks = max(int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / TASK_ROWS))
    # The digest's bytes, which sort as its text does; they are not sent.
    order = Window.partitionBy("label", "digits__").orderBy(F.unhex(digest), "pair_id")
    out = dealt.repartition(tasks, "label", "digits__").withColumn("nth__", F.row_number().over(order))
    out = out.join(heads, F.col("label").eqNullSafe(F.col("label__")) & (F.col("digits__") == F.col("of__")))
    return out.select(*samples.columns, ((F.col("ahead__") + F.col("nth__") - 1) % k).cast("int").alias("fold"))
