"""Weighted frequent sets of metapaths, shared-node conditions on them, and closed-set pruning.

Patterns are tables: pattern (its key), mps (sorted metapath keys), k, unif (array of (i, pos): item number
and 1-based inner node, empty without condition), and matches(pattern, pair_id).
"""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.operators.paths import directed
from pathloom.sources.stages import hinted, ordinals, written

ITEM = " + "


def absolute_minsup(samples: DataFrame, ratio: float, weighted: bool = True) -> float:
    """Least support: a share of all weights, or of the number of samples rounded down."""
    w, n = samples.agg(F.sum("weight"), F.count("*")).first()
    return (w or 0.0) * ratio if weighted else float(int(n * ratio))


def transactions(paths: DataFrame, both: bool = False) -> DataFrame:
    """Distinct (pair_id, direction, mp)."""
    return directed(paths.select("pair_id", "edges", "types", "mp", "nodes", "score"), both).select("pair_id", "direction", "mp").distinct()


def _supported(matches: DataFrame, keys: list[str], samples: DataFrame, minsup: float) -> DataFrame:
    """Distinct pairs of each key summed up, under a floor for rounding."""
    per = matches.select(*keys, "pair_id").distinct().join(samples.select("pair_id", "weight"), "pair_id")
    return per.groupBy(*keys).agg(F.sum("weight").alias("support"), F.count("*").alias("n")).where(F.col("support") >= F.lit(minsup - 1e-9))


def frequent_metapaths(tx: DataFrame, samples: DataFrame, minsup: float) -> DataFrame:
    """Single metapaths with enough support: mp, support, n."""
    return _supported(tx, ["mp"], samples, minsup)


#: Pairs in a range of a bitmap, and sets that a task counts in one range.
RANGE, SETS = 1 << 15, 4096


@dataclass
class Bitmaps:
    """Which pairs have which item: for every item, direction and range of pair numbers a bitmap.

    items: item (its place in the order of the metapaths), mp; weights: range_, bit, weights of its pairs; rows: range_, direction, item, bits.
    """

    items: DataFrame
    weights: DataFrame
    rows: DataFrame

    @classmethod
    def of(cls, tx: DataFrame, samples: DataFrame, singles: DataFrame) -> Bitmaps:
        """From transactions of the single metapaths given; samples: pair_id and weights (one for each of several weightings)."""
        items = written(ordinals(singles.select("mp"), "mp", name="item").withColumn("item", F.col("item").cast("int")), "items")
        pairs = ordinals(samples.select("pair_id", "weights"), "pair_id")
        pairs = written(pairs.select("pair_id", "weights", F.floor(F.col("n") / RANGE).cast("int").alias("range_"), (F.col("n") % RANGE).alias("bit")), "numbers")
        at = tx.join(hinted(items), "mp").join(pairs.select("pair_id", "range_", "bit"), "pair_id")
        bits = at.groupBy("range_", "direction", "item").agg(F.bitmap_construct_agg("bit").alias("bits"))
        return cls(items, pairs.select("range_", "bit", "weights"), written(bits, "bitmaps"))


def _range_of(bits: pa.Table, weights: pa.Table) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Of one range: the items in order, their bitmaps (items x bytes) for each direction, and the weights of its pairs (pairs x weightings)."""
    item, direction = np.asarray(bits.column("item")), np.asarray(bits.column("direction"))
    raw = np.frombuffer(b"".join(bits.column("bits").to_pylist()), np.uint8).reshape(len(item), -1)[:, : RANGE // 8]
    items = np.unique(item)
    sides = []
    for d in np.unique(direction):
        side = np.zeros((len(items), RANGE // 8), np.uint8)
        mine = direction == d
        side[np.searchsorted(items, item[mine])] = raw[mine]
        sides.append(side)
    rows = np.array(weights.column("weights").to_pylist(), np.float64)
    table = np.zeros((RANGE, rows.shape[1]))
    table[np.asarray(weights.column("bit"))] = rows
    return items, sides, table


def _counted(kept: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and numbers of the pairs in bitmaps (sets x bytes), for each weighting."""
    bits = np.unpackbits(kept, axis=1, bitorder="little").astype(np.float64)
    return bits @ table, bits @ (table > 0)


_COUNTS = pa.schema([("items", pa.list_(pa.int32())), ("support", pa.list_(pa.float64())), ("n", pa.list_(pa.int64()))])


def _as_table(sets: list, support: list, n: list) -> pa.Table:
    return pa.table([pa.array(sets, pa.list_(pa.int32())), pa.array(support, pa.list_(pa.float64())), pa.array(n, pa.list_(pa.int64()))], schema=_COUNTS)


def _count_twos(key: tuple, bits: pa.Table, weights: pa.Table) -> pa.Table:
    """Support of all sets of two items in a range, those with a smaller item of the task's block."""
    block, blocks = key[1].as_py(), key[2].as_py()
    out: tuple[list, list, list] = ([], [], [])
    if bits.num_rows and weights.num_rows:
        items, sides, table = _range_of(bits, weights)
        for i in np.flatnonzero(items % blocks == block):
            for begin in range(i + 1, len(items), 256):
                stop = min(begin + 256, len(items))
                kept = np.bitwise_or.reduce([side[i] & side[begin:stop] for side in sides])
                support, n = _counted(kept, table)
                for j in np.flatnonzero(kept.any(1)):
                    for column, value in zip(out, ([items[i], items[begin + j]], support[j], n[j].astype(np.int64)), strict=True):
                        column.append(value)
    return _as_table(*out)


def _count_sets(key: tuple, bits: pa.Table, sets: pa.Table) -> pa.Table:
    """Support of the task's sets in a range."""
    out: tuple[list, list, list] = ([], [], [])
    if bits.num_rows and sets.num_rows:
        is_bits = np.asarray(bits.column("is_bits"))
        items, sides, table = _range_of(bits.filter(pa.array(is_bits)), bits.filter(pa.array(~is_bits)))
        wanted = np.array(sets.column("items").to_pylist())
        at = np.minimum(np.searchsorted(items, wanted), len(items) - 1)
        there = np.flatnonzero((items[at] == wanted).all(1))
        for begin in range(0, there.size, 256):
            rows = there[begin : begin + 256]
            kept = np.bitwise_or.reduce([np.bitwise_and.reduce([side[at[rows, i]] for i in range(wanted.shape[1])]) for side in sides])
            support, n = _counted(kept, table)
            for j in np.flatnonzero(kept.any(1)):
                for column, value in zip(out, (wanted[rows[j]], support[j], n[j].astype(np.int64)), strict=True):
                    column.append(value)
    return _as_table(*out)


def _summed(parts: DataFrame, minsup: Sequence[float], mps: Column) -> DataFrame:
    """Counts of all ranges together, of sets with enough support in some weighting: mps, items, supports, ns."""
    folds = range(len(minsup))
    total = parts.groupBy("items").agg(*[F.sum(F.get("support", F.lit(f))).alias(f"s{f}") for f in folds], *[F.sum(F.get("n", F.lit(f))).alias(f"n{f}") for f in folds])
    enough = functools.reduce(lambda a, b: a | b, [F.col(f"s{f}") >= F.lit(minsup[f] - 1e-9) for f in folds])
    return total.where(enough).select(mps.alias("mps"), "items", F.array(*[F.col(f"s{f}") for f in folds]).alias("supports"), F.array(*[F.col(f"n{f}") for f in folds]).alias("ns"))


def count_twos(maps: Bitmaps, blocks: int) -> DataFrame:
    """(items, support, n) of sets of two by range; a range's bitmaps go to blocks tasks, each for some of the smaller items."""
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    left = maps.rows.select("range_", every, F.lit(blocks).alias("blocks"), "direction", "item", "bits").groupBy("range_", "block", "blocks")
    right = maps.weights.select("range_", every, F.lit(blocks).alias("blocks"), "bit", "weights").groupBy("range_", "block", "blocks")
    return left.cogroup(right).applyInArrow(_count_twos, "items array<int>, support array<double>, n array<long>")


def count_sets(maps: Bitmaps, sets: DataFrame, n_sets: int) -> DataFrame:
    """(items, support, n) of the sets given by range; every range meets them in blocks of SETS."""
    blocks = -(-n_sets // SETS)
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    none = lambda t: F.lit(None).cast(t)
    bits = maps.rows.select("range_", F.lit(True).alias("is_bits"), "direction", "item", "bits", none("long").alias("bit"), none("array<double>").alias("weights"))
    weights = maps.weights.select("range_", F.lit(False).alias("is_bits"), none("int").alias("direction"), none("int").alias("item"), none("binary").alias("bits"), "bit", "weights")
    left = bits.unionByName(weights).withColumn("block", every)
    ranges = maps.rows.groupBy("range_").agg(F.lit(1).alias("one"))
    # The ranges' numbers, a few bytes each, are what every set is sent to.
    ranges = ranges.groupBy("one").agg(F.collect_list("range_").alias("ranges"))
    right = sets.select("items", F.pmod(F.xxhash64("items"), F.lit(blocks)).cast("int").alias("block"), F.lit(1).alias("one")).join(F.broadcast(ranges), "one")
    right = right.select("items", "block", F.explode("ranges").alias("range_"))
    return left.groupBy("range_", "block").cogroup(right.groupBy("range_", "block")).applyInArrow(_count_sets, "items array<int>, support array<double>, n array<long>")


def candidates(sets: DataFrame) -> DataFrame:
    """Sets one item larger (items) of which all smaller subsets are among the sets: joined on all but their last item, then checked."""
    head, last = F.slice("items", 1, F.size("items") - 1), F.element_at("items", -1)
    one = sets.select(head.alias("head"), last.alias("a"))
    grown = one.join(one.select("head", F.col("a").alias("b")), "head").where("a < b").select(F.concat("head", F.array("a", "b")).alias("items"))
    return subsets_frequent(grown, sets, "items")


def grow_weighted(tx: DataFrame, samples: DataFrame, minsups: Sequence[float], max_len: int = 3) -> dict[int, DataFrame]:
    """By size from 2, the sets with enough support in some weighting: mps, items, supports and ns, one for each. samples: pair_id, weights.

    Transactions become bitmaps once; then every level counts its candidates range by range (AND of the items'
    bitmaps in each direction, OR over directions, weighted bit counts), so what is shuffled are bitmaps, candidates and
    one count per candidate and range, never the combinations of a transaction.
    """
    per = tx.select("mp", "pair_id").distinct().join(samples, "pair_id").groupBy("mp").agg(*[F.sum(F.get("weights", F.lit(f))).alias(f"s{f}") for f in range(len(minsups))])
    enough = functools.reduce(lambda a, b: a | b, [F.col(f"s{f}") >= F.lit(m - 1e-9) for f, m in enumerate(minsups)])
    singles = written(per.where(enough).select("mp"), "singles")
    n_items = singles.count()
    out: dict[int, DataFrame] = {}
    if n_items < 2:
        empty = tx.sparkSession.createDataFrame([], "mps array<string>, items array<int>, supports array<double>, ns array<long>")
        return {2: empty} if max_len >= 2 else {}
    maps = Bitmaps.of(tx, samples, singles)
    # A few items in all would not fill a block; many are dealt so that a task has SETS / 8 smaller items at most.
    names = hinted(maps.items.select("item", "mp"), n_items)
    for k in range(2, max_len + 1):
        if k == 2:
            counts = count_twos(maps, -(-n_items * 8 // SETS))
        else:
            wanted = written(candidates(out[k - 1].select("items")), "candidates")
            n_wanted = wanted.count()
            if not n_wanted:
                out[k] = out[k - 1].limit(0)
                continue
            counts = count_sets(maps, wanted, n_wanted)
        good = _summed(counts, minsups, F.lit(None).cast("array<string>")).drop("mps")
        spelt = good.select("items", "supports", "ns", F.posexplode("items").alias("at", "item")).join(names, "item").groupBy("items").agg(
            F.transform(F.sort_array(F.collect_list(F.struct("at", "mp"))), lambda x: x["mp"]).alias("mps"), F.any_value("supports").alias("supports"), F.any_value("ns").alias("ns")
        )
        out[k] = written(spelt.select("mps", "items", "supports", "ns"), "sets")
    return out


def grow_sets(tx: DataFrame, samples: DataFrame, minsup: float, max_len: int = 3) -> dict[int, tuple[DataFrame, DataFrame]]:
    """By size from 2: (sets with mps, support, n; their matches with mps, pair_id, direction)."""
    levels = grow_weighted(tx, samples.select("pair_id", F.array("weight").alias("weights")), [minsup], max_len)
    one = lambda sets: sets.select("mps", F.get("supports", F.lit(0)).alias("support"), F.get("ns", F.lit(0)).alias("n"))
    return {k: (one(sets), matched(sets, tx)) for k, sets in levels.items()}


def matched(sets: DataFrame, tx: DataFrame) -> DataFrame:
    """mps, pair_id and direction of the transactions that hold all items of a set."""
    j = sets.select("mps", F.explode("mps").alias("mp")).join(tx, "mp")
    return j.groupBy("mps", "pair_id", "direction").agg(F.count("*").alias("c")).where(F.col("c") == F.size("mps")).select("mps", "pair_id", "direction")


def subsets_frequent(sets: DataFrame, smaller: DataFrame, by: str = "mps") -> DataFrame:
    """Of candidate sets (column by), those of which every subset with one item less is among the smaller sets."""
    parts = sets.select(by, F.explode(F.transform(F.sequence(F.lit(1), F.size(by)), lambda i: F.filter(by, lambda x, j: j + 1 != i))).alias("sub"))
    missing = parts.join(smaller.select(F.col(by).alias("sub")), "sub", "left_anti").select(by).distinct()
    return sets.join(missing, by, "left_anti")


def set_patterns(levels: dict[int, tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Patterns without conditions and their matches. Single metapaths are no patterns."""
    none = F.array().cast("array<struct<i:int,pos:int>>")
    patterns = matches = None
    for k, (sets, found) in levels.items():
        p = sets.select(F.array_join("mps", ITEM).alias("pattern"), "mps", F.lit(k).alias("k"), none.alias("unif"), "support", "n")
        m = found.select(F.array_join("mps", ITEM).alias("pattern"), "pair_id").distinct()
        patterns, matches = (p, m) if patterns is None else (patterns.unionByName(p), matches.unionByName(m))
    return patterns, matches


def inner_types(mps: Column) -> Column:
    """Inner node types of each metapath key, distinct per metapath."""
    return F.flatten(F.transform(mps, lambda m: F.array_distinct(F.filter(F.split(m, "/"), lambda _, i: i % 2 == 1))))


def unifiable(patterns: DataFrame) -> DataFrame:
    """Patterns in which an inner node type occurs in two metapaths at least."""
    types = inner_types(F.col("mps"))
    return patterns.where(F.size(types) > F.size(F.array_distinct(types)))


def shared_nodes(patterns: DataFrame, paths: DataFrame, both: bool = False) -> DataFrame:
    """Distinct (pattern, unif, pair_id) where paths of two or more metapaths of a pattern share a node, as the condition unif says; written."""
    items = unifiable(patterns).select("pattern", "mps", "k", F.posexplode("mps").alias("i", "mp"))
    # By pair alone, before patterns multiply the paths: what follows needs no further shuffle until spots are written.
    used = directed(paths, both).select("pair_id", "direction", "mp", "nodes").join(hinted(items.select("mp").distinct()), "mp", "left_semi")
    hits = used.repartition("pair_id").join(hinted(items), "mp")
    whole = Window.partitionBy("pattern", "pair_id", "direction")
    spots = hits.withColumn("c", F.size(F.collect_set("i").over(whole))).where("c = k").select("pattern", "pair_id", "direction", "i", F.posexplode("nodes").alias("p", "node"))
    spots = written(spots.select("pattern", "pair_id", "direction", "node", F.struct("i", (F.col("p") + 1).alias("pos")).alias("s")).distinct(), "spots")
    key = ["pattern", "pair_id", "direction", "node"]
    level = found = spots.withColumnRenamed("s", "t").join(spots, key).where("t.i < s.i").select(*key, F.array("t", "s").alias("unif"))
    largest = patterns.agg(F.max("k")).first()[0] or 0
    for size in range(3, largest + 1):
        # A level is read by the next and for the result: written where it would be worked out again and again.
        level = level.join(spots, key).where(F.element_at("unif", -1)["i"] < F.col("s.i")).select(*key, F.concat("unif", F.array("s")).alias("unif"))
        level = written(level, "shared") if size < largest else level
        found = found.unionByName(level)
    return written(found.select("pattern", "unif", "pair_id").distinct(), "shared")


def conditioned(conditions: DataFrame, patterns: DataFrame) -> DataFrame:
    """Conditions (pattern, unif and columns of their own) as patterns: named after pattern and condition, with mps and k of the former."""
    name = F.concat_ws(" ", F.col("pattern"), F.lit("@"), unif_text(F.col("unif")))
    return conditions.join(patterns.select("pattern", "mps", "k"), "pattern").withColumn("pattern", name)


def unifications(patterns: DataFrame, paths: DataFrame, samples: DataFrame, minsup: float, both: bool = False) -> tuple[DataFrame, DataFrame]:
    """Patterns with a condition that paths of two or more of their metapaths share a node, and their matches."""
    found = shared_nodes(patterns, paths, both)
    good = _supported(found, ["pattern", "unif"], samples, minsup)
    matches = conditioned(found.join(good.select("pattern", "unif"), ["pattern", "unif"]), patterns).select("pattern", "pair_id")
    return conditioned(good, patterns).select("pattern", "mps", "k", "unif", "support", "n"), matches


def unif_text(unif: Column) -> Column:
    return F.array_join(F.transform(unif, lambda x: F.concat_ws(":", x["i"].cast("string"), x["pos"].cast("string"))), ",")


def closed_patterns(patterns: DataFrame, strict: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Patterns that no pattern one level up replaces; with columns by, none that agrees in these.

    A level is the number of metapaths, one more with a condition. As the rule has always been applied, a
    pattern goes if some pattern one level up holds its first metapath and matches at least as many pairs;
    strict asks that it hold all of them.
    """
    p = patterns.withColumn("level", F.col("k") + F.when(F.size("unif") > 0, 1).otherwise(0))
    if not strict:
        up = p.select((F.col("level") - 1).alias("level"), F.explode("mps").alias("first"), "n", *by).groupBy("level", "first", *by).agg(F.max("n").alias("most"))
        out = p.withColumn("first", F.get("mps", F.lit(0))).join(up, ["level", "first", *by], "left")
        return out.where("most is null or n > most").select(*patterns.columns)
    above = p.select((F.col("level") - 1).alias("level"), F.explode("mps").alias("first"), F.col("mps").alias("others"), F.col("n").alias("m"), *by)
    j = p.withColumn("first", F.get("mps", F.lit(0))).join(above, ["level", "first", *by], "left")
    inside = (F.size(F.array_except("mps", "others")) == 0) & (F.col("n") <= F.col("m"))
    gone = j.where(F.coalesce(inside, F.lit(False))).select("pattern", *by).distinct()
    return patterns.join(gone, ["pattern", *by], "left_anti")
