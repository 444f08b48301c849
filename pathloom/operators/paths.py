"""Bounded simple paths between entity pairs, as joins over the adjacency, split at heavy nodes.

Half paths grow from the distinct first ends and towards the distinct second ends, not from pairs. A node is heavy if its
degree is above the square root of the number of edges: there are few of them, and a light one multiplies a half by
that root at most. Halves stop at heavy nodes, they never grow out of one:

* Paths without a heavy inner node meet in their middle, as do those whose only heavy one is there.
* A path whose only heavy inner node is elsewhere meets there: one half has come to it step by step, the other stops
  one step after its own end.
* Between a first and a last heavy node, the stretch is walked once for all pairs (stretches from heavy to heavy nodes are
  few) and closes the two halves of a pair.

Where two halves meet, every meeting node takes the cheapest of three ways, by the rows that each would make: near and far halves are
joined on the node and then looked up among the pairs; or one of the halves, near or far, takes the pairs of its end and meets the other on
node and end together. So a node of few halves never multiplies by the pairs of an end, and a hub joins only what some pair asks for.
A stretch goes to the half for which it branches less. Far halves take their last step to nodes that some near half has reached only.
Forbidden node types, non-positive scores and broken contexts are dropped at
every hop, so no doomed path grows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions import combined_context, context_valid, metapath_key
from pathloom.sources.stages import hinted, written


def _grown(half: DataFrame, hops: DataFrame, forward: bool) -> DataFrame:
    """Half paths one hop longer, out of light tips: end, its number of pairs, tip, its type and weight, inner nodes, their types, labels, logs, context count and contexts."""
    step = hops.select(F.col("src").alias("tip"), F.col("dst").alias("to"), F.col("dst_type").alias("to_type"), F.col("dst_heavy").alias("to_heavy"), "label", "log", "c", "ctx")
    first = "tip_type" not in half.columns
    j = half if first else half.where(~F.col("tip_heavy"))
    j = j.alias("h").join(step.alias("s"), "tip").where((F.col("s.to") != F.col("h.end")) & ~F.array_contains("h.nodes", F.col("s.to")))
    grow = lambda a, x: F.concat(a, F.array(x)) if forward else F.concat(F.array(x), a)
    out = j.select(
        "h.end",
        "h.m",
        F.col("s.to").alias("tip"),
        F.col("s.to_type").alias("tip_type"),
        F.col("s.to_heavy").alias("tip_heavy"),
        F.col("h.nodes") if first else grow(F.col("h.nodes"), F.col("tip")).alias("nodes"),
        F.col("h.types") if first else grow(F.col("h.types"), F.col("h.tip_type")).alias("types"),
        grow(F.col("h.edges"), F.col("s.label")).alias("edges"),
        (F.col("h.log") + F.col("s.log")).alias("log"),
        (F.col("h.c") + F.col("s.c")).alias("c"),
        combined_context(F.col("h.c"), F.col("h.ctx"), F.col("s.c"), F.col("s.ctx")).alias("ctx"),
    )
    return out.where(context_valid(F.col("c"), F.col("ctx")))


def _start(ends: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    return ends.select("end", "m", F.col("end").alias("tip"), none.alias("nodes"), none.alias("types"), none.alias("edges"), F.lit(0.0).alias("log"), F.lit(0).alias("c"), none.alias("ctx"))


def heavy_nodes(adjacency: DataFrame, above: int | None = None) -> DataFrame:
    """(id) of nodes with more than above edges, the square root of the number of edges if not given; written."""
    above = math.isqrt(adjacency.count()) if above is None else above
    return written(adjacency.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n")).where(F.col("n") > above).select("id"), "heavy")


def flagged(adjacency: DataFrame, heavy: DataFrame, forbidden: Sequence[str] = ()) -> DataFrame:
    """The hops that paths may take: src, dst, their types and whether they are heavy, label, log of the score, context count and contexts."""
    hops = adjacency.where(F.col("score") > 0)
    if forbidden:
        hops = hops.where(~F.col("dst_type").isin(*forbidden))
    has = F.col("ctx").isNotNull()
    hops = hops.select("src", "dst", "src_type", "dst_type", "label", F.ln("score").alias("log"), F.when(has, 1).otherwise(0).alias("c"), F.coalesce("ctx", F.array().cast("array<string>")).alias("ctx"))
    few = hinted(heavy)
    for side in ("src", "dst"):
        mark = few.select(F.col("id").alias(side), F.lit(True).alias(f"{side}_mark"))
        hops = hops.join(mark, side, "left").withColumn(f"{side}_heavy", F.coalesce(f"{side}_mark", F.lit(False))).drop(f"{side}_mark")
    return hops


def halves(pairs: DataFrame, hops: DataFrame, cutoff: int) -> tuple[dict[int, DataFrame], dict[int, DataFrame]]:
    """Near and far half paths by number of hops, from 0; written. Of the longest ones only what can meet the other side: heavy tips, or nodes reached by it."""
    turned = {"src": "dst", "dst": "src", "src_type": "dst_type", "dst_type": "src_type", "src_heavy": "dst_heavy", "dst_heavy": "src_heavy"}
    # The far half walks edges against their direction, so its targets are what it starts from.
    back = hops.select([F.col(turned.get(c, c)).alias(c) for c in hops.columns])
    ends = lambda side: pairs.groupBy(F.col(side).alias("end")).agg(F.count("*").alias("m"))
    near, far = {0: _start(written(ends("a"), "ends"))}, {0: _start(written(ends("b"), "ends"))}
    # Ends are few, so the hops needn't be shuffled to meet them.
    few = {True: hinted(near[0]), False: hinted(far[0])}
    middle = cutoff // 2
    for half, most, steps, forward in ((near, middle, hops, True), (far, cutoff - middle, back, False)):
        for k in range(1, max(cutoff, 2)):
            last = k == cutoff - 1
            step = steps.where("dst_heavy") if last and k > most else steps
            if last and k == most > 1 and not forward:
                # The longest far half only meets the near half of the other hops (with two hops at most, it also meets first ends).
                reached = near[cutoff - k].select(F.col("tip").alias("dst")).distinct()
                step = steps.join(reached, "dst", "left_semi")
            # Several lengths meet at each half.
            half[k] = written(_grown(half[k - 1] if k > 1 else few[forward], step, forward), "half")
    return near, far


class Walks:
    """What paths of at most cutoff hops between ends (end) are put together from, made once for any pairs of these: heavy nodes, hops, half paths, stretches.

    heavy_above: the degree above which a node is heavy; it changes the work only.
    """

    def __init__(self, ends: DataFrame, adjacency: DataFrame, cutoff: int = 3, forbidden: Sequence[str] = (), heavy_above: int | None = None):
        self.cutoff, self._ends, self._adjacency, self._forbidden, self._above = cutoff, ends, adjacency, forbidden, heavy_above

    @cached_property
    def heavy(self) -> DataFrame:
        return heavy_nodes(self._adjacency, self._above)

    @cached_property
    def hops(self) -> DataFrame:
        return flagged(self._adjacency, self.heavy, self._forbidden)

    @cached_property
    def halves(self) -> tuple[dict[int, DataFrame], dict[int, DataFrame]]:
        return halves(self._ends.select(F.col("end").alias("a"), F.col("end").alias("b")), self.hops, self.cutoff)

    @cached_property
    def stretches(self) -> dict[int, tuple[DataFrame, DataFrame]]:
        return {} if self.heavy.isEmpty() else stretches(self.heavy, self.hops, self.cutoff - 2)

    def of_pairs(self, pairs: DataFrame) -> tuple[dict[int, DataFrame], dict[int, DataFrame]]:
        """The halves from the ends of pairs (a, b) only, each with the number of pairs of its end."""
        counts = [hinted(written(pairs.groupBy(F.col(side).alias("end")).agg(F.count("*").alias("m")), "ends")) for side in ("a", "b")]
        return tuple({k: half.drop("m").join(m, "end") for k, half in mine.items()} for mine, m in zip(self.halves, counts, strict=True))


def enumerate_paths(pairs: DataFrame, adjacency: DataFrame, cutoff: int = 3, forbidden: Sequence[str] = (), heavy_above: int | None = None, walks: Walks | None = None) -> DataFrame:
    """All simple paths of at most cutoff edges of each pair (pair_id, a, b).

    Columns: pair_id, edges, types (labels and inner node types in order), mp (their key), nodes (inner
    nodes) and score (geometric mean of the edges' scores; of parallel edges the best). No edge of a path
    leads to a forbidden type. heavy_above: the degree above which a node is heavy; it changes the work only. walks: half paths of all ends, made before
    from the same adjacency, cutoff and forbidden types.
    """
    heavy = walks.heavy if walks else heavy_nodes(adjacency, heavy_above)
    any_heavy = not heavy.isEmpty()
    hops = walks.hops if walks else flagged(adjacency, heavy, forbidden)
    # Without parallel edges every path is found once.
    # Two edges of one hash only cost the grouping of paths that parallel ones need.
    parallel = not hops.groupBy(F.xxhash64("src", "dst", "label").alias("edge")).count().where("count > 1").isEmpty()
    near, far = walks.of_pairs(pairs) if walks else halves(pairs, hops, cutoff)
    pairs = pairs.select("pair_id", "a", "b")
    parts = []
    tip = F.col("tip_heavy")
    bridges = walks.stretches if walks else stretches(heavy, hops, cutoff - 2) if any_heavy else {}
    for length in range(1, cutoff + 1):
        f = length // 2
        parts.append(met(pairs, near[f], far[length - f], f > 0))
        if any_heavy:
            for i in range(1, length):
                if i != f:
                    parts.append(met(pairs, near[i].where(tip), far[length - i].where(tip), True))
                for j in range(i + 1, length):
                    if j - i in bridges:
                        by_near, by_far = bridges[j - i]
                        parts.append(met(pairs, _bridged(near[i].where(tip), by_near), far[length - j].where(tip), True))
                        parts.append(met(pairs, near[i].where(tip), _bridged_far(by_far, far[length - j].where(tip)), True))
    none = F.lit(None).cast("array<string>")
    found = pairs.limit(0).select("pair_id", none.alias("edges"), none.alias("types"), none.alias("nodes"), F.lit(0.0).alias("log"))
    direct = [part[_DIRECT] for part in parts if _DIRECT in part]
    if direct:
        # Looked up among the pairs all at once.
        found = found.unionByName(reduce(DataFrame.unionByName, direct).join(pairs, ["a", "b"]).drop("a", "b"))
    for part in parts:
        for way in (_BY_NEAR, _BY_FAR):
            found = found.unionByName(part[way]) if way in part else found
    if parallel:
        found = found.groupBy("pair_id", "edges", "types", "nodes").agg(F.max("log").alias("log"))
    return found.select("pair_id", "edges", "types", metapath_key(F.col("edges"), F.col("types")).alias("mp"), "nodes", F.exp(F.col("log") / F.size("edges")).alias("score"))


def stretches(heavy: DataFrame, hops: DataFrame, longest: int) -> dict[int, tuple[DataFrame, DataFrame]]:
    """Simple stretches from heavy to heavy nodes by number of hops, from 1 to longest, where there are any; they may pass any node.

    Of each length those that branch less at their first node than at their last one, and the others.
    """
    walked = {0: _start(heavy.select(F.col("id").alias("end"), F.lit(0).cast("long").alias("m")))}
    out = {}
    for k in range(1, longest + 1):
        step = hops.where("src_heavy") if k == 1 else hops
        # Here heavy nodes are passed, too: growing out of them is what a stretch is for.
        walked[k] = written(_grown(walked[k - 1].withColumn("tip_heavy", F.lit(False)) if k > 1 else walked[0], step.where("dst_heavy") if k == longest else step, True), "stretch")
        here = walked[k].where("tip_heavy")
        if not here.isEmpty():
            for side, n in (("end", "n_end"), ("tip", "n_tip")):
                here = here.join(walked[k].where("tip_heavy").groupBy(side).agg(F.count("*").alias(n)), side)
            out[k] = (here.where("n_end <= n_tip"), here.where("n_end > n_tip"))
    return out


def _together(x: str, y: str, middle: bool) -> list[Column]:
    """Two joined half paths as one: labels, types and nodes in order, logs, context count and contexts."""
    between, between_type = ([F.array(f"{x}.tip")], [F.array(f"{x}.tip_type")]) if middle else ([], [])
    return [
        F.concat(f"{x}.edges", f"{y}.edges").alias("edges"),
        F.concat(f"{x}.types", *between_type, f"{y}.types").alias("types"),
        F.concat(f"{x}.nodes", *between, f"{y}.nodes").alias("nodes"),
        (F.col(f"{x}.log") + F.col(f"{y}.log")).alias("log"),
        (F.col(f"{x}.c") + F.col(f"{y}.c")).alias("c"),
        combined_context(F.col(f"{x}.c"), F.col(f"{x}.ctx"), F.col(f"{y}.c"), F.col(f"{y}.ctx")).alias("ctx"),
    ]


def _apart(x: str, y: str) -> Column:
    """Whether two half paths that meet share no other node: neither's outer end is the other's, nor inside the other."""
    return (F.col(f"{x}.end") != F.col(f"{y}.end")) & ~F.array_contains(f"{x}.nodes", F.col(f"{y}.end")) & ~F.array_contains(f"{y}.nodes", F.col(f"{x}.end")) & ~F.arrays_overlap(f"{x}.nodes", f"{y}.nodes")


def _bridged(near: DataFrame, stretch: DataFrame) -> DataFrame:
    """Near half paths, which end at a heavy node, walked on along a stretch."""
    j = near.alias("x").join(stretch.alias("y"), F.col("x.tip") == F.col("y.end"))
    shared = F.arrays_overlap("x.nodes", "y.nodes") | F.array_contains("x.nodes", F.col("y.tip")) | F.array_contains("y.nodes", F.col("x.end")) | (F.col("y.tip") == F.col("x.end"))
    out = j.where(~shared).select("x.end", "x.m", F.col("y.tip").alias("tip"), F.col("y.tip_type").alias("tip_type"), *_together("x", "y", True))
    return out.where(context_valid(F.col("c"), F.col("ctx")))


def _bridged_far(stretch: DataFrame, far: DataFrame) -> DataFrame:
    """Far half paths, which end at a heavy node, walked back along a stretch."""
    j = stretch.alias("x").join(far.alias("y"), F.col("x.tip") == F.col("y.tip"))
    out = j.where(_apart("x", "y")).select("y.end", "y.m", F.col("x.end").alias("tip"), *_together("x", "y", True))
    return out.where(context_valid(F.col("c"), F.col("ctx")))


#: How halves meet at a node: joined there and looked up among the pairs, or the near or the far ones taking the pairs of their end.
_DIRECT, _BY_NEAR, _BY_FAR = 0, 1, 2


def met(pairs: DataFrame, near: DataFrame, far: DataFrame, middle: bool) -> dict[int, DataFrame]:
    """Paths of pairs (pair_id, a, b) from near half paths of their first ends and far ones of their second ends that end at the same node and share no other.

    middle: the meeting node is an inner one; with near half paths of no hop it is the first end itself. Every node takes the way that makes the
    fewest rows; there is a frame for each way taken. Those met directly still have the ends a and b where the others have the pair_id.
    """
    count = lambda half, n, w: half.groupBy("tip").agg(F.count("*").alias(n), F.sum("m").alias(w))
    at = count(near, "nx", "wx").join(count(far, "ny", "wy"), "tip")
    # Doubles, for the product may pass a long.
    way = F.when(F.col("nx").cast("double") * F.col("ny") <= F.least("wx", "wy"), _DIRECT).when(F.col("wx") <= F.col("wy"), _BY_NEAR).otherwise(_BY_FAR)
    ways = written(at.select("tip", way.alias("way"), "nx", "ny"), "ways")
    totals = {r["way"]: r for r in ways.groupBy("way").agg(F.count("*").alias("n"), F.sum("nx").alias("nx"), F.sum("ny").alias("ny")).collect()}
    out = {}
    for w, total in totals.items():
        if w == _DIRECT:
            # The nodes that go another way are few.
            others = hinted(ways.where(F.col("way") != w).select("tip"), sum(t["n"] for v, t in totals.items() if v != w))
            x, y = (half.join(others, "tip", "left_anti") for half in (near, far))
            j = x.alias("x").join(y.alias("y"), F.col("x.tip") == F.col("y.tip"))
        else:
            here = hinted(ways.where(F.col("way") == w).select("tip"), total["n"])
            x, y = (half.join(here, "tip", "left_semi") for half in (near, far))
            own, end, other_half, other_end = (x, "a", y, "b") if w == _BY_NEAR else (y, "b", x, "a")
            own_rows, other_rows = (total["nx"], total["ny"]) if w == _BY_NEAR else (total["ny"], total["nx"])
            own = pairs.join(hinted(own.withColumnRenamed("end", end), own_rows), end).withColumn("end", F.col(end))
            other = other_half.withColumn(other_end, F.col("end"))
            p, q = ("x", "y") if w == _BY_NEAR else ("y", "x")
            j = own.alias(p).join(hinted(other, other_rows).alias(q), (F.col("x.tip") == F.col("y.tip")) & (F.col(f"{p}.{other_end}") == F.col(f"{q}.{other_end}")))
        named = [F.col("x.end").alias("a"), F.col("y.end").alias("b")] if w == _DIRECT else [F.col("pair_id")]
        out[w] = j.where(_apart("x", "y")).select(*named, *_together("x", "y", middle)).where(context_valid(F.col("c"), F.col("ctx"))).drop("c", "ctx")
    return out


def pair_summary(pairs: DataFrame, paths: DataFrame) -> DataFrame:
    """Every pair, also such without a path, with its numbers of metapaths and paths and its best score."""
    per = paths.groupBy("pair_id").agg(F.countDistinct("mp").alias("n_metapaths"), F.count("*").alias("n_paths"), F.max("score").alias("best_score"))
    return pairs.select("pair_id").join(per, "pair_id", "left").fillna(0, ["n_metapaths", "n_paths"])


def directed(paths: DataFrame, both: bool) -> DataFrame:
    """Paths with direction 1 and, if both, each reversed with direction -1; mp is that of the direction."""
    out = paths.withColumn("direction", F.lit(1))
    if both:
        turned = paths.select("pair_id", F.reverse("edges").alias("edges"), F.reverse("types").alias("types"), F.reverse("nodes").alias("nodes"), "score")
        turned = turned.withColumn("mp", metapath_key(F.col("edges"), F.col("types"))).withColumn("direction", F.lit(-1))
        out = out.unionByName(turned)
    return out
