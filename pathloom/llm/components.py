"""Connected components of link tables by union-find, each node labelled with its smallest member."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import release, written

#: Links (two longs each) up to which one task finishes the grouping; counted before, contracted by joins beyond.
LOCAL_LINKS = 1_000_000


def _forest(batches):
    """Union-find over all links of a task: each node that isn't its tree's smallest, with that smallest."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (p := parent.get(top, top)) != top:
            top = p
        while (p := parent.get(x, x)) != top:
            parent[x], x = top, p
        return top

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    roots = [root(x) for x in nodes]
    for at in range(0, len(nodes), 65536):
        yield pa.RecordBatch.from_arrays([pa.array(np.array(nodes[at : at + 65536], np.int64)), pa.array(np.array(roots[at : at + 65536], np.int64))], ["u", "v"])


def components(links: DataFrame, limit: int = LOCAL_LINKS) -> DataFrame:
    """(node, label) of every node of the links (u, v) that isn't itself the smallest of its component; written."""
    links = written(links.select("u", "v").mapInArrow(_forest, "u long, v long"), "forest")
    labels = None
    while links.count() > limit:
        # Every node points to its smallest neighbour; pointers are followed to their ends, the graph is contracted.
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        to = written(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("v")), "pointers")
        while True:
            far = to.select(F.col("u").alias("v"), F.col("v").alias("w"))
            jumped = written(to.join(far, "v").select("u", F.col("w").alias("v"), (F.col("w") != F.col("v")).alias("moved")), "pointers")
            to = jumped.select("u", "v")
            if jumped.where("moved").isEmpty():
                break
        labels = _composed(labels, to)
        a, b = to.select("u", F.col("v").alias("a")), to.select(F.col("u").alias("v"), F.col("v").alias("b"))
        links = written(links.join(a, "u").join(b, "v").where("a != b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "contracted")
        if links.isEmpty():
            return written(labels.where("u != v").select(F.col("u").alias("node"), F.col("v").alias("label")), "labels")
    labels = _composed(labels, links.coalesce(1).mapInArrow(_forest, "u long, v long"))
    return written(labels.where("u != v").select(F.col("u").alias("node"), F.col("v").alias("label")), "labels")


def _composed(first: DataFrame | None, then: DataFrame) -> DataFrame:
    """Labels of the first step sent on by the second."""
    if first is None:
        return then
    on = then.select(F.col("u").alias("v"), F.col("v").alias("w"))
    return written(first.join(on, "v", "left").select("u", F.coalesce("w", "v").alias("v")).unionByName(then).distinct(), "composed")
