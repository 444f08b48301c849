"""Bounded labelled samples for fitting the document classifiers."""

from __future__ import annotations

from itertools import zip_longest

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import id_crc, release, written


def within(rows: DataFrame, size: Column, budget: int) -> DataFrame:
    """Of sampled rows (h, text, y), those whose sizes fit the budget together, the classes in turn, each in the order of h; written.

    One that doesn't fit is passed over for the next, so that a text of any length leaves the others their places.
    """
    order: dict[int, list] = {}
    for r in rows.select("h", "y", size.alias("size")).orderBy("h", "size").collect():
        order.setdefault(r["y"], []).append((r["h"], r["size"]))
    left, taken = budget, []
    for turn in zip_longest(*[order[y] for y in sorted(order)]):
        for h, n in filter(None, turn):
            if n <= left:
                left -= n
                taken.append((h,))
    keep = F.broadcast(rows.sparkSession.createDataFrame(taken, "h long"))  # no more than the sample has rows
    out = written(rows.join(keep, "h", "left_semi"), "sample")
    release(rows)
    return out


def sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, per_class: dict[int, int], seed: int) -> tuple[DataFrame, dict[int, int]]:
    """Hash h, text and label y of training rows, at most per_class[y] of each class, and all training labels' counts.

    Rows whose crc32 of the id leaves the held remainder are never used. Of a label given twice the
    larger counts; null labels and ids, and labels without a document, give nothing; of an id given twice
    the text that comes first in order counts, so the sample has no more rows than ids, however often these
    repeat. Which ids are taken is a matter of a hash of theirs. Only narrow label rows are sorted; the ids found are
    few enough to broadcast.
    """
    rows = labels.select(F.col("doc_id").alias("i_"), F.col(label).cast("int").alias("y"))
    rows = rows.where(F.col("i_").isNotNull() & F.col("y").isin(0, 1) & (F.pmod(id_crc(F.col("i_")), F.lit(modulus)) != held))
    rows = rows.groupBy("i_").agg(F.max("y").alias("y")).withColumn("h", F.xxhash64(F.lit(seed), "i_"))
    counts = dict(rows.groupBy("y").count().collect())
    parts = [rows.where(F.col("y") == y).orderBy("h", "i_").limit(n) for y, n in per_class.items()]
    ids = parts[0]
    for part in parts[1:]:
        ids = ids.unionByName(part)
    ids = written(ids.select("i_", "y", "h"), "sample-ids")
    texts = docs.select(F.col("doc_id").alias("i_"), F.coalesce("text", F.lit("")).alias("text"))
    found = texts.join(F.broadcast(ids), "i_").groupBy("i_").agg(F.min("text").alias("text"), F.any_value("y").alias("y"), F.any_value("h").alias("h"))
    out = written(found.select("h", "text", "y"), "sample")
    release(ids)
    return out, {0: counts.get(0, 0), 1: counts.get(1, 0)}
