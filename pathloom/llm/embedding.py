"""Near-duplicate embeddings by an exact metric range join.

Unit vectors with cosine >= 0.93 lie within RADIUS of each other. Equal vectors of one label become one
class with a count first, so groups of exact copies of any size cost one row. The classes of one label and
length start as one cell, and cells are split in up to LEVELS rounds, by pivots of their own:

* Of a bounded sample of the cell, pivots and ball radii are chosen one after the other, each so that it saves
  most comparisons: a ball that holds many vectors and has few in the shell of RADIUS around it.
* A class belongs to the first pivot whose ball holds it, or to the rest. The triangle inequality sets its
  replicas: with an earlier ball of radius r around a pivot at distance d, it can only have a neighbour inside
  if d <= r + RADIUS, and only then it is replicated there.
* A pair within RADIUS meets exactly once: in the cell of that of the two which comes first. Pairs of which both
  are replicas in some round aren't compared in it.

Cells then join independently of each other. A cell larger than BLOCK (few vectors of it near each other, so
that no ball saves anything) is cut into blocks and block pairs, so no task holds more than two blocks, however
hot the cell or the label. Which pivots are drawn changes the work, never the result.

Tasks emit no pairs: of each block pair come the number of links of every vector and the links of a
spanning forest, which is all that components need.

Cosines are computed in double precision. Null, empty or zero vectors and such with null or non-finite
components link with nothing, neither do rows with null label; vectors of different lengths don't link.
vec_id may be of any type. Repeated vec_ids are rows of their own, each counted; a null vec_id gets a null
component.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import scope, slices, small, written
from pathloom.llm.components import components

COSINE = 0.93
#: Chord length of the cosine, and slack for rounding on the replication tests only.
RADIUS = math.sqrt(2 - 2 * COSINE)
SLACK = 1e-9
#: Rounds of splitting; cells split in a round at most (the largest; all others stay whole); vectors looked at and
#: pivots chosen in a cell at most; share of a cell's comparisons a pivot must save, but for the first.
LEVELS, CELLS, SAMPLE, PIVOTS, GAIN = 3, 512, 256, 8, 0.02
#: Rows of a block, and of a cell that isn't worth splitting any more.
BLOCK, LEAF = 3000, 256


def classes_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows with their class key (k1, k2), null where unusable, and the classes: key, number cls, label, vector v, size n and smallest id; both written."""
    ok = F.col("label").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    # Adding zero makes -0.0 and 0.0 the same.
    v = F.transform("embedding", lambda x: x.cast("double") + 0.0)
    keyed = rows.select("vec_id", F.when(F.coalesce(ok, F.lit(False)), F.struct(F.col("label").cast("string").alias("label"), v.alias("v"))).alias("x"))
    keyed = keyed.select("vec_id", "x", *[F.when(F.col("x").isNotNull(), F.xxhash64(F.lit(seed), "x.label", F.size("x.v"), "x.v")).alias(k) for k, seed in (("k1", 101), ("k2", 202))])
    groups = keyed.where("k1 is not null").groupBy("k1", "k2").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("n"), F.first("x").alias("x"))
    # Numbers are given as the rows are written, once and for all.
    groups = groups.select("k1", "k2", F.monotonically_increasing_id().alias("cls"), "x.label", "n", "first_id", "x.v")
    return written(keyed.select("vec_id", "k1", "k2"), "keys"), written(groups, "vectors")


def units(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision, by their largest component first, so that squares neither vanish nor overflow."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def balls(x: np.ndarray, needed: bool = False) -> list[tuple[np.ndarray, float]]:
    """Pivots and radii for a cell, from unit vectors of it: each the pair that leaves fewest comparisons among those outside the balls before.

    The first is taken if needed whether it saves anything or not.
    """
    n = len(x)
    far = np.sqrt(np.maximum(0, 2 - 2 * (x @ x.T)))
    np.fill_diagonal(far, 0)
    left, out = np.arange(n), []
    while len(out) < PIVOTS and left.size > 1:
        m = left.size
        d = np.sort(far[:, left], 1)
        inside = np.arange(1, m + 1)
        # Of every sample row and every radius just large enough for so many: what stays to be compared.
        reach = np.array([np.searchsorted(row, row + RADIUS + SLACK, "right") for row in d])
        cost = inside * inside / 2 + inside * (reach - inside) + (m - inside) ** 2 / 2
        i, k = np.unravel_index(int(cost.argmin()), cost.shape)
        if (out or not needed) and m * m / 2 - cost[i, k] < GAIN * n * n / 2:
            break
        radius = float(d[i, k])
        out.append((x[i], radius))
        left = left[far[i, left] > radius]
    return out


def pivots_of(placed: DataFrame, sizes: dict[int, int], needed: bool) -> dict[int, list[tuple[np.ndarray, float]]]:
    """Pivots of the cells given with their sizes, chosen in tasks of one bounded sample each; CELLS x PIVOTS vectors reach the driver at most."""
    rate = placed.sparkSession.createDataFrame([(c, min(1.0, SAMPLE / m)) for c, m in sizes.items()], "cell long, rate double")
    draw = F.pmod(F.xxhash64("cls", "cell", F.lit(7)), F.lit(1 << 30)) < F.col("rate") * (1 << 30)

    def choose(table: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(table.column("cls")), kind="stable")[:SAMPLE]
        chosen = balls(units(_matrix(table.column("v").take(pa.array(order)).combine_chunks())), needed)
        cell = table.column("cell")[0].as_py()
        return pa.table([pa.array([cell] * len(chosen), pa.int64()), pa.array(range(len(chosen)), pa.int32()), pa.array([r for _, r in chosen], pa.float64()), pa.array([p.tolist() for p, _ in chosen], pa.list_(pa.float64()))], ["cell", "at", "radius", "pivot"])

    sample = placed.join(F.broadcast(rate), "cell").where(draw).select("cell", "cls", "v")
    got = sample.groupBy("cell").applyInArrow(choose, "cell long, at int, radius double, pivot array<double>").collect()
    out: dict[int, list[tuple[np.ndarray, float]]] = {}
    for r in sorted(got, key=lambda r: (r["cell"], r["at"])):
        out.setdefault(r["cell"], []).append((np.array(r["pivot"]), r["radius"]))
    return out


def split(placed: DataFrame, wanted: set[int], pivots: dict[int, list[tuple[np.ndarray, float]]], level: int) -> DataFrame:
    """Every row of the wanted cells once with its home cell, and once for each earlier ball that may hold a neighbour; other rows as they are; written.

    open tells cells that may be worth splitting again: balls, and rests from which not all pivots were taken that pay.
    """
    matrix = {c: (np.array([p for p, _ in b]), np.array([r for _, r in b])) for c, b in pivots.items()}
    futile = np.array(sorted(wanted - set(matrix)), np.int64)

    def run(batches):
        for batch in slices(batches, 1024):
            cell = np.asarray(batch.column(4))
            stay = np.flatnonzero(~np.isin(cell, list(matrix)))
            rows, to, copy, again = [stay], [np.full(stay.size, -1)], [np.zeros(stay.size, bool)], [~np.isin(cell[stay], futile)]
            for c in np.unique(cell).tolist():
                if c not in matrix:
                    continue
                at = np.flatnonzero(cell == c)
                points, radius = matrix[c]
                x = units(_matrix(batch.column(3).take(pa.array(at))))
                d = np.sqrt(np.maximum(0, ((x[:, None, :] - points[None]) ** 2).sum(2)))
                held = d <= radius
                home = np.where(held.any(1), held.argmax(1), len(radius))
                near = (d <= radius + RADIUS + SLACK) & (np.arange(len(radius)) < home[:, None])
                i, j = np.nonzero(near)
                rows += [at, at[i]]
                to += [home, j]
                copy += [np.zeros(at.size, bool), np.ones(i.size, bool)]
                again += [(home < len(radius)) | (len(radius) == PIVOTS), np.ones(i.size, bool)]
            rows, to, copy, again = (np.concatenate(x) for x in (rows, to, copy, again))
            took = batch.take(pa.array(rows))
            mask = np.asarray(took.column(5)) | (copy.astype(np.int32) << level)
            yield pa.RecordBatch.from_arrays([*took.columns[:5], pa.array(mask, pa.int32()), pa.array(to, pa.int32()), pa.array(again)], ["cls", "n", "label", "v", "cell", "mask", "to", "open"])

    moved = placed.select("cls", "n", "label", "v", "cell", "mask").mapInArrow(run, "cls long, n long, label string, v array<double>, cell long, mask int, to int, open boolean")
    cell = F.when(F.col("to") < 0, F.col("cell")).otherwise(F.xxhash64("cell", F.lit(level), "to"))
    return written(moved.select("cls", "n", "label", "v", cell.alias("cell"), "mask", "open"), "cells")


def cells(classes: DataFrame) -> DataFrame:
    """cls, n, label, v, cell and mask (a bit for each round in which the row is a replica) of every class in every cell it was dealt to.

    A cell's number is a hash; were those of two labels to agree, their vectors would be told apart by the label.
    """
    placed = classes.select("cls", "n", "label", "v", F.xxhash64("label", F.size("v")).alias("cell"), F.lit(0).alias("mask"))
    out = []
    for level in range(LEVELS):
        # The first round splits labels of any size; later ones what is still large.
        sizes = placed.groupBy("cell").agg(F.count("*").alias("m")).where(F.col("m") > (1 if level == 0 else LEAF))
        wanted = {r["cell"]: r["m"] for r in sizes.orderBy(F.desc("m"), "cell").limit(CELLS).collect()}
        if not wanted:
            break
        moved = split(placed, set(wanted), pivots_of(placed, wanted, level == 0), level)
        out.append(moved.where("not open").drop("open"))
        placed = moved.where("open").drop("open")
    for more in out:
        placed = placed.unionByName(more)
    return placed


def _matrix(lists: pa.ListArray) -> np.ndarray:
    """Vectors of one length as rows."""
    return np.asarray(lists.flatten(), np.float64).reshape(len(lists), -1)


def _by_length(column: pa.ChunkedArray | pa.ListArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix of the vectors of each length."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0) if lists.num_chunks else pa.array([], pa.list_(pa.float64()))
    size = np.diff(np.asarray(lists.offsets))
    values = np.asarray(lists.values)
    starts = np.asarray(lists.offsets)[:-1]
    return [(at := np.flatnonzero(size == d), values[starts[at][:, None] + np.arange(d)]) for d in np.unique(size)]


def _join_block(table: pa.Table) -> pa.Table:
    """Links between left and right rows of a block pair, each pair once: their number for every row, and a spanning forest (n_links 0)."""
    cls, n, mask = np.asarray(table.column("cls")), np.asarray(table.column("n"), np.float64), np.asarray(table.column("mask"))
    left, right = np.asarray(table.column("left")), np.asarray(table.column("right"))
    label = np.unique(table.column("label").to_pylist(), return_inverse=True)[1]
    out_cls, out_n, out_to = [], [], []
    for at, x in _by_length(table.column("v")):
        x = units(x)
        a, b = np.flatnonzero(left[at]), np.flatnonzero(right[at])
        own, weight, bits, tree, links = cls[at], n[at], mask[at], np.arange(at.size), np.zeros(at.size)
        masked, labels = bits.any(), label[at] if label.any() else None
        for start in range(0, a.size, 500):
            rows = a[start : start + 500]
            close = x[rows] @ x[b].T >= COSINE
            # Rows on both sides meet once, and never themselves.
            close &= ~right[at][rows][:, None] | ~left[at][b][None, :] | (rows[:, None] < b[None, :])
            if masked:
                close &= (bits[rows][:, None] & bits[b][None, :]) == 0
            if labels is not None:
                close &= labels[rows][:, None] == labels[b][None, :]
            links[rows] += close @ weight[b]
            links[b] += weight[rows] @ close
            for r in np.flatnonzero(close.any(1)):
                me, others = rows[r], b[close[r]]
                trees, first = np.unique(tree[others], return_index=True)
                for t, other in zip(trees.tolist(), others[first].tolist(), strict=True):
                    if tree[me] != tree[other]:
                        tree[tree == tree[other]] = tree[me]
                        out_cls.append(own[me])
                        out_n.append(0)
                        out_to.append(own[other])
        some = np.flatnonzero(links)
        out_cls += own[some].tolist()
        out_n += links[some].astype(np.int64).tolist()
        out_to += own[some].tolist()
    return pa.table([pa.array(out_cls, pa.int64()), pa.array(out_n, pa.int64()), pa.array(out_to, pa.int64())], ["cls", "n_links", "other"])


def dealt(placed: DataFrame) -> DataFrame:
    """Rows with the block pairs (i, j), i <= j, of their cell: on the left in their own block's, on the right in those of earlier ones."""
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = placed.join(small(sizes, sizes.count()), "cell")
    mine = F.pmod(F.xxhash64("cls", F.lit(11)), F.col("blocks")).cast("int")
    every = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(mine, o).alias("i"), F.greatest(mine, o).alias("j"), (mine <= o).alias("left"), (mine >= o).alias("right")))
    return rows.select("cell", "cls", "n", "v", "mask", "label", F.explode(every).alias("x")).select("cell", "x.*", "cls", "n", "v", "mask", "label")


def near_vectors(rows: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    with scope() as keep:
        keyed, classes = classes_of(rows.select("vec_id", "embedding", "label"))
        found = written(dealt(cells(classes)).groupBy("cell", "i", "j").applyInArrow(_join_block, "cls long, n_links long, other long"), "found")
        ties = found.where("n_links = 0").select(F.least("cls", "other").alias("u"), F.greatest("cls", "other").alias("v")).distinct()
        labels = components(ties)
        counts = found.where("n_links > 0").groupBy("cls").agg(F.sum("n_links").alias("m"))
        ids = classes.select("k1", "k2", "cls", "n", "first_id").join(counts, "cls", "left").join(labels, F.col("cls") == F.col("node"), "left")
        ids = ids.select("k1", "k2", (F.coalesce("m", F.lit(0)) + F.col("n") - 1).alias("m"), "first_id", F.coalesce("label", "cls").alias("comp"))
        ids = written(ids.join(ids.groupBy("comp").agg(F.min("first_id").alias("head")), "comp").select("k1", "k2", "m", "head"), "components")
        keep += [keyed, ids]
    out = keyed.join(ids, ["k1", "k2"], "left")
    component = F.when(F.col("k1").isNull(), F.col("vec_id")).when(F.col("vec_id").isNotNull(), F.col("head"))
    return out.select("vec_id", F.coalesce("m", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def work(placed: DataFrame) -> dict[str, int]:
    """Rows dealt to cells, cells, and pairs compared after excluding all pairs of different cells."""
    r = placed.groupBy("cell").agg(F.count("*").alias("m")).agg(F.sum("m").alias("rows"), F.count("*").alias("cells"), F.sum(F.col("m") * (F.col("m") - 1) / 2).cast("long").alias("pairs")).first()
    return r.asDict()


def query(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = f"""
with recursive v as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings),
u as (select vec_id, label, e from v where label is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
l as (select a.vec_id as x, b.vec_id as y from u a join u b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= {COSINE}),
n as (select x, count(*) as n from l group by x),
r as (select vec_id as x, vec_id as y from v union select r.x, l.y from r join l on l.x = r.y)
select r.x as vec_id, cast(coalesce(max(n.n), 0) as bigint) as n_links, min(r.y) as component_id, min(r.y) = r.x as kept from r left join n on n.x = r.x group by r.x
"""
