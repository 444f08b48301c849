"""Hard negatives by an exact search of k-means inverted lists.

Scores are integer inner products of quantised vectors. An anchor's positives are its best rows of the same label; its
negatives are, for each positive, the best rows of other labels whose score lies in a window below the positive's.

* Lists: centroids are fitted on a bounded sample (SAMPLE rows); every row goes to the list of its nearest centroid,
  each list keeps its radius, and long lists are cut into blocks of BLOCK rows.
* Search: by Cauchy-Schwarz no row of a list scores above <anchor, centroid> + |anchor| radius, nor below the same with
  a minus. Every anchor visits lists by falling upper bound, in rounds of growing reach (STEPS); lists that lie wholly
  outside its windows are skipped, and it stops where the bound is strictly below the score of the worst row it would
  keep. So equal scores are never cut off, and the result is that of comparing with all rows; which centroids were
  drawn changes the work only.
* A visit pairs a block of rows with at most ANCHORS anchors in one task, however many ask for a list; a task returns
  the best few per anchor and window.

Of rows with equal label and vector a search can only ever return those with the smallest ids, so just these
are listed, as many as a search may need: a group of copies of any size costs a few rows, and none is lost.

Rows with a null label, a null vector or a null or non-finite component take no part, neither do vectors whose
quantised squares sum to 2**62 or more, as their scores wouldn't fit a long. Vectors meet those of their own length only
(empty ones score 0 with each other). Of rows with equal scores the smaller vec_id comes first, a null one last; rows
with repeated ids are rows of their own, and an anchor is not its own positive while another row of its id may be. An
anchor without positives, a positive without negatives in its window and an empty table give no rows. Columns other
than vec_id (long), embedding and label are left out, whatever they are called.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.llm.common import scope, small, written

POSITIVES, NEGATIVES, LOW, HIGH, SCALE = 5, 3, 50, 95, 256
#: Rows and numbers the centroids are fitted on at most; lists at most; Lloyd rounds of the fit.
SAMPLE, SAMPLE_VALUES, LISTS, FIT_ROUNDS = 16_384, 1 << 21, 1024, 8
#: Lists that an anchor has visited after each round, at most; the last round has no end.
STEPS = (4, 16, 64, 256)
#: Rows of a block, and anchors that meet it in one task.
BLOCK, ANCHORS = 4096, 1024
#: Whole numbers that doubles hold exactly.
EXACT = float(1 << 53)
_NONE = np.iinfo(np.int64).min


def usable(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label and whole-number vector q of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    level = lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))
    # The floors of huge components don't fit a long, so their size is judged in doubles.
    weight = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.pow(F.abs(F.lit(float(scale)) * x.cast("double")) + 1, 2))
    kept = rows.select("vec_id", "embedding", "label").where("label is not null and embedding is not null").where(F.coalesce(finite, F.lit(False)))
    kept = kept.where(weight < float(1 << 62))
    return kept.select("vec_id", F.col("label").cast("string").alias("label"), F.transform("embedding", lambda x: level(x).cast("int")).alias("q"))


def _matrix(column) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0)
    return np.asarray(lists.flatten(), np.float64).reshape(len(lists), -1)


def fit_centroids(rows: DataFrame, n: int) -> np.ndarray:
    """Centroids for about the square root of n lists, from a sample drawn by hash of the length that most of a first draw have."""
    draw = F.xxhash64("q", "label", "vec_id", F.lit(5))
    first = rows.select(F.size("q").alias("d")).where(F.pmod(draw, F.lit(max(1, n // SAMPLE))) == 0)
    most = first.groupBy("d").count().orderBy(F.desc("count"), "d").first() or rows.select(F.size("q").alias("d")).first()
    dims = most["d"]
    if not dims:
        return np.zeros((0, 0))
    size = max(1, min(SAMPLE, SAMPLE_VALUES // dims))
    # Equal vectors count once, so that a large group of copies doesn't fill the sample.
    near = rows.where((F.size("q") == dims) & (F.pmod(draw, F.lit(1 << 20)) < F.lit(max(1, min(1 << 20, math.ceil(4 * size / n * (1 << 20)))))))
    sample = near.select("q").distinct().orderBy(F.xxhash64("q", F.lit(6)), "q").limit(size).toArrow()
    if not sample.num_rows:
        return np.zeros((0, 0))
    x = _matrix(sample.column("q"))
    k = max(1, min(LISTS, math.isqrt(n), len(x)))
    centroids = x[:k].copy()
    for _ in range(FIT_ROUNDS):
        at = (-2 * x @ centroids.T + (centroids**2).sum(1)).argmin(1)
        count = np.bincount(at, minlength=k)
        sums = np.zeros_like(centroids)
        np.add.at(sums, at, x)
        centroids = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centroids)
    return centroids


def listed(rows: DataFrame, centroids: np.ndarray, keep: int) -> tuple[DataFrame, np.ndarray]:
    """Rows with class key (k1, k2), list and block, the keep smallest ids of each class; and the radius of each list (negative: empty)."""
    k, dims = centroids.shape
    # Spark keeps the first of each class in every task before it sorts them together.
    order = Window.partitionBy("k1", "k2").orderBy(F.asc_nulls_last("vec_id"))
    keyed = rows.withColumns({"k1": F.xxhash64(F.lit(31), "label", F.size("q"), "q"), "k2": F.xxhash64(F.lit(32), "label", F.size("q"), "q")})
    first = keyed.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= keep).drop("nth")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = batch.column(2)
            size = np.diff(np.asarray(q.offsets))
            # Lists of lengths that have no centroids: one for each length, all of it within reach.
            at, far = -1 - size.astype(np.int64), np.full(len(size), np.nan)
            mine = np.flatnonzero(size == dims) if k else np.zeros(0, int)
            if mine.size:
                x = _matrix(q.take(pa.array(mine)))
                near = (-2 * x @ centroids.T + (centroids**2).sum(1)).argmin(1)
                at[mine], far[mine] = near, np.sqrt(((x - centroids[near]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64()), pa.array(far, pa.float64())], ["vec_id", "label", "q", "k1", "k2", "list", "far"])

    placed = first.select("vec_id", "label", "q", "k1", "k2").mapInArrow(place, "vec_id long, label string, q array<int>, k1 long, k2 long, list long, far double")
    placed = written(placed, "listed")
    radii = np.full(k, -1.0)
    for r in placed.where("list >= 0").groupBy("list").agg(F.max("far").alias("far")).collect():
        radii[r["list"]] = r["far"]
    return placed.drop("far"), radii


def blocks_of(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lists' rows with their blocks, and (list, blocks)."""
    sizes = written(placed.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "sizes")
    block = F.pmod(F.xxhash64("k1", "k2", "vec_id", F.lit(9)), F.col("blocks")).cast("int")
    return placed.join(small(sizes, sizes.count()), "list").withColumn("block", block).drop("blocks"), sizes


_STATE = "aid long, label string, q array<int>, lows array<long>, highs array<long>"


def visits(state: DataFrame, centroids: np.ndarray, radii: np.ndarray, start: int, stop: int | None) -> DataFrame:
    """The lists that anchors visit from their place start to stop in the order of their bounds: list and the anchor's state."""
    k, dims = centroids.shape
    long = np.abs(centroids).sum(1) if k else np.zeros(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 1024):
                batch = whole.slice(begin, 1024)
                size = np.diff(np.asarray(batch.column(2).offsets)[: batch.num_rows + 1])
                rows, to = [], []
                other = np.flatnonzero((size != dims) | (k == 0))
                if start == 0 and other.size:
                    rows.append(other)
                    to.append(-1 - size[other].astype(np.int64))
                mine = np.flatnonzero(size == dims) if k else np.zeros(0, int)
                if mine.size:
                    some = batch.take(pa.array(mine))
                    a = _matrix(some.column(2))
                    middle = a @ centroids.T
                    reach = np.sqrt((a * a).sum(1))[:, None] * radii[None]
                    slack = 1e-9 * (np.abs(a).max(1, initial=0)[:, None] * long[None] + reach) + 1e-6
                    upper, lower = middle + reach + slack, middle - reach - slack
                    n_slots = np.diff(np.asarray(some.column(3).offsets))
                    slots = np.repeat(np.arange(len(mine)), n_slots)
                    lows, highs = np.asarray(some.column(3).flatten(), np.float64), np.asarray(some.column(4).flatten(), np.float64)
                    # Lists beyond every window come last in the order, and nobody visits them.
                    ceiling = np.full(len(mine), -np.inf)
                    np.maximum.at(ceiling, slots, highs)
                    within = (radii[None] >= 0) & (lower <= ceiling[:, None])
                    order = np.argsort(np.where(within, -upper, np.inf), axis=1, kind="stable")[:, start:stop]
                    wanted = np.zeros((len(mine), k), bool)
                    for s in range(int(n_slots.max(initial=0))):
                        has = np.flatnonzero(n_slots > s)
                        at = np.asarray(some.column(3).offsets)[:-1][has] - np.asarray(some.column(3).offsets)[0] + s
                        wanted[has] |= (upper[has] >= lows[at][:, None]) & (lower[has] <= highs[at][:, None])
                    wanted &= within
                    i, j = np.nonzero(np.take_along_axis(wanted, order, 1))
                    rows.append(mine[i])
                    to.append(order[i, j])
                if rows and sum(r.size for r in rows):
                    at, lists = np.concatenate(rows), np.concatenate(to)
                    for part in range(0, len(at), 8192):
                        took = batch.take(pa.array(at[part : part + 8192]))
                        yield pa.RecordBatch.from_arrays([pa.array(lists[part : part + 8192], pa.int64()), *took.columns], ["list", "aid", "label", "q", "lows", "highs"])

    return state.select("aid", "label", "q", "lows", "highs").mapInArrow(run, "list long, " + _STATE)


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products as longs, exact: in doubles where no sum can leave what these hold."""
    if not a.shape[1]:
        return np.zeros((len(a), len(b)), np.int64)
    if math.sqrt(float((a * a).sum(1).max())) * math.sqrt(float((b * b).sum(1).max())) * 1.001 < EXACT:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.T.astype(np.int64)


def best_of_block(same: bool, keep: int):
    """Of an anchor group and a block: for each anchor and window the keep best rows of the same label, or of others."""
    schema = pa.schema([("aid", pa.int64()), ("slot", pa.int32()), ("score", pa.int64()), ("vec_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64())])

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], [], []]
        if anchors.num_rows and rows.num_rows:
            ids = rows.column("vec_id").to_pylist()
            order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
            rows = rows.take(pa.array(order))
            label = np.array(rows.column("label").to_pylist(), object)
            b = _matrix(rows.column("q"))
            aid, mine = np.asarray(anchors.column("aid")), anchors.column("label").to_pylist()
            lows, highs = anchors.column("lows").to_pylist(), anchors.column("highs").to_pylist()
            other = {y: (label == y) if same else (label != y) for y in set(mine)}
            a = _matrix(anchors.column("q"))
            for begin in range(0, len(a), 256):
                scores = _scores(a[begin : begin + 256], b)
                for i, row in enumerate(scores, begin):
                    free = other[mine[i]]
                    for slot, (low, high) in enumerate(zip(lows[i], highs[i], strict=True)):
                        at = np.flatnonzero(free & (row >= low) & (row <= high))
                        if at.size > keep:
                            # All rows as good as the keep-th, then the first of them in the order of ids.
                            worst = np.partition(row[at], at.size - keep)[at.size - keep]
                            at = at[row[at] >= worst]
                        at = at[np.argsort(-row[at], kind="stable")][:keep]
                        for column, values in zip(out, ([aid[i]] * at.size, [slot] * at.size, row[at], at, at, at), strict=True):
                            column.extend(values)
            took = rows.take(pa.array(np.array(out[3], np.int64)))
            return pa.table([pa.array(np.array(out[0], np.int64)), pa.array(np.array(out[1], np.int32)), pa.array(np.array(out[2], np.int64)), *(took.column(c).combine_chunks().cast(pa.int64()) for c in ("vec_id", "k1", "k2"))], schema=schema)
        return schema.empty_table()

    return run


def searched(anchors: DataFrame, lists: DataFrame, sizes: DataFrame, centroids: np.ndarray, radii: np.ndarray, same: bool, keep: int) -> DataFrame:
    """aid, slot, score, vec_id, k1, k2 of the keep best rows of each anchor (_STATE) and window; written."""
    shape = "aid long, slot int, score long, vec_id long, k1 long, k2 long"
    best, state, start = None, anchors, 0
    rank = Window.partitionBy("aid", "slot").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "k1", "k2")
    for stop in [s for s in STEPS if s < len(radii)] + [None]:
        with scope(*([best] if best is not None else []), *([state] if state is not anchors else [])) as kept:
            asked = written(visits(state, centroids, radii, start, stop), "visits")
            load = asked.groupBy("list").agg(F.ceil(F.count("*") / ANCHORS).cast("int").alias("parts")).join(sizes, "list")
            load = written(load, "load")
            n_lists = load.count()
            if n_lists:
                part = F.pmod(F.xxhash64("aid", F.lit(13)), F.col("parts")).cast("int")
                left = asked.join(small(load, n_lists), "list").withColumn("part", part).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
                right = lists.join(small(load.select("list", "parts"), n_lists), "list").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
                key = ["list", "block", "part"]
                met = left.select(*key, "aid", "label", "q", "lows", "highs").groupBy(*key).cogroup(right.select(*key, "vec_id", "label", "q", "k1", "k2").groupBy(*key))
                got = met.applyInArrow(best_of_block(same, keep), shape)
                every = got if best is None else best.unionByName(got)
                best = written(every.withColumn("nth", F.row_number().over(rank)).where(F.col("nth") <= keep).drop("nth"), "best")
                kept.append(best)
            if stop is not None and n_lists:
                full = best.groupBy("aid", "slot").agg(F.count("*").alias("n"), F.min("score").alias("worst")).where(F.col("n") == keep)
                floors = full.groupBy("aid").agg(F.map_from_entries(F.collect_list(F.struct("slot", "worst"))).alias("floors"))
                raised = F.transform("lows", lambda low, i: F.greatest(low, F.coalesce(F.try_element_at("floors", i), low)))
                state = written(anchors.join(floors, "aid", "left").select("aid", "label", "q", raised.alias("lows"), "highs"), "state")
                kept.append(state)
        start = stop
    return best if best is not None else written(anchors.sparkSession.createDataFrame([], shape), "best")


def mine(rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score; anchor is a condition on vec_id and label.

    A negative's score lies from low to high percent of the positive's.
    """
    with scope() as kept:
        ready = written(usable(rows, scale), "vectors")
        n = ready.count()
        centroids = fit_centroids(ready, n) if n else np.zeros((0, 0))
        placed, radii = listed(ready, centroids, max(positives + 1, negatives))
        lists, sizes = blocks_of(placed)
        keys = [F.xxhash64(F.lit(s), "label", F.size("q"), "q").alias(c) for s, c in ((31, "k1"), (32, "k2"))]
        anchors = written(ready.where(anchor).select(F.monotonically_increasing_id().alias("aid"), F.col("vec_id").alias("anchor_id"), "label", "q", *keys), "anchors")
        wide = lambda x: F.array(F.lit(x).cast("long"))
        found = searched(anchors.select("aid", "label", "q", wide(-(1 << 62)).alias("lows"), wide(1 << 62).alias("highs")), lists, sizes, centroids, radii, True, positives + 1)

        # The anchor itself is one of the rows found; one that ranks behind all these is none of them.
        own = anchors.select("aid", "anchor_id", F.col("k1").alias("a1"), F.col("k2").alias("a2"))
        mates = found.join(own, "aid").withColumn("self", F.col("vec_id").eqNullSafe(F.col("anchor_id")) & (F.col("k1") == F.col("a1")) & (F.col("k2") == F.col("a2")))
        order = Window.partitionBy("aid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "k1", "k2")
        once = F.row_number().over(Window.partitionBy("aid", "self").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "k1", "k2"))
        mates = mates.withColumn("twin", once).where(~F.col("self") | (F.col("twin") > 1)).withColumn("slot", F.row_number().over(order) - 1).where(F.col("slot") < positives)
        share = lambda percent: F.col("score").cast("decimal(20,0)") * F.lit(percent).cast("decimal(5,0)") / F.lit(100).cast("decimal(3,0)")
        mates = mates.select("aid", "anchor_id", "slot", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), F.ceil(share(low)).cast("long").alias("low"), F.floor(share(high)).cast("long").alias("high"))
        mates = written(mates, "positives")

        windows = mates.where("low <= high").groupBy("aid").agg(F.sort_array(F.collect_list(F.struct("slot", "low", "high"))).alias("w"))
        windows = windows.select("aid", F.transform("w", lambda x: x["low"]).alias("lows"), F.transform("w", lambda x: x["high"]).alias("highs"), F.transform("w", lambda x: x["slot"]).alias("slots"))
        asking = written(anchors.select("aid", "label", "q").join(windows, "aid"), "windows")
        hard = searched(asking.select("aid", "label", "q", "lows", "highs"), lists, sizes, centroids, radii, False, negatives)
        hard = hard.join(asking.select("aid", "slots"), "aid").withColumn("slot", F.element_at("slots", F.col("slot") + 1))
        place = Window.partitionBy("aid", "slot").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
        hard = hard.select("aid", "slot", F.row_number().over(place).alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        out = written(mates.join(hard, ["aid", "slot"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "mined")
        kept.append(out)
    return out


def query(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.select("vec_id", "embedding", moved.alias("label")), F.col("vec_id") % 50 == 0)


ORACLE = f"""
with v as materialized (select row_number() over () as r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as y, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as q
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as materialized (select a.r, a.vec_id as anchor_id, b.vec_id, a.y = b.y as same, cast(coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])), 0) as bigint) as score from v a join v b on a.r <> b.r and len(a.q) = len(b.q) where a.vec_id % 50 = 0),
p as (select r, anchor_id, vec_id as positive_id, score, row_number() over (partition by r order by score desc, vec_id) as n from s where same qualify n <= {POSITIVES}),
h as (select p.anchor_id, p.positive_id, row_number() over (partition by p.r, p.n order by s.score desc, s.vec_id) as rank, s.vec_id as negative_id, p.score as positive_score, s.score as negative_score
  from p join s on s.r = p.r and not s.same where {LOW} * p.score <= 100 * s.score and 100 * s.score <= {HIGH} * p.score qualify rank <= {NEGATIVES})
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from h
"""
