"""Centroid clustering by plain Lloyd rounds over integer vectors.

Vectors of DIMS components, none of them null or non-finite, take part, each component x as floor(SCALE * x). The
first centroids are the CLUSTERS vectors whose salted ids have the smallest SHA-256 texts. A round sends the
centroids to all tasks; each computes integer squared differences to one centroid after the other in NumPy, takes the
nearest (the lowest number of equals) and returns one integer sum per centroid and component for its whole partition.
These partial sums merge in a groupBy; what reaches the driver is CLUSTERS x (DIMS + 1) numbers, whatever the table's
size. All arithmetic is on whole numbers, so neither the partitioning nor a task run again changes anything.

Vectors of another length, null vectors and such with a null or non-finite component leave; so do those with a
component beyond 2**21, whose squared distances would not fit a long. vec_id may be of any atomic type; rows with
repeated ids are rows of their own, ties of their hash go to the smaller vector; null ids come last in that order.
With fewer vectors than CLUSTERS there are as many centroids as vectors; an empty table gives no rows. An inertia too
large for a long is null. Other columns, whatever they are called, are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.llm.common import written

CLUSTERS, ROUNDS, DIMS, SCALE, SALT = 16, 3, 64, 64, "1:"
#: Largest size of a component.
LIMIT = float(1 << 21)


def usable(vector: Column, dims: int = DIMS) -> Column:
    ok = (F.size(vector) == dims) & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) <= LIMIT))
    return F.coalesce(ok, F.lit(False))


def first_centroids(kept: DataFrame, clusters: int, scale: int) -> np.ndarray:
    """The vectors with the smallest hashes of their ids, in that order; an order by limit, so every task sends clusters rows at most."""
    key = F.sha2(F.concat(F.lit(SALT), F.col("vec_id").cast("string")), 256)
    q = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    rows = kept.select(key.alias("h"), q.alias("q")).orderBy(F.asc_nulls_last("h"), "q").limit(clusters).collect()
    return np.array([r["q"] for r in rows], np.int64)


def nearest(vectors: pd.Series, centroids: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whole-number vectors, the number of each one's centroid and the squared distance to it."""
    x = np.floor(np.stack(vectors.to_list()).astype(np.float64) * scale).astype(np.int64)
    squared = np.empty((len(centroids), len(x)), np.int64)
    for i, c in enumerate(centroids):
        squared[i] = ((x - c) ** 2).sum(1)
    at = squared.argmin(0)
    return x, at, squared[at, np.arange(len(x))]


def partial_sums(kept: DataFrame, centroids: np.ndarray, scale: int) -> DataFrame:
    """(cluster, at, total): component sums of each cluster, and its number of vectors at the place after the last."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k, dims = centroids.shape
        total = np.zeros((k, dims + 1), np.int64)
        for batch in batches:
            if len(batch):
                x, at, _ = nearest(batch["embedding"], centroids, scale)
                for i in np.unique(at):
                    mine = at == i
                    total[i, :dims] += x[mine].sum(0)
                    total[i, dims] += mine.sum()
        cluster, place = np.nonzero(total)
        yield pd.DataFrame({"cluster": cluster, "at": place, "total": total[cluster, place]})

    merged = kept.select("embedding").mapInPandas(run, "cluster int, at int, total long")
    return merged.groupBy("cluster", "at").agg(F.sum("total").alias("total"))


def moved(centroids: np.ndarray, sums: list) -> np.ndarray:
    """Centroids at the floors of their vectors' means; empty ones stay."""
    k, dims = centroids.shape
    total: dict[tuple[int, int], int] = {(r["cluster"], r["at"]): r["total"] for r in sums}
    out = centroids.copy()
    for i in range(k):
        if count := total.get((i, dims)):
            out[i] = [total.get((i, d), 0) // count for d in range(dims)]
    return out


def cluster(rows: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that takes part."""
    kept = rows.select("vec_id", "embedding").where(usable(F.col("embedding"), dims))
    id_type = kept.schema["vec_id"].dataType
    centroids = first_centroids(kept, clusters, scale)
    if not len(centroids):
        centroids = np.zeros((1, dims), np.int64)
    for _ in range(rounds):
        centroids = moved(centroids, partial_sums(kept, centroids, scale).collect())

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                _, at, squared = nearest(batch["embedding"], centroids, scale)
                yield pd.DataFrame({"id": batch["id"], "cluster": at, "distance": squared})

    # Ids travel as texts: pandas would turn whole numbers beside nulls into doubles.
    ids = kept.select(F.col("vec_id").cast("string").alias("id"), "embedding")
    placed = written(ids.mapInPandas(assign, "id string, cluster int, distance long"), "assigned")
    wide = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("own")).collect()
    whole = sum(r["own"] for r in wide)
    fits = lambda x: int(x) if x < 1 << 63 else None
    said = [(r["cluster"], fits(r["own"]), fits(whole), hashlib.sha256(",".join(map(str, centroids[r["cluster"]].tolist())).encode()).hexdigest()) for r in wide]
    schema = T.StructType([T.StructField("cluster", T.IntegerType()), T.StructField("cluster_inertia", T.LongType()), T.StructField("inertia", T.LongType()), T.StructField("centroid_sha256", T.StringType())])
    about = rows.sparkSession.createDataFrame(said, schema)
    return placed.join(F.broadcast(about), "cluster").select(F.col("id").cast(id_type).alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def query(spark, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _oracle() -> str:
    """The rounds one after another over (vector, place, value) rows."""
    steps = [
        f"k as (select row_number() over () r, vec_id, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) q from embeddings where len(embedding) = {DIMS} and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0)",
        f"x as (select r, unnest(q) v, unnest(range(0, {DIMS})) i from k)",
        f"c0 as (select c, unnest(q) v, unnest(range(0, {DIMS})) i from (select row_number() over (order by sha256('{SALT}' || cast(vec_id as varchar)), q) - 1 c, q from k order by 1 limit {CLUSTERS}) z)",
    ]
    for n in range(ROUNDS + 1):
        steps.append(f"d{n} as (select r, c, sum((x.v - c{n}.v) * (x.v - c{n}.v)) d from x join c{n} on c{n}.i = x.i group by r, c)")
        steps.append(f"a{n} as (select r, min(d) d, arg_min(c, d * {CLUSTERS} + c) c from d{n} group by r)")
        if n < ROUNDS:
            steps.append(f"m{n} as (select c, i, sum(v) s, count(*) n from x join a{n} on a{n}.r = x.r group by c, i)")
            steps.append(f"c{n + 1} as (select o.c, o.i, cast(case when m.n is null then o.v else (m.s - ((m.s % m.n) + m.n) % m.n) // m.n end as bigint) v from c{n} o left join m{n} m on m.c = o.c and m.i = o.i)")
    steps.append(f"t as (select c, sha256(string_agg(cast(v as varchar), ',' order by i)) h from c{ROUNDS} group by c)")
    body = ", ".join(s.replace(" as (", " as materialized (", 1) for s in steps)
    return f"with {body} select k.vec_id, cast(a.c as int) as cluster, cast(a.d as bigint) as distance, cast(sum(a.d) over (partition by a.c) as bigint) as cluster_inertia, cast(sum(a.d) over () as bigint) as inertia, t.h as centroid_sha256 from a{ROUNDS} a join k on k.r = a.r join t on t.c = a.c"


ORACLE = _oracle()
