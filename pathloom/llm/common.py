"""Shared plumbing: table scans, written intermediates, size-checked broadcasts."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.sources.stages import release, scope, shared_dir, written  # noqa: F401

#: Rows up to which a side of narrow rows (keys and small numbers) may be broadcast.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_place(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with columns called by their places, so that none is called like a helper, and these names by the former ones."""
    at = {c: f"c{i}_" for i, c in enumerate(df.columns)}
    return df.toDF(*at.values()), at


def named_back(df: DataFrame, at: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(a).alias(c) for c, a in at.items()])


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint when the counted rows stay under the limit; beyond it Spark shuffles."""
    return F.broadcast(df) if rows <= limit else df


def id_crc(col: Column) -> Column:
    """crc32 of an id written as text; of a null id, of the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))


def slices(batches: Iterator, size: int = 256) -> Iterator:
    """Arrow batches cut into slices of a few rows, so that few texts are Python objects at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, size):
            yield batch.slice(start, size)


def texts(column: pa.Array, size: int = 256) -> Iterator[str]:
    """The texts of an Arrow column, null as the empty one, with few as Python objects at a time."""
    for start in range(0, len(column), size):
        for text in column.slice(start, size).to_pylist():
            yield text or ""


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows for what runs inside: less memory beside the heap where rows are long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)
