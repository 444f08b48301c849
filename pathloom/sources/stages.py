"""Stage results as Parquet: written once, read back, so that lineage ends there and lost executors lose nothing."""

from __future__ import annotations

import atexit
import contextlib
import hashlib
import json
import pathlib
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Folders that written() left and nobody has released.
_left: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Only a local master may go without: it gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that the driver and all executors of {master} share")
        folder = tempfile.mkdtemp(prefix="pathloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        folder = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _left.add(path)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._pathloom_path = path
    return back


#: Rows up to which a side of a join may be broadcast.
BROADCAST_ROWS = 1_000_000


def hinted(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if the rows, counted here unless their number is given, stay under the limit; beyond it the join shuffles."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= limit else df


def ordinals(df: DataFrame, *order: Column | str, name: str = "n", made: Mapping[str, Column] | None = None) -> DataFrame:
    """df with its place, from 0, in the order given, as a long; written. Rows that the order doesn't tell apart take theirs in any order.

    Rows are sorted range by range; only the number of rows in each range meets the others, on the driver. Names of the order that stand for columns made
    from others are worked out on both sides of the shuffle, so they are neither sent nor written.
    """
    made = dict(made or {})
    inside = F.lit((1 << 33) - 1)
    dealt = df.repartitionByRange(*[made.get(c, c) if isinstance(c, str) else c for c in order])
    placed = written(dealt.withColumns(made).sortWithinPartitions(*order).withColumn("at__", F.monotonically_increasing_id()).drop(*made), "ordered")
    counts = sorted(placed.groupBy(F.shiftright("at__", 33).alias("range__")).count().collect())
    heads, total = [], 0
    for r in counts:
        heads.append((r["range__"], total))
        total += r["count"]
    ahead = F.broadcast(df.sparkSession.createDataFrame(heads, "range__ long, head__ long"))  # one row per range
    out = placed.withColumn("range__", F.shiftright("at__", 33)).join(ahead, "range__")
    return out.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("head__") + F.col("at__").bitwiseAND(inside)).alias(name))


def running_sums(df: DataFrame, order: Column, *columns: str, by: Sequence[str] = ()) -> DataFrame:
    """df with every column's sum up to its row, as <column>_upto, in the order given, which must tell rows apart; written.

    With columns by, which must not be null, every group has sums of its own. Sums run inside ranges of rows; what the ranges before add to each is
    summed on the driver, which sees a row for each range, and one more for each group at most.
    """
    parted = written(df.repartitionByRange(*by, order).withColumn("range__", F.spark_partition_id()), "ranges")
    totals = sorted(parted.groupBy(*by, "range__").agg(*[F.sum(c).alias(c) for c in columns]).collect(), key=lambda r: tuple(r[c] for c in (*by, "range__")))
    heads, at, last = [], [0.0] * len(columns), None
    for r in totals:
        group = tuple(r[c] for c in by)
        if group != last:
            at, last = [0.0] * len(columns), group
        heads.append((*group, r["range__"], *at))
        at = [a + (r[c] or 0.0) for a, c in zip(at, columns, strict=True)]
    kinds = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by]
    ahead = F.broadcast(df.sparkSession.createDataFrame(heads, ", ".join([*kinds, "range__ int", *[f"{c}__ double" for c in columns]])))  # one row per range and group in it
    upto = Window.partitionBy(*by, "range__").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = parted.join(ahead, [*by, "range__"])
    return out.select(*[F.col(c) for c in df.columns], *[(F.col(f"{c}__") + F.sum(c).over(upto)).alias(f"{c}_upto") for c in columns])


def _delete(paths) -> None:
    jvm = SparkContext._jvm
    for path in list(paths):
        at = jvm.org.apache.hadoop.fs.Path(path)
        active = SparkContext._active_spark_context
        conf = active._jsc.hadoopConfiguration() if active else jvm.org.apache.hadoop.conf.Configuration()
        at.getFileSystem(conf).delete(at, True)
        _left.discard(path)


def release(*frames: DataFrame) -> None:
    """Deletes what written() left of these, once nothing reads it any more."""
    _delete([p for df in frames if (p := getattr(df, "_pathloom_path", None))])


@contextlib.contextmanager
def scope(*kept: DataFrame) -> Iterator[list[DataFrame]]:
    """On leaving, everything written() inside is deleted but for the frames given or appended to the list."""
    before, keep = set(_left), list(kept)
    try:
        yield keep
    finally:
        _delete(_left - before - {getattr(df, "_pathloom_path", "") for df in keep})


def release_all() -> None:
    """Deletes all that written() has left in this process; results that read it must have been used."""
    _delete(_left)


@atexit.register
def _at_exit() -> None:
    with contextlib.suppress(Exception):
        if _left and SparkContext._jvm is not None:
            release_all()


def _version() -> str:
    """A hash of this package's code, so that no stage of former code is served."""
    root = pathlib.Path(__file__).resolve().parent.parent
    files = sorted(p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts)
    return hashlib.sha256(b"".join(p.read_bytes() for p in files)).hexdigest()[:16]


def _state(value):
    """What an input names, as it is now: of paths, the lengths and times of their files."""
    spark = SparkSession.getActiveSession()
    if isinstance(value, (list, tuple)):
        return [_state(v) for v in value]
    if not isinstance(value, str) or not ("/" in value or "." in value) or spark is None or not _exists(spark, value):
        return value
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(value)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getFileStatus(at).isFile():
        found = [fs.getFileStatus(at)]
    else:
        every, found = fs.listFiles(at, True), []
        while every.hasNext():
            found.append(every.next())
    return [value, sorted([f.getPath().toString(), f.getLen(), f.getModificationTime()] for f in found)]


class StageCache:
    """Named stages under a folder. A stage's key is its name and a hash of the parameters and inputs given, of the state of
    the files that these name, and of the package's code; a stage appears under it as a whole, by a rename."""

    def __init__(self, folder: str, update: bool = False):
        self.folder, self.update = folder.rstrip("/"), update

    def path(self, stage: str, **inputs) -> str:
        known = {name: _state(value) for name, value in inputs.items()} | {"code": _version()}
        key = hashlib.sha256(json.dumps(known, sort_keys=True, default=str).encode()).hexdigest()[:20]
        return f"{self.folder}/{stage}/{key}"

    def has(self, spark: SparkSession, stage: str, **inputs) -> bool:
        return _exists(spark, f"{self.path(stage, **inputs)}/_SUCCESS")

    def get_or_store(self, spark: SparkSession, stage: str, build: Callable[[], DataFrame], **inputs) -> DataFrame:
        path = self.path(stage, **inputs)
        if self.update or not self.has(spark, stage, **inputs):
            part = f"{path}-{uuid.uuid4().hex}"
            build().write.parquet(part)
            _moved(spark, part, path)
        return spark.read.parquet(path)


class ValueCache:
    """Small values under keys, as JSON texts in a folder that Spark's file systems reach; for settings and results of the driver."""

    def __init__(self, spark: SparkSession, folder: str, update: bool = False):
        self.spark, self.folder, self.update = spark, folder.rstrip("/"), update

    def _path(self, key) -> str:
        return f"{self.folder}/{hashlib.sha256(json.dumps(key, sort_keys=True, default=str).encode()).hexdigest()}"

    def get(self, key, default=None):
        path = self._path(key)
        return json.loads(self.spark.read.text(path, wholetext=True).first()[0]) if _exists(self.spark, f"{path}/_SUCCESS") else default

    def store(self, key, value) -> None:
        self.spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(self._path(key))

    def get_or_store(self, key, build: Callable):
        """The value kept under the key; else, or with update, that of build(key), kept from then on."""
        none = object()
        found = none if self.update else self.get(key, none)
        if found is none:
            found = build(key)
            self.store(key, found)
        return found


def _moved(spark: SparkSession, source: str, target: str) -> None:
    """What stood at the target gives way to the source."""
    to = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    fs = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(to, True)
    if not fs.rename(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source), to):
        raise OSError(f"{source} could not be moved to {target}")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def load_params(path: str, defaults: Mapping) -> dict:
    """Defaults overridden by a JSON file's keys; unknown keys raise."""
    with open(path) as f:
        given = json.load(f)
    if unknown := set(given) - set(defaults):
        raise KeyError(f"unknown keys: {sorted(unknown)}")
    return {**defaults, **given}
