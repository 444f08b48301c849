"""Two-pass external shuffle into shards.

Pass one scatters records uniformly into memory-sized buckets by seeded hashes of the whole record; a bucket is
one shuffle partition, so the scatter goes through disk. With more than FAN_OUT buckets it goes there in two
levels, coarse groups of buckets first, so no task writes to more than FAN_OUT others. Pass two brings each
bucket into the order of its records' hashes, Fisher-Yates shuffles it with a seeded generator (Spark's
``shuffle``) and deals the result out. Buckets follow each other in one global sequence, cut into shards whose
row counts differ by at most one. ``write_shards`` writes a folder for each shard, in slot order.

Records that are equal in all columns are told apart by their number among their equals: one of them is
multiplied, in blocks, so that they spread over all buckets whatever their count. So nothing is keyed by id,
source or text alone, and no group of whatever kind lands in one bucket. The result depends only on the rows, the
seed and the number of buckets, not on how files or tasks are laid out, so a task that is run again gives
the same slots.

Null and empty texts count one byte. Repeated rows are kept, each with a slot of its own; an empty table gives
no rows; columns of other names and of any type pass through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.llm.common import shared_dir, small, written

#: Bytes of text in a bucket. A task holds a few copies of one bucket.
BUCKET_BYTES = 16 << 20
#: Partitions that one scatter makes at most, buckets of which the driver keeps one offset, and equal records multiplied in one go.
FAN_OUT, STRIDE, COPIES = 20_000, 4096, 1000


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _has_map(t: T.DataType) -> bool:
    if isinstance(t, T.MapType):
        return True
    if isinstance(t, T.ArrayType):
        return _has_map(t.elementType)
    return isinstance(t, T.StructType) and any(_has_map(f.dataType) for f in t.fields)


def _hashable(name: str, t: T.DataType) -> Column:
    """The column, or for what Spark can't hash (maps, variants) its JSON text; nulls are told from empty values."""
    c = F.col(f"`{name}`")
    return F.to_json(F.struct(c)) if _has_map(t) or isinstance(t, T.VariantType) else c


def record_hash(rows: DataFrame, seed: int) -> Column:
    cols = [x for f in rows.schema.fields for x in (_hashable(f.name, f.dataType), F.col(f"`{f.name}`").isNull())]
    return F.xxhash64(F.lit(seed), *cols)


def numbered(rows: DataFrame, seed: int, size: Column) -> tuple[DataFrame, int, int]:
    """The rows as (row, k1, k2, copy), told apart by hashes and number among equals; how many they are; and the sum of their sizes."""
    k1, k2 = record_hash(rows, seed).alias("k1"), record_hash(rows, seed + 1).alias("k2")
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), k1, k2)
    groups = rows.select(k1, k2, size.alias("size_")).groupBy("k1", "k2").agg(F.count("*").alias("c"), F.sum("size_").alias("size_"))
    n, most, total = groups.agg(F.sum("c"), F.max("c"), F.sum("size_")).first()
    if (most or 0) < 2:
        return packed.withColumn("copy", F.lit(0).cast("long")), n or 0, total or 0
    again = written(groups.where("c > 1").select("k1", "k2", "c"), "again")
    found = small(again, again.count())
    single = packed.join(found, ["k1", "k2"], "left_anti").withColumn("copy", F.lit(0).cast("long"))
    # One record of each kind, multiplied in blocks that different tasks take.
    one = packed.join(found, ["k1", "k2"]).groupBy("k1", "k2").agg(F.any_value("row").alias("row"), F.any_value("c").alias("c"))
    blocks = one.select("row", "k1", "k2", "c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1, F.lit(COPIES).cast("long"))).alias("from_")).repartition("k1", "k2", "from_")
    copies = blocks.select("row", "k1", "k2", F.explode(F.sequence("from_", F.least(F.col("from_") + COPIES, F.col("c")) - 1)).alias("copy"))
    return single.select("row", "k1", "k2", "copy").unionByName(copies), n, total


def external_shuffle(rows: DataFrame, text_col: str = "text", shards: int = 16, seed: int = 17, bucket_bytes: int = BUCKET_BYTES, fan_out: int = FAN_OUT) -> DataFrame:
    """The rows with shard and slot (gapless from 0 in each shard); columns of these names are replaced."""
    rows = rows.drop("shard", "slot")
    records, n, total = numbered(rows, seed, size_of(F.col(f"`{text_col}`")))
    buckets = max(1, -(-total // bucket_bytes))
    key = F.xxhash64(F.lit(seed + 2), "k1", "k2", "copy")
    records = records.select(F.pmod(key, F.lit(buckets)).cast("int").alias("bucket_"), F.struct(key.alias("k"), "k1", "k2", "copy", "row").alias("x_"))

    counts = written(records.groupBy("bucket_").agg(F.count("*").alias("c")), "buckets")
    starts = offsets(counts)

    if buckets > fan_out:
        coarse = F.floor(F.col("bucket_") / F.lit(-(-buckets // fan_out))).cast("int")
        records = written(records.repartitionById(fan_out, coarse), "coarse")
    dealt = records.repartitionById(buckets, F.col("bucket_")).groupBy("bucket_").agg(F.collect_list("x_").alias("xs_"))
    # Only hashes are sorted and shuffled; the records follow by their places.
    order = F.sort_array(F.transform("xs_", lambda x, i: F.struct(x["k"].alias("k"), x["k1"].alias("k1"), x["k2"].alias("k2"), x["copy"].alias("copy"), i.alias("i"))))
    mixed = dealt.select("bucket_", "xs_", F.shuffle(order, F.lit(seed)).alias("os_"))
    mixed = mixed.select("bucket_", F.posexplode(F.transform("os_", lambda o: F.get("xs_", o["i"])["row"])).alias("i_", "row"))
    placed = mixed.join(small(starts, buckets), "bucket_").select("row", (F.col("before_") + F.col("i_")).alias("pos_"))
    shard = F.floor(F.col("pos_") * shards / F.lit(max(n, 1)).cast("decimal(20,0)")).cast("int")
    placed = placed.select("row", "pos_", shard.alias("shard"))
    first = F.ceil(F.col("shard").cast("long") * F.lit(n).cast("decimal(20,0)") / F.lit(shards)).cast("long")
    return placed.select("row.*", "shard", (F.col("pos_") - first).alias("slot"))


def offsets(counts: DataFrame) -> DataFrame:
    """(bucket_, before_): the rows in all buckets before each; the driver sums strides of STRIDE buckets."""
    stride = F.floor(F.col("bucket_") / STRIDE).cast("int")
    sums = sorted((r["s"], r["c"]) for r in counts.groupBy(stride.alias("s")).agg(F.sum("c").alias("c")).collect())
    rows, at = [], 0
    for s, c in sums:
        rows.append((s, at))
        at += c
    heads = F.broadcast(counts.sparkSession.createDataFrame(rows, "stride_ int, head_ long"))
    before = F.sum("c").over(Window.partitionBy("stride_").orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1))
    within = counts.withColumn("stride_", stride).select("stride_", "bucket_", F.coalesce(before, F.lit(0)).alias("in_"))
    return within.join(heads, "stride_").select("bucket_", (F.col("head_") + F.col("in_")).alias("before_"))


def write_shards(shuffled: DataFrame, path: str) -> None:
    """A folder shard=N for each shard, its files and their rows in slot order."""
    shuffled.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    shuffled = external_shuffle(docs)
    path = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    write_shards(shuffled, path)
    out = spark.read.schema(shuffled.schema).parquet(path)
    return out.select(
        "doc_id",
        size_of(F.col("text")).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
