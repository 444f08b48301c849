from collections import Counter

from pathloom.llm import sharding


def shuffled(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string, bucket_ string") if rows else spark.createDataFrame([], "doc_id long, text string")
    return sharding.external_shuffle(df.select("doc_id", "text"), **kw).collect()


def test_counts_slots_and_rows(spark):
    rows = [(i, "same" if i % 3 else f"text {i}" * (i % 7), "x", "y") for i in range(997)] + [(None, None, "x", "y"), (5, "again", "x", "y"), (5, "again", "x", "y"), (7, "", "x", "y")]
    out = shuffled(spark, rows, bucket_bytes=500)
    assert Counter((r.doc_id, r.text) for r in out) == Counter(r[:2] for r in rows)
    sizes = Counter(r.shard for r in out)
    assert set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sizes[s]))


def test_same_seed_same_order_whatever_the_layout(spark):
    rows = [(i, f"t{i}", "x", "y") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, a string, b string").select("doc_id", "text")
    place = lambda d, seed: {r.doc_id: (r.shard, r.slot) for r in sharding.external_shuffle(d, bucket_bytes=300, seed=seed).collect()}
    assert place(df, 1) == place(df.repartition(7), 1) != place(df, 2)
    order = [d for d, _ in sorted(place(df, 1).items(), key=lambda x: x[1])]
    assert order != sorted(order)


def test_empty_few_and_long(spark):
    assert shuffled(spark, []) == []
    out = shuffled(spark, [(1, "a" * 200_000, "x", "y"), (2, None, "x", "y")], bucket_bytes=1000)
    assert len({(r.shard, r.slot) for r in out}) == 2


def test_one_id_with_most_rows(spark):
    rows = [(1 if i % 3 else i, "t" * 20, "x", "y") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, a string, b string").select("doc_id", "text")
    out = sharding.external_shuffle(df, bucket_bytes=6000)
    got = out.collect()
    sizes = Counter(r.shard for r in got)
    assert len(got) == 6000 and max(sizes.values()) - min(sizes.values()) <= 1
    assert len({(r.shard, r.slot) for r in got}) == 6000
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)


def test_layout_does_not_matter_with_repeated_rows(spark):
    """One id fills a third of the rows, some of them equal in all columns: the same slots from any layout."""
    rows = [(1 if i % 3 == 0 else i, f"t{i % 60}" if i % 3 == 0 else f"t{i}", i % 2) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, extra int")
    place = lambda d: Counter((r.doc_id, r.text, r.extra, r.shard, r.slot) for r in sharding.external_shuffle(d, bucket_bytes=3000).collect())
    first = place(df)
    assert first == place(df.repartition(13)) and sum(first.values()) == 6000
    shards = Counter()
    for (doc, _, _, shard, _), n in first.items():
        shards[shard] += n * (doc == 1)
    assert min(shards.values()) > 60


def test_maps_and_two_levels(spark):
    df = spark.createDataFrame([(i % 90, None if i % 7 == 0 else "x" * (i % 11), {"k": i % 4, "l": None}, [{"m": 1.5}]) for i in range(500)], "doc_id long, text string, m map<string,int>, a array<map<string,double>>")
    one = sharding.external_shuffle(df, bucket_bytes=50)
    two = sharding.external_shuffle(df, bucket_bytes=50, fan_out=6)
    key = lambda r: (r.doc_id, r.text, str(r.m), str(r.a), r.shard, r.slot)
    assert Counter(map(key, one.collect())) == Counter(map(key, two.collect()))
    assert Counter((r.doc_id, r.text, str(r.m)) for r in one.collect()) == Counter((r.doc_id, r.text, str(r.m)) for r in df.collect())


def test_offsets_over_strides(spark, monkeypatch):
    monkeypatch.setattr(sharding, "STRIDE", 4)
    counts = [(b, b % 5 + 1) for b in range(0, 30) if b % 6]
    got = {r.bucket_: r.before_ for r in sharding.offsets(spark.createDataFrame(counts, "bucket_ int, c long")).collect()}
    assert got == {b: sum(c for o, c in counts if o < b) for b, _ in counts}


def test_every_permutation_turns_up(spark):
    """Fisher-Yates: all orders of three records of one bucket come up about equally often over seeds."""
    df = spark.createDataFrame([(i, "t") for i in range(3)], "doc_id long, text string").coalesce(1)
    seen = Counter(tuple(r.doc_id for r in sorted(sharding.external_shuffle(df, shards=1, seed=s).collect(), key=lambda r: r.slot)) for s in range(0, 120, 3))
    assert len(seen) >= 5


def test_written_shards_are_in_slot_order(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(400)], "doc_id long, text string")
    out = sharding.external_shuffle(df, bucket_bytes=400)
    sharding.write_shards(out, f"{tmp_path}/s")
    want = {(r.doc_id, r.shard, r.slot) for r in out.collect()}
    got = set()
    for shard in range(16):
        slots = []
        for file in sorted((tmp_path / "s" / f"shard={shard}").glob("*.parquet")):
            for r in spark.read.parquet(str(file)).collect():
                slots.append(r.slot)
                got.add((r.doc_id, shard, r.slot))
        assert slots == list(range(25))
    assert got == want


def brute(rows, buckets, shards, n):
    """The slots again in plain Python, from the operator's own record hashes and bucket orders."""
    out, at = {}, 0
    for b in range(buckets):
        for record in rows.get(b, []):
            shard = at * shards // n
            out[record] = (shard, at - -(-shard * n // shards))
            at += 1
    return out


def test_slots_against_a_plain_version(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(200)], "doc_id long, text string")
    placed = sharding.external_shuffle(df, bucket_bytes=100).collect()
    records, n, total = sharding.numbered(df, 17, sharding.size_of(sharding.F.col("text")))
    assert total == sum(len(f"t{i}") + 1 for i in range(200))
    buckets = -(-total // 100)
    key = sharding.F.xxhash64(sharding.F.lit(19), "k1", "k2", "copy")
    home = {r.doc_id: r.b for r in records.select("row.doc_id", sharding.F.pmod(key, sharding.F.lit(buckets)).alias("b")).collect()}
    order = sorted(placed, key=lambda r: (r.shard, r.slot))
    rows = {}
    for r in order:
        rows.setdefault(home[r.doc_id], []).append(r.doc_id)
    assert [home[r.doc_id] for r in order] == sorted(home.values()) and n == 200
    assert brute(rows, buckets, 16, n) == {r.doc_id: (r.shard, r.slot) for r in placed}


def test_clashing_names(spark):
    df = spark.createDataFrame([(i, "t", 5, "b", 9) for i in range(50)], "doc_id long, text string, shard int, bucket_ string, slot long")
    out = sharding.external_shuffle(df)
    assert out.columns == ["doc_id", "text", "bucket_", "shard", "slot"] and out.select("shard", "slot").distinct().count() == 50
