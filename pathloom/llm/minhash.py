"""Near-duplicate documents by SuperMinHash, banding, verification on full sets and union-find.

A document's set holds its distinct shingles of five words (white-space separated, A-Z lower-cased);
fewer words make one shingle. SuperMinHash gives every element one random permutation of the signature's
places with ranks correlated across them, and stops as soon as no later rank can lower a minimum.
Documents with equal sets are one class from then on, so groups of exact copies of any size cost one
row. BANDS bands of ROWS signature places make buckets of classes. Links are searched in rounds, each
verified on full shingle sets and followed by union-find:

1. in the first bands, every class against the smallest of its bucket;
2. in all bands, in buckets that still hold several components, members against LEADERS members drawn
   by different hashes, if of another component;
3. among the classes still in buckets of several components, an exact prefix-filter join across
   components: shingles are ordered by how many of these classes hold them, and a pair is compared only if
   a shingle early enough in both orders to leave room for the overlap needed is common to both.

So no pair within a component known as such is emitted, and none that could connect two components is
left out. A pair with similarity 0.75 shares a band with probability 0.9999.

Null texts and texts without words have empty sets and link with nothing. Classes have numbers of their
own and rows are told apart by id and hash of the text, so ids may be of any type, repeat, or be null: every
row is judged by its own text. component_id is the smallest id of the component, null if it has none; the kept
row of a component is that with the smallest id (with null ids only: with the smallest text hash), and of
repeated rows drop_copies keeps one. Columns of other names pass through drop_copies.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.llm.common import arrow_rows, by_place, named_back, release, scope, slices, small, written
from pathloom.llm.components import components

SHINGLE, BANDS, ROWS, FIRST, LEADERS = 5, 24, 4, 4, 3
PLACES = BANDS * ROWS
#: 100 * intersection >= SIMILAR * union
SIMILAR = 75
#: Entries of one shingle that meet in one task.
BLOCK = 1000

_A, _B, _C = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit shingle hashes of a text, on byte arrays."""

    def __init__(self):
        self.lower = np.arange(256, dtype=np.uint64) + np.uint64(1)
        self.lower[65:91] += np.uint64(32)
        self.space = np.zeros(256, bool)
        self.space[[32, 9, 10, 11, 12, 13]] = True
        self.power = np.ones(1, np.uint64)

    def _powers(self, n: int) -> np.ndarray:
        if n > self.power.size:
            self.power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(2 * n, 0x5851F42D4C957F2D, np.uint64))))
        return self.power

    def words(self, text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        inside = ~self.space[raw]
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        starts, ends = edge[::2], edge[1::2]
        if not starts.size:
            return np.zeros(0, np.uint64)
        size = ends - starts
        at = np.flatnonzero(inside)
        first = np.cumsum(size) - size
        values = self.lower[raw[at]] * self._powers(int(size.max()))[np.arange(at.size) - np.repeat(first, size)]
        return mix(np.add.reduceat(values, first) + size.astype(np.uint64) * _C)

    def __call__(self, text: str) -> np.ndarray:
        w = self.words(text)
        if not w.size:
            return w
        n = min(SHINGLE, w.size)
        h = np.full(w.size - n + 1, n, np.uint64)
        for t in range(n):
            h = mix(h * _C + w[t : w.size - n + 1 + t])
        return np.unique(h)


def superminhash(elements: np.ndarray, places: int = PLACES) -> np.ndarray:
    """The signature: in each place the smallest (rank << 32 | random bits) that an element puts there.

    The ranks of one element are a Fisher-Yates permutation; all elements draw a rank together, and once every
    place holds a value of this rank or a lower one, no later rank can matter.
    """
    best = np.full(places, np.iinfo(np.uint64).max, np.uint64)
    n = elements.size
    perm, rows = None, np.arange(n)
    for j in range(places):
        x = mix(elements + np.uint64((j + 1) * int(_C) % 2**64))
        k = j + (((x & np.uint64(0xFFFFFFFF)) * np.uint64(places - j)) >> np.uint64(32)).astype(np.int64)
        if perm is None:
            place = k
        else:
            place = perm[rows, k].astype(np.int64)
        np.minimum.at(best, place, (np.uint64(j) << np.uint64(32)) | (x >> np.uint64(32)))
        if int(best.max()) >> 32 <= j:
            break
        if perm is None:
            perm = np.tile(np.arange(places, dtype=np.uint16), (n, 1))
        perm[rows, k] = perm[rows, j]
    return best


def band_keys(signature: np.ndarray) -> np.ndarray:
    sig = signature.reshape(BANDS, ROWS)
    h = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    for r in range(ROWS):
        h = mix(h * _C + sig[:, r])
    return h


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text hash th, n_shingles, the set's digest (two longs) and its band keys, null for empty sets; written."""

    def run(batches):
        shingler = Shingler()
        for batch in slices(batches):
            n, one, two, keys = [], [], [], []
            for text in batch.column(2).to_pylist():
                s = shingler(text or "")
                n.append(s.size)
                if s.size:
                    d = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                    one.append(int(d[0]))
                    two.append(int(d[1]))
                    keys.append(band_keys(superminhash(s)).view(np.int64))
                else:
                    one.append(None)
                    two.append(None)
                    keys.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "th", "n_shingles", "d1", "d2", "bands"])

    rows = docs.select("doc_id", text_hash(F.col("text")).alias("th"), "text")
    fields = [rows.schema["doc_id"], T.StructField("th", T.LongType()), *[T.StructField(c, T.LongType()) for c in ("n_shingles", "d1", "d2")], T.StructField("bands", T.ArrayType(T.LongType()))]
    return written(rows.mapInArrow(run, T.StructType(fields)), "signatures")


def classes_of(sigs: DataFrame) -> DataFrame:
    """A row per distinct set that isn't empty: digest, number (node), size n, band keys, and one document of it (id_, th_); written.

    Numbers are given as the rows are written, once and for all; what they are changes no result.
    """
    smallest = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("th").alias("th")))
    one = sigs.where("n_shingles > 0").groupBy("d1", "d2").agg(smallest.alias("x"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    return written(one.select("d1", "d2", F.monotonically_increasing_id().alias("node"), "n", "bands", F.col("x.id").alias("id_"), F.col("x.th").alias("th_")), "classes")


def shingle_sets(docs: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, set) of the classes with these numbers (id), set as array of shingle hashes; written."""

    def run(batches):
        shingler = Shingler()
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingler(t or "").view(np.int64) for t in batch.column(1).to_pylist()], pa.list_(pa.int64()))], ["id", "set"])

    n = nodes.count()
    wanted = written(classes.select("node", "id_", "th_").join(small(nodes, n), F.col("node") == F.col("id")).select("node", "id_", "th_"), "wanted")
    texts = docs.select("doc_id", "text").withColumn("th", text_hash(F.col("text")))
    texts = texts.join(small(wanted, n), F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("th") == F.col("th_")))
    # Rows repeated with id and text give their class one set; beyond the broadcast, the join has put them together already.
    texts = texts.groupBy("doc_id", "th").agg(F.first("node").alias("id"), F.first("text").alias("text"))
    out = written(texts.select("id", "text").mapInArrow(run, "id long, set array<long>"), "sets")
    release(wanted)
    return out


def verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough; written."""
    ids = written(pairs.select(F.col("u").alias("id")).unionByName(pairs.select(F.col("v").alias("id"))).distinct(), "ids")
    sets = shingle_sets(docs, classes, ids)
    right = pairs.join(sets.select(F.col("id").alias("v"), F.col("set").alias("sv")), "v")
    both = right.join(sets.select(F.col("id").alias("u"), F.col("set").alias("su")), "u")
    common = F.size(F.array_intersect("su", "sv"))
    out = written(both.where(100 * common >= SIMILAR * (F.size("su") + F.size("sv") - common)).select("u", "v").distinct(), "links")
    release(sets, ids)
    return out


def comparable(n: str, m: str):
    """Sets of these sizes can be similar enough at all."""
    return 100 * F.least(n, m) >= SIMILAR * F.greatest(n, m)


def with_token(entries: DataFrame, table: DataFrame) -> DataFrame:
    """Entries joined with what table says of their shingle (tok, f: how many entries it has).

    Shingles with more than BLOCK entries are few, at most one for every BLOCK entries: their rows are broadcast (in the
    bounds of small()), so their entries needn't meet in one task.
    """
    table = written(table, "tokens")
    hot = table.where(F.col("f") > BLOCK)
    n = hot.count()
    if not n:
        return entries.join(table, "tok")
    rest = entries.join(small(hot.select("tok"), n), "tok", "left_anti").join(table.where(F.col("f") <= BLOCK), "tok")
    return rest.unionByName(entries.join(small(hot, n), "tok"))


def across(docs: DataFrame, classes: DataFrame, open_: DataFrame) -> DataFrame:
    """Pairs (a, b) of open classes (node, n, comp) of different components that may be similar enough: none that is gets lost.

    Two sets are similar only if they share 3/7 of their sizes' sum. In a common order of shingles, a pair's first
    common one at places i and j leaves at most 1 + min(n - i, m - j) common shingles. Shingles held in one
    component alone can't be common to a pair; they come first in the order and cost nothing more.
    """
    need = lambda n, m: 3 * (n + m)  # noqa: E731  in sevenths
    sets = shingle_sets(docs, classes, open_.select(F.col("node").alias("id")))
    tokens = sets.join(open_, F.col("id") == F.col("node")).select("node", "n", "comp", F.explode("set").alias("tok"))
    live = tokens.groupBy("tok").agg(F.count("*").alias("f"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("tok", "f")
    order = with_token(tokens, live).groupBy("node", "n", "comp").agg(F.sort_array(F.collect_list(F.struct("f", "tok"))).alias("ts"))
    order = order.select("node", "n", "comp", F.size("ts").alias("live"), F.posexplode("ts").alias("at", "t"))
    order = order.select("node", "n", "comp", F.col("t.tok").alias("tok"), (F.col("n") - F.col("live") + F.col("at") + 1).alias("i"))
    room = 7 * (F.col("n") - F.col("i") + 1)
    entries = written(order.where(room >= need(F.col("n"), 0.75 * F.col("n"))), "entries")
    # The smallest set behind a shingle tightens how early it has to come.
    least = entries.groupBy("tok").agg(F.min("n").alias("least"), F.count("*").alias("f"))
    entries_ = with_token(entries, least).where(room >= need(F.col("n"), F.greatest(0.75 * F.col("n"), F.col("least")))).drop("least", "f")
    # A shingle's largest component meets the others only, so a group of copies isn't compared with itself.
    per = entries_.groupBy("tok", "comp").agg(F.count("*").alias("c"))
    mixed = per.groupBy("tok").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.max("c").alias("most"), F.sum("c").alias("f")).where("f > most")
    mixed = mixed.select("tok", "main", F.ceil((F.col("f") - F.col("most")) / BLOCK).cast("int").alias("bi"), F.ceil(F.col("f") / BLOCK).cast("int").alias("bj"), "f")
    kept = written(with_token(entries_, mixed).drop("f"), "entries")
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # Block pair (i, j): entries of other components than the largest on the left, all entries on the right.
    left = kept.where("comp != main").withColumn("i_", block("bi")).withColumn("j_", every("bj"))
    right = kept.withColumn("j_", block("bj")).withColumn("i_", every("bi"))
    x, y = (t.select("tok", "i_", "j_", *[F.col(c).alias(c + u) for c in ("node", "n", "comp", "i", "main")]) for t, u in ((left, "x"), (right, "y")))
    pairs = x.join(y, ["tok", "i_", "j_"]).where(
        ((F.col("nodex") < F.col("nodey")) | (F.col("compy") == F.col("mainy"))) & (F.col("compx") != F.col("compy")) & comparable("nx", "ny")
        & (7 * (1 + F.least(F.col("nx") - F.col("ix"), F.col("ny") - F.col("iy"))) >= need(F.col("nx"), F.col("ny")))
    )
    out = written(pairs.select(F.least("nodex", "nodey").alias("a"), F.greatest("nodex", "nodey").alias("b")).distinct(), "across")
    release(sets, entries, kept)
    return out


def grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Signatures of all rows; and of every class its digest (d1, d2) and its component's first document (head, head_th); both written."""
    # Everything in Python is written before this returns.
    with arrow_rows(docs.sparkSession, 1000), scope() as keep:
        sigs = signatures(docs)
        classes = classes_of(sigs)
        labels = linked(docs, classes)
        groups = classes.select("d1", "d2", F.col("node").alias("comp"), F.struct(F.col("id_").isNull().alias("none"), F.col("id_").alias("id"), F.col("th_").alias("th")).alias("x"))
        if labels is not None:
            groups = groups.join(labels, F.col("comp") == F.col("node"), "left").withColumn("comp", F.coalesce("label", "comp"))
            groups = groups.select("d1", "d2", "comp").join(groups.groupBy("comp").agg(F.min("x").alias("x")), "comp")
        groups = written(groups.select("d1", "d2", F.col("x.id").alias("head"), F.col("x.th").alias("head_th")), "groups")
        keep += [sigs, groups]
    return sigs, groups


def linked(docs: DataFrame, classes: DataFrame) -> DataFrame | None:
    """(node, label) of every class that isn't the smallest of its component; None without links."""
    buckets = classes.select("node", "n", F.posexplode("bands").alias("band", "key"))
    crowded = buckets.groupBy("band", "key").agg(F.count("*").alias("c")).where("c > 1").drop("c")
    members = written(buckets.join(crowded, ["band", "key"]).select("band", "key", "node", "n"), "buckets")

    links, compared, labels = [], [], None

    def round_(pairs: DataFrame) -> None:
        nonlocal labels
        pairs = pairs.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
        for old in compared:
            pairs = pairs.join(old, ["u", "v"], "left_anti")
        pairs = written(pairs, "pairs")
        if pairs.isEmpty():
            return
        compared.append(pairs)
        links.append(verified(docs, classes, pairs))
        every = links[0]
        for more in links[1:]:
            every = every.unionByName(more)
        labels = components(every)

    def labelled() -> DataFrame:
        """Members with their component, in buckets that hold several."""
        m = members
        if labels is None:
            m = m.withColumn("comp", F.col("node"))
        else:
            m = m.join(small(labels, labels.count()), "node", "left").withColumn("comp", F.coalesce("label", "node")).drop("label")
        open_ = m.groupBy("band", "key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("band", "key")
        return m.join(small(open_, open_.count()), ["band", "key"])

    head = members.where(F.col("band") < FIRST)
    lead = head.groupBy("band", "key").agg(F.min(F.struct("node", "n")).alias("l"))
    star = head.join(lead, ["band", "key"]).where((F.col("node") != F.col("l.node")) & comparable("n", "l.n"))
    round_(star.select(F.col("node").alias("a"), F.col("l.node").alias("b")))

    m = written(labelled(), "open")
    ranks = [F.min(F.struct(F.xxhash64(F.lit(t), "node").alias("h"), F.struct("node", "n", "comp").alias("x"))) for t in range(LEADERS)]
    lead = m.groupBy("band", "key").agg(F.array_distinct(F.array(*[r["x"] for r in ranks])).alias("ls"))
    star = m.join(lead, ["band", "key"]).select("node", "n", "comp", F.explode("ls").alias("l")).where((F.col("comp") != F.col("l.comp")) & comparable("n", "l.n"))
    round_(star.select(F.col("node").alias("a"), F.col("l.node").alias("b")))

    open_ = written(labelled().select("node", "n", "comp").distinct(), "open")
    if not open_.isEmpty():
        round_(across(docs, classes, open_))
    return labels


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    sigs, groups = grouped(docs)
    out = sigs.select("doc_id", "n_shingles", "d1", "d2").join(groups, ["d1", "d2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("head")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), component.isNull()).alias("kept"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each group: that with the smallest id, of repeated rows any one."""
    sigs, groups = grouped(docs)
    rows = sigs.join(groups, ["d1", "d2"]).groupBy("doc_id", "th", "head", "head_th").agg(F.count("*").alias("n"))
    kept = F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("th") == F.col("head_th"))
    # What goes, and of what stays the repeated rows.
    marked = written(rows.where(~kept | (F.col("n") > 1)).select(F.col("doc_id").alias("id_"), F.col("th").alias("th_"), kept.alias("again_")), "gone")
    release(sigs, groups)
    again = marked.where("again_").count()
    given, names = by_place(docs)
    at = F.col(names["doc_id"]).eqNullSafe(F.col("id_")) & (text_hash(F.col(names["text"])) == F.col("th_"))
    out = given.join(small(marked, marked.count()), at, "left_anti")
    if again:
        same = given.join(small(marked.where("again_"), again), at).groupBy("id_", "th_").agg(F.any_value(F.struct(*given.columns)).alias("x"))
        out = out.unionByName(same.select("x.*"))
    return named_back(out, names)


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

ORACLE = rf"""
with recursive d as (select doc_id, {_WORDS} as w from documents),
s as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] end) as g from d),
n as (select doc_id, len(g) as n from s),
e as (select doc_id, unnest(g) as g from s),
c as (select a.doc_id as u, b.doc_id as v, count(*) as k from e a join e b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select u, v from c join n x on x.doc_id = u join n y on y.doc_id = v where 100 * k >= 75 * (x.n + y.n - k)),
b as (select u, v from l union select v, u from l),
r as (select doc_id as x, doc_id as y from d union select r.x, b.v from r join b on b.u = r.y)
select n.doc_id, cast(n.n as bigint) as n_shingles, min(r.y) as component_id, min(r.y) = n.doc_id as kept from n join r on r.x = n.doc_id group by n.doc_id, n.n
"""
