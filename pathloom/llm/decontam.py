"""Benchmark decontamination through a distributed positional inverted index.

The index stores for every token of the documents its document and position, and for every document a
header row; it is written once, without a shuffle, by a single pass over the texts. For a search that is
made once, ``find`` has it hold only tokens that are benchmark terms (no others can match anything); an index of
all tokens, ``build_index(docs)``, serves any number of benchmarks. Searches work on it alone until the last step:

1. Corpus frequencies of the terms order the words of every benchmark window (10 consecutive words
   of an item; a shorter item is one window) from the rarest.
2. The posting lists of each window's two rarest terms, adjusted by the terms' offsets in the item,
   meet in a grouping by (document, item, adjusted position): a window that occurs has both there.
3. The few places found are compared word by word with the documents' texts, which gives the exact
   phrase matches.
4. Proximity matches come from the posting lists of an item's three rarest terms that occur at all (an item with
   too few of them has none): all of them lie within SLOP words of each other, in any order.

Words are runs of a-z, 0-9 and non-ASCII characters after A-Z are lower-cased. Null and empty texts
have no words; items without words match nothing. Repeated documents each get their row; repeated
items count once; a null item id counts as the empty string. Documents are told apart by id and hash
of the text, so different texts under one id don't mix. Benchmark-side tables are broadcast while
their counted rows stay under BROADCAST_ROWS and are joined by shuffles beyond it.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import by_place, named_back, release, small, written

#: ASCII characters that belong to no word.
OUTSIDE = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 10
SLOP = 20


class Matches(NamedTuple):
    #: doc_id, text hash, n_words of every document row
    headers: DataFrame
    #: doc_id, text hash, item_id, start (word position), length of every exact window occurrence
    exact: DataFrame
    #: doc_id, text hash, item_id of every proximity match
    near: DataFrame


def words_of(text: Column) -> Column:
    """The words in order. Lower-casing and blanking all else in one go and cutting at blanks takes a tenth of a pattern's time."""
    plain = F.translate(F.coalesce(text, F.lit("")), UPPER + OUTSIDE, UPPER.lower() + " " * len(OUTSIDE))
    return F.array_remove(F.split(plain, " "), "")


def term_of(word: Column) -> Column:
    return F.xxhash64(word)


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def build_index(docs: DataFrame, vocabulary: DataFrame | None = None, n_terms: int = 0) -> DataFrame:
    """Postings (doc_id, th, n_words, term, pos) and a row with null term for each document; of the n_terms words (w_, term) of the vocabulary, else of all."""
    rows = docs.select("doc_id", text_hash(F.col("text")).alias("th"), words_of(F.col("text")).alias("ws_"))
    # The marker before the first word becomes the header row.
    rows = rows.select("doc_id", "th", F.size("ws_").alias("n_words"), F.posexplode(F.concat(F.array(F.lit("\x00")), F.col("ws_"))).alias("pos", "w_"))
    if vocabulary is None:
        rows = rows.withColumn("term", F.when(F.col("w_") != "\x00", term_of(F.col("w_"))))
    else:
        head = docs.sparkSession.createDataFrame([("\x00", None)], "w_ string, term long")
        rows = rows.join(small(vocabulary.unionByName(head), n_terms + 1), "w_")
    return written(rows.select("doc_id", "th", "n_words", "term", (F.col("pos") - 1).alias("pos")), "postings")


def find(docs: DataFrame, items: DataFrame, index: DataFrame | None = None) -> tuple[Matches, list[DataFrame]]:
    """The matches, and written tables to release() once they have been used. index: one of all of docs' tokens, if there is one."""
    items = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words_of(F.col("text")).alias("iw")).where(F.size("iw") > 0).distinct()
    items = written(items.withColumn("item", F.xxhash64("item_id", "iw")), "items")
    n_items = items.count()
    spots = items.select("item", F.posexplode("iw").alias("i", "w_")).withColumn("term", term_of(F.col("w_")))
    vocabulary = spots.select("w_", "term").distinct()
    n_terms, used = vocabulary.count(), [items]
    if index is None:
        index = build_index(docs, vocabulary, n_terms)
        used.append(index)
        postings = index.where(F.col("term").isNotNull())
    else:
        postings = index.join(small(vocabulary.select("term").distinct(), n_terms), "term")

    freq = postings.groupBy("term").agg(F.count("*").alias("f"))
    ranked = written(spots.join(freq, "term", "left").select("item", "i", "term", F.coalesce("f", F.lit(0)).alias("f")), "terms")
    n_spots = ranked.count()
    lists = ranked.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("i", "f", "term"))).alias("t_"))
    width = F.least(F.lit(WINDOW), F.size("t_"))
    window = lambda s: F.array_sort(F.transform(F.slice("t_", s + 1, width), lambda x: F.struct(x["f"].alias("f"), x["i"].alias("i"), x["term"].alias("term"))))
    windows = lists.select("item", F.transform(F.sequence(F.lit(0), F.size("t_") - width), lambda s: F.struct(s.alias("s"), F.slice(window(s), 1, 2).alias("rare"), F.forall(window(s), lambda x: x["f"] > 0).alias("can"))).alias("v_"))
    windows = windows.select("item", F.filter("v_", lambda v: v["can"]).alias("v_")).where(F.size("v_") > 0)
    rare = windows.select("item", F.explode(F.array_distinct(F.flatten(F.transform("v_", lambda v: F.transform(v["rare"], lambda x: F.struct(x["i"].alias("i"), x["term"].alias("term"))))))).alias("x")).select("item", "x.*")
    needed = windows.select("item", F.transform("v_", lambda v: F.transform(v["rare"], lambda x: x["i"])).alias("needs_"))

    # Offset-adjusted lists meet: one group per document, item and place of the item's first word.
    met = postings.join(small(rare, n_spots), "term").groupBy("doc_id", "th", "item", (F.col("pos") - F.col("i")).alias("d")).agg(F.collect_set("i").alias("is_"))
    met = met.join(small(needed, n_items), "item").where(F.exists("needs_", lambda need: F.size(F.array_except(need, F.col("is_"))) == 0))
    places = written(met.select("doc_id", "th", "item", "d"), "places")

    # Exact comparison with the texts of the documents found.
    n_places = places.count()
    by_doc = places.join(small(items.select("item", F.size("iw").alias("n")), n_items), "item").groupBy("doc_id", "th").agg(F.collect_set(F.struct("item", "d", "n")).alias("c_"))
    by_doc = small(by_doc.withColumnRenamed("doc_id", "id_").withColumnRenamed("th", "th_"), n_places)
    texts = docs.select("doc_id", "text").withColumn("th", text_hash(F.col("text"))).join(by_doc, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("th") == F.col("th_")))
    texts = texts.select("doc_id", "th", words_of(F.col("text")).alias("ws_"), "c_")
    cut = texts.select(
        "doc_id",
        "th",
        F.explode(F.transform("c_", lambda c: F.struct(c["item"].alias("item"), F.greatest(c["d"], F.lit(0)).alias("p"), F.greatest(-c["d"], F.lit(0)).alias("off"), F.slice("ws_", F.greatest(c["d"], F.lit(0)) + 1, c["n"] - F.greatest(-c["d"], F.lit(0))).alias("got")))).alias("x"),
    ).select("doc_id", "th", "x.*")
    cut = cut.join(small(items.select("item", "item_id", "iw"), n_items), "item").withColumn("k", F.least(F.lit(WINDOW), F.size("iw")))
    starts = F.filter(
        F.sequence(F.lit(0), F.greatest(F.size("got") - F.col("k"), F.lit(0))),
        lambda s: (F.size("got") >= F.col("k")) & (F.slice("got", s + 1, F.col("k")) == F.slice("iw", s + F.col("off") + 1, F.col("k"))),
    )
    exact = cut.select("doc_id", "th", "item_id", F.explode(F.transform(starts, lambda s: s + F.col("p"))).alias("start"), F.col("k").alias("length"))

    # Proximity: the three rarest distinct terms of an item that the documents hold (all, if it has fewer) within SLOP words.
    terms = ranked.groupBy("item", "term").agg(F.min("f").alias("f"), F.min("i").alias("i"))
    terms = terms.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("f", "i", "term"))).alias("t_"))
    terms = terms.select("item", F.least(F.lit(3), F.size("t_")).alias("need"), F.slice(F.filter("t_", lambda x: x["f"] > 0), 1, 3).alias("t_")).where(F.size("t_") == F.col("need"))
    terms = terms.select("item", "need", F.explode("t_.term").alias("term"))
    close = postings.join(small(terms, n_spots), "term").groupBy("doc_id", "th", "item").agg(F.sort_array(F.collect_set(F.struct("pos", "term"))).alias("e_"), F.max("need").alias("need"))
    apart = lambda i: F.size(F.array_distinct(F.transform(F.filter(F.slice("e_", i + 1, F.lit(3 * SLOP)), lambda x: x["pos"] - F.element_at("e_", i + 1)["pos"] <= SLOP), lambda x: x["term"])))
    close = close.where(F.exists(F.sequence(F.lit(0), F.size("e_") - 1), lambda i: apart(i) >= F.col("need")))
    near = close.join(small(items.select("item", "item_id"), n_items), "item").select("doc_id", "th", "item_id").distinct()
    headers = index.where(F.col("term").isNull()).select("doc_id", "th", "n_words")
    return Matches(headers, exact, near), [*used, ranked, places]


def report(matches: Matches) -> DataFrame:
    """A row per document with the words hit by windows, the items that occur, and the items near."""
    hits = matches.exact.groupBy("doc_id", "th").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set(F.sequence("start", F.col("start") + F.col("length") - 1))))).cast("long").alias("n_hit"),
        F.sort_array(F.collect_set("item_id")).alias("ids_"),
    )
    near = matches.near.groupBy("doc_id", "th").agg(F.count("*").alias("n_near"))
    out = matches.headers
    for x in (hits, near):
        x = x.withColumnRenamed("doc_id", "id_").withColumnRenamed("th", "th_")
        out = out.join(x, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("th") == F.col("th_")), "left").drop("id_", "th_")
    ids = F.coalesce("ids_", F.array().cast("array<string>"))
    return out.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    matches, _ = find(docs, items)
    return report(matches)


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the documents in which a benchmark window occurs."""
    matches, used = find(docs, items)
    bad = written(matches.exact.select("doc_id", "th").distinct(), "contaminated")
    release(*used)
    bad = small(bad.withColumnRenamed("doc_id", "id_").withColumnRenamed("th", "th_"), bad.count())
    given, at = by_place(docs)
    return named_back(given.join(bad, F.col(at["doc_id"]).eqNullSafe(F.col("id_")) & (text_hash(F.col(at["text"])) == F.col("th_")), "left_anti"), at)


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE = f"""
with d as (select row_number() over () as r, doc_id, {_SQL_WORDS} as w from documents),
i as (select distinct coalesce(cast(item_id as varchar), '') as item_id, {_SQL_WORDS} as w from benchmark),
iw as (select item_id, least(10, len(w)) as k, unnest([array_to_string(w[s:s + least(10, len(w)) - 1], ' ') for s in range(1, len(w) - least(10, len(w)) + 2)]) as g from i where len(w) > 0),
ks as (select distinct k from iw),
dg as (select r, k, unnest(range(1, len(w) - k + 2)) as p, w from d, ks where len(w) >= k),
hit as (select distinct dg.r, dg.p, dg.k, iw.item_id from dg join iw on iw.k = dg.k and iw.g = array_to_string(dg.w[dg.p:dg.p + dg.k - 1], ' ')),
pos as (select r, count(distinct q) as n_hit from (select r, unnest(range(p, p + k)) as q from hit) group by r),
its as (select r, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct r, item_id from hit) group by r),
tok as (select r, unnest(w) as t, unnest(range(1, len(w) + 1)) as p from d),
f as (select t, count(*) as f from tok group by t),
it as (select item_id, w as iw, t, min(n) as n from (select item_id, w, unnest(w) as t, unnest(range(1, len(w) + 1)) as n from i) group by 1, 2, 3),
cnt as (select item_id, iw, least(3, count(*)) as need from it group by 1, 2),
top as (select * from (select it.item_id, it.iw, it.t, f.f, row_number() over (partition by it.item_id, it.iw order by f.f, it.n) as rk from it join f using (t)) where rk <= 3),
ok as (select item_id, iw, max(need) as need from top join cnt using (item_id, iw) group by 1, 2 having count(*) = max(need)),
post as (select tok.r, top.item_id, top.iw, ok.need, tok.t, tok.p from top join ok using (item_id, iw) join tok using (t)),
near as (select r, count(distinct item_id) as n_near from (select a.r, a.item_id, a.iw, a.p from post a join post b on a.r = b.r and a.item_id = b.item_id and a.iw = b.iw and b.p between a.p and a.p + {SLOP} group by 1, 2, 3, 4 having count(distinct b.t) >= max(a.need)) group by r)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated, cast(coalesce(n_near, 0) as bigint) as n_near
from d left join pos using (r) left join its using (r) left join near using (r)
"""
