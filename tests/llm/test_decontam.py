import random
import re

from pathloom.llm import decontam

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

def brute(docs, items):
    words = lambda t: re.findall(WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i, x in items:
            iw = words(x)
            k = min(10, len(iw))
            wins = {tuple(iw[s : s + k]) for s in range(len(iw) - k + 1)} if k else set()
            for p in range(len(w) - k + 1) if k else ():
                if tuple(w[p : p + k]) in wins:
                    hit |= set(range(p, p + k))
                    found.add("" if i is None else str(i))
        out.append((d, len(w), len(hit), len(found), bool(hit)))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocab = ["the", "of", "a", "é", *[f"w{i}" for i in range(30)]]
    text = lambda n: " ".join(rng.choices(vocab, [9, 9, 9, 3, *[1] * 30], k=n))
    items = [(i, text(rng.choice([1, 2, 5, 9, 10, 11, 25]))) for i in range(25)] + [(3, "The THE the the the the the the the the the"), (None, "of a of"), (99, ""), (98, None), (97, "... !!")]
    items += items[:3]
    docs = []
    for d in range(60):
        t = text(rng.choice([0, 3, 40]))
        if d % 2:
            t += ", " + rng.choice(items)[1].upper() + "! " if rng.random() < 2 and (x := rng.choice(items))[1] and False else " " + (rng.choice(items[:25])[1]).upper() + "; " + text(5)
        docs.append((d, t))
    docs += [(7, "other text " + items[9][1]), (None, items[12][1]), (500, None), (501, ""), (502, (items[5][1] + " ") * 300), docs[1]]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, id_ string, th_ int")
    matches, used = decontam.find(df.select("doc_id", "text"), spark.createDataFrame(items, "item_id long, text string"))
    got = sorted([(r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontam.report(matches).collect()], key=repr)
    assert got == brute(docs, items)
    clean = decontam.clean(df, spark.createDataFrame(items, "item_id long, text string"))
    assert clean.columns == df.columns
    assert sorted([r.doc_id for r in clean.collect()], key=repr) == sorted([r[0] for r in brute(docs, items) if not r[4]], key=repr)


def test_proximity_and_empty(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma " + " ".join(f"x{i}" for i in range(12)))], "item_id long, text string")
    docs = [(1, "gamma q q alpha q beta"), (2, "gamma " + "q " * 40 + "alpha beta"), (3, "alpha beta"), *[(9 + i, f"x{i}") for i in range(12)]]
    docs += [(100 + j, " ; ".join(f"x{i}" for i in range(12))) for j in range(5)]
    m, _ = decontam.find(spark.createDataFrame(docs, "doc_id long, text string"), items)
    assert 1 in {r.doc_id for r in m.near.collect()} and not {2, 3} & {r.doc_id for r in m.near.collect()}
    none = spark.createDataFrame([], "item_id long, text string")
    m, _ = decontam.find(spark.createDataFrame(docs, "doc_id long, text string"), none)
    assert decontam.report(m).where("contaminated or n_near > 0").count() == 0
    m, _ = decontam.find(spark.createDataFrame([], "doc_id long, text string"), items)
    assert decontam.report(m).count() == 0


def test_words_of_any_characters(spark):
    rng = random.Random(4)
    odd = [chr(c) for c in range(128)] + ["é", "É", "\u00a0", "\u2003", "𝔘", "ß", "İ", "中"]
    texts = [None, "", " ", "a", "Ab-c"] + ["".join(rng.choice(odd) for _ in range(rng.randrange(80))) for _ in range(500)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    got = dict(df.select("i", decontam.words_of(decontam.F.col("t"))).collect())
    assert got == {i: re.findall(WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or ""))) for i, t in enumerate(texts)}


def test_one_index_of_all_tokens_serves_several_benchmarks(spark):
    rng = random.Random(6)
    text = lambda n: " ".join(rng.choice(["a", "b", "c", *[f"w{i}" for i in range(20)]]) for _ in range(n))
    docs = [(i, text(60)) for i in range(30)]
    one = [(1, docs[3][1][40:90]), (2, text(4))]
    two = [(7, docs[8][1][10:80]), (8, "nowhere " + text(3))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    index = decontam.build_index(df)
    for items in (one, two):
        x = spark.createDataFrame(items, "item_id long, text string")
        reports = [sorted(map(tuple, decontam.report(decontam.find(df, x, i)[0]).collect())) for i in (None, index)]
        assert reports[0] == reports[1] and sorted([(*r[:4], r[5]) for r in reports[0]], key=repr) == brute(docs, items)


def test_proximity_of_items_with_absent_words(spark):
    """A word that no document holds doesn't hide the others; too few left is no match."""
    df = spark.createDataFrame([(1, "x alpha y beta z gamma"), (2, "alpha beta"), (3, "solo")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha missing beta gone gamma"), (2, "solo and nothing else here"), (3, "solo")], "item_id long, text string")
    near = decontam.find(df, items)[0].near
    assert {(r.doc_id, r.item_id) for r in near.collect()} == {(1, "1"), (3, "3")}


def test_very_long_text(spark):
    """A document of 400,000 words with the item at its end, and one that is the item over and over."""
    item = " ".join(f"k{i}" for i in range(12))
    df = spark.createDataFrame([(1, "w v " * 200_000 + item), (2, (item + " ") * 3000)], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit) for r in decontam.report(decontam.find(df, spark.createDataFrame([(1, item)], "item_id long, text string"))[0]).collect()}
    assert got == {1: (400_012, 12), 2: (36_000, 36_000)}
