import random
import zlib

import numpy as np
import pytest

from pathloom.llm import charfeat, labelled, langid, quality, toxicity

WORDS = {"en": "the of and in that with for this from was".split(), "de": "der die und ein nicht mit für auf das von".split(), "fr": "le la des et que pour dans avec sur une".split()}


def sentence(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "er", "tion"]) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def corpus():
    """Rows with language, quality and toxicity, and odd texts at the end."""
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(900):
        lang, bad, toxic = rng.choice(list(WORDS)), rng.random() < 0.3, rng.random() < 0.3
        lines = [" | ".join(sentence(rng, lang, 1) for _ in range(9)) if bad else sentence(rng, lang, 14) for _ in range(rng.choice([1, 2, 6]))]
        if toxic:
            lines[0] += " you idiot scum"
        docs.append((i, "\n".join(lines), lang, "s", "clash"))
        labels.append((i, int(not bad), int(toxic)))
    docs += [(2000, None, "en", None, None), (2001, "", None, "s", None), (2002, "123 !!", "en", "s", ""), (2003, "der und " * 40_000, None, "s", ""), (None, "the of and", "en", "s", ""), (2004, "\n" * 500, "en", "s", ""), docs[0]]
    labels += [(1, None, None), (None, 1, 1), (5000, 1, 1), labels[0]]
    return docs, labels


@pytest.fixture(scope="module")
def frames(spark, corpus):
    docs, labels = corpus
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def rest(doc_id, m):
    return zlib.crc32(str(doc_id).encode()) % m


def test_language(spark, frames, corpus):
    df, _ = frames
    model = langid.fit(langid.training_rows(df))
    out = {r.doc_id: r for r in langid.identify(df, model).collect()}
    held = [d for d in corpus[0][:900] if rest(d[0], 5) == 0]
    assert len(held) > 100 and np.mean([out[d[0]].lang_pred == d[2] for d in held]) > 0.98
    assert all(out[i].lang_pred == "und" for i in (2000, 2001, 2002, 2004)) and out[2003].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in out.values()) and None in out
    assert (model["w"] == 0).mean() > 0.5


def test_rows_repeated_under_one_id_are_sampled_by_hash(spark, monkeypatch):
    """Long texts are as likely drawn as short ones, and no more than TRAIN_ROWS are."""
    sizes = []
    monkeypatch.setattr(langid, "TRAIN_ROWS", 50)
    monkeypatch.setattr(langid, "ftrl", lambda samples, k, f=langid.ftrl: sizes.extend(len(s[0]) for s in samples) or f(samples, k))
    rng = random.Random(4)
    rows = [(1, sentence(rng, "en", 1 if i % 2 else 200), "en") for i in range(300)]
    langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(sizes) == 40 and 8 <= sum(n > 100 for n in sizes) <= 32
    sizes.clear()
    langid.fit(spark.createDataFrame([(1, "the same text", "en")] * 300, "doc_id long, text string, lang string"))
    assert len(sizes) == 40


def test_held_out_rows_and_labels_are_never_used(spark, frames, corpus):
    """Changing held-out rows, or what may not be an input, changes no score of the others."""
    docs, labels = corpus
    base = {r.doc_id: r.score for r in langid.identify(frames[0], langid.fit(langid.training_rows(frames[0]))).collect()}
    turned = [d if rest(d[0], 5) else (d[0], "zzz qqq xxx", "xx", "other", "c") for d in docs if d[0] is not None]
    df = spark.createDataFrame(turned, frames[0].schema)
    got = {r.doc_id: r.score for r in langid.identify(df, langid.fit(langid.training_rows(df))).collect()}
    assert all(abs(base[d[0]] - got[d[0]]) < 1e-6 for d in turned if rest(d[0], 5))
    flipped = spark.createDataFrame([(i, q, 1 - t) if i is not None and t is not None and rest(i, 4) == 2 else (i, q, t) for i, q, t in labels], "doc_id long, quality int, toxic int")
    one, two = (toxicity.fit(frames[0], x) for x in (frames[1], flipped))
    assert (one["bins"] == two["bins"]).all() and np.allclose(one["w"], two["w"])


@pytest.mark.parametrize("module, column, m, held", [(quality, 1, 3, 1), (toxicity, 2, 4, 2)])
def test_document_classifiers(spark, frames, corpus, module, column, m, held):
    model = module.fit(*frames)
    rows = module.score(frames[0], model).collect()
    out = {r.doc_id: r.score for r in rows}
    assert len(rows) == len(corpus[0]) and all(0 <= s <= 1 for s in out.values())
    test = [x for x in corpus[1][:900] if rest(x[0], m) == held]
    assert len(test) > 100 and np.mean([(out[x[0]] >= module.THRESHOLD) == x[column] for x in test]) > 0.97


@pytest.mark.parametrize("module, empty", [(quality, 0.5), (toxicity, 0.0)])
def test_without_labels_or_rows(spark, frames, module, empty):
    model = module.fit(frames[0], frames[1].limit(0))
    assert {r.score for r in module.score(frames[0].limit(5), model).collect()} == {empty}
    assert module.score(frames[0].limit(0), model).count() == 0
    assert langid.fit(frames[0].select("doc_id", "text", "lang").limit(0)) is None
    assert {r.lang_pred for r in langid.identify(frames[0].limit(3), None).collect()} == {"und"}


def test_repeated_ids_do_not_grow_the_sample(spark):
    """50,000 rows of one id, of null ids and labels given often: a row per labelled id, however often it repeats."""
    docs = [(1, f"t{i}") for i in range(50_000)] + [(None, "n")] * 50_000 + [(i, "x") for i in range(2, 12)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1)] * 50 + [(i, i % 2) for i in range(2, 12)], "doc_id long, toxic int")
    sample, counts = labelled.sample(df, labels, "toxic", 4, 2, {0: 3, 1: 4}, 23)
    rows = sample.collect()
    assert len(rows) <= 7 and max(sum(r.y == y for r in rows) for y in (0, 1)) <= 4 and sum(counts.values()) <= 11
    assert not any(r.text != "x" and r.text != "t0" for r in rows)


def test_language_sample_is_bounded(spark):
    docs = [(1, "the same", "en")] * 30_000 + [(None, "der und", "de")] * 30_000 + [(i, "the of", "en") for i in range(100)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    assert langid.sampled(df, "doc_id").count() == langid.TRAIN_ROWS


def test_extra_columns_of_clashing_names(spark, frames):
    df = frames[0].withColumn("__c0", toxicity.F.lit("z")).withColumn("lang_pred", toxicity.F.lit(9)).withColumn("at", toxicity.F.lit("q"))
    out = langid.identify(df, None)
    assert out.columns == ["doc_id", "text", "lang", "source", "__c0", "at", "lang_pred", "score"]
    assert toxicity.score(df, {"constant": 0.5}).columns == df.columns == quality.score(df, {"constant": 0.5}).columns


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5):
        odds, trans = rng.normal(size=n) * 2, rng.normal(size=(2, 2))
        weight = {}
        for code in range(2**n):
            y = [code >> i & 1 for i in range(n)]
            weight[tuple(y)] = np.exp(sum(o * v for o, v in zip(odds, y, strict=True)) + sum(trans[a, b] for a, b in zip(y, y[1:], strict=False)))
        z = sum(weight.values())
        want = [sum(v for y, v in weight.items() if y[i]) / z for i in range(n)]
        assert np.allclose(quality.marginals(odds, trans), want)


def test_crf_gradient_finds_neighbour_dependence():
    """Chains whose own features say nothing but at one line: transitions must carry the label."""
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 200).astype(float)
    x = np.zeros((200, 5, 2), np.float32)
    x[:, 2, 0] = 2 * y - 1
    x[..., 1] = 1
    w, trans = quality.train(x, y, np.ones((200, 5), bool))
    assert trans[0, 0] + trans[1, 1] > trans[0, 1] + trans[1, 0] + 1
    assert quality.marginals(x[0] @ w, trans)[0] > 0.8 if y[0] else quality.marginals(x[0] @ w, trans)[0] < 0.2


def test_lines_far_down_are_learnt_from(spark):
    """Good and bad documents that differ after their first 60 lines only."""
    rng = random.Random(8)
    good = lambda: sentence(rng, "en", 14)
    bad = lambda: " | ".join(sentence(rng, "en", 1) for _ in range(9))
    docs = [(i, "\n".join([*(good() for _ in range(60)), *((bad if i % 2 else good)() for _ in range(60))])) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = quality.fit(df, spark.createDataFrame([(i, 1 - i % 2) for i, _ in docs], "doc_id long, quality int"))
    assert all((r.score >= quality.THRESHOLD) == (r.doc_id % 2 == 0) for r in quality.score(df, model).collect())


def test_ftrl_and_features():
    table = charfeat.letter_table()
    assert "".join(map(chr, charfeat.letters("Hé, 2x\tÄ𝔘", table))).startswith(" hé x ä")
    assert (charfeat.hashed(charfeat.letters("abc", table), (3,), 20) == charfeat.hashed(charfeat.letters("ABC!", table), (3,), 20)).all()
    rng = np.random.default_rng(0)
    samples = [(np.array([y, 10 + rng.integers(50)]), np.array([0.8, 0.6]), y) for y in rng.integers(0, 3, 600)]
    w, b = langid.ftrl(samples, 3)
    assert np.mean([np.argmax(v @ w[at] + b) == y for at, v, y in samples]) > 0.99 and (w == 0).mean() > 0.9
    logits = np.array([[4.0, 0, 0], [0, 4.0, 0], [4.0, 0, 0], [4.0, 0, 0]])
    assert langid.temperature(logits, np.array([0, 1, 1, 2])) > 1 > langid.temperature(logits / 4, np.array([0, 1, 0, 0]))


def test_fits_stay_within_their_budgets(spark, frames, corpus, monkeypatch):
    """Documents of 10^5 lines are passed over once the budget is spent, and the others still teach."""
    monkeypatch.setattr(quality, "LINES", 1500)
    monkeypatch.setattr(toxicity, "CHARACTERS", 60_000)
    seen = []
    monkeypatch.setattr(quality, "train", lambda x, y, f=quality.train: seen.append(sum(map(len, x))) or f(x, y))
    monkeypatch.setattr(toxicity, "learn", lambda flat, sizes, y, prior, f=toxicity.learn: seen.append(int(sizes.size)) or f(flat, sizes, y, prior))
    docs, labels = frames
    huge = spark.createDataFrame([(10_000 + i, "der und\n" * 100_000, "de", "s", "") for i in range(4)], docs.schema)
    marks = spark.createDataFrame([(10_000 + i, i % 2, i % 2) for i in range(4)], labels.schema)
    held = [d for d in corpus[0][:900] if rest(d[0], 3) == 1]
    want = {i: q for i, q, _ in corpus[1][:900]}
    model = quality.fit(docs.unionByName(huge), labels.unionByName(marks))
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert 1000 < seen[0] <= 1500 and np.mean([(got[d[0]] >= 0.5) == want[d[0]] for d in held]) > 0.9
    toxicity.fit(docs.unionByName(huge), labels.unionByName(marks))
    assert 50 < seen[1] < 700


def test_columns_called_like_helpers(spark):
    from pathloom.llm import decontam, minhash

    names = ["doc_id", "text", "lang", "__pl_id", "__pl_th", "__pl_again", "__pl_found", "id_", "th_", "again_", "found_", "c0_", "c1_", "h", "node"]
    rows = [(i, f"one two three four five six seven eight nine ten eleven {i // 2}", "en", *["x"] * 12) for i in range(4)] + [(0, "one two three four five six seven eight nine ten eleven 0", "en", *["x"] * 12)]
    docs = spark.createDataFrame(rows, ", ".join(f"{c} {'long' if c == 'doc_id' else 'string'}" for c in names))
    left = minhash.drop_copies(docs)
    assert left.columns == names and [r.doc_id for r in left.collect()] == [0]
    assert decontam.clean(docs, spark.createDataFrame([("i", "of quite other words")], "item_id string, text string")).count() == 5
    found = langid.identify(docs, None)
    assert found.columns == [*names, "lang_pred", "score"] and {r.found_ for r in found.collect()} == {"x"}
