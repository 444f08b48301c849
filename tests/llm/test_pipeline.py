"""Stages of the pipeline on their own input, against brute force, and the registered queries against DuckDB."""

import os
import random

import duckdb
import pytest

import corpus_pipeline
from pathloom.llm import langid, registry
from tests.llm.test_minhash import brute as groups

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    d = tmp_path_factory.mktemp("tables")
    words = {"en": "the of and in that with for this".split(), "de": "der die und ein nicht mit für auf".split()}
    text = lambda lang, n: " ".join(rng.choice(words[lang]) + rng.choice(["", "en", "s", "ag"]) + rng.choice("abcdefg") for _ in range(n))
    docs = [(i, text(lang := rng.choice(["en", "de"]), 60), lang, f"src{rng.randrange(3)}", 1) for i in range(250)]
    items = [(i, text("en", 14)) for i in range(5)]
    docs += [(300 + i, docs[i][1] + " extra", "en", "src0", 1) for i in range(20)] + [(400 + i, text("en", 20) + " " + items[i][1] + " " + text("en", 20), "en", "src1", 1) for i in range(5)]
    docs += [(500, None, "en", "src0", 0), (501, "123", None, "src0", 3), (502, "", "en", None, 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    cols = docs.columns
    known = corpus_pipeline.identified(spark, docs, folder)
    assert known.columns == cols
    ids = {r.doc_id for r in known.collect()}
    assert not ids & {500, 501, 502} and len(ids) > 265
    single = corpus_pipeline.deduplicated(spark, known, folder)
    assert single.columns == cols
    rows = [(r.doc_id, r.text) for r in known.select("doc_id", "text").collect()]
    left = {r.doc_id for r in single.collect()}
    assert left == {d for d, _, _, kept in groups(rows) if kept}
    clean = corpus_pipeline.decontaminated(spark, single, folder)
    assert clean.columns == cols and left - {r.doc_id for r in clean.collect()} == {d for d in left if 400 <= d < 405}
    mixed = corpus_pipeline.weighted(spark, clean, folder)
    assert mixed.columns == cols and 0 < mixed.count() <= clean.count()
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == [*cols, "shard", "slot"]
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in mixed.collect()}


def test_empty_documents(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_model_without_training_rows(spark):
    assert langid.fit(spark.createDataFrame([], "doc_id long, text string, lang string")) is None


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    df = registry.QUERIES[name](spark, DIR)
    cur = con.execute(registry.ORACLES[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted(repr([plain(r[cols.index(c)]) for c in sorted(cols)]) for r in cur.fetchall())
    assert sorted(repr([plain(r[c]) for c in sorted(cols)]) for r in df.collect()) == want
