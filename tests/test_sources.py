"""Readers, caches, the shared folder and packaging."""

import json
import zipfile
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from pathloom import cli
from pathloom.functions import abbreviated_metapath, rule_text
from pathloom.operators import paths
from pathloom.sources import packaging, readers, stages


def test_delimited_files(spark, tmp_path):
    file = tmp_path / "a.tsv"
    file.write_text('#one\n#two\nx\ty\tz\n1\t"a\tb"c\t\n#data\t"q""r"\t3\n\n2\tlast\n')
    rows = readers.read_delimited(spark, str(file), comment="#").collect()
    assert [tuple(r) for r in rows] == [("1", "a\tbc", ""), ("#data", 'q"r"', "3"), ("2", "last", None)]
    assert readers.read_delimited(spark, str(file), comment="#").columns == ["x", "y", "z"]
    named = readers.read_delimited(spark, str(file), ["p", "q"], comment="#").collect()
    assert [tuple(r) for r in named][:2] == [("x", "y"), ("1", "a\tbc")]
    (tmp_path / "b.csv").write_text("a|b\n1|2\n")
    assert [tuple(r) for r in readers.read_delimited(spark, str(tmp_path / "b.csv"), sep="|").collect()] == [("1", "2")]


def test_pair_files(spark, tmp_path):
    (tmp_path / "p.tsv").write_text("score\tleft\tright\tw\n9\tA\tB\t0.5\n8\tC\tD\t\n")
    rows = readers.read_pairs(spark, str(tmp_path / "p.tsv"), header=True, gene_cols=("left", "right"), weight_col="w").orderBy("line").collect()
    assert [(r.gene_1, r.gene_2, r.weight) for r in rows] == [("A", "B", 0.5), ("C", "D", 1.0)]
    with pytest.raises(ValueError):
        readers.read_pairs(spark, str(tmp_path / "p.tsv"), header=True)
    (tmp_path / "q.tsv").write_text("A\tB\nC\tD\t2\n")
    assert [(r.gene_1, r.gene_2, r.weight) for r in readers.read_pairs(spark, str(tmp_path / "q.tsv"), header=False).orderBy("line").collect()] == [("A", "B", 1.0), ("C", "D", 2.0)]
    (tmp_path / "bad.tsv").write_text("A\tB\theavy\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        readers.read_pairs(spark, str(tmp_path / "bad.tsv"), header=False).collect()


def test_value_cache(spark, tmp_path):
    calls = []
    build = lambda key: calls.append(key) or {"n": len(calls), "key": key}
    cache = stages.ValueCache(spark, f"{tmp_path}/values")
    assert cache.get("a") is None and cache.get_or_store("a", build) == cache.get_or_store("a", build) == {"n": 1, "key": "a"}
    assert cache.get_or_store(["b", 2], build)["n"] == 2 and cache.get("a")["n"] == 1
    assert stages.ValueCache(spark, f"{tmp_path}/values", update=True).get_or_store("a", build)["n"] == 3 == cache.get("a")["n"]


def test_shared_folder_must_be_named_off_a_local_master():
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: ""), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        stages.shared_dir(cluster)
    cluster.conf.get = lambda *_: "hdfs://x/y/"
    assert stages.shared_dir(cluster) == "hdfs://x/y"


def test_intermediates_are_deleted(spark):
    stages.release_all()
    with stages.scope() as keep:
        one, two = (stages.written(spark.range(n), "t") for n in (2, 3))
        keep.append(two)
    assert stages._left == {two._pathloom_path} and two.count() == 3
    with pytest.raises(Exception):
        one.count()
    stages.release_all()
    assert not stages._left and not spark.sparkContext._jvm.java.io.File(two._pathloom_path.removeprefix("file://")).exists()


def test_package_is_sent_to_executors(tmp_path):
    with zipfile.ZipFile(packaging.archive(str(tmp_path))) as z:
        assert {"pathloom/__init__.py", "pathloom/operators/paths.py", "pathloom/sources/packaging.py"} <= set(z.namelist())
    sent = []
    context = SimpleNamespace(master="yarn", addPyFile=sent.append)
    assert packaging.ship(SimpleNamespace(sparkContext=context)) == sent[0]
    context.master = "local[4]"
    assert packaging.ship(SimpleNamespace(sparkContext=context)) is None and len(sent) == 1


def test_settings_from_files(spark, tmp_path):
    (tmp_path / "paths.json").write_text(json.dumps({"kg": "none.graphml", "sparkle": 1}))
    with pytest.raises(KeyError):
        cli.main(["train", "--paths", str(tmp_path / "paths.json")], spark)
    with pytest.raises(SystemExit):
        cli.main(["train"], spark)


def test_names_for_readers(spark):
    df = spark.sql("select array('has','of') e, array('Protein') t, map('Gene','G','Protein','P') d, map('has','h') l, 3 r, 'a + b' p, 7 n, array(0.5D, 0.25D) thr")
    r = df.select(abbreviated_metapath(F.col("e"), F.col("t"), F.col("d"), F.col("l"), "Gene").alias("s"), rule_text(F.col("r"), F.col("p"), F.col("n"), F.lit(0), F.col("thr")).alias("x")).first()
    assert r.s == "GhPofG" and r.x == "R3: a + b [THR= 0.5000, 0.2500] -> 1 | Positive matches: 7 | Negative matches: 0"


def test_hubs_meet_only_for_pairs(spark):
    """A hub between many ends: paths come for the pairs asked for alone."""
    edges = [(f"x{i}", "hub", "T", "H", "l", 0.5) for i in range(60)] + [("hub", f"y{i}", "H", "T", "m", 0.5) for i in range(60)]
    adjacency = spark.createDataFrame([(*e, None) for e in edges], "src string, dst string, src_type string, dst_type string, label string, score double, ctx array<string>")
    pairs = spark.createDataFrame([("p", "x1", "y2"), ("q", "x1", "y3"), ("r", "x5", "x6")], "pair_id string, a string, b string")
    out = paths.enumerate_paths(pairs, adjacency)
    assert sorted((r.pair_id, r.nodes, round(r.score, 6)) for r in out.collect()) == [("p", ["hub"], 0.5), ("q", ["hub"], 0.5)]


def test_stages_follow_the_state_of_their_inputs(spark, tmp_path):
    """A file that changed under the same name isn't served from the cache; nor is an unchanged one built again."""
    from pathloom.sources.stages import StageCache

    built, graph = [], tmp_path / "kg.txt"
    cache = StageCache(f"file://{tmp_path}/cache")

    def stage():
        return cache.get_or_store(spark, "lines", lambda: built.append(1) or spark.read.text(str(graph)), kg=str(graph), cutoff=3).collect()

    graph.write_text("one")
    assert [r.value for r in stage()] == ["one"] == [r.value for r in stage()] and len(built) == 1
    graph.write_text("two, and longer")
    assert [r.value for r in stage()] == ["two, and longer"] and len(built) == 2
    assert cache.path("lines", kg=str(graph), cutoff=4) != cache.path("lines", kg=str(graph), cutoff=3)


def test_running_sums(spark):
    from pyspark.sql import functions as F

    from pathloom.sources.stages import running_sums

    rows = running_sums(spark.range(300).select("id", F.lit(0.5).alias("x")).repartition(6), F.desc("id"), "x").collect()
    assert {r.id: r.x_upto for r in rows} == {i: 0.5 * (300 - i) for i in range(300)}


def test_records_are_numbered_over_all_parts(spark, tmp_path):
    """Places follow the order of parts and lines, in several tasks; no task has them all."""
    from pathloom.sources import readers, sinks

    rows = spark.range(3000).selectExpr("concat('a', id) as gene_name_A", "'b' as gene_name_B", "concat('a', id) as ens_id_A", "'\"x' as ens_id_B", "id / 3000 as predicted_proba")
    sinks.write_predictions(rows.repartition(5), f"{tmp_path}/out")
    back = readers.read_delimited(spark, f"{tmp_path}/out", place="place")
    got = back.collect()
    assert {(r.place, r.ens_id_A) for r in got} == {(3000 - i, f"a{i}") for i in range(3000)} and {r.gene_name_B for r in got} == {"b"}
    assert "SinglePartition" not in back._jdf.queryExecution().executedPlan().toString()
