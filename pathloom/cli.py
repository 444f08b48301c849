"""Command line: train, predict, explain, evaluate, test."""

from __future__ import annotations

import argparse
from dataclasses import asdict, replace

from pyspark.sql import SparkSession

from pathloom.operators import samples
from pathloom.plans import workflow
from pathloom.plans.workflow import Params
from pathloom.sources import sinks
from pathloom.sources.models import load_model, save_model
from pathloom.sources.packaging import session
from pathloom.sources.readers import pair_literal, read_graphml, read_pairs
from pathloom.operators.graph import Graph
from pathloom.sources.stages import StageCache, load_params

#: Node column that raw gene names of each format stand for.
GENE_KEYS = {"Ensembl": "id", "HGNC": "name"}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pathloom", description=__doc__)
    p.add_argument("action", choices=["train", "predict", "explain", "evaluate", "test"])
    p.add_argument("--kg", help="graph file")
    p.add_argument("--model", help="folder of a trained model")
    p.add_argument("--input", help="pair file (predict) or pair A,B (explain)")
    p.add_argument("--gene_id_format", choices=list(GENE_KEYS), default="HGNC")
    p.add_argument("--gene_id_delim", default="\t")
    p.add_argument("--prediction_output_folder", default=".")
    p.add_argument("--neutral_pairs", help="file of negative pairs")
    p.add_argument("--holdout_positive_size", type=int)
    p.add_argument("--minsup_ratio", type=float)
    p.add_argument("--path_cutoff", type=int)
    p.add_argument("--max_rule_length", type=int)
    p.add_argument("--alpha", type=float)
    p.add_argument("--include_phenotypes", action="store_true", default=None)
    p.add_argument("--paths", help="JSON file with kg, neutral_pairs, model, cache, analytics_output; options given here override it")
    p.add_argument("--spark_config", help="JSON file of Spark settings")
    p.add_argument("--params", help="JSON file of parameters; options given here override it")
    p.add_argument("--analysis_name", default="analysis")
    p.add_argument("--analytics_output")
    p.add_argument("--cache", help="folder that keeps the parsed graph and traversed paths between runs")
    p.add_argument("--update_kg_cache", action="store_true")
    p.add_argument("--update_step_caches", action="store_true")
    p.add_argument("--holdout_output", help="where train writes the holdout pairs")
    p.add_argument("--spark_mode", "--master", dest="master", help="Spark master; by default that of the environment")
    return p


def params_of(args: argparse.Namespace) -> Params:
    base = load_params(args.params, asdict(Params())) if args.params else asdict(Params())
    return replace(Params(**base), **{k: v for k, v in vars(args).items() if k in base and v is not None})


def load_graph(spark: SparkSession, args: argparse.Namespace) -> Graph:
    """The graph file, from the cache if one is kept for its path."""
    if not args.cache:
        return read_graphml(spark, args.kg)
    cache = StageCache(args.cache, args.update_kg_cache)
    return Graph(*(cache.get_or_store(spark, part, lambda p=part: getattr(read_graphml(spark, args.kg), p), kg=args.kg) for part in ("nodes", "edges")))


def main(argv: list[str] | None = None, spark: SparkSession | None = None):
    args = parser().parse_args(argv)
    if args.paths:
        given = load_params(args.paths, dict.fromkeys(("kg", "neutral_pairs", "model", "cache", "analytics_output")))
        for key, value in given.items():
            setattr(args, key, getattr(args, key) or value)
    if not args.kg:
        raise SystemExit("a graph file is needed: --kg, or kg in --paths")
    params = params_of(args)
    spark = spark or session("pathloom", args.master, args.spark_config)
    graph = load_graph(spark, args)
    key = GENE_KEYS[args.gene_id_format]
    if args.action in ("train", "evaluate"):
        neg = samples.negatives(read_pairs(spark, args.neutral_pairs, header=True), graph.nodes)
        if args.action == "evaluate":
            out = workflow.evaluate(graph, neg, params, analytics=args.analytics_output)
            out.show(truncate=False)
            return out
        steps = StageCache(args.cache, args.update_step_caches) if args.cache else None
        model, every = workflow.train(graph, neg, params, steps, kg=args.kg, neutral_pairs=args.neutral_pairs)
        if args.holdout_output:
            sinks.write_holdout(every.where("split = 'holdout'"), args.holdout_output, with_weight=True)
        save_model(model, args.model)
        return model
    model = load_model(spark, args.model)
    if args.action == "predict":
        pairs, unknown = samples.resolve_pairs(read_pairs(spark, args.input, header=False, sep=args.gene_id_delim), graph.nodes, key)
        rows = sinks.prediction_rows(workflow.predict(graph, model, pairs), graph.nodes, unknown)
        sinks.write_predictions(rows, f"{args.prediction_output_folder}/{args.analysis_name}_predictions.csv")
        return rows
    if args.action == "explain":
        predicted, ranked, _ = workflow.explain(graph, model, pair_literal(graph, args.input, key), args.prediction_output_folder)
        for r in predicted.collect():  # one pair
            print(f"{r['pair_id']}: {r['proba']:.2f}")
        ranked.show(truncate=False)
        return ranked
    out = workflow.test(graph, model, params, args.prediction_output_folder)
    sinks.write_predictions(sinks.prediction_rows(out, graph.nodes), f"{args.prediction_output_folder}/{args.analysis_name}_test_predictions.csv")
    return out


if __name__ == "__main__":
    main()
