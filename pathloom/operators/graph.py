"""A typed, scored property multigraph as two DataFrames, and what is derived from it.

nodes: id string, node_type string, name string, orient double (nullable or NaN), further properties
edges: edge_id long, src string, dst string, label string, score double, ctx array<string> (null: none)
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame

    @cached_property
    def adjacency(self) -> DataFrame:
        """Every edge from both of its ends, with node types: edge_id, src, dst, src_type, dst_type, label, score, ctx."""
        ends = self.nodes.select("id", "node_type")
        typed = self.edges.join(ends.withColumnsRenamed({"id": "src", "node_type": "src_type"}), "src")
        typed = typed.join(ends.withColumnsRenamed({"id": "dst", "node_type": "dst_type"}), "dst")
        cols = ["edge_id", "src", "dst", "src_type", "dst_type", "label", "score", "ctx"]
        swapped = {"src": "dst", "dst": "src", "src_type": "dst_type", "dst_type": "src_type"}
        # Both ways of an edge come from one row, so edges look up their types once.
        there, back = F.struct(cols), F.struct([F.col(swapped.get(c, c)).alias(c) for c in cols])
        return typed.select(F.inline(F.when(F.col("src") != F.col("dst"), F.array(there, back)).otherwise(F.array(there))))


def edge_types(g: Graph) -> DataFrame:
    return g.edges.select("label").distinct()


def node_types(g: Graph) -> DataFrame:
    return g.nodes.select("node_type").distinct()


def edge_type_index(g: Graph) -> DataFrame:
    """Labels numbered from 0 in alphabetical order. Only the distinct labels, not the edges, are ranked."""
    labels = edge_types(g).agg(F.sort_array(F.collect_list("label")).alias("ls"))
    return labels.select(F.posexplode("ls").alias("edge_type_idx", "label"))


def select_nodes(g: Graph, prop: str, values: Sequence | None = None, *where: Column | Callable[[DataFrame], Column]) -> DataFrame:
    """Nodes whose property is among the values (any, if None) and which meet all further conditions."""
    out = g.nodes if values is None else g.nodes.where(F.col(prop).isin(*values))
    for cond in where:
        out = out.where(cond(out) if callable(cond) and not isinstance(cond, Column) else cond)
    return out


def has_property(prop: str) -> Column:
    return F.col(prop).isNotNull()


def induced_subgraph(g: Graph, nodes: DataFrame, edges: DataFrame | None = None) -> Graph:
    """The nodes given (column id) and the edges, of those given (column edge_id), between them."""
    ids = nodes.select("id").distinct()
    kept = g.edges if edges is None else g.edges.join(edges.select("edge_id").distinct(), "edge_id", "left_semi")
    kept = kept.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return Graph(g.nodes.join(ids, "id", "left_semi"), kept)


def type_flag(col: Column, names: Sequence[str] | str, keep: bool = True) -> Column:
    """Whether a label passes: a list names labels, a string is looked for inside them; keep=False drops what is named."""
    named = F.contains(col, F.lit(names)) if isinstance(names, str) else col.isin(*names) if names else F.lit(False)
    return named if keep else ~named


def filtered(g: Graph, edge_labels: Sequence[str] | str | None = None, node_labels: Sequence[str] | str | None = None, keep: bool = True) -> Graph:
    """The graph by edge and node labels; edges need both ends."""
    nodes = g.nodes if node_labels is None else g.nodes.where(type_flag(F.col("node_type"), node_labels, keep))
    edges = g.edges if edge_labels is None else g.edges.where(type_flag(F.col("label"), edge_labels, keep))
    return induced_subgraph(Graph(g.nodes, edges), nodes)


def without_combinations(g: Graph, combination: str = "OligogenicCombination", involves: str = "involves") -> Graph:
    """The default filter: no combination nodes, no edges to their members."""
    return Graph(filtered(g, node_labels=[combination], keep=False).nodes, filtered(g, edge_labels=[involves], keep=False).edges.join(g.nodes.where(F.col("node_type") == combination).select(F.col("id").alias("src")), "src", "left_anti").join(g.nodes.where(F.col("node_type") == combination).select(F.col("id").alias("dst")), "dst", "left_anti"))


def node_statistics(g: Graph) -> DataFrame:
    """Per node and metaedge (src_type, label, dst_type): degree and largest score, 0 at least."""
    return g.adjacency.groupBy("src", "src_type", "label", "dst_type").agg(F.count("*").alias("degree"), F.greatest(F.lit(0.0), F.max("score")).alias("max_score"))


def metaedge_statistics(g: Graph) -> DataFrame:
    """Per metaedge the largest degree and score of any node."""
    return node_statistics(g).groupBy("src_type", "label", "dst_type").agg(F.max("degree").alias("max_degree"), F.max("max_score").alias("max_score"))


def nomenclature(g: Graph, abbrev: str = "abbrev") -> DataFrame:
    """(name, short) for every node type and edge label that has an abbreviation; the smallest where several are given."""
    parts = [df.select(F.col(key).alias("name"), F.col(abbrev).alias("short")) for df, key in ((g.nodes, "node_type"), (g.edges, "label")) if abbrev in df.columns]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.where("short is not null").groupBy("name").agg(F.min("short").alias("short"))
