"""Column expressions of the rule-mining vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Between the labels and types of a metapath key; labels and types don't contain it.
SEP = "/"


def first_label(labels: Column) -> Column:
    """The primary label of ``:A:B``."""
    return F.get(F.split(labels, ":"), F.lit(1))


def list_literal(text: Column) -> Column:
    """A list written as ``['a', 'b']`` as array of strings; null if it isn't one. Nothing is evaluated."""
    return F.from_json(text, "array<string>", {"allowSingleQuotes": "true"})


def is_before(value_a: Column, id_a: Column, value_b: Column, id_b: Column) -> Column:
    """Whether a comes first in an oriented pair: by the lower value; equal, missing or NaN values leave it to the ids."""
    known = value_a.isNotNull() & value_b.isNotNull() & ~F.isnan(value_a) & ~F.isnan(value_b)
    return F.when(known & (value_a < value_b), True).when(known & (value_b < value_a), False).otherwise(id_a <= id_b)


def oriented(id_a: Column, value_a: Column, id_b: Column, value_b: Column) -> Column:
    """The pair as struct (a, b) in its orientation."""
    first = is_before(value_a, id_a, value_b, id_b)
    return F.struct(F.when(first, id_a).otherwise(id_b).alias("a"), F.when(first, id_b).otherwise(id_a).alias("b"))


def confidence_level(fam_manual: Column, stat_meta: Column, stat_manual: Column) -> Column:
    """Strongest evidence level met, 0 if none; missing counts are 0."""
    fam, meta, manual = (F.coalesce(c.cast("int"), F.lit(0)) for c in (fam_manual, stat_meta, stat_manual))
    weak, moderate, strong = (fam >= 1) | ((meta >= 1) & (manual >= 1)), (fam >= 2) | (meta >= 2), (fam >= 3) | (meta >= 2)
    return F.when(strong, 3).when(moderate, 2).when(weak, 1).otherwise(0)


def combined_context(count_a: Column, ctx_a: Column, count_b: Column, ctx_b: Column) -> Column:
    """Contexts common to two stretches of a path; a stretch without any context list (count 0) restricts nothing."""
    return F.when(count_a == 0, ctx_b).when(count_b == 0, ctx_a).otherwise(F.array_intersect(ctx_a, ctx_b))


def context_valid(count: Column, ctx: Column) -> Column:
    """A path holds with at most one context list, or if all its lists share a context."""
    return (count <= 1) | (F.size(ctx) > 0)


def metapath_key(edges: Column, types: Column) -> Column:
    """Edge labels and the node types between them as one text, in path order."""
    steps = F.flatten(F.zip_with(edges, types, lambda e, t: F.array(e, t)))
    return F.concat_ws(SEP, steps)


def metapath_text(edges: Column, types: Column, joiner: str = "--") -> Column:
    """A metapath for readers."""
    return F.concat_ws(joiner, F.flatten(F.zip_with(edges, types, lambda e, t: F.array(e, t))))


def abbreviated(names: Column, dictionary: Column) -> Column:
    """Names by their abbreviations in a map column; unknown ones stay as they are."""
    return F.transform(names, lambda x: F.coalesce(F.try_element_at(dictionary, x), x))


def abbreviated_metapath(edges: Column, types: Column, types_dict: Column, labels_dict: Column, end: str | None = None) -> Column:
    """A metapath as short as it gets: end type, then labels and node types in turn, then end type, all by their abbreviations and without separator."""
    name = lambda x, d: F.coalesce(F.try_element_at(d, x), x)
    steps = F.flatten(F.zip_with(edges, types, lambda e, t: F.array(name(e, labels_dict), name(t, types_dict))))
    ends = F.array(name(F.lit(end), types_dict)) if end else F.array().cast("array<string>")
    return F.array_join(F.concat(ends, steps, ends), "")


def abbreviated_metaedge(src_type: Column, label: Column, dst_type: Column, types_dict: Column, labels_dict: Column) -> Column:
    name = lambda x, d: F.coalesce(F.try_element_at(d, x), x)
    return F.concat(name(src_type, types_dict), name(label, labels_dict), name(dst_type, types_dict))


def metaedge_text(src_type: Column, label: Column, dst_type: Column) -> Column:
    """A metaedge for readers."""
    return F.concat_ws("--", src_type, label, dst_type)


def rule_text(rule_id: Column, pattern: Column, positives: Column, negatives: Column | None = None, thresholds: Column | None = None, consequent: Column | int = 1) -> Column:
    """A rule for readers: number, pattern (with thresholds, if it has any), class, and how many samples match."""
    limits = F.lit("") if thresholds is None else F.coalesce(F.concat(F.lit(" [THR= "), F.array_join(F.transform(thresholds, lambda t: F.format_string("%.4f", t)), ", "), F.lit("]")), F.lit(""))
    out = F.concat(F.lit("R"), rule_id.cast("string"), F.lit(": "), pattern, limits, F.lit(" -> "), (F.lit(consequent) if isinstance(consequent, int) else consequent).cast("string"), F.lit(" | Positive matches: "), positives.cast("string"))
    return out if negatives is None else F.concat(out, F.lit(" | Negative matches: "), negatives.cast("string"))


def max_scaled(value: Column, largest: Column | float) -> Column:
    """value over the largest value."""
    return value / (largest if isinstance(largest, Column) else F.lit(float(largest)))


def minmax_scaled(value: Column, low: Column, high: Column) -> Column:
    return F.when(high > low, (value - low) / (high - low)).otherwise(F.lit(0.0))


def with_extremes(df: DataFrame, value: Column) -> DataFrame:
    """df with the lowest and highest value of all rows, low and high: one aggregate, joined as one row."""
    return df.crossJoin(F.broadcast(df.agg(F.min(value).alias("low"), F.max(value).alias("high"))))


def valid_support(weight: Column, minsup: float) -> Column:
    return weight >= F.lit(minsup)
