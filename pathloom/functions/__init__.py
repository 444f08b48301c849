"""Column expressions of the rule-mining vocabulary."""

from pathloom.functions.scalars import (
    abbreviated,
    abbreviated_metaedge,
    abbreviated_metapath,
    combined_context,
    confidence_level,
    context_valid,
    first_label,
    is_before,
    list_literal,
    max_scaled,
    metaedge_text,
    metapath_key,
    metapath_text,
    minmax_scaled,
    oriented,
    rule_text,
    valid_support,
    with_extremes,
)

__all__ = [
    "abbreviated", "abbreviated_metaedge", "abbreviated_metapath", "combined_context", "confidence_level", "context_valid", "first_label", "is_before", "list_literal",
    "max_scaled", "metaedge_text", "metapath_key", "metapath_text", "minmax_scaled", "oriented", "rule_text", "valid_support", "with_extremes",
]
