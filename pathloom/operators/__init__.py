"""Relational operators of rule mining: graph, samples, paths, patterns, thresholds, rules, decision set, metrics."""
