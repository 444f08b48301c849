"""Readers and writers: graph files, pair files, models, stages, predictions, explanations, analytics."""
