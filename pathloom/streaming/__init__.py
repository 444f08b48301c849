"""Arriving pairs scored against a trained model. The mining itself is batch work."""
