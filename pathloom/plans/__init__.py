"""Workflows over the operators, and the fixture graph of the registered queries."""
