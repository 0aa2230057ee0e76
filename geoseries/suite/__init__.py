"""Registered queries over the test tables."""

from importlib import import_module

PARTS = ["scans", "timeseries", "grids", "scores", "comparisons", "jobs", "learning"]


def load():
    for part in PARTS:
        import_module(f"geoseries.suite.{part}")
    from geoseries.suite.registry import ORACLE, QUERIES

    return QUERIES, ORACLE
