"""Registered queries: each operator applied to the base tables."""


import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

AREAS = (
    "sources", "tables", "progress", "runs", "quality", "text", "structure", "annotations",
    "units", "concepts", "graph", "study", "book", "layout", "review", "streams",
)


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for area in AREAS:
        module = importlib.import_module(f"coursewright.plans.{area}")
        for name, query in module.QUERIES.items():
            assert name not in found, name
            found[name] = query
    return found
