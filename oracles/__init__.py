"""DuckDB SQL for the registered queries."""


import importlib

from coursewright.plans import AREAS


def all_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for area in AREAS:
        found.update(importlib.import_module(f"oracles.{area}").SQL)
    return found
