"""DuckDB SQL that states each query's expected result independently of the Spark code."""

from __future__ import annotations

from inkloom.plans.oracle import evaluation, geometry, labels, palette, quality, regions, runs


def all_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for module in (palette, labels, quality, evaluation, regions, geometry, runs):
        out.update(module.sql())
    return out
