"""Band assignment and per-band lookups as plain CASE expressions (they stay inside whole-stage codegen).

A band specification is a dict with ``edges`` (numeric) or ``categories`` (text).  Numeric band i is
``(edge[i-1], edge[i]]``; after the last numeric band comes ``missing``.  Category bands are followed by ``other`` and
``missing``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_numeric(spec: Mapping) -> bool:
    return "categories" not in spec


def band_count(spec: Mapping) -> int:
    return (len(spec["edges"]) if is_numeric(spec) else len(spec["categories"])) + 2


def band_labels(spec: Mapping) -> list[str]:
    if not is_numeric(spec):
        return [*map(str, spec["categories"]), "other", "missing"]
    edges = spec["edges"]
    if not edges:
        return ["all", "missing"]
    inner = [f"({low:g}, {high:g}]" for low, high in zip(edges, edges[1:])]
    return [f"<= {edges[0]:g}", *inner, f"> {edges[-1]:g}", "missing"]


def literal(value) -> str:
    """A Python value as Spark SQL text."""
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, float):
        return f"{value!r}D"
    return str(value)


def band_lookup(column: str, spec: Mapping, per_band: Sequence) -> Column:
    """``per_band[band of the column's value]`` as one CASE, built as SQL text (one call instead of one per band)."""
    name = f"`{column}`"
    results = [literal(v) for v in per_band]
    if is_numeric(spec):
        number = f"CAST({name} AS DOUBLE)"
        missing = f"{name} IS NULL OR isnan({number})"
        known = [f"WHEN {number} <= {literal(float(e))} THEN {r}" for e, r in zip(spec["edges"], results)]
    else:
        missing = f"{name} IS NULL"
        known = [f"WHEN {name} = {literal(str(c))} THEN {r}" for c, r in zip(spec["categories"], results)]
    return F.expr(f"CASE WHEN {missing} THEN {results[-1]} {' '.join(known)} ELSE {results[-2]} END")


def band_index(column: str, spec: Mapping) -> Column:
    return band_lookup(column, spec, list(range(band_count(spec))))
