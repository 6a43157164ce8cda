"""The assembly graph: two DataFrames and a few numbers."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class AssemblyGraph:
    """``vertices(vid, length, segments, depth, ...)``, ``edges(src, dst, ...)``, k and the samples.

    A length counts k-mers. Inactive vertices are absent rows; ids are never given twice.
    """

    vertices: DataFrame
    edges: DataFrame
    k: int = 1
    samples: tuple[str, ...] = field(default=())

    def with_(self, **changes) -> AssemblyGraph:
        return replace(self, **changes)


def validate(graph: AssemblyGraph, rules: Mapping[str, object]) -> None:
    """Every property of the vertices must have exactly one rule, and each rule what it requires."""
    properties = set(graph.vertices.columns) - {"vid"}
    if missing := properties - set(rules):
        raise ValueError(f"properties without a rule: {sorted(missing)}")
    if unknown := set(rules) - properties:
        raise ValueError(f"rules without a property: {sorted(unknown)}")
    for name, rule in rules.items():
        if lacking := set(getattr(rule, "requires", ())) - properties:
            raise ValueError(f"the rule of {name} requires {sorted(lacking)}")
