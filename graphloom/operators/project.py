"""Projection: whole triples stay or go."""

from __future__ import annotations

from .bound import FIELDS, Bound


def project(bound: Bound, variables: list[str] | None) -> Bound:
    """Keep the triples whose pattern has a listed variable.  None keeps all; an empty list keeps every row as an empty graph."""
    if variables is None:
        return bound
    keep = {p.node for v in variables for p in bound.places.get(v, ())}
    nodes = tuple(n for n in bound.nodes if n in keep)
    frame = bound.frame.select(*(f"n{n}_{f}" for n in nodes for f in FIELDS))
    places = {v: left for v, ps in bound.places.items() if (left := tuple(p for p in ps if p.node in keep))}
    return Bound(frame, nodes, places)
