"""Joins of graphs on all shared variables, and the set operators that extend them.

join leaves the strategy to the optimizer; hjoin asks for a hash join built on the outer side,
mjoin for one built on the inner side, unless that side may be too large for it (HASH_BYTES).  The hints choose a strategy
only: all three give the same rows.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.terms import TermError
from .bound import Bound, Place
from .predicate import condition, select


def shared(outer: Bound, inner: Bound, known: set[str] | None = None) -> list[str]:
    """Variables of both sides.  known: variables of both patterns, which projection below may have removed."""
    lost = sorted(v for v in known or () if v not in outer.places or v not in inner.places)
    if lost:
        raise TermError(f"a projection below removed every triple with the join variable {lost[0]}")
    return [v for v in outer.places if v in inner.places]


def _merged(outer: Bound, inner: Bound) -> dict[str, tuple[Place, ...]]:
    return {v: outer.places.get(v, ()) + inner.places.get(v, ()) for v in [*outer.places, *(v for v in inner.places if v not in outer.places)]}


def _on(outer: Bound, inner: Bound, variables: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (outer.value(v).equals(inner.value(v)) for v in variables))


#: A hash table is built in memory: a side is hinted if the optimizer's estimate of it is at most this for each shuffle partition.
HASH_BYTES = 64 << 20


def _fits(side: DataFrame) -> bool:
    estimate = int(side._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return estimate <= HASH_BYTES * int(side.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def join(outer: Bound, inner: Bound, kind: str = "join", known: set[str] | None = None, hints: bool = True) -> Bound:
    variables = shared(outer, inner, known)
    left, right = outer.frame, inner.frame
    if hints and variables and kind == "hjoin" and _fits(left):
        left = left.hint("shuffle_hash")
    if hints and variables and kind == "mjoin" and _fits(right):
        right = right.hint("shuffle_hash")
    frame = left.join(right, _on(outer, inner, variables), "inner") if variables else outer.frame.crossJoin(inner.frame)
    return Bound(frame, outer.nodes + inner.nodes, _merged(outer, inner))


def left_join(outer: Bound, inner: Bound, predicate: Any = None) -> Bound:
    """All outer graphs, extended by those inner ones that match and, together, satisfy the predicate."""
    both = Bound(outer.frame, outer.nodes + inner.nodes, _merged(outer, inner))
    variables = shared(outer, inner)
    on = _on(outer, inner, variables) if variables else F.lit(True)
    if predicate is not None:
        on = on & condition(predicate, both)
    frame = outer.frame.join(inner.frame, on, "left")
    return Bound(frame, outer.nodes + inner.nodes, _merged(outer, inner.optional()))


def union(outer: Bound, inner: Bound, predicate: Any = None) -> Bound:
    """Graphs of either side, repeats kept; the predicate is applied to each side."""
    sides = [select(b, predicate) for b in (outer, inner)]
    frame: DataFrame = sides[0].frame.unionByName(sides[1].frame, allowMissingColumns=True)
    return Bound(frame, outer.nodes + inner.nodes, _merged(outer.optional(), inner.optional()))


def differ(outer: Bound, inner: Bound) -> Bound:
    """Outer graphs that no inner graph matches on the shared variables; without any, all outer graphs."""
    variables = shared(outer, inner)
    if not variables:
        return outer
    return Bound(outer.frame.join(inner.frame, _on(outer, inner, variables), "left_anti"), outer.nodes, outer.places)
