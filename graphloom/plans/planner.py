"""Planning: number the nodes, find variables, and turn a query into a DataFrame."""

from __future__ import annotations

from typing import Any

from pyspark.sql import functions as F

from ..operators import join as joins
from ..operators.bound import COUNT, Bound, narrowed
from ..operators.predicate import mentioned, select
from ..operators.project import project
from ..operators.scan import scan
from .terms import JOINS, Branch, Query, Scan, TermError, is_wildcard


def number(query: Query, first: int = 1) -> int:
    """Number the nodes in post-order (outer, inner, node) from first; returns the next free number."""
    if isinstance(query, Branch):
        first = number(query.inner, number(query.outer, first))
    query.node = first
    return first + 1


def nodes(query: Query) -> list[Query]:
    """All nodes in post-order."""
    return [query] if isinstance(query, Scan) else [*nodes(query.outer), *nodes(query.inner), query]


def variables(query: Query) -> set[str]:
    """Variables of all patterns below."""
    if isinstance(query, Scan):
        return {v for v, _ in query.pattern.variables()}
    return variables(query.outer) | (set() if query.op == "differ" else variables(query.inner))


def compile_query(query: Query, triples: Any, compat: bool = False, hints: bool = True) -> Bound:
    """The query's graphs.  Every operator of the tree becomes one DataFrame operation."""
    if isinstance(query, Scan):
        # A projection list on a scan is part of the language but without effect.
        return select(scan(triples, query.pattern, query.node, compat), query.select)
    outer = compile_query(query.outer, triples, compat, hints)
    inner = compile_query(query.inner, triples, compat, hints)
    if query.op in JOINS:
        known = variables(query.outer) & variables(query.inner)
        out = select(joins.join(outer, inner, query.op, known, hints), query.select)
    elif query.op == "leftjoin":
        out = joins.left_join(outer, inner, query.select)
    elif query.op == "union":
        out = joins.union(outer, inner, query.select)
    elif query.op == "differ":
        out = select(joins.differ(outer, inner), query.select)
    else:
        raise TermError(f"no such operator: {query.op}")
    return project(out, query.project)


def compile_counts(query: Query, triples: Any, needed: set[str], compat: bool = False, hints: bool = True) -> Bound:
    """compile_query's graphs as far as the needed variables go, with the number of graphs for each row in COUNT.

    A variable that nothing above looks at is folded away where it was last used, and joins multiply the numbers.  So a
    join on a frequent value takes a row per distinct value of each side, not a row per pair of graphs.  A row may still
    come more than once; the caller adds up.  Set operators and trees below a projection give their graphs in full.
    """
    if isinstance(query, Scan):
        found = compile_query(query, triples, compat, hints)
        whole = set(found.places) <= needed and not any(is_wildcard(x) for x in query.pattern.slots[1:])
        return narrowed(found, needed, not whole)
    if query.op not in JOINS or query.project is not None:
        return narrowed(compile_query(query, triples, compat, hints), needed, True)
    below, sides = (variables(query.outer), variables(query.inner)), []
    known = below[0] & below[1]
    inside = needed | known | mentioned(query.select)
    for side, own in zip((query.outer, query.inner), below, strict=True):
        sides.append(compile_counts(side, triples, inside & own, compat, hints))
    outer, inner = sides
    outer.frame = outer.frame.withColumnRenamed(COUNT, "__outer")
    inner.frame = inner.frame.withColumnRenamed(COUNT, "__inner")
    found = select(joins.join(outer, inner, query.op, known, hints), query.select)
    found.frame = found.frame.withColumn(COUNT, F.col("__outer") * F.col("__inner")).drop("__outer", "__inner")
    return narrowed(found, needed, not set(found.places) <= needed)
