"""The engine: triples to query, and results."""

from __future__ import annotations

import time
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.objects import decoded
from .operators.bound import COUNT, Bound
from .plans.planner import compile_counts, compile_query, nodes, number
from .plans.terms import Query, to_query


class Result:
    """A query's graphs, not computed before they are asked for."""

    def __init__(self, bound: Bound, query: Query):
        self.bound, self.query = bound, query

    @property
    def frame(self) -> DataFrame:
        """One row per graph with flat columns n<node>_<field>."""
        return self.bound.frame

    def graphs(self) -> DataFrame:
        """One row per graph: graph, a map from node id to its triple, objects decoded; absent triples are left out."""
        triples = []
        for n in self.bound.nodes:
            c = lambda f, n=n: F.col(f"n{n}_{f}")
            triple = F.struct(c("tid").alias("tid"), c("s").alias("s"), c("p").alias("p"), decoded(c("oty"), c("o"), c("o_real")).alias("o"), c("oty").alias("oty"))
            triples.append(F.when(c("oty").isNotNull(), F.struct(F.lit(n).alias("key"), triple.alias("value"))))
        kind = "array<struct<key:int,value:struct<tid:string,s:string,p:string,o:string,oty:smallint>>>"
        entries = F.filter(F.array(*triples), lambda x: x.isNotNull()) if triples else F.array()
        return self.frame.select(F.map_from_entries(entries.cast(kind)).alias("graph"))

    def bindings(self, *variables: str, **typed: tuple[str, str]) -> DataFrame:
        """A column per variable, without its mark, decoded; all variables if none is given.

        typed: column=(variable, "code" | "integer" | "real" | "datetime") for a value of that type.
        """
        chosen = list(variables) or ([] if typed else list(self.bound.places))
        cols = self.shown(*chosen)
        for name, (v, kind) in typed.items():
            x = self.bound.value(v)
            column = {"code": x.code, "integer": x.o_int, "real": x.o_real, "datetime": x.o_ts}[kind]
            cols.append((F.lit(None) if column is None else column).alias(name))
        return self.frame.select(*cols)

    def shown(self, *variables: str) -> list[Column]:
        """The columns of variables, decoded."""
        cols = []
        for v in variables:
            x = self.bound.value(v)
            cols.append((decoded(x.oty, x.o, x.o_real) if x.is_object else x.code).alias(v.lstrip("?")))
        return cols

    def limit(self, n: int) -> "Result":
        """At most n graphs; count() of the whole result isn't capped."""
        return Result(Bound(self.frame.limit(n), self.bound.nodes, self.bound.places), self.query)

    def count(self) -> int:
        return self.frame.count()

    def read(self, block: int = 100) -> Iterator[list[dict]]:
        """The graphs in blocks, as they arrive."""
        held: list[dict] = []
        for row in self.graphs().toLocalIterator(prefetchPartitions=True):
            held.append({k: tuple(v[:4]) for k, v in row.graph.items()})
            if len(held) == block:
                yield held
                held = []
        if held:
            yield held


class Engine:
    """Queries over triples: a frame with the columns tid, s, p, oty, o, o_int, o_real, o_ts, or a source with matching(pattern).

    compat: a variable that stands twice in one pattern isn't compared with itself.
    hints: hjoin and mjoin ask for their hash joins.
    """

    def __init__(self, triples: Any, compat: bool = False, hints: bool = True):
        self.triples, self.compat, self.hints = triples, compat, hints

    def execute(self, term: Any) -> Result:
        """term: a query's text, its term, or Scan and Branch objects."""
        query = to_query(term)
        number(query)
        return Result(compile_query(query, self.triples, self.compat, self.hints), query)

    def profile(self, term: Any) -> list[tuple[int, str, int, float]]:
        """Number, operator, graphs and seconds of each node; every node's tree is run by itself, so a time includes those of the nodes below."""
        query = to_query(term)
        number(query)
        out = []
        for node in nodes(query):
            began = time.perf_counter()
            found = compile_query(node, self.triples, self.compat, self.hints).frame.count()
            out.append((node.node, getattr(node, "op", "tp"), found, time.perf_counter() - began))
        return out

    def counts(self, term: Any, *variables: str, name: str = "n") -> DataFrame:
        """A column per variable as bindings() gives them, and name: the number of the query's graphs with these values.

        The graphs are counted, not made (planner.compile_counts), so their number may be far beyond what could be listed.
        """
        query = to_query(term)
        number(query)
        bound = compile_counts(query, self.triples, set(variables), self.compat, self.hints)
        shown = Result(bound, query).shown(*variables)
        return bound.frame.select(*shown, F.col(COUNT).alias("__n")).groupBy(*(v.lstrip("?") for v in variables)).agg(F.sum("__n").alias(name))

    def execute_file(self, path: str) -> Result:
        with open(path) as f:
            return self.execute(f.read())
