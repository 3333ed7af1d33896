"""Frames of graphs: one row per graph, flat columns n<node>_<field> per triple, and where each variable stands."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.objects import CODE

#: Fields of a triple; the object has a type, a canonical form and a column per ordered type.
FIELDS = ("tid", "s", "p", "oty", "o", "o_int", "o_real", "o_ts")


@dataclass(frozen=True)
class Place:
    """Where a variable stands: a node, a slot, and whether the node's triple can be absent from a graph."""

    node: int
    slot: str
    optional: bool = False


@dataclass
class Bound:
    frame: DataFrame
    nodes: tuple[int, ...]
    places: dict[str, tuple[Place, ...]]

    def value(self, variable: str) -> "Value":
        """The variable's value at the first place that every graph has, else at the first that this graph has."""
        places = self.places.get(variable)
        if not places:
            raise KeyError(variable)
        sure = [p for p in places if not p.optional][:1]
        return Value.first([Value.at(p) for p in (sure or places)])

    def optional(self) -> "Bound":
        """The same with every triple possibly absent."""
        return Bound(self.frame, self.nodes, {v: tuple(Place(p.node, p.slot, True) for p in ps) for v, ps in self.places.items()})


@dataclass(frozen=True)
class Value:
    """A variable's columns.  Names and ids are codes; only objects have other types."""

    code: Column
    oty: Column
    o: Column
    o_int: Column | None = None
    o_real: Column | None = None
    o_ts: Column | None = None

    @staticmethod
    def at(place: Place) -> "Value":
        col = lambda f: F.col(f"n{place.node}_{f}")
        if place.slot == "o":
            return Value(F.when(col("oty") == CODE, col("o")), col("oty"), col("o"), col("o_int"), col("o_real"), col("o_ts"))
        return Value(col(place.slot), F.when(col(place.slot).isNotNull(), F.lit(CODE)).cast("short"), col(place.slot))

    @staticmethod
    def first(values: list["Value"]) -> "Value":
        if len(values) == 1:
            return values[0]
        names = ("code", "oty", "o", "o_int", "o_real", "o_ts")
        found = {n: [getattr(v, n) for v in values if getattr(v, n) is not None] for n in names}
        return Value(**{n: F.coalesce(*c) if c else None for n, c in found.items()})

    @property
    def is_object(self) -> bool:
        return self.o_int is not None

    def equals(self, other: "Value") -> Column:
        """Equality by type and value, in a form that an equi-join can use: null equals nothing."""
        if self.is_object and other.is_object:
            return (self.oty == other.oty) & (self.o == other.o)
        return self.code == other.code


#: The number of equal graphs that a row stands for; see planner.compile_counts.
COUNT = "graphs"


def _kept(places: tuple[Place, ...]) -> tuple[Place, ...]:
    """The places that value() looks at."""
    return tuple(p for p in places if not p.optional)[:1] or places


def narrowed(bound: Bound, variables: set[str], fold: bool) -> Bound:
    """The graphs as far as these variables go, and how many there are of each: COUNT.  fold: equal rows are made one."""
    places = {v: _kept(ps) for v, ps in bound.places.items() if v in variables}
    exact, values = [], []
    for node, slot in sorted({(p.node, p.slot) for ps in places.values() for p in ps}):
        if slot == "o":
            exact += [f"n{node}_{f}" for f in ("oty", "o", "o_int", "o_real", "o_ts")]
            values.append(f"n{node}_o_real")
        else:
            exact.append(f"n{node}_{slot}")
    count = F.col(COUNT) if COUNT in bound.frame.columns else F.lit(1).cast("long")
    if fold:
        # Grouping makes -0.0 a 0.0; their texts differ, so each group has one real, which is taken as it is.
        found = bound.frame.groupBy(*exact).agg(F.sum(count).alias(COUNT), *(F.first(v).alias(f"{v}_kept") for v in values))
        if not exact:
            found = found.where(F.col(COUNT) > 0)
        frame = found.select(*(F.col(f"{c}_kept" if c in values else c).alias(c) for c in exact), COUNT)
    else:
        frame = bound.frame.select(*exact, count.alias(COUNT))
    return Bound(frame, bound.nodes, places)
