"""Scans: the triples that match a pattern, as one-node graphs."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.objects import CODE, DATETIME, INTEGER, REAL, STRING, constant
from ..plans.terms import SLOTS, Pattern, TermError, Typed, is_variable, is_wildcard
from .bound import FIELDS, Bound, Place


def slot_filter(slot: str, value: Any) -> Column:
    """Equality of a slot with a constant, on plain columns so that files can skip rows; objects are compared by type and value."""
    kind = value.type if isinstance(value, Typed) else None
    raw = value.value if isinstance(value, Typed) else value
    if slot != "o":
        if not isinstance(raw, str):
            raise TermError(f"the {slot} slot holds names, not {raw!r}")
        return F.col(slot) == F.lit(raw)
    oty, v = constant(raw, kind)
    if oty in (INTEGER, REAL, DATETIME):
        column = {INTEGER: "o_int", REAL: "o_real", DATETIME: "o_ts"}[oty]
        return (F.col("oty") == oty) & (F.col(column) == (F.lit(v).cast("timestamp_ntz") if oty == DATETIME else F.lit(v)))
    return (F.col("oty") == (oty if oty == STRING else CODE)) & (F.col("o") == F.lit(v))


def scan(triples: Any, pattern: Pattern, node: int, compat: bool = False) -> Bound:
    """One-node graphs of the triples that match all constants of the pattern.

    A variable that stands twice in the pattern must have one value; with compat it is
    bound at its later slot and not compared.  triples: a frame, or a source that makes one for a pattern.
    """
    frame: DataFrame = triples.matching(pattern) if hasattr(triples, "matching") else triples
    for slot, value in zip(SLOTS, pattern.slots, strict=True):
        if not is_variable(value) and not is_wildcard(value):
            frame = frame.where(slot_filter(slot, value))
    places: dict[str, list[str]] = {}
    for variable, slot in pattern.variables():
        places.setdefault(variable, []).append(slot)
    for slots in places.values():
        for other in [] if compat else slots[1:]:
            same = F.col(slots[0]) == F.col(other)
            frame = frame.where((F.col("oty") == CODE) & same if other == "o" else same)
    frame = frame.select(*(F.col(f).alias(f"n{node}_{f}") for f in FIELDS))
    return Bound(frame, (node,), {v: (Place(node, slots[-1] if compat else slots[0]),) for v, slots in places.items()})
