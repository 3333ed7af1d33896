"""Select predicates as two-valued columns."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.objects import CODE, DATETIME, INTEGER, REAL, STRING, UNDEFINED, constant
from ..plans.terms import Comparison, Connective, Not, TermError, Typed, is_variable
from .bound import Bound

_OPS = {
    "equal": lambda a, b: a == b,
    "less": lambda a, b: a < b,
    "lesseq": lambda a, b: a <= b,
    "greater": lambda a, b: a > b,
    "greatereq": lambda a, b: a >= b,
}


@dataclass(frozen=True)
class _Operand:
    """Columns by type; a row has a value in at most one."""

    text: Column | None = None
    whole: Column | None = None
    real: Column | None = None
    stamp: Column | None = None


def _operand(x: Any, bound: Bound) -> _Operand:
    if is_variable(x):
        try:
            v = bound.value(x)
        except KeyError:
            raise TermError(f"the predicate's variable {x} isn't bound here") from None
        if not v.is_object:
            return _Operand(text=v.code)
        return _Operand(F.when(v.oty.isin(CODE, STRING, UNDEFINED), v.o), v.o_int, v.o_real, v.o_ts)
    if isinstance(x, Typed):
        kind, value = constant(x.value, x.type)
    elif isinstance(x, str):
        # A plain string is a name, whatever it looks like.
        kind, value = CODE, x
    elif isinstance(x, (int, float)):
        kind, value = constant(x)
    else:
        raise TermError(f"illegal operand: {x!r}")
    if kind == INTEGER:
        return _Operand(whole=F.lit(value).cast("long"))
    if kind == REAL:
        return _Operand(real=F.lit(value))
    if kind == DATETIME:
        return _Operand(stamp=F.lit(value).cast("timestamp_ntz"))
    return _Operand(text=F.lit(value))


def condition(expression: Any, bound: Bound) -> Column:
    """The predicate's column: true or false, never null.  Values of different types compare as false; integers and reals compare as numbers."""
    if isinstance(expression, Not):
        return ~condition(expression.operand, bound)
    if isinstance(expression, Connective):
        left, right = condition(expression.left, bound), condition(expression.right, bound)
        return left & right if expression.op == "land" else left | right
    if isinstance(expression, Comparison):
        a, b, op = _operand(expression.left, bound), _operand(expression.right, bound), _OPS[expression.op]
        pairs = [(a.text, b.text), (a.whole, b.whole), (a.whole, b.real), (a.real, b.whole), (a.real, b.real), (a.stamp, b.stamp)]
        found = [F.coalesce(op(x, y), F.lit(False)) for x, y in pairs if x is not None and y is not None]
        out = F.lit(False)
        for i, c in enumerate(found):
            out = c if i == 0 else out | c
        return out
    raise TermError(f"illegal select expression: {expression!r}")


def select(bound: Bound, expression: Any) -> Bound:
    return bound if expression is None else Bound(bound.frame.where(condition(expression, bound)), bound.nodes, bound.places)


def mentioned(expression: Any) -> set[str]:
    """The variables of a predicate."""
    if isinstance(expression, Not):
        return mentioned(expression.operand)
    if isinstance(expression, Connective):
        return mentioned(expression.left) | mentioned(expression.right)
    if isinstance(expression, Comparison):
        return {x for x in (expression.left, expression.right) if is_variable(x)}
    return set()
