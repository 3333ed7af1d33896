"""Random queries against a plain evaluator that merges dictionaries."""

import operator
import random
from collections import Counter

import pytest

from graphloom.engine import Engine
from graphloom.functions.objects import classify
from graphloom.plans.planner import number, variables
from graphloom.plans.terms import Branch, Comparison, Connective, Not, Pattern, Scan, is_variable
from graphloom.sources.triples import from_lexical

NAMES = ["a", "b", "c", "p", "q"]
OBJECTS = [*NAMES, "1", "2", "2.0", "3.5", "1990-01-01"]
OPS = {"equal": operator.eq, "less": operator.lt, "lesseq": operator.le, "greater": operator.gt, "greatereq": operator.ge}


def _triples(rnd):
    return [(f"t{i}", rnd.choice(NAMES), rnd.choice(NAMES[3:]), rnd.choice(OBJECTS)) for i in range(14)]


def _scan(rnd):
    pick = lambda constants, share: rnd.choice(constants) if rnd.random() < share else rnd.choice(["?x", "?y", "?z", "[]"])
    return Scan(Pattern((rnd.choice(["[]", "?t"]) if rnd.random() < 0.3 else "[]", pick(NAMES, 0.3), pick(NAMES[3:], 0.6), pick(OBJECTS, 0.3))))


def _predicate(rnd, variables):
    if not variables or rnd.random() < 0.3:
        return None
    atom = lambda: Comparison(rnd.choice(variables), rnd.choice(list(OPS)), rnd.choice([*variables, 1, 2.0, 3, "b"]))
    found = atom()
    if rnd.random() < 0.3:
        found = Not(found)
    return Connective(found, rnd.choice(["land", "lor"]), atom()) if rnd.random() < 0.4 else found


def _query(rnd, depth):
    if not depth:
        return _scan(rnd)
    q = Branch(rnd.choice(["join", "hjoin", "mjoin", "leftjoin", "union", "differ"]) if depth == 1 else "join", _query(rnd, depth - 1), _query(rnd, rnd.choice([0, depth - 1])))
    q.select = _predicate(rnd, sorted(_bound(q)))
    return q


def _bound(q):
    """Variables that every result has."""
    if isinstance(q, Scan):
        return {v for v, _ in q.pattern.variables()}
    outer, inner = _bound(q.outer), _bound(q.inner)
    if q.op == "union":
        return outer & inner
    return outer if q.op == "differ" else outer | inner


def _value(slot, x):
    return (1, x) if slot != 3 else classify(x)


def _holds(e, row):
    if isinstance(e, Not):
        return not _holds(e.operand, row)
    if isinstance(e, Connective):
        return (_holds(e.left, row) and _holds(e.right, row)) if e.op == "land" else (_holds(e.left, row) or _holds(e.right, row))
    sides = []
    for x in (e.left, e.right):
        kind, v = row.get(x, (None, None)) if is_variable(x) else (1, x) if isinstance(x, str) else classify(x)
        sides.append(({1: "text", 2: "number", 3: "number", 4: "time"}.get(kind), v))
    return None not in (sides[0][0], sides[1][0]) and sides[0][0] == sides[1][0] and OPS[e.op](sides[0][1], sides[1][1])


def _plain(q, triples):
    if isinstance(q, Scan):
        out = []
        for t in triples:
            row, ok = {}, True
            for slot, (want, have) in enumerate(zip(q.pattern.slots, t, strict=True)):
                v = _value(slot, have)
                if is_variable(want):
                    ok &= row.setdefault(want, v) == v
                elif want != "[]":
                    ok &= v == _value(slot, want)
            out += [row] * ok
        return [r for r in out if q.select is None or _holds(q.select, r)]
    outer, inner = _plain(q.outer, triples), _plain(q.inner, triples)
    keep = lambda r: q.select is None or _holds(q.select, r)
    # A variable that an optional part or a union's other side left without a value joins with nothing.
    common = variables(q.outer) & variables(q.inner)
    match = lambda a, b: all(v in a and v in b and a[v] == b[v] for v in common)
    if q.op == "union":
        return [r for r in outer + inner if keep(r)]
    if q.op == "differ":
        return [r for r in outer if (not common or not any(match(r, b) for b in inner)) and keep(r)]
    if q.op == "leftjoin":
        out = []
        for a in outer:
            found = [a | b for b in inner if match(a, b) and keep(a | b)]
            out += found or [a]
        return out
    return [a | b for a in outer for b in inner if match(a, b) and keep(a | b)]


@pytest.mark.parametrize("seed", range(40))
def test_random_query(spark, seed):
    rnd = random.Random(seed)
    triples = _triples(rnd)
    query = _query(rnd, rnd.choice([0, 1, 1, 2]))
    number(query)
    result = Engine(from_lexical(spark.createDataFrame(triples, "tid string, s string, p string, o string"))).execute(query)
    names = sorted(result.bound.places)
    want = _plain(query, triples)
    show = lambda v: None if v is None else "2.0" if v == (3, 2.0) else str(v[1])
    expected = [tuple(show(r.get(v)) for v in names) for r in want] if names else [()] * len(want)
    got = [tuple(r) for r in result.bindings(*names).collect()] if names else [()] * result.count()
    assert sorted(got, key=str) == sorted(expected, key=str)


@pytest.mark.parametrize("seed", range(40))
def test_counts_equal_listed_graphs(spark, seed):
    rnd = random.Random(100 + seed)
    triples = _triples(rnd)
    query = _query(rnd, rnd.choice([0, 1, 2, 2]))
    number(query)
    names = sorted(variables(query))
    asked = rnd.sample(names, rnd.randint(0, len(names)))
    engine = Engine(from_lexical(spark.createDataFrame(triples, "tid string, s string, p string, o string")))
    show = lambda v: None if v is None else "2.0" if v == (3, 2.0) else str(v[1])
    want = Counter(tuple(show(r.get(v)) for v in asked) for r in _plain(query, triples))
    got = engine.counts(query, *asked).collect()
    # Without a variable there is one row, as of any sum.
    assert {tuple(r)[:-1]: r.n or 0 for r in got} == (dict(want) or ({} if asked else {(): 0})) and len(got) == max(len(want), not asked)
