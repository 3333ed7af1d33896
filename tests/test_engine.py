import pytest
from pyspark.sql import functions as F

from data import EXAMPLE, THREE
from graphloom.engine import Engine
from graphloom.plans.terms import TermError
from graphloom.sources.triples import from_lexical


@pytest.fixture(scope="module")
def three(spark):
    return Engine(from_lexical(spark.createDataFrame(THREE, "tid string, s string, p string, o string")).cache())


@pytest.fixture(scope="module")
def example(spark):
    return Engine(from_lexical(spark.createDataFrame(EXAMPLE, "tid string, s string, p string, o string")).cache())


def tids(result):
    """Graphs as sorted tuples of (node, id number)."""
    return sorted(tuple(sorted((n, int(t.tid.strip("<>").split("_")[-1].lstrip("id"))) for n, t in r.graph.items())) for r in result.graphs().collect())


@pytest.mark.parametrize(
    "pattern, want",
    [
        (("<triple_id_0002>", "?s", "?p", "?o"), [2]),
        (("?id", "?sbj", "<eat>", "<fishes>"), [2]),
        (("?id", "<Chinese>", "?prd", "<vegetables>"), [1]),
        (("?id", "<Chinese>", "<eat>", "?obj"), [1]),
        (("?id", "<Chinese>", "?prd", "?obj"), [1]),
        (("?id", "?sbj", "<eat>", "?obj"), [1, 2, 3]),
        (("?id", "?sbj", "?prd", "<potatoes>"), [3]),
        (("?id", "?sbj", "?prd", "?obj"), [1, 2, 3]),
        (("_:id", "_:sbj", "_:prd", "_:obj"), [1, 2, 3]),
        (("?id", "<Chinese>", "?prd", "<fished>"), []),
        (("?id", "<Chinese>", "<eat>", "<vegetables>"), [1]),
        (("?id", "<Chinese>", "<eat>", "<fishes>"), []),
        (("<triple_id_0001>", "<Japanese>", "?p", "?o"), []),
    ],
)
def test_patterns(three, pattern, want):
    got = tids(three.execute(("tp", pattern, None, None)))
    assert got == [((1, w),) for w in want]


def test_predicate_on_scan(three):
    got = tids(three.execute('{tp, {"[]", "?sbj", "<eat>", "?obj"}, {{"?sbj", equal, "<Chinese>"}, lor, {"?obj", equal, "<fishes>"}}, none}'))
    assert got == [((1, 1),), ((1, 2),)]


def test_join_on_predicate_variable(three):
    for op in ("join", "hjoin", "mjoin"):
        got = tids(three.execute(f'{{{op}, {{tp, {{"?i1", "<Japanese>", "?prd", "?obj1"}}, none, none}}, {{tp, {{"?i2", "<Slovenian>", "?prd", "?obj2"}}, none, none}}, none, none}}'))
        assert got == [((1, 2), (2, 3))]


OPS = ("join", "hjoin", "mjoin")


@pytest.mark.parametrize("op1", OPS)
@pytest.mark.parametrize("op2", OPS)
def test_three_patterns(example, op1, op2):
    got = tids(example.execute(f'{{{op2}, {{{op1}, {{tp, {{"?a", "?y", "livesIn", "?x"}}, none, none}}, {{tp, {{"?b", "slovenia", "hasCapital", "?x"}}, none, none}}, none, none}}, {{tp, {{"?c", "?y", "worksAt", "ijs"}}, none, none}}, none, none}}'))
    assert got == [((1, 38), (2, 22), (4, 47)), ((1, 40), (2, 22), (4, 49)), ((1, 41), (2, 22), (4, 50))]


def test_variable_predicate(example):
    got = tids(example.execute('{hjoin, {tp, {"?a", "nika", "?x", "ijs"}, none, none}, {tp, {"?b", "?y", "?x", "yj"}, none, none}, none, none}'))
    assert got == [((1, 49), (2, 42)), ((1, 49), (2, 44))]


def test_predicate_and_projection(example):
    got = tids(example.execute('{join, {hjoin, {tp, {"?i1", "?x", "livesIn", "ljubljana"}, none, none}, {tp, {"?i2", "?x", "graduatedFrom", "ul"}, none, none}, none, none}, {tp, {"?i3", "?x", "age", "?y"}, none, none}, {{"?y", less, 30}, land, {"?y", greatereq, 20}}, ["?y"]}'))
    assert got == [((4, 63),)]
    got = tids(example.execute('{join, {join, {tp, {"?a", "slovenia", "hasCapital", "?x"}, none, none}, {tp, {"?b", "?y", "livesIn", "?x"}, none, none}, none, none}, {tp, {"?c", "?y", "worksAt", "ijs"}, none, none}, {lnot, {"?y", equal, "luka"}}, ["?y"]}'))
    assert got == [((2, 40), (4, 49)), ((2, 41), (4, 50))]


def test_projection_on_scan_has_no_effect(three):
    assert tids(three.execute('{tp, {"?i", "?s", "<eat>", "?o"}, none, []}')) == [((1, 1),), ((1, 2),), ((1, 3),)]


def test_lost_join_variable(example):
    term = '{join, {join, {tp, {"[]", "?a", "livesIn", "?x"}, none, none}, {tp, {"[]", "?x", "isLocatedIn", "?z"}, none, none}, none, ["?z"]}, {tp, {"[]", "?a", "age", "?n"}, none, none}, none, none}'
    with pytest.raises(TermError, match="join variable"):
        example.execute(term)
    with pytest.raises(TermError, match="isn't bound"):
        example.execute('{tp, {"[]", "?a", "age", "?n"}, {"?m", equal, 1}, none}')


def test_bag_semantics_and_cross(example, spark):
    twice = Engine(example.triples.unionAll(example.triples))
    assert twice.execute('{join, {tp, {"[]", "?a", "hasCapital", "?x"}, none, none}, {tp, {"[]", "?b", "hasCapital", "?x"}, none, none}, none, none}').count() == 8
    assert example.execute('{join, {tp, {"[]", "?a", "age", "?x"}, none, none}, {tp, {"[]", "?b", "hasCapital", "?y"}, none, none}, none, none}').count() == 14


def test_repeated_variable(spark):
    rows = [("1", "a", "is", "a"), ("2", "a", "is", "b"), ("3", "is", "is", "x")]
    t = from_lexical(spark.createDataFrame(rows, "tid string, s string, p string, o string"))
    term = '{tp, {"[]", "?x", "is", "?x"}, none, none}'
    assert Engine(t).execute(term).bindings().collect() == [("a",)]
    assert sorted(Engine(t, compat=True).execute(term).bindings().collect()) == [("a",), ("b",), ("x",)]
    assert Engine(t).execute('{tp, {"?i", "?x", "?x", "?o"}, none, none}').bindings("?i").collect() == [("3",)]


def test_types_in_predicates(spark):
    rows = [("1", "a", "v", "5"), ("2", "b", "v", "5.0"), ("3", "c", "v", "5x"), ("4", "d", "v", "1966-02-03"), ("5", "e", "v", "9007199254740993")]
    e = Engine(from_lexical(spark.createDataFrame(rows, "tid string, s string, p string, o string")))
    ask = lambda p: sorted(r.s for r in e.execute(f'{{tp, {{"[]", "?s", "v", "?o"}}, {p}, none}}').bindings("?s").collect())
    assert ask('{"?o", equal, 5}') == ["a", "b"]
    assert ask('{"?o", equal, "5"}') == []
    assert ask('{"?o", greater, 4.5}') == ["a", "b", "e"]
    assert ask('{lnot, {"?o", greater, 4.5}}') == ["c", "d"]
    assert ask('{"?o", equal, 9007199254740993}') == ["e"] and ask('{"?o", equal, 9007199254740992}') == []
    assert ask('{"?o", less, {"1970-01-01", datetime}}') == ["d"]
    assert ask('{"?s", less, "c"}') == ["a", "b"]
    assert ask('{{"?o", equal, "?o"}, land, {"?s", equal, "?s"}}') == ["a", "b", "c", "d", "e"]
    assert ask('{5, less, "x"}') == []
    got = e.execute('{tp, {"[]", "?s", "v", "5"}, none, none}').bindings("?s").collect()
    assert got == [("a",)]


def test_typed_joins(spark):
    rows = [("1", "a", "v", "5"), ("2", "b", "w", "5"), ("3", "c", "w", "5.0"), ("4", "5", "n", "x"), ("5", "a", "l", "b")]
    e = Engine(from_lexical(spark.createDataFrame(rows, "tid string, s string, p string, o string")))
    pair = '{join, {tp, {"[]", "?a", "v", "?x"}, none, none}, {tp, {"?t", ONE, none, none}, none, none}'
    assert e.execute(pair.replace("ONE", '"?b", "w", "?x"}')).bindings("?b").collect() == [("b",)]
    assert e.execute(pair.replace("ONE", '"?x", "n", "?y"}')).count() == 0
    assert e.execute('{join, {tp, {"[]", "?a", "l", "?x"}, none, none}, {tp, {"[]", "?x", "w", "?v"}, none, none}, none, none}').bindings("?x", "?v").collect() == [("b", "5")]


def test_set_operators(example):
    left = example.execute('{leftjoin, {tp, {"[]", "?p", "type", "person"}, none, none}, {tp, {"[]", "?p", "graduatedFrom", "?u"}, none, none}, none, none}').bindings("?p", "?u").collect()
    assert len(left) == 7 and ("marko", None) in left and ("jan", "up") in left
    gone = example.execute('{differ, {tp, {"[]", "?p", "type", "person"}, none, none}, {tp, {"[]", "?p", "graduatedFrom", "?u"}, none, none}, none, none}')
    assert gone.bindings().collect() == [("marko",)]
    both = example.execute('{union, {tp, {"[]", "?a", "livesIn", "tokyo"}, none, none}, {tp, {"[]", "?a", "worksAt", "yj"}, none, none}, none, none}')
    assert sorted(r.a for r in both.bindings().collect()) == ["shou", "shou", "yoshio", "yoshio"]
    then = example.execute('{join, {union, {tp, {"[]", "?a", "livesIn", "tokyo"}, none, none}, {tp, {"[]", "?a", "worksAt", "ijs"}, none, none}, none, none}, {tp, {"[]", "?a", "age", "?n"}, {"?n", greater, 30}, none}, none, none}')
    assert sorted(r.a for r in then.bindings("?a").collect()) == ["luka", "yoshio"]
    optional = example.execute('{join, {leftjoin, {tp, {"[]", "?p", "type", "person"}, none, none}, {tp, {"[]", "?p", "graduatedFrom", "?u"}, none, none}, none, none}, {tp, {"[]", "?p", "age", "?n"}, none, none}, {lnot, {"?u", equal, "ul"}}, none}')
    assert sorted(r.p for r in optional.bindings("?p").collect()) == ["jan", "marko", "sakura", "shou", "yoshio"]


def test_results(example):
    r = example.execute('{tp, {"[]", "?p", "type", "person"}, none, none}')
    assert r.count() == 7 and r.limit(3).count() == 3 and r.limit(0).count() == 0
    assert [len(b) for b in r.read(3)] == [3, 3, 1]
    assert list(example.execute('{tp, {"[]", "?p", "none", "?x"}, none, none}').read()) == []
    empty = example.execute('{join, {tp, {"[]", "?p", "type", "country"}, none, none}, {tp, {"[]", "?p", "hasCapital", "?x"}, none, none}, none, []}')
    assert [row.graph for row in empty.graphs().collect()] == [{}, {}]


def test_constants_reach_the_files(spark, tmp_path, example):
    from graphloom.sources.triples import Store, write_store

    write_store(example.triples, str(tmp_path / "store"), buckets=4)
    store = Store(spark, str(tmp_path / "store"), 4)
    r = Engine(store).execute('{tp, {"[]", "?a", "age", "22"}, none, none}')
    plan = r.frame._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(p,age)" in plan and "EqualTo(o_int,22)" in plan
    filters = plan[plan.index("PartitionFilters: [") :].split("]")[0]
    assert "p_part" in filters and "= " in filters
    files = {f.split("p_part=")[1].split("/")[0] for f in r.frame.inputFiles()}
    assert len(files) <= 4 and r.bindings().collect() == [("nika",)]
    assert len(r.frame._jdf.queryExecution().optimizedPlan().toString()) > 0
    assert Engine(store).execute('{tp, {"[]", "?a", "age", "?n"}, none, none}').count() == 7
    assert Engine(store).execute('{tp, {"[]", "?a", "?p", "?n"}, none, none}').count() == 64
    # A second batch beside the first, read with the same pruning.
    write_store(example.triples, str(tmp_path / "store"), 4, 0)
    assert Engine(Store(spark, str(tmp_path / "store"), 4)).execute('{tp, {"[]", "?a", "age", "?n"}, none, none}').count() == 14


def test_hash_hints_only_where_they_fit(spark, tmp_path, example, monkeypatch):
    from graphloom.operators import join as joins

    example.triples.write.parquet(str(tmp_path / "t"))
    stored = Engine(spark.read.parquet(str(tmp_path / "t")))

    term = '{hjoin, {tp, {"?a", "?y", "livesIn", "?x"}, none, none}, {tp, {"?b", "?z", "isLocatedIn", "?x"}, none, none}, none, none}'
    logical = lambda: stored.execute(term).frame._jdf.queryExecution().logical().toString()
    assert "shuffle_hash" in logical().lower()
    monkeypatch.setattr(joins, "HASH_BYTES", 0)
    assert "shuffle_hash" not in logical().lower()


def test_profile(example):
    found = example.profile('{join, {tp, {"?a", "slovenia", "hasCapital", "?x"}, none, none}, {tp, {"?b", "?y", "livesIn", "?x"}, none, none}, none, none}')
    assert [f[:3] for f in found] == [(1, "tp", 1), (2, "tp", 7), (3, "join", 3)] and all(f[3] > 0 for f in found)


def test_counts_make_no_pairs(spark):
    """3000 and 3000 subjects of one object: 9 million graphs, counted from a row for each side."""
    rows = spark.range(6000).selectExpr("concat('t', id) tid", "concat('s', id) s", "if(id < 3000, 'p', 'q') p", "'hub' o")
    term = '{join, {tp, {"[]", "?a", "p", "?x"}, none, none}, {tp, {"[]", "?b", "q", "?x"}, none, none}, none, none}'
    engine = Engine(from_lexical(rows))
    found = engine.counts(term, "?x")
    assert found.collect() == [("hub", 9_000_000)]
    made = []

    def look(plan):
        if plan.nodeName().endswith("Join"):
            made.append(plan.metrics().apply("numOutputRows").value())
        for below in (plan.executedPlan(),) if hasattr(plan, "executedPlan") and plan.nodeName() == "AdaptiveSparkPlan" else (plan.plan(),) if plan.nodeName().endswith("QueryStage") else ():
            look(below)
        for i in range(plan.children().size()):
            look(plan.children().apply(i))

    look(found._jdf.queryExecution().executedPlan())
    assert made == [1]
    reals = from_lexical(spark.createDataFrame([("1", "a", "v", "-0.0"), ("2", "b", "v", "0.0"), ("3", "c", "v", "0.0")], "tid string, s string, p string, o string"))
    assert sorted(Engine(reals).counts('{tp, {"[]", "?s", "v", "?o"}, none, none}', "?o").collect()) == [("-0.0", 1), ("0.0", 2)]
