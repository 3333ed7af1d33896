"""Queries over the relational test tables seen as triples, and SQL over the tables themselves for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine, Result
from .functions.objects import CODE
from .operators import dictionary as dictionaries
from .operators import distribution
from .plans.terms import Pattern
from .sources.relations import TABLES, Relations, relation_triples
from .sources.stored import frozen, new_path
from .sources.triples import Store, from_lexical, load_map, save_map, write_store
from .sources.tsv import fill_ids, tokens
from .streaming.load import append_to_store, triple_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _engine(spark: SparkSession, sf_dir: str, *tables: str) -> Engine:
    return Engine(Relations(spark, sf_dir, tables or None))


def _add(name: str, term: str, output: Callable[[Result], DataFrame], sql: str, *tables: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: output(_engine(spark, sf_dir, *tables).execute(term))
    SQL[name] = sql


def _add_counts(name: str, term: str, variables: str, sql: str, *tables: str, count: str = "n") -> None:
    """The number of graphs by variables; joins on a value as frequent as a nation have too many to make each."""
    QUERIES[name] = lambda spark, sf_dir: _engine(spark, sf_dir, *tables).counts(term, *(f"?{v}" for v in variables.split()), name=count)
    SQL[name] = sql


def _columns(*variables: str, **typed: tuple[str, str]) -> Callable[[Result], DataFrame]:
    return lambda result: result.bindings(*variables, **typed)


def _triples(*nodes: int) -> Callable[[Result], DataFrame]:
    """tid, s, p of each node's triple."""
    return lambda result: result.frame.select(*(F.col(f"n{n}_{f}").alias(f"{f}{n}") for n in nodes for f in ("tid", "s", "p")))


def _tp(s: str, p: str, o: str, tid: str = '"[]"') -> str:
    return f"{{tp, {{{tid}, {s}, {p}, {o}}}, none, none}}"


# All triples in SQL: id, subject, predicate.
_ALL = " UNION ALL ".join(
    f"SELECT '<{t}/' || {k} || '/{c}>' AS tid1, '<{t}/' || {k} || '>' AS s1, '<{c}>' AS p1 FROM {t} WHERE {c} IS NOT NULL"
    for t, k, cs in (
        ("region", "r_regionkey", "r_name"),
        ("nation", "n_nationkey", "n_name n_regionkey"),
        ("customer", "c_custkey", "c_name c_nationkey c_acctbal c_mktsegment"),
        ("supplier", "s_suppkey", "s_name s_nationkey s_acctbal"),
        ("part", "p_partkey", "p_name p_brand p_type p_size p_retailprice"),
        ("orders", "o_orderkey", "o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority"),
    )
    for c in cs.split()
)

# ------------------------------------------------------------------ scans
_add("tp_p", _tp('"?s"', '"<c_nationkey>"', '"?o"'), _columns("?s", "?o"), "SELECT '<customer/' || c_custkey || '>' AS s, '<nation/' || c_nationkey || '>' AS o FROM customer")
_add("tp_s", _tp('"<customer/7>"', '"?p"', '"?o"', '"?t"'), _columns("?t", "?p"), f"SELECT tid1 AS t, p1 AS p FROM ({_ALL}) WHERE s1 = '<customer/7>'")
_add("tp_o", _tp('"?s"', '"?p"', '"<nation/3>"'), _columns("?s", "?p"), "SELECT '<customer/' || c_custkey || '>' AS s, '<c_nationkey>' AS p FROM customer WHERE c_nationkey = 3 UNION ALL SELECT '<supplier/' || s_suppkey || '>', '<s_nationkey>' FROM supplier WHERE s_nationkey = 3")
_add("tp_sp", _tp('"<orders/5>"', '"<o_orderstatus>"', '"?o"'), _columns("?o"), "SELECT o_orderstatus AS o FROM orders WHERE o_orderkey = 5")
_add("tp_so", _tp('"<nation/3>"', '"?p"', '"?o"'), _columns("?p"), f"SELECT p1 AS p FROM ({_ALL}) WHERE s1 = '<nation/3>'")
_add("tp_po", _tp('"?s"', '"<p_size>"', '"10"'), _columns("?s"), "SELECT '<part/' || p_partkey || '>' AS s FROM part WHERE p_size = 10")
_add("tp_spo", _tp('"<nation/3>"', '"<n_regionkey>"', '"<region/1>"', '"?t"'), _columns("?t"), "SELECT '<nation/' || n_nationkey || '/n_regionkey>' AS t FROM nation WHERE n_nationkey = 3 AND n_regionkey = 1")
_add("tp_spo_known", _tp('"<nation/8>"', '"<n_regionkey>"', '"<region/3>"', '"?t"'), _columns("?t"), "SELECT '<nation/' || n_nationkey || '/n_regionkey>' AS t FROM nation WHERE n_nationkey = 8 AND n_regionkey = 3")
_add("tp_all", _tp('"?s"', '"?p"', '"?o"', '"?t"'), _triples(1), _ALL)
_add("tp_tid", _tp('"?s"', '"?p"', '"?o"', '"<nation/4/n_name>"'), _columns("?s", "?p", "?o"), "SELECT '<nation/' || n_nationkey || '>' AS s, '<n_name>' AS p, n_name AS o FROM nation WHERE n_nationkey = 4")
_add("tp_wildcard", _tp('"_:s"', '"_:p"', '"[]"', '"_:t"'), _triples(1), _ALL)
_add("tp_real", _tp('"?s"', '"<p_retailprice>"', '"?o"'), _columns("?s", price=("?o", "real")), "SELECT '<part/' || p_partkey || '>' AS s, p_retailprice AS price FROM part")

# ------------------------------------------------------------------ predicates


def _select(p: str, predicate: str) -> str:
    return f'{{tp, {{"[]", "?s", "<{p}>", "?o"}}, {predicate}, none}}'


for _name, _op, _sign in (("equal", "equal", "="), ("less", "less", "<"), ("lesseq", "lesseq", "<="), ("greater", "greater", ">"), ("greatereq", "greatereq", ">=")):
    _add(f"sel_{_name}", _select("p_size", f'{{"?o", {_op}, 20}}'), _columns("?s", size=("?o", "integer")), f"SELECT '<part/' || p_partkey || '>' AS s, p_size::BIGINT AS size FROM part WHERE p_size {_sign} 20")
_add("sel_land", _select("c_acctbal", '{{"?o", greater, 0}, land, {"?o", lesseq, 2500.5}}'), _columns("?s", b=("?o", "real")), "SELECT '<customer/' || c_custkey || '>' AS s, c_acctbal AS b FROM customer WHERE c_acctbal > 0 AND c_acctbal <= 2500.5")
_add("sel_lor", _select("c_mktsegment", '{{"?o", equal, "BUILDING"}, lor, {"?s", equal, "<customer/3>"}}'), _columns("?s", "?o"), "SELECT '<customer/' || c_custkey || '>' AS s, c_mktsegment AS o FROM customer WHERE c_mktsegment = 'BUILDING' OR c_custkey = 3")
_add("sel_lnot", _select("o_orderstatus", '{lnot, {"?o", equal, "F"}}'), _columns("?s", "?o"), "SELECT '<orders/' || o_orderkey || '>' AS s, o_orderstatus AS o FROM orders WHERE o_orderstatus <> 'F'")
_add("sel_mixed_types", '{tp, {"[]", "?s", "?p", "?o"}, {lnot, {"?o", less, 45}}, none}', lambda r: r.frame.groupBy(F.col("n1_p").alias("p")).agg(F.count("*").alias("n")), f"SELECT p1 AS p, count(*) AS n FROM ({_ALL}) WHERE p1 NOT IN ('<p_size>', '<c_acctbal>', '<s_acctbal>', '<p_retailprice>', '<o_totalprice>') GROUP BY p1 UNION ALL SELECT p, n FROM (SELECT '<p_size>' AS p, count(*) AS n FROM part WHERE p_size >= 45 UNION ALL SELECT '<c_acctbal>', count(*) FROM customer WHERE c_acctbal >= 45 UNION ALL SELECT '<s_acctbal>', count(*) FROM supplier WHERE s_acctbal >= 45 UNION ALL SELECT '<p_retailprice>', count(*) FROM part WHERE p_retailprice >= 45 UNION ALL SELECT '<o_totalprice>', count(*) FROM orders WHERE o_totalprice >= 45) WHERE n > 0")
_add("sel_datetime", _select("o_orderdate", '{"?o", less, {"1996-01-01", datetime}}'), _columns("?s", at=("?o", "datetime")), "SELECT '<orders/' || o_orderkey || '>' AS s, o_orderdate AS at FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01'")

# ------------------------------------------------------------------ joins
_PATH = '{OP2, {OP1, {tp, {"[]", "?c", "<c_nationkey>", "?n"}, none, none}, {tp, {"[]", "?n", "<n_regionkey>", "?r"}, none, none}, none, none}, {tp, {"[]", "?c", "<c_acctbal>", "?b"}, none, none}, {"?b", greater, 0}, none}'
_PATH_SQL = "SELECT '<customer/' || c_custkey || '>' AS c, '<region/' || n_regionkey || '>' AS r, c_acctbal AS b FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0"
for _name, _op1, _op2 in (("join_path", "join", "join"), ("hjoin_path", "hjoin", "join"), ("mjoin_path", "mjoin", "mjoin"), ("hjoin_mjoin_path", "hjoin", "mjoin")):
    _add(_name, _PATH.replace("OP1", _op1).replace("OP2", _op2), _columns("?c", "?r", b=("?b", "real")), _PATH_SQL)
_STAR = '{JOIN, {JOIN, {tp, {"[]", "?s", "<p_brand>", "?b"}, none, none}, {tp, {"[]", "?s", "<p_type>", "?t"}, none, none}, none, none}, {tp, {"[]", "?s", "<p_size>", "?z"}, none, none}, none, none}'
_STAR_SQL = "SELECT '<part/' || p_partkey || '>' AS s, p_brand AS b, p_type AS t, p_size::BIGINT AS z FROM part"
for _name in ("join", "hjoin", "mjoin"):
    _add(f"{_name}_star", _STAR.replace("JOIN", _name), _columns("?s", "?b", "?t", z=("?z", "integer")), _STAR_SQL)
_add("join_chain", '{join, {join, {join, {tp, {"[]", "?o", "<o_custkey>", "?c"}, none, none}, {tp, {"[]", "?c", "<c_nationkey>", "?n"}, none, none}, none, none}, {tp, {"[]", "?n", "<n_regionkey>", "?r"}, none, none}, none, none}, {tp, {"[]", "?r", "<r_name>", "?name"}, none, none}, none, none}', _columns("?o", "?name"), "SELECT '<orders/' || o_orderkey || '>' AS o, r_name AS name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
_add_counts("join_cycle", '{join, {join, {tp, {"[]", "?c", "<c_nationkey>", "?n"}, none, none}, {tp, {"[]", "?s", "<s_nationkey>", "?n"}, none, none}, none, none}, {join, {tp, {"[]", "?n", "<n_regionkey>", "?r"}, none, none}, {tp, {"[]", "?r", "<r_name>", "?rn"}, none, none}, none, none}, none, none}', "n rn", "SELECT '<nation/' || n_nationkey || '>' AS n, r_name AS rn, count(*) AS pairs FROM customer JOIN supplier ON s_nationkey = c_nationkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL", count="pairs")
_add("join_varpred", '{hjoin, {tp, {"[]", "<customer/1>", "?prd", "?o1"}, none, none}, {tp, {"[]", "<customer/2>", "?prd", "?o2"}, none, none}, none, none}', _columns("?prd"), "SELECT p AS prd FROM (VALUES ('<c_name>'), ('<c_nationkey>'), ('<c_acctbal>'), ('<c_mktsegment>')) t(p) WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = 1) AND EXISTS (SELECT 1 FROM customer WHERE c_custkey = 2)", "customer", "supplier")
_add("join_object", '{join, {tp, {"[]", "?a", "<c_nationkey>", "?n"}, {"?a", equal, "<customer/1>"}, none}, {tp, {"[]", "?b", "<s_nationkey>", "?n"}, none, none}, none, none}', _columns("?a", "?b"), "SELECT '<customer/1>' AS a, '<supplier/' || s_suppkey || '>' AS b FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE c_custkey = 1")


def _self_chain(n: int) -> str:
    term = '{tp, {"[]", "<nation/0>", "<n_regionkey>", "?r"}, none, none}'
    for i in range(1, n):
        term = f'{{join, {term}, {{tp, {{"[]", "?n{i}", "<n_regionkey>", "?r"}}, {{"?n{i}", equal, "<nation/{i}>"}}, none}}, none, none}}'
    return term


_add("join_selfn", f'{{join, {_self_chain(2)}, {{tp, {{"[]", "?m", "<n_regionkey>", "?r"}}, none, none}}, none, none}}', _columns("?r", "?m"), "SELECT '<region/' || a.n_regionkey || '>' AS r, '<nation/' || m.n_nationkey || '>' AS m FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND b.n_nationkey = 1 JOIN nation m ON m.n_regionkey = a.n_regionkey WHERE a.n_nationkey = 0")


def _region_chain() -> str:
    """Twenty scans of one predicate that share their object."""
    term = '{tp, {"[]", "?n0", "<n_regionkey>", "?r"}, {"?n0", equal, "<nation/0>"}, none}'
    for i in range(1, 20):
        term = f'{{join, {term}, {{tp, {{"[]", "?n{i}", "<n_regionkey>", "?r"}}, {{{{"?n{i}", equal, "<nation/{i % 25}>"}}, lor, {{"?n{i}", equal, "?n{i}"}}}}, none}}, {{"?n{i}", equal, "?n0"}}, none}}'
    return term


_add("join_chain20", _region_chain(), _columns("?r", "?n0", "?n19"), "SELECT '<region/' || n_regionkey || '>' AS r, '<nation/0>' AS n0, '<nation/0>' AS n19 FROM nation WHERE n_nationkey = 0", "nation")
_add("join_cross", '{join, {tp, {"[]", "?a", "<r_name>", "?x"}, none, none}, {tp, {"[]", "?b", "<n_name>", "?y"}, none, none}, none, none}', _columns("?x", "?y"), "SELECT r_name AS x, n_name AS y FROM region, nation")
_add("join_bushy", '{mjoin, {join, {tp, {"[]", "?o", "<o_custkey>", "?c"}, none, none}, {tp, {"[]", "?o", "<o_orderpriority>", "?pr"}, {"?pr", equal, "1-URGENT"}, none}, none, none}, {join, {tp, {"[]", "?c", "<c_nationkey>", "?n"}, none, none}, {tp, {"[]", "?n", "<n_name>", "?name"}, none, none}, none, none}, none, none}', _columns("?o", "?name"), "SELECT '<orders/' || o_orderkey || '>' AS o, n_name AS name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderpriority = '1-URGENT'")

# ------------------------------------------------------------------ shapes of benchmark tasks
_SCAN = lambda s, p, o: f'{{tp, {{"[]", "{s}", "{p}", "{o}"}}, none, none}}'


def _left_deep(kinds: list[str], scans: list[str]) -> str:
    term = scans[0]
    for kind, scan in zip(kinds, scans[1:], strict=True):
        term = f"{{{kind}, {term}, {scan}, none, none}}"
    return term


_TWO = [_SCAN("?o", "<o_custkey>", "?c"), _SCAN("?c", "<c_nationkey>", "?n"), _SCAN("?s", "<s_nationkey>", "?n")]
_TWO_SQL = "SELECT '<nation/' || c_nationkey || '>' AS n0, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN supplier ON s_nationkey = c_nationkey GROUP BY ALL"
for _name, _kinds in (("bench_two_join", ["join", "join"]), ("bench_two_hjoin", ["hjoin", "join"]), ("bench_two_mjoin", ["mjoin", "join"])):
    _add_counts(_name, _left_deep(_kinds, [x.replace("?n", "?n0") for x in _TWO]), "n0", _TWO_SQL)
_EIGHT = [
    _SCAN("?c", "<c_mktsegment>", "BUILDING"), _SCAN("?c", "<c_nationkey>", "?n1"), _SCAN("?n1", "<n_regionkey>", "?r"), _SCAN("?n2", "<n_regionkey>", "?r"),
    _SCAN("?s", "<s_nationkey>", "?n2"), _SCAN("?n1", "<n_name>", "?name1"), _SCAN("?n2", "<n_name>", "?name2"), _SCAN("?r", "<r_name>", "?rn"),
]
_EIGHT_SQL = "SELECT a.n_name AS name1, b.n_name AS name2, r_name AS rn, count(*) AS n FROM customer JOIN nation a ON a.n_nationkey = c_nationkey JOIN nation b ON b.n_regionkey = a.n_regionkey JOIN supplier ON s_nationkey = b.n_nationkey JOIN region ON r_regionkey = a.n_regionkey WHERE c_mktsegment = 'BUILDING' GROUP BY ALL"
_add_counts("bench_eight_join", _left_deep(["join"] * 7, _EIGHT), "name1 name2 rn", _EIGHT_SQL)
_add_counts("bench_eight_mjoin", _left_deep(["mjoin", "join", "join", "mjoin", "mjoin", "join", "join"], _EIGHT), "name1 name2 rn", _EIGHT_SQL)
_add_counts("bench_linked", _left_deep(["join", "join"], [_SCAN("?c", "?p1", "?n0"), _SCAN("?s", "?p2", "?n0"), _SCAN("?n0", "<n_regionkey>", "<region/1>")]), "p1 p2", "SELECT a.p AS p1, b.p AS p2, count(*) AS n FROM (SELECT '<c_nationkey>' AS p, c_nationkey AS k FROM customer UNION ALL SELECT '<s_nationkey>', s_nationkey FROM supplier) a JOIN (SELECT '<c_nationkey>' AS p, c_nationkey AS k FROM customer UNION ALL SELECT '<s_nationkey>', s_nationkey FROM supplier) b USING (k) JOIN nation ON n_nationkey = k WHERE n_regionkey = 1 GROUP BY ALL", "customer", "supplier", "nation")
_add("bench_by_subject", _left_deep(["join", "join"], [_SCAN("<supplier/1>", "<s_nationkey>", "?n0"), _SCAN("?c", "<c_nationkey>", "?n0"), _SCAN("?o", "<o_custkey>", "?c")]), _columns("?c", "?o"), "SELECT '<customer/' || c_custkey || '>' AS c, '<orders/' || o_orderkey || '>' AS o FROM supplier JOIN customer ON c_nationkey = s_nationkey JOIN orders ON o_custkey = c_custkey WHERE s_suppkey = 1")

# ------------------------------------------------------------------ projection
_GRAPH = lambda r: r.graphs().select(F.concat_ws(",", F.array_sort(F.transform(F.map_entries("graph"), lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"]["tid"])))).alias("graph"))
_PROJECTED = '{join, {tp, {"[]", "?c", "<c_nationkey>", "?n"}, none, none}, {tp, {"[]", "?n", "<n_name>", "?name"}, none, none}, none, LIST}'
_add("project_nodes", _PROJECTED.replace("LIST", '["?name"]'), _GRAPH, "SELECT '2=<nation/' || n_nationkey || '/n_name>' AS graph FROM customer JOIN nation ON c_nationkey = n_nationkey")
_add("project_all", _PROJECTED.replace("LIST", "none"), _GRAPH, "SELECT '1=<customer/' || c_custkey || '/c_nationkey>,2=<nation/' || n_nationkey || '/n_name>' AS graph FROM customer JOIN nation ON c_nationkey = n_nationkey")
_add("project_empty", _PROJECTED.replace("LIST", "[]"), _GRAPH, "SELECT '' AS graph FROM customer JOIN nation ON c_nationkey = n_nationkey")

# ------------------------------------------------------------------ set operators
_add("optional_orders", '{leftjoin, {tp, {"[]", "?c", "<c_mktsegment>", "BUILDING"}, none, none}, {tp, {"[]", "?o", "<o_custkey>", "?c"}, none, none}, none, none}', _columns("?c", "?o"), "SELECT '<customer/' || c_custkey || '>' AS c, '<orders/' || o_orderkey || '>' AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
_add("optional_filter", '{leftjoin, {tp, {"[]", "?n", "<n_name>", "?name"}, none, none}, {tp, {"[]", "?s", "<s_nationkey>", "?n"}, none, none}, {lnot, {"?name", equal, "NATION_1"}}, none}', _columns("?n", "?s"), "SELECT '<nation/' || n_nationkey || '>' AS n, '<supplier/' || s_suppkey || '>' AS s FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND n_name <> 'NATION_1'")
_add("union_nation", '{union, {tp, {"[]", "?x", "<c_nationkey>", "?n"}, none, none}, {tp, {"[]", "?x", "<s_nationkey>", "?n"}, none, none}, {"?n", equal, "<nation/3>"}, none}', _columns("?x", "?n"), "SELECT '<customer/' || c_custkey || '>' AS x, '<nation/3>' AS n FROM customer WHERE c_nationkey = 3 UNION ALL SELECT '<supplier/' || s_suppkey || '>', '<nation/3>' FROM supplier WHERE s_nationkey = 3")
_add("union_join", '{join, {union, {tp, {"[]", "?x", "<c_nationkey>", "?n"}, none, none}, {tp, {"[]", "?x", "<s_nationkey>", "?n"}, none, none}, none, none}, {tp, {"[]", "?n", "<n_name>", "?name"}, none, none}, none, none}', lambda r: r.bindings("?name").groupBy("name").agg(F.count("*").alias("n")), "SELECT n_name AS name, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) JOIN nation ON k = n_nationkey GROUP BY ALL")
_add("differ_orders", '{differ, {tp, {"[]", "?c", "<c_name>", "?name"}, none, none}, {tp, {"[]", "?o", "<o_custkey>", "?c"}, none, none}, none, none}', _columns("?c", "?name"), "SELECT '<customer/' || c_custkey || '>' AS c, c_name AS name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
_add("differ_none", '{differ, {tp, {"[]", "?c", "<r_name>", "?name"}, none, none}, {tp, {"[]", "?o", "<n_name>", "?other"}, none, none}, none, none}', _columns("?name"), "SELECT r_name AS name FROM region")

# All triples in SQL with their objects: type, text of codes, and values.
_FULL = " UNION ALL ".join(
    f"SELECT '<{t}/' || {k} || '/{c}>' AS tid, '<{t}/' || {k} || '>' AS s, '<{c}>' AS p, {oty} AS oty, {code} AS code, {whole} AS o_int, {real} AS o_real, {stamp} AS o_ts FROM {t} WHERE {c} IS NOT NULL"
    for t, (k, kinds) in TABLES.items()
    for c, kind in kinds.items()
    for oty, code, whole, real, stamp in [
        {
            "integer": (2, "NULL::VARCHAR", f"{c}::BIGINT", "NULL::DOUBLE", "NULL::TIMESTAMP"),
            "real": (3, "NULL::VARCHAR", "NULL::BIGINT", f"{c}::DOUBLE", "NULL::TIMESTAMP"),
            "datetime": (4, "NULL::VARCHAR", "NULL::BIGINT", "NULL::DOUBLE", f"{c}::TIMESTAMP"),
        }.get(kind, (1, f"'<{kind}/' || {c} || '>'" if kind in TABLES else c, "NULL::BIGINT", "NULL::DOUBLE", "NULL::TIMESTAMP"))
    ]
)


def _full(triples: DataFrame) -> DataFrame:
    """The columns of _FULL."""
    code = F.when(F.col("oty") == CODE, F.col("o"))
    return triples.select("tid", "s", "p", F.col("oty").cast("int").alias("oty"), code.alias("code"), "o_int", "o_real", "o_ts")


# ------------------------------------------------------------------ dictionary, typing


def _dictionary(spark: SparkSession, sf_dir: str):
    triples = relation_triples(spark, sf_dir)
    return triples, dictionaries.Dictionary.empty(spark).append(dictionaries.strings_of(triples), 4 * triples.count())


def _encoded(spark: SparkSession, sf_dir: str) -> dictionaries.Encoded:
    triples, d = _dictionary(spark, sf_dir)
    return dictionaries.Encoded(dictionaries.encoded_table(triples, d), d)


def _dict_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _encoded(spark, sf_dir)
    return _full(dictionaries.decode_triples(found.triples, found.dictionary, scan=True))


def _dict_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dictionary(spark, sf_dir)[1].entries.agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"), F.countDistinct("str").alias("strings"))


_STRINGS = f"SELECT unnest([tid, s, p, code]) AS x FROM ({_FULL})"
_NUMBERED = f"numbered AS (SELECT x, row_number() OVER (ORDER BY x) AS id FROM (SELECT DISTINCT x FROM ({_STRINGS}) WHERE x IS NOT NULL))"
QUERIES |= {"dict_roundtrip": _dict_roundtrip, "dict_size": _dict_size}
SQL["dict_roundtrip"] = _FULL
SQL["dict_size"] = f"SELECT count(DISTINCT x) AS n, 1::BIGINT AS first, count(DISTINCT x) AS last, count(DISTINCT x) AS strings FROM ({_STRINGS})"
_WANTED = ("<nation/3>", "<c_acctbal>", "no such string", "<orders/1/o_orderdate>")


def _dict_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of some strings and strings of these ids, one by one; the ids follow the order of the strings."""
    d = _dictionary(spark, sf_dir)[1]
    found = [(w, d.find(w)) for w in _WANTED]
    return spark.createDataFrame([(w, i, None if i is None else d.find_string(i)) for w, i in found], "str string, id long, back string")


def _dict_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strings of regions deleted; of them one is asked for again and gets a new id, others and known ones are appended in bulk."""
    d = _dictionary(spark, sf_dir)[1]
    last = d.last
    d = d.delete(d.entries.where(F.col("str").startswith("<region/")).select("id"))
    rest = d.size()
    d, again = d.get_id("<region/0>")
    d, same = d.get_id("<region/0>")
    d = d.append(spark.createDataFrame([("<region/1>",), ("<c_name>",), (None,)], "str string"))
    return spark.createDataFrame([(rest, again - last, same - last, d.size() - rest, d.last - last)], "rest long, again long, same long, more long, given long")


QUERIES |= {"dict_find": _dict_find, "dict_delete": _dict_delete}
SQL["dict_find"] = f"WITH {_NUMBERED} SELECT w.x AS str, id, n.x AS back FROM (VALUES {', '.join(f"('{w}')" for w in _WANTED)}) w(x) LEFT JOIN numbered n ON n.x = w.x"
SQL["dict_delete"] = f"SELECT count(DISTINCT x) AS rest, 1::BIGINT AS again, 1::BIGINT AS same, 2::BIGINT AS more, 2::BIGINT AS given FROM ({_STRINGS}) WHERE NOT starts_with(x, '<region/')"


def _over_encoded(term: str, output: Callable[[Result], DataFrame]) -> Query:
    return lambda spark, sf_dir: output(Engine(_encoded(spark, sf_dir)).execute(term))


for _name, _like in (("encoded_tp_p", "tp_p"), ("encoded_tp_o", "tp_o"), ("encoded_tp_po", "tp_po"), ("encoded_tp_spo", "tp_spo")):
    SQL[_name] = SQL[_like]
QUERIES |= {
    "encoded_tp_p": _over_encoded(_tp('"?s"', '"<c_nationkey>"', '"?o"'), _columns("?s", "?o")),
    "encoded_tp_o": _over_encoded(_tp('"?s"', '"?p"', '"<nation/3>"'), _columns("?s", "?p")),
    "encoded_tp_po": _over_encoded(_tp('"?s"', '"<p_size>"', '"10"'), _columns("?s")),
    "encoded_tp_spo": _over_encoded(_tp('"<nation/3>"', '"<n_regionkey>"', '"<region/1>"', '"?t"'), _columns("?t")),
    "encoded_join": _over_encoded(_PATH.replace("OP1", "join").replace("OP2", "join"), _columns("?c", "?r", b=("?b", "real"))),
    "encoded_unknown": _over_encoded(_tp('"?s"', '"<no such predicate>"', '"?o"'), _columns("?s")),
}
SQL["encoded_join"] = _PATH_SQL
SQL["encoded_unknown"] = "SELECT NULL::VARCHAR AS s WHERE false"


def _encoded_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns as numbers and back; one constant of the last has no id."""
    d = _dictionary(spark, sf_dir)[1]
    rows = []
    for i, slots in enumerate([("?t", "<nation/3>", "<n_regionkey>", "<region/1>"), ("?t", "?s", "<p_size>", 10), ("?t", "?s", "<o_orderdate>", "1996-01-02"), ("?t", "<nowhere/1>", "?p", "?o")]):
        e = dictionaries.encode_pattern(Pattern(slots), d)
        back = dictionaries.decode_pattern(e, d) if e else {}
        rows.append((i, len(e.equal) if e else -1, ",".join(f"{k}={v}" for k, v in sorted(back.items()))))
    return spark.createDataFrame(rows, "i int, n int, back string")


QUERIES["encoded_pattern"] = _encoded_pattern
SQL["encoded_pattern"] = "SELECT * FROM (VALUES (0, 3, 'o=<region/1>,p=<n_regionkey>,s=<nation/3>'), (1, 2, 'o=10,p=<p_size>'), (2, 2, 'o=1996-01-02 00:00:00,p=<o_orderdate>'), (3, -1, '')) t(i, n, back)"


# ------------------------------------------------------------------ stores, dumps, maps


def _stored(spark: SparkSession, sf_dir: str) -> Store:
    path = new_path(spark)
    write_store(relation_triples(spark, sf_dir), path)
    return Store(spark, path)


def _over_store(term: str, output: Callable[[Result], DataFrame]) -> Query:
    return lambda spark, sf_dir: output(Engine(_stored(spark, sf_dir)).execute(term))


QUERIES |= {
    "store_all": lambda spark, sf_dir: _full(_stored(spark, sf_dir).all()),
    "store_tp_p": _over_store(_tp('"?s"', '"<c_nationkey>"', '"?o"'), _columns("?s", "?o")),
    "store_tp_s": _over_store(_tp('"<customer/7>"', '"?p"', '"?o"', '"?t"'), _columns("?t", "?p")),
    "store_join": _over_store(_PATH.replace("OP1", "hjoin").replace("OP2", "mjoin"), _columns("?c", "?r", b=("?b", "real"))),
}
SQL |= {"store_all": _FULL, "store_tp_p": SQL["tp_p"], "store_tp_s": SQL["tp_s"], "store_join": _PATH_SQL}


def _stream_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations loaded into a store, then regions as a stream of files in text form; all are queried together."""
    path, lines = new_path(spark), new_path(spark)
    write_store(relation_triples(spark, sf_dir, ("nation",)), path)
    raw = relation_triples(spark, sf_dir, ("region",)).select(F.concat_ws("\t", "tid", "s", "p", "o").alias("value"))
    raw.write.text(lines)
    append_to_store(triple_stream(spark, lines), path, new_path(spark)).awaitTermination()
    return Engine(Store(spark, path)).execute(_left_deep(["join"], [_SCAN("?n", "<n_regionkey>", "?r"), _SCAN("?r", "<r_name>", "?name")])).bindings("?n", "?name")


QUERIES["stream_append"] = _stream_append
SQL["stream_append"] = "SELECT '<nation/' || n_nationkey || '>' AS n, r_name AS name FROM nation JOIN region ON r_regionkey = n_regionkey"


def _redistributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded triples dumped as text by one assignment, read, dumped again by another, and read: triples and values by column."""
    found = _encoded(spark, sf_dir)
    ids = {r.p: r.freq for r in found.triples.groupBy("p").agg(F.count("*").alias("freq")).toLocalIterator()}
    names = {r.id: r.str for r in found.dictionary.entries.where(F.col("id").isin(list(ids))).collect()}
    freq = {names[i]: n for i, n in ids.items()}
    by_id = lambda assigned: {i: assigned[names[i]] for i in ids}
    one, two = new_path(spark), new_path(spark)
    distribution.dump_columns(distribution.route(found.triples, by_id(distribution.assign_greedy(freq, 4)))[0], one)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.triples.schema.fields) + ", clm int"
    distribution.redistribute(distribution.read_dump(spark, one, kinds), by_id(distribution.assign_round_robin(freq, 3)), two)
    back = distribution.read_dump(spark, two, kinds)
    return back.groupBy("clm").agg(F.count("*").alias("n"), F.countDistinct("p").alias("predicates"), F.count_if(F.col("oty") == 2).alias("whole"), F.sum(F.when(F.col("oty") == 2, F.col("o"))).alias("total"))


def _random_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random routing loses nothing, stays within its columns and, here, leaves none with under a sixth of the triples."""
    counts = distribution.route_random(relation_triples(spark, sf_dir), 4).groupBy("clm").count()
    return counts.agg(F.sum("count").alias("n"), F.min("clm").alias("first"), F.max("clm").alias("last"), (F.min("count") * 6 > F.sum("count")).alias("even"))


def _map_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicate counts saved as a table of keys and values, and loaded."""
    path = new_path(spark)
    save_map(spark, distribution.collect_frequency(distribution.predicate_frequency(Relations(spark, sf_dir))), path)
    return spark.createDataFrame(sorted(load_map(spark, path).items()), "p string, freq long")


QUERIES |= {"redistribute": _redistributed, "route_random": _random_route, "map_tables": _map_tables}
SQL["route_random"] = f"SELECT count(*) AS n, 1 AS first, 4 AS last, true AS even FROM ({_ALL})"
SQL["map_tables"] = f"SELECT p1 AS p, count(*) AS freq FROM ({_ALL}) GROUP BY p1"
SQL["redistribute"] = f"""WITH t AS ({_FULL}), ranked AS (SELECT p, row_number() OVER (ORDER BY count(*) DESC, p) AS r FROM t GROUP BY p)
SELECT ((r - 1) % 3 + 1)::INTEGER AS clm, count(*) AS n, count(DISTINCT p) AS predicates, count(*) FILTER (oty = 2) AS whole, sum(o_int)::BIGINT AS total FROM t JOIN ranked USING (p) GROUP BY ALL"""

# ------------------------------------------------------------------ joins on ids, differences
_add("join_id", '{join, {tp, {"?t", "?s", "<c_nationkey>", "?n"}, none, none}, {tp, {"?t", "?s2", "?p", "<nation/3>"}, none, none}, none, none}', _columns("?t", "?s", "?p"), "SELECT '<customer/' || c_custkey || '/c_nationkey>' AS t, '<customer/' || c_custkey || '>' AS s, '<c_nationkey>' AS p FROM customer WHERE c_nationkey = 3", "customer", "nation", "supplier")
_add("differ_urgent", '{differ, {tp, {"[]", "?o", "<o_custkey>", "?c"}, none, none}, {tp, {"[]", "?o", "<o_orderpriority>", "1-URGENT"}, none, none}, none, none}', _columns("?o", "?c"), "SELECT '<orders/' || o_orderkey || '>' AS o, '<customer/' || o_custkey || '>' AS c FROM orders WHERE o_orderpriority <> '1-URGENT'")


def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphs by node of a query of three patterns."""
    found = _engine(spark, sf_dir).profile(_PATH.replace("OP1", "hjoin").replace("OP2", "join"))
    return spark.createDataFrame([(n, op, rows, seconds > 0) for n, op, rows, seconds in found], "node int, op string, graphs long, timed boolean")


QUERIES["profile"] = _profile
SQL["profile"] = "WITH c AS (SELECT count(*) AS n, count(*) FILTER (c_acctbal > 0) AS positive FROM customer) SELECT node, op, graphs, true AS timed FROM (SELECT 1 AS node, 'tp' AS op, n AS graphs FROM c UNION ALL SELECT 2, 'tp', (SELECT count(*) FROM nation) UNION ALL SELECT 3, 'hjoin', n FROM c UNION ALL SELECT 4, 'tp', n FROM c UNION ALL SELECT 5, 'join', positive FROM c)"


def _typing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical forms made of a table's values, typed."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    day = F.lpad((F.col("c_custkey") % 40).cast("string"), 2, "0")
    form = F.expr("""CASE c_custkey % 6 WHEN 0 THEN concat('"', c_custkey, '"') WHEN 1 THEN concat(c_custkey, '.5') WHEN 2 THEN c_name WHEN 3 THEN concat(c_custkey, '.')
        WHEN 4 THEN concat(1900 + c_custkey % 100, '-##-##') END""")
    return from_lexical(c.select(F.lit("t").alias("tid"), F.concat(F.lit("<"), F.col("c_custkey").cast("string"), F.lit(">")).alias("s"), F.lit("is").alias("p"), F.coalesce(form, F.concat(F.lit("1966-01-"), day)).alias("o"))).select("s", F.col("oty").cast("int").alias("oty"), F.coalesce("o_int", F.lit(-1)).alias("o_int"), F.coalesce("o_real", F.lit(-1.0)).alias("o_real"), F.col("o_ts").alias("at"))


QUERIES["typing"] = _typing
SQL["typing"] = """SELECT '<' || c_custkey || '>' AS s,
  CASE c_custkey % 6 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 1 WHEN 3 THEN 1 WHEN 4 THEN 4 ELSE CASE WHEN c_custkey % 40 BETWEEN 1 AND 31 THEN 4 ELSE 1 END END AS oty,
  CASE WHEN c_custkey % 6 = 0 THEN c_custkey ELSE -1 END AS o_int, CASE WHEN c_custkey % 6 = 1 THEN c_custkey + 0.5::DOUBLE ELSE -1.0::DOUBLE END AS o_real,
  CASE WHEN c_custkey % 6 = 4 THEN make_timestamp(1900 + c_custkey % 100, 1, 1, 0, 0, 0) WHEN c_custkey % 6 = 5 AND c_custkey % 40 BETWEEN 1 AND 31 THEN make_timestamp(1966, 1, c_custkey % 40, 0, 0, 0) END AS at
FROM customer"""


def _tokenise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines made of a table's values, cut to triples, ids filled in."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey")
    line = F.concat(F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("<t"), F.col("n_nationkey"), F.lit(">"))).otherwise(F.lit("")), F.lit("\t<"), F.col("n_name"), F.lit('>\t\t<key>\t"'), F.col("n_regionkey"), F.lit('"^^xsd:integer\t'), F.col("n_regionkey"), F.lit(".0\n"))
    raw = n.select(*(c.alias(k) for k, c in tokens(line).items()))
    return fill_ids(raw).select("s", "p", "o", F.when(F.col("tid").startswith("<triple_id_"), F.length("tid")).otherwise(F.length("tid") * 0).cast("long").alias("filled"))


QUERIES["tokenise"] = _tokenise
SQL["tokenise"] = """SELECT '<' || n_name || '>' AS s, '<key>' AS p, '"' || n_regionkey || '"' AS o, CASE WHEN n_nationkey % 2 = 0 THEN 0 ELSE 24 END::BIGINT AS filled FROM nation"""

# ------------------------------------------------------------------ statistics, distribution
QUERIES["pred_freq"] = lambda spark, d: distribution.predicate_frequency(Relations(spark, d))
SQL["pred_freq"] = f"SELECT p1 AS p, count(*) AS freq FROM ({_ALL}) GROUP BY p1"


def _assigned(assign):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        freq = distribution.collect_frequency(distribution.predicate_frequency(Relations(spark, sf_dir)))
        return spark.createDataFrame(sorted(assign(freq, 4).items()), "p string, clm int")

    return run


QUERIES |= {"assign_greedy": _assigned(distribution.assign_greedy), "assign_rr": _assigned(distribution.assign_round_robin)}
_FREQ = f"freq AS (SELECT p1 AS p, count(*) AS f FROM ({_ALL}) GROUP BY p1), ranked AS (SELECT p, f, row_number() OVER (ORDER BY f DESC, p) AS r FROM freq)"
SQL["assign_rr"] = f"WITH {_FREQ} SELECT p, ((r - 1) % 4 + 1)::INTEGER AS clm FROM ranked"
SQL["assign_greedy"] = f"""WITH RECURSIVE {_FREQ}, go(r, p, clm, l1, l2, l3, l4) AS (
  SELECT 0::BIGINT, NULL::VARCHAR, NULL::INTEGER, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT UNION ALL
  SELECT n.r, n.p, n.c, l1 + CASE WHEN n.c = 1 THEN n.f ELSE 0 END, l2 + CASE WHEN n.c = 2 THEN n.f ELSE 0 END, l3 + CASE WHEN n.c = 3 THEN n.f ELSE 0 END, l4 + CASE WHEN n.c = 4 THEN n.f ELSE 0 END
  FROM (SELECT k.r, k.p, k.f, l1, l2, l3, l4, list_position([l1, l2, l3, l4], least(l1, l2, l3, l4))::INTEGER AS c FROM go JOIN ranked k ON k.r = go.r + 1) n)
SELECT p, clm FROM go WHERE p IS NOT NULL"""


def _route(spark: SparkSession, sf_dir: str) -> DataFrame:
    triples = relation_triples(spark, sf_dir)
    freq = distribution.collect_frequency(distribution.predicate_frequency(triples))
    known = {p: n for p, n in freq.items() if p != "<p_size>"}
    routed, refused = distribution.route(triples, distribution.assign_round_robin(known, 3))
    rows = routed.select("clm").unionAll(refused.select(F.lit(0).alias("clm")))
    return rows.groupBy("clm").agg(F.count("*").alias("n"))


QUERIES["route"] = _route
SQL["route"] = f"""WITH freq AS (SELECT p1 AS p, count(*) AS f FROM ({_ALL}) GROUP BY p1), ranked AS (SELECT p, f, row_number() OVER (ORDER BY f DESC, p) AS r FROM freq WHERE p <> '<p_size>')
SELECT clm, sum(f)::BIGINT AS n FROM (SELECT ((r - 1) % 3 + 1)::INTEGER AS clm, f FROM ranked UNION ALL SELECT 0, f FROM freq WHERE p = '<p_size>') GROUP BY clm"""


def _count_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A capped result beside its uncapped count."""
    result = _engine(spark, sf_dir, "nation").execute(_tp('"?s"', '"<n_name>"', '"?o"'))
    whole = result.frame.agg(F.count("*").alias("whole"))
    return result.limit(10).frame.agg(F.count("*").alias("capped")).crossJoin(whole)


QUERIES["count_cap"] = _count_cap
SQL["count_cap"] = "SELECT least(10, count(*)) AS capped, count(*) AS whole FROM nation"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["join_path"](spark, sf_dir)
