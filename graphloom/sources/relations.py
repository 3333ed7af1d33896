"""Relational tables as triples.

A row's subject is <table/key>, each column a predicate <column>; a foreign key is the subject of the row it
refers to, other objects are integers, reals, datetimes or codes.  The id is <table/key/column>.  The triples are a view: a
union with one branch a column whose predicate is a literal, so that a constant
predicate leaves one branch and reads two columns.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.terms import Pattern, Typed, is_variable, is_wildcard
from .triples import SCHEMA, typed_triple

#: table: (key column, {column: kind}); a kind that names a table is a foreign key.
TABLES: dict[str, tuple[str, dict[str, str]]] = {
    "region": ("r_regionkey", {"r_name": "code"}),
    "nation": ("n_nationkey", {"n_name": "code", "n_regionkey": "region"}),
    "customer": ("c_custkey", {"c_name": "code", "c_nationkey": "nation", "c_acctbal": "real", "c_mktsegment": "code"}),
    "supplier": ("s_suppkey", {"s_name": "code", "s_nationkey": "nation", "s_acctbal": "real"}),
    "part": ("p_partkey", {"p_name": "code", "p_brand": "code", "p_type": "code", "p_size": "integer", "p_retailprice": "real"}),
    "orders": ("o_orderkey", {"o_custkey": "customer", "o_orderstatus": "code", "o_totalprice": "real", "o_orderdate": "datetime", "o_orderpriority": "code"}),
}


_NAME = re.compile(r"<(\w+)/(-?[0-9]+)>")
_ID = re.compile(r"<(\w+)/(-?[0-9]+)/(\w+)>")


def _name(table: str, column: str) -> Column:
    return F.concat(F.lit(f"<{table}/"), F.col(column).cast("string"), F.lit(">"))


def _branch(frame: DataFrame, table: str, key: str, column: str, kind: str) -> DataFrame:
    tid = F.concat(F.lit(f"<{table}/"), F.col(key).cast("string"), F.lit(f"/{column}>"))
    value = _name(kind, column) if kind in TABLES else F.col(column)
    row = frame.where(F.col(column).isNotNull() & F.col(key).isNotNull())
    return row.select(*typed_triple(tid, _name(table, key), f"<{column}>", "code" if kind in TABLES else kind, value))


def table_triples(frame: DataFrame, table: str, key: str, columns: dict[str, str]) -> DataFrame:
    return reduce(DataFrame.unionAll, (_branch(frame, table, key, c, kind) for c, kind in columns.items()))


class Relations:
    """The triples of the tables in a folder of Parquet files.

    matching(pattern) makes only the branches that the pattern's constants allow, and puts constant names,
    ids and references as filters on the plain key columns, which the Parquet reader can use to skip.
    """

    def __init__(self, spark: SparkSession, folder: str, tables: tuple[str, ...] | None = None):
        self.spark, self.folder = spark, folder
        self.tables = {t: TABLES[t] for t in tables or TABLES}
        self.frames: dict[str, DataFrame] = {}

    def frame(self, table: str) -> DataFrame:
        """A table, opened when it is first needed."""
        if table not in self.frames:
            self.frames[table] = self.spark.read.parquet(f"{self.folder}/{table}.parquet")
        return self.frames[table]

    def all(self) -> DataFrame:
        return reduce(DataFrame.unionAll, (table_triples(self.frame(t), t, key, columns) for t, (key, columns) in self.tables.items()))

    def predicate_frequency(self) -> DataFrame:
        """p, freq: one scan a table, each column counted by itself."""
        counts = []
        for table, (key, columns) in self.tables.items():
            one = self.frame(table).where(F.col(key).isNotNull()).agg(*(F.count(c).alias(c) for c in columns))
            pairs = F.array(*(F.struct(F.lit(f"<{c}>").alias("p"), F.col(c).alias("freq")) for c in columns))
            counts.append(one.select(F.explode(pairs).alias("x")).select("x.p", "x.freq").where("freq > 0"))
        return reduce(DataFrame.unionAll, counts)

    def matching(self, pattern: Pattern) -> DataFrame:
        """Triples among which all that match are; the caller still compares every constant."""
        tid, s, p, o = (None if is_variable(x) or is_wildcard(x) else x.value if isinstance(x, Typed) else x for x in pattern.slots)
        named, known = (m.fullmatch(x) if isinstance(x, str) else None for m, x in ((_NAME, s), (_ID, tid)))
        reference = _NAME.fullmatch(o) if isinstance(o, str) else None
        branches = []
        for table, (key, columns) in self.tables.items():
            if (s is not None and (not named or named[1] != table)) or (tid is not None and (not known or known[1] != table)):
                continue
            for column, kind in columns.items():
                if (p is not None and p != f"<{column}>") or (tid is not None and known[3] != column):
                    continue
                frame = self.frame(table)
                for m in (named, known):
                    if m:
                        frame = frame.where(F.col(key) == F.lit(int(m[2])))
                if reference and kind in TABLES:
                    if kind != reference[1]:
                        continue
                    frame = frame.where(F.col(column) == F.lit(int(reference[2])))
                branches.append(_branch(frame, table, key, column, kind))
        return reduce(DataFrame.unionAll, branches) if branches else self.spark.createDataFrame([], SCHEMA)


def relation_triples(spark: SparkSession, folder: str, tables: tuple[str, ...] | None = None) -> DataFrame:
    return Relations(spark, folder, tables).all()
