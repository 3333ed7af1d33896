"""Predicate statistics, and the distribution of triples over columns (horizontal parts of the store)."""

from __future__ import annotations

import heapq
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def predicate_frequency(triples: Any) -> DataFrame:
    """p, freq: counts, combined before the shuffle.  A source that can count its own predicates does."""
    if hasattr(triples, "predicate_frequency"):
        return triples.predicate_frequency()
    return triples.groupBy("p").agg(F.count("*").alias("freq"))


def collect_frequency(freq: DataFrame, most: int = 1_000_000) -> dict[str, int]:
    """The counts as a map.  Predicates are a vocabulary; more than most of them is an error, not a cut."""
    rows = freq.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} predicates")
    return {r.p: r.freq for r in rows}


def assign_greedy(freq: dict[str, int], columns: int) -> dict[str, int]:
    """Predicates by falling count, then name, each to the column with the least load so far, then the smallest number."""
    heap = [(0, c) for c in range(1, columns + 1)]
    out = {}
    for p in sorted(freq, key=lambda p: (-freq[p], p)):
        load, column = heapq.heappop(heap)
        out[p] = column
        heapq.heappush(heap, (load + freq[p], column))
    return out


def assign_round_robin(freq: dict[str, int], columns: int) -> dict[str, int]:
    """Predicates by falling count, then name, to columns 1, 2, ... in turn."""
    return {p: i % columns + 1 for i, p in enumerate(sorted(freq, key=lambda p: (-freq[p], p)))}


def route(triples: DataFrame, assignment: dict[Any, int]) -> tuple[DataFrame, DataFrame]:
    """Triples, encoded or not, with their column clm, and those whose predicate has none."""
    spark = triples.sparkSession
    table = spark.createDataFrame(list(assignment.items()) or [], f"p {dict(triples.dtypes)['p']}, clm int")
    # As many rows as the assignment, which was made on the driver, has.
    return triples.join(F.broadcast(table), "p").select(*triples.columns, "clm"), triples.join(F.broadcast(table), "p", "left_anti")


def route_random(triples: DataFrame, columns: int) -> DataFrame:
    """Triples with a column drawn by a hash, so that a repeated run deals them alike."""
    return triples.withColumn("clm", (F.pmod(F.xxhash64("tid", "s", "p", "o"), F.lit(columns)) + 1).cast("int"))


def dump_columns(routed: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder of tab-separated files per column."""
    flat = [F.col(c).cast("string").alias(c) for c in routed.columns if c != "clm"]
    routed.select("clm", *flat).write.mode(mode).partitionBy("clm").option("sep", "\t").option("quote", "").csv(path)


def read_dump(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of dumps, clm included; schema: their columns in order, then clm."""
    return spark.read.schema(schema).option("sep", "\t").option("quote", "").csv(path)


def redistribute(dump: DataFrame, assignment: dict[Any, int], path: str) -> None:
    """Dumps of a new assignment from rows (with a column p) of an old one."""
    dump_columns(route(dump.drop("clm"), assignment)[0], path)
