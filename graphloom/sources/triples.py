"""Frames of triples: schema, typing of lexical objects, storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.objects import typed_columns
from ..plans.terms import SLOTS, Pattern, Typed, is_variable, is_wildcard
from .stored import tasks_for

SCHEMA = T.StructType(
    [
        T.StructField("tid", T.StringType()),
        T.StructField("s", T.StringType()),
        T.StructField("p", T.StringType()),
        T.StructField("oty", T.ShortType()),
        T.StructField("o", T.StringType()),
        T.StructField("o_int", T.LongType()),
        T.StructField("o_real", T.DoubleType()),
        T.StructField("o_ts", T.TimestampNTZType()),
    ]
)


def from_lexical(raw: DataFrame) -> DataFrame:
    """Triples from lexical tid, s, p, o; other columns are dropped."""
    return raw.select("tid", "s", "p", *(c.alias(n) for n, c in typed_columns(F.col("o")).items())).select(*SCHEMA.names)


def typed_triple(tid: Column, s: Column, p: str, kind: str, value: Column) -> list[Column]:
    """The columns of a triple whose object's type is known: code, integer, real or datetime."""
    none = {"o_int": F.lit(None).cast("long"), "o_real": F.lit(None).cast("double"), "o_ts": F.lit(None).cast("timestamp_ntz")}
    if kind == "integer":
        none["o_int"] = value.cast("long")
        text, oty = value.cast("long").cast("string"), 2
    elif kind == "real":
        none["o_real"] = value.cast("double")
        text, oty = value.cast("double").cast("string"), 3
    elif kind == "datetime":
        none["o_ts"] = value.cast("timestamp_ntz")
        text, oty = F.date_format(none["o_ts"], "yyyy-MM-dd HH:mm:ss"), 4
    else:
        text, oty = value.cast("string"), 1
    return [tid.alias("tid"), s.alias("s"), F.lit(p).alias("p"), F.lit(oty).cast("short").alias("oty"), text.alias("o"), *(c.alias(n) for n, c in none.items())]


BUCKETS = 64
#: The first load's batch; those of a stream count from 0.
LOADED = -1


def _part(p: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(p), F.lit(buckets)).cast("int")


def write_store(triples: DataFrame, path: str, buckets: int = BUCKETS, batch: int | None = None) -> None:
    """A store laid out for scans: folders by batch and by a hash of the predicate, rows sorted by predicate and subject.

    Constant predicates prune folders, constant subjects skip row groups.  Rows of one predicate
    are spread over several files by subject, so a frequent predicate isn't one task's work.  The rows are counted first, so
    that a task sorts a bounded number of them.  Without a batch the whole store
    is written anew, with one that batch alone.
    """
    out = triples.select(*SCHEMA.names).withColumn("p_part", _part(F.col("p"), buckets))
    sorted_ = out.repartitionByRange(tasks_for(triples.count()), "p_part", "p", "s").sortWithinPartitions("p_part", "p", "s")
    if batch is None:
        sorted_.withColumn("batch", F.lit(LOADED)).write.mode("overwrite").partitionBy("batch", "p_part").parquet(path)
    else:
        sorted_.write.mode("overwrite").partitionBy("p_part").parquet(f"{path}/batch={batch}")


class Store:
    """A stored table of triples; for a pattern it reads the folder of a constant predicate only."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.path, self.buckets = path, buckets
        kind = T.StructType([*SCHEMA.fields, T.StructField("batch", T.IntegerType()), T.StructField("p_part", T.IntegerType())])
        self.frame = spark.read.schema(kind).parquet(path)

    def all(self) -> DataFrame:
        return self.frame.select(*SCHEMA.names)

    def matching(self, pattern: Pattern) -> DataFrame:
        """Triples among which all that match are."""
        p = pattern.slots[SLOTS.index("p")]
        p = p.value if isinstance(p, Typed) else p
        if not isinstance(p, str) or is_variable(p) or is_wildcard(p):
            return self.all()
        return self.frame.where((F.col("p_part") == _part(F.lit(p), self.buckets)) & (F.col("p") == p)).select(*SCHEMA.names)


def read_store(spark: SparkSession, path: str, buckets: int = BUCKETS) -> Store:
    return Store(spark, path, buckets)


def dump_csv(frame: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A table as tab-separated text, one folder."""
    flat = [F.col(c).cast("string").alias(c) for c in frame.columns]
    frame.select(*flat).write.mode(mode).option("sep", "\t").option("quote", "").csv(path)


def save_map(spark: SparkSession, pairs: dict, path: str) -> None:
    """A table of (k, v) for a small map of names to whole numbers."""
    spark.createDataFrame(sorted(pairs.items()), "k string, v long").coalesce(1).write.mode("overwrite").parquet(path)


def load_map(spark: SparkSession, path: str) -> dict:
    return {r.k: r.v for r in spark.read.parquet(path).toLocalIterator()}
