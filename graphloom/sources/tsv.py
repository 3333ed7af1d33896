"""Tab-separated triple files.

A line is id, subject, predicate, object and perhaps more fields, which aren't used; a line that
starts with a tab has no id.  Empty fields don't count.  What follows ^^ in an object is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .stored import frozen


def tokens(line: Column) -> dict[str, Column]:
    """tid, s, p, o of a line; parts that are missing are null."""
    parts = F.filter(F.split(F.regexp_replace(line, r"[\r\n]+$", ""), "\t"), lambda x: x != "")
    bare = line.startswith("\t")
    at = lambda i: F.try_element_at(parts, F.when(bare, F.lit(i)).otherwise(F.lit(i + 1)))
    return {"tid": F.when(~bare, F.try_element_at(parts, F.lit(1))), "s": at(1), "p": at(2), "o": F.substring_index(at(3), "^^", 1)}


def parse(lines: DataFrame, line: str = "value") -> DataFrame:
    """tid, s, p, o, line: tid may be null; rows without subject, predicate or object are kept and have a null there."""
    return lines.select(*(c.alias(n) for n, c in tokens(F.col(line)).items()), F.col(line).alias("line"))


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL").drop("line")


def rejected(parsed: DataFrame) -> DataFrame:
    """Lines that hold no triple, blank ones left out."""
    return parsed.where("(s IS NULL OR p IS NULL OR o IS NULL) AND trim(line) <> ''").select("line")


def read_tsv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """tid, s, p, o of the lines of some files."""
    return accepted(parse(spark.read.text(paths)))


def number_rows(frame: DataFrame, name: str, first: int = 1, scan: bool = False) -> DataFrame:
    """frame with a running number over its rows in their order.

    Rows are counted by partition; only these counts meet in one place, never the rows.  The frame is written between
    the two passes, since every use must see the same numbers; not so if it is a mere scan of files, whose partitions
    are the same each time.
    """
    marked = frame.withColumn("__at", F.monotonically_increasing_id())
    if not scan:
        marked = frozen(marked)
    part = F.shiftright("__at", 33)
    counts = marked.groupBy(part.alias("__part")).count()
    starts, total = {}, first
    for row in sorted(counts.toLocalIterator(), key=lambda r: r["__part"]):
        starts[row["__part"]] = total
        total += row["count"]
    if not starts:
        return frame.withColumn(name, F.lit(first).cast("long"))
    table = frame.sparkSession.createDataFrame(list(starts.items()), "__part long, __start long")
    numbered = marked.withColumn("__part", part).join(F.broadcast(table), "__part")  # a row a partition
    return numbered.withColumn(name, F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).select(*frame.columns, name)


def fill_ids(raw: DataFrame, skeleton: str = "<triple_id_", first: int = 0, scan: bool = False) -> DataFrame:
    """Rows without an id get the skeleton and a number of 12 digits, counting up from first over all such rows.  scan: as for number_rows."""
    known, missing = raw.where("tid IS NOT NULL"), raw.where("tid IS NULL")
    named = number_rows(missing, "__n", first, scan).withColumn("tid", F.concat(F.lit(skeleton), F.lpad(F.col("__n").cast("string"), 12, "0"), F.lit(">") if skeleton.startswith("<") else F.lit("")))
    return known.unionByName(named.select(*known.columns))


class FileList:
    """A list of input files that can be added to, removed from and cleared."""

    def __init__(self, *paths: str):
        self.paths = list(paths)

    def add(self, *paths: str) -> "FileList":
        self.paths += [p for p in paths if p not in self.paths]
        return self

    def remove(self, *paths: str) -> "FileList":
        self.paths = [p for p in self.paths if p not in paths]
        return self

    def clear(self) -> "FileList":
        self.paths = []
        return self

    def read(self, spark: SparkSession) -> DataFrame:
        return read_tsv(spark, self.paths)
