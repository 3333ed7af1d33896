"""The string dictionary: every string has a whole-number id, and triples can be stored as numbers."""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.objects import CODE, DATETIME, EPOCH, INTEGER, REAL, STRING, constant
from ..plans.terms import SLOTS, Pattern, TermError, Typed, is_variable, is_wildcard
from ..sources.stored import discard, frozen, passing, slices_for, sparing, tasks_for, written
from ..sources.triples import SCHEMA
from ..sources.tsv import number_rows


@dataclass(frozen=True)
class Dictionary:
    """entries: id, str; last: the largest id ever given, so that ids of deleted strings don't come back."""

    entries: DataFrame
    last: int = 0

    @staticmethod
    def empty(spark: SparkSession) -> "Dictionary":
        return Dictionary(spark.createDataFrame([], "id long, str string"))

    def append(self, strings: DataFrame, most: int | None = None) -> "Dictionary":
        """With ids for the strings (column str) that have none, in order of the strings; null has no id.  most: there aren't more strings; else they are counted."""
        given = strings.select("str").where("str IS NOT NULL")
        first = self.entries.isEmpty()
        spark = strings.sparkSession
        with sparing(spark), passing(spark) as keep:
            # Parts of a given number, which are not merged, so that no task groups or sorts more than tasks_for says.
            new = given.repartition(tasks_for(given.count() if most is None else most), "str").distinct()
            new = frozen(new if first else new.join(self.entries, "str", "left_anti"))
            rows = new.count()
            # number_rows writes the sorted rows, so every use sees the same ids; they are written with these, so that a range of ids is read by itself.
            numbered = keep(number_rows(new.repartitionByRange(tasks_for(rows), "str").sortWithinPartitions("str"), "id", self.last + 1).select("id", "str"))
        return Dictionary(numbered if first else self.entries.unionByName(numbered), self.last + rows)

    def get_id(self, string: str) -> tuple["Dictionary", int]:
        """The id of a string, appended if it has none."""
        found = self.find(string)
        if found is not None:
            return self, found
        spark = self.entries.sparkSession
        return Dictionary(self.entries.unionByName(spark.createDataFrame([(self.last + 1, string)], "id long, str string")), self.last + 1), self.last + 1

    def find_all(self, strings: list[str]) -> dict[str, int]:
        """The ids of those strings, few, that have one."""
        rows = self.entries.where(F.col("str").isin(strings)).select("str", "id").collect() if strings else []
        return {r["str"]: r.id for r in rows}

    def find(self, string: str) -> int | None:
        row = self.entries.where(F.col("str") == string).select("id").first()
        return row.id if row else None

    def find_string(self, number: int) -> str | None:
        row = self.entries.where(F.col("id") == number).select("str").first()
        return row["str"] if row else None

    def delete(self, ids: DataFrame) -> "Dictionary":
        return Dictionary(self.entries.join(ids.select("id"), "id", "left_anti"), self.last)

    def size(self) -> int:
        return self.entries.count()


def strings_of(triples: DataFrame) -> DataFrame:
    """The strings that encoding needs, repeats included: ids, subjects, code objects, and each predicate once."""
    name = F.when(F.col("oty").isin(0, CODE, STRING), F.col("o"))
    out = triples.select(F.explode(F.array("tid", "s", name)).alias("str")).unionAll(triples.select(F.col("p").alias("str")).distinct())
    return out.where("str IS NOT NULL")


#: As many predicates are told to all tasks; more are joined by a shuffle.
MOST_PREDICATES = 100_000


def _predicates(rows: DataFrame, column: str, entries: DataFrame, key: str) -> DataFrame | None:
    """The entries of the predicates in rows, to broadcast: few, so that a frequent predicate needn't be one task's work.  None if they aren't few."""
    few = rows.select(F.col(column).alias(key)).distinct().limit(MOST_PREDICATES + 1).collect()
    if len(few) > MOST_PREDICATES:
        return None
    if len(few) <= DRAWN // FREQUENT:
        # A filter lets the reader skip what lies between the ids or strings that are wanted.
        return F.broadcast(frozen(entries.where(F.col(key).isin([r[0] for r in few if r[0] is not None]))))
    wanted = entries.sparkSession.createDataFrame([(r[0],) for r in few], f"{key} {dict(entries.dtypes)[key]}")
    return F.broadcast(frozen(entries.join(F.broadcast(wanted), key, "left_semi")))


#: Of so many rows drawn, a value that comes FREQUENT times is told to all tasks, so that its rows needn't meet in one; there are at most DRAWN / FREQUENT.
DRAWN, FREQUENT = 100_000, 50


def _frequent(rows: DataFrame, total: int, columns: tuple[str, ...]) -> dict[str, list]:
    """Values that probably are frequent in a column.  What is drawn decides only how a value is joined."""
    drawn = rows.select(*columns).sample(min(1.0, DRAWN / max(1, total)), seed=1)
    pairs = F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns))
    found = drawn.select(F.explode(pairs).alias("x")).where("x.v IS NOT NULL").groupBy("x.c", "x.v").count().where(F.col("count") >= FREQUENT).collect()
    kind = int if dict(rows.dtypes)[columns[0]] == "bigint" else str
    return {c: [kind(r.v) for r in found if r.c == c] for c in columns}


def _known(entries: DataFrame, key: str, wanted: str, frequent: list, column: str) -> DataFrame:
    """The entries of frequent values, few, as column and __known."""
    kinds = dict(entries.dtypes)
    known = [(r[0], r[1]) for r in entries.where(F.col(key).isin(frequent)).select(key, wanted).collect()] if frequent else []
    return F.broadcast(entries.sparkSession.createDataFrame(known, f"{column} {kinds[key]}, __known {kinds[wanted]}"))


def _joined(rows: DataFrame, column: str, entries: DataFrame, key: str, wanted: str, parts: int, frequent: list) -> DataFrame:
    """rows with column's value, entries' key, replaced by wanted of its entry, null if it has none.

    Values are joined by a hash of them: long texts that begin alike are slow to sort.  Rows without a value, and those of
    frequent values, which are joined by a broadcast of few entries, are spread over all parts.
    """
    kinds, get = dict(entries.dtypes), f"__{column}_{wanted}"
    table = entries.select(F.xxhash64(key).alias("__k"), F.col(key).alias("__key"), F.col(wanted).alias("__wanted"))
    if frequent:
        rows = rows.join(_known(entries, key, wanted, frequent, column), column, "left")
    else:
        rows = rows.withColumn("__known", F.lit(None).cast(kinds[wanted]))
    left = F.when(F.col("__known").isNull(), F.col(column))
    others = [c for c in rows.columns if c not in (column, "__known")]
    spread = rows.withColumn("__at", left).withColumn("__hash", F.when(F.col("__at").isNull(), F.xxhash64(*others)).otherwise(F.xxhash64("__at"))).drop(column)
    spread = spread.repartition(parts, "__hash", "__at")
    table = table.repartition(parts, "__k", "__key")
    found = spread.join(table, (F.col("__hash") == F.col("__k")) & (F.col("__at") == F.col("__key")), "left")
    return found.select(*others, F.coalesce("__known", "__wanted").alias(get)).withColumnRenamed(get, column)


def _joined_slice(rows: DataFrame, column: str, entries: DataFrame, key: str, wanted: str, parts: int) -> DataFrame:
    """_joined for rows that all have a value, none of it frequent."""
    others, get = [c for c in rows.columns if c != column], f"__{column}_{wanted}"
    table = entries.select(F.col(key).alias("__key"), F.col(wanted).alias("__wanted"))
    on = [(column, "__key")]
    if dict(entries.dtypes)[key] == "string":
        rows, table, on = rows.withColumn("__hash", F.xxhash64(column)), table.withColumn("__k", F.xxhash64("__key")), [("__hash", "__k"), *on]
    rows, table = rows.repartition(parts, *(a for a, _ in on)), table.repartition(parts, *(b for _, b in on))
    return rows.join(table, [F.col(a) == F.col(b) for a, b in on], "left").select(*others, F.col("__wanted").alias(get)).withColumnRenamed(get, column)


#: So many values are drawn of each column and of the dictionary to cut them into slices.
CUTS = 4000


def _bounds(rows: DataFrame, columns: tuple[str, ...], frequent: dict[str, list], entries: DataFrame, key: str, total: int, size: int, slices: int) -> dict[str, list]:
    """Values that cut each column and the dictionary into slices.  What is drawn decides only how large a slice is."""
    pairs = F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in columns))
    drawn = rows.select(*columns).sample(min(1.0, CUTS / max(1, total)), seed=2).select(F.explode(pairs).alias("x")).select("x.c", "x.v")
    told = entries.sample(min(1.0, CUTS / max(1, size)), seed=2).select(F.lit("").alias("c"), F.col(key).alias("v"))
    # In Spark's order, by which the slices are read.
    found = drawn.unionAll(told).where("v IS NOT NULL").orderBy("v").collect()
    out = {}
    for c in columns:
        apart = set(frequent[c])
        values = [r.v for r in found if r.c in ("", c) and r.v not in apart]
        out[c] = list(dict.fromkeys(values[len(values) * i // slices] for i in range(1, slices))) if values else []
    return out


def _between(column: str, bounds: list, i: int) -> Column:
    low = F.col(column) > F.lit(bounds[i - 1]) if i > 0 else F.lit(True)
    return low & (F.col(column) <= F.lit(bounds[i])) if i < len(bounds) else low


def _slices(rows: DataFrame, column: str, entries: DataFrame, key: str, wanted: str, parts: int, frequent: list, bounds: list) -> Iterator[DataFrame]:
    """The rows of _joined, those of a slice of the values after another.  Rows without a value and those of frequent ones stay where they are."""
    apart = F.col(column).isNull() | F.col(column).isin(frequent) if frequent else F.col(column).isNull()
    others = [c for c in rows.columns if c != column]
    yield rows.where(apart).join(_known(entries, key, wanted, frequent, column), column, "left").select(*others, F.col("__known").alias(column))
    for i in range(len(bounds) + 1):
        yield _joined_slice(rows.where(~apart & _between(column, bounds, i)), column, entries.where(_between(key, bounds, i)), key, wanted, parts)


def _replaced(rows: DataFrame, columns: tuple[str, ...], entries: DataFrame, key: str, wanted: str, scan: bool = False) -> tuple[DataFrame, bool]:
    """rows with the columns' values, entries' key, replaced by wanted of their entries, null if there is none; if they were written.

    Of few rows nothing is written.  Else the rows are written, then a column after the other is replaced and written in slices, so that disk holds
    two states of the rows and the shuffle of one slice, not those of all columns.  scan: they are a mere scan of files, which needn't be written first.
    """
    spark, total, size, before = rows.sparkSession, rows.count(), entries.count(), None
    slices = slices_for(max(total, size))
    if slices > 1 and not scan:
        rows, before = written([rows])
    frequent = _frequent(rows, total, columns)
    if slices == 1:
        for c in columns:
            rows = _joined(rows, c, entries, key, wanted, tasks_for(max(total, size)), frequent[c])
        return rows, False
    bounds = _bounds(rows, columns, frequent, entries, key, total, size, slices)
    for c in columns:
        with sparing(spark, parts := tasks_for(-(-max(total, size) // slices))):
            rows, path = written(_slices(rows, c, entries, key, wanted, parts, frequent[c], bounds[c]))
        if before:
            discard(spark, before)
        before = path
    return rows, True


def _encode(triples: DataFrame, dictionary: Dictionary) -> tuple[DataFrame, bool]:
    name = F.when(F.col("oty").isin(0, CODE, STRING), F.col("o"))
    seconds = F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', o_ts) + {EPOCH}L")
    value = F.when(F.col("oty") == INTEGER, F.col("o_int")).when(F.col("oty") == REAL, F.lit(0).cast("long")).when(F.col("oty") == DATETIME, seconds)
    entries = _predicates(triples, "p", dictionary.entries, "str")
    out = triples.select("tid", "s", "p", "oty", name.alias("name"), value.alias("value"), F.col("o_real").alias("orl"))
    if entries is not None:
        out = out.join(entries.select(F.col("id").alias("p_id"), F.col("str").alias("p")), "p", "left").drop("p").withColumnRenamed("p_id", "p")
    out, stored = _replaced(out, ("tid", "s", "name") if entries is not None else ("p", "tid", "s", "name"), dictionary.entries, "str", "id")
    return out.select("tid", "s", "p", F.coalesce("value", "name").alias("o"), "orl", "oty"), stored


def encode_triples(triples: DataFrame, dictionary: Dictionary) -> DataFrame:
    """tid, s, p, o (long), orl (double), oty: names by their ids, integers as they are, datetimes as seconds from year 0, reals in orl with o 0."""
    return _encode(triples, dictionary)[0]


def encoded_table(triples: DataFrame, dictionary: Dictionary) -> DataFrame:
    """encode_triples as a table in the shared folder."""
    out, stored = _encode(triples, dictionary)
    if stored:
        return out
    with sparing(triples.sparkSession):
        return frozen(out)


def decode_triples(encoded: DataFrame, dictionary: Dictionary, scan: bool = False) -> DataFrame:
    """The triples that encode_triples has numbered.  scan: encoded is a mere scan of files."""
    code = F.when(F.col("oty").isin(0, CODE, STRING), F.col("o"))
    out = encoded.select("tid", "s", "p", code.alias("name"), F.when(~F.col("oty").isin(0, CODE, STRING), F.col("o")).alias("value"), "orl", "oty")
    entries = _predicates(encoded, "p", dictionary.entries, "id")
    out, _ = _replaced(out, ("name", "s", "tid") if entries is not None else ("p", "name", "s", "tid"), dictionary.entries, "id", "str", scan)
    if entries is not None:
        out = out.join(entries.select(F.col("id").alias("p"), F.col("str").alias("p_str")), "p", "left").drop("p").withColumnRenamed("p_str", "p")
    stamp = F.when(F.col("oty") == DATETIME, F.expr(f"timestampadd(SECOND, value - {EPOCH}L, timestamp_ntz'1970-01-01 00:00:00')"))
    whole = F.when(F.col("oty") == INTEGER, F.col("value"))
    text = F.coalesce("name", whole.cast("string"), F.col("orl").cast("string"), F.date_format(stamp, "yyyy-MM-dd HH:mm:ss"))
    return out.select("tid", "s", "p", "oty", text.alias("o"), whole.alias("o_int"), F.col("orl").alias("o_real"), stamp.alias("o_ts")).select(*SCHEMA.names)


@dataclass(frozen=True)
class EncodedPattern:
    """A pattern with numbers for its constants: (column, value) pairs that must hold, and the object's type if it is constant."""

    equal: tuple[tuple[str, int | float], ...]
    oty: int | None = None


def encode_pattern(pattern: Pattern, dictionary: Dictionary) -> EncodedPattern | None:
    """The pattern's constants as numbers; None if one has no id, so that no triple can match.  Nothing is appended."""
    names, plain, oty = {}, [], None
    for slot, value in zip(SLOTS, pattern.slots, strict=True):
        if is_variable(value) or is_wildcard(value):
            continue
        raw, kind = (value.value, value.type) if isinstance(value, Typed) else (value, None)
        if slot != "o":
            if not isinstance(raw, str):
                raise TermError(f"the {slot} slot holds names, not {raw!r}")
            names[slot] = raw
            continue
        oty, v = constant(raw, kind)
        if oty == INTEGER:
            plain.append(("o", v))
        elif oty == REAL:
            plain.append(("orl", v))
        elif oty == DATETIME:
            plain.append(("o", (v - datetime.datetime(1970, 1, 1)) // datetime.timedelta(seconds=1) + EPOCH))
        else:
            oty = STRING if oty == STRING else CODE
            names["o"] = v
    ids = dictionary.find_all(sorted(set(names.values())))
    if any(v not in ids for v in names.values()):
        return None
    return EncodedPattern(tuple((slot, ids[v]) for slot, v in names.items()) + tuple(plain), oty)


def decode_pattern(encoded: EncodedPattern, dictionary: Dictionary) -> dict[str, str | int | float | datetime.datetime]:
    """slot -> constant of an encoded pattern."""
    out = {}
    for column, value in encoded.equal:
        if column == "orl":
            out["o"] = value
        elif column != "o" or encoded.oty in (CODE, STRING):
            out[column] = dictionary.find_string(value)
        else:
            out["o"] = value if encoded.oty == INTEGER else datetime.datetime(1970, 1, 1) + datetime.timedelta(seconds=value - EPOCH)
    return out


class Encoded:
    """Encoded triples and their dictionary, to query: constants are compared as numbers, and only what matches is decoded."""

    def __init__(self, triples: DataFrame, dictionary: Dictionary):
        self.triples, self.dictionary = triples, dictionary

    def matching(self, pattern: Pattern) -> DataFrame:
        found = encode_pattern(pattern, self.dictionary)
        if found is None:
            return self.triples.sparkSession.createDataFrame([], SCHEMA)
        rows = self.triples if found.oty is None else self.triples.where(F.col("oty") == found.oty)
        for column, value in found.equal:
            rows = rows.where(F.col(column) == F.lit(value))
        return decode_triples(rows, self.dictionary)
