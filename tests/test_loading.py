import datetime
import time

import pytest
from pyspark.sql import functions as F

from data import EXAMPLE, EXAMPLE_TSV
from graphloom.benchmark import StopWatch, run_batch
from graphloom.functions.objects import CODE, DATETIME, INTEGER, REAL, classify, constant, decoded
from graphloom.operators.dictionary import Dictionary, decode_triples, encode_triples, strings_of
from graphloom.operators.distribution import assign_greedy, assign_round_robin, collect_frequency, dump_columns, predicate_frequency, redistribute, route, route_random
from graphloom.sources.triples import Store, dump_csv, from_lexical, load_map, save_map
from graphloom.sources.tsv import FileList, fill_ids, number_rows, parse, read_tsv, rejected
from graphloom.streaming.load import append_to_store, triple_stream

D = datetime.datetime
FORMS = [
    ('"25"', INTEGER, 25), ("-3", INTEGER, -3), ('"1.5e3"', CODE, '"1.5e3"'), ("1.5e3", CODE, "1.5e3"), ("2.50e1", REAL, 25.0), ("3.", CODE, "3."), ("3.25", REAL, 3.25),
    ("1966-##-##", DATETIME, D(1966, 1, 1)), ("1966/02/03 10:11", DATETIME, D(1966, 2, 3, 10, 11)), ("1966-02-03 10:11:12", DATETIME, D(1966, 2, 3, 10, 11, 12)),
    ("1966-13-40", CODE, "1966-13-40"), ("<Japan>", CODE, "<Japan>"), ("", CODE, ""), ("99999999999999999999", CODE, "99999999999999999999"), ('"1966-##-##"', DATETIME, D(1966, 1, 1)), ("007", INTEGER, 7), ("1966-2-30", CODE, "1966-2-30"),
]


def _example(spark):
    return from_lexical(spark.createDataFrame(EXAMPLE, "tid string, s string, p string, o string"))


def test_typing(spark):
    # "1.5e3": a real has digits on both sides of the point, an exponent may follow.
    forms = [(f, REAL if f.strip('"') in ("1.5e3",) else t, 1500.0 if f.strip('"') == "1.5e3" else v) for f, t, v in FORMS]
    rows = from_lexical(spark.createDataFrame([("t", "s", "p", f) for f, _, _ in forms], "tid string, s string, p string, o string")).collect()
    for (form, kind, value), row in zip(forms, rows, strict=True):
        assert (row.oty, {INTEGER: row.o_int, REAL: row.o_real, DATETIME: row.o_ts}.get(row.oty, row.o)) == (kind, value), form
        assert classify(form) == (kind, value), form
    assert from_lexical(spark.createDataFrame([("t", "s", "p", None)], "tid string, s string, p string, o string")).first().oty == 0


def test_constants():
    assert constant("25", "code") == (CODE, "25") and constant("25", "integer") == (INTEGER, 25) and constant(2, "real") == (REAL, 2.0)
    assert constant("1970-01-01", "datetime") == (DATETIME, D(1970, 1, 1))
    with pytest.raises(ValueError):
        constant("x", "datetime")
    with pytest.raises(TypeError):
        classify(True)


def test_decoding(spark):
    rows = spark.createDataFrame([(3, "x", 2.5), (3, "x", 2.0), (3, "x", 1.23456), (3, "x", -10.1), (1, "abc", None), (3, "x", 100.0)], "oty short, o string, r double")
    assert [r[0] for r in rows.select(decoded(F.col("oty"), F.col("o"), F.col("r"))).collect()] == ["2.5", "2.0", "1.2346", "-10.1", "abc", "100.0"]


def test_tokeniser(spark, tmp_path):
    lines = ['\t<Northwood_University-West_Baden>\t<wasCreatedOnDate>\t"1966-##-##"^^xsd:date\t1966.0000', "<id_1>\t<a>\t\t<b>\t<c>", "", "<id_2>\t<a>\t<b>", "<id>\t<s>\t<p>\tlit^^a^^b\r"]
    (tmp_path / "a.tsv").write_text("\n".join(lines) + "\n")
    got = read_tsv(spark, str(tmp_path / "a.tsv")).collect()
    assert [tuple(r) for r in got] == [(None, "<Northwood_University-West_Baden>", "<wasCreatedOnDate>", '"1966-##-##"'), ("<id_1>", "<a>", "<b>", "<c>"), ("<id>", "<s>", "<p>", "lit")]
    assert [r.line for r in rejected(parse(spark.read.text(str(tmp_path / "a.tsv")))).collect()] == ["<id_2>\t<a>\t<b>"]
    files = FileList(str(tmp_path / "a.tsv")).add(str(tmp_path / "a.tsv"), "b").remove("b")
    assert files.read(spark).count() == 3 and files.clear().paths == []


def test_ids(spark):
    rows = spark.createDataFrame([(None, f"s{i}", "p", "o") if i % 3 else (f"t{i}", f"s{i}", "p", "o") for i in range(20)], "tid string, s string, p string, o string").repartition(3)
    got = sorted(r.tid for r in fill_ids(rows).collect())
    assert got == sorted([f"<triple_id_{i:012d}>" for i in range(13)] + [f"t{i}" for i in range(0, 20, 3)])
    assert sorted(r.n for r in number_rows(spark.range(0, 100, 1, 7).where("id % 5 <> 0"), "n", 10).collect()) == list(range(10, 90))
    assert number_rows(spark.range(0), "n").count() == 0


def test_dictionary(spark):
    d, one = Dictionary.empty(spark).get_id("a")
    d, two = d.get_id("b")
    d, again = d.get_id("a")
    assert (one, two, again, d.size()) == (1, 2, 1, 2)
    d = d.append(spark.createDataFrame([("c",), ("a",), (None,), ("c",), ("d",)], "str string"))
    assert {r["str"]: r.id for r in d.entries.collect()} == {"a": 1, "b": 2, "c": 3, "d": 4}
    assert d.find("c") == 3 and d.find("x") is None and d.find_string(4) == "d" and d.find_string(9) is None
    d = d.delete(spark.createDataFrame([(4,)], "id long"))
    d, new = d.get_id("d")
    assert new == 5 and d.size() == 4


def test_encoding_round_trip(spark):
    lexical = [*EXAMPLE, ("x1", "a", "born", "1966-02-03 10:11:12"), ("x2", "a", "height", "1.75"), ("x3", "a", "none", None)]
    t = from_lexical(spark.createDataFrame(lexical, "tid string, s string, p string, o string"))
    d = Dictionary.empty(spark).append(strings_of(t))
    e = encode_triples(t, d)
    assert sorted(decode_triples(e, d).collect(), key=str) == sorted(t.collect(), key=str)
    born = e.where("oty = 4").first()
    assert born.o == 62_038_793_472 or born.o == int((D(1966, 2, 3, 10, 11, 12) - D(1970, 1, 1)).total_seconds()) + 62_167_219_200
    real = e.where("oty = 3").first()
    assert (real.o, real.orl) == (0, 1.75)


def test_distribution(spark, tmp_path):
    t = _example(spark)
    freq = collect_frequency(predicate_frequency(t))
    assert freq == {"type": 21, "isLocatedIn": 12, "worksAt": 9, "livesIn": 7, "age": 7, "graduatedFrom": 6, "hasCapital": 2}
    greedy = assign_greedy(freq, 3)
    loads = [sum(freq[p] for p, c in greedy.items() if c == k) for k in (1, 2, 3)]
    assert set(greedy) == set(freq) and sum(loads) == 64 and sorted(loads) == [21, 21, 22]
    assert assign_round_robin(freq, 3) == {"type": 1, "isLocatedIn": 2, "worksAt": 3, "age": 1, "livesIn": 2, "graduatedFrom": 3, "hasCapital": 1}
    known = {p: c for p, c in greedy.items() if p != "age"}
    routed, refused = route(t, known)
    assert routed.count() == 57 and refused.count() == 7
    dump_columns(routed, str(tmp_path / "dump"))
    back = spark.read.option("sep", "\t").csv(str(tmp_path / "dump"))
    assert back.groupBy("clm").count().count() == 3 and back.count() == 57
    redistribute(t, assign_round_robin(freq, 2), str(tmp_path / "again"))
    assert {r.clm: r["count"] for r in spark.read.option("sep", "\t").csv(str(tmp_path / "again")).groupBy("clm").count().collect()} == {1: 39, 2: 25}
    a, b = (sorted(route_random(t, 4).collect()) for _ in range(2))
    assert a == b and {r.clm for r in a} <= {1, 2, 3, 4}
    with pytest.raises(ValueError):
        collect_frequency(predicate_frequency(t), 3)
    save_map(spark, freq, str(tmp_path / "map"))
    assert load_map(spark, str(tmp_path / "map")) == freq
    dump_csv(t, str(tmp_path / "csv"))
    assert spark.read.option("sep", "\t").csv(str(tmp_path / "csv")).count() == 64


def test_stream_equals_batch(spark, tmp_path):
    lines = EXAMPLE_TSV.splitlines()
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.tsv").write_text("\n".join(lines[:40]) + "\n")
    store, mark = str(tmp_path / "store"), str(tmp_path / "mark")
    append_to_store(triple_stream(spark, str(source), 1), store, mark).awaitTermination()
    (source / "b.tsv").write_text("\n".join(lines[40:]) + "\n\tx\ty\tz\n")
    append_to_store(triple_stream(spark, str(source), 1), store, mark).awaitTermination()
    got = Store(spark, store).all()
    assert {r.batch for r in spark.read.parquet(store).select("batch").distinct().collect()} == {0, 1}
    assert sorted(r for r in got.where("s <> 'x'").collect()) == sorted(_example(spark).select(got.columns).collect())
    assert got.where("s = 'x'").first().tid == "<triple_id_1_000000000000>"


def test_timing():
    report = run_batch({"a": lambda: 3, "b": lambda: 4, "c": lambda: 5})
    assert [t.results for t in report.timings] == [3, 4, 5] and report.total >= report.average
    ticks = iter([0.0, 1.0, 4.0])
    watch = StopWatch(lambda: next(ticks))
    watch.lap("x")
    watch.lap("y")
    assert watch.report() == [("x", 1.0, 1.0), ("y", 4.0, 3.0)]
    assert "middle average" in report.text() and run_batch({}).average == 0.0


@pytest.mark.parametrize("algorithm", ["predicate_based", "predicate_based_p", "random"])
def test_loader(spark, tmp_path, algorithm):
    from graphloom.engine import Engine
    from graphloom.loader import Loader

    source = tmp_path / "in.tsv"
    source.write_text(EXAMPLE_TSV + "\n")
    loader = Loader(spark, 3, algorithm)
    loader.files.add(str(source))
    loader.investigate()
    assert sum(loader.pred_freq.values()) == 64
    loader.save_maps(str(tmp_path / "maps"))
    again = Loader(spark, 3, algorithm)
    again.load_maps(str(tmp_path / "maps"))
    assert (again.pred_freq, again.pred_clm) == (loader.pred_freq, loader.pred_clm)
    (tmp_path / "more.tsv").write_text("x1\ta\tunseen\tb\n")
    loader.files.add(str(tmp_path / "more.tsv"))
    refused = loader.distribute(str(tmp_path / "dump"))
    assert (refused.count() if refused is not None else 0) == (0 if algorithm == "random" else 1)
    assert spark.read.option("sep", "\t").csv(str(tmp_path / "dump")).count() == (65 if algorithm == "random" else 64)
    store = loader.store(str(tmp_path / "store"), 4)
    assert Engine(store).execute('{join, {tp, {"[]", "?x", "livesIn", "ljubljana"}, none, none}, {tp, {"[]", "?x", "age", "?y"}, {"?y", less, 30}, none}, none, none}').bindings("?x").collect() == [("nika",)]
    d = loader.encode(str(tmp_path / "enc"))
    assert spark.read.parquet(str(tmp_path / "enc/triples")).count() == 65 and d.find("nika") is not None
    assert sorted(Engine(loader.encoded(str(tmp_path / "enc"))).execute('{tp, {"[]", "?x", "livesIn", "ljubljana"}, none, none}').bindings("?x").collect()) == [("luka",), ("marko",), ("nika",)]
    assert loader.encode(str(tmp_path / "enc2"), d).last == d.last
    loader.dump(str(tmp_path / "store"), str(tmp_path / "text"))
    assert spark.read.text(str(tmp_path / "text")).count() == 65
    with pytest.raises(ValueError):
        Loader(spark, 3, "other")


def test_parts_follow_the_rows(spark, tmp_path, monkeypatch):
    """A task of the store's writer sorts a given number of rows, however few partitions a shuffle has or adaptive execution makes."""
    from graphloom.sources import stored, triples
    from graphloom.sources.stored import tasks_for

    assert [tasks_for(n) for n in (0, 1, 250_001, 50_000_000, 329_000_000, 1_000_000_000)] == [1, 1, 2, 200, 200, 500]
    monkeypatch.setattr(stored, "TASK_ROWS", 1000)
    rows = from_lexical(spark.range(20_000).selectExpr("concat('t', id) tid", "concat('s', id) s", "'p' p", "string(id) o"))
    triples.write_store(rows, str(tmp_path / "store"))
    sizes = [r[0] for r in spark.read.parquet(str(tmp_path / "store")).groupBy(F.input_file_name()).count().select("count").collect()]
    assert sum(sizes) == 20_000 and len(sizes) >= 18 and max(sizes) < 2500
    assert sorted(Store(spark, str(tmp_path / "store")).all().collect()) == sorted(rows.collect())


def test_encoding_spreads_frequent_values(spark, monkeypatch):
    """Neither objects without a string nor a string that half the triples share make one task's work, to and fro."""
    from graphloom.sources import stored

    monkeypatch.setattr(stored, "TASK_ROWS", 1000)
    rows = from_lexical(spark.range(12_000).selectExpr("concat('t', id) tid", "concat('s', id % 6000) s", "if(id % 2 = 0, 'p', 'q') p", "if(id % 2 = 0, 'hub', string(id)) o"))
    most = lambda frame: frame.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    d = Dictionary.empty(spark).append(strings_of(rows))
    assert d.size() == d.last == 18_003 and d.entries.orderBy("id").select("str").collect() == d.entries.orderBy("str").select("str").collect()
    e = encode_triples(rows, d)
    back = decode_triples(e, d)
    assert sorted(back.collect()) == sorted(rows.collect())
    assert most(e) < 2400 and most(back) < 2400


def _shuffle_bytes(spark):
    """What shuffles have left on disk."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).length() for i in range(files.size()) if "shuffle_" in files.apply(i).getName())


def test_round_trip_in_slices_leaves_little_on_disk(spark, monkeypatch):
    """Many rows are encoded and decoded a slice after another; neither shuffles nor tables that no step needs any more stay on disk."""
    from graphloom.sources import stored

    text = "if(id % 4 = 0, 'hub', if(id % 4 = 1, concat('s', id % 6000), if(id % 4 = 2, string(id), null)))"
    rows = from_lexical(spark.range(40_000).selectExpr("if(id % 1000 = 7, null, concat('t', id)) tid", "concat('s', id % 6000) s", "if(id % 2 = 0, 'p', 'q') p", f"{text} o"))
    whole = Dictionary.empty(spark).append(strings_of(rows))
    known = Dictionary(whole.entries.where("id % 100 <> 0 OR str IN ('p', 'q')"), whole.last)  # some strings have no id
    want = sorted(encode_triples(rows, known).collect(), key=str)
    monkeypatch.setattr(stored, "TASK_ROWS", 2000, raising=False)
    monkeypatch.setattr(stored, "SLICE_ROWS", 15_000, raising=False)
    assert sorted(encode_triples(rows, known).collect(), key=str) == want
    before, tables = _shuffle_bytes(spark), len(stored._written)
    d = Dictionary.empty(spark).append(strings_of(rows))
    e = encode_triples(rows, d)
    back = decode_triples(e, d)
    assert sorted(back.collect(), key=str) == sorted(rows.collect(), key=str)
    assert sorted(d.entries.collect()) == sorted(whole.entries.collect())
    # The dictionary, the predicates' entries twice, the encoded and the decoded triples.
    assert len(stored._written) - tables <= 5
    for _ in range(50):
        left = _shuffle_bytes(spark) - before
        if left < 300_000:
            break
        time.sleep(0.1)
    assert left < 300_000


def test_slices_read_every_value_once(spark):
    """The slices of a column have all its values, whatever was drawn, and the same of the dictionary."""
    from graphloom.operators import dictionary

    rows = spark.range(1000).selectExpr("concat('v', id) v", "id n")
    entries = spark.range(1000).selectExpr("id", "concat('v', id) str")
    for column, key, values in (("v", "str", ["v0", "v5", "v999"]), ("n", "id", [0, 500, 999]), ("v", "str", [])):
        parts = [rows.where(dictionary._between(column, values, i)) for i in range(len(values) + 1)]
        others = [entries.where(dictionary._between(key, values, i)) for i in range(len(values) + 1)]
        assert sum(p.count() for p in parts) == 1000
        assert [sorted(r[0] for r in p.select(column).collect()) for p in parts] == [sorted(r[0] for r in x.select(key).collect()) for x in others]
