import os

import pytest

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_stages(spark):
    import corpus_pipeline as c
    from graphloom.llm import boosting, passages, pii, simhash

    assert [n for n, _ in c.STAGES] == ["quality classifier", "SimHash near-dedup", "substring dedup", "PII", "packing"]
    docs = c.table(spark, FOLDER, "documents")
    labels = c.table(spark, FOLDER, "labels")
    ids = lambda d: sorted(r.doc_id for r in d.select("doc_id").collect())

    good = c.frozen(c.quality(spark, docs, FOLDER))
    scored = {r.doc_id: r.predicted for r in boosting.classify(docs, labels).collect()}
    assert ids(good) == sorted(i for i, p in scored.items() if p)
    one = c.frozen(c.near_duplicates(spark, good, FOLDER))
    assert ids(one) == sorted({r.component for r in simhash.near_duplicates(good).collect()})
    cut = c.frozen(c.passages(spark, one, FOLDER))
    removed = {r.doc_id: r.n_words - r.n_removed for r in passages.digest(one).collect()}
    assert {r.doc_id: len((r.text or "").split()) for r in cut.collect()} == removed
    clean = c.frozen(c.private_data(spark, cut, FOLDER))
    assert all(r.base == "" for r in pii.find_pii(clean).collect())
    for d in (good, one, cut, clean):
        assert tuple(d.columns) == c.COLUMNS
        assert all(r.n_chars == len(r.text or "") for r in d.collect())
    packed = c.packing(spark, clean, FOLDER).collect()
    assert {r.doc_id for r in packed} == set(ids(clean))
    total = {r.doc_id: r.doc_tokens for r in packed}
    assert sum(r.length for r in packed) == sum(total.values())
    assert sum(r.doc_tokens for r in c.run(spark, FOLDER).dropDuplicates(["doc_id"]).collect()) == sum(total.values())


def test_sql(spark):
    import duckdb

    from graphloom.llm.queries import oracle_sql, queries

    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    for name, sql in oracle_sql().items():
        got = queries()[name](spark, FOLDER)
        want = con.sql(sql)
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want.select(*(duckdb.ColumnExpression(c) for c in columns)).fetchall())
