import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from wayloom.llm import decontam, jaccard, pipeline, queries, secrets, toxicity

SMALL = "/root/testdata/sf0.001"


def rows(df, order):
    return sorted((tuple(str(r[c]) for c in order) for r in df.collect()))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    cur = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in cur.description]
    want = sorted(tuple(map(str, r)) for r in cur.fetchall())
    got = queries.QUERIES[name](spark, SMALL)
    assert sorted(columns) == sorted(got.columns) and rows(got, columns) == want


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = pipeline.toxic_out(spark, docs, SMALL).cache()
    model = toxicity.train(docs, spark.read.parquet(f"{SMALL}/labels.parquet"), ~toxicity.held_out("doc_id", 0, 5))
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model, ["doc_id"]).collect()}
    assert {r["doc_id"] for r in kept.collect()} == {k for k, v in scores.items() if v < 0.5}

    single = pipeline.near_out(spark, kept, SMALL).cache()
    member = jaccard.jaccard_join(kept)[0].collect()
    assert {r["doc_id"] for r in single.collect()} == {r["component_id"] for r in member}

    benchmark = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    free = pipeline.leaks_out(spark, single, SMALL).cache()
    clean = {r["doc_id"] for r in decontam.decontaminate(single, benchmark).filter("not contaminated").collect()}
    assert {r["doc_id"] for r in free.collect()} == clean

    safe = pipeline.secrets_out(spark, free, SMALL).cache()
    assert all(d.columns == docs.columns for d in (kept, single, free, safe))
    before = {r["doc_id"]: r["n_assign"] + r["n_access"] + r["n_hex"] for r in secrets.scan(free).collect()}
    after = secrets.scan(safe).filter("n_assign + n_access + n_hex > 0")
    assert safe.count() == free.count() and after.isEmpty()
    texts = {r["doc_id"]: r["text"] for r in free.collect()}
    assert all((texts[r["doc_id"]] == r["text"]) == (before[r["doc_id"]] == 0) for r in safe.collect())
    assert safe.filter(F.col("n_chars") != F.length("text")).isEmpty()

    last = pipeline.tokens(spark, safe, SMALL)
    whole = pipeline.run(spark, SMALL, pipeline.STAGES)
    assert rows(whole, last.columns) == rows(last, last.columns)


def test_stages_on_odd_tables(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, spans string, score double"
    odd = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "same words in here again and again", "en", "s", 34), (4, "same words in here again and again", "en", "s", 34), (4, "same words in here again and again", "en", "s", 34), (None, "same words in here again and again", "en", "s", 34), (5, "token = abcdefgh", "en", "s", 16)]
    docs = spark.createDataFrame([(*r, "k", "s", 1.0) for r in odd], schema)
    for d in (docs, docs.limit(0)):
        for _, stage in pipeline.STAGES:
            d = stage(spark, d, SMALL)
            assert d.count() >= 0
    got = pipeline.near_out(spark, docs, SMALL)
    assert sorted(str(r["doc_id"]) for r in got.collect()) == ["1", "2", "3", "5", "None"]
    text = {r["doc_id"]: (r["text"], r["n_chars"]) for r in pipeline.secrets_out(spark, docs.filter("doc_id = 5"), SMALL).collect()}
    assert text == {5: ("[secret]", 8)}
