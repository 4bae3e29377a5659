"""The registered queries against their SQL, and the pipeline against a plain version, on the smallest tables."""

import os

import duckdb
import pytest

import corpus_pipeline
from conftest import SF
from test_queries import canon
from waymark.llm import exact, pii, quality, registry
from waymark.llm.jaccard import classes


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    if name not in registry.SQL:
        assert got.count() >= 200
        return
    want = duck.sql(registry.SQL[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()]
    assert canon([r.asDict() for r in got.collect()], columns) == canon(rows, columns)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = {r.doc_id: r.text for r in docs.collect()}
    ids = list(rows)
    good = [i for i, s in zip(ids, model.scores([rows[i] or "" for i in ids]), strict=True) if s >= 0.3]
    last = {}
    for i in good:
        key = "".join(c.lower() if "A" <= c <= "Z" else c for c in rows[i] or "")
        last[key] = max(i, last.get(key, i))
    left = docs.filter(docs.doc_id.isin(list(last.values())))
    first = {r.doc_id for r in classes(left, 80, 5).filter("doc_id = component_id").collect()}
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in out} == first
    assert len(corpus_pipeline.STAGES) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(30), SF).columns == docs.columns
    assert exact.drop_copies(docs.limit(0)).count() == 0 and pii.redact(docs.limit(0), pii.train(docs.limit(0))).count() == 0


def test_pipeline_odd_tables(spark, tmp_path):
    """Null and empty texts, repeated and null ids, a long text and columns with the names of our own go through all stages; so does no row."""
    good = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1"), "doc_id").limit(12).collect()]
    rows = [(i, t, "en", "s", 0, 1, "x", 2.5) for i, t in enumerate(good)]
    rows += [(3, good[3], "en", "s", 0, 2, "y", 1.5), (4, good[5], "en", "s", 0, 1, "x", 0.5), (None, good[6], None, None, None, None, None, None), (20, None, "en", "s", 0, 1, "x", 1.0)]
    rows += [(21, "", "en", "s", 0, 1, "x", 1.0), (22, good[7] * 200, "en", "s", 0, 1, "x", 1.0), (23, good[8].swapcase().lower(), "en", "s", 0, 1, "x", 1.0)]
    kind = "doc_id bigint, text string, lang string, source string, n_chars int, _score int, _sha string, _slot double"
    docs = spark.createDataFrame(rows, kind)
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "a/labels.parquet"))
    docs.write.parquet(str(tmp_path / "a/documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path / "a"))
        assert out.columns == docs.columns and out.count() > 0
    whole = corpus_pipeline.run(spark, str(tmp_path / "a")).collect()
    assert whole and max(r.offset + r.length for r in whole) <= 2048
    docs.limit(0).write.parquet(str(tmp_path / "b/documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "b/labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "b")).collect() == []
