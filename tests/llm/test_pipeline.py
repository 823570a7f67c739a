import duckdb
import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from meshlens.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.staged(stage(spark, docs, SF), "test")
        counts.append(docs.count())
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
    assert len(corpus_pipeline.STAGES) == 5 and counts[0] > counts[1] > counts[2] >= counts[3] > 0 and counts[5] == counts[4]
    ids = [r[0] for r in docs.select("doc_id").collect()]
    assert max(map(ids.count, set(ids))) <= 2


def test_stages_on_odd_rows(spark):
    """Null ids, texts, sources and languages, repeated rows and ids, a text of a megabyte, and a further column of a stage's own name."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    long = " ".join(f"word{k % 4999} of {k % 37}" for k in range(100_000))
    odd = [(None, None, None, None, None), (None, "no id " * 40, "en", None, 240), (7, None, "en", "s", None), (7, "the same id, another text " * 9, None, "s", 234), (8, "", "en", "s", 0), (8, "", "en", "s", 0), (9, long, "en", "s", len(long)), (9, long, "en", "s", len(long))]
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long").withColumn("n_chars", F.col("n_chars").cast(dict(docs.dtypes)["n_chars"]))).withColumn("_row", F.lit(1))
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.staged(stage(spark, docs, SF), "odd")
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns, name
            assert docs.filter("text is not null").count() > 10, name
    assert docs.count() > 10


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.staged(stage(spark, docs, SF), "empty")
        assert docs.count() == 0, name


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    found = con.execute(queries.SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    line = lambda row, cols: repr(tuple(row[cols.index(c)] for c in sorted(names)))
    assert sorted(line(tuple(r), df.columns) for r in df.collect()) == sorted(line(r, names) for r in found.fetchall())


def test_near_dedup_at_its_likeness(spark):
    words = [f"w{k}" for k in range(100)]
    near, far = [*words[:94], "x"], [*words[:70], "y"]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, d, "").collect()) == [1, 3]
