"""The pipeline's stages, and every registered query against its oracle."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from compare import difference
from leadloom.llm import queries
from test_ngram_join import plain_kept

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, FOLDER)
    if name in queries.ORACLES:
        assert difference(df, queries.ORACLES[name], FOLDER) is None
    else:
        assert df.count()


def test_registered():
    names = set(entry.queries())
    assert set(queries.QUERIES) | {"pipeline"} <= names and set(queries.ORACLES) <= set(entry.oracle_sql())
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, FOLDER).checkpoint()
        assert after.columns == docs.columns, name
        assert after.exceptAll(before).isEmpty() if name != "mixing" else after.distinct().exceptAll(before).isEmpty()
        if name == "near duplicates":
            want = plain_kept([(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()])
            assert sorted(r.doc_id for r in after.collect()) == want
        before = after
    rows = corpus_pipeline.token_stage(spark, before, FOLDER).collect()
    texts = {r.doc_id: r.text for r in before.collect()}
    assert len(rows) == before.count() > 100
    for r in rows[:40]:
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode(texts[r.doc_id], add_special_tokens=False).ids


def test_run_reads_what_it_wrote(spark):
    df = corpus_pipeline.run(spark, FOLDER)
    assert "FileScan parquet" in df._jdf.queryExecution().executedPlan().toString()
    assert {"doc_id", "lang", "source", "n_chars", "ids", "n_tokens", "ids_sha256", "decoded_sha256"} == set(df.columns)
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    kept, given = (x.agg(F.avg("quality")).first()[0] for x in (df.join(labels, "doc_id"), labels))
    assert kept > given


def test_odd_documents(spark):
    good = spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id < 60")
    odd = spark.createDataFrame([(None, None, None, None, None), (1000, "", "en", "src0", 0), (1001, " ", None, None, 1), (1002, "12 34", "en", "src1", 5),
                                 (1003, "le chat et la souris " * 20_000, "fr", "src1", None)], good.schema)
    docs = good.unionByName(odd).unionByName(odd).unionByName(good.limit(5)).withColumns({"score": F.lit("x"), "ids": F.lit(1), "__spare": F.lit(None).cast("date")})
    # names that operators and stages use inside
    names = ["__id", "__hash", "__score", "__lang", "__source", "__copy", "__of", "__least", "__familiarity", "__kept_id", "__decoded", "node", "weight", "copies", "text_hash"]
    docs = docs.withColumns({n: F.lit(n) for n in names})
    for _, stage in corpus_pipeline.STAGES:
        kept = stage(spark, docs, FOLDER).checkpoint()
        assert kept.count() or _ == "none"
        docs = kept
    assert {"score", "ids", "__spare"} <= set(docs.columns)
    row = docs.first()
    assert all(row[n] == n for n in names)
    empty = good.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, FOLDER).count() == 0
