import re

import duckdb
import pytest

import corpus_pipeline
from llm_fixtures import SF
from tallyline.llm.oracle import ORACLE_SQL
from tallyline.llm.queries import QUERIES

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_twin(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    expected = con.execute(ORACLE_SQL[name]).df()
    found = QUERIES[name](spark, SF).toPandas()
    columns = sorted(expected.columns)
    assert sorted(found.columns) == columns
    a, b = (x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (found, expected))
    assert a.equals(b)


def test_each_operator_once():
    numbers = [int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES]
    assert sorted(numbers) == list(range(1, 14))


def test_pipeline(spark):
    """Stages keep the documents' columns; every step only takes away what it should."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF).cache()
        assert after.columns == docs.columns and after.dtypes == docs.dtypes
        kept, had = ({r[0] for r in x.select("doc_id").collect()} for x in (after, before))
        assert kept <= had and (name != "mixing" or kept == had)
        before = after
    found = corpus_pipeline.run(spark, SF)
    assert found.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    total = found.agg({"n_tokens": "sum"}).first()[0]
    last = found.orderBy("start", ascending=False).first()
    assert last["start"] + last["n_tokens"] == total


def test_mix_has_every_domain_of_the_labels(spark):
    from tallyline.llm.mixing import quality_domains
    from tallyline.llm.queries import MIX

    domains = quality_domains(spark.read.parquet(f"{SF}/labels.parquet")).select("domain").distinct().collect()
    assert {r["domain"] for r in domains} == set(MIX) and MIX["toxic"] == 0
