import duckdb
import pytest

import __spark_entry__ as entry
from gridols.jobs import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    return sorted(repr(tuple(None if v != v else v for v in r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, sql, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = sql.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() == 64


def test_every_query_has_sql():
    assert set(registry.SQL) == set(registry.QUERIES)


def test_only_the_entry_knows_the_training_data_operations():
    from pathlib import Path

    for p in Path(registry.__file__).parent.parent.rglob("*.py"):
        if "llm" not in p.parts:
            assert "gridols.llm" not in p.read_text()
