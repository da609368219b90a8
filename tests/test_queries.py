"""Every registered query of the library against DuckDB on the smallest tables."""

import duckdb
import pytest

from docassay.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rounded(row):
    return tuple(round(x, 6) if isinstance(x, float) else x for x in row)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.execute(registry.oracle_sql()[name])
    order = [[c[0] for c in found.description].index(c) for c in columns]
    want = sorted((rounded(r[k] for k in order) for r in found.fetchall()), key=str)
    assert sorted((rounded(r) for r in df.select(*columns).collect()), key=str) == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs_without_sql(spark, name):
    df = registry.queries()[name](spark, SF)
    assert df.count() > 0


def test_the_rest_needs_no_llm():
    import pathlib
    import re

    for path in pathlib.Path("docassay").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"docassay\.llm|corpus_pipeline", path.read_text()), path
