"""Every query with SQL against that SQL, run by DuckDB on the same files."""

import duckdb
import pytest

from docweave.plans import oracles, queries

TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def test_every_query_has_sql_or_a_reason():
    assert set(queries.QUERIES) == set(oracles.ORACLE)


@pytest.mark.parametrize("name", sorted(oracles.ORACLE))
def test_equals_sql(spark, sf, duck, name):
    df = queries.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    done = duck.execute(oracles.ORACLE[name])
    names = [d[0] for d in done.description]
    assert sorted(names) == columns
    rows = lambda found: sorted(tuple(map(str, r)) for r in found)
    want = rows([r[names.index(c)] for c in columns] for r in done.fetchall())
    assert rows(map(tuple, df.select(*columns).collect())) == want
