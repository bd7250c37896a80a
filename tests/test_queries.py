"""Every query with a SQL twin gives the twin's rows on the smallest tables."""

import math

import duckdb
import pytest

from ledgerline import registry

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return str(v)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_rows_match_sql(spark, db, name):
    df = registry.queries()[name](spark, D)
    cols = sorted(df.columns)
    got = sorted("|".join(shown(r[c]) for c in cols) for r in df.collect())
    r = db.execute(registry.oracle_sql()[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    want = sorted("|".join(shown(row[names.index(c)]) for c in cols) for row in r.fetchall())
    assert got == want


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
