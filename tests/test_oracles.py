"""Every registered query of the media operators gives the rows of its SQL, and some."""

import duckdb
import pytest

from framehouse.plans import actions, catalog, ledger  # noqa: F401  (all register their queries with the catalog's)

DIR = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.fixture(scope="module", autouse=True)
def members_once():
    """Many queries begin with the same clusters: here they are made once."""
    made, plain = {}, catalog._members
    catalog._members = ledger._members = lambda spark, sf_dir: made.setdefault(sf_dir, None) or made.__setitem__(sf_dir, plain(spark, sf_dir)) or made[sf_dir]
    yield
    catalog._members = ledger._members = plain


def normal(x):
    return round(x, 6) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, db, name):
    got = catalog.QUERIES[name](spark, DIR)
    want = db.sql(catalog.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted((tuple(normal(r[c]) for c in columns) for r in got.collect()), key=repr)
    at = [want.columns.index(c) for c in columns]
    expected = sorted((tuple(normal(r[k]) for k in at) for r in want.fetchall()), key=repr)
    assert rows and len(rows) == len(expected)
    assert rows == expected
