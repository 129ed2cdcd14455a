"""Every query against its SQL, and a row check for the rest."""

import datetime
import decimal
import math

import duckdb
import pytest

from lagloom import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float | decimal.Decimal):
        v = float(v)
        return "nan" if math.isnan(v) else f"{v:.6g}" if v else "0"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, sf_dir, name):
    df = registry.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    assert got or name == "drop_sparse_nodes", "no rows"  # on the smallest tables every node is too sparse
    if name in SQL:
        rel = con.execute(SQL[name])
        names = [d[0] for d in rel.description]
        assert sorted(names) == cols
        want = sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in rel.fetchall())
        assert got == want
