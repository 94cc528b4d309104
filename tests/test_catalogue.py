"""The registered queries against their SQL, and what must not be needed."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from facetloom import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def shown(value):
    return f"{value:.9g}" if isinstance(value, float) else value.isoformat() if hasattr(value, "isoformat") else str(value)


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(catalog.CATALOG))
def test_query_agrees_with_sql(spark, sql, name):
    query, text = catalog.CATALOG[name]
    df = query(spark, DATA)
    columns = sorted(df.columns)
    cursor = sql.execute(text)
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    wanted = sorted(tuple(shown(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert sorted(tuple(shown(r[c]) for c in columns) for r in df.collect()) == wanted


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_outside_imports_the_training_data_operators():
    code = "import sys; sys.modules['facetloom.llm'] = None; import __spark_entry__ as e; import facetloom.streaming.counts, facetloom.sources.interchange; assert 'eq_scalar' in e.queries() and e.oracle_sql(); assert not any(q.startswith('op') for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.abspath(entry.__file__)))
