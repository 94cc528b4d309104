"""The registered queries against their SQL."""

import os
import subprocess
import sys

import pytest

from facetloom.llm import registry


def shown(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_query_agrees_with_sql(spark, data, sql, name):
    df = registry.queries()[name](spark, data)
    columns = sorted(df.columns)
    cursor = sql.execute(registry.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    wanted = sorted(tuple(shown(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert sorted(tuple(shown(r[c]) for c in columns) for r in df.collect()) == wanted


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 11))


FAR = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.sql.warehouse.dir", {folder!r}).getOrCreate()
import __spark_entry__
for name in ("op1_quality", "op2_html_crf", "op3_simhash", "op6_lm_score", "op7_decontamination", "op10_suffix_dedup"):
    assert __spark_entry__.queries()[name](spark, {data!r}).collect(), name
"""


def test_executors_do_not_need_the_package(data, tmp_path):
    """Only the driver finds the package; its workers run elsewhere and get functions by value."""
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = FAR.format(repo=repo, folder=str(tmp_path / "warehouse"), data=data)
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-2000:]


def test_queries_can_be_listed_without_a_session():
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = "import __spark_entry__ as e; assert len([q for q in e.queries() if q.startswith('op')]) == 10 and 'pipeline' in e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=repo)
