"""Every registered query on the smallest tables, against its SQL where it has one."""

import os

import duckdb
import pytest

import __spark_entry__
from notewright.plans import notes, training

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
NAMES = sorted(training.QUERIES | notes.QUERIES)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from read_parquet('{SF}/{f}')")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple("~" if r[k] is None else f"{r[k]:.6f}" if isinstance(r[k], float) else str(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF)
    got = df.collect()
    sql = __spark_entry__.oracle_sql().get(name)
    if sql is not None:
        rel = duck.execute(sql)
        columns = [d[0] for d in rel.description]
        assert sorted(columns) == sorted(df.columns)
        assert _rows(df.columns, got) == _rows(columns, rel.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_the_core_never_names_the_optional_part():
    base = os.path.dirname(os.path.dirname(os.path.abspath(notes.__file__)))
    for folder, _, names in os.walk(base):
        if "/llm" in folder:
            continue
        for n in names:
            if n.endswith(".py"):
                assert "notewright.llm" not in open(os.path.join(folder, n)).read(), n
