"""Every registered query of the subpackage on the smallest tables, against its SQL where it has one."""

import os

import duckdb
import pytest

from notewright.llm import plans

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple("~" if r[k] is None else str(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, name):
    df = plans.QUERIES[name](spark, SF)
    got = df.collect()
    if name in plans.SQL:
        con = duckdb.connect()
        for f in os.listdir(SF):
            con.execute(f"create view {f[:-8]} as select * from read_parquet('{SF}/{f}')")
        rel = con.execute(plans.SQL[name])
        columns = [d[0] for d in rel.description]
        assert sorted(columns) == sorted(df.columns) and _rows(df.columns, got) == _rows(columns, rel.fetchall())


def test_found_queries_have_the_columns_asked_for(spark):
    want = {"p1_found": ["mention_id", "canonical"], "p3_found": ["source_table", "record_id", "elem_kind", "elem_no"], "p4_found": ["entity_type", "canonical", "mark"], "p6_found": ["doc_id", "item_id"], "p8_found": ["doc_id"]}
    assert {n: plans.QUERIES[n](spark, SF).columns for n in want} == want
