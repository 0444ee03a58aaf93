"""Driver contract and the SQL oracle over the whole catalogue (sf0.001)."""

import importlib.util
import os

import pytest

from gatewatch.plans.registry import all_queries
from gatewatch.testing import compare, duck, type_mismatches

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"
SLOW = {"forest_fit_score", "fedavg_merge", "stream_score"}


def _entry():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def test_contract(spark):
    m = _entry()
    df = m.entry(spark)
    assert df.count() > 0
    qs, sql = m.queries(), m.oracle_sql()
    assert set(sql) <= set(qs) and len(qs) >= 60


@pytest.mark.parametrize("name", sorted(n for n, q in all_queries().items() if q.sql))
def test_oracle(spark, name):
    q = all_queries()[name]
    df = q.build(spark, SF)
    rel = duck(SF).sql(q.sql)
    assert type_mismatches(df.dtypes, rel) == []
    assert compare(df.toPandas(), rel.df()) == []


@pytest.mark.parametrize("name", sorted(n for n, q in all_queries().items() if not q.sql and n not in SLOW))
def test_rows_only(spark, name):
    assert all_queries()[name].build(spark, SF).count() > 0
