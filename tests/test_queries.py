"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from gridloom.plans.registry import QUERIES, SQL

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return repr(float(v)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    rel = duck.execute(SQL[name])
    at = [d[0] for d in rel.description]
    assert sorted(at) == columns
    want = sorted(tuple(norm(r[at.index(c)]) for c in columns) for r in rel.fetchall())
    assert got == want


#: Queries that label regions run one grid a time in Python.
REGIONS = ("components", "color_components", "diagonal_components", "flood_region", "background_flood", "component_descriptors", "energy_terms",
           "grid_holes", "structure_errors", "region_evidence", "pair_reliability", "evidence_again")
#: Folds whose every step depends on the one before.
FOLDS = ("undo_redo",)
NATIVE = [n for n in SQL if n not in REGIONS + FOLDS]


@pytest.mark.parametrize("name", sorted(NATIVE)[::6])
def test_native_queries_run_no_python(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroups", "MapInPandas", "MapInArrow"))
