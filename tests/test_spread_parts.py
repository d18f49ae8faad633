"""A small file of parts becomes much work: it is dealt to several tasks, and cells of lines are told apart within a line."""

import pytest

from gridloom.functions import geometry as G
from gridloom.plans.registry import QUERIES


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("parts"))
    spark.createDataFrame([(k, k % 50 + 1) for k in range(300)], "p_partkey long, p_size int").coalesce(1).write.parquet(f"{folder}/part.parquet")
    return folder


@pytest.mark.parametrize("name", ["shape_line", "shape_outlines", "merge_candidates"])
def test_parts_are_dealt_to_all_tasks(spark, parts, name):
    assert QUERIES[name](spark, parts).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_cells_of_lines_are_not_gathered(spark, parts):
    plan = QUERIES["shape_line"](spark, parts)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate [id")  # read from the top: nothing is gathered once cells are there


def test_cells_of_one_key_are_distinct(spark):
    rows = [(1, 0, 0, 3, 0), (1, 2, 0, 5, 0), (1, 0, 0, 3, 0), (2, 4, 4, 4, 4)]
    got = G.line_cells(spark.createDataFrame(rows, "id long, x0 int, y0 int, x1 int, y1 int"), "id", "x0", "y0", "x1", "y1")
    assert sorted(map(tuple, got.collect())) == [(1, x, 0) for x in range(6)] + [(2, 4, 4)]
