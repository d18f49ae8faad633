"""Adjusted colours against their SQL, over all colours that parts can have."""

import duckdb

from gridloom.plans.registry import QUERIES, SQL


def test_all_part_colors(spark, tmp_path):
    rows = [(k + 256 * s, s) for k in range(256) for s in range(1, 51)]
    spark.createDataFrame(rows, "p_partkey long, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    got = sorted(tuple(r) for r in QUERIES["adjust_colors"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    want = sorted(con.sql(SQL["adjust_colors"]).fetchall())
    assert len(got) == 12_800 and [(a, b) for a, b in zip(got, want, strict=True) if a != b] == []
