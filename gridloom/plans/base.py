"""The decorator that registers queries, and SQL views of the inputs that the queries derive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import PALETTE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

PX = """px AS (SELECT *, v AS r, 255 - v AS g, v * 3 % 256 AS b, CASE WHEN v < 96 THEN 0 ELSE 255 END AS a FROM (
  SELECT vec_id AS grid_id, (i - 1)::INT AS idx, ((i - 1) % 8)::INT AS x, ((i - 1) // 8)::INT AS y,
         greatest(0, least(255, floor((embedding[i]::DOUBLE + 0.5) * 255 + 0.5)))::INT AS v
  FROM embeddings, unnest(range(1, 65)) AS t(i)))"""
CELLS = PX + ", cells AS (SELECT grid_id, idx, x, y, CASE WHEN v >= 96 THEN 'k' || (v - 96) // 24 END AS color FROM px)"
PAL = "pal(pos, id, code, r, g, b) AS (VALUES " + ", ".join(str(p) for p in PALETTE) + ")"
PC = "pc AS (SELECT 'p' || p_partkey AS id, (p_partkey * 37 % 256)::INT AS r, (p_size * 5 % 256)::INT AS g, ((p_partkey * p_size + 31) % 256)::INT AS b FROM part)"
BOTH = f"{PAL}, {PC}, pp AS (SELECT id, r, g, b FROM pc UNION ALL SELECT id, r, g, b FROM pal)"
LAYERS = """layers AS (SELECT *, z % 4 <> 0 AS visible, CASE WHEN z % 5 <> 0 THEN 1 ELSE 0 END AS opacity, z % 3 = 0 AS locked, z <> 2 AS in_usage
  FROM (SELECT l_orderkey AS cell, l_linenumber::INT AS z, max(CASE WHEN l_discount <> 0 THEN l_returnflag || l_linestatus END) AS color FROM lineitem GROUP BY 1, 2))"""


def linear(c: str) -> str:
    return f"(CASE WHEN ({c}) / 255.0::DOUBLE <= 0.04045 THEN ({c}) / 255.0::DOUBLE / 12.92 ELSE pow((({c}) / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END)"


def lab(relation: str, columns: str, name: str) -> str:
    """CTEs that add ok_l, ok_a, ok_b to a relation's bytes r, g, b."""
    return f"""{name}_lin AS (SELECT {columns}, {linear('r')} AS lr, {linear('g')} AS lg, {linear('b')} AS lb FROM {relation}), {lab_of_linear(name + '_lin', columns, name)}"""


def lab_of_linear(relation: str, columns: str, name: str) -> str:
    return f"""{name}_lms AS (SELECT {columns}, cbrt(0.4122214708 * lr + 0.5363325363 * lg + 0.0514459929 * lb) AS l_,
    cbrt(0.2119034982 * lr + 0.6806995451 * lg + 0.1073969566 * lb) AS m_, cbrt(0.0883024619 * lr + 0.2817188376 * lg + 0.6299787005 * lb) AS s_ FROM {relation}),
  {name} AS (SELECT {columns}, 0.2104542553 * l_ + 0.793617785 * m_ - 0.0040720468 * s_ AS ok_l, 1.9779984951 * l_ - 2.428592205 * m_ + 0.4505937099 * s_ AS ok_a,
    0.0259040371 * l_ + 0.7827717662 * m_ - 0.808675766 * s_ AS ok_b FROM {name}_lms)"""


def redmean(p: str, q: str) -> str:
    m = f"(({p}.r + {q}.r) / 2.0::DOUBLE)"
    return f"sqrt((2 + {m} / 256) * ({p}.r - {q}.r) ** 2 + 4 * ({p}.g - {q}.g) ** 2 + (2 + (255 - {m}) / 256) * ({p}.b - {q}.b) ** 2)"


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with the SQL that must give the same rows."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register
