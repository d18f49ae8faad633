"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _stars(directed: DataFrame) -> DataFrame:
    """(u, v, m): m is the smallest of u and its v; the minima are pre-aggregated and joined back, so a hot u can be split."""
    low = directed.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return directed.join(low, "u")


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 40) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b long); the component is the smallest node that can be reached.

    Edges stay in scratch tables throughout; each round is one table, so a lost executor repeats one round at most.
    Self loops and repeated edges don't matter; an empty table gives no rows.
    """
    now = scratch.table(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        # Small star: u with its smaller neighbours; all of them, and u, are hung below the smallest.
        small = _stars(large)
        small = small.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        last, now = now, scratch.table(small, "edges")
        scratch.drop(last)
        row = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (row.n, row.h) == state:
            break
        state = (row.n, row.h)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    rows = now.unionByName(now.select(F.col("v").alias("u"), "v"))
    return rows.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")


#: Up to so many edges (16 bytes each) one task joins them; more go through the rounds above.
ONE_TASK = 1_000_000


def joined(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) as ``connected_components`` gives it; a set of edges of checked size takes one task instead of many rounds."""
    if edges.count() > ONE_TASK:
        return connected_components(edges, scratch)

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        top: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := top.setdefault(x, x)) != x:
                top[x] = x = top[up]
            return x

        for b in batches:
            for x, y in zip(b["a"].tolist(), b["b"].tolist(), strict=True):
                x, y = root(x), root(y)
                top[max(x, y)] = min(x, y)
        nodes = np.fromiter(top, np.int64, len(top))
        yield pd.DataFrame({"node": nodes, "component": np.fromiter(map(root, list(top)), np.int64, len(top))})

    return edges.where("a != b").select("a", "b").repartition(1).mapInPandas(join, "node long, component long")
