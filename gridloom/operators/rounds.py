"""Work in rounds of joins: cutting the lineage between rounds, and pointer doubling over trees."""

from __future__ import annotations

import atexit
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, in the one that ``spark.checkpoint.dir`` names (a temporary one only where one machine runs all and none is named)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if root is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.TemporaryDirectory(prefix="gridloom-rounds-")
            atexit.register(folder.cleanup)
            root = "file://" + folder.name
        sc.setCheckpointDir(root)
    return sc.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def ascend(tree: DataFrame, mark: Column | None = None, record: str | None = None, key: str = "id", parent: str = "parent") -> DataFrame:
    """(record, key, top, depth, marked, state) of each row of ``tree``: its root, the steps to it, and whether it or a row above it is marked.

    ``state`` is ``tree`` for rows with a root, ``cycle`` for rows on a cycle and ``below a cycle`` for rows that lead to one; the last two
    have no top and no depth. A row whose parent is null or isn't there is a root. Every row points to a row above it, and pointers
    are replaced by what they point at: the distance doubles each round, so a tree of any depth takes logarithmically many joins. Rows
    still under way after as many steps as there are rows are on cycles. A key that occurs twice in a record counts once, with its
    smallest parent, and is marked if one of its rows is; null keys are left out; an empty table gives no rows.
    """
    by = [F.col(record).alias("record")] if record else [F.lit(0).alias("record")]
    marked = F.coalesce(mark, F.lit(False)) if mark is not None else F.lit(False)
    rows = tree.where(F.col(key).isNotNull()).select(*by, F.col(key).alias("k"), F.col(parent).alias("up"), marked.alias("marked"))
    rows = rows.groupBy("record", "k").agg(F.min("up").alias("up"), F.max("marked").alias("marked"))
    there = rows.select("record", F.col("k").alias("up"), F.lit(True).alias("known"))
    start = rows.join(there, ["record", "up"], "left").select("record", "k", "marked", F.when(F.col("known"), F.col("up")).alias("at"))
    state = settled(start.select("record", "k", F.coalesce("at", "k").alias("at"), F.col("at").isNotNull().cast("long").alias("depth"), "marked", F.col("at").isNull().alias("done")))
    steps, total = 1, state.count()
    while steps <= total and not state.where("NOT done").isEmpty():
        above = state.select("record", F.col("k").alias("at"), F.col("at").alias("to"), F.col("depth").alias("further"), F.col("marked").alias("over"), F.col("done").alias("there"))
        moved = state.where("NOT done").join(above, ["record", "at"])
        moved = moved.select("record", "k", F.col("to").alias("at"), (F.col("depth") + F.col("further")).alias("depth"), (F.col("marked") | F.col("over")).alias("marked"), F.col("there").alias("done"))
        state, steps = settled(state.where("done").unionByName(moved)), 2 * steps
    # After at least as many steps as rows every pointer under way lies on its cycle, and those of a cycle's rows cover it.
    ring = state.where("NOT done").select("record", F.col("at").alias("k"), F.lit(True).alias("ring")).distinct()
    named = state.join(ring, ["record", "k"], "left")
    kind = F.when(F.col("done"), "tree").when(F.col("ring"), "cycle").otherwise("below a cycle")
    out = named.select("record", F.col("k").alias(key), F.when(F.col("done"), F.col("at")).alias("top"), F.when(F.col("done"), F.col("depth")).alias("depth"), "marked", kind.alias("state"))
    return out.withColumnRenamed("record", record) if record else out.drop("record")
