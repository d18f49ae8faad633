"""Bounded samples of labelled rows, and the split between rows to learn from and held-out rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def fold(doc_id: Column | str = "doc_id") -> Column:
    """crc32 of the doc_id as text, modulo FOLDS; fold 0 is held out. A null doc_id is held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce((F.crc32(c.cast("string").cast("binary")) % FOLDS).cast("int"), F.lit(0))


def sample_labelled(docs: DataFrame, labels: DataFrame, column: str, per_class: dict[int, int], max_bytes: int, more: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, target, fold) of at most ``per_class`` rows of each label outside fold 0: those of smallest hash.

    Every row has the same chance, whatever the input order. Null labels and texts over ``max_bytes`` aren't drawn; a
    doc_id that is labelled twice counts with its smaller label. The ids joined to the documents are as bounded as the sample.
    ``more`` names further columns of ``docs``, null where it has none.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("target"))
    known = known.where("doc_id IS NOT NULL AND target IS NOT NULL").groupBy("doc_id").agg(F.min("target").alias("target")).where(fold() > 0)
    known = known.withColumn("_at", F.xxhash64("doc_id", F.lit(11)))
    counts = {r.target: r.n for r in known.where(F.col("target").isin(*per_class)).groupBy("target").agg(F.count(F.lit(1)).alias("n")).collect()}
    drawn = None
    for value, n in per_class.items():
        # A threshold on the hash leaves about four times as many rows for the final choice, spread over all tasks.
        few = known.where((F.col("target") == value) & (F.pmod("_at", F.lit(max(1, counts.get(value, 0)))) < 4 * n))
        part = few.orderBy("_at", "doc_id").limit(n).drop("_at")
        drawn = part if drawn is None else drawn.unionByName(part)
    extra = [F.col(c).cast("string").alias(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in more]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *extra).where(F.octet_length("text") <= max_bytes)
    return texts.join(F.broadcast(drawn), "doc_id").withColumn("fold", fold())
