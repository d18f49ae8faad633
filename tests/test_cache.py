"""The evidence table: what is computed again, damage, equal images, regions."""

import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import cache
from gridloom.operators.local import region_evidence

SIZE = (12, 9, 5, 4)
SCHEMA = "grid_id long, idx int, x int, y int, r int, g int, b int, a int"


def images(n, seed=5, first=0):
    rng = np.random.default_rng(seed)
    w, h = SIZE[:2]
    return [(first + g, y * w + x, x, y, *map(int, rng.integers(0, 4, 3) * 80), int(rng.choice([255, 255, 255, 0]))) for g in range(n) for y in range(h) for x in range(w)]


def values(df):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select("grid_id", "cx", "cy", *cache.VALUES).collect())


@pytest.fixture
def computed(monkeypatch):
    """The images of each call of region_evidence that the table made."""
    seen = []

    def watched(pixels, *size):
        seen.append({r.grid_id for r in pixels.select("grid_id").distinct().collect()})
        return region_evidence(pixels, *size)

    monkeypatch.setattr(cache, "region_evidence", watched)
    return seen


def test_second_run_computes_what_is_new(spark, tmp_path, computed):
    folder = f"file://{tmp_path}/table"
    rows = images(6)
    df = spark.createDataFrame(rows, SCHEMA)
    want = values(region_evidence(df, *SIZE))
    assert values(cache.cached_evidence(df, folder, *SIZE)) == want and computed == [{0, 1, 2, 3, 4, 5}]
    assert values(cache.cached_evidence(df, folder, *SIZE)) == want and len(computed) == 1
    # Image 2 under another id, its rows in another order, and a new one.
    more = [(7, *r[1:]) for r in rows if r[0] == 2][::-1] + images(1, 9, 20)
    more = spark.createDataFrame(more, SCHEMA).withColumn("key", F.lit("x"))
    assert values(cache.cached_evidence(more, folder, *SIZE)) == values(region_evidence(more, *SIZE)) and computed[1:] == [{20}]
    # Other settings share nothing.
    cache.cached_evidence(df, folder, 12, 9, 4, 3)
    assert len(computed) == 3


def test_damage_is_noticed(spark, tmp_path, computed):
    folder = f"file://{tmp_path}/table"
    df = spark.createDataFrame(images(5), SCHEMA)
    want = values(cache.cached_evidence(df, folder, *SIZE))
    table = spark.read.parquet(folder)
    keys = sorted(r.key for r in table.select("key").distinct().collect())
    harmed = table.where(~((F.col("key") == keys[0]) & (F.col("cx") == 1) & (F.col("cy") == 1)))
    harmed = harmed.withColumn("contrast", F.when((F.col("key") == keys[1]) & (F.col("cx") == 2), 0.125).otherwise(F.col("contrast")))
    other = f"file://{tmp_path}/harmed"
    harmed.write.partitionBy("settings", "part").parquet(other)
    ids = {r.key: r.grid_id for r in cache.image_keys(df).collect()}
    assert values(cache.cached_evidence(df, other, *SIZE)) == want
    assert computed[1:] == [{ids[keys[0]], ids[keys[1]]}]
    assert values(cache.cached_evidence(df, other, *SIZE)) == want and len(computed) == 2


def test_only_asked_folders_are_read(spark, tmp_path):
    folder = f"file://{tmp_path}/table"
    df = spark.createDataFrame(images(8), SCHEMA)
    want = values(cache.cached_evidence(df, folder, *SIZE, digits=2))
    parts = glob.glob(f"{tmp_path}/table/settings=*/part=*")
    assert len(parts) == len({r.key[:2] for r in cache.image_keys(df).collect()})
    one = cache.cached_evidence(df.where("grid_id = 3"), folder, *SIZE, digits=2)
    assert values(one) == [v for v in want if v[0] == 3]
    read = [f for f in one.inputFiles() if "/settings=" in f]
    assert read and len({f.split("/part=")[1][:2] for f in read}) <= len(parts)
    scan = next(x for x in one._jdf.queryExecution().executedPlan().toString().split("\n") if "PartitionFilters" in x and "/table" in x)
    assert "part" in scan.split("PartitionFilters: [")[1].split("]")[0]


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], SCHEMA)
    assert cache.cached_evidence(df, f"file://{tmp_path}/none", *SIZE).collect() == []
    clear = spark.createDataFrame([(*r[:7], 0) for r in images(1)], SCHEMA)
    assert cache.cached_evidence(clear, f"file://{tmp_path}/none", *SIZE).collect() == []


def test_changed_region(spark, computed):
    before = images(40)
    rng = np.random.default_rng(6)
    after, at = [], {}
    for g in range(40):
        w, h = rng.integers(1, 4, 2)
        at[g] = (int(rng.integers(0, 13 - w)), int(rng.integers(0, 10 - h)), int(w), int(h))
    for r in before:
        x, y, w, h = at[r[0]]
        hit = r[0] > 2 and x <= r[2] < x + w and y <= r[3] < y + h
        after.append((*r[:4], *((255 - v for v in r[4:7]) if hit else r[4:7]), (0 if r[0] % 2 else 255) if hit else r[7]))
    a, b = spark.createDataFrame(before, SCHEMA), spark.createDataFrame(after, SCHEMA)
    boxes = cache.changed_boxes(a, b)
    assert {r.grid_id for r in boxes.collect()} == {*range(3, 40)}
    got = cache.evidence_again(region_evidence(a, *SIZE), b, boxes, *SIZE)
    assert values(got) == values(region_evidence(b, *SIZE))
    assert computed == [{*range(3, 40)}]


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_evidence_deals_pixels_twice(spark):
    df = spark.createDataFrame(images(3), SCHEMA)
    assert exchanges(region_evidence(df, *SIZE)) == 2


def test_small_boxes_dont_merge_the_work(spark):
    """Pixels are neither broadcast nor worked on in the one task that holds the few boxes."""
    df = spark.createDataFrame(images(8), SCHEMA)
    boxes = spark.createDataFrame([(g, 1, 1, 2, 2) for g in range(8)], "grid_id long, l int, t int, r int, b int").coalesce(1)
    none = region_evidence(df, *SIZE).where("false")
    out = cache.evidence_again(none, df, boxes, *SIZE)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "REPARTITION_BY_NUM" in plan.split("MapInArrow")[1]
    assert values(out) == [v for v in values(region_evidence(df, *SIZE)) if v[1] <= 1 and v[2] <= 1]
