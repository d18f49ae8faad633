"""Undo and redo: the fold against a list of all versions with a cursor, in a batch and in a stream."""

import random

from gridloom.operators.history import replay
from gridloom.streaming.history import boards_now

COLUMNS = "board long, version long, op string, at long"


def by_cursor(ops, most):
    """(shown, undoable, redoable) after each op by a list of versions and a place in it: an edit cuts what lies behind the place."""
    versions, place, out = [None], 0, []
    for op, v in ops:
        if op == "edit":
            versions = [*versions[: place + 1], v][-(most + 1) :]
            place = len(versions) - 1
        elif op == "undo":
            place = max(0, place - 1)
        elif op == "redo":
            place = min(len(versions) - 1, place + 1)
        out.append((versions[place], place, len(versions) - 1 - place))
    return out


def log(boards, n):
    rng = random.Random(7)
    return [(b, b * 1000 + k, rng.choices(["edit", "undo", "redo", "look"], [5, 4, 3, 1])[0], k) for b in range(boards) for k in range(n)]


def wanted(rows, most):
    out = set()
    for b in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == b), key=lambda r: r[3])
        out |= {(b, r[1], *s) for r, s in zip(own, by_cursor([(r[2], r[1]) for r in own], most), strict=True)}
    return out


def test_replay_equals_a_list_with_a_cursor(spark):
    rows = log(5, 200)
    df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), COLUMNS).withColumnRenamed("at", "shown")  # a clashing name
    for most in (3, 40):
        got = [tuple(r) for r in replay(df, ["shown"], most).collect()]
        assert len(got) == len(rows) and set(got) == wanted(rows, most)


def test_an_edit_drops_redo_and_nulls_are_kept(spark):
    rows = [(None, 1, "edit", 1), (None, 2, "undo", 2), (None, None, "edit", 3), (None, 4, "redo", 4), (7, 5, None, 1), (7, 2**53 + 1, "edit", 2)]
    got = {tuple(r) for r in replay(spark.createDataFrame(rows, COLUMNS), ["at"]).collect()}
    assert got == {(None, 1, 1, 1, 0), (None, 2, None, 0, 1), (None, None, None, 1, 0), (None, 4, None, 1, 0), (7, 5, None, 0, 0), (7, 2**53 + 1, 2**53 + 1, 1, 0)}
    assert replay(spark.createDataFrame([], COLUMNS), ["at"]).collect() == []


def test_the_stream_gives_the_rows_of_the_batch(spark, tmp_path):
    rows, source = log(3, 60), str(tmp_path / "in")
    for a in range(0, 60, 20):  # one file a micro-batch, in order
        spark.createDataFrame([r for r in rows if a <= r[3] < a + 20], COLUMNS).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).parquet(source)
    run = boards_now(stream, "at").writeStream.format("memory").queryName("boards_now").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    got = {tuple(r) for r in spark.table("boards_now").collect()}
    assert got == {tuple(r) for r in replay(spark.createDataFrame(rows, COLUMNS), ["at"]).collect()} == wanted(rows, 40)
