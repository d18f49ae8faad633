"""The stages together against brute force, on a small folder of tables."""

import importlib.util
import os
import random

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="module")
def pipeline():
    spec = importlib.util.spec_from_file_location("corpus_pipeline", f"{ROOT}/corpus_pipeline.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    item, shared = text(20), text(25)
    rows = [(i, text(120)) for i in range(30)]
    rows += [(40, rows[3][1]), (41, rows[4][1]), (42, rows[4][1])]  # copies
    rows += [(50, f"{text(80)} {shared} {text(10)}"), (51, f"{text(70)} {shared} {text(30)}")]  # a shared passage
    rows += [(60, f"{text(80)} {item.upper()} {text(30)}")]  # a benchmark item
    rows += [(70, "short text"), (71, None), (72, "# | $ " * 60), (73, "again and again and " * 60)]  # rejected
    path = tmp_path_factory.mktemp("tables")
    full = [(d, t, "en", "src", len(t) if t else None) for d, t in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages(spark, pipeline, folder):
    from gridloom.llm.common import Scratch

    scratch, docs, seen = Scratch(spark, "t"), spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        docs = scratch.table(stage(spark, docs, folder), name)
        seen[name] = {r.doc_id: r for r in docs.collect()}
        if name != "best_fit_packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {n: set(v) for n, v in seen.items()}
    assert ids["quality_rules"] == {*range(30), 40, 41, 42, 50, 51, 60}
    assert ids["simhash_near_dedup"] == ids["quality_rules"] - {40, 41, 42}
    assert ids["suffix_array_dedup"] == ids["simhash_near_dedup"]
    before, after = seen["simhash_near_dedup"], seen["suffix_array_dedup"]
    changed = {d for d in after if after[d].text != before[d].text}
    assert changed == {51} and after[51].n_chars == len(after[51].text) < before[51].n_chars - 50
    assert ids["benchmark_decontamination"] == ids["suffix_array_dedup"] - {60}
    assert ids["best_fit_packing"] == ids["benchmark_decontamination"]


def test_run_equals_its_stages(spark, pipeline, folder):
    rows = pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in rows} == {*range(30), 50, 51}
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 1024


def test_empty_tables(spark, pipeline, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_all_queries_are_registered(monkeypatch):
    monkeypatch.syspath_prepend(ROOT)
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)
