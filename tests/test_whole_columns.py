"""Queries that must read whole columns, against brute force on rows longer than any sample."""

import re
from xml.sax.saxutils import escape

import pytest

from gridloom.plans.registry import QUERIES


@pytest.mark.parametrize("name", ["xml_escape"])
def test_xml_escape_whole(spark, tmp_path, name):
    pages = [(1, "<p>" * 200 + "a & \"b\" 'c'"), (2, "&amp;"), (3, ""), (4, None), (5, "é\U0001f600<" * 5000)]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.xml for r in QUERIES[name](spark, str(tmp_path)).collect()}
    assert got == {i: h if h is None else escape(h, {'"': "&quot;", "'": "&apos;"}) for i, h in pages}


@pytest.mark.parametrize("name", ["code_lists"])
def test_code_lists_whole(spark, tmp_path, name):
    docs = [(1, "ab, Cd " * 100 + "late ab"), (2, None), (3, ""), (4, " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}-7" for i in range(5000)))]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.codes for r in QUERIES[name](spark, str(tmp_path)).collect()}
    parse = lambda t: " ".join(dict.fromkeys(x for x in re.split(r"[\s,]+", re.sub(r"[^A-Za-z,\s]", "", t).upper()) if x))
    assert got == {i: "" if t is None else parse(t) for i, t in docs} | {2: got[2]}
    assert not got[2]
